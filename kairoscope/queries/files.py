"""Queries of sources, sinks and pipelines: tables are written in a source's format into the shared folder, read back by its
operator and compared with what the tables say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.functions import parse, text
from kairoscope.operators import chunks, consensus, diagnosis, evidence, graph, matching, quality, vectors
from kairoscope.plans import pipelines
from kairoscope.queries import tables as t
from kairoscope.sources import files, sinks
from kairoscope.storage import fresh_path, stored

#: Onset terms and their windows in years, as the annotations' crosswalk has them.
TERMS = (("HP:0003577", 0.0, 0.0), ("HP:0003593", 0.08, 1.0), ("HP:0011463", 1.0, 5.0), ("HP:0003621", 5.0, 15.0), ("HP:0003581", 40.0, 120.0))


def written(lines: DataFrame, name: str, compression: str = "none", per_file: int = 0) -> str:
    """The path of lines (value) as text files; per_file bounds the lines of a file."""
    path = fresh_path(lines.sparkSession, name)
    lines.select("value").write.option("compression", compression).option("maxRecordsPerFile", per_file).text(path)
    return path


def rooted(lines: DataFrame, by: Column) -> DataFrame:
    """XML documents of the lines of each group, of which there are few."""
    return lines.groupBy(by.alias("by")).agg(F.concat(F.lit("<L>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</L>")).alias("value"))


def s(c: str) -> Column:
    return F.col(c).cast("string")


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity")
    lines = li.select(F.to_json(F.struct(*li.columns)).alias("value"))
    path = written(lines.unionByName(lines.filter("length(value) % 3 = 0").select(F.lit("").alias("value"))), "lines", "gzip")
    return files.json_lines(spark, path, "l_orderkey long, l_returnflag string, l_quantity double").filter("corrupt IS NULL").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def tolerant(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    whole = F.to_json(F.struct(*li.columns))
    path = written(li.select(F.when(F.col("l_linenumber") == 3, F.left(whole, F.lit(20))).otherwise(whole).alias("value")), "broken")
    return files.tolerant(spark, path, "l_orderkey long, l_linenumber int, l_returnflag string").filter("l_orderkey IS NOT NULL").groupBy("l_linenumber").agg(F.count("*").alias("n"))


def static_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "kg")
    t.static_graph(spark, sf).select(*sinks.CSV_COLUMNS).write.option("header", True).csv(path)
    kg = files.static_graph(spark, path)
    some = t.table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(s("s_suppkey").alias("id"))
    return files.graph_of(kg, some).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("y_id").alias("n_nodes"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "customer")
    path = written(c.select(F.concat_ws("\t", s("c_custkey"), "c_name").alias("value")), "list")
    return files.name_list(spark, path).select("id", "name")


def _annotations(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    term = F.element_at(F.array(*[F.lit(x) for x, _, _ in TERMS], F.lit("")), (F.col("l_quantity").cast("int") % 6 + 1))
    fields = F.concat_ws("\t", F.concat(F.when(F.col("l_suppkey") % 7 == 0, "ORPHA:").otherwise("OMIM:"), s("l_suppkey")), F.lit("name"), F.when(F.col("l_linenumber") == 2, "not").otherwise(""), F.concat(F.lit("HP:"), s("l_partkey")), F.lit("r"), F.lit("e"), term, F.lit(""), F.lit(""), F.lit(""), F.when(F.col("l_returnflag") == "R", "I").otherwise("P"), F.lit("x"))
    lines = li.select(fields.alias("value"))
    return files.annotations(spark, written(lines.unionByName(lines.select(F.lit("# comment").alias("value")).distinct()), "annotations"))


def annotation_edges(spark: SparkSession, sf: str) -> DataFrame:
    return files.annotation_edges(_annotations(spark, sf)).groupBy("database_id").agg(F.count("*").alias("n"), F.count_distinct("hpo_id").alias("n_terms"))


def annotation_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return files.annotation_ranges(_annotations(spark, sf), "database_id", "hpo_id").select("database_id", "hpo_id", "min_age", "max_age", F.array_join("onset_terms", ",").alias("terms"))


def rare_diseases(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    entry = lambda name: F.concat(F.lit("<AverageAgeOfOnset><Name lang='en'>"), F.lit(name), F.lit("</Name></AverageAgeOfOnset>"))
    ages = F.concat(F.when(F.col("p_size") % 2 == 0, entry("Infancy")).otherwise(""), F.when(F.col("p_size") % 3 == 0, entry("Adult")).otherwise(""), entry("No data available"))
    lines = p.select("p_partkey", F.concat(F.lit("<Disorder><OrphaCode>"), s("p_partkey"), F.lit("</OrphaCode><Name lang='en'>"), "p_name", F.lit("</Name><AverageAgeOfOnsetList>"), ages, F.lit("</AverageAgeOfOnsetList></Disorder>")).alias("value"))
    return files.rare_diseases(spark, written(rooted(lines, F.floor(F.col("p_partkey") / 100)), "disorders", per_file=1)).select("gold_id", "name", "min_age", "max_age")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON file of questions for each order's customer nation; documents are order lines."""
    o, li, c = (t.table(spark, sf, n) for n in ("orders", "lineitem", "customer"))
    url = F.concat(F.lit("http://x/"), s("l_linenumber"))
    by_order = li.select("l_orderkey", "l_linenumber", url.alias("u")).distinct().groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "u"))), lambda x: x["u"]).alias("documents"))
    q = o.join(by_order, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    snippets = F.transform(F.filter("documents", lambda d: d != "http://x/1"), lambda d: F.struct(d.alias("document"), F.lit("said").alias("text")))
    one = F.struct(s("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, "body").alias("body"), F.lit("list").alias("type"), "documents", snippets.alias("snippets"))
    docs = q.groupBy("c_nationkey", (F.col("o_orderkey") % 50).alias("part")).agg(F.to_json(F.struct(F.collect_list(one).alias("questions"))).alias("value"))
    return files.questions(spark, written(docs, "questions", per_file=1))


def question_ids(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("id", F.size("with_snippet").alias("n_with"), F.array_join("without_snippet", ",").alias("without"))


def question_snippets(spark: SparkSession, sf: str) -> DataFrame:
    found = chunks.snippets(questions(spark, sf))
    return found.select("chunk_id", "source_type")


def choices(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    one = F.struct(F.col("p_name").alias("question"), F.create_map(F.lit("A"), "p_brand", F.lit("B"), "p_type").alias("options"), F.col("p_brand").alias("answer"), F.lit("A").alias("answer_idx"))
    path = written(p.select(F.to_json(one).alias("value")).unionByName(p.select(F.lit("{oops").alias("value")).limit(1)), "choices")
    return files.choices(spark, path).filter("question IS NOT NULL").select("question", F.try_element_at("options", F.lit("B")).alias("second"), "answer")


def abstracts(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "customer")
    fields = [F.col("c_name").alias("QUESTION"), F.array("c_mktsegment", F.lit("end")).alias("CONTEXTS"), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("NO").alias("final_decision")]
    keyed = c.filter("c_nationkey % 2 = 0").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(s("c_custkey"), F.struct(*fields))))).alias("value"))
    listed_ = c.filter("c_nationkey % 2 = 1").groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct(s("c_custkey").alias("pmid"), *fields))).alias("value"))
    return files.abstracts(spark, written(keyed.unionByName(listed_), "abstracts", per_file=1))


def yaml_files(spark: SparkSession, sf: str) -> DataFrame:
    n = t.table(spark, sf, "nation").join(t.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    body = F.concat(F.lit("disease_id: 'MONDO:"), s("n_nationkey"), F.lit("'\nname: "), "n_name", F.lit("\ngenes: [G1, "), "r_name", F.lit("]\nrare: "), F.when(F.col("n_nationkey") % 2 == 0, "true").otherwise("false"))
    return files.yaml_documents(spark, written(n.select(body.alias("value")), "yaml", per_file=1), {"disease_id": "string", "name": "string", "genes": "array<string>", "rare": "boolean"}).select("disease_id", "name", F.array_join("genes", ",").alias("genes"), "rare")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    words = F.when(F.col("o_orderkey") % 3 == 0, 20).otherwise(120)
    kind = F.when(F.col("o_orderstatus") == "P", "Editorial").otherwise("Review")
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name.split(' ')[0]}>"))
    date = F.concat(tag("Year", F.year("o_orderdate").cast("string")), tag("Month", F.date_format("o_orderdate", "MMM")))
    article = F.concat(tag("Journal", F.concat(tag("JournalIssue", tag("PubDate", date)), tag("Title", F.lit("Brain")))), tag("ArticleTitle", s("o_custkey")), tag("Abstract", tag("AbstractText Label='AIM'", F.repeat(F.lit("w "), words))), tag("PublicationTypeList", tag("PublicationType", kind)))
    lines = o.select("o_orderkey", tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", s("o_orderkey")), tag("Article", article)))).alias("value"))
    return files.articles(spark, written(rooted(lines, F.floor(F.col("o_orderkey") / 400)), "articles", per_file=1)).select("pmid", "title", F.left("abstract", F.lit(6)).alias("begins"), F.col("publication_date").cast("string").alias("published"))


def phenopackets(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    feature = F.struct(F.struct(F.concat(F.lit("HP:"), s("l_suppkey")).alias("id"), F.concat(F.lit("Sign "), s("l_suppkey")).alias("label")).alias("type"), (F.col("l_returnflag") == "R").alias("excluded"), F.struct(F.struct(F.concat(F.lit("P"), F.col("l_quantity").cast("int").cast("string"), F.lit("Y")).alias("iso8601duration")).alias("age")).alias("onset"))
    cases = li.groupBy("l_orderkey").agg(F.collect_list(feature).alias("f"), F.min("l_partkey").alias("p"))
    name = F.concat(F.lit("Disease "), (F.col("p") % 40).cast("string"))
    one = F.struct(s("l_orderkey").alias("id"), F.array(F.struct(F.struct(F.concat(F.lit("OMIM:"), (F.col("p") % 40).cast("string")).alias("id"), name.alias("label")).alias("term"))).alias("diseases"), F.col("f").alias("phenotypicFeatures"))
    docs = cases.groupBy((F.col("l_orderkey") % 64).alias("part")).agg(F.to_json(F.collect_list(one)).alias("value"))
    found = files.phenopacket_onsets(files.phenopackets(spark, written(docs, "packets", per_file=1)), 2)
    return found.select("disease", "phenotype", "n_cases", "onset_min", "onset_max")


def approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Parts are products of applications (suppliers), whose orders by key are submissions."""
    root = fresh_path(spark, "approvals")
    p, x, o = (t.table(spark, sf, n) for n in ("part", "supplier", "orders"))
    n = x.count()
    tables = {
        "products": p.select(s("p_brand").alias("ActiveIngredient"), F.col("p_name").alias("DrugName"), (F.col("p_partkey") % n + 1).cast("string").alias("ApplNo")),
        "applications": x.select(s("s_suppkey").alias("ApplNo"), F.when(F.col("s_suppkey") % 4 == 0, "NDA").otherwise("ANDA").alias("ApplType")),
        "submissions": o.select((F.col("o_orderkey") % n + 1).cast("string").alias("ApplNo"), F.when(F.col("o_orderstatus") == "O", "AP").otherwise("TA").alias("SubmissionStatus"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("SubmissionStatusDate")),
    }
    for name, rows in tables.items():
        rows.write.option("sep", "\t").option("header", True).csv(f"{root}/{name}")
    found = files.approvals(*[files.tab_separated(spark, f"{root}/{name}") for name in tables])
    return found.select("ingredient", F.col("approved").cast("string").alias("approved"), "ApplNo")


def quality_written(spark: SparkSession, sf: str) -> DataFrame:
    judged = stored(quality.validated(t.raw_triples(spark, sf)), "judged")
    valid, rejects = judged.filter("reject_reason IS NULL").drop("reject_reason"), judged.filter("reject_reason IS NOT NULL")
    root = fresh_path(spark, "quality")
    some = valid.withColumn("disease_profile_id", (F.col("disease_profile_id").cast("long") % 8).cast("string"))  # partitions are folders
    sinks.write_quality(some, rejects, valid.agg(F.count("*").alias("n")), root)
    kept = spark.read.schema(some.schema).json(f"{root}/validated").groupBy(F.concat(F.lit("profile "), s("disease_profile_id")).alias("part")).agg(F.count("*").alias("n"))
    gone = spark.read.schema(rejects.schema).json(f"{root}/rejected").groupBy(F.col("reject_reason").alias("part")).agg(F.count("*").alias("n"))
    return kept.unionByName(gone).unionByName(spark.read.json(f"{root}/report").select(F.lit("report").alias("part"), "n"))


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    raw = t.raw_triples(spark, sf)
    valid = quality.validated(raw).filter("reject_reason IS NULL").withColumns({"score": F.lit(None).cast("double"), "study_type": F.lit(None).cast("string")})
    made = quality.to_edges(valid)
    return quality.report(raw.withColumn("relation", text.graph_relation(F.col("relation"))), made, "relation").select("relation", "n_input", "n_valid", "n_edges", "valid_grade")


def edge_json(spark: SparkSession, sf: str) -> DataFrame:
    path = written(sinks.as_json(t.edges(spark, sf)), "edges", "gzip")
    back = spark.read.schema(t.edges(spark, sf).schema).json(path)
    return back.select("edge_id", "relation", F.col("temporal.discovery_date").cast("string").alias("discovered"), F.col("evidence.source_ids")[0].alias("source"), "ord")


def evidence_graph(spark: SparkSession, sf: str) -> DataFrame:
    e = sinks.evidence_nodes(t.edges(spark, sf))
    return e.select(F.explode("nodes").alias("n")).groupBy(F.col("n.type").alias("type")).agg(F.count("*").alias("n"), F.count_distinct("n.id").alias("n_ids"))


def vectors_written(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "vectors")
    docs = t.table(spark, sf, "documents").select(F.concat(F.lit("chapter "), s("doc_id")).alias("source_name"), s("doc_id").alias("chunk_id"), F.lit("textbook").alias("source_type"), "text")
    sinks.write_vectors(vectors.encoded(docs.filter("text IS NOT NULL")), path)
    return vectors.counts(spark.read.parquet(path)).select("source_type", "count")


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of which the even ones are done, and those with few orders not enough."""
    path = fresh_path(spark, "manifest")
    n = t.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_consensus"))
    sinks.mark_finished(n.select(s("l_suppkey").alias("disease_id"), (F.col("l_suppkey") % 2 == 0).alias("validated"), "n_consensus"), path)
    wanted = t.table(spark, sf, "supplier").select(s("s_suppkey").alias("disease_id"))
    return evidence.pending(wanted, sinks.finished(spark, path), least=600)


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    edges = t.edges(spark, sf).withColumn("edge_id", F.concat_ws("|", "source_id", "relation"))
    found = consensus.consolidated(edges)
    e = F.col("evidence")
    return found.select("edge_id", "ord", "n_members", F.size(e["source_ids"]).cast("long").alias("n_sources"), F.round(e["credibility_score"], 6).alias("credibility"))


def both_ways(spark: SparkSession, sf: str) -> DataFrame:
    return graph.both_directions(t.edges(spark, sf), F.lit("Supplier 7"), 20).select("edge_id", "direction")


def subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.disease_subgraph(t.static_graph(spark, sf), F.lit("7")).groupBy("relation").agg(F.count("*").alias("n"))


def cited(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cited(t.edges(spark, sf).filter("relation = 'indication'"))


def keyword_triples(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each part, whose words are a supplier and a stage."""
    p = t.table(spark, sf, "part")
    asked = p.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("Does supplier "), (F.col("p_partkey") % 9).cast("string"), F.lit(" open contraindication?")).alias("question"), s("p_partkey").alias("disease_id"))
    return graph.keyword_ranked(asked, t.edges(spark, sf), 3).select("question_id", "edge_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def age_phrases(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int").cast("string")
    said = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("at "), q, F.lit(" months"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("between "), q, F.lit(" and 60 years of age"))).when(F.col("l_linenumber") == 3, F.lit("in the Fourth decade")).otherwise(F.lit("unknown"))
    w = parse.age_phrase(said)
    return li.select(t.ord_().alias("ord"), F.round(w["min"], 6).alias("low"), F.round(w["max"], 6).alias("high"))


def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as models' outputs: a list, a wrapped one, a fenced one, a single record, junk."""
    li = t.table(spark, sf, "lineitem")
    record = F.to_json(F.struct(s("l_partkey").alias("subject"), s("l_suppkey").alias("object")))
    ways = F.array(F.concat(F.lit("["), record, F.lit("]")), F.concat(F.lit('{"triples": ['), record, F.lit(", "), record, F.lit("]}")), F.concat(F.lit("```json\n["), record, F.lit("]\n```")), record, F.concat(F.lit("well: ["), record, F.lit("] so")), F.lit("{nothing"), F.lit(""))
    out = li.select("l_linenumber", parse.json_records(F.element_at(ways, F.col("l_linenumber").cast("int"))).alias("r"))
    return out.groupBy("l_linenumber").agg(F.sum(F.size("r")).alias("n"))


def parsed_records(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    record = F.create_map(F.lit("subject"), F.concat(F.lit(" "), s("l_partkey")), F.lit("relation"), t.relation(F.col("l_returnflag")), F.lit("object"), F.when(F.col("l_linenumber") == 2, "none").otherwise(s("l_suppkey")), F.lit("confidence"), F.element_at(F.array(F.lit("HIGH"), F.lit("medium"), F.lit("Low"), F.lit("odd")), (F.col("l_linenumber") % 4 + 1).cast("int")))
    r = quality.parsed_record(record, s("l_orderkey"), s("l_suppkey"))
    return li.select(r.alias("r")).filter("r IS NOT NULL").groupBy("r.relation", "r.confidence").agg(F.count("*").alias("n"), F.count_distinct("r.subject").alias("n_subjects"))


def normalised_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Part names: known ones, ones that an embedding or a judge finds, and others."""
    p = t.table(spark, sf, "part").select("p_name").distinct()
    stock = p.filter("p_name < 'm'").select(F.lower("p_name").alias("name_key"), F.lower("p_name").alias("node_id"), F.lit("drug").alias("node_type"), F.col("p_name").alias("node_name"))
    near = F.when(F.length("p_name") % 3 == 0, 0.9).when(F.length("p_name") % 3 == 1, 0.7).otherwise(0.3)
    linked = p.select(F.col("p_name").alias("mention"), F.lit("L").alias("link_id"), F.lit("link").alias("link_name"), near.alias("link_score"))
    judged = p.filter("length(p_name) % 2 = 0").select(F.col("p_name").alias("mention"), F.lit("J").alias("judge_id"), F.lit("judge").alias("judge_name"), F.lit(0.75).alias("judge_score"))
    asked = p.select(F.col("p_name").alias("mention"), F.lit("drug").alias("mention_type"))
    return matching.resolution_rate(matching.normalised(asked, stock, linked, judged)).select("method", "n")


def gold_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names as gold: as they are, by a synonym, with a letter left out."""
    c = t.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("client "), F.translate(F.md5(s("c_custkey")), "0123456789", "qrtvwxyzkh")).alias("name"))
    own = c.select("name", F.array(F.concat(F.lit("Alias "), s("c_custkey"))).alias("synonyms"))
    asked = c.select(F.when(F.col("c_custkey") % 3 == 0, F.upper("name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("ALIAS "), s("c_custkey"))).otherwise(F.concat(F.left("name", F.lit(20)), F.substring("name", 22, 30))).alias("name"))
    return matching.by_name(asked, own)


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as concepts: exact names, abbreviations, and names with a letter too many."""
    x = t.table(spark, sf, "supplier").select("s_suppkey", F.translate(F.md5(s("s_suppkey")), "0123456789", "qrtvwxyzkh").alias("name"), F.concat(F.lit("ab"), s("s_suppkey")).alias("short"))
    known = x.select(s("s_suppkey").alias("cui"), "name", F.array("short").alias("aliases"))
    asked = x.select(F.when(F.col("s_suppkey") % 3 == 0, F.initcap("name")).when(F.col("s_suppkey") % 3 == 1, F.concat("name", F.lit("zz"))).otherwise(F.lit("nothing like it")).alias("mention"))
    return matching.matched_concepts(asked, known).select("mention", "cui", "score", "method")


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    a = p.select(F.upper("p_name").alias("name"))
    b = p.filter("p_size % 2 = 0").select(F.concat(F.lit("x "), "p_name").alias("name"))
    return diagnosis.overlap_diseases(a, b, p.select(F.col("p_name").alias("name"))).select("name", F.col("match0").alias("second"), F.col("match1").alias("third"))


def disease_list(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "customer")
    rows = c.select(s("c_custkey").alias("disease_id"), F.concat(F.lit("Syndrome "), s("c_custkey")).alias("disease_name"))
    wanted = c.filter("c_custkey % 4 = 0").select(F.upper(F.concat(F.lit(" syndrome "), s("c_custkey"))).alias("name"))
    found = c.filter("c_custkey % 10 = 1").select(F.concat(F.lit("Syndrome "), s("c_custkey")).alias("name"))
    return evidence.disease_list(rows, wanted, found)


def batches(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    done = li.select(s("l_partkey").alias("result"), F.when(F.col("l_returnflag") == "R", "late").alias("error"), (F.col("l_linestatus") == "O").alias("kg_coverage"))
    return evidence.batch_summary(done).withColumn("kg_hit_rate", F.round("kg_hit_rate", 6))


def strategies(spark: SparkSession, sf: str) -> DataFrame:
    n = t.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n1"))
    found = evidence.strategy(F.col("n") * 20, F.col("n1") % 3)
    return n.select("l_partkey", found["coverage"].alias("coverage"), found["expected_yield"].alias("expected"), evidence.sufficient(F.col("n1") % 3, F.col("n")).alias("enough"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    rows = p.select(F.lit("phenotype").alias("target_type"), F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("target_name"))
    return evidence.vocabulary(rows).select(F.lower("name").alias("name"), "count")


def hybrid_context(spark: SparkSession, sf: str) -> DataFrame:
    p, li = t.table(spark, sf, "part"), t.table(spark, sf, "lineitem")
    hits = p.select(F.col("p_partkey").alias("question_id"), F.lit(1).alias("rank"), F.col("p_brand").alias("source_name"), F.col("p_name").alias("text"))
    triples = li.filter("l_linenumber = 1").groupBy(F.col("l_partkey").alias("question_id")).agg(F.min("l_suppkey").alias("m")).select("question_id", F.lit(1).alias("rank"), F.lit("part").alias("source_name"), F.lit("has").alias("relation"), s("m").alias("target_name"))
    return vectors.context(hits, triples).select("question_id", "context", F.col("n").cast("long").alias("n"))


def answered(spark: SparkSession, sf: str) -> DataFrame:
    asked = t.table(spark, sf, "part").filter("p_partkey <= 40").select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("what of part "), s("p_partkey")).alias("question"))
    return pipelines.answer(asked, t.edges(spark, sf), depth=0).select("question_id", "answer")


def quality_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    metadata = spark.createDataFrame([], "source_id string, score double, study_type string")
    out = pipelines.quality_control(t.raw_triples(spark, sf), metadata, F.lit(t.AS_OF).cast("date"))
    return out["edges"].agg(F.coalesce(F.sum("n_members"), F.lit(0)).alias("n")).withColumn("part", F.lit("valid")).unionByName(out["rejects"].agg(F.count("*").alias("n")).withColumn("part", F.lit("rejected")))


QUERIES = {
    "q_scan_json_lines": json_lines, "q_scan_tolerant": tolerant, "q_scan_static_graph": static_scan, "q_scan_name_list": listed, "q_scan_annotation_edges": annotation_edges, "q_scan_annotation_ranges": annotation_ranges,
    "q_scan_rare_diseases": rare_diseases, "q_scan_questions": question_ids, "q_question_snippets": question_snippets, "q_scan_choices": choices, "q_scan_abstracts": abstracts, "q_scan_yaml": yaml_files, "q_scan_articles": articles,
    "q_scan_phenopackets": phenopackets, "q_scan_approvals": approvals, "q_write_quality": quality_written, "q_quality_report": quality_report, "q_edge_json": edge_json, "q_evidence_nodes": evidence_graph, "q_write_vectors": vectors_written,
    "q_manifest_pending": manifest, "q_consolidated": consolidated, "q_both_directions": both_ways, "q_disease_subgraph": subgraph, "q_cited_documents": cited, "q_keyword_triples": keyword_triples, "q_age_phrases": age_phrases,
    "q_json_repair": json_repair, "q_parsed_records": parsed_records, "q_normalise_entities": normalised_entities, "q_gold_by_name": gold_names, "q_match_concepts": concepts, "q_overlap_diseases": overlap, "q_disease_list": disease_list,
    "q_batch_summary": batches, "q_evidence_strategy": strategies, "q_vocabulary": vocabulary, "q_hybrid_context": hybrid_context, "q_answer": answered, "q_quality_pipeline": quality_pipeline,
}

_TERM = "list_extract([" + ", ".join(f"'{x}'" for x, _, _ in TERMS) + ", ''], l_quantity::INT % 6 + 1)"
_LOW = "list_extract([" + ", ".join(f"{a}::DOUBLE" for _, a, _ in TERMS) + "], l_quantity::INT % 6 + 1)"
_HIGH = "list_extract([" + ", ".join(f"{b}::DOUBLE" for _, _, b in TERMS) + "], l_quantity::INT % 6 + 1)"
_DISEASE = "CASE WHEN l_suppkey % 7 = 0 THEN 'ORPHA:' ELSE 'OMIM:' END || l_suppkey"
_HASHED = "translate(md5({}::VARCHAR), '0123456789', 'qrtvwxyzkh')"
_RAW = f"(SELECT l_partkey::VARCHAR AS s, {t.RELATION_SQL} AS r, l_suppkey::VARCHAR AS o, l_discount * 10 AS c, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity - 2 END AS a, l_quantity + 100 * l_tax - 3 AS b, l_partkey FROM lineitem)"
_REASON = "CASE WHEN length(s) < 2 OR length(o) < 2 THEN 'entity_too_short' WHEN c < 0.3 THEN 'low_confidence' WHEN a > b THEN 'temporal_age_inverted' WHEN (b IS NOT NULL AND a < 0) OR (a IS NOT NULL AND b > 120) THEN 'temporal_age_implausible' WHEN s = o THEN 'self_referencing' END"
ORACLE = {
    "q_scan_json_lines": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "q_scan_tolerant": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1",
    "q_scan_static_graph": f"""
WITH k AS (SELECT DISTINCT {t.RELATION_SQL} AS relation, l_partkey AS x, l_suppkey AS y FROM lineitem WHERE l_linenumber = 1), i AS (SELECT s_suppkey AS i FROM supplier WHERE s_suppkey % 2 = 0)
SELECT relation, count(*) AS n, count(DISTINCT y) AS n_nodes FROM k WHERE x IN (FROM i) OR y IN (FROM i) GROUP BY 1""",
    "q_scan_name_list": "SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer",
    "q_scan_annotation_edges": f"SELECT {_DISEASE} AS database_id, count(*) AS n, count(DISTINCT l_partkey) AS n_terms FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 2 AND l_suppkey % 7 <> 0 GROUP BY 1",
    "q_scan_annotation_ranges": f"""
SELECT {_DISEASE} AS database_id, 'HP:' || l_partkey AS hpo_id, min({_LOW}) AS min_age, max({_HIGH}) AS max_age, string_agg(DISTINCT {_TERM}, ',' ORDER BY {_TERM}) AS terms FROM lineitem WHERE l_quantity::INT % 6 < 5 GROUP BY ALL""",
    "q_scan_rare_diseases": "SELECT 'ORPHA:' || p_partkey AS gold_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 0.08::DOUBLE ELSE 15.0::DOUBLE END AS min_age, CASE WHEN p_size % 3 = 0 THEN 120.0::DOUBLE ELSE 1.0::DOUBLE END AS max_age FROM part WHERE p_size % 2 = 0 OR p_size % 3 = 0",
    "q_scan_questions": "SELECT l_orderkey::VARCHAR AS id, (count(DISTINCT l_linenumber) FILTER (l_linenumber <> 1))::INT AS n_with, CASE WHEN min(l_linenumber) = 1 THEN '1' ELSE '' END AS without FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_orderkey % 5 <> 0 GROUP BY 1, l_orderkey",
    "q_question_snippets": """
SELECT 'BIOASQ:' || l_orderkey || ':' || lpad((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::VARCHAR, 2, '0') AS chunk_id, 'bioasq_snippet' AS source_type
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linenumber <> 1 AND l_orderkey % 5 <> 0)""",
    "q_scan_choices": "SELECT p_name AS question, p_type AS second, p_brand AS answer FROM part",
    "q_scan_abstracts": "SELECT c_custkey::VARCHAR AS pmid, c_name AS question, c_mktsegment || chr(10) || 'end' AS context, CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS decision FROM customer",
    "q_scan_yaml": "SELECT 'MONDO:' || n_nationkey AS disease_id, n_name AS name, 'G1,' || r_name AS genes, n_nationkey % 2 = 0 AS rare FROM nation JOIN region ON n_regionkey = r_regionkey",
    "q_scan_articles": "SELECT o_orderkey::VARCHAR AS pmid, o_custkey::VARCHAR AS title, 'AIM: w' AS begins, strftime(date_trunc('month', o_orderdate::DATE), '%Y-%m-%d') AS published FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P'",
    "q_scan_phenopackets": """
WITH c AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT 'disease ' || p % 40 AS disease, 'sign ' || l_suppkey AS phenotype, count(DISTINCT l_orderkey) AS n_cases, min(l_quantity::INT)::DOUBLE AS onset_min, max(l_quantity::INT)::DOUBLE AS onset_max
FROM lineitem JOIN c USING (l_orderkey) WHERE l_returnflag <> 'R' GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2""",
    "q_scan_approvals": """
WITH n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT (o_orderkey % n + 1)::VARCHAR AS a, min(o_orderdate::DATE) AS d FROM orders, n WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT lower(p_brand) AS ingredient, arg_min(d, (s_suppkey % 4 <> 0, d, a))::VARCHAR AS approved, arg_min(a, (s_suppkey % 4 <> 0, d, a)) AS ApplNo
FROM part, n JOIN b ON a = (p_partkey % n + 1)::VARCHAR JOIN supplier ON s_suppkey::VARCHAR = a GROUP BY 1""",
    "q_write_quality": f"""
WITH v AS (SELECT *, {_REASON} AS z FROM {_RAW})
SELECT 'profile ' || l_partkey % 8 AS part, count(*) AS n FROM v WHERE z IS NULL GROUP BY 1 UNION ALL SELECT z, count(*) FROM v WHERE z IS NOT NULL GROUP BY 1 UNION ALL SELECT 'report', count(*) FROM v WHERE z IS NULL""",
    "q_quality_report": f"""
WITH v AS (SELECT r, count(*) AS n_input, count(*) FILTER ({_REASON} IS NULL) AS n_valid FROM {_RAW} GROUP BY 1)
SELECT r AS relation, n_input, n_valid, nullif(n_valid, 0) AS n_edges, CASE WHEN n_valid / n_input >= 0.9 THEN 'A' WHEN n_valid / n_input >= 0.7 THEN 'B' ELSE 'C' END AS valid_grade FROM v""",
    "q_edge_json": f"SELECT {t.ID_SQL} AS edge_id, {t.RELATION_SQL} AS relation, l_shipdate::DATE::VARCHAR AS discovered, l_orderkey::VARCHAR AS source, {t.ORD_SQL} AS ord FROM lineitem",
    "q_evidence_nodes": f"SELECT 'drug' AS type, count(*) AS n, count(DISTINCT l_partkey) AS n_ids FROM lineitem UNION ALL SELECT 'disease', count(*), count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'evidence', count(*), count(DISTINCT {t.ID_SQL}) FROM lineitem",
    "q_write_vectors": "SELECT 'textbook' AS source_type, count(*) AS count FROM documents WHERE text IS NOT NULL",
    "q_manifest_pending": "SELECT s_suppkey::VARCHAR AS disease_id FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey WHERE s_suppkey % 2 = 1 OR coalesce(n, 0) < 600",
    "q_consolidated": f"""
SELECT l_partkey || '|' || {t.RELATION_SQL} AS edge_id, arg_max({t.ORD_SQL}, (l_discount, -({t.ORD_SQL}))) AS ord, count(*) AS n_members, count(DISTINCT l_orderkey) AS n_sources, round(max(l_discount), 6) AS credibility FROM lineitem GROUP BY 1""",
    "q_both_directions": f"SELECT {t.ID_SQL} AS edge_id, 'in' AS direction FROM lineitem WHERE l_suppkey = 7 ORDER BY 1 LIMIT 10",
    "q_disease_subgraph": f"SELECT {t.RELATION_SQL} AS relation, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND (l_partkey = 7 OR l_suppkey = 7) GROUP BY 1",
    "q_cited_documents": "SELECT DISTINCT l_orderkey::VARCHAR AS document FROM lineitem WHERE l_returnflag = 'R'",
    "q_age_phrases": f"""
SELECT {t.ORD_SQL} AS ord, CASE l_linenumber WHEN 1 THEN round(l_quantity::INT / 12, 6) WHEN 2 THEN l_quantity::INT WHEN 3 THEN 30 END::DOUBLE AS low, CASE l_linenumber WHEN 1 THEN round(l_quantity::INT / 12, 6) WHEN 2 THEN 60 WHEN 3 THEN 40 END::DOUBLE AS high FROM lineitem""",
    "q_json_repair": "SELECT l_linenumber, sum(CASE l_linenumber WHEN 2 THEN 2 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END)::BIGINT AS n FROM lineitem GROUP BY 1",
    "q_parsed_records": f"SELECT {t.RELATION_SQL} AS relation, list_extract([0.9::DOUBLE, 0.7::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE], l_linenumber % 4 + 1) AS confidence, count(*) AS n, count(DISTINCT l_partkey) AS n_subjects FROM lineitem WHERE l_linenumber <> 2 GROUP BY ALL",
    "q_normalise_entities": """
SELECT CASE WHEN p_name < 'm' THEN 'dictionary' WHEN length(p_name) % 3 = 0 THEN 'embedding' WHEN length(p_name) % 3 = 1 AND length(p_name) % 2 = 0 THEN 'llm' WHEN part THEN 'dictionary_partial' ELSE 'unresolved' END AS method, count(*) AS n
FROM (SELECT p_name, EXISTS (FROM part q WHERE q.p_name < 'm' AND contains(lower(q.p_name), lower(p.p_name))) AS part FROM (SELECT DISTINCT p_name FROM part) p) GROUP BY 1""",
    "q_gold_by_name": f"""
WITH c AS (SELECT c_custkey AS k, 'client ' || {_HASHED.format("c_custkey")} AS name FROM customer)
SELECT CASE k % 3 WHEN 0 THEN name WHEN 1 THEN 'alias ' || k ELSE left(name, 20) || substr(name, 22) END AS name, name AS own_name FROM c""",
    "q_match_concepts": f"""
WITH x AS (SELECT s_suppkey AS k, {_HASHED.format("s_suppkey")} AS name FROM supplier)
SELECT upper(left(name, 1)) || substr(name, 2) AS mention, k::VARCHAR AS cui, 1.0::DOUBLE AS score, 'exact' AS method FROM x WHERE k % 3 = 0 UNION ALL SELECT name || 'zz', k::VARCHAR, round(64 / 66, 4)::DOUBLE, 'fuzzy' FROM x WHERE k % 3 = 1""",
    "q_overlap_diseases": """
WITH a AS (SELECT DISTINCT lower(p_name) AS n FROM part), b AS (SELECT DISTINCT lower('x ' || p_name) AS n FROM part WHERE p_size % 2 = 0)
SELECT a.n AS name, min(b.n) AS second, a.n AS third FROM a JOIN b ON contains(b.n, a.n) OR contains(a.n, b.n) GROUP BY a.n""",
    "q_disease_list": "SELECT c_custkey::VARCHAR AS disease_id, 'Syndrome ' || c_custkey AS disease_name FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 10 = 1",
    "q_batch_summary": """
SELECT count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS success, count(*) FILTER (l_returnflag = 'R') AS failed, round(avg((l_returnflag <> 'R' AND l_linestatus = 'O')::INT), 6) AS kg_hit_rate FROM lineitem""",
    "q_evidence_strategy": """
WITH n AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') % 3 AS k FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN n * 20 >= 500 AND k >= 2 THEN 'rich' WHEN n * 20 >= 50 OR k >= 1 THEN 'moderate' ELSE 'sparse' END AS coverage, CASE WHEN n * 20 >= 500 AND k >= 2 THEN 'high' WHEN n * 20 >= 50 OR k >= 1 THEN 'medium' ELSE 'low' END AS expected, k >= 1 OR n >= 10 AS enough FROM n""",
    "q_vocabulary": "SELECT lower(p_name) AS name, count(*) AS count FROM part GROUP BY 1",
    "q_hybrid_context": """
WITH m AS (SELECT l_partkey AS k, min(l_suppkey) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT p_partkey AS question_id, '[' || p_brand || '] ' || p_name || CASE WHEN m IS NULL THEN '' ELSE chr(10) || 'part has ' || m END AS context, CASE WHEN m IS NULL THEN 1 ELSE 2 END::BIGINT AS n FROM part LEFT JOIN m ON k = p_partkey""",
    "q_quality_pipeline": f"SELECT 'valid' AS part, count(*) FILTER ({_REASON} IS NULL) AS n FROM {_RAW} UNION ALL SELECT 'rejected', count(*) FILTER ({_REASON} IS NOT NULL) FROM {_RAW}",
}
