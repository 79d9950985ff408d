"""Evidence collections: classification, filters, document selection and ranking, profiles and pending work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import scores, text
from kairoscope.operators.ranks import numbered

# Publication types in order of priority, those that are left out, and the fewest words of an abstract.
STUDY_OF_TYPE = (
    ("meta-analysis", "meta-analysis"), ("randomized controlled trial", "RCT"), ("practice guideline", "guideline"), ("guideline", "guideline"),
    ("systematic review", "meta-analysis"), ("clinical trial", "cohort"), ("case reports", "case-report"), ("review", "review"),
)
EXCLUDED_TYPES = ("editorial", "letter", "comment", "erratum", "retraction of publication", "retracted publication", "news", "published erratum", "biography")
LEAST_WORDS = 100


def study_type(publication_types: Column) -> Column:
    low = F.transform(publication_types, lambda t: F.lower(t))
    return F.coalesce(*[F.when(F.array_contains(low, t), s) for t, s in STUDY_OF_TYPE], F.lit("other"))


def usable(abstract: Column, publication_types: Column) -> Column:
    low = F.transform(publication_types, lambda t: F.lower(t))
    enough = F.size(F.filter(F.split(F.coalesce(abstract, F.lit("")), r"\s+"), lambda w: w != "")) >= LEAST_WORDS
    return enough & ~F.coalesce(F.arrays_overlap(low, F.array(*map(F.lit, EXCLUDED_TYPES))), F.lit(False))


def harvested(hits: DataFrame, articles: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Tier-2 documents of a profile's queries: an article counts for the first query (query_no) that finds it, with its credibility."""
    first = hits.groupBy("disease_id", "pmid").agg(F.min("query_no").alias("query_no"))
    study = study_type(F.col("pub_types"))
    score = scores.credibility(study, F.lit(0.0), F.col("journal"), as_of=as_of)
    return first.join(articles, "pmid").select("disease_id", "query_no", F.concat(F.lit("PMID:"), "pmid").alias("source_id"), F.lit("pubmed_abstract").alias("source_type"), F.lit(2).alias("tier"), "title", F.col("abstract").alias("text"), "publication_date", "journal", score.alias("credibility_score"), study.alias("study_type"))


def with_full_text(docs: DataFrame, full: DataFrame, most: int = 50) -> DataFrame:
    """Documents and full-text copies of the best `most` that have one among the best 2 * most; copies score a tenth more."""
    rank = F.row_number().over(Window.partitionBy("disease_id").orderBy(F.desc("credibility_score"), "source_id"))
    near = docs.withColumn("rank", rank).filter(F.col("rank") <= 2 * most).join(full.select("source_id", "pmcid", "focus_text"), "source_id")
    kept = near.withColumn("n", F.row_number().over(Window.partitionBy("disease_id").orderBy("rank"))).filter((F.col("n") <= most) & (F.coalesce("focus_text", F.lit("")) != ""))
    changed = {"source_id": F.concat_ws("|", "source_id", "pmcid"), "source_type": F.lit("pmc_fulltext"), "text": F.col("focus_text"), "credibility_score": F.col("credibility_score") * 1.1}
    return docs.unionByName(kept.withColumns(changed).select(*docs.columns))


def selected(docs: DataFrame, rich: int = 200, moderate: int = 150) -> DataFrame:
    """Each disease's documents up to its cap (by coverage: rich, moderate, sparse without one), tier 1 first, then credibility."""
    rank = F.row_number().over(Window.partitionBy("disease_id").orderBy("tier", F.desc("credibility_score"), "source_id"))
    cap = F.when(F.col("coverage") == "rich", rich).when(F.col("coverage") == "moderate", moderate)
    return docs.withColumn("rank", rank).filter(cap.isNull() | (F.col("rank") <= cap))


def collection(docs: DataFrame) -> DataFrame:
    """disease_id -> documents of each tier and the coverage that follows."""
    n = docs.groupBy("disease_id").agg(F.count_if(F.col("tier") == 1).alias("n_tier1"), F.count_if(F.col("tier") == 2).alias("n_tier2"))
    flag = F.when((F.col("n_tier1") >= 2) & (F.col("n_tier2") >= 200), "rich").when((F.col("n_tier1") >= 1) | (F.col("n_tier2") >= 50), "moderate").otherwise("sparse")
    return n.withColumn("coverage", flag)


def strategy(n_articles: Column, n_tier1: Column) -> Column:
    """struct(coverage, expected_yield) by articles (500, 50) and tier-1 sources (two, one)."""
    rich, some = (n_articles >= 500) & (n_tier1 >= 2), (n_articles >= 50) | (n_tier1 >= 1)
    return F.struct(F.when(rich, "rich").when(some, "moderate").otherwise("sparse").alias("coverage"), F.when(rich, "high").when(some, "medium").otherwise("low").alias("expected_yield"))


def sufficient(n_tier1: Column, n_articles: Column) -> Column:
    return (n_tier1 >= 1) | (n_articles >= 10)


# What a disease's literature is searched for.
TOPICS = ("(treatment OR therapy OR management)", "(pathogenesis OR mechanism OR genetics)", "(diagnosis OR biomarker OR prognosis)", "(natural history OR progression OR outcome)")


def queries_for(name: Column, differentials: Column) -> Column:
    """Search queries for a disease, and for telling it from its first three differential diagnoses."""
    quoted = F.concat(F.lit('"'), name, F.lit('" AND '))
    own = F.array(*[F.concat(quoted, F.lit(t)) for t in TOPICS])
    return F.concat(own, F.transform(F.slice(F.coalesce(differentials, F.array().cast("array<string>")), 1, 3), lambda d: F.concat(quoted, F.lit('"'), d, F.lit('" AND (differential OR distinguish)'))))


def gold_documents(snippets: DataFrame) -> DataFrame:
    """One document for each (question_id, pmid) of its snippets (pos, section, text): a section's header where it first comes."""
    by = Window.partitionBy("question_id", "pmid", "section").orderBy("pos")
    headed = snippets.withColumn("part", F.when((F.row_number().over(by) == 1) & text.present(F.col("section")), F.concat(F.lit("## "), "section", F.lit("\n"), "text")).otherwise(F.col("text")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return headed.groupBy("question_id", "pmid").agg(F.array_join(parts, "\n\n").alias("text"), F.count("*").alias("n_snippets")).withColumn("source_id", F.concat(F.lit("PMID:"), "pmid"))


def tier1_triples(profiles: DataFrame) -> DataFrame:
    """Triples of full confidence from a profile's genes, phenotypes and treatments."""
    parts = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(t).alias("object_type"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("objects")) for c, r, t in (("genes", "disease_protein", "gene/protein"), ("phenotypes", "disease_phenotype_positive", "phenotype"), ("treatments", "indication", "drug"))])
    return profiles.select("disease_id", F.col("disease_name").alias("subject"), F.explode(parts).alias("p")).select("disease_id", "subject", "p.relation", "p.object_type", F.explode("p.objects").alias("object"), F.lit(1.0).alias("confidence"))


def differentials(kg: DataFrame, profiles: DataFrame, most: int = 10) -> DataFrame:
    """Up to `most` neighbouring diseases of a profile's node, found by its name or its id."""
    side = lambda a, b: kg.filter((F.col("relation") == "disease_disease")).select(F.col(f"{a}_id").alias("node_id"), F.lower(f"{a}_name").alias("name"), F.col(f"{b}_name").alias("neighbour"))
    both = side("x", "y").unionByName(side("y", "x"))
    hits = profiles.join(both.drop("node_id"), F.lower("disease_name") == F.col("name")).select("disease_id", "neighbour").union(profiles.join(both.drop("name"), F.col("disease_id") == F.col("node_id")).select("disease_id", "neighbour")).distinct()
    rank = F.row_number().over(Window.partitionBy("disease_id").orderBy("neighbour"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= most)


def pending(wanted: DataFrame, done: DataFrame, key: str = "disease_id", least: int = 11) -> DataFrame:
    """What is still to do: keys without a validated table and a consensus of `least` rows; done is (key, validated, n_consensus)."""
    return wanted.join(done.filter((F.col("validated")) & (F.col("n_consensus") >= least)).select(key), key, "left_anti")


def disease_list(rows: DataFrame, listed: DataFrame, found: DataFrame) -> DataFrame:
    """Rows whose profile is on a list of names: equal in normalised form, or found as the most similar."""
    names = listed.select(text.list_name(F.col("name")).alias("k"))
    exact = rows.withColumn("k", text.list_name(F.col("disease_name"))).join(names, "k", "left_semi").drop("k")
    return exact.unionByName(rows.join(found.select(F.col("name").alias("disease_name")), "disease_name", "left_semi")).dropDuplicates(["disease_id"])


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by provider; prices is (provider, input_price, output_price) for a thousand tokens."""
    return calls.join(prices, "provider").groupBy("provider").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") / 1000 * F.col("input_price") + F.col("output_tokens") / 1000 * F.col("output_price")).alias("cost"))


def rate_limited(calls: DataFrame, most: int = 500, seconds: int = 3600, *, by: str = "user_id", at: str = "ts") -> DataFrame:
    """Calls with how many the caller made in the window up to each, and whether that is too many."""
    w = Window.partitionBy(by).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > most)


def preferred(paths: DataFrame) -> DataFrame:
    """One file for each folder of paths (path): the compressed one where both are there."""
    plain = F.regexp_replace("path", r"\.gz$", "")
    return paths.groupBy(plain.alias("name")).agg(F.max("path").alias("path"))


def vocabulary(edges: DataFrame) -> DataFrame:
    """name, count, ord: phenotypes by folded spelling, each under its most frequent surface form, most frequent first."""
    raw = edges.filter("target_type = 'phenotype'").select(F.trim("target_name").alias("surface")).filter("surface <> ''").groupBy("surface").count()
    keyed = raw.withColumn("key", text.folded(F.col("surface"))).filter("key <> ''")
    best = keyed.groupBy("key").agg(F.max(F.struct("count", "surface")).alias("x"), F.sum("count").alias("count"))
    return numbered(best.select(F.col("x.surface").alias("name"), "count"), "ord", F.desc("count"), F.col("name"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row over batch results (result, error, kg_coverage): how many, succeeded, failed, and the share that the graph covers."""
    ok = F.col("error").isNull()
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg((ok & F.col("kg_coverage")).cast("double")), F.lit(0.0)).alias("kg_hit_rate"))
