"""Queries of text and vector operators: names, similarity, chunks, nearest neighbours, metrics, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.functions import fuzzy, scores, text
from kairoscope.operators import chunks, consensus, evidence, matching, vectors
from kairoscope.queries import tables as t
from kairoscope.storage import fresh_path
from kairoscope.streaming import quality as streams


def names(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "part").select("p_name").distinct()


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct part names against each other: a bounded vocabulary."""
    n = names(spark, sf)
    return n.select(F.col("p_name").alias("a")).join(n.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    raw = F.concat(F.lit("  "), F.initcap("p_name"), F.when(F.col("p_size") % 4 == 0, " 0.45 mg/kg/d therapy").when(F.col("p_size") % 4 == 1, " (ABC) levels").when(F.col("p_size") % 4 == 2, "/second signaling pathway").otherwise(" per  day-based"))
    return p.select("p_partkey", text.entity_name(raw).alias("name"), text.audit_name(raw).alias("audit"), text.list_name(raw).alias("listed"), text.safe_id(raw, 20).alias("safe"))


def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    m = text.audit_match(text.audit_name(F.col("a")), text.audit_name(F.col("b")))
    return pairs(spark, sf).select("a", "b", m["matched"].alias("matched"), F.round(m["score"], 6).alias("score"))


def token_sort(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).withColumn("score", F.round(fuzzy.token_sort_ratio(F.col("a"), F.col("b")), 4))


def best_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    stock = names(spark, sf).select(F.col("p_name").alias("name"), F.xxhash64("p_name").alias("ord"))
    asked = names(spark, sf).select(F.concat(F.lit("x"), "p_name").alias("mention"))
    return matching.best_fuzzy(asked, stock, 75.0, 2)


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    n = t.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("count"), F.min("p_partkey").alias("ord"))
    a, b = n.select(F.col("name").alias("x"), F.col("ord").alias("a")), n.select(F.col("name").alias("y"), F.col("ord").alias("b"))
    alike = a.join(b, F.col("a") < F.col("b")).filter(fuzzy.alike(F.col("x"), F.col("y"), 70.0)).select("a", "b")
    return consensus.canonical_by_count(alike, n)


def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    p = names(spark, sf)
    return p.select("p_name", F.explode(F.array_distinct(text.ngrams(text.words(F.col("p_name"))))).alias("gram"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    b = t.table(spark, sf, "benchmark")
    return b.select("item_id", F.explode(F.array_distinct(text.mentions(F.col("text")))).alias("mention"))


def rouge(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    a, b = F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", F.round(scores.rouge2(a, b), 6).alias("rouge2"), F.round(scores.token_f1(a, F.concat_ws(" ", "p_name", "p_type")), 6).alias("token_f1"))


def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    said = F.when(F.col("l_returnflag") == "R", "yes").when(F.col("l_returnflag") == "A", "no").otherwise("maybe")
    gold = F.when(F.col("l_linestatus") == "O", "yes").when(F.col("l_quantity") > 25, "no").otherwise("maybe")
    return li.select(said.alias("s"), gold.alias("g")).agg(F.round(scores.macro_f1(F.col("s"), F.col("g")), 6).alias("macro_f1"))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return chunks.paragraphs(docs).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("chars"), F.max("start").cast("long").alias("last_start"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunks.paragraph_windows(docs, 3, 2).groupBy("source_name").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    return chunks.headed_sections(docs, r"^[A-Z]{2,}").select("chunk_id", "section_heading", F.length("text").alias("chars"), "char_start", "char_end")


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    return chunks.character_windows(docs).select("chunk_id", F.length("text").alias("chars"), "char_start", "char_end")


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "embeddings")
    return vectors.nearest(e, e, 3).select("query_id", "vec_id", F.round("score", 5).alias("score"))


def post_filtered(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "embeddings")
    kinds = e.select("vec_id", F.col("label").cast("string").alias("source_type"))
    return vectors.post_filtered(vectors.nearest(e, e, 9), kinds, "1", 3).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def mutual(spark: SparkSession, sf: str) -> DataFrame:
    e = t.table(spark, sf, "embeddings")
    return vectors.mutual_pairs(vectors.nearest(e, e, 5), least=0.2)


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text")
    found = vectors.encoded(chunks.paragraph_windows(docs, 1, 1))
    return found.select("chunk_id", F.size("embedding").alias("dims"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("size"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "pages")
    return p.select("page_id", F.length(text.strip_tags(F.col("html"))).alias("chars"), F.regexp_count("html", F.lit("<")).alias("tags"))


def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    return o.select("o_orderkey", text.padded_id(F.concat(F.lit("MONDO_"), F.col("o_orderkey").cast("string"))).alias("padded"), F.array_join(text.split_ids(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", F.col("o_custkey").cast("string"))), ",").alias("ids"))


def study_types(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(F.lit("Review"), F.when(F.col("l_returnflag") == "R", "Randomized Controlled Trial").otherwise("Journal Article"), F.when(F.col("l_linestatus") == "O", "Case Reports").otherwise("English Abstract"))
    return t.table(spark, sf, "lineitem").groupBy(evidence.study_type(kinds).alias("study_type")).agg(F.count("*").alias("n"))


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files: each user's event type once an hour, into a table."""
    out, state = fresh_path(spark, "unique"), fresh_path(spark, "state")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    events = streams.unique_events(source, "event_id", "ts")
    events.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "event_type")


QUERIES = {
    "q_text_normalise": normalised, "q_jaccard_audit": jaccard, "q_fuzzy_tokensort": token_sort, "q_fuzzy_best": best_fuzzy, "q_canonical_names": canonical, "q_ngrams": ngrams, "q_mentions": mentions, "q_rouge2": rouge, "q_macro_f1": macro_f1,
    "q_paragraphs": paragraphs, "q_paragraph_windows": windows, "q_heading_groups": sections, "q_character_windows": budgets, "q_vector_topk": nearest, "q_vector_filtered": post_filtered, "q_mutual_neighbours": mutual, "q_chunk_vectors": chunk_vectors,
    "q_strip_tags": pages, "q_identifiers": identifiers, "q_study_types": study_types, "q_stream_unique": stream,
}

NEAR_SQL = "SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s, c.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) DESC, c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id"
ORACLE = {
    "q_text_normalise": r"""
WITH p AS (SELECT p_partkey, '  ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || CASE p_size % 4 WHEN 0 THEN ' 0.45 mg/kg/d therapy' WHEN 1 THEN ' (ABC) levels' WHEN 2 THEN '/second signaling pathway' ELSE ' per  day-based' END AS x, p_size % 4 AS k, lower(p_name) AS n FROM part)
SELECT p_partkey, trim(regexp_replace(CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n || ' second signaling' ELSE n END, '\s+', ' ', 'g')) AS name,
       trim(regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS audit, trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS listed, substr(regexp_replace(x, '[^A-Za-z0-9_-]', '_', 'g'), 1, 20) AS safe FROM p""",
    "q_jaccard_audit": """
WITH n AS (SELECT DISTINCT p_name AS p FROM part), x AS (SELECT a.p AS a, b.p AS b, CASE WHEN length(a.p) <= length(b.p) THEN a.p ELSE b.p END AS s, CASE WHEN length(a.p) <= length(b.p) THEN b.p ELSE a.p END AS l,
  list_distinct(list_filter(string_split(a.p, ' '), lambda w: length(w) >= 3)) AS ta, list_distinct(list_filter(string_split(b.p, ' '), lambda w: length(w) >= 3)) AS tb FROM n a JOIN n b ON a.p < b.p),
y AS (SELECT *, CASE WHEN length(s) >= 4 AND contains(l, s) AND length(s) >= 0.4 * length(l) THEN 0.85::DOUBLE ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS v FROM x)
SELECT a, b, v >= 0.5 AS matched, round(v, 6) AS score FROM y""",
    "q_ngrams": r"""
WITH p AS (SELECT DISTINCT p_name, string_split(lower(p_name), ' ') AS w FROM part), g AS (SELECT p_name, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)
SELECT DISTINCT p_name, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g""",
    "q_rouge2": r"""
WITH p AS (SELECT p_partkey, list_transform([p_name || ' ' || p_brand || ' ' || p_type, p_name || ' ' || p_type || ' ' || p_brand, p_name || ' ' || p_type], lambda x: list_filter(string_split_regex(regexp_replace(lower(x), '[^a-z0-9_\s]', '', 'g'), '\s+'), lambda w: w <> '')) AS w FROM part),
b AS (SELECT p_partkey, w, list_transform([w[1], w[2]], lambda x: list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]))) AS g FROM p)
SELECT p_partkey, round(2.0::DOUBLE * len(list_intersect(g[1], g[2])) / (len(g[1]) + len(g[2])), 6) AS rouge2, round(2.0::DOUBLE * len(list_intersect(list_distinct(w[1]), list_distinct(w[3]))) / (len(list_distinct(w[1])) + len(list_distinct(w[3]))), 6) AS token_f1 FROM b""",
    "q_macro_f1": """
WITH e AS (SELECT CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'maybe' END AS s, CASE WHEN l_linestatus = 'O' THEN 'yes' WHEN l_quantity > 25 THEN 'no' ELSE 'maybe' END AS g FROM lineitem),
f AS (SELECT v, 2.0::DOUBLE * count(*) FILTER (s = v AND g = v) / (count(*) FILTER (s = v) + count(*) FILTER (g = v)) AS f FROM e, (SELECT unnest(['yes', 'no', 'maybe']) AS v) GROUP BY v)
SELECT round(avg(f), 6) AS macro_f1 FROM f""",
    "q_paragraphs": r"""
WITH d AS (SELECT doc_id::VARCHAR AS name, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) AS l FROM documents),
e AS (SELECT name, unnest(range(1, len(l) + 1)) AS i, l FROM d), f AS (SELECT name, i, rtrim(replace(l[i], chr(13), '')) AS x FROM e),
s AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum((trim(x) = '')::INT) OVER (PARTITION BY name ORDER BY i) AS g FROM f),
p AS (SELECT name, g, string_agg(x, ' ' ORDER BY i) AS p, min(start) AS start FROM s WHERE trim(x) <> '' GROUP BY ALL)
SELECT name, count(*) AS n, sum(length(p))::BIGINT AS chars, max(start)::BIGINT AS last_start FROM p GROUP BY 1""",
    "q_paragraph_windows": r"""
WITH d AS (SELECT doc_id::VARCHAR AS name, list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(replace(x, chr(13), ''))), lambda x: trim(x) <> '') AS l FROM documents),
w AS (SELECT name, unnest(range(0, len(l), 2)) AS s, l FROM d), x AS (SELECT name, trim(array_to_string(l[s + 1:s + 3], ' ')) AS t FROM w)
SELECT name AS source_name, count(*) AS n, sum(length(t))::BIGINT AS chars FROM x WHERE len(list_filter(string_split_regex(t, '\s+'), lambda v: v <> '')) >= 15 GROUP BY 1""",
    "q_vector_topk": f"SELECT query_id, vec_id, round(s, 5) AS score FROM ({NEAR_SQL}) WHERE rank <= 3",
    "q_vector_filtered": f"SELECT query_id, vec_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM ({NEAR_SQL}) WHERE rank <= 9 AND label = 1) WHERE r <= 3",
    "q_mutual_neighbours": f"WITH n AS (SELECT query_id AS a, vec_id AS b FROM ({NEAR_SQL}) WHERE rank <= 5 AND s >= 0.2) SELECT a, b FROM n WHERE a < b AND (b, a) IN (SELECT (a, b) FROM n)",
    "q_identifiers": "SELECT o_orderkey, 'MONDO:' || lpad(o_orderkey::VARCHAR, 7, '0') AS padded, o_custkey || ',' || o_orderstatus AS ids FROM orders",
    "q_study_types": "SELECT CASE WHEN l_returnflag = 'R' THEN 'RCT' WHEN l_linestatus = 'O' THEN 'case-report' ELSE 'review' END AS study_type, count(*) AS n FROM lineitem GROUP BY 1",
    "q_stream_unique": "SELECT event_id, user_id, event_type FROM events",
}
