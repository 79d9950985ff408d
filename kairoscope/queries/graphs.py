"""Queries of the graph operators: search, components, profiles, chains and link-prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.operators import components as cc
from kairoscope.operators import graph, matching
from kairoscope.queries import tables as t


def named(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_name"), t.edge_key().alias("edge_id"), t.ord_().alias("ord"))


def khop(spark: SparkSession, sf: str) -> DataFrame:
    e = named(spark, sf)
    seeds = e.agg(F.min("source_name").alias("entity"))
    return graph.reached(graph.links_of(e), seeds, 2).select("entity", F.col("hops").cast("long").alias("hops"))


def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    e = named(spark, sf)
    return graph.neighbourhood(e, e.agg(F.min("source_name").alias("entity")), 1).select("edge_id")


def components(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    return cc.components(o.select((F.col("o_orderkey") * 2).alias("a"), (F.col("o_custkey") * 2 + 1).alias("b"))).select("node", "root")


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return graph.profile(t.static_graph(spark, sf)).select("node_id", "n_edges", F.col("n_relations").cast("long").alias("n_relations"), F.element_at("neighbour_types", "drug").alias("drugs"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(t.static_graph(spark, sf)).select("node_id", "relation", F.array_join("names", ",").alias("names"))


def chains(spark: SparkSession, sf: str) -> DataFrame:
    e = t.edges(spark, sf).withColumn("source_type", F.when(F.col("relation") == "indication", "drug").otherwise("gene/protein"))
    return graph.chains(e).groupBy("disease").agg(F.count("*").alias("n"), F.max("year_gap").cast("long").alias("most"))


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.temporal_relations(t.edges(spark, sf)).groupBy("condition", "relation").agg(F.count("*").alias("n"))


def integer_ids(spark: SparkSession, sf: str) -> DataFrame:
    return graph.integer_ids(t.edges(spark, sf)).select("head", "relation", "tail", F.col("head_id").cast("long").alias("head_id"), F.col("tail_id").cast("long").alias("tail_id"), F.col("relation_id").cast("long").alias("relation_id"))


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("rank"))
    m = graph.link_metrics(li, "l_returnflag")
    return m.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("mrr", "hits_1", "hits_3", "hits_10")])


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(t.edges(spark, sf)).groupBy("entity").agg(F.count("*").alias("n"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return graph.by_source(t.edges(spark, sf)).groupBy("document").agg(F.count("*").alias("n"))


def patient(spark: SparkSession, sf: str) -> DataFrame:
    e = t.edges(spark, sf)
    return graph.patient_subgraph(e.filter("source_id = '7'").select(F.lower("source_name").alias("entity")).distinct(), e, 30.0).select("edge_id")


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    asked = li.select(F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("mention"), F.when(F.col("l_linenumber") % 2 == 0, "treatment").alias("mention_type")).distinct()
    return matching.resolved(asked, matching.names(t.static_graph(spark, sf))).groupBy("mention", "mention_type").agg(F.count("*").alias("n"))


def looked_up(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    stock = p.select(F.lower("p_name").alias("name_key"), F.lower("p_name").alias("node_id"), F.lit("drug").alias("node_type"), F.col("p_name").alias("node_name")).distinct()
    asked = p.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.substring("p_name", 2, 7)).otherwise(F.lit("zz")).alias("mention"), F.when(F.col("p_size") % 2 == 0, "drug").otherwise("disease").alias("mention_type"))
    return matching.cascade_lookup(asked, stock).select("mention", "mention_type", "node_id", "confidence", "method")


def contained(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    stock = p.select(F.lower("p_name").alias("name_key"), F.lower("p_name").alias("node_id"), F.lit("drug").alias("node_type"), F.col("p_name").alias("node_name")).distinct()
    asked = p.select(F.substring("p_name", 3, 4).alias("mention"))
    return matching.containing(asked, stock, 5).select("mention", "name_key", F.col("rank").cast("long").alias("rank"))


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    e = t.edges(spark, sf)
    questions = spark.createDataFrame([(1, "part 13"), (2, "is part 15 worth it"), (3, "zzzz")], "question_id int, question string")
    return graph.retrieve(questions, e, most=5).select("question_id", "edge_id", "rank", "insufficient_evidence")


QUERIES = {
    "q_khop": khop, "q_neighbourhood": neighbourhood, "q_components": components, "q_profile_kg": profile, "q_neighbours": neighbours, "q_multi_hop": chains, "q_temporal_relations": relations, "q_integer_ids": integer_ids,
    "q_link_metrics": ranks, "q_adjacency": adjacency, "q_document_index": documents, "q_patient_subgraph": patient, "q_resolve_name": resolved, "q_dictionary_lookup": looked_up, "q_substring_resolve": contained, "q_retrieve": retrieved,
}

NAMED_SQL = f"SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, {t.ID_SQL} AS edge_id FROM lineitem"
LINKS_SQL = f"SELECT a, b FROM ({NAMED_SQL}) UNION SELECT b, a FROM ({NAMED_SQL})"
KG_SQL = f"SELECT {t.RELATION_SQL} AS r, l_partkey::VARCHAR AS x, l_suppkey::VARCHAR AS y FROM lineitem WHERE l_linenumber = 1"
ORACLE = {
    "q_khop": f"""
WITH RECURSIVE l AS ({LINKS_SQL}), w AS (SELECT min(a) AS entity, 0 AS hops FROM ({NAMED_SQL}) UNION SELECT l.b, hops + 1 FROM w JOIN l ON l.a = w.entity WHERE hops < 2)
SELECT entity, min(hops)::BIGINT AS hops FROM w GROUP BY 1""",
    "q_neighbourhood": f"""
WITH RECURSIVE l AS ({LINKS_SQL}), w AS (SELECT min(a) AS entity, 0 AS hops FROM ({NAMED_SQL}) UNION SELECT l.b, hops + 1 FROM w JOIN l ON l.a = w.entity WHERE hops < 1)
SELECT DISTINCT edge_id FROM ({NAMED_SQL}) WHERE a IN (SELECT entity FROM w) OR b IN (SELECT entity FROM w)""",
    "q_components": """
WITH e AS (SELECT o_orderkey * 2 AS a, o_custkey * 2 + 1 AS b FROM orders), r AS (SELECT b, least(b, min(a)) AS root FROM e GROUP BY b)
SELECT node, min(root) AS root FROM (SELECT a AS node, root FROM e JOIN r USING (b) UNION ALL SELECT b, root FROM r) GROUP BY 1 HAVING min(root) <> node""",
    "q_profile_kg": f"SELECT y AS node_id, count(*) AS n_edges, count(DISTINCT r) AS n_relations, count(*) AS drugs FROM ({KG_SQL}) GROUP BY 1",
    "q_neighbours": f"""
SELECT node_id, relation, string_agg(DISTINCT n, ',' ORDER BY n) AS names FROM (SELECT x AS node_id, r AS relation, y AS n FROM ({KG_SQL}) UNION ALL SELECT y, r, x FROM ({KG_SQL})) GROUP BY ALL""",
    "q_multi_hop": f"""
WITH e AS (SELECT 'supplier ' || l_suppkey AS disease, year(l_shipdate) AS y, l_returnflag AS f FROM lineitem)
SELECT g.disease, count(*) AS n, max(d.y - g.y) AS most FROM e g JOIN e d USING (disease) WHERE g.f <> 'R' AND d.f = 'R' AND d.y > g.y GROUP BY 1""",
    "q_temporal_relations": f"""
WITH e AS (SELECT 'part ' || l_partkey AS h, 'supplier ' || l_suppkey AS o, {t.RELATION_SQL} AS r, (l_quantity + (l_quantity + 100 * l_tax)) / 2 AS m, year(l_shipdate) AS y FROM lineitem),
b AS (SELECT *, CASE WHEN m < 0.1 THEN 'neonatal' WHEN m < 2 THEN 'infantile' WHEN m < 12 THEN 'childhood' WHEN m < 18 THEN 'juvenile' WHEN m < 40 THEN 'adult' WHEN m < 65 THEN 'middle_age' ELSE 'late_onset' END AS s,
  CASE WHEN y >= 2020 THEN 'recent' WHEN y >= 2010 THEN 'modern' WHEN y >= 2000 THEN 'older' ELSE 'historical' END AS v FROM e),
c AS (SELECT DISTINCT 'static' AS condition, h, r AS relation, o FROM b UNION SELECT DISTINCT 'stage', h, r || '__' || s, o FROM b UNION SELECT DISTINCT 'stage_year', h, r || '__' || s || '__' || v, o FROM b)
SELECT condition, relation, count(*) AS n FROM c GROUP BY ALL""",
    "q_integer_ids": f"""
WITH d AS (SELECT DISTINCT 'part ' || l_partkey AS head, {t.RELATION_SQL} AS relation, 'supplier ' || l_suppkey AS tail FROM lineitem),
e AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT head AS name FROM d UNION SELECT tail FROM d)), r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS relation_id FROM (SELECT DISTINCT relation FROM d))
SELECT head, relation, tail, h.id AS head_id, o.id AS tail_id, relation_id FROM d JOIN e h ON h.name = head JOIN e o ON o.name = tail JOIN r USING (relation)""",
    "q_link_metrics": "SELECT l_returnflag, round(avg(1 / l_quantity), 6) AS mrr, round(avg((l_quantity <= 1)::INT), 6) AS hits_1, round(avg((l_quantity <= 3)::INT), 6) AS hits_3, round(avg((l_quantity <= 10)::INT), 6) AS hits_10 FROM lineitem GROUP BY 1",
    "q_adjacency": "SELECT entity, count(*) AS n FROM (SELECT 'part ' || l_partkey AS entity FROM lineitem UNION ALL SELECT 'supplier ' || l_suppkey FROM lineitem) GROUP BY 1",
    "q_document_index": "SELECT l_orderkey::VARCHAR AS document, count(*) AS n FROM lineitem GROUP BY 1",
    "q_patient_subgraph": f"""
SELECT DISTINCT {t.ID_SQL} AS edge_id FROM lineitem
WHERE (l_partkey = 7 OR l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 7)) AND 30 BETWEEN l_quantity AND l_quantity + 100 * l_tax""",
    "q_resolve_name": f"""
WITH n AS (SELECT DISTINCT x AS name, 'drug' AS kind FROM ({KG_SQL}) UNION SELECT DISTINCT y, 'disease' FROM ({KG_SQL})), q AS (SELECT DISTINCT l_suppkey::VARCHAR AS m, CASE WHEN l_linenumber % 2 = 0 THEN 'treatment' END AS k FROM lineitem)
SELECT ' ' || m AS mention, k AS mention_type, count(*) AS n FROM q JOIN n ON n.name = m AND (k IS NULL OR kind = 'drug') GROUP BY ALL""",
    "q_dictionary_lookup": """
WITH s AS (SELECT DISTINCT lower(p_name) AS n FROM part),
q AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 2, 7) ELSE 'zz' END AS mention, CASE WHEN p_size % 2 = 0 THEN 'drug' ELSE 'disease' END AS mention_type FROM part),
m AS (SELECT *, trim(lower(mention)) AS k FROM q), x AS (SELECT *, (SELECT n FROM s WHERE n = k) AS exact, CASE WHEN length(k) >= 5 THEN (SELECT min(n) FROM s WHERE contains(n, k)) END AS part FROM m)
SELECT mention, mention_type, coalesce(exact, part) AS node_id, CASE WHEN exact IS NOT NULL AND mention_type = 'drug' THEN 1.0::DOUBLE WHEN exact IS NOT NULL THEN 0.95::DOUBLE WHEN part IS NOT NULL THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
       CASE WHEN exact IS NOT NULL THEN 'dictionary' WHEN part IS NOT NULL THEN 'dictionary_partial' ELSE 'unresolved' END AS method FROM x""",
    "q_substring_resolve": """
WITH s AS (SELECT DISTINCT lower(p_name) AS n FROM part), q AS (SELECT DISTINCT substr(p_name, 3, 4) AS mention FROM part), h AS (SELECT mention, n, row_number() OVER (PARTITION BY trim(lower(mention)) ORDER BY n) AS rank FROM q JOIN s ON contains(n, trim(lower(mention))) OR contains(trim(lower(mention)), n))
SELECT mention, n AS name_key, rank FROM h WHERE rank <= 5""",
}
