"""Queries of the edge operators: validation, projection, consensus, merging, reasoning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairoscope.functions import scores
from kairoscope.operators import audit, consensus, evidence, gold, matching, quality, temporal
from kairoscope.queries import tables as t
from kairoscope.sources import sinks

RAW_SQL = f"""
SELECT l_partkey::VARCHAR AS s, {t.RELATION_SQL} AS r, l_suppkey::VARCHAR AS o, l_discount * 10 AS c, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity - 2 END AS a,
       l_quantity + 100 * l_tax - 3 AS b, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem"""
REASON_SQL = "CASE WHEN length(s) < 2 OR length(o) < 2 THEN 'entity_too_short' WHEN c < 0.3 THEN 'low_confidence' WHEN a > b THEN 'temporal_age_inverted' WHEN (b IS NOT NULL AND a < 0) OR (a IS NOT NULL AND b > 120) THEN 'temporal_age_implausible' WHEN s = o THEN 'self_referencing' END"
EDGE_SQL = f"""
SELECT {t.ID_SQL} AS edge_id, l_partkey, l_suppkey, {t.RELATION_SQL} AS relation, l_shipdate::DATE AS d, l_discount, l_tax, l_quantity, l_linestatus, l_returnflag,
       l_orderkey, l_linenumber, {t.ORD_SQL} AS ord FROM lineitem"""


def validate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.validated(t.raw_triples(spark, sf)).groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def project(spark: SparkSession, sf: str) -> DataFrame:
    valid = quality.validated(t.raw_triples(spark, sf)).filter("reject_reason IS NULL").withColumns({"score": F.lit(None).cast("double"), "study_type": F.lit(None).cast("string")})
    return quality.to_edges(valid).select("edge_id", "source_type", "relation", "target_type", F.col("temporal.discovery_date").cast("string").alias("discovery_date"), F.col("temporal.onset_age_min").alias("onset_age_min"), F.col("evidence.credibility_score").alias("credibility"), "ord")


def summary(spark: SparkSession, sf: str) -> DataFrame:
    e = t.edges(spark, sf)
    score = scores.rerank(F.col("evidence.credibility_score"), F.col("evidence.consensus_confidence"), F.col("quality_grade"))
    rank = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("score"), "edge_id"))
    best = e.select("relation", "edge_id", F.round(score, 6).alias("score")).withColumn("rank", rank).filter("rank <= 5").groupBy("relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "edge_id"))), lambda x: x["edge_id"]), ",").alias("best"))
    stats = quality.coverage(e, "relation").select("relation", "total", F.round("coverage", 6).alias("coverage"), F.round("progression_stage", 6).alias("staged"))
    return stats.join(e.groupBy("relation").agg(F.round(F.avg("evidence.credibility_score"), 6).alias("credibility")), "relation").join(best, "relation")


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage(t.edges(spark, sf), "source_type", "relation").select("relation", "total", *[F.round(c, 6).alias(c) for c in ("coverage", "discovery_date", "onset_age", "progression_stage", "duration", "validity_end")])


def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.conflicts(t.edges(spark, sf)).select("source", "target", "type", F.array_join("relations", ",").alias("relations"))


def consistency(spark: SparkSession, sf: str) -> DataFrame:
    shifted = t.edges(spark, sf).withColumn("temporal", F.col("temporal").withField("onset_age_max", F.col("temporal.onset_age_max") * 3 - 20).withField("validity_start", F.col("temporal.discovery_date")).withField("validity_end", F.date_add(F.col("temporal.discovery_date"), F.lit(3) - F.col("temporal.onset_age_min").cast("int"))))
    return quality.consistency_issues(shifted, F.lit(t.AS_OF).cast("date")).groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


def repair(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array(*map(F.lit, ("disease", "phenotype", "drug", "gene/protein", "biological_process")))
    relations = F.array(*map(F.lit, ("disease_phenotype_positive", "disease_disease", "indication", "disease_protein")))
    li = t.table(spark, sf, "lineitem")
    e = li.select(F.element_at(types, (F.col("l_partkey") % 5 + 1).cast("int")).alias("source_type"), F.element_at(types, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("target_type"), F.element_at(relations, (F.col("l_orderkey") % 4 + 1).cast("int")).alias("relation"))
    return quality.repaired(e).groupBy("source_type", "relation", "target_type", "action").agg(F.count("*").alias("n"))


def wordings(base: Column, way: Column) -> Column:
    """One name in four wordings: as it is, in capitals, with its words the other way round, with its last letter typed twice."""
    return F.element_at(F.array(base, F.upper(base), F.array_join(F.reverse(F.split(base, " ")), " "), F.concat(base, F.right(base, F.lit(1)))), (way % 4 + 1).cast("int"))


def hashed_name(key: Column) -> Column:
    """A name that is unlike any other: letters of a hash, cut into words."""
    return F.regexp_replace(F.translate(F.md5(key), "0123456789", "qrtvwxyzkh"), "(.{8})", "$1 ").substr(1, 35)


def worded(rows: DataFrame, part: Column, way: Column) -> DataFrame:
    """Rows with s and o: of each part and base (even and odd orders) one name for each end, in several wordings."""
    part = part.cast("string")
    base = F.concat(part, F.lit("-"), (F.col("l_orderkey") % 2).cast("string"))
    return rows.withColumns({"s": wordings(hashed_name(base), way), "o": wordings(hashed_name(F.concat(F.lit("o"), part)), way + 1)})


def fuzzy_consensus(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").repartition("l_partkey")  # dealt out before rows grow names
    li = worded(li, F.col("l_partkey"), F.col("l_linenumber"))
    triples = li.select(F.col("s").alias("subject"), t.relation(F.col("l_returnflag")).alias("relation"), F.col("o").alias("object"), F.col("l_suppkey").cast("string").alias("extraction_model"), F.col("l_discount").alias("confidence"), F.col("l_partkey").alias("source_id"), t.ord_().alias("ord"), t.place().alias("place"))
    return consensus.consensus(triples, "source_id", first="place").select("source_id", "relation", "ord", "n_models", F.round("confidence", 6).alias("confidence"))


def merge(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("evidence")
    li = t.table(spark, sf, "lineitem").repartition(F.col("l_partkey").cast("string"))  # dealt out before rows grow names
    edges = t.as_edges(worded(li, F.col("l_partkey"), F.col("l_linenumber")), t.ord_, "s", "o", t.place().alias("place"))
    edges = edges.select("disease_profile_id", "relation", "ord", "place", "evidence", F.col("s").alias("source_name"), F.col("o").alias("target_name"))
    out = consensus.merge_sources(edges, "disease_profile_id", first="place")
    return out.select("disease_profile_id", "relation", "ord", "n_members", F.size(e["source_ids"]).cast("long").alias("n_sources"), F.array_join(e["extraction_models"], ",").alias("models"), F.round(e["credibility_score"], 6).alias("credibility"), F.round(e["consensus_confidence"], 6).alias("consensus"))


def confirm(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").filter("l_linenumber > 1")
    triples = li.select(F.col("l_partkey").cast("string").alias("subject"), t.relation(F.col("l_returnflag")).alias("relation"), F.col("l_suppkey").cast("string").alias("object"), t.ord_().alias("ord"))
    return matching.confirmed(triples, t.static_graph(spark, sf)).select("ord", "match_type", "reversed")


def supersession(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.contradictions(t.edges(spark, sf, t.place)).select("old_edge_id", "new_edge_id", "reason", F.col("old_discovery_date").cast("string").alias("old_date"), F.col("new_discovery_date").cast("string").alias("new_date"))


def reasoned(spark: SparkSession, sf: str) -> DataFrame:
    done, _, _ = temporal.reason(t.edges(spark, sf, t.place), F.lit(t.AS_OF).cast("date"))
    return done.filter("temporal.superseded_by IS NOT NULL").select("edge_id", F.col("temporal.superseded_by").alias("superseded_by"), F.col("temporal.validity_start").cast("string").alias("starts"), F.col("temporal.validity_end").cast("string").alias("ends"))


def treatments(spark: SparkSession, sf: str) -> DataFrame:
    e = t.edges(spark, sf).filter("relation = 'indication'")
    said = F.when(F.col("ord") % 50 == 1, F.concat(F.lit("now preferred over "), F.lower("source_name"), F.lit(" and part 1")))
    return temporal.updated_treatments(e.withColumn("evidence", F.col("evidence").withField("evidence_text", said))).select("old_edge_id", "new_edge_id", "reason")


def chronology(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.chronology(t.edges(spark, sf), "source_id", "relation").select("source_id", "relation", "n", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    score = scores.rerank(F.col("evidence.credibility_score"), F.col("evidence.consensus_confidence"), F.col("quality_grade"))
    e = t.edges(spark, sf).select("source_id", "edge_id", F.round(score, 6).alias("score"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "edge_id"))).filter("rank <= 3")


def credibility(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    study = F.element_at(F.array(*map(F.lit, ("meta-analysis", "RCT", "cohort", "review", "unheard of"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    s = scores.credibility(study, F.lit(0.5), F.lit("Journal of neurology"), (F.col("o_totalprice") / 1000).cast("int"), F.col("o_orderdate").cast("date"), F.col("o_orderstatus") == "P", as_of=F.lit("2000-01-01").cast("date"))
    return o.select("o_orderkey", F.floor(s * 100 + 0.003).alias("score"))  # whole hundredths: the last place depends on how a library rounds ties


def with_evidence(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("PMID:"), F.col("o_orderkey").cast("string")).alias("source_id"), (F.col("o_totalprice") / 1e6).alias("credibility_score"), F.col("o_orderpriority").alias("study_type"), F.col("o_custkey").alias("ord"))
    raw = t.raw_triples(spark, sf).select("ord", F.when(F.col("ord") % 2 == 0, F.concat("source_id", F.lit("|PMC1"))).otherwise(F.col("source_id")).alias("source_id"))
    return quality.with_evidence(raw, quality.evidence_scores(docs)).select("ord", F.round("score", 6).alias("score"), "study_type")


def tie_breaks(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("extraction_model"))
    return consensus.third_model_needed(li, "A", "R")


def votes(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("verdict"))
    return consensus.majority(li, "l_orderkey")


def audited(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    s = lambda c: F.col(c).cast("string")
    static = li.filter("l_linenumber = 1").select(s("l_orderkey").alias("edge_no"), s("l_partkey").alias("disease_id"), t.relation(F.col("l_returnflag")).alias("relation"), F.concat(F.lit("part"), s("l_partkey")).alias("x_name"), F.concat(F.lit("supplier"), s("l_suppkey")).alias("y_name"))
    own = li.filter("l_linenumber > 1").select(t.ord_().alias("ord"), s("l_partkey").alias("disease_id"), F.concat(F.lit("supplier"), s("l_suppkey")).alias("subject"), F.when(F.col("l_returnflag") == "R", "treats").otherwise(t.relation(F.col("l_returnflag"))).alias("relation"), F.concat(F.lit("part"), s("l_partkey")).alias("object"), F.lpad(F.concat(s("l_orderkey"), F.lit("000")), 8, "1").alias("source_id"), F.col("l_discount").alias("confidence"))
    exact = audit.verdicts(static, own)
    return audit.summary(exact, "relation").select("relation", "total", "confirmed", "contradicted", "unassessed", "stale_5", "stale_10")


def rows_for_static(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.static_rows(t.edges(spark, sf)).select("relation", "x_id", "y_id", "source_ids", "duration", "progression_stage")


def property_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, links = sinks.property_graph(t.edges(spark, sf))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(links.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


def first_listed(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "customer")
    listed = c.groupBy(F.col("c_nationkey").alias("disease_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey"))), lambda x: x["c_custkey"]).alias("ids"))
    known = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("gold_id")).agg(F.count("*").alias("n_orders")).filter("n_orders >= 15")
    nations = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("disease_id"), "n_name")
    return matching.first_listed(nations, listed, known).select("disease_id", "n_name", "gold_id", "n_orders")


def first_hits(spark: SparkSession, sf: str) -> DataFrame:
    m = t.matched(spark, sf)
    own = m.select("disease_id", "ord", F.col("onset_min").alias("low"), F.col("onset_max").alias("high"))
    ref = t.table(spark, sf, "lineitem").filter("l_linenumber = 2").select(F.col("l_partkey").alias("disease_id"), t.ord_().alias("ord"), F.col("l_quantity").alias("ref_min"), (F.col("l_quantity") + 2).alias("ref_max"))
    return gold.first_hit(own, ref, "disease_id").groupBy("verdict").agg(F.count("*").alias("n"))


def limited(spark: SparkSession, sf: str) -> DataFrame:
    events = t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return evidence.rate_limited(events, most=2).select("event_id", "in_window", "limited")


def selected_documents(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("disease_id"), (F.substring("o_orderpriority", 1, 1).cast("int") % 2 + 1).alias("tier"), F.col("o_totalprice").alias("credibility_score"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("source_id"), F.when(F.col("o_custkey") % 3 == 0, "rich").when(F.col("o_custkey") % 3 == 1, "moderate").otherwise("sparse").alias("coverage"))
    return evidence.selected(o, rich=8, moderate=5).select("disease_id", "source_id", "rank")


QUERIES = {
    "q_flagship": summary, "q_validate_edges": validate, "q_project_edges": project, "q_temporal_coverage": coverage, "q_conflicts": conflicts, "q_consistency": consistency, "q_repair_relations": repair,
    "q_consensus": fuzzy_consensus, "q_cross_source_merge": merge, "q_confirm_cascade": confirm, "q_supersession": supersession, "q_reasoning": reasoned, "q_treatment_updates": treatments, "q_chronology": chronology,
    "q_rerank_topk": rerank, "q_credibility": credibility, "q_evidence_lookup": with_evidence, "q_third_model": tie_breaks, "q_majority_vote": votes, "q_audit_verdicts": audited, "q_static_export": rows_for_static,
    "q_property_graph": property_nodes, "q_crosswalk_first": first_listed, "q_first_hit": first_hits, "q_rate_limit": limited, "q_document_selection": selected_documents,
}

CREDIBILITY = "round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.0::DOUBLE + 0.15::DOUBLE * {j} + 0.15::DOUBLE * {v} + 0.25::DOUBLE * {s} + 0.15::DOUBLE * 0.5::DOUBLE + 0.15::DOUBLE * {r} + 0.15::DOUBLE * {c})), 4)"
ORACLE = {
    "q_flagship": f"""
WITH e AS ({EDGE_SQL}),
s AS (SELECT *, round(l_discount * 0.5::DOUBLE + (1 - l_tax) * 0.3::DOUBLE + CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE, 6) AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY score DESC, edge_id) AS rank FROM s)
SELECT relation, count(*) AS total, 1.0::DOUBLE AS coverage, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END), 6) AS staged, round(avg(l_discount), 6) AS credibility,
       string_agg(edge_id, ',' ORDER BY rank) FILTER (rank <= 5) AS best
FROM k GROUP BY relation""",
    "q_validate_edges": f"SELECT coalesce({REASON_SQL}, 'valid') AS reason, count(*) AS n FROM ({RAW_SQL}) GROUP BY 1",
    "q_project_edges": f"""
SELECT substr(md5(s || '|' || r || '|' || o), 1, 12) AS edge_id, 'drug' AS source_type, r AS relation, 'disease' AS target_type, strftime(make_date(year(l_shipdate)::BIGINT, 1, 1), '%Y-%m-%d') AS discovery_date, a AS onset_age_min,
       {CREDIBILITY.format(j="0.3::DOUBLE", v="0.0::DOUBLE", s="0.1::DOUBLE", r="1.0::DOUBLE", c="c")} AS credibility, {t.ORD_SQL} AS ord
FROM (SELECT *, {REASON_SQL} AS reason FROM ({RAW_SQL})) WHERE reason IS NULL""",
    "q_temporal_coverage": f"""
SELECT relation, count(*) AS total, 1.0::DOUBLE AS coverage, 1.0::DOUBLE AS discovery_date, 1.0::DOUBLE AS onset_age, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END), 6) AS progression_stage, 0.0::DOUBLE AS duration, 0.0::DOUBLE AS validity_end
FROM ({EDGE_SQL}) GROUP BY relation""",
    "q_conflicts": f"""
SELECT 'part ' || l_partkey AS source, 'supplier ' || l_suppkey AS target, 'indication_contraindication_conflict' AS type, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations
FROM ({EDGE_SQL}) GROUP BY l_partkey, l_suppkey HAVING bool_or(relation = 'indication') AND bool_or(relation = 'contraindication')""",
    "q_consistency": f"""
WITH e AS (SELECT d, l_quantity AS a, (l_quantity + 100 * l_tax) * 3 - 20 AS b, d + (3 - l_quantity::INT) AS ends FROM ({EDGE_SQL})),
i AS (
  SELECT 'future_date' AS issue_type, 'error' AS severity FROM e WHERE d > DATE '{t.AS_OF}' UNION ALL SELECT 'age_implausible', 'error' FROM e WHERE a > b
  UNION ALL SELECT 'age_implausible', 'warning' FROM e WHERE b > 120 UNION ALL SELECT 'date_ordering', 'error' FROM e WHERE ends < d UNION ALL SELECT 'date_ordering', 'warning' FROM e WHERE year(d) < 1900)
SELECT issue_type, severity, count(*) AS n FROM i GROUP BY ALL""",
    "q_repair_relations": """
WITH e AS (SELECT ['disease', 'phenotype', 'drug', 'gene/protein', 'biological_process'] AS k, ['disease_phenotype_positive', 'disease_disease', 'indication', 'disease_protein'] AS q, * FROM lineitem),
x AS (SELECT k[l_partkey % 5 + 1] AS s, q[l_orderkey % 4 + 1] AS r, k[l_suppkey % 5 + 1] AS o FROM e),
j AS (SELECT *, s || '|' || r || '|' || o AS z,
  CASE WHEN (r = 'disease_phenotype_positive' AND ((s = 'disease' AND o = 'phenotype') OR (s = 'phenotype' AND o = 'disease'))) OR (r = 'disease_disease' AND s = 'disease' AND o = 'disease')
         OR (r = 'indication' AND ((s = 'drug' AND o = 'disease') OR (s = 'disease' AND o = 'drug'))) OR (r = 'disease_protein' AND ((s = 'disease' AND o = 'gene/protein') OR (s = 'gene/protein' AND o = 'disease'))) THEN 'valid' END AS v FROM x),
m AS (SELECT *, CASE
  WHEN v IS NOT NULL THEN NULL
  WHEN z = 'disease|disease_phenotype_positive|disease' THEN 'disease_disease'
  WHEN z IN ('disease|disease_disease|phenotype', 'phenotype|disease_disease|disease') THEN 'disease_phenotype_positive'
  WHEN z IN ('gene/protein|disease_phenotype_positive|phenotype', 'phenotype|disease_phenotype_positive|gene/protein') THEN 'phenotype_protein'
  WHEN z IN ('drug|indication|phenotype', 'phenotype|indication|drug') THEN 'drug_effect'
  WHEN z IN ('gene/protein|disease_phenotype_positive|disease', 'disease|disease_phenotype_positive|gene/protein') THEN 'disease_protein'
  WHEN z IN ('disease|disease_protein|biological_process', 'biological_process|disease_protein|disease', 'biological_process|disease_protein|gene/protein', 'gene/protein|disease_protein|biological_process') THEN 'bioprocess_protein' END AS better FROM j)
SELECT s AS source_type, coalesce(better, r) AS relation, o AS target_type, coalesce(v, CASE WHEN better IS NOT NULL THEN 'reclassified' ELSE 'tagged_unresolved' END) AS action, count(*) AS n FROM m GROUP BY ALL""",
    # By construction all wordings of a name are alike and different names are not, so a claim's cluster is its part, relation
    # and base; the third model aside, rows of several models or sources always connect.
    "q_consensus": f"""
WITH e AS (SELECT *, l_orderkey % 2 AS base, CASE WHEN l_linenumber % 4 = 3 THEN 36 ELSE 35 END + CASE WHEN (l_linenumber + 1) % 4 = 3 THEN 36 ELSE 35 END AS long FROM ({EDGE_SQL})),
b AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS models FROM e GROUP BY 1),
g AS (SELECT l_partkey, relation, base, count(DISTINCT l_suppkey) AS n_models, arg_max(ord, (l_discount, long, -ord)) AS ord FROM e GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2)
SELECT l_partkey AS source_id, relation, ord, n_models, round(n_models / models, 6) AS confidence FROM g JOIN b USING (l_partkey)""",
    "q_cross_source_merge": f"""
WITH e AS (SELECT *, l_orderkey % 2 AS base FROM ({EDGE_SQL})), n AS (SELECT *, count(DISTINCT l_orderkey) OVER (PARTITION BY l_partkey, relation, base) AS orders FROM e),
c AS (SELECT *, CASE WHEN orders > 1 THEN 0 ELSE ord END AS cluster FROM n)
SELECT l_partkey::VARCHAR AS disease_profile_id, relation, arg_max(ord, (l_discount, -ord)) AS ord, count(*) AS n_members, count(DISTINCT l_orderkey) AS n_sources, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS models,
       round(max(l_discount), 6) AS credibility, round(CASE WHEN count(*) > 1 THEN greatest(arg_max(1 - l_tax, (l_discount, -ord)), least(1.0::DOUBLE, count(*) * 0.33::DOUBLE)) ELSE max(1 - l_tax) END, 6) AS consensus
FROM c GROUP BY l_partkey, relation, base, cluster""",
    "q_confirm_cascade": f"""
WITH kg AS (SELECT DISTINCT l_partkey AS x, {t.RELATION_SQL} AS r, l_suppkey AS y FROM lineitem WHERE l_linenumber = 1),
q AS (SELECT l_partkey AS x, {t.RELATION_SQL} AS r, l_suppkey AS y, {t.ORD_SQL} AS ord FROM lineitem WHERE l_linenumber > 1),
m AS (SELECT ord, x, y, EXISTS (FROM kg WHERE kg.x = q.x AND kg.r = q.r AND kg.y = q.y) AS a, EXISTS (FROM kg WHERE kg.x = q.y AND kg.r = q.r AND kg.y = q.x) AS b, EXISTS (FROM kg WHERE kg.x = q.x AND kg.y = q.y) AS c, EXISTS (FROM kg WHERE kg.x = q.y AND kg.y = q.x) AS d FROM q),
rest AS (SELECT DISTINCT x, y FROM m WHERE NOT (a OR b OR c OR d)),
s AS (SELECT DISTINCT x::VARCHAR AS n, 'drug' AS k FROM kg UNION SELECT DISTINCT y::VARCHAR, 'disease' FROM kg),
asked AS (SELECT x::VARCHAR AS w FROM rest UNION SELECT y::VARCHAR FROM rest),
near AS (SELECT w, n FROM (SELECT w, n, row_number() OVER (PARTITION BY w ORDER BY n, n, k) AS i FROM asked JOIN s ON contains(n, w) OR contains(w, n)) WHERE i <= 10),
e AS (SELECT x::VARCHAR AS cx, y::VARCHAR AS cy, false AS v FROM kg UNION SELECT y::VARCHAR, x::VARCHAR, true FROM kg),
f AS (SELECT rest.x, rest.y, bool_and(v) AS v FROM rest JOIN near p ON p.w = rest.x::VARCHAR JOIN near q ON q.w = rest.y::VARCHAR JOIN e ON e.cx = p.n AND e.cy = q.n GROUP BY ALL)
SELECT ord, CASE WHEN a OR b THEN 'exact' WHEN c OR d THEN 'same_relation' WHEN f.v IS NOT NULL THEN 'fuzzy_name' END AS match_type, CASE WHEN a THEN false WHEN b THEN true WHEN c THEN false WHEN d THEN true ELSE f.v END AS reversed
FROM m LEFT JOIN f ON f.x = m.x AND f.y = m.y""",
    "q_supersession": f"""
WITH e AS ({EDGE_SQL}), o AS (SELECT l_partkey, l_suppkey, min((d, ord, edge_id)) AS x FROM e WHERE relation = 'indication' GROUP BY ALL), n AS (SELECT l_partkey, l_suppkey, max((d, -ord, edge_id)) AS y FROM e WHERE relation = 'contraindication' GROUP BY ALL)
SELECT x[3] AS old_edge_id, y[3] AS new_edge_id, 'contradictory' AS reason, x[1]::VARCHAR AS old_date, y[1]::VARCHAR AS new_date FROM o JOIN n USING (l_partkey, l_suppkey) WHERE y[1] > x[1]""",
    "q_reasoning": f"""
WITH e AS ({EDGE_SQL}), o AS (SELECT l_partkey, l_suppkey, min((d, ord, edge_id)) AS x FROM e WHERE relation = 'indication' GROUP BY ALL), n AS (SELECT l_partkey, l_suppkey, max((d, -ord, edge_id)) AS y FROM e WHERE relation = 'contraindication' GROUP BY ALL)
SELECT x[3] AS edge_id, y[3] AS superseded_by, x[1]::VARCHAR AS starts, y[1]::VARCHAR AS ends FROM o JOIN n USING (l_partkey, l_suppkey) WHERE y[1] > x[1]""",
    "q_treatment_updates": f"""
WITH e AS (SELECT *, 'part ' || l_partkey AS drug, CASE WHEN ord % 50 = 1 THEN 'now preferred over part ' || l_partkey || ' and part 1' END AS said FROM ({EDGE_SQL}) WHERE relation = 'indication')
SELECT o.edge_id AS old_edge_id, n.edge_id AS new_edge_id, 'updated_treatment' AS reason FROM e n JOIN e o ON n.l_suppkey = o.l_suppkey AND o.d < n.d AND o.edge_id <> n.edge_id AND n.said IS NOT NULL AND contains(n.said, o.drug)""",
    "q_chronology": f"SELECT l_partkey::VARCHAR AS source_id, relation, count(*) AS n, min(d)::VARCHAR AS first_date, max(d)::VARCHAR AS last_date FROM ({EDGE_SQL}) GROUP BY ALL HAVING count(*) >= 2",
    "q_rerank_topk": f"""
WITH s AS (SELECT l_partkey::VARCHAR AS source_id, edge_id, round(l_discount * 0.5::DOUBLE + (1 - l_tax) * 0.3::DOUBLE + CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.2::DOUBLE, 6) AS score FROM ({EDGE_SQL}))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, edge_id)::INT AS rank FROM s) WHERE rank <= 3""",
    "q_credibility": f"""
WITH o AS (SELECT *, floor(o_totalprice / 1000) AS n, greatest(0.5::DOUBLE, date_diff('day', o_orderdate::DATE, DATE '2000-01-01') / 365.25::DOUBLE) AS y, substr(o_orderpriority, 1, 1)::INT AS p FROM orders),
v AS (SELECT *, n / y AS v FROM o)
SELECT o_orderkey, floor({CREDIBILITY.format(j="1.0::DOUBLE", v="CASE WHEN n <= 0 THEN 0.0 WHEN v >= 50 THEN least(1.0::DOUBLE, 0.9::DOUBLE + (v - 50) / 500) WHEN v >= 5 THEN 0.5::DOUBLE + (v - 5) / 45 * 0.4::DOUBLE ELSE v / 5 * 0.5::DOUBLE END", s="list_extract([1.0::DOUBLE, 0.9::DOUBLE, 0.7::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE], p)", r="CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END", c="0.5::DOUBLE")} * 100 + 0.003::DOUBLE)::BIGINT AS score FROM v""",
    "q_evidence_lookup": f"""
SELECT {t.ORD_SQL} AS ord, round(o_totalprice / 1e6, 6) AS score, o_orderpriority AS study_type FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) ON l_orderkey = o_orderkey""",
    "q_third_model": """
SELECT l_orderkey AS source_id, count(*) FILTER (l_returnflag = 'A') AS n_first, count(*) FILTER (l_returnflag = 'R') AS n_second,
       (least(n_first, n_second) = 0 AND greatest(n_first, n_second) > 0) OR greatest(n_first, n_second) > 5 * least(n_first, n_second) AS needs_third FROM lineitem GROUP BY 1""",
    "q_majority_vote": """
WITH n AS (SELECT l_orderkey, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, v) AS r FROM n)
SELECT l_orderkey, CASE WHEN n >= 2 THEN v ELSE 'DISAGREE' END AS verdict FROM k WHERE r = 1""",
    "q_static_export": f"SELECT relation, l_partkey::VARCHAR AS x_id, l_suppkey::VARCHAR AS y_id, '[\"' || l_orderkey || '\"]' AS source_ids, '' AS duration, CASE WHEN l_linestatus = 'O' THEN 'open' ELSE '' END AS progression_stage FROM ({EDGE_SQL})",
    "q_property_graph": f"""
SELECT 'Drug' AS label, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'Disease', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT upper(relation), count(*) FROM ({EDGE_SQL}) GROUP BY 1""",
    "q_crosswalk_first": """
WITH g AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1 HAVING count(*) >= 15), f AS (SELECT c_nationkey, min(c_custkey) AS gold_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM g) GROUP BY 1)
SELECT n_nationkey AS disease_id, n_name, gold_id, n_orders FROM nation JOIN f ON n_nationkey = c_nationkey JOIN g ON gold_id = o_custkey""",
    "q_first_hit": f"""
WITH o AS (SELECT * FROM ({t.MATCHED_SQL})), r AS (SELECT l_partkey AS disease_id, {t.ORD_SQL} AS ro, l_quantity AS x2, l_quantity + 2 AS y2 FROM lineitem WHERE l_linenumber = 2),
v AS (SELECT o.disease_id, o.ord, ro, CASE WHEN a <= y2 AND b >= x2 THEN 'overlap' WHEN a > y2 THEN 'ambiguous' END AS v FROM o JOIN r USING (disease_id)),
f AS (SELECT disease_id, ord, arg_min(v, ro) AS v FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT coalesce(v, 'none') AS verdict, count(*) AS n FROM o LEFT JOIN f USING (disease_id, ord) GROUP BY 1""",
    "q_rate_limit": """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND CURRENT ROW) AS in_window, in_window > 2 AS limited FROM events""",
    "q_document_selection": """
WITH d AS (SELECT o_custkey AS disease_id, lpad(o_orderkey::VARCHAR, 9, '0') AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1)::INT % 2 + 1, o_totalprice DESC, lpad(o_orderkey::VARCHAR, 9, '0'))::INT AS rank FROM orders)
SELECT * FROM d WHERE disease_id % 3 = 2 OR rank <= CASE disease_id % 3 WHEN 0 THEN 8 ELSE 5 END""",
}
