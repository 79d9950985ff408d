"""Queries of validation, features, coverage, evidence ages, clustering and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.functions import ages
from kairoscope.operators import diagnosis, evidence, gold, profiles
from kairoscope.queries import tables as t



def intervals(spark: SparkSession, sf: str) -> DataFrame:
    m = t.matched(spark, sf)
    w = [F.col(c) for c in ("onset_min", "onset_max", "ref_min", "ref_max")]
    return m.groupBy("relation").agg(F.count_if(ages.overlaps(*w)).alias("overlap"), F.count_if(ages.contained(*w)).alias("inside"), F.count_if(ages.narrower(*w)).alias("narrower"), F.count_if(ages.admits(w[0], w[1], F.lit(30.0))).alias("admits"))


def four_strategies(spark: SparkSession, sf: str) -> DataFrame:
    s = gold.strategies(t.matched(spark, sf), "disease_id")
    return s.select(*[F.round(c, 6).alias(c) if c.endswith("width") else F.col(c) for c in s.columns])


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return gold.taxonomy_summary(gold.taxonomy(t.matched(spark, sf), "disease_id"))


def taxonomy_staged(spark: SparkSession, sf: str) -> DataFrame:
    return gold.taxonomy(t.matched(spark, sf), "disease_id", strict=False).groupBy("category").agg(F.count("*").alias("n"))


def quartiles(spark: SparkSession, sf: str) -> DataFrame:
    q = gold.by_quartile(t.matched(spark, sf))
    return q.select("quartile", "n", "overlap", "contained", F.round("credibility", 6).alias("credibility"))


def by_relation(spark: SparkSession, sf: str) -> DataFrame:
    return gold.by_relation(t.matched(spark, sf))


def ablation(spark: SparkSession, sf: str) -> DataFrame:
    return gold.ablation(t.matched(spark, sf)).select(F.col("threshold").cast("long").alias("threshold"), "n_triples", "n_diseases", "overlap", "contained")


def onset_bins(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    low, high = F.col("l_quantity"), F.col("l_quantity") + 100 * F.col("l_tax")
    return li.select(ages.onset_bin(low, high).alias("refined"), ages.link_bin(low, high).alias("link"), ages.link_bin(low, high, ages.TERM_BINS).alias("term"), ages.year_bin(F.year("l_shipdate") + 10).alias("era"), ages.stage_index(low).alias("stage")).groupBy("refined", "link", "term", "era", "stage").agg(F.count("*").alias("n"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("onset_min"), (F.col("l_quantity") + 100 * F.col("l_tax")).alias("onset_max"), F.col("l_linestatus").alias("stage"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("milestone"))
    f = profiles.onset_features(li, "l_partkey")
    return f.select("l_partkey", "n_onset", "n_stages", "n_milestones", *[F.round(c, 4).alias(c) for c in ("median_onset", "mean_onset", "min_onset", "max_onset", "spread", "iqr")])


def granularity(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.granularity(t.table(spark, sf, "orders"), "o_custkey", "o_orderdate")


def dated(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    return li.select("l_partkey", "l_suppkey", (F.year("l_shipdate") + 20).alias("year"), F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("quality_grade"))


def staleness(spark: SparkSession, sf: str) -> DataFrame:
    s = profiles.staleness(dated(spark, sf))
    return s.select("n", "median_year", *[F.col(f"`{name}`").alias(f"b{i}") for i, (_, name) in enumerate(profiles.BRACKETS)], "median_A", F.round("recent_A", 6).alias("recent_A"), "median_B", F.round("recent_B", 6).alias("recent_B"))


def long_lived(spark: SparkSession, sf: str) -> DataFrame:
    found = profiles.long_lived(dated(spark, sf), "l_partkey", "l_suppkey", least_span=4)
    return found.withColumns({c: F.col(c).cast("long") for c in ("first_year", "last_year", "span")})


def evidence_years(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    e = o.select(F.col("o_orderkey").alias("ord"), F.array(F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string")).alias("source_ids"))
    docs = o.filter("o_orderstatus = 'P'").select(F.concat(F.lit("PMID:"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderdate").cast("string").alias("publication_date"), F.col("o_orderkey").alias("ord"))
    return profiles.evidence_years(e, profiles.year_index(docs)).select("ord", "year")


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.audit(t.table(spark, sf, "lineitem"), ("l_returnflag", "l_linestatus", "l_linenumber", "l_tax"))


def novel(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("disease_id"))
    o = t.table(spark, sf, "orders")
    return profiles.novel(c, o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("disease_id")), o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("disease_id")))


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    a, b = o.filter("o_orderstatus = 'O'").select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first": a.distinct().join(b.distinct(), "o_custkey", "left_anti"), "semi": t.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).join(a, "o_custkey", "left_semi")}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def claims(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    computed = li.groupBy(F.col("l_returnflag").alias("name")).agg(F.sum("l_quantity").alias("value"))
    claimed = li.groupBy(F.col("l_returnflag").alias("name")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 1.01).otherwise(F.col("l_quantity"))).alias("value"))
    extra = li.agg(F.sum("l_quantity").alias("value")).select(F.lit("Z").alias("name"), "value")
    return gold.claims_checked(claimed.unionByName(extra), computed).select("name", "status")


def onsets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' lines as phenotype windows: brand of disease, type of phenotype."""
    p = t.table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("disease"), F.col("p_type").alias("phenotype"), F.col("p_size").cast("double").alias("onset_min"), (F.col("p_size") + 5.0).alias("onset_max"))


def shared(spark: SparkSession, sf: str) -> DataFrame:
    return diagnosis.shared_phenotypes(onsets(spark, sf))


def distractors(spark: SparkSession, sf: str) -> DataFrame:
    o = onsets(spark, sf)
    return diagnosis.distractors(o, o, 1, 4).select("target", "candidate", "shared", F.col("rank").cast("long").alias("rank"))


def simulation(spark: SparkSession, sf: str) -> DataFrame:
    o = onsets(spark, sf).groupBy("disease", "phenotype").agg(F.min("onset_min").alias("onset_min"), F.max("onset_max").alias("onset_max"))
    s = diagnosis.simulate(o, o, points=(2.0, 10.0, 25.0, 40.0))
    return s.select("target", "age", "candidate", F.round("static", 6).alias("static"), F.round("temporal", 6).alias("temporal"))


def simulation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    o = onsets(spark, sf).groupBy("disease", "phenotype").agg(F.min("onset_min").alias("onset_min"), F.max("onset_max").alias("onset_max"))
    return diagnosis.accuracy(diagnosis.simulate(o, o))


def sample(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "customer")
    return profiles.stratified(c, "c_mktsegment", "c_custkey", 100).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    f = profiles.onset_features(t.table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("onset_min"), F.col("l_quantity").alias("onset_max"), F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("milestone")), "l_partkey")
    found, _ = profiles.clustered(f, ("median_onset", "spread", "iqr"), ks=(4, 5))
    return profiles.characterised(found, ("median_onset", "spread"), "l_partkey")


def confidence(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.when(F.col("o_totalprice") > 100000, 1.0).otherwise(0.0).alias("score"))
    return profiles.bootstrap(li, "o_orderstatus", rounds=50)


def collections(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("disease_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2).alias("tier"))
    return evidence.collection(o)


def spend(spark: SparkSession, sf: str) -> DataFrame:
    calls = t.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("provider"), F.col("o_custkey").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    prices = spark.createDataFrame([("O", 0.5, 1.5), ("F", 0.25, 1.0), ("P", 1.0, 4.0)], "provider string, input_price double, output_price double")
    c = evidence.costs(calls, prices)
    return c.select("provider", "input_tokens", "output_tokens", F.round("cost", 3).alias("cost"))


QUERIES = {
    "q_intervals": intervals, "q_four_strategy": four_strategies, "q_error_taxonomy": taxonomy, "q_error_taxonomy_staged": taxonomy_staged, "q_credibility_quartiles": quartiles, "q_relation_precision": by_relation, "q_threshold_ablation": ablation,
    "q_onset_bins": onset_bins, "q_features": features, "q_granularity": granularity, "q_staleness": staleness, "q_evidence_span": long_lived, "q_evidence_years": evidence_years, "q_quality_audit": audit, "q_novel_anti": novel,
    "q_setops": set_operations, "q_claims": claims, "q_shared_phenotypes": shared, "q_distractors": distractors, "q_diagnosis_scores": simulation, "q_diagnosis_accuracy": simulation_accuracy, "q_stratified_sample": sample,
    "q_kmeans": clusters, "q_bootstrap": confidence, "q_collections": collections, "q_costs": spend,
}

M = f"WITH m AS ({t.MATCHED_SQL})"
PER = f"""{M}, g AS (
  SELECT disease_id, x, y, count(*) AS n, min(a) AS a0, max(b) AS b1, median(a) AS ma, median(b) AS mb, list_sort(list(a)) AS la, list_sort(list(b)) AS lb,
         count(*) FILTER (a <= y AND b >= x) AS no, count(*) FILTER (a >= x AND b <= y) AS nc, avg(CASE WHEN relation = 'disease_phenotype_positive' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS other, max(l_orderkey) * 1000 > 33000000 AS recent
  FROM m WHERE NOT (x = 0 AND y >= 100) GROUP BY ALL),
d AS (SELECT *, least(ma, mb) AS lo, greatest(ma, mb) AS hi, CASE WHEN n >= 4 THEN la[n // 4 + 1] END AS q1, CASE WHEN n >= 4 THEN lb[3 * n // 4 + 1] END AS q3 FROM g),
s AS (SELECT *, coalesce(least(q1, q3), lo) AS ql, coalesce(greatest(q1, q3), hi) AS qh FROM d)"""
OVER = "CASE WHEN lo >= x AND hi <= y THEN 'CONTAINED' WHEN n = 1 THEN 'SINGLE_TRIPLE_NOISE' WHEN x >= lo AND y <= hi THEN 'TA_WIDER_BUT_CORRECT' WHEN lo <= y AND hi >= x AND other > 0.4 THEN 'PHENOTYPE_VS_DISEASE' WHEN lo <= y AND hi >= x THEN 'GRANULARITY_MISMATCH'"


def _stage(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} BETWEEN {low} AND {high} THEN {i}" for i, (_, low, high) in enumerate(ages.ONSET_STAGES)) + f" ELSE {len(ages.ONSET_STAGES) - 1} END"


def _bins(v: str, bins: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {below} THEN '{name}'" for below, name in bins[:-1]) + f" ELSE '{bins[-1][1]}' END"


ONSETS_SQL = "SELECT p_brand AS d, p_type AS p, p_size::DOUBLE AS a, p_size + 5.0::DOUBLE AS b FROM part"
SHARED_SQL = "SELECT x.d AS a, y.d AS b, count(*) AS shared FROM (SELECT DISTINCT p_brand AS d, lower(p_type) AS p FROM part) x JOIN (SELECT DISTINCT p_brand AS d, lower(p_type) AS p FROM part) y ON x.p = y.p AND x.d <> y.d GROUP BY ALL"
RIVALS_SQL = f"""SELECT a AS target, b AS candidate, shared, row_number() OVER (PARTITION BY a ORDER BY shared DESC, total, b) AS rank
FROM ({SHARED_SQL}) JOIN (SELECT p_brand AS b, count(DISTINCT lower(p_type)) AS total FROM part GROUP BY 1) USING (b)"""
ORACLE = {
    "q_intervals": f"{M} SELECT relation, count(*) FILTER (a <= y AND b >= x) AS overlap, count(*) FILTER (a >= x AND b <= y) AS inside, count(*) FILTER (b - a < y - x) AS narrower, count(*) FILTER (30 BETWEEN a AND b) AS admits FROM m GROUP BY 1",
    "q_four_strategy": f"""{PER} SELECT count(*) AS compared, count(*) FILTER (a0 <= y AND b1 >= x) AS minmax_overlap, count(*) FILTER (a0 >= x AND b1 <= y) AS minmax_contained, count(*) FILTER (lo <= y AND hi >= x) AS median_overlap, count(*) FILTER (lo >= x AND hi <= y) AS median_contained,
  sum(n)::BIGINT AS per_triple_total, sum(no)::BIGINT AS per_triple_overlap, sum(nc)::BIGINT AS per_triple_contained, count(*) FILTER (ql <= y AND qh >= x) AS iqr_overlap, count(*) FILTER (ql >= x AND qh <= y) AS iqr_contained,
  round(avg(b1 - a0), 6) AS minmax_width, round(avg(hi - lo), 6) AS median_width, round(avg(y - x), 6) AS gold_width FROM s""",
    "q_error_taxonomy": f"""{PER}, c AS (SELECT {OVER} WHEN abs((lo + hi) / 2 - (x + y) / 2) <= 10 THEN 'ADJACENT_STAGE' ELSE 'GENUINELY_WRONG' END AS category FROM s), k AS (SELECT category, count(*) AS count FROM c GROUP BY 1)
SELECT category, count, round_even(100 * count / sum(count) OVER (), 2) AS share, round_even(100 * sum(CASE WHEN category IN ('CONTAINED', 'TA_WIDER_BUT_CORRECT', 'GRANULARITY_MISMATCH') THEN count ELSE 0 END) OVER () / sum(count) OVER (), 2) AS effective FROM k""",
    "q_error_taxonomy_staged": f"""{PER}, c AS (SELECT {OVER} WHEN least(abs({_stage("(lo + hi) / 2")} - {_stage("x")}), abs({_stage("(lo + hi) / 2")} - {_stage("y")})) <= 1 THEN 'ADJACENT_STAGE' WHEN recent THEN 'GOLD_POSSIBLY_OUTDATED' ELSE 'GENUINELY_WRONG' END AS category FROM s)
SELECT category, count(*) AS n FROM c GROUP BY 1""",
    "q_credibility_quartiles": f"""{M}, r AS (SELECT *, row_number() OVER (ORDER BY credibility DESC, ord) - 1 AS i, count(*) OVER () AS n FROM m WHERE credibility IS NOT NULL AND NOT (x = 0 AND y >= 100))
SELECT CASE WHEN i < n // 4 THEN 'Q1' WHEN i < n // 2 THEN 'Q2' WHEN i < 3 * n // 4 THEN 'Q3' ELSE 'Q4' END AS quartile, count(*) AS n, count(*) FILTER (a <= y AND b >= x) AS overlap, count(*) FILTER (a >= x AND b <= y) AS contained, round(avg(credibility), 6) AS credibility FROM r GROUP BY 1""",
    "q_relation_precision": f"{M} SELECT relation, count(*) AS n, count(*) FILTER (a <= y AND b >= x) AS overlap, count(*) FILTER (a >= x AND b <= y) AS contained FROM m GROUP BY 1",
    "q_threshold_ablation": f"{M} SELECT threshold, count(*) AS n_triples, count(DISTINCT disease_id) AS n_diseases, count(*) FILTER (a <= y AND b >= x) AS overlap, count(*) FILTER (a >= x AND b <= y) AS contained FROM m JOIN (SELECT unnest([1, 2, 3])::BIGINT AS threshold) ON n_models >= threshold GROUP BY 1",
    "q_onset_bins": f"""
WITH e AS (SELECT l_quantity AS a, l_quantity + 100 * l_tax AS b, year(l_shipdate) + 10 AS y FROM lineitem), m AS (SELECT *, (a + b) / 2 AS m FROM e)
SELECT CASE WHEN b - a > 60 THEN 'broad_range' ELSE {_bins("m", ages.REFINED_BINS)} END AS refined, {_bins("m", ages.LINK_BINS)} AS link, {_bins("m", ages.TERM_BINS)} AS term, {_bins("y", ages.YEAR_BINS)} AS era, {_stage("a")} AS stage, count(*) AS n FROM m GROUP BY ALL""",
    "q_features": """
WITH e AS (SELECT l_partkey, (l_quantity + (l_quantity + 100 * l_tax)) / 2 AS m, l_linestatus, l_returnflag FROM lineitem),
g AS (SELECT l_partkey, count(*) AS n_onset, count(DISTINCT l_linestatus) AS n_stages, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS n_milestones, median(m) AS a, avg(m) AS b, min(m) AS c, max(m) AS d, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS q FROM e GROUP BY 1)
SELECT l_partkey, n_onset, n_stages, n_milestones, round(a, 4) AS median_onset, round(b, 4) AS mean_onset, round(c, 4) AS min_onset, round(d, 4) AS max_onset, round(d - c, 4) AS spread, round(CASE WHEN n_onset >= 4 THEN q ELSE d - c END, 4) AS iqr FROM g""",
    "q_granularity": "WITH n AS (SELECT o_custkey, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1) SELECT CASE WHEN n <= 1 THEN '1_phenotype' WHEN n <= 5 THEN '2-5_phenotypes' WHEN n <= 10 THEN '6-10_phenotypes' WHEN n <= 20 THEN '11-20_phenotypes' ELSE '20+_phenotypes' END AS bucket, count(*) AS diseases, median(n) AS median_n FROM n GROUP BY 1",
    "q_staleness": """
WITH e AS (SELECT year(l_shipdate) + 20 AS y, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END AS g FROM lineitem)
SELECT count(*) AS n, median(y) AS median_year, count(*) FILTER (y >= 2021) AS b0, count(*) FILTER (y >= 2016 AND y < 2021) AS b1, count(*) FILTER (y >= 2011 AND y < 2016) AS b2, count(*) FILTER (y >= 2006 AND y < 2011) AS b3, count(*) FILTER (y < 2006) AS b4,
       median(y) FILTER (g = 'A') AS median_A, round(avg((y >= 2020)::INT) FILTER (g = 'A'), 6) AS recent_A, median(y) FILTER (g = 'B') AS median_B, round(avg((y >= 2020)::INT) FILTER (g = 'B'), 6) AS recent_B FROM e""",
    "q_evidence_span": "WITH e AS (SELECT l_partkey, l_suppkey, year(l_shipdate) + 20 AS y FROM lineitem) SELECT l_partkey, l_suppkey, count(*) AS n, min(y) AS first_year, max(y) AS last_year, max(y) - min(y) AS span FROM e GROUP BY ALL HAVING count(*) >= 2 AND max(y) - min(y) >= 4 ORDER BY span DESC, l_partkey, l_suppkey LIMIT 50",
    "q_evidence_years": """
WITH d AS (SELECT o_custkey AS c, arg_max(year(o_orderdate), o_orderkey) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o_orderkey AS ord, coalesce(a.y, b.y)::INT AS year FROM orders LEFT JOIN d a ON a.c = o_custkey LEFT JOIN d b ON b.c = o_custkey + 1""",
    "q_quality_audit": """
SELECT 'l_returnflag' AS dimension, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_tax', l_tax::VARCHAR, count(*) FROM lineitem GROUP BY ALL""",
    "q_novel_anti": "SELECT c_custkey AS disease_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT')",
    "q_setops": """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'both' AS part, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'first', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'semi', count(*) FROM customer WHERE c_custkey IN (FROM a)""",
    "q_claims": "SELECT DISTINCT l_returnflag AS name, CASE WHEN l_returnflag = 'R' THEN 'mismatch' ELSE 'match' END AS status FROM lineitem UNION ALL SELECT 'Z', 'missing'",
    "q_shared_phenotypes": SHARED_SQL,
    "q_distractors": f"SELECT * FROM ({RIVALS_SQL}) WHERE rank <= 4",
    "q_diagnosis_scores": f"""
WITH o AS (SELECT d, p, min(a) AS a, max(b) AS b FROM ({ONSETS_SQL}) GROUP BY ALL), r AS (SELECT DISTINCT d AS target, d AS candidate FROM o UNION SELECT target, candidate FROM ({RIVALS_SQL}) WHERE rank <= 4),
s AS (SELECT d AS target, p, age FROM o JOIN (SELECT unnest([2.0::DOUBLE, 10.0::DOUBLE, 25.0::DOUBLE, 40.0::DOUBLE]) AS age) ON a <= age),
j AS (SELECT s.target, age, r.candidate, s.p, lower(s.p) AS p1, lower(k.p) AS p2, k.a, k.b FROM s JOIN r USING (target) JOIN o k ON k.d = r.candidate),
n AS (SELECT *, CASE WHEN p1 = p2 THEN 1.0::DOUBLE WHEN contains(p1, p2) OR contains(p2, p1) THEN 0.7::DOUBLE WHEN list_has_any(list_filter(string_split(p1, ' '), lambda w: length(w) > 4), list_filter(string_split(p2, ' '), lambda w: length(w) > 4)) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS m,
  CASE WHEN age BETWEEN a AND b THEN 1.0::DOUBLE WHEN least(abs(age - a), abs(age - b)) <= 3 THEN 0.5::DOUBLE WHEN least(abs(age - a), abs(age - b)) <= 8 THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END AS f FROM j),
x AS (SELECT target, age, candidate, p, max(m) AS m, max(m * f) AS t FROM n GROUP BY ALL)
SELECT target, age, candidate, round(avg(m), 6) AS static, round(avg(t), 6) AS temporal FROM x GROUP BY ALL""",
    "q_collections": """
SELECT o_custkey AS disease_id, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_tier1, count(*) FILTER (o_orderpriority <> '1-URGENT') AS n_tier2, CASE WHEN n_tier1 >= 2 AND n_tier2 >= 200 THEN 'rich' WHEN n_tier1 >= 1 OR n_tier2 >= 50 THEN 'moderate' ELSE 'sparse' END AS coverage FROM orders GROUP BY 1""",
    "q_costs": "SELECT o_orderstatus AS provider, sum(o_custkey)::BIGINT AS input_tokens, sum(o_orderkey)::BIGINT AS output_tokens, round(sum(o_custkey / 1000 * i + o_orderkey / 1000 * o), 3) AS cost FROM orders JOIN (VALUES ('O', 0.5::DOUBLE, 1.5::DOUBLE), ('F', 0.25::DOUBLE, 1.0::DOUBLE), ('P', 1.0::DOUBLE, 4.0::DOUBLE)) v(s, i, o) ON s = o_orderstatus GROUP BY 1",
}
