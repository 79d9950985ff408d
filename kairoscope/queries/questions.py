"""Queries of question generation, cleaning and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.functions import parse
from kairoscope.operators import benchmark as b
from kairoscope.operators import evidence
from kairoscope.queries import tables as t


def differential(spark: SparkSession, sf: str) -> DataFrame:
    return b.differential(t.gold_ranges(spark, sf)).select("disease_id", "answer", "test_age", F.array_join("options", "|").alias("options"))


def differential_check(spark: SparkSession, sf: str) -> DataFrame:
    """The invariant of the differential questions: how many ages lie in their own window, and in a distractor's."""
    gold = t.gold_ranges(spark, sf)
    q = b.differential(gold).join(gold.select("disease_id", "min_age", "max_age"), "disease_id")
    inside = F.col("test_age").between(F.col("min_age") - 1e-3, F.col("max_age") + 1e-3)
    other = F.exists("distractors", lambda d: F.col("test_age").between(d["min_age"], d["max_age"]))
    return q.agg((F.count("*") > 0).alias("some"), (F.count_if(inside) == F.count("*")).alias("all_inside"), F.count_if(other).alias("ambiguous"))


def window(spark: SparkSession, sf: str) -> DataFrame:
    q = b.window_questions(t.gold_ranges(spark, sf))
    within = F.col("test_age").between(F.col("min_age"), F.col("max_age"))
    return q.groupBy("answer").agg(F.min(within.cast("int")).alias("least_within"), F.max(within.cast("int")).alias("most_within"))


def cross(spark: SparkSession, sf: str) -> DataFrame:
    return b.cross_disease(t.gold_ranges(spark, sf)).select("disease_id", "question", "answer")


def milestone_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = t.table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("disease_id"), F.concat_ws("-", F.lit("Stage"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linestatus") == "O", "presentation")).alias("milestone"), (F.col("l_quantity") + 5 * F.col("l_linenumber")).alias("age"))


def greedy_gap(spark: SparkSession, sf: str) -> DataFrame:
    return b.milestones(milestone_edges(spark, sf)).select("disease_id", F.array_join(F.transform("kept", lambda m: m["name"]), ",").alias("kept"))


def ordering(spark: SparkSession, sf: str) -> DataFrame:
    return b.ordering(milestone_edges(spark, sf)).select("disease_id", "question", "answer")


def phenotype_edges(spark: SparkSession, sf: str) -> DataFrame:
    li, part = t.table(spark, sf, "lineitem"), t.table(spark, sf, "part")
    both = li.join(part, li["l_partkey"] == part["p_partkey"])
    return both.select(F.col("l_suppkey").alias("disease_id"), F.col("p_type").alias("phenotype"), F.col("l_linestatus").alias("stage"), F.col("l_quantity").alias("onset_min"), (F.col("l_quantity") + 5).alias("onset_max"), F.col("l_shipdate").cast("date").alias("discovery_date"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("source_name"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("target_name"), t.relation(F.col("l_returnflag")).alias("relation"), t.place().alias("ord"))


def stages(spark: SparkSession, sf: str) -> DataFrame:
    return b.stage_questions(phenotype_edges(spark, sf)).select("disease_id", "question", "answer")


def negatives(spark: SparkSession, sf: str) -> DataFrame:
    names = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("disease_id"), F.col("s_name").alias("name"))
    return b.negative(names, phenotype_edges(spark, sf)).select("disease_id", "test_age", "answer")


def evolution(spark: SparkSession, sf: str) -> DataFrame:
    return b.evolution(phenotype_edges(spark, sf)).select("disease_id", "question", "answer")


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return b.timeline(phenotype_edges(spark, sf)).select("disease_id", "answer")


def age_queries(spark: SparkSession, sf: str) -> DataFrame:
    return b.age_queries(phenotype_edges(spark, sf)).select("disease_id", "age", "answer")


def made(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as generated questions, some of them poor."""
    li = t.table(spark, sf, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("onset_age", "stage_phenotype", "treatment_timeline"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    whole = F.format_string("Between age %d and %d.", F.col("l_quantity").cast("int"), (F.col("l_quantity") + F.col("l_linenumber") - 1).cast("int"))
    answer = F.when(kind == "onset_age", whole).when(kind == "stage_phenotype", F.when(F.col("l_linestatus") == "O", "During the acute stage.").otherwise("Weakness and fatigue appear during the late stage of it.")).otherwise(F.when(F.col("l_linestatus") == "O", "Drugs in order.").otherwise("A first, later B, after some years C."))
    return li.select(t.ord_().alias("ord"), F.col("l_suppkey").alias("disease_id"), kind.alias("type"), F.col("l_partkey").alias("entity"), F.lit("What about the acute form?").alias("question"), answer.alias("answer"), F.col("l_discount").alias("confidence"), F.lit("easy").alias("difficulty"))


def removals(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf).groupBy("type", F.coalesce(b.removal(F.col("question"), F.col("answer"), F.col("type")), F.lit("kept")).alias("removed")).agg(F.count("*").alias("n"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    counts = t.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("disease_id")).agg(F.count("*").alias("n_triples"))
    return b.cleaned(made(spark, sf), counts).select("question_id", "ord", "disease_id", "type", "difficulty")


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    return b.statistics(made(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scorers over made-up answers: letters, texts, yes or no, ages."""
    li = t.table(spark, sf, "lineitem")
    options = F.create_map(F.lit("A"), F.lit("alpha fever"), F.lit("B"), F.lit("beta fever"), F.lit("C"), F.lit("gamma fever"))
    said = F.when(F.col("l_returnflag") == "A", "A) it is").when(F.col("l_returnflag") == "R", "It must be beta fever").otherwise("No idea")
    ages = F.format_string("between %d and %d years", F.col("l_quantity").cast("int"), (F.col("l_quantity") + 3).cast("int"))
    judged = li.select(
        b.score_choice(said, F.when(F.col("l_linestatus") == "O", "A").otherwise("B"), options).alias("choice"),
        b.score_window(F.when(F.col("l_returnflag") == "N", "Yes, it falls within").otherwise("No, it is outside"), F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No")).alias("window"),
        b.score_onset(ages, F.lit(10.0), F.lit(20.0)).alias("onset"),
        b.score_disease(said, F.lit("Beta fever")).alias("disease"),
    )
    return judged.groupBy("choice.how").agg(F.count("*").alias("n"), F.count_if(F.col("choice.correct")).alias("choice"), F.count_if(F.col("window.correct")).alias("window"), F.count_if(F.col("onset.correct")).alias("onset"), F.count_if(F.col("disease.correct")).alias("disease"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    o = t.table(spark, sf, "orders")
    answer = F.when(F.col("o_orderstatus") == "O", "The answer is (C).").when(F.col("o_orderstatus") == "F", "B. because").otherwise("Maybe, unsure")
    return o.groupBy(parse.letter(answer).alias("letter"), parse.yes_no_maybe(answer).alias("word")).agg(F.count("*").alias("n"))


def list_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = t.table(spark, sf, "part")
    said, gold = F.split("p_name", " "), F.array(F.array(F.element_at(F.split("p_name", " "), 1), F.lit("x")), F.array(F.lit("y")))
    return p.select("p_partkey", F.round(b.list_f1(said, gold), 6).alias("f1"), b.factoid(said, gold).alias("hit"))


def gold_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = t.table(spark, sf, "conversations")
    s = c.select(F.col("conv_id").alias("question_id"), F.lit("1").alias("pmid"), F.col("role").alias("section"), F.col("turn").alias("pos"), "text")
    return evidence.gold_documents(s).select("question_id", "n_snippets", F.length("text").alias("chars"))


def remaining(spark: SparkSession, sf: str) -> DataFrame:
    q = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    models, conditions = spark.createDataFrame([("m1",), ("m2",)], "model string"), spark.createDataFrame([("plain",), ("graph",)], "condition string")
    done = q.select("question_id", F.lit("m1").alias("model"), F.when(F.col("question_id") % 2 == 0, "plain").otherwise("other").alias("condition"))
    return b.remaining(q, models, conditions, done).groupBy("model", "condition").agg(F.count("*").alias("n"))


QUERIES = {
    "q_differential_questions": differential, "q_differential_invariant": differential_check, "q_window_invariant": window, "q_cross_disease": cross, "q_greedy_gap": greedy_gap, "q_ordering_questions": ordering, "q_stage_questions": stages, "q_negative_questions": negatives,
    "q_evidence_evolution": evolution, "q_timeline_first5": timeline, "q_age_queries": age_queries, "q_question_filters": removals, "q_clean_questions": cleaned, "q_question_statistics": statistics, "q_scorers": scored, "q_answer_parsers": parsed,
    "q_list_f1": list_scores, "q_gold_documents": gold_documents, "q_remaining_runs": remaining,
}

PH = "WITH e AS (SELECT l_suppkey AS s, p_type AS p, l_linestatus AS st, l_quantity AS a, l_quantity + 5 AS b, l_shipdate::DATE AS d, l_partkey, l_returnflag AS f, " + t.RELATION_SQL + " AS r, " + t.ORD_SQL + " AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)"
MADE = f"""WITH m AS (SELECT {t.ORD_SQL} AS ord, l_suppkey AS disease_id, l_partkey AS entity, l_discount AS c, ['onset_age', 'stage_phenotype', 'treatment_timeline'][l_orderkey % 3 + 1] AS type, l_linestatus AS st, l_linenumber AS ln FROM lineitem),
j AS (SELECT *, CASE WHEN type = 'onset_age' AND ln = 1 THEN 'same_min_max' WHEN type = 'stage_phenotype' AND st = 'O' THEN 'tautological' WHEN type = 'treatment_timeline' AND st = 'O' THEN 'no_temporal_content' END AS why FROM m)"""
ORACLE = {
    "q_differential_invariant": "SELECT true AS some, true AS all_inside, 0::BIGINT AS ambiguous",
    "q_window_invariant": "SELECT 'Yes' AS answer, 1 AS least_within, 1 AS most_within UNION ALL SELECT 'No', 0, 0",
    "q_stage_questions": f"{PH} SELECT s AS disease_id, 'Which phenotypes belong to the ' || lower(st) || ' stage?' AS question, string_agg(DISTINCT p, ', ' ORDER BY p) AS answer FROM e GROUP BY s, st HAVING count(DISTINCT p) >= 2",
    "q_evidence_evolution": f"""{PH} SELECT s AS disease_id, 'part ' || l_partkey || ' ' || r || ' supplier ' || s AS question, 'From ' || year(min(d)) || ' to ' || year(max(d)) || ' in ' || count(*) || ' sources, ' || (year(max(d)) - year(min(d))) || ' years.' AS answer FROM e GROUP BY s, l_partkey, r HAVING count(*) >= 2""",
    "q_timeline_first5": f"""{PH}, k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, ord) AS i, count(*) OVER (PARTITION BY s) AS n FROM e WHERE f = 'R')
SELECT s AS disease_id, string_agg('part ' || l_partkey || ' (' || year(d) || ')', ', ' ORDER BY i) AS answer FROM k WHERE n >= 3 AND i <= 5 GROUP BY 1""",
    "q_age_queries": f"{PH} SELECT s AS disease_id, age, string_agg(DISTINCT p, ', ' ORDER BY p) AS answer FROM e JOIN (SELECT unnest([1.0::DOUBLE, 10.0::DOUBLE, 40.0::DOUBLE]) AS age) ON age BETWEEN a AND b GROUP BY ALL",
    "q_question_filters": f"{MADE} SELECT type, coalesce(why, 'kept') AS removed, count(*) AS n FROM j GROUP BY ALL",
    "q_clean_questions": f"""{MADE}, k AS (SELECT *, row_number() OVER (PARTITION BY disease_id, type, entity ORDER BY c DESC, ord) AS i FROM j WHERE why IS NULL), n AS (SELECT l_suppkey AS disease_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'TQA-' || lpad((row_number() OVER (ORDER BY ord))::VARCHAR, greatest(5, length((row_number() OVER (ORDER BY ord))::VARCHAR))::INT, '0') AS question_id, ord, disease_id, type, CASE WHEN n < 5 THEN 'hard' WHEN type = 'onset_age' THEN 'easy' ELSE 'medium' END AS difficulty FROM k JOIN n USING (disease_id) WHERE i = 1""",
    "q_question_statistics": f"{MADE} SELECT type, 'easy' AS difficulty, count(*) AS n, count(DISTINCT disease_id) AS diseases FROM m GROUP BY 1",
    "q_scorers": """
WITH s AS (SELECT *, CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'O' THEN 'direct_letter_match' ELSE 'no_clear_answer' END WHEN 'R' THEN CASE l_linestatus WHEN 'O' THEN 'chose_wrong_option_B' ELSE 'option_text_match' END ELSE 'no_clear_answer' END AS how FROM lineitem)
SELECT how, count(*) AS n, count(*) FILTER (how IN ('direct_letter_match', 'option_text_match')) AS choice, count(*) FILTER ((l_returnflag = 'N') = (l_linestatus = 'O')) AS window, count(*) FILTER (l_quantity <= 22 AND l_quantity + 3 >= 8) AS onset, count(*) FILTER (l_returnflag = 'R') AS disease FROM s GROUP BY 1""",
    "q_answer_parsers": "SELECT CASE o_orderstatus WHEN 'O' THEN 'C' WHEN 'F' THEN 'B' END AS letter, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'maybe' END AS word, count(*) AS n FROM orders GROUP BY ALL",
    "q_list_f1": "SELECT p_partkey, round(2.0::DOUBLE * (1 / len(string_split(p_name, ' '))) * 0.5::DOUBLE / (1 / len(string_split(p_name, ' ')) + 0.5::DOUBLE), 6) AS f1, true AS hit FROM part",
    "q_gold_documents": """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations)
SELECT conv_id AS question_id, count(*) AS n_snippets, length(string_agg(CASE WHEN i = 1 THEN '## ' || role || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY turn))::INT AS chars FROM f GROUP BY 1""",
    "q_remaining_runs": "SELECT m AS model, c AS condition, count(*) FILTER (NOT (m = 'm1' AND c = 'plain' AND item_id % 2 = 0)) AS n FROM benchmark, (SELECT unnest(['m1', 'm2']) AS m), (SELECT unnest(['plain', 'graph']) AS c) GROUP BY ALL",
}
