"""Samples, prompts' contexts and summaries of the studies around the graph: benchmark coverage across graphs, case contexts,
judged samples, questions from cases, static facts and pairs of diseases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import ages, text
from kairoscope.operators.ranks import numbered
from kairoscope.storage import stored

# Words that show that a text speaks of time.
TIMING_WORDS = (
    "year", "month", "week", "day", "age", "onset", "birth", "congenital", "neonatal", "infancy", "infant", "childhood", "adolescen", "adult", "elderly",
    "prenatal", "antenatal", "juvenile", "toddler", "senior", "young",
)
#: Draws of distractors for each static question; three that fit are taken.
DRAWS = 16


def stated_range(answer: Column) -> Column:
    """struct(min, max) of "between age x and y" or "around age x"."""
    between = r"[Bb]etween age ([\d.]+) and ([\d.]+)"
    low, high = (F.regexp_extract(answer, between, i).try_cast("double") for i in (1, 2))
    around = F.regexp_extract(answer, r"[Aa]round age ([\d.]+)", 1).try_cast("double")
    return F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max"))).when(around.isNotNull(), F.struct(around.alias("min"), around.alias("max")))


def answered_by_graph(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """Question ids that the graph answers: their edge is there, or their disease has an edge with time whose end holds or is held by their target.

    questions has question_id, disease_id, target and edge_id; edges as the engine's.
    """
    t = F.col("temporal")
    known = questions.join(edges.select(F.col("disease_profile_id").alias("disease_id"), "edge_id").distinct(), ["disease_id", "edge_id"], "left_semi")
    timed = t["onset_age_min"].isNotNull() | t["discovery_date"].isNotNull() | text.present(t["temporal_qualifier"]) | text.present(t["milestone"]) | text.present(t["progression_stage"]) | text.present(t["duration"])
    ends = edges.filter(timed).select(F.col("disease_profile_id").alias("disease_id"), F.lower(F.trim("source_name")).alias("a"), F.lower(F.trim("target_name")).alias("b")).distinct()
    asked = questions.withColumn("target", F.lower(F.trim("target"))).filter("target <> ''")
    near = asked.join(ends, "disease_id").filter(F.contains("b", "target") | F.contains("a", "target") | F.contains("target", "b"))
    return known.select("question_id").union(near.select("question_id")).distinct()


def cross_graph(questions: DataFrame, edges: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """source -> total, answerable, correct, coverage and accuracy over a question set (question_id, disease_id, disease_name, target, edge_id, answer).

    The graph answers by its edges. A reference (name, min_age, max_age) answers questions that state ages for a disease of
    its own, rightly where the windows overlap; a negative lower age counts as birth. A static graph answers none.
    """
    held = stored(questions, "questions")
    total = held.agg(F.count("*").alias("total"))
    own = stored(answered_by_graph(held, edges), "answered").agg(F.count("*").alias("answerable"), F.count("*").alias("correct")).withColumn("source", F.lit("graph"))
    parts = [own, own.select(F.lit(0).cast("long").alias("answerable"), F.lit(0).cast("long").alias("correct"), F.lit("static").alias("source"))]
    w = stated_range(F.col("answer"))
    stated = held.withColumn("w", w).filter("w IS NOT NULL").withColumn("name", F.lower(F.trim("disease_name")))
    for source, ranges in references.items():
        ref = ranges.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("min_age").alias("min_age"), F.max("max_age").alias("max_age"))
        met = stated.join(ref, "name").withColumn("right", ages.overlaps(F.col("w.min"), F.col("w.max"), F.greatest(F.lit(0.0), F.coalesce("min_age", F.lit(0.0))), F.coalesce("max_age", F.lit(120.0))))
        parts.append(met.agg(F.count("*").alias("answerable"), F.count_if("right").alias("correct")).withColumn("source", F.lit(source)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return both.crossJoin(F.broadcast(total)).select("source", "total", "answerable", "correct", ratio("answerable", "total").alias("coverage"), ratio("correct", "answerable").alias("accuracy"))


def best_detail(details: DataFrame, key: str = "disease_id", least: int = 10) -> DataFrame:
    """Each key's best detail (evidence_text, ord): one that speaks of time if there is one, then the longest, then the first."""
    said = F.lower("evidence_text")
    timed = F.lit(False)
    for word in TIMING_WORDS:
        timed |= said.contains(word)
    whole = details.filter(F.length("evidence_text") >= least)
    row = F.struct(*details.columns)
    return whole.groupBy(key).agg(F.max_by(row, F.struct(timed, F.length("evidence_text"), -F.col("ord"))).alias("best")).select("best.*")


def judged_sample(triples: DataFrame, reference: DataFrame, n: int | None = 100, seed: int = 42) -> DataFrame:
    """Diseases of both tables with their medians, their longest evidence and whether the medians lie within the reference; half of each kind, or all without n.

    triples is (disease_id, onset_min, onset_max, evidence_text, ord), reference (disease_id, ref_min, ref_max). References
    for all ages, ages over 120 and evidence under 20 letters don't count. Which are taken is decided by hash.
    """
    high = F.coalesce("onset_max", "onset_min")
    usable = triples.withColumn("onset_max", high).filter((F.col("onset_min") <= 120) & (F.col("onset_max") <= 120) & (F.length("evidence_text") >= 20))
    own = usable.groupBy("disease_id").agg(F.median("onset_min").alias("median_min"), F.median("onset_max").alias("median_max"), F.max_by("evidence_text", F.struct(F.length("evidence_text"), -F.col("ord"))).alias("evidence_text"), F.count("*").alias("n_triples"))
    gold = reference.filter(~ages.all_ages(F.col("ref_min"), F.col("ref_max")))
    met = own.join(gold, "disease_id").withColumn("contained", ages.contained(F.col("median_min"), F.col("median_max"), F.col("ref_min"), F.col("ref_max")))
    if n is None:
        return met
    rank = F.row_number().over(Window.partitionBy("contained").orderBy(F.xxhash64("disease_id", F.lit(seed)), "disease_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= n // 2).drop("rank")


def case_contexts(candidates: DataFrame, phenotypes: DataFrame, windows: DataFrame) -> DataFrame:
    """case_id -> static and temporal context of its candidates (case_id, letter, disease, name).

    Static: a candidate's first 15 phenotypes by name. Temporal: its first 12 with a window, each with its first; else its
    phenotypes without one. phenotypes is (disease, phenotype), windows (disease, phenotype, onset_min, onset_max, ord).
    """
    known = phenotypes.filter("phenotype IS NOT NULL").groupBy("disease").agg(F.array_sort(F.collect_set("phenotype")).alias("known"))
    a, b = (F.format_string("%.0f", F.bround(c, 0)) for c in ("w.onset_min", "w.onset_max"))
    first = windows.filter("onset_min IS NOT NULL AND onset_max IS NOT NULL").groupBy("disease", "phenotype").agg(F.min_by(F.struct("onset_min", "onset_max"), "ord").alias("w"))
    said = F.concat("phenotype", F.lit(" (onset: "), F.when(F.col("w.onset_min") == F.col("w.onset_max"), a).otherwise(F.concat_ws("-", a, b)), F.lit("y)"))
    timed = first.groupBy("disease").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("phenotype", said.alias("said")))), 1, 12), lambda x: x["said"]).alias("timed"))
    each = candidates.join(known, "disease", "left").join(timed, "disease", "left")
    joined = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    static = F.when(F.size("known") > 0, F.concat(F.lit("Associated phenotypes: "), joined("known", 15))).otherwise("No phenotype data available in this knowledge base")
    temporal = F.when(F.size("timed") > 0, joined("timed", 12)).when(F.size("known") > 0, F.concat(F.lit("Phenotypes: "), joined("known", 12), F.lit(" (no onset age data)"))).otherwise("No data available")
    line = lambda c: F.concat("letter", F.lit(". "), "name", F.lit(": "), c)
    lines = each.select("case_id", "letter", line(static).alias("s"), line(temporal).alias("t"))
    of = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("letter", c))), lambda x: x[c]), "\n")
    return lines.groupBy("case_id").agg(of("s").alias("static_context"), of("t").alias("temporal_context"))


def seed_summary(runs: DataFrame, *by: str, metrics: tuple[str, ...] = ("mrr", "hits_1", "hits_10")) -> DataFrame:
    """Mean and population deviation of each metric over a condition's runs; failed runs (null metrics) don't count."""
    good = runs.dropna(subset=list(metrics))
    stats = [f(m).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return good.groupBy(*by).agg(F.count("*").alias("n_seeds"), *stats)


def component_ids(static: DataFrame, column: str = "x_id") -> DataFrame:
    """Static rows once for each part of a composite id ("1200_1134"), as disease_id with its prefix and zeros."""
    parts = F.array_distinct(F.filter(F.split(column, "_"), lambda x: x != ""))
    return static.withColumn("part", F.explode(parts)).withColumn("disease_id", F.concat(F.lit("MONDO:"), F.lpad("part", 7, "0"))).drop("part")


def case_questions(onsets: DataFrame, ids: DataFrame, least: int = 2) -> DataFrame:
    """When a phenotype presents in a disease, from case data (disease, phenotype, n_cases, onset_min, onset_max); ids is (name, disease_id)."""
    met = onsets.filter(F.col("n_cases") >= least).join(ids.groupBy(F.lower("name").alias("disease")).agg(F.min("disease_id").alias("disease_id")), "disease")
    n = F.concat(F.lit(" (from "), F.col("n_cases").cast("string"), F.lit(" cases)."))
    born = (F.col("onset_min") <= 0.01) & (F.col("onset_max") <= 0.08)
    answer = F.when(born, F.concat(F.lit("At birth / congenital"), n)).otherwise(F.concat(F.lit("Age "), F.format_string("%.1f-%.1f", "onset_min", "onset_max"), F.lit(" years"), n))
    asked = F.concat(F.lit('At what age does "'), "phenotype", F.lit('" typically present in '), F.initcap("disease"), F.lit("? (Based on patient case data)"))
    return met.select("disease_id", "phenotype", asked.alias("question"), answer.alias("answer"), F.lit("phenopackets_onset").alias("type"), F.lit("hard").alias("difficulty"))


def static_questions(pairs: DataFrame, kind: str, most: int = 250, seed: int = 42) -> DataFrame:
    """Multiple choice about static facts (disease, item): which item goes with a disease, among three that don't.

    Distractors are drawn by hash from all items by number; a disease for which too few of DRAWS fit has no question.
    """
    held = stored(pairs.select("disease", "item").distinct(), "facts")
    items = stored(numbered(held.select("item").distinct(), "i", "item"), "items")
    n = items.count()
    right = held.groupBy("disease").agg(F.min_by("item", F.struct(F.xxhash64("disease", "item", F.lit(seed)), "item")).alias("answer"))
    chosen = stored(right.orderBy(F.xxhash64("disease", F.lit(seed)), "disease").limit(4 * most), "chosen")
    drawn = chosen.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("i", F.pmod(F.xxhash64("disease", "j", F.lit(seed)), F.lit(max(1, n))) + 1)
    wrong = drawn.join(items, "i").join(held, ["disease", "item"], "left_anti").groupBy("disease", "item").agg(F.min("j").alias("j"))
    three = wrong.groupBy("disease").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("j", "item"))), lambda x: x["item"]), 1, 3).alias("wrong")).filter(F.size("wrong") == 3)
    mixed = F.array_sort(F.transform(F.concat("wrong", F.array("answer")), lambda x: F.struct(F.xxhash64("disease", x, F.lit(seed)).alias("h"), x.alias("item"))))
    asked = chosen.join(three, "disease").withColumn("options", F.transform(mixed, lambda x: x["item"])).orderBy(F.xxhash64("disease", F.lit(seed)), "disease").limit(most)
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), F.array_position("options", F.col("answer")).cast("int"))
    return asked.select("disease", F.format_string(f"Which {kind} is associated with %s?", "disease").alias("question"), "options", "answer", letter.alias("letter"), F.lit("static_control").alias("type"))


def extensions(own: DataFrame, reference: DataFrame, most_yes: int = 150, most_no: int = 50, least: int = 10, seed: int = 42) -> DataFrame:
    """Whether a disease can begin beyond what a reference says: yes where own windows with `least` sources do, no where they agree.

    own is (disease_id, name, onset_min, onset_max, n_sources), reference (disease_id, source, ref_min, ref_max).
    """
    met = own.join(reference, "disease_id")
    older, younger = F.col("onset_max") > F.col("ref_max"), F.col("onset_min") < F.col("ref_min")
    sided = met.withColumn("direction", F.when(older, "older").when(younger, "younger")).withColumn("answer", F.when(F.col("direction").isNotNull() & (F.col("n_sources") >= least), "Yes").when(F.col("direction").isNull(), "No")).filter("answer IS NOT NULL")
    one = sided.groupBy("disease_id").agg(F.min_by(F.struct(*sided.columns), F.struct((F.col("answer") == "No").cast("int"), "source")).alias("x")).select("x.*")
    rank = F.row_number().over(Window.partitionBy("answer").orderBy(F.xxhash64("disease_id", F.lit(seed)), "disease_id"))
    kept = one.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("answer") == "Yes", most_yes).otherwise(most_no))
    at = F.when(F.col("direction") == "younger", "younger ages (e.g., neonatally or in infancy)").otherwise("older ages (e.g., in adulthood or later)")
    asked = F.concat(F.lit("Existing databases ("), "source", F.lit(") list the typical onset of "), "name", F.lit(" as "), F.format_string("%.0f-%.0f", "ref_min", "ref_max"), F.lit(" years. Based on recent literature, can it also present at "), at, F.lit("?"))
    return kept.select("disease_id", asked.alias("question"), "answer", F.coalesce("direction", F.lit("none")).alias("direction"), F.lit(3).alias("tier"))


def comparisons(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """How two diseases (a, b of pairs) differ: by their mean onset, and by their stages, where both have some."""
    t = F.col("temporal")
    each = edges.groupBy(F.col("disease_profile_id").alias("id")).agg(F.avg(t["onset_age_min"]).alias("age"), F.array_sort(F.collect_set(F.when(text.present(t["progression_stage"]), t["progression_stage"]))).alias("stages"))
    left, right = (each.select(*[F.col(c).alias(f"{c}_{x}") for c in each.columns]) for x in "ab")
    met = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
    by_age = F.when(F.col("age_a").isNotNull() & F.col("age_b").isNotNull(), F.struct(F.lit("onset").alias("kind"), F.format_string("%s has average onset age ~%.0f years, while %s has average onset age ~%.0f years.", "a", F.bround("age_a", 0), "b", F.bround("age_b", 0)).alias("answer")))
    by_stage = F.when((F.size("stages_a") > 0) & (F.size("stages_b") > 0), F.struct(F.lit("stages").alias("kind"), F.concat("a", F.lit(" stages: "), F.array_join("stages_a", ", "), F.lit(". "), "b", F.lit(" stages: "), F.array_join("stages_b", ", "), F.lit(".")).alias("answer")))
    return met.select("a", "b", F.explode(F.array_compact(F.array(by_age, by_stage))).alias("x")).select("a", "b", "x.kind", "x.answer", F.lit("temporal_diff_dx").alias("type"))
