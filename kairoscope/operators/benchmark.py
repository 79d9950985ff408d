"""Question generation, cleaning and scoring. Choices that a generator would draw at random come from hashes of a seed and
the row, so that reruns and repartitioning give the same questions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairoscope.functions import ages, parse, text
from kairoscope.operators.ranks import numbered

LETTERS = ("A", "B", "C", "D")
# Words that make an answer temporal, and milestones that precede others.
TEMPORAL_WORDS = ("age", "year", "month", "day", "onset", "stage", "phase", "early", "late", "before", "after", "during", "infan", "child", "adult", "birth", "neonat", "decade")
PRECEDES = {"onset": ("diagnosis", "death"), "diagnosis": ("death",), "loss of ambulation": ("death",), "walking": ("loss of ambulation",)}
NOISE_MILESTONES = ("follow-up", "publication", "study", "unknown")
YES = ("yes", "is within", "falls within", "consistent with", "within the typical", "within the onset", "within this range", "is typical")
NO = ("no", "is not within", "outside", "not within", "not typical", "does not fall", "is outside", "unlikely", "not consistent", "no specific information", "no data")


def unit(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) by hash."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def _shuffled(options: Column, seed: int, key: Column) -> Column:
    return F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.xxhash64(F.lit(seed), key, o["name"]).alias("h"), o.alias("o")))), lambda x: x["o"])


def differential(gold: DataFrame, seed: int = 42, least_in_bin: int = 10, tries: int = 5) -> DataFrame:
    """One question for each disease (disease_id, name, min_age, max_age): which of four fits an age, one from its own onset
    bin and three from others. The age lies in its own window and in no distractor's; a disease without such an age has none.
    """
    bin_ = ages.onset_bin(F.col("min_age"), F.col("max_age"))
    d = gold.filter("NOT (min_age = 0 AND max_age = 120)").withColumn("bin", bin_).filter("bin <> 'broad_range'")
    sized = d.withColumn("n", F.count("*").over(Window.partitionBy("bin"))).filter(F.col("n") >= least_in_bin)
    numbered = sized.withColumn("at", F.row_number().over(Window.partitionBy("bin").orderBy(F.xxhash64(F.lit(seed), "disease_id"), "disease_id")) - 1)
    names = numbered.select("bin").distinct().agg(F.array_sort(F.collect_list("bin")).alias("bins"))
    age = F.col("min_age") + unit(seed, F.col("disease_id"), F.col("try")) * (F.col("max_age") - F.col("min_age"))
    asked = numbered.crossJoin(F.broadcast(names)).filter(F.size("bins") >= 4).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("test_age", F.round(age, 4))
    others = F.transform(F.slice(F.array_sort(F.transform(F.array_except("bins", F.array("bin")), lambda b: F.struct(F.xxhash64(F.lit(seed), "disease_id", "try", b).alias("h"), b.alias("b")))), 1, 3), lambda x: x["b"])
    drawn = asked.withColumn("other", F.explode(others))
    other = numbered.select(F.col("bin").alias("other"), F.col("at").alias("pick"), F.col("n").alias("size"), F.struct(F.col("disease_id").alias("id"), "name", "min_age", "max_age").alias("distractor"))
    sizes = numbered.groupBy(F.col("bin").alias("other")).agg(F.max("n").alias("size"))
    picked = drawn.join(sizes, "other").withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "disease_id", "try", "other"), F.col("size")).cast("int")).join(other.drop("size"), ["other", "pick"])
    fits = ages.admits(F.col("distractor.min_age"), F.col("distractor.max_age"), F.col("test_age"))
    whole = picked.groupBy("disease_id", "name", "min_age", "max_age", "bin", "try", "test_age").agg(F.array_sort(F.collect_list("distractor")).alias("distractors"), F.max(fits).alias("ambiguous")).filter((F.size("distractors") == 3) & ~F.col("ambiguous"))
    first = whole.withColumn("r", F.row_number().over(Window.partitionBy("disease_id").orderBy("try"))).filter("r = 1")
    options = _shuffled(F.concat(F.array(F.struct(F.col("disease_id").alias("id"), "name", "min_age", "max_age")), F.col("distractors")), seed, F.col("disease_id"))
    placed = first.withColumn("options", options).withColumn("answer", F.element_at(F.array(*map(F.lit, LETTERS)), F.array_position(F.transform("options", lambda o: o["id"]), F.col("disease_id")).cast("int")))
    said = ages.readable(F.col("test_age"))
    when = F.concat(F.when(F.startswith(said, F.lit("the ")), "during ").otherwise("at age "), said)
    listed = F.array_join(F.transform("options", lambda o, i: F.concat(F.element_at(F.array(*map(F.lit, LETTERS)), i + 1), F.lit(") "), o["name"])), "\n")
    question = F.concat(F.lit("Symptoms begin "), when, F.lit(". Which disease's usual onset fits best?\n"), listed)
    return placed.select("disease_id", F.col("name").alias("disease_name"), F.lit("temporal_differential_dx").alias("type"), question.alias("question"), "answer", "test_age", F.transform("options", lambda o: o["name"]).alias("options"), "distractors", F.lit("hard").alias("difficulty"))


def window_questions(gold: DataFrame, seed: int = 42, widest: float = 80.0) -> DataFrame:
    """Whether an age lies in a disease's window: half by hash within, half a year below or five above it."""
    d = gold.filter((F.col("max_age") - F.col("min_age") <= widest) & ~((F.col("min_age") == 0) & (F.col("max_age") == 120)))
    coin, side, u = (unit(seed + i, F.col("disease_id")) for i in range(3))
    low, high = F.col("min_age"), F.col("max_age")
    above = high + 5 + u * F.greatest(F.lit(0.0), F.least(F.lit(100.0), high + 30) - (high + 5))
    age = F.when(coin < 0.5, low + u * (high - low)).when((low > 2) & (side < 0.5), u * (low - 1)).otherwise(above)
    out = d.withColumns({"test_age": F.round(age, 4), "answer": F.when(coin < 0.5, "Yes").otherwise("No")})
    question = F.concat(F.lit("Is age "), ages.readable(F.col("test_age")), F.lit(" within the usual onset window of "), F.col("name"), F.lit("?"))
    return out.select("disease_id", F.col("name").alias("disease_name"), F.lit("temporal_window").alias("type"), question.alias("question"), "answer", "test_age", "min_age", "max_age", F.lit("medium").alias("difficulty"))


def cross_disease(gold: DataFrame, seed: int = 42, least_gap: float = 5.0) -> DataFrame:
    """Which of two diseases begins earlier; each disease meets the next by hash whose midpoint is `least_gap` away."""
    mid = (F.col("min_age") + F.col("max_age")) / 2
    d = gold.filter(F.col("max_age") - F.col("min_age") <= 60).withColumns({"mid": mid, "bucket": F.pmod(F.xxhash64(F.lit(seed), "disease_id"), F.lit(64))})
    by = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), "disease_id"), "disease_id")
    met = d.withColumns({"other": F.lead("name").over(by), "other_mid": F.lead("mid").over(by)}).filter(F.abs(F.col("mid") - F.col("other_mid")) >= least_gap)
    question = F.concat(F.lit("Which usually begins earlier, "), F.col("name"), F.lit(" or "), F.col("other"), F.lit("?"))
    return met.select("disease_id", F.col("name").alias("disease_name"), F.lit("cross_disease_comparison").alias("type"), question.alias("question"), F.when(F.col("mid") < F.col("other_mid"), F.col("name")).otherwise(F.col("other")).alias("answer"), F.lit("medium").alias("difficulty"))


def milestones(edges: DataFrame, least_points: int = 2, least_gap: float = 2.0) -> DataFrame:
    """disease_id -> its milestones (name, age) in order of mean age, each more than `least_gap` years after the last kept.

    Spellings that differ in hyphens and filler words are one milestone, named by the shortest.
    """
    key = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower("milestone"), F.lit("-"), F.lit(" ")), "  ", " "), " (presentation|form)", ""))
    kept = edges.filter(text.present(F.col("milestone")) & F.col("age").isNotNull()).withColumn("key", key)
    mean = kept.groupBy("disease_id", "key").agg(F.min(F.struct(F.length("milestone").alias("l"), F.col("milestone").alias("name"))).alias("x"), F.avg("age").alias("age"), F.count("*").alias("n")).filter((F.col("n") >= least_points) & ~F.lower("x.name").rlike("|".join(NOISE_MILESTONES)))
    ordered = mean.groupBy("disease_id").agg(F.array_sort(F.collect_list(F.struct("age", F.col("x.name").alias("name")))).alias("all"))
    none = F.array().cast("array<struct<age: double, name: string>>")
    keep = F.aggregate("all", none, lambda out, m: F.when((F.size(out) == 0) | (m["age"] - F.try_element_at(out, F.lit(-1))["age"] > least_gap), F.array_append(out, m)).otherwise(out))
    return ordered.withColumn("kept", keep).drop("all")


def coherent(kept: Column) -> Column:
    """Whether an order of milestones makes sense: none that must follow another lies over half a year before it, and
    presentations at birth aren't mixed with those of adults."""
    ok = F.lit(True)
    age_of = lambda name: F.get(F.filter(kept, lambda m: F.lower(m["name"]) == name), F.lit(0))["age"]
    for early, later in PRECEDES.items():
        for late in later:
            ok &= F.coalesce(age_of(late) >= age_of(early) - 0.5, F.lit(True))
    others = F.array_sort(F.transform(F.filter(kept, lambda m: m["age"] > 0.1), lambda m: m["age"]))
    at_birth = F.exists(kept, lambda m: (m["age"] <= 0.1) & F.lower(m["name"]).rlike("birth|neonatal|congenital"))
    span = F.array_max(F.transform(kept, lambda m: m["age"])) - F.array_min(F.transform(kept, lambda m: m["age"]))
    mixed = at_birth & (F.size(others) > 0) & (F.coalesce(F.get(others, F.floor(F.size(others) / 2).cast("int")) > 15, F.lit(False)) | (span > 30))
    return ok & ~mixed


def ordering(edges: DataFrame) -> DataFrame:
    """Questions for the order of three milestones or more."""
    found = milestones(edges).filter((F.size("kept") >= 3) & coherent(F.col("kept")))
    return found.select("disease_id", F.lit("phenotype_ordering").alias("type"), F.array_join(F.array_sort(F.transform("kept", lambda m: m["name"])), ", ").alias("question"), F.array_join(F.transform("kept", lambda m: m["name"]), " → ").alias("answer"), "kept", F.lit("hard").alias("difficulty"))


def stage_questions(edges: DataFrame, least: int = 2) -> DataFrame:
    """What belongs to a disease's stage: its distinct phenotypes, where there are `least`."""
    g = edges.filter(text.present(F.col("stage"))).groupBy("disease_id", F.lower("stage").alias("stage")).agg(F.array_sort(F.collect_set("phenotype")).alias("phenotypes")).filter(F.size("phenotypes") >= least)
    return g.select("disease_id", F.lit("stage_phenotype").alias("type"), F.concat(F.lit("Which phenotypes belong to the "), "stage", F.lit(" stage?")).alias("question"), F.array_join("phenotypes", ", ").alias("answer"), F.lit("medium").alias("difficulty"))


def negative(gold: DataFrame, edges: DataFrame, seed: int = 42) -> DataFrame:
    """Which of a disease's phenotypes doesn't usually begin by an age: the one with the latest window, if only it begins later."""
    p = edges.groupBy("disease_id", "phenotype").agg(F.min("onset_min").alias("low"))
    late = p.groupBy("disease_id").agg(F.array_sort(F.collect_list(F.struct("low", "phenotype"))).alias("all")).filter(F.size("all") >= 4)
    last, before = F.element_at("all", -1), F.element_at("all", -2)
    options = F.slice("all", -4, 4)
    return late.filter(last["low"] > before["low"]).join(gold.select("disease_id", "name"), "disease_id").select("disease_id", F.col("name").alias("disease_name"), F.lit("negative_temporal").alias("type"), F.round((last["low"] + before["low"]) / 2, 4).alias("test_age"), F.transform(options, lambda o: o["phenotype"]).alias("options"), last["phenotype"].alias("answer"), F.lit("hard").alias("difficulty"))


def evolution(edges: DataFrame) -> DataFrame:
    """How evidence for a triple evolved: first and last year of two dated edges or more."""
    d = edges.filter("discovery_date IS NOT NULL").groupBy("disease_id", F.lower("source_name").alias("s"), "relation", F.lower("target_name").alias("t")).agg(F.count("*").alias("n"), F.min("discovery_date").alias("a"), F.max("discovery_date").alias("b")).filter("n >= 2")
    answer = F.format_string("From %d to %d in %d sources, %d years.", F.year("a"), F.year("b"), F.col("n"), F.year("b") - F.year("a"))
    return d.select("disease_id", F.lit("evidence_evolution").alias("type"), F.concat_ws(" ", "s", "relation", "t").alias("question"), answer.alias("answer"), F.lit("medium").alias("difficulty"))


def timeline(edges: DataFrame, most: int = 5, least: int = 3) -> DataFrame:
    """A disease's first treatments by date, where `least` are dated."""
    dated = edges.filter(F.col("relation").isin("treats", "indication") & F.col("discovery_date").isNotNull())
    by = Window.partitionBy("disease_id").orderBy("discovery_date", "ord")
    n = F.count("*").over(Window.partitionBy("disease_id"))
    first = dated.withColumns({"r": F.row_number().over(by), "n": n}).filter((F.col("n") >= least) & (F.col("r") <= most))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("source_name", F.lit(" ("), F.year("discovery_date").cast("string"), F.lit(")")).alias("x")))), lambda x: x["x"])
    return first.groupBy("disease_id").agg(F.array_join(parts, ", ").alias("answer")).withColumns({"type": F.lit("treatment_timeline"), "difficulty": F.lit("medium")})


def fact_questions(edges: DataFrame) -> DataFrame:
    """When a phenotype begins."""
    age = F.format_string("Between age %s and %s.", F.col("onset_min").cast("string"), F.col("onset_max").cast("string"))
    return edges.filter("onset_min IS NOT NULL").select("disease_id", F.lit("onset_age").alias("type"), F.concat(F.lit("When does "), F.col("phenotype"), F.lit(" begin?")).alias("question"), age.alias("answer"), (F.col("onset_max") - F.col("onset_min")).alias("span"), F.lit("easy").alias("difficulty"))


def age_queries(edges: DataFrame, points: tuple = (1.0, 10.0, 40.0)) -> DataFrame:
    """What is expected by an age: the phenotypes whose window holds it."""
    g = edges.filter("onset_min IS NOT NULL").withColumn("age", F.explode(F.array(*map(F.lit, points)))).filter(F.col("age").between(F.col("onset_min"), F.col("onset_max")))
    return g.groupBy("disease_id", "age").agg(F.array_join(F.array_sort(F.collect_set("phenotype")), ", ").alias("answer")).withColumns({"type": F.lit("age_conditional"), "difficulty": F.lit("medium")})


def temporal_content(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(TEMPORAL_WORDS))


def same_ages(answer: Column) -> Column:
    p = r"[Bb]etween age ([\d.]+) and ([\d.]+?)\.?\s*$"
    a, b = F.regexp_extract(answer, p, 1), F.regexp_extract(answer, p, 2)
    return (a != "") & F.coalesce(a.try_cast("double") == b.try_cast("double"), a == b)


def tautological(question: Column, answer: Column) -> Column:
    low = F.trim(F.lower(answer))
    stage = F.regexp_extract(low, r"(?:during|in|at) the (\w+) (?:stage|phase|period)", 1)
    return (F.length(low) < 40) | ((F.length(low) < 50) & F.contains(low, F.lit("stage")) & (stage != "") & F.contains(F.lower(question), stage))


def difficulty(kind: Column, answer: Column, n_triples: Column, given: Column) -> Column:
    p = r"[Bb]etween age ([\d.]+) and ([\d.]+)"
    span = F.regexp_extract(answer, p, 2).try_cast("double") - F.regexp_extract(answer, p, 1).try_cast("double")
    return (
        F.when(F.coalesce(n_triples, F.lit(0)) < 5, "hard")
        .when((kind == "onset_age") & (span > 30), "hard")
        .when((kind == "onset_age") & (span > 10), "medium")
        .when((kind == "onset_age") & span.isNotNull(), "easy")
        .when(kind == "treatment_timeline", "medium")
        .when(kind == "milestone_timing", "easy")
        .when(kind == "stage_phenotype", "medium")
        .otherwise(F.coalesce(given, F.lit("easy")))
    )


def removal(question: Column, answer: Column, kind: Column) -> Column:
    """The first filter that removes a question; null if it stays."""
    return F.when(~temporal_content(answer), "no_temporal_content").when((kind == "onset_age") & same_ages(answer), "same_min_max").when((kind == "stage_phenotype") & tautological(question, answer), "tautological")


def cleaned(questions: DataFrame, counts: DataFrame) -> DataFrame:
    """Questions (ord, disease_id, type, entity, question, answer, confidence) that pass the filters, one for each (disease,
    type, entity): the most confident, then the first; with their difficulty and a new number in order."""
    kept = questions.filter(removal(F.col("question"), F.col("answer"), F.col("type")).isNull())
    best = Window.partitionBy("disease_id", "type", "entity").orderBy(F.desc("confidence"), "ord")
    one = kept.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r").join(counts, "disease_id", "left")
    hard = difficulty(F.col("type"), F.col("answer"), F.col("n_triples"), F.col("difficulty"))
    return numbered(one.withColumn("difficulty", hard), "number", "ord").withColumn("question_id", F.format_string("TQA-%05d", F.col("number"))).drop("number")


def statistics(questions: DataFrame) -> DataFrame:
    return questions.groupBy("type", "difficulty").agg(F.count("*").alias("n"), F.count_distinct("disease_id").alias("diseases"))


# Scorers: struct(correct, how) of an answer.


def _verdict(correct: Column, how: Column) -> Column:
    return F.struct(correct.alias("correct"), how.alias("how"))


def score_choice(answer: Column, letter: Column, options: Column) -> Column:
    """By the letter the answer starts with, else by the option's text in it; options is a map."""
    low, right = F.lower(F.trim(answer)), F.lower(F.try_element_at(options, letter))
    wrong = F.get(F.filter(F.array_sort(F.map_entries(options)), lambda o: (o["key"] != letter) & F.contains(low, F.lower(o["value"]))), F.lit(0))
    by_letter, by_text = F.startswith(low, F.lower(letter)), F.coalesce((right != "") & F.contains(low, right), F.lit(False))
    how = F.when(by_letter, "direct_letter_match").when(by_text, "option_text_match").when(wrong.isNotNull(), F.concat(F.lit("chose_wrong_option_"), wrong["key"])).otherwise("no_clear_answer")
    return _verdict(by_letter | by_text, how)


def score_choice_strict(answer: Column, letter: Column) -> Column:
    """Only by a letter that the answer states on its own."""
    said = parse.letter(answer, "A-D")
    return _verdict(F.coalesce(said == letter, F.lit(False)), F.when(said.isNull(), "no_letter").when(said == letter, "letter_match").otherwise("wrong_letter"))


def score_window(answer: Column, correct: Column) -> Column:
    low = F.lower(F.trim(answer))
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    start = F.left(low, F.lit(100))
    yes = any_of(low, YES) & ~any_of(start, ("no,", "no.", "no ", "not within", "outside"))
    no = any_of(low, NO) & ~any_of(start, ("yes,", "yes.", "yes "))
    hit = F.when(F.lower(correct) == "yes", yes).when(F.lower(correct) == "no", no).otherwise(False)
    return _verdict(hit, F.when(hit, F.concat(F.lit("correct_"), F.lower(correct))).otherwise("incorrect_or_unclear"))


def score_disease(answer: Column, correct: Column) -> Column:
    hit = F.contains(F.lower(answer), F.lower(correct))
    return _verdict(hit, F.when(hit, "correct_disease_mentioned").otherwise("correct_disease_not_found"))


def score_onset(answer: Column, low: Column, high: Column, slack: float = 2.0) -> Column:
    """By the ages an answer states, else by the stage it names."""
    stated, named = parse.age_range(answer), parse.age_phrase(answer)
    by_age = F.coalesce(ages.overlaps(stated["min"], stated["max"], low - slack, high + slack), F.lit(False))
    by_stage = stated.isNull() & F.coalesce(ages.overlaps(named["min"], named["max"], low - 5, high + 5), F.lit(False))
    return _verdict(by_age | by_stage, F.when(by_age, "age_overlap").when(by_stage, "category_match").otherwise("no_match"))


def in_order(answer: str | None, names: list[str]) -> bool:
    """Whether at least two of the names, by themselves or by a long word, first come up in this order."""
    low, seen = re.sub(r"\*+", "", (answer or "").lower()), []
    for name in names:
        at = low.find(name.lower())
        if at < 0:
            at = next((p for w in name.lower().split() if len(w) > 4 and (p := low.find(w)) >= 0), -1)
        if at >= 0:
            seen.append(at)
    return len(seen) >= 2 and seen == sorted(seen)


@F.pandas_udf(T.BooleanType())
def ordered_as(answer: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([in_order(a, list(n) if n is not None else []) for a, n in zip(answer, names, strict=True)])


def score_stage(answer: Column, phenotypes: Column, share: float = 0.3) -> Column:
    """By how many of the phenotypes the answer names."""
    low = F.lower(answer)
    found = F.size(F.filter(phenotypes, lambda p: F.contains(low, F.lower(p)))) / F.greatest(F.size(phenotypes), F.lit(1))
    return _verdict(found >= share, F.format_string("named_%.2f", found))


def score(kind: Column, answer: Column, gold: Column) -> Column:
    """The scorer of a question's type; gold is a struct of what each needs."""
    by_order = F.when(F.size(gold["order"]) > 0, ordered_as(answer, gold["order"])).otherwise(False)
    return (
        F.when(kind.isin("temporal_differential_dx", "negative_temporal", "static_control"), score_choice(answer, gold["letter"], gold["options"]))
        .when(kind == "temporal_window", score_window(answer, gold["text"]))
        .when(kind == "cross_disease_comparison", score_disease(answer, gold["text"]))
        .when(kind.isin("onset_age", "phenopacket_onset"), score_onset(answer, gold["min"], gold["max"]))
        .when(kind == "phenotype_ordering", _verdict(by_order, F.when(by_order, "order_match").otherwise("order_not_matched")))
        .when(kind == "stage_phenotype", score_stage(answer, gold["phenotypes"]))
    )


def list_f1(predicted: Column, groups: Column) -> Column:
    """F1 of predicted items against groups of synonyms: a group is found if any of its spellings is predicted."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", ""))
    said = F.transform(predicted, plain)
    hits = F.size(F.filter(groups, lambda g: F.arrays_overlap(F.transform(g, plain), said)))
    recall, precision = F.try_divide(hits, F.size(groups)), F.try_divide(hits, F.size(predicted))
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def factoid(predicted: Column, groups: Column, most: int = 5) -> Column:
    """Whether one of the first `most` items is any group's spelling."""
    return list_f1(F.slice(predicted, 1, most), groups) > 0


def accuracies(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def intent(source: Column, said: Column) -> Column:
    """A question's type: by its benchmark, else as a pluggable classifier said."""
    return F.when(source == "medqa", "mcq").when(source == "pubmedqa", "yes_no_maybe").otherwise(F.coalesce(said, F.lit("summary")))


def remaining(questions: DataFrame, models: DataFrame, conditions: DataFrame, done: DataFrame) -> DataFrame:
    """(question_id, model, condition) that are still to run; models and conditions are a few rows each."""
    grid = questions.select("question_id").join(F.broadcast(models.join(F.broadcast(conditions))))
    return grid.join(done, ["question_id", "model", "condition"], "left_anti")
