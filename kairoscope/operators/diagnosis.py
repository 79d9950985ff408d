"""Diagnosis simulation: distractors, phenotype scores with and without time, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import ages, text
from kairoscope.operators.matching import containing

# The ages at which patients are simulated.
AGE_POINTS = (0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 25.0, 40.0, 60.0)


def shared_phenotypes(phenotypes: DataFrame) -> DataFrame:
    """(a, b, shared) for pairs of diseases with an equal phenotype; phenotypes is (disease, phenotype)."""
    p = phenotypes.select("disease", F.lower("phenotype").alias("phenotype")).distinct()
    a, b = p.select(F.col("disease").alias("a"), "phenotype"), p.select(F.col("disease").alias("b"), "phenotype")
    return a.join(b, "phenotype").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def distractors(phenotypes: DataFrame, targets: DataFrame, least: int = 1, most: int = 4) -> DataFrame:
    """target -> the `most` diseases that share most phenotypes (`least` or more), fewest phenotypes first among equals, then by name."""
    n = phenotypes.groupBy("disease").agg(F.count_distinct(F.lower("phenotype")).alias("total"))
    pairs = shared_phenotypes(phenotypes).join(targets.select(F.col("disease").alias("a")).distinct(), "a", "left_semi").filter(F.col("shared") >= least).join(n.withColumnRenamed("disease", "b"), "b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "total", "b"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("a").alias("target"), F.col("b").alias("candidate"), "shared", "rank")


def candidates(phenotypes: DataFrame, targets: DataFrame, least: int = 1, most: int = 4) -> DataFrame:
    """(target, candidate): each target, itself and its distractors."""
    own = targets.select(F.col("disease").alias("target"), F.col("disease").alias("candidate")).distinct()
    return own.unionByName(distractors(phenotypes, targets, least, most).select("target", "candidate"))


def presented(onsets: DataFrame, points: tuple = AGE_POINTS) -> DataFrame:
    """(target, age, phenotype): what has begun by each age; onsets is (disease, phenotype, onset_min, onset_max)."""
    age = F.explode(F.array(*map(F.lit, points)))
    return onsets.select(F.col("disease").alias("target"), "phenotype", "onset_min", age.alias("age")).filter("onset_min <= age").select("target", "age", "phenotype").distinct()


def scored(shown: DataFrame, rivals: DataFrame, windows: DataFrame, shared_word: float = 0.5, steps: tuple = ((0.0, 1.0), (3.0, 0.5), (8.0, 0.25))) -> DataFrame:
    """(target, age, candidate, static, temporal): mean over presented phenotypes of the best name match, and of the best name match times fit."""
    cases = shown.join(rivals, "target")
    known = windows.select(F.col("disease").alias("candidate"), F.lower("phenotype").alias("known"), "onset_min", "onset_max")
    met = cases.join(known, "candidate", "left")
    name = F.coalesce(text.phenotype_match(F.lower("phenotype"), F.col("known"), shared_word), F.lit(0.0))
    fit = F.coalesce(ages.fit(F.col("onset_min"), F.col("onset_max"), F.col("age"), steps), F.lit(0.0))
    best = met.groupBy("target", "age", "candidate", "phenotype").agg(F.max(name).alias("s"), F.max(name * fit).alias("t"))
    return best.groupBy("target", "age", "candidate").agg(F.avg("s").alias("static"), F.avg("t").alias("temporal"))


def ranked(scores: DataFrame, score: str) -> DataFrame:
    """(target, age, rank) of the right disease by a score; ties in an order of the pair's hash, so that they favour none."""
    order = Window.partitionBy("target", "age").orderBy(F.desc(F.round(score, 12)), F.xxhash64("target", "candidate"))
    return scores.withColumn("rank", F.row_number().over(order)).filter("candidate = target").select("target", "age", "rank")


def accuracy(scores: DataFrame) -> DataFrame:
    """Top-1 accuracy and mean reciprocal rank of both scores."""
    out = None
    for name in ("static", "temporal"):
        row = ranked(scores, name).agg(F.count("*").alias("cases"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.avg(1 / F.col("rank")).alias("mrr")).withColumn("condition", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def simulate(onsets: DataFrame, windows: DataFrame, points: tuple = AGE_POINTS, least: int = 1, most: int = 4) -> DataFrame:
    """The whole simulation: presented phenotypes at each age, candidates, scores."""
    phenotypes = windows.select("disease", "phenotype")
    targets = onsets.select("disease").distinct()
    return scored(presented(onsets, points), candidates(phenotypes, targets, least, most), windows)


def overlap_diseases(*sets: DataFrame, key: str = "name") -> DataFrame:
    """Names that all sets have: equal in lower case, else the first (by name) that holds or is held by it."""
    out = sets[0].select(F.lower(key).alias("name")).distinct()
    for i, other in enumerate(sets[1:]):
        stock = other.select(F.lower(key).alias("name_key")).distinct().withColumns({"node_id": F.col("name_key"), "node_type": F.lit(""), "node_name": F.col("name_key")})
        exact = out.join(stock.select(F.col("name_key").alias("name")), "name", "left_semi").select("name", F.col("name").alias(f"match{i}"))
        rest = out.join(exact.select("name"), "name", "left_anti").select(F.col("name").alias("mention"))
        near = containing(rest, stock, 1).select(F.col("mention").alias("name"), F.col("name_key").alias(f"match{i}"))
        out = out.join(exact.unionByName(near), "name")
    return out


def word_overlap(a: Column, b: Column, share: float = 0.6) -> Column:
    """Names of two words or more that share at least two, and `share` of the first one's."""
    wa, wb = text.tokens(a), text.tokens(b)
    n = F.size(F.array_intersect(wa, wb))
    return (F.size(wa) >= 2) & (n >= F.greatest(F.lit(2.0), share * F.size(wa)))
