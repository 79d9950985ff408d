"""Validation against gold age ranges: strategies, error classes, strata and ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import ages, scores

# Relations that state a phenotype's own timing.
PHENOTYPE_RELATIONS = ("disease_phenotype_positive", "disease_phenotype_negative", "manifests_as", "onset_at")
RECENT_IDENTIFIER = 33_000_000


def _hits(name: str, low: Column, high: Column) -> list[Column]:
    gold = F.col("ref_min"), F.col("ref_max")
    return [F.count_if(ages.overlaps(low, high, *gold)).alias(f"{name}_overlap"), F.count_if(ages.contained(low, high, *gold)).alias(f"{name}_contained")]


def per_disease(matched: DataFrame, key: str) -> DataFrame:
    """For each key of matched (key, onset_min, onset_max, ref_min, ref_max): the windows of the four strategies, without all-ages gold.

    Medians and quartiles out of order are exchanged; the quartiles are elements of the sorted values, medians where fewer than four.
    """
    kept = matched.filter(~ages.all_ages(F.col("ref_min"), F.col("ref_max")))
    grouped = kept.groupBy(key, "ref_min", "ref_max").agg(
        F.count("*").alias("n"),
        F.min("onset_min").alias("min_low"),
        F.max("onset_max").alias("max_high"),
        F.median("onset_min").alias("m1"),
        F.median("onset_max").alias("m2"),
        scores.index_quantile(F.col("onset_min"), 1).alias("q1"),
        scores.index_quantile(F.col("onset_max"), 3).alias("q3"),
        F.count_if(ages.overlaps(F.col("onset_min"), F.col("onset_max"), F.col("ref_min"), F.col("ref_max"))).alias("n_overlap"),
        F.count_if(ages.contained(F.col("onset_min"), F.col("onset_max"), F.col("ref_min"), F.col("ref_max"))).alias("n_contained"),
    )
    four = F.col("n") >= 4
    lows = grouped.withColumns({"med_low": F.least("m1", "m2"), "med_high": F.greatest("m1", "m2")})
    return lows.withColumns({"iqr_low": F.when(four, F.least("q1", "q3")).otherwise(F.col("med_low")), "iqr_high": F.when(four, F.greatest("q1", "q3")).otherwise(F.col("med_high"))}).drop("m1", "m2", "q1", "q3")


def strategies(matched: DataFrame, key: str) -> DataFrame:
    """One row: how often each strategy's window overlaps and lies in the gold one, and the mean widths."""
    d = per_disease(matched, key)
    return d.agg(
        F.count("*").alias("compared"),
        *_hits("minmax", F.col("min_low"), F.col("max_high")),
        *_hits("median", F.col("med_low"), F.col("med_high")),
        F.sum("n").alias("per_triple_total"),
        F.sum("n_overlap").alias("per_triple_overlap"),
        F.sum("n_contained").alias("per_triple_contained"),
        *_hits("iqr", F.col("iqr_low"), F.col("iqr_high")),
        F.avg(F.col("max_high") - F.col("min_low")).alias("minmax_width"),
        F.avg(F.col("med_high") - F.col("med_low")).alias("median_width"),
        F.avg(F.col("ref_max") - F.col("ref_min")).alias("gold_width"),
    )


def strict_class(low: Column, high: Column, ref_min: Column, ref_max: Column, n: Column, other_share: Column) -> Column:
    """The class of a window that doesn't lie within the gold one."""
    mid_gap = F.abs((low + high) / 2 - (ref_min + ref_max) / 2)
    overlap = ages.overlaps(low, high, ref_min, ref_max)
    return (
        F.when(n == 1, "SINGLE_TRIPLE_NOISE")
        .when(ages.contained(ref_min, ref_max, low, high) & overlap, "TA_WIDER_BUT_CORRECT")
        .when(overlap & (other_share > 0.4), "PHENOTYPE_VS_DISEASE")
        .when(overlap, "GRANULARITY_MISMATCH")
        .when(mid_gap <= 10, "ADJACENT_STAGE")
        .otherwise("GENUINELY_WRONG")
    )


def staged_class(low: Column, high: Column, ref_min: Column, ref_max: Column, n: Column, other_share: Column, recent: Column) -> Column:
    """The older classification: neighbouring stages instead of a gap, and gold that newer evidence contradicts."""
    stage = ages.stage_index((low + high) / 2)
    steps = F.least(F.abs(stage - ages.stage_index(ref_min)), F.abs(stage - ages.stage_index(ref_max)))
    overlap = ages.overlaps(low, high, ref_min, ref_max)
    return (
        F.when(n == 1, "SINGLE_TRIPLE_NOISE")
        .when(ages.contained(ref_min, ref_max, low, high) & overlap, "TA_WIDER_BUT_CORRECT")
        .when(overlap & (other_share > 0.4), "PHENOTYPE_VS_DISEASE")
        .when(overlap, "GRANULARITY_MISMATCH")
        .when(steps <= 1, "ADJACENT_STAGE")
        .when(recent, "GOLD_POSSIBLY_OUTDATED")
        .otherwise("GENUINELY_WRONG")
    )


def recent_evidence(source_ids: Column) -> Column:
    number = lambda s: F.replace(s, F.lit("PMID:"), F.lit("")).try_cast("long")
    return F.exists(source_ids, lambda s: F.coalesce(number(s) > RECENT_IDENTIFIER, F.lit(False)))


def taxonomy(matched: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """key -> category: CONTAINED, or the class of the error; matched also has relation (and source_ids, if not strict)."""
    kept = matched.filter(~ages.all_ages(F.col("ref_min"), F.col("ref_max")))
    other = F.avg((~F.lower("relation").isin(*PHENOTYPE_RELATIONS)).cast("double")).alias("other_share")
    recent = [] if strict else [F.max(recent_evidence(F.col("source_ids"))).alias("recent")]
    grouped = kept.groupBy(key, "ref_min", "ref_max").agg(F.count("*").alias("n"), F.median("onset_min").alias("a"), F.median("onset_max").alias("b"), other, *recent)
    d = grouped.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    args = [F.col(c) for c in ("low", "high", "ref_min", "ref_max", "n", "other_share")]
    error = strict_class(*args) if strict else staged_class(*args, F.col("recent"))
    return d.select(key, "n", "low", "high", "ref_min", "ref_max", F.when(ages.contained(*args[:4]), "CONTAINED").otherwise(error).alias("category"))


def taxonomy_summary(classified: DataFrame) -> DataFrame:
    """Counts and shares by category; effective adds the harmless classes to the contained."""
    n = classified.groupBy("category").count()
    total = F.sum("count").over(Window.partitionBy())
    effective = F.sum(F.when(F.col("category").isin("CONTAINED", "TA_WIDER_BUT_CORRECT", "GRANULARITY_MISMATCH"), F.col("count")).otherwise(0)).over(Window.partitionBy())
    return n.select("category", "count", scores.percentage(F.col("count"), total).alias("share"), scores.percentage(effective, total).alias("effective"))


def by_quartile(matched: DataFrame) -> DataFrame:
    """Overlap and containment by quartile of credibility, best first; cuts at floor(n/4), floor(n/2), floor(3n/4).

    Ranks come from a histogram of equal scores, not from one sorted partition: a score's rows share consecutive ranks, split by ord only where a cut falls.
    """
    scored = matched.filter("credibility IS NOT NULL AND NOT (ref_min = 0 AND ref_max >= 100)")
    sums = scored.groupBy("credibility").agg(F.count("*").alias("k"))
    ahead = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("credibility")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sums.withColumns({"ahead": ahead, "total": F.sum("k").over(Window.partitionBy())})
    own = F.row_number().over(Window.partitionBy("credibility").orderBy("ord")) - 1
    ranked = scored.withColumn("own", own).join(places, "credibility").withColumn("at", F.col("ahead") + F.col("own"))
    cut = lambda i: F.floor(F.col("total") * i / 4)
    quartile = F.when(F.col("at") < cut(1), "Q1").when(F.col("at") < cut(2), "Q2").when(F.col("at") < cut(3), "Q3").otherwise("Q4")
    return _precision(ranked.withColumn("quartile", quartile), "quartile").select("quartile", "n", "overlap", "contained", "credibility")


def _precision(rows: DataFrame, *by: str) -> DataFrame:
    window = [F.col(c) for c in ("onset_min", "onset_max", "ref_min", "ref_max")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ages.overlaps(*window)).alias("overlap"), F.count_if(ages.contained(*window)).alias("contained"), F.avg("credibility").alias("credibility"))


def by_relation(matched: DataFrame) -> DataFrame:
    return _precision(matched, "relation").select("relation", "n", "overlap", "contained")


def ablation(matched: DataFrame, thresholds: tuple = (1, 2, 3)) -> DataFrame:
    """Triples, diseases, overlap and containment that are left for each least number of models."""
    levels = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("n_models")))
    window = [F.col(c) for c in ("onset_min", "onset_max", "ref_min", "ref_max")]
    return matched.withColumn("threshold", levels).groupBy("threshold").agg(F.count("*").alias("n_triples"), F.count_distinct("disease_id").alias("n_diseases"), F.count_if(ages.overlaps(*window)).alias("overlap"), F.count_if(ages.contained(*window)).alias("contained"))


def first_hit(own: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """For each of own (key, ord, low, high): overlap with the reference windows of its key in order, ended by the first overlap
    or the first own window that begins after the reference one (ambiguous); otherwise none."""
    both = own.join(reference.select(key, F.col("ord").alias("ref_ord"), "ref_min", "ref_max"), key)
    verdict = F.when(ages.overlaps(F.col("low"), F.col("high"), F.col("ref_min"), F.col("ref_max")), "overlap").when(F.col("low") > F.col("ref_max"), "ambiguous")
    ends = both.withColumn("verdict", verdict).filter("verdict IS NOT NULL").groupBy(key, "ord").agg(F.min_by("verdict", "ref_ord").alias("verdict"))
    return own.join(ends, [key, "ord"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))


def claims_checked(claims: DataFrame, computed: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Claimed against computed figures (name, value): within `tolerance` per cent or not; missing where not computed."""
    joined = claims.select("name", F.col("value").alias("claimed")).join(computed.select("name", F.col("value").alias("computed")), "name", "left")
    off = 100 * F.abs(F.col("claimed") - F.col("computed")) / F.greatest(F.abs("claimed"), F.lit(1e-12))
    return joined.withColumn("status", F.when(F.col("computed").isNull(), "missing").when(off <= tolerance, "match").otherwise("mismatch"))
