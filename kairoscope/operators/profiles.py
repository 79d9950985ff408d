"""Per-disease features, coverage, evidence ages, clustering and audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.functions import ages, text
from kairoscope.storage import stored

# Buckets of how many phenotypes have an onset, and of evidence years.
#: Equal rows up to which a bootstrap draws for each of them.
EXACT_DRAWS = 32
GRANULARITY = ((1, "1_phenotype"), (5, "2-5_phenotypes"), (10, "6-10_phenotypes"), (20, "11-20_phenotypes"), (None, "20+_phenotypes"))
BRACKETS = ((2021, "0-5 years"), (2016, "5-10 years"), (2011, "10-15 years"), (2006, "15-20 years"), (None, "20+ years"))


def onset_features(edges: DataFrame, key: str) -> DataFrame:
    """Count, median, mean, least, most, spread and interquartile range of onset midpoints, and distinct stages and milestones.

    The range is interpolated, and the spread where there are fewer than four ages.
    """
    mid = (F.col("onset_min") + F.col("onset_max")) / 2
    d = edges.filter("onset_min IS NOT NULL").withColumn("mid", mid)
    g = d.groupBy(key).agg(
        F.count("mid").alias("n_onset"), F.median("mid").alias("median_onset"), F.avg("mid").alias("mean_onset"), F.min("mid").alias("min_onset"), F.max("mid").alias("max_onset"),
        (F.percentile("mid", 0.75) - F.percentile("mid", 0.25)).alias("range4"), F.count_distinct(F.when(text.present(F.col("stage")), F.lower("stage"))).alias("n_stages"),
        F.count_distinct(F.when(text.present(F.col("milestone")), F.lower("milestone"))).alias("n_milestones"),
    )
    spread = F.col("max_onset") - F.col("min_onset")
    return g.withColumn("spread", spread).withColumn("iqr", F.when(F.col("n_onset") >= 4, F.col("range4")).otherwise(spread)).drop("range4")


def granularity(edges: DataFrame, key: str, phenotype: str) -> DataFrame:
    """Diseases by how many distinct phenotypes have an onset."""
    n = edges.groupBy(key).agg(F.count_distinct(phenotype).alias("n"))
    out = None
    for most, name in GRANULARITY[:-1]:
        out = F.when(F.col("n") <= most, name) if out is None else out.when(F.col("n") <= most, name)
    return n.groupBy(out.otherwise(GRANULARITY[-1][1]).alias("bucket")).agg(F.count("*").alias("diseases"), F.median("n").alias("median_n"))


def evidence_years(edges: DataFrame, years: DataFrame) -> DataFrame:
    """Edges with the year of the first of their sources, in order, that has one."""
    listed = edges.select("ord", F.posexplode("source_ids").alias("pos", "pmid"))
    first = listed.join(years, "pmid").groupBy("ord").agg(F.min_by("year", "pos").alias("year"))
    return edges.join(first, "ord", "left")


def year_index(docs: DataFrame) -> DataFrame:
    """pmid -> year of the last dated document (by ord)."""
    dated = docs.withColumn("year", ages.year_of(F.col("publication_date"))).filter("year IS NOT NULL")
    return dated.groupBy(F.regexp_replace("source_id", "^PMID:", "").alias("pmid")).agg(F.max_by("year", "ord").alias("year"))


def staleness(edges: DataFrame) -> DataFrame:
    """One row: how many edges are dated, their median and mean year, brackets, and medians and recent shares of grades A and B."""
    dated = edges.filter("year IS NOT NULL")
    year = F.col("year")
    brackets, above = [], None
    for least, name in BRACKETS:
        own = F.lit(True) if least is None else year >= least
        if above is not None:
            own = own & (year < above)
        brackets.append(F.count_if(own).alias(name))
        above = least
    grades = [x for g in "AB" for x in (F.median(F.when(F.col("quality_grade") == g, year)).alias(f"median_{g}"), F.avg(F.when(F.col("quality_grade") == g, (year >= 2020).cast("double"))).alias(f"recent_{g}"))]
    return dated.agg(F.count("*").alias("n"), F.median(year).alias("median_year"), F.bround(F.avg(year), 1).alias("mean_year"), *brackets, *grades)


def long_lived(edges: DataFrame, *by: str, least_span: int = 10, most: int = 50) -> DataFrame:
    """Keys whose evidence spans `least_span` years or more, longest first."""
    g = edges.filter("year IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.withColumn("span", F.col("last_year") - F.col("first_year")).filter((F.col("n") >= 2) & (F.col("span") >= least_span)).orderBy(F.desc("span"), *by).limit(most)


def audit(edges: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Counts by each value of each dimension, in one pass: (dimension, value, n)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("missing")).alias("value")) for d in dimensions])
    return edges.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def novel(own: DataFrame, *others: DataFrame, key: str = "disease_id") -> DataFrame:
    """Keys that no other set has."""
    out = own.select(key).distinct()
    for other in others:
        out = out.join(other.select(key).distinct(), key, "left_anti")
    return out


def literature_tier(n_articles: Column) -> Column:
    return F.when(n_articles >= 100, "well_studied").when(n_articles >= 20, "moderate").otherwise("sparse")


def coverage_flag(tier1: Column, tier2: Column, rich: int = 200, some: int = 50) -> Column:
    return F.when((tier1 >= 2) & (tier2 >= rich), "rich").when((tier1 >= 1) | (tier2 >= some), "moderate").otherwise("sparse")


def stratified(rows: DataFrame, stratum: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """About `target` rows in proportion to the strata, one of each at least, chosen by hash.

    Shares are worked out on the strata (a few rows): too many are taken back from the largest allocations one by one,
    too few are added to the largest strata with room.
    """
    sizes = [(r[0], r[1]) for r in rows.groupBy(stratum).count().orderBy(stratum).collect()]
    total = sum(n for _, n in sizes)
    share = {s: min(n, max(1, round(target * n / total))) for s, n in sizes}
    while sum(share.values()) > target and max(share.values()) > 1:
        share[max(share, key=lambda s: (share[s], str(s)))] -= 1
    for s, n in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        share[s] += max(0, min(n - share[s], target - sum(share.values())))
    wanted = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= F.element_at(wanted, F.col(stratum))).drop("rank")


def clustered(features: DataFrame, columns: tuple[str, ...], ks: tuple[int, ...] = (4, 5, 6, 7, 8), seed: int = 42) -> tuple[DataFrame, dict[int, float]]:
    """Features with cluster of the best k by silhouette, after scaling by population deviation; and every k's silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    stats = features.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_pop(c).alias(f"{c}_s") for c in columns]).first()
    scaled = [((F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] or 1.0)).alias(f"{c}_z") for c in columns]
    data = VectorAssembler(inputCols=[f"{c}_z" for c in columns], outputCol="features").transform(features.na.fill(0.0, list(columns)).select("*", *scaled))
    data = stored(data, "features")
    found = {}
    for k in ks:
        model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data)
        found[k] = (ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(data)), model)
    best = max(found, key=lambda k: (found[k][0], -k))
    out = found[best][1].transform(data).drop("features", *[f"{c}_z" for c in columns])
    return out, {k: v[0] for k, v in found.items()}


def characterised(clusters: DataFrame, columns: tuple[str, ...], name: str, most: int = 10) -> DataFrame:
    """Each cluster's size, medians, means and bounds, and its first names."""
    stats = [f(c).alias(f"{label}_{c}") for c in columns for label, f in (("median", F.median), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(name))
    examples = clusters.withColumn("r", rank).filter(F.col("r") <= most).groupBy("cluster").agg(F.array_sort(F.collect_list(name)).alias("examples"))
    return clusters.groupBy("cluster").agg(F.count("*").alias("size"), *stats).join(examples, "cluster")


def bootstrap(scored: DataFrame, *by: str, score: str = "score", rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 95 % bounds by a Poisson bootstrap: each row counts 0, 1, 2, ... times in each round, so that no group has to
    fit in a task and reruns agree.

    Equal scores of a group are one row with their number n, which counts as n independent draws do: the sum of n draws by
    hash up to EXACT_DRAWS, and beyond that a normal deviate of the same mean and variance, rounded, by hash.
    """
    mask, scale = F.lit((1 << 52) - 1), F.lit(float(1 << 52))
    uniform = lambda *x: F.xxhash64(*x, F.lit(seed)).bitwiseAND(mask) / scale
    cuts, cut, p = [], 0.0, 0.36787944117144233
    for k in range(1, 13):
        cut += p
        cuts.append(cut)
        p /= k
    drawn_once = lambda u: F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (u >= c).cast("int"))
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(EXACT_DRAWS))), F.lit(0), lambda n, i: n + drawn_once(uniform("row", "round", i)))
    normal = F.sqrt(-2 * F.log(1 - uniform("row", "round", F.lit(-1)))) * F.cos(2 * F.pi() * uniform("row", "round", F.lit(-2)))
    many = F.greatest(F.lit(0.0), F.bround(F.col("n") + F.sqrt("n") * normal)).cast("long")
    distinct = scored.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"))
    drawn = distinct.withColumn("row", F.xxhash64(*by, score)).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", F.when(F.col("n") <= EXACT_DRAWS, few.cast("long")).otherwise(many))
    means = drawn.groupBy(*by, "round").agg((F.sum(F.col(score) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    bounds = means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    mean = scored.groupBy(*by).agg(F.avg(score).alias("mean"), F.count("*").alias("n"))
    return mean.join(bounds, list(by)) if by else mean.crossJoin(F.broadcast(bounds))


def paired_t(seeds: DataFrame, *by: str) -> DataFrame:
    """Paired t statistic, degrees of freedom and two-sided p of a minus b over seeds."""
    from math import atan, cos, pi, sqrt

    @F.pandas_udf("double")
    def two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
        def p(x: float, n: float) -> float:
            if x != x or n < 1:
                return float("nan")
            angle, n = atan(abs(x) / sqrt(n)), int(n)
            s, c = abs(x) / sqrt(n + x * x), cos(angle)
            if n % 2:
                term, total = c, c if n > 1 else 0.0
                for k in range(3, n - 1, 2):
                    term *= c * c * (k - 1) / k
                    total += term
                inside = 2 / pi * (angle + s * total)
            else:
                term = total = 1.0
                for k in range(2, n - 1, 2):
                    term *= c * c * (k - 1) / k
                    total += term
                inside = s * total
            return max(0.0, 1 - inside)

        return pd.Series([p(a, b) for a, b in zip(t, df, strict=True)])

    d = seeds.withColumn("d", F.col("a") - F.col("b")).groupBy(*by).agg(F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("s"), F.count("*").alias("n"))
    t = F.try_divide(F.col("mean_difference"), F.col("s") / F.sqrt("n"))
    return d.withColumn("t", t).withColumn("df", F.col("n") - 1).withColumn("p", two_sided(F.coalesce("t", F.lit(float("nan"))), F.col("df").cast("double"))).drop("s")


def euclidean_silhouette(rows: DataFrame, columns: tuple[str, ...], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette by Euclidean distance, as (silhouette); distances to a cluster's members are means over a self-join, for small tables."""
    v = F.array(*[F.col(c).cast("double") for c in columns])
    p = rows.select(F.monotonically_increasing_id().alias("i"), F.col(cluster).alias("c"), v.alias("v"))
    p = stored(p, "points")
    a, b = p.alias("a"), p.alias("b")
    distance = F.sqrt(F.aggregate(F.zip_with(F.col("a.v"), F.col("b.v"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    d = a.join(b, F.col("a.i") != F.col("b.i")).groupBy(F.col("a.i").alias("i"), F.col("a.c").alias("own"), F.col("b.c").alias("other")).agg(F.avg(distance).alias("d"))
    s = d.groupBy("i").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("inside"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("outside"))
    return s.agg(F.avg(F.coalesce((F.col("outside") - F.col("inside")) / F.greatest("inside", "outside"), F.lit(0.0))).alias("silhouette"))
