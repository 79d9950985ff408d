"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a fixed hash of 60 bits. A source's part of the mix is its documents below a hash threshold, once
(a target up to the source's size) or all of them once and those below the threshold twice (a target up to twice its
size). The threshold is found without sorting: token sums by source and leading hash bits give the bucket in which the
budget runs out, only that bucket is looked into with the next bits, and after three levels its few documents by their
whole hash. Of the rows at the boundary, equal ones all, as many are in as bring the source nearest to its budget.

Hot sources: sums combine on the map side, a source's histogram has 1024 rows at most, and documents are never gathered
by source. The per-source table is broadcast only after its rows are counted (common.BROADCAST_ROWS), else dealt by
source and salt.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share SHARE of all sizes; a target stops at
MOST_REPEATS times its source's size, the excess goes to the others by weight. That is the water level max_k of what
remains after the k sources that fill first, so one window over the sources finds it.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, the last; rows with the
same doc_id, text and source are taken alike, but at the boundary, where some of them are taken once more than the others
(in mix() by their other columns' hash); an empty table gives an empty result; other columns are not read by plan() and pass
through mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm.common import WORD_CHAR, WORD_GAP, join_summary, n_words_of, stored, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
#: Bits of the hash, and how many each level of the histogram looks at.
BITS, LEVEL_BITS, LEVELS = 60, 10, 3
#: Equal rows that one task makes at once.
RUN = 10_000


def place():
    """The document's hash, from 0 to 2**60 - 1: of its id and its text, so that no shared id is one place."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def source_key():
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def targets(sized: DataFrame) -> DataFrame:
    """k, source_size and target for each source key; a row for each source."""
    sums = sized.groupBy("k").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy((F.col("k") == "n").cast("int"), "k")) - 1) % len(WEIGHTS) + 1)
    cap = MOST_REPEATS * F.col("source_size")
    weighed = sums.withColumn("weight", weight).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    everyone = Window.partitionBy()
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.lit(SHARE) * F.sum("source_size").over(everyone) - filled) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everyone))
    return levelled.select("k", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _boundary(sized: DataFrame, state: DataFrame, n: int, shift: int, width: int) -> DataFrame:
    """For each source the bucket in which its budget runs out, what is left of the budget there, and the bucket's sum."""
    inside = join_summary(sized, state, "k", n).filter(F.shiftright("place", shift + width) == F.col("bucket"))
    sums = inside.groupBy("k", "left", F.shiftright("place", shift).alias("next")).agg(F.sum("size").alias("w"), F.count("*").alias("rows"))
    upto = F.sum("w").over(Window.partitionBy("k").orderBy("next").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    crossing = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("left"))
    first = F.min(F.struct("next", (F.col("left") - (F.col("upto") - F.col("w"))).alias("left"), "w", "rows"))
    return crossing.groupBy("k").agg(first.alias("x")).select("k", F.col("x.next").alias("bucket"), F.col("x.left").alias("left"), F.col("x.w").alias("w"), F.col("x.rows").alias("rows"))


def _cuts(sized: DataFrame) -> tuple[DataFrame, int]:
    """For each source k: source_size, target, base (copies of all), cut (the place below which there is one more) and extra (rows at cut that have one more); and the number of sources."""
    aims = stored(targets(sized).withColumn("base", (F.col("target") >= F.col("source_size")).cast("int")), "targets")
    n = aims.count()
    state = aims.select("k", F.lit(0).cast("long").alias("bucket"), (F.col("target") - F.col("base") * F.col("source_size")).alias("left"))
    shift = BITS
    for _ in range(LEVELS):
        shift -= LEVEL_BITS
        state = stored(_boundary(sized, state, n, shift, LEVEL_BITS).drop("w", "rows"), "boundary")
    last = _boundary(sized, state, n, 0, shift)
    nearest = F.ceil(F.col("left") * F.col("rows") / F.col("w") - 0.5)
    cut = last.select("k", F.col("bucket").alias("cut"), F.greatest(F.lit(0), nearest).cast("long").alias("extra"))
    return stored(aims.join(cut, "k", "left").withColumns({"cut": F.coalesce("cut", F.lit(1 << BITS)), "extra": F.coalesce("extra", F.lit(0))}), "cuts"), n


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column says, dealt in runs of RUN, so that one row of very many copies isn't one task's work."""
    run = unused("mix_run", rows.columns)
    runs = rows.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) div {RUN}"))))
    dealt = runs.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in runs.columns]))
    return dealt.withColumn(run, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col(f"`{times}`") - F.col(run) * RUN)))).drop(run)


def plan(docs: DataFrame) -> DataFrame:
    """doc_id, place, k, size, source_size, target and copies (0 to MOST_REPEATS) for each document."""
    sized = stored(docs.select("doc_id", source_key().alias("k"), n_words_of(F.col("text")).alias("size"), place().alias("place")), "sized")
    aims, n = _cuts(sized)
    aimed = join_summary(sized, aims, "k", n)
    out = ["doc_id", "place", "k", "size", "source_size", "target", "copies"]
    apart = aimed.filter("place <> cut").withColumn("copies", F.col("base") + (F.col("place") < F.col("cut")).cast("int"))
    same = aimed.filter("place = cut").groupBy(*sized.columns, "source_size", "target", "base", "extra").agg(F.count("*").alias("rows"))
    more, less = same.withColumns({"n": F.least("rows", "extra"), "copies": F.col("base") + 1}), same.withColumns({"n": F.col("rows") - F.least("rows", "extra"), "copies": F.col("base")})
    return apart.select(*out).unionByName(_repeated(more.unionByName(less).filter("n > 0").select(*out, "n"), "n").select(*out))


def decide(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for each document."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixture: every document as many times as it is taken, with the columns it came with."""
    p, k, n = unused("mix_place", docs.columns), unused("mix_k", docs.columns), unused("mix_copies", docs.columns)
    narrow = docs.select("doc_id", source_key().alias("k"), n_words_of(F.col("text")).alias("size"), place().alias("place"))
    aims, n_sources = _cuts(stored(narrow, "sized"))
    own = [unused(f"mix_{c}", docs.columns) for c in ("base", "cut", "extra")]
    aims = aims.select(F.col("k").alias(k), *[F.col(c).alias(o) for c, o in zip(("base", "cut", "extra"), own, strict=True)])
    base, cut, extra = (F.col(c) for c in own)
    held = docs.filter(F.col("text").rlike(WORD_CHAR)).withColumns({p: place(), k: source_key()})
    aimed = join_summary(held, aims, k, n_sources)
    apart = aimed.filter(F.col(p) != cut).withColumn(n, base + (F.col(p) < cut).cast("int")).filter(F.col(n) > 0)
    apart = apart.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    rows, before = unused("mix_rows", docs.columns), unused("mix_before", docs.columns)
    same = aimed.filter(F.col(p) == cut).groupBy(*docs.columns, k, *own).agg(F.count("*").alias(rows))
    order = Window.partitionBy(k).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn(before, F.coalesce(F.sum(rows).over(order), F.lit(0)))
    taken = ranked.withColumn(n, F.col(rows) * base + F.greatest(F.lit(0).cast("long"), F.least(F.col(rows), extra - F.col(before)))).filter(F.col(n) > 0)
    return apart.unionByName(_repeated(taken.select(*docs.columns, n), n).select(*docs.columns))


def oracle_sql() -> str:
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS k,
         len(list_filter(string_split_regex(coalesce(text, ''), '{WORD_GAP}'), lambda w: w <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS place
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY k = 'n', k) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight, {MOST_REPEATS} * source_size AS cap FROM s),
l AS (
  SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
t AS (SELECT k, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS base FROM t),
h AS (SELECT k, place, sum(size)::BIGINT AS w, count(*) AS n FROM d GROUP BY k, place),
u AS (SELECT k, place, w, n, sum(w) OVER (PARTITION BY k ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto, target - base * source_size AS budget FROM h JOIN b USING (k)),
x AS (SELECT k, min(place) AS place FROM u WHERE upto > budget GROUP BY k),
c AS (SELECT k, place AS cut, greatest(0, ceil((budget - (upto - w)) * n / w - 0.5)) AS extra FROM u JOIN x USING (k, place)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, place) AS nth FROM d)
SELECT doc_id, size, source_size, target, (size * (base + CASE WHEN place < coalesce(cut, {1 << BITS}) OR (place = cut AND nth <= extra) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN b USING (k) LEFT JOIN c USING (k)"""
