"""Distributed union-find: alternating large-star and small-star rounds over an edge table.

Every round is two group-by minima and two joins, so nothing is gathered on the driver and no node's neighbours meet in
one task: minima combine on the map side, and as they are read from a table Spark's adaptive execution can split the
joins on a hot node. Rounds grow with
the logarithm of the longest chain. Each round's edges go to a table in the shared folder, which survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.storage import scratch, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that isn't its component's root; root is the smallest node reachable.

    Loops and null ends are no edges. An empty edge table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    with scratch():
        e = stored(e, "edges", keep=True)
        state = _state(e)
        while state[0]:
            e = stored(_small_star(stored(_large_star(e), "edges")), "edges", keep=True)
            before, state = state, _state(e)
            if state == before:
                break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
