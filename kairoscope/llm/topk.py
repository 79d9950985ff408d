"""Exact top-k search by inner product with one KD-tree per shard.

Vectors are dealt into shards by a hash of their id, about SHARD_ROWS each. A task builds its shard's tree (median splits
of the widest dimension, tight bounding boxes) and answers blocks of queries: the largest inner product that a box allows
is known for all nodes from two matrix products, nodes are taken best first, and a node is opened only while its bound
isn't below the query's k-th score so far, which is propagated from leaf to leaf. It starts from the query's home shard:
a first pass over that one shard gives every query a k-th score that prunes in all the others. Every shard answers every
query (the stated query set against all rows, in blocks); the k best of a shard go on and the k best of all remain. Queries
are dealt into blocks of about QUERY_ROWS, and a task has one shard and one block, whatever the table's size.

Scores are integers: floor(SCALE * x) of each component, so ties are true ties and go to the smaller vec_id. Blocks whose
sums fit in 53 bits are multiplied as doubles, exactly; others as Python integers, held to 64 bits at the end.

Defined results: vectors that are null or hold a null or a non-finite component take no part, as query or candidate;
vectors of different lengths are never compared; a query's own row is any row with its vec_id, and a null vec_id takes no
part; repeated rows are candidates as often as they come, but a query's vec_id is answered once, for the least of its vectors
(component by component); a query without any candidate returns no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm.common import stored

SCALE = 64
K = 20
SHARD_ROWS = 8192
LEAF_ROWS = 256
QUERY_ROWS = 32768
QUERY_BLOCK = 1024


class Tree:
    """A KD-tree over the rows of an array: nodes as arrays, leaves as ranges of a reordering."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.low, self.high, self.children, self.ranges = [], [], [], []
        self._grow(points, 0, len(points))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, start: int, end: int) -> int:
        own = points[self.order[start:end]]
        node = len(self.low)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.children.append(())
        self.ranges.append((start, end))
        widest = int(np.argmax(self.high[node] - self.low[node]))
        if end - start > LEAF_ROWS and self.high[node][widest] > self.low[node][widest]:
            half = (end - start) // 2
            self.order[start:end] = self.order[start:end][np.argpartition(own[:, widest], half)]
            self.children[node] = (self._grow(points, start, start + half), self._grow(points, start + half, end))
        return node


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query number, vec_id, score) of each query's k best in the shard that reach its least score."""
    most = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, points.shape[1])
    kind = np.float64 if most < 2**53 else object
    points, queries = points.astype(kind), queries.astype(kind)
    tree = Tree(points)
    points, ids = points[tree.order], ids[tree.order]
    bounds = np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T
    found = []
    for q in range(len(queries)):
        bound, floor = bounds[q], least[q]
        best_score, best_id = np.array([], dtype=kind), np.array([], dtype=np.int64)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= floor:
            _, node = heapq.heappop(heap)
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            start, end = tree.ranges[node]
            score = points[start:end] @ queries[q]
            keep = (score >= floor) & (ids[start:end] != query_ids[q])
            if not keep.any():
                continue
            best_score, best_id = np.concatenate([best_score, score[keep]]), np.concatenate([best_id, ids[start:end][keep]])
            if len(best_score) > k:
                first = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[first], best_id[first]
            if len(best_score) == k:
                floor = max(floor, best_score.min())
        found += [(q, int(i), max(-(2**63), min(2**63 - 1, int(s)))) for i, s in zip(best_id, best_score, strict=True)]
    return found


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (doubles holding integers) and n (their number) of the rows that take part."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: _floor(x * SCALE))
    return rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("n", F.size("v"))


def _floor(x):
    """floor as a double: Spark's own floor returns a long, which large components don't fit."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _answers(queries: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """The k best of each (n, shard) for each block of the queries that name it."""

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            right = right.sort_values("vec_id", kind="stable")
            points, ids = np.stack(right["v"].to_numpy()), right["vec_id"].to_numpy()
            left = left.rename(columns=lambda c: c.removeprefix("q_")).sort_values("vec_id", kind="stable")
            for start in range(0, len(left), QUERY_BLOCK):
                block = left.iloc[start : start + QUERY_BLOCK]
                query_ids = block["vec_id"].to_numpy()
                rows += [(int(query_ids[q]), i, s) for q, i, s in search(points, ids, np.stack(block["v"].to_numpy()), query_ids, block["least"].to_numpy(), k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    own = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return own.groupBy("q_n", "q_shard", "q_block").cogroup(shards.groupBy("n", "shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each row for which is_query holds."""
    kept = stored(vectors(rows), "vectors")
    size = kept.count()
    n_shards = max(1, -(-size // SHARD_ROWS))
    shards = kept.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    asked = stored(kept.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("n", F.size("v")), "queries")
    n_blocks = max(1, -(-asked.count() // QUERY_ROWS))
    blocks = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = asked.withColumns({"home": F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"), "block": F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(n_blocks)).cast("int")})
    nothing = F.lit(float("-inf"))
    first = stored(_answers(asked.select("vec_id", "v", "n", F.col("home").alias("shard"), "block", nothing.alias("least")), blocks, k), "home")
    known = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
    bounded = asked.join(known, asked["vec_id"] == known["query_id"], "left").withColumn("least", F.coalesce("least", nothing))
    others = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).filter("shard <> home")
    found = first.unionByName(_answers(others.select("vec_id", "v", "n", "shard", "block", "least"), blocks, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(k: int = K) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""
