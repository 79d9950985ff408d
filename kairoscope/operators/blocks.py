"""All pairs within groups without emitting them: rows are dealt in blocks, and a task compares two blocks of a group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.storage import stored

BLOCK = 512
#: A test of one group's rows: which rows are linked, as a table, from their columns.
Test = Callable[[list[pa.ChunkedArray]], np.ndarray]


def linked_within(rows: DataFrame, by: list[str], node: str, columns: list[str], test: Test, size: int = BLOCK) -> DataFrame:
    """(a, b) of nodes of one group (equal `by`, nulls included) for which test holds.

    A group of n rows is n / size blocks and each pair of them is compared in one place, so no task holds a group, however
    large; groups of one row are left out. Groups come one after the other from sorted rows, so small ones cost no task.
    """
    key = F.xxhash64(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in by])
    held = stored(rows.select(key.alias("g"), F.col(node).alias("node"), *columns), "grouped")
    sizes = stored(held.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    dealt = held.join(sizes, "g").withColumn("blocks", F.expr(f"int((n + {size - 1}) div {size})")).withColumn("own", F.expr("int(pmod(xxhash64(node, g), blocks))"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
    spread = dealt.withColumn("p", F.explode(pairs)).select("g", "p.i", "p.j", "own", "node", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            here = pa.Table.from_batches([batch])
            here = here if left is None else pa.concat_tables([left, here])
            if not here.num_rows:
                continue
            group = [here.column(i).to_numpy() for i in range(3)]
            begin = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in group], axis=0)]))
            found = [_links(here.slice(x, y - x), test) for x, y in zip(begin, begin[1:], strict=False)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in range(2)], names=["a", "b"])
            left = here.slice(begin[-1])
        if left is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _links(left, test)], names=["a", "b"])

    return spread.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "node").mapInArrow(run, "a long, b long")


def _links(rows: pa.Table, test: Test) -> tuple[np.ndarray, np.ndarray]:
    own, node = rows.column(3).to_numpy(), rows.column(4).to_numpy()
    if len(node) < 2:
        return node[:0], node[:0]
    table = np.triu(test([rows.column(i) for i in range(5, rows.num_columns)]), 1)
    if own.min() != own.max():
        table &= own[:, None] != own[None, :]
    a, b = np.nonzero(table)
    return node[a], node[b]
