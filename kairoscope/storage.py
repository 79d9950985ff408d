"""Shared storage for intermediate tables: what survives a lost executor and every machine can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch: whether the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of each open scratch(), the innermost last.
_OPEN: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session has it.

    Only where the session names none and runs in one process (tests) is a folder of our own made and set; on a cluster
    such a folder would be another one on each machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kairoscope-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables or files of one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that stored() writes meanwhile are deleted at the end, but for those that it is told to keep.

    Only where all that reads them has ended by then: what is returned from such a block must read kept tables and inputs.
    """
    own: list[tuple[SparkSession, str]] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for spark, path in own:
            gone = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and read again.

    Lineage ends here: a lost executor costs no recomputation of what came before, and later steps read only the columns they need.
    Within scratch() the table goes at the end of the block, with keep at the end of the block around it, if there is one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    around = _OPEN.get()[:-1] if keep else _OPEN.get()
    if around:
        around[-1].append((spark, path))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
