"""Incremental quality control: raw triples that arrive as files become validated edges, each once.

Validation and projection are stateless; duplicates of an edge id within the watermark are dropped by the state store, and a
batch is merged into the table of edges by anti-join on its ids, so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kairoscope.model import RAW_TRIPLES
from kairoscope.operators import quality


def arriving(spark: SparkSession, path: str, schema: str = RAW_TRIPLES, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(f"{schema}, arrived timestamp").option("maxFilesPerTrigger", files_per_trigger).json(path)


def edges(raw: DataFrame, metadata: DataFrame, delay: str = "1 day") -> DataFrame:
    """Valid triples of a stream as edges, each edge id once within the delay; metadata is a static table."""
    valid = quality.validated(raw).filter("reject_reason IS NULL").withWatermark("arrived", delay)
    scored = quality.with_evidence(valid, metadata)
    made = quality.to_edges(scored.withColumn("ord", F.unix_micros("arrived"))).withColumn("arrived", F.timestamp_micros("ord")).drop("ord")
    return made


def _written(spark: SparkSession, table: str) -> bool:
    """Whether a batch has been committed to the table's folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table, "_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def merge_into(table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends edges whose id the table doesn't have."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["edge_id"])
        if _written(spark, table):
            new = new.join(spark.read.parquet(table).select("edge_id"), "edge_id", "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return merge


def run(spark: SparkSession, source: str, metadata: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, then stop; call again for what has come since."""
    stream = edges(arriving(spark, source), metadata)
    return stream.writeStream.foreachBatch(merge_into(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_events(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """A stream's events once for each key within the delay; timestamps without a zone are cast first."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
