"""Helpers shared by the corpus operators: tables, native let-bindings, shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.storage import fresh_path, scratch, shared_dir, stored

__all__ = ["BROADCAST_ROWS", "WORD_CHAR", "WORD_GAP", "fresh_path", "join_summary", "let", "n_words_of", "scratch", "shared_dir", "stored", "table", "text_hash", "unused"]

#: What separates words, everywhere in this package: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A character that is part of a word.
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Rows above which a per-source or per-length summary is joined by shuffle rather than by broadcast.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once.

    Catalyst inlines a projected column into lambdas that mention it, where it would run again for every element; a lambda variable isn't inlined.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def n_words_of(text: Column) -> Column:
    """The number of words, without keeping them: gaps between trimmed words, plus one."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return let(parts, lambda p: F.size(p) - F.when(F.element_at(p, 1) == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)).cast("long")


def text_hash(text: Column) -> Column:
    """Tells rows with the same doc_id apart; null texts hash like empty ones."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unused(name: str, taken: Iterable[str]) -> str:
    """name, lengthened until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def join_summary(rows: DataFrame, summary: DataFrame, key: str, n: int, how: str = "inner") -> DataFrame:
    """rows joined with a summary of n rows, one for each key.

    Broadcast only if the counted n is within BROADCAST_ROWS. Otherwise every key is dealt over 16 salts, so that a key with a third of all rows isn't one task.
    """
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(summary), key, how)
    salt = unused("salt", rows.columns)
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(16)).cast("int"))
    spread = summary.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(15))))
    return salted.join(spread, [key, salt], how).drop(salt)
