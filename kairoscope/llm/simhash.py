"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: 64 bits over the XXH64 hashes of three-word shingles. Two fingerprints link at RADIUS = 3 or fewer differing
bits, and documents of linked fingerprints, at any number of steps, are one component.

Collision search, over distinct fingerprints only (a third of all rows may share one), in two shuffles on variants:

1. Partial balls. Of three blocks of bits, a pair within 3 bits differs by at most two bits in the two blocks (42 or 43
   bits) that differ least. For each two blocks every fingerprint emits the variants within half of that, one bit: 131
   variants in all. A fingerprint that shares no variant links to nothing; chance meetings in so many bits are rare.
2. Full balls, for those that share one. Parities again: fingerprints with an even number of bits emit the 65 variants
   within one bit; odd ones these and the two-bit variants whose bits lie in the same half (of three differing bits two
   do). Any pair within 3 bits meets in a variant, and all that meet there lie within 3 bits of the bucket's centre: of
   its smallest member if the variant's own parity is even, else of the smallest member that is the variant or an even
   fingerprint. So each member needs one link, to the centre, and a bucket of any size emits no pairs. Links are verified
   by their bit count and deduplicated.

Components come from distributed union-find.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; repeated rows come back as
often as they came; a null doc_id never names a component unless all its doc_ids are null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm.common import scratch, stored, text_hash, unused
from kairoscope.operators.components import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Shingles whose bits are unpacked at once: bounds memory for texts of any length.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text; bytes.lower() and bytes.split() are A-Z and U+0009-U+000D, U+0020."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        words = [b" ".join(words)]
        grams, n = iter(words), 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)), len(words) - SHINGLE_WORDS + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for start in range(0, n, BLOCK):
        m = min(BLOCK, n - start)
        hashes = np.fromiter((digest(next(grams)) for _ in range(m)) if n > BLOCK else map(digest, grams), dtype="<u8", count=m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash) and fp (the fingerprint's bits as a long) for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_hash(F.col("text")).alias("h"))
    return rows.mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(most: int) -> list[int]:
    """The bit masks of the variants: none, single bits, and with most = 2 pairs of bits in the same half."""
    singles = [1 << i for i in range(64)]
    pairs = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)] if most == 2 else []
    return [_signed(m) for m in (0, *singles, *pairs)]


def _odd(value: Column) -> Column:
    return F.bit_count(value) % 2 == 1


def _partial() -> list[tuple[int, int]]:
    """(bits kept, bits flipped and marked) of the variants over each two of three blocks; the block left out is marked with its number."""
    blocks, out = ((0, 21), (21, 42), (42, 64)), []
    for number, (low, high) in enumerate(blocks, 1):
        kept = (1 << 64) - 1 & ~((1 << high) - (1 << low))
        out += [(_signed(kept), _signed(flip | number << low)) for flip in (0, *(1 << i for i in range(64) if not low <= i < high))]
    return out


def _sharing(distinct: DataFrame) -> DataFrame:
    """The fingerprints that share a partial variant with another one."""
    variants = F.array(*[F.struct(F.lit(kept).cast("long").alias("kept"), F.lit(flip).cast("long").alias("flip")) for kept, flip in _partial()])
    emitted = distinct.select("fp", F.explode(variants).alias("v"))
    keyed = emitted.select("fp", F.col("fp").bitwiseAND(F.col("v.kept")).bitwiseXOR(F.col("v.flip")).alias("key"))
    by = Window.partitionBy("key")
    return keyed.withColumns({"low": F.min("fp").over(by), "high": F.max("fp").over(by)}).filter("low <> high").select("fp").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to connect every pair within RADIUS bits."""
    near = _sharing(distinct)
    emitted = near.select("fp", F.explode(F.when(_odd(F.col("fp")), F.lit(_masks(2))).otherwise(F.lit(_masks(1)))).alias("m"))
    variant = F.col("fp").bitwiseXOR(F.col("m"))
    met = emitted.select("fp", variant.alias("variant"), (~_odd(variant) | (F.col("m") == 0) | ~_odd(F.col("fp"))).alias("central"))
    centre = F.min(F.when(F.col("central"), F.col("fp"))).over(Window.partitionBy("variant"))
    pairs = met.withColumn("centre", centre).filter("centre <> fp").select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, root and component_id (the smallest doc_id reachable by links) for each document."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    linked = stored(components(links(distinct.select("fp"))), "linked")
    rooted = stored(distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    named = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    labels = stored(rooted.join(named, "root").select("fp", "root", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", "h", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with the columns it came with.

    Rows that share that doc_id are told apart by their texts' hashes, of which the smallest stays; of equal rows one, by the
    hash of all columns.
    """
    h, n, own = unused("simhash_h", docs.columns), unused("simhash_n", docs.columns), unused("simhash_id", docs.columns)
    with scratch():
        found = near_duplicates(docs)
        counted = found.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))  # first: equal rows combine before they meet
        best = counted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "n")).alias("best"))
        kept = stored(best.select(F.col("best.doc_id").alias(own), F.col("best.h").alias(f"{h}_"), F.col("best.n").alias(n)), "kept", keep=True)
    hashed = docs.withColumn(h, text_hash(F.col("text")))
    met = hashed.join(kept, F.col(h).eqNullSafe(F.col(f"{h}_")) & hashed["doc_id"].cast("long").eqNullSafe(F.col(own)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = met.filter(F.col(n) > 1).groupBy(h, "doc_id").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(n))
    return met.filter(F.col(n) == 1).select(*docs.columns).unionByName(one.select(f"{n}.*"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
