"""Best-fit packing of documents into sequences by exact-complement hashing.

Documents are tokenised and cut into pieces of at most SEQUENCE tokens. Which piece goes where depends only on how many
pieces there are of each length, at most SEQUENCE numbers however large the corpus, so the plan is made on the driver:
sums of one, two and three available lengths are indexed, a sequence's gap that such a sum fills exactly consumes that
combination as often as the counts allow, and where no sum fills it the longest piece that fits (best fit) goes in and
the gap that is left is looked up again. Every pattern uses up a length, so there are about as many patterns as lengths.

The pieces then find their places in parallel: a piece's rank among those of its length, from counts by length and chunk
and a row number within the chunk (a hash of the piece, so that a length that a third of all rows have is many groups),
is looked up in the plan's slots.

Tokens: `tokenizers` and its byte-level BPE file fix the ids. Where a text is Latin script throughout, the same
vocabulary's ranks are applied by tiktoken, about five times as fast; the tests hold both to the same ids. Token 0 follows
each document. Both paths are parameters.

Defined results: null and empty texts are one piece, the token 0; repeated rows are packed as often as they come; an empty
table gives an empty result; other columns are not read; a text of any length is cut, its first piece being the shorter.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.llm.common import stored

SEQUENCE = 2048
END = 0
#: Rows that a chunk of a length has on average at most.
CHUNK_ROWS, LEAST_CHUNKS = 20_000, 64
#: Last code point of the Latin blocks, up to which both tokenizer libraries class characters alike.
LATIN = 0x24F


class Encoder:
    """Token ids of texts; each library is loaded when first needed."""

    def __init__(self, path: str, ranks: str | None, pattern: str) -> None:
        self.path, self.ranks, self.pattern = path, ranks, pattern
        self.whole = self.fast = None

    def slow(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None or "<|" in text or not (text.isascii() or np.frombuffer(text.encode("utf-16-le"), dtype="<u2").max() <= LATIN):
            return self.slow(text)
        if self.fast is None:
            import tiktoken

            with open(self.ranks, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("pieces", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % SEQUENCE or SEQUENCE
    return [(0, first), *((start, SEQUENCE) for start in range(first, n, SEQUENCE))]


def tokenize(docs: DataFrame, with_ids: bool = True, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every document."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = public_tokenizers.PATTERN
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, ranks, pattern)
        for batch in batches:
            keys, rows, ids = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(encode(text.as_py() or ""), np.array([END], dtype="<u4"))
                for piece, (start, length) in enumerate(cuts(len(found))):
                    own = found[start : start + length]
                    keys.append(key)
                    rows.append((piece, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        ids.append(own.astype(np.int32))
            piece, start, length, crc = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            columns = [pa.array(keys, pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


class Complements:
    """How many pieces are left of each length, and which sums of up to three of them fill a gap."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.copy()
        self.index()

    def index(self) -> None:
        there = self.left > 0
        self.there = there
        twice = np.convolve(there, there)[: SEQUENCE + 1] > 0
        self.pair_sums = twice

    def affordable(self, lengths: list[int]) -> int:
        """How often these lengths can be taken together."""
        return min((int(self.left[x]) // k for x, k in Counter(lengths).items()), default=0)

    def exact(self, held: list[int], gap: int) -> list[int] | None:
        """One, two or three lengths that fill the gap, beside what is held already; longest first."""
        if self.affordable([*held, gap]):
            return [gap]
        if pair := self._pair(held, gap):
            return pair
        for a in np.flatnonzero(self.there[: gap - 1] & self.pair_sums[gap : 1 : -1])[::-1] if gap > 2 else ():
            if 3 * a < gap:
                break
            if (pair := self._pair([*held, int(a)], gap - int(a))) and pair[0] <= a:
                return [int(a), *pair]
        return None

    def _pair(self, held: list[int], gap: int) -> list[int] | None:
        if gap < 2 or not self.pair_sums[gap]:
            return None
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        for a in high[self.there[high] & self.there[gap - high]]:
            if self.affordable([*held, int(a), gap - int(a)]):
                return [int(a), gap - int(a)]
        return None

    def longest(self, held: list[int], gap: int) -> int | None:
        for x in np.flatnonzero(self.there[: gap + 1])[::-1]:
            if self.affordable([*held, int(x)]):
                return int(x)
        return None

    def take(self, lengths: list[int]) -> int:
        times = self.affordable(lengths)
        for x, k in Counter(lengths).items():
            self.left[x] -= k * times
        if any(self.left[x] == 0 for x in lengths):
            self.index()
        return times


def patterns(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths, how many sequences have them) for all pieces; counts[x] pieces have length x."""
    stock, found = Complements(counts), []
    for x in range(SEQUENCE, 0, -1):
        while stock.left[x]:
            held, gap = [x], SEQUENCE - x
            while gap:
                if fill := stock.exact(held, gap):
                    held += fill
                    break
                if (best := stock.longest(held, gap)) is None:
                    break
                held.append(best)
                gap -= best
            found.append((held, stock.take(held)))
    return found


def slots(found: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: a piece of length x and rank r belongs to the last slot whose key is at most x << 40 | r."""
    used: Counter = Counter()
    rows, base = [], 0
    for lengths, times in found:
        at = 0
        for x in lengths:
            rows.append((x << 40 | used[x], used[x], base, at))
            used[x] += times
            at += x
        base += times
    key, first, base, at = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T
    return {"key": key, "first": first, "base": base, "at": at}


def pack(pieces: DataFrame) -> DataFrame:
    """The pieces, which are read twice, with sequence_id and offset."""
    n = pieces.count()
    chunks = max(LEAST_CHUNKS, -(-n // CHUNK_ROWS))
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)).cast("int"))
    sums = stored(dealt.groupBy("length", "chunk").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(SEQUENCE + 1, dtype=np.int64)
    for length, c in sums.groupBy("length").agg(F.sum("n")).collect():  # SEQUENCE rows at most
        counts[length] = c
    at = slots(patterns(counts))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("own", own).join(before.drop("n"), ["length", "chunk"]).withColumn("own", F.col("own") + F.col("before")).select(*pieces.columns, "own")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "own"))
            i = np.searchsorted(at["key"], length << 40 | rank, side="right") - 1
            sequence, offset = at["base"][i] + rank - at["first"][i], at["at"][i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    return pack(stored(tokenize(docs, with_ids), "pieces"))
