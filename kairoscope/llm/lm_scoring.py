"""Language-model scores by masked pseudo-likelihood.

A token is a word. Words have classes: the FREQUENT most frequent ones a class each, the others share BUCKETS classes by a
hash of their last bytes; class 0 stands outside a text. A bidirectional window network predicts the class of every token
from the two tokens on each side, of which the outer ones count by FAR coarser classes:
p(c | context) = softmax(W tanh(F[ll] + L[l] + R[r] + G[rr] + b) + o). A word is as likely within its class as it is frequent
in the corpus, n(w) / n(c). A text's score is the sum of log p(c | context) + log n(w) / n(c) over its tokens.

What is gathered grows with the corpus: a count of every word of every text, in a table, and counts of all windows. The
windows of classes are the network's sufficient statistics, so each step of training is a full-batch step over all tokens.
The driver gets the KNOWN most frequent words, the classes' sizes and one packed row of counts for each pair of left classes
(NEAR * NEAR * NEAR * FAR * FAR counters); the rest of the vocabulary stays in its table: a first pass scores what the tasks
know and keeps the other words of each text, and these are joined with their counts. They are rare, so no key is hot.
Training is numpy, on those counts, and starts from a fixed seed.

Defined results: null, empty and blank texts have no token, a score of 0 and a null mean; repeated rows score alike; words
that the corpus doesn't have count half an occurrence; an empty table gives an empty result; very long texts are scored
whole, in blocks.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import stored

#: Classes of words (0 is outside), and coarser ones of the words two away.
FREQUENT, BUCKETS, FAR = 39, 24, 4
NEAR = 1 + FREQUENT + BUCKETS
WINDOWS = FAR * NEAR * NEAR * NEAR * FAR
HIDDEN, EPOCHS, RATE = 24, 30, 0.05
#: Words whose counts tasks have at hand.
KNOWN = 1 << 16
#: Distinct words that a task keeps before it passes counts on, and that it remembers classes of.
WORDS_KEPT = 400_000
BLOCK = 1 << 20
UNSEEN = 0.5
#: The coarser class of each class.
FAR_OF = np.array([0, *(1 + c % (FAR - 1) for c in range(1, NEAR))], dtype=np.int32)


def bucket(word: bytes) -> int:
    return 1 + FREQUENT + zlib.crc32(word[-3:]) % BUCKETS


class Vocabulary(dict):
    """word -> its number in classes, part (log n(w) / n(c), without n(w) if that isn't known) and hashes (0 if it is known)."""

    def __init__(self, known: Iterable[tuple[bytes, int]], sizes: dict[int, int]) -> None:
        super().__init__()
        self.less = [0.0 if c <= FREQUENT else math.log(max(1, sizes.get(c, 1))) for c in range(NEAR)]
        self._classes, self._part, self._hashes = array("i"), array("d"), array("q")
        for i, (word, n) in enumerate(known):
            class_ = 1 + i if i < FREQUENT else bucket(word)
            self._add(word, class_, 0.0 if i < FREQUENT else math.log(n) - self.less[class_], 0)
        self.known = len(self)

    def _add(self, word: bytes, class_: int, part: float, hash_: int) -> int:
        self[word] = at = len(self._classes)
        self._classes.append(class_)
        self._part.append(part)
        self._hashes.append(hash_)
        return at

    def __missing__(self, word: bytes) -> int:
        class_, hash_ = bucket(word), xxhash.xxh64_intdigest(word, 42)
        return self._add(word, class_, -self.less[class_], hash_ - (1 << 64) if hash_ >> 63 else hash_)

    def of(self, name: str, numbers_: np.ndarray) -> np.ndarray:
        """classes, part or hashes of words by their numbers."""
        held = getattr(self, f"_{name}")
        return np.frombuffer(held, dtype=held.typecode)[numbers_] if len(held) else np.empty(0, held.typecode)

    def trim(self) -> None:
        """Forgets all but the known words, if they have grown beyond the bound."""
        if len(self) - self.known > WORDS_KEPT:
            known = list(self)[: self.known]
            self.clear()
            self.update(zip(known, range(self.known), strict=True))
            for held in (self._classes, self._part, self._hashes):
                del held[self.known :]


def numbers(text: bytes | None, vocabulary: Vocabulary) -> np.ndarray:
    """The words of a text by their numbers in the vocabulary."""
    words = text.lower().split() if text else []
    return np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))


def windows(classes: np.ndarray) -> np.ndarray:
    """Two tokens to the left, the token and two to the right, for each token, as one number."""
    padded = np.zeros(len(classes) + 4, dtype=np.int32)
    padded[2:-2] = classes
    outer = FAR_OF[padded]
    return (((outer[:-4] * NEAR + padded[1:-3]) * NEAR + padded[2:-2]) * NEAR + padded[3:-1]) * FAR + outer[4:]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            found.update((text.as_py() or b"").lower().split())
            if len(found) > WORDS_KEPT:
                yield out(found)
                found.clear()
    yield out(found)


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The network before training; counts are by outer left, left, token, right and outer right class."""
    rng, (outer, near, *_) = np.random.default_rng(7), counts.shape
    tokens = counts.sum(axis=(0, 1, 3, 4), dtype=np.float64)
    p = {name: rng.normal(0, 0.3, (n, HIDDEN)) for name, n in (("F", outer), ("L", near), ("R", near), ("G", outer), ("W", near))}
    return p | {"b": np.zeros(HIDDEN), "o": np.log(tokens + 1.0) - np.log(max(1.0, tokens.sum()) + near)}


def loss_and_gradient(p: dict[str, np.ndarray], counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean negative conditional log-probability of the tokens, and its gradient."""
    total, loss = max(1.0, float(counts.sum(dtype=np.float64))), 0.0
    grad = {k: np.zeros_like(x) for k, x in p.items()}
    outer, near = counts.shape[:2]
    right = (p["R"][:, None] + p["G"][None] + p["b"]).reshape(near * outer, -1)
    for i in range(outer):
        for j in range(near):
            seen = counts[i, j].reshape(near, -1).T.astype(right.dtype)  # right and outer right, token
            weight = seen.sum(axis=1, keepdims=True)
            if not weight.any():
                continue
            h = np.tanh(right + p["F"][i] + p["L"][j])
            z = h @ p["W"].T + p["o"]
            z -= z.max(axis=1, keepdims=True)
            odds = np.exp(z)
            sums = odds.sum(axis=1, keepdims=True)
            loss -= float((seen * z).sum(dtype=np.float64) - (weight * np.log(sums)).sum(dtype=np.float64))
            d = (odds * (weight / sums) - seen) / np.array(total, dtype=right.dtype)
            dh = (d @ p["W"]) * (1 - h * h)
            grad["W"] += d.T @ h
            grad["o"] += d.sum(axis=0)
            by_right = dh.reshape(near, outer, -1)
            grad["R"] += by_right.sum(axis=1)
            grad["G"] += by_right.sum(axis=0)
            whole = dh.sum(axis=0)
            grad["F"][i] += whole
            grad["L"][j] += whole
            grad["b"] += whole
    return loss / total, grad


def train_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The network's parameters; Adam over the mean conditional log-probability."""
    p = {k: x.astype(np.float32) for k, x in start(counts).items()}
    first, second = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        _, grad = loss_and_gradient(p, counts)
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
            p[k] = (p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def log_probabilities(p: dict[str, np.ndarray]) -> np.ndarray:
    """By the number that windows() makes."""
    out = np.empty((FAR, NEAR, NEAR, NEAR * FAR), dtype=np.float32)
    right = (p["R"][:, None] + p["G"][None] + p["b"]).reshape(NEAR * FAR, -1)
    for i in range(FAR):
        for j in range(NEAR):
            z = np.tanh(right + p["F"][i] + p["L"][j]) @ p["W"].T + p["o"]
            z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
            out[i, j] = z.T
    return out.reshape(-1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


def train(docs: DataFrame) -> dict:
    """What scoring needs, from every text: known words, sizes of classes, the network, and the table of all words."""
    counted = _texts(docs).mapInArrow(_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(counted.withColumn("hash", F.xxhash64("word")), "words")
    known = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    tail = F.lit(1 + FREQUENT) + F.crc32(F.substring("word", -3, 3)) % BUCKETS
    sizes = {int(r["c"]): r["n"] for r in words.groupBy(tail.alias("c")).agg(F.sum("n").alias("n")).collect()}
    for word, n in known[:FREQUENT]:
        sizes[bucket(word)] -= n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found, held, size = Vocabulary(known, sizes), np.zeros(WINDOWS, dtype=np.uint32), [], 0

        def flush() -> None:
            seen, n = np.unique(np.concatenate([*held, np.empty(0, np.int32)]), return_counts=True)
            found[seen] += n.astype(np.uint32)
            held.clear()

        for batch in batches:
            for text in batch.column(0):
                if len(own := numbers(text.as_py(), vocabulary)):
                    held.append(windows(vocabulary.of("classes", own)))
                    if (size := size + len(own)) > BLOCK:
                        flush()
                        size = 0
                vocabulary.trim()
        flush()
        at = np.flatnonzero(found)
        for begin in range(0, len(at), BLOCK):
            part = at[begin : begin + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(found[part].astype(np.int64))], names=["window", "n"])

    row_size = NEAR * NEAR * FAR

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(row_size, dtype=np.float32)
        row[group["window"].to_numpy() % row_size] = group["n"]
        return pd.DataFrame({"left": [int(group["window"].iloc[0]) // row_size], "packed": [zlib.compress(row.tobytes(), 1)]})

    summed = _texts(docs).mapInArrow(count, "window int, n long").groupBy("window").agg(F.sum("n").alias("n"))
    rows = summed.groupBy(F.expr(f"window div {row_size}").alias("g")).applyInPandas(pack, "left int, packed binary").collect()
    counts = np.zeros((FAR * NEAR, row_size), dtype=np.float32)
    for r in rows:
        counts[r["left"]] = np.frombuffer(zlib.decompress(r["packed"]), dtype=np.float32)
    return {"known": known, "sizes": sizes, "words": words, "network": train_counts(counts.reshape(FAR, NEAR, NEAR, NEAR, FAR))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed) and mean_log_likelihood for each document."""
    known, sizes, network = model["known"], model["sizes"], model["network"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, vocabulary = log_probabilities(network), Vocabulary(known, sizes)
        for batch in batches:
            n, sums, others = [], [], []
            for text in batch.column(2):
                own = numbers(text.as_py(), vocabulary)
                n.append(len(own))
                sums.append(float(table[windows(vocabulary.of("classes", own))].sum(dtype=np.float64) + vocabulary.of("part", own).sum()) if len(own) else 0.0)
                hashes = vocabulary.of("hashes", own)
                others.append(hashes[hashes != 0])
                vocabulary.trim()
            edges = np.cumsum([0, *map(len, others)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*others, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sums, pa.float64()), lists], names=["row", "doc_id", "n_tokens", "s", "others"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    local = stored(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, s double, others array<long>"), "scored")
    rest = local.select("row", F.explode("others").alias("hash")).groupBy("row", "hash").agg(F.count("*").alias("times"))
    known_n = model["words"].groupBy("hash").agg(F.sum("n").alias("n"))
    more = rest.join(known_n, "hash", "left").groupBy("row").agg(F.sum(F.col("times") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))).alias("more"))
    total = F.col("s") + F.coalesce("more", F.lit(0.0))
    return local.join(more, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
