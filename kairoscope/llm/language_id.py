"""Language identification by nearest centroid over normalised TF-IDF n-gram vectors.

A text becomes counts of byte n-grams (1 to 3) of its lower-cased letters, hashed into DIMS dimensions, weighted by
inverse document frequency and scaled to length one. Each language has several centroids, found by spherical k-means;
a text takes the language of the centroid with the largest cosine. Distance-based rejection: a text whose cosine is
below that centroid's radius (the RADIUS_QUANTILE of its own training texts, less RADIUS_MARGIN) is marked as not
accepted.

What is learned: document frequencies and language counts from every training text; the centroids from a bounded
sample, about SAMPLE_PER_LANG different texts of each language, chosen by a hash of doc_id and text, and at least one.
What reaches the driver is the model: a few centroids of each language.

Defined results: null texts and texts without a letter are `und` with score 0, and so is every text where nothing could
be learned; a null doc_id counts as the empty text in the hash that holds out; repeated rows are scored alike; an empty
table gives an empty result; very long texts are counted whole, in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairoscope.llm.common import join_summary, stored

#: A letter, as Java's patterns have it.
LETTER = r"\p{L}"
DIMS = 1 << 12
#: Bound of the sample that centroids are fitted to, for each language; in expectation, as a hash decides.
SAMPLE_PER_LANG = 1000
CENTROIDS_PER_LANG = 4
RADIUS_QUANTILE, RADIUS_MARGIN = 0.01, 0.05
#: Multipliers of the n-gram hash, by n.
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
BLOCK = 1 << 20


def letters(text: str | None) -> str | None:
    """The text's letters in lower case with single spaces between; None if there is no letter."""
    if not text:
        return None
    kept = re.sub(r"[\W\d_]+", " ", text.lower())
    return f" {kept.strip()} " if any(map(str.isalpha, kept)) else None


def counts(kept: str) -> np.ndarray:
    """Hashed n-gram counts of a text that letters() returned."""
    raw = np.frombuffer(kept.encode("utf-8", "replace"), dtype=np.uint8)
    found = np.zeros(DIMS)
    for start in range(0, len(raw), BLOCK):
        part = raw[start : start + BLOCK + 2].astype(np.uint32)
        codes = part
        for n, mix in enumerate(MIX):
            if n:
                codes = (codes[:-1] << np.uint32(8)) | part[n:]
            own = codes[:BLOCK]  # grams that begin in this block
            found += np.bincount((own * np.uint32(mix) + np.uint32(n)) >> np.uint32(20), minlength=DIMS)
    return found


def unit(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = found * idf
    size = np.sqrt(v @ v)
    return (v / size if size else v).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            if (kept := letters(text.as_py())) is not None:
                df += counts(kept) > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *df[at]], pa.int64())], names=["dim", "n"])


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each point's centroid; starts from points far from each other, so reruns agree."""
    chosen, nearest = [0], points @ points[0]
    for _ in range(min(k, len(points)) - 1):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    centres, own = points[chosen].copy(), np.zeros(len(points), dtype=np.int64)
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            mean = points[own == c].sum(axis=0)
            if size := np.sqrt(mean @ mean):
                centres[c] = mean / size
    return centres, np.argmax(points @ centres.T, axis=1)


def train(docs: DataFrame) -> dict:
    """The model learned from rows with a text and a lang: idf, centroids, their languages and radii."""
    labelled = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    seen = dict(labelled.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect())
    n = seen.pop(-1, 0)
    df = np.zeros(DIMS)
    for dim, c in seen.items():
        df[dim] = c
    idf = np.log((1 + n) / (1 + df)) + 1
    model = {"idf": idf.astype(np.float32), "centres": np.zeros((0, DIMS), dtype=np.float32), "langs": [], "radii": np.zeros(0)}
    placed = labelled.withColumn("place", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    lettered = F.min(F.when(F.col("text").rlike(LETTER), F.col("place")))
    sizes = stored(placed.groupBy("lang").agg(F.count("*").alias("n"), lettered.alias("first")), "languages")
    share = (F.shiftrightunsigned("place", 11).cast("double") / float(1 << 53)) < SAMPLE_PER_LANG / F.col("n")
    chosen = join_summary(placed.select("lang", "place", "text"), sizes, "lang", sizes.count()).filter(share | (F.col("place") == F.col("first")))
    sample = chosen.groupBy("lang", "place").agg(F.first("text").alias("text"))  # repeated rows once, however many

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [letters(t.as_py()) for t in batch.column(2)]
            rows = [i for i, t in enumerate(kept) if t is not None]
            found = pa.array([unit(counts(kept[i]), idf).tobytes() for i in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), found], names=["lang", "place", "v"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        points = np.stack([np.frombuffer(v, dtype=np.float32) for v in group.sort_values(["place", "v"])["v"]])
        centres, own = kmeans(points, CENTROIDS_PER_LANG)
        rows = []
        for c, centre in enumerate(centres):
            near = points[own == c] @ centre
            rows.append((group["lang"].iloc[0], c, centre.tobytes(), float(np.quantile(near, RADIUS_QUANTILE)) - RADIUS_MARGIN if len(near) else 1.0))
        return pd.DataFrame(rows, columns=["lang", "c", "v", "radius"])

    fitted = sample.mapInArrow(vectors, "lang string, place long, v binary").groupBy("lang").applyInPandas(fit, "lang string, c int, v binary, radius double")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["c"]))
    if rows:
        model |= {"centres": np.stack([np.frombuffer(r["v"], dtype=np.float32) for r in rows]), "langs": [r["lang"] for r in rows], "radii": np.array([r["radius"] for r in rows])}
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score and accepted for each document; only the text decides."""
    idf, centres, langs, radii = model["idf"], model["centres"], model["langs"], model["radii"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, value, accepted = [], [], []
            for text in batch.column(1):
                kept = letters(text.as_py())
                if kept is None or not langs:
                    pred.append("und"), value.append(0.0), accepted.append(False)
                    continue
                cosine = centres @ unit(counts(kept), idf)
                best = int(np.argmax(cosine))
                pred.append(langs[best]), value.append(float(min(1.0, max(0.0, cosine[best])))), accepted.append(bool(cosine[best] >= radii[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(value, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out():
    """True for documents whose crc32 of doc_id leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Trained on what isn't held out, applied to every document."""
    model = train(docs.filter(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out())
