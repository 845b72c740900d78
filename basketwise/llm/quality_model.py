"""Quality as a logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is its words (runs without blanks). Each word counts as itself, lower-cased, and as its shape (capitals, small letters,
digits and marks, each run once; a word that repeats the one before it has a shape of its own). Features are hashes of words and
pairs of words, and of one to three shapes in a row, each with its share of the text's n-grams; so a score doesn't depend on
length, and it is one sparse dot product.

Training: a sample of labelled documents, bounded by sample_rows, is dealt into shards by a hash of the key. In each round every
shard runs the updates over its documents, in the order of the hash, from the state they all share; the states are then averaged,
weighing each shard by its documents. What comes to the driver are `shards` states of 2^bits numbers. Scoring is row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Bounded
from .workspace import stash

BITS, SCALE = 18, 10.0
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_RUN = re.compile(r"(.)\1+")


class _Shapes(dict):
    def __missing__(self, c):
        ch = chr(c)
        self[c] = out = "0" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else ch
        return out


_SHAPES = _Shapes()


def _word(word: bytes) -> int:
    """Hashes of a word and of its shape, 32 bits each."""
    text = word.decode()
    shape = _RUN.sub(r"\1", text.translate(_SHAPES))
    return (xxhash.xxh32_intdigest(text.lower()) << 32) | xxhash.xxh32_intdigest(shape)


class Features:
    """Hashed n-grams of texts, with one bounded table of words."""

    def __init__(self, bits: int = BITS):
        self.shift, self.words = np.uint64(64 - bits), Bounded(_word)

    def of(self, text: str) -> np.ndarray:
        """The bucket of each n-gram of a text."""
        words = text.encode().split()  # of bytes: blanks are those of ASCII
        both = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        s[1:] ^= np.where(w[1:] == w[:-1], np.uint64(0x5BD1E995), np.uint64(0))
        pair = s[:-1] * _M1 + s[1:] * _M2
        parts = (w * _M1, w[:-1] * _M2 + w[1:] * _M3, s * _M3 + _M1, pair + _M3, pair[:-1] + s[2:] * _M3 + _M2)
        h = np.concatenate(parts)
        h ^= h >> np.uint64(31)
        return ((h * _M2) >> self.shift).astype(np.int64)

    def weighed(self, text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, values): each bucket once, with its share; the last bucket is the constant's."""
        found, n = np.unique(self.of(text), return_counts=True)
        return np.append(found, 1 << bits), np.append(n * (SCALE / max(n.sum(), 1)), 1.0)


class Ftrl:
    """Follow the regularised leader, coordinate by coordinate: z and n are all its state."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (_sigmoid(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, train: Column | None, sample_rows: int, shards: int, key: str, text: str, label: str
) -> DataFrame:
    """shard, h, id, label, text of at most sample_rows labelled documents, the same ones whatever the partitions: those with the least
    hash of the key. Null keys and labels are left out; of several labels of a key the least counts, of several texts the least."""
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    own = own if train is None else own.where(train)
    picked = own.groupBy(F.col(key).alias("id")).agg(F.min(label).alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = [tuple(r) for r in picked.collect()]  # bounded by sample_rows
    small = docs.sparkSession.createDataFrame(rows, picked.schema)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(small), "id")
    one = texts.groupBy("id", "label").agg(F.min("text").alias("text"))
    h = F.xxhash64("id")
    return stash(one.select(F.pmod(h, F.lit(shards)).cast("int").alias("shard"), h.alias("h"), "id", "label", "text"), "labelled")


def fit(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = 20_000, shards: int = 4, rounds: int = 6, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002,
    l2: float = 0.001,
) -> np.ndarray:
    """The weights: 2^bits of buckets and the constant. train is a condition on labels: only rows where it is true are learned from.
    Without labels all weights are 0."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    sample = labelled_sample(docs, labels, train, sample_rows, shards, key, text, label)
    how = (alpha, beta, l1, l2)

    def epoch(state):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            model, features = Ftrl(state.value[0].copy(), state.value[1].copy(), *how), Features(bits)
            rows = rows.sort_values(["h", "id"])
            for y, t in zip(rows["label"], rows["text"], strict=True):
                model.update(*features.weighed(t, bits), float(y))
            return pd.DataFrame({"rows": [len(rows)], "z": [model.z.tobytes()], "n": [model.n.tobytes()]})

        return run

    spark = docs.sparkSession
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        # a shard holds sample_rows / shards documents at most
        got = sample.groupBy("shard").applyInPandas(epoch(state), "rows long, z binary, n binary").collect()
        total = sum(r["rows"] for r in got)
        if not total:
            break
        got.sort(key=lambda r: (r["rows"], bytes(r["z"])))  # sums of floats in one order
        z = sum(np.frombuffer(r["z"]) * (r["rows"] / total) for r in got)
        n = sum(np.frombuffer(r["n"]) * (r["rows"] / total) for r in got)
        state.unpersist()
    return Ftrl(z, n, *how).weights()


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability of the label 1. Row by row: no shuffle. Null and empty texts are scored by the constant alone, and
    all texts whole; a column of that name is replaced; an empty table stays empty."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits numbers

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, w = Features(bits), sent.value
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                at = features.of(t or "")
                out[i] = w[at].sum() * (SCALE / max(len(at), 1)) + w[-1]
            yield pd.Series(_sigmoid(out))

    return docs.withColumn(column, scored(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.7, **how) -> DataFrame:
    """docs with score and predicted, learned from labels."""
    scored = score(docs, fit(docs, labels, train, key, text, **how), text)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
