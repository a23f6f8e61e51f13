"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features are words, word pairs, the words' shapes (case, digits, symbols) and
how much of the pairs repeat; each counts with its share of the text, so a score
is one sparse dot product.  Training runs in shards that start every round from
the mean of all shards' FTRL state.

Results in special cases: null or empty text: the score of the bias alone; no
labelled rows, or one class only: that class' share smoothed by one; repeated
rows: one row each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch, keep_rows, raw, sampled, sharded
from dqspark.session import settle

BITS = 18
SIZE = 1 << BITS
SCALE = 10.0
THRESHOLD = 0.5
_SHAPE = bytes(48 if chr(i).isdigit() else 65 if 65 <= i < 91 else 97 if 97 <= i < 123 or i > 127 else i
               for i in range(256))
_CACHE = 400_000
_STATE = "state binary, rows bigint"


class Words(dict):
    """word -> hash of the word and of its shape, packed; remembers up to _CACHE words."""

    def __missing__(self, word: bytes) -> int:
        shape = word.translate(_SHAPE)
        packed = zlib.crc32(word) << 32 | zlib.crc32(shape[:1] + shape[-4:])
        self[word] = packed
        return packed


def indices(text: bytes, words: Words) -> np.ndarray:
    """Hashed feature numbers of a text, repeats included; the bias (0) is left out."""
    if len(words) > _CACHE:
        words.clear()
    packed = np.array(list(map(words.__getitem__, text.split())), dtype=np.uint64)
    if not len(packed):
        return np.zeros(0, dtype=np.int64)
    word, shape = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ word[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    shapes = shape[:-1] * np.uint64(0xD6E8FEB86659FD93) ^ shape[1:] * np.uint64(0xA0761D6478BD642F)
    repeats = int(20 * len(np.unique(pair)) / len(pair)) if len(pair) else 0
    extra = np.full(len(packed), 0xABCDEF + repeats, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    every = np.concatenate([word * np.uint64(0x9E3779B97F4A7C15), pair, shape * np.uint64(0xD6E8FEB86659FD93),
                            shapes, extra])
    return (every >> np.uint64(64 - BITS)).astype(np.int64) | 1  # odd: apart from the bias


@dataclass
class Ftrl:
    """FTRL-proximal state: z and n of each feature."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1

    @staticmethod
    def zero() -> Ftrl:
        return Ftrl(np.zeros(SIZE), np.zeros(SIZE))

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def example(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values, bias first."""
    found = indices(text, words)
    i, n = np.unique(found, return_counts=True)
    return np.concatenate([[0], i]), np.concatenate([[1.0], SCALE * n / max(len(found), 1)])


def _round(rows: DataFrame, start: Ftrl, epochs: int) -> Ftrl:
    """One pass of every shard from the same state; the mean of the states, weighted by rows."""
    shared = rows.sparkSession.sparkContext.broadcast((start.z, start.n))

    def kernel(batches):
        state, words, seen = Ftrl(*(a.copy() for a in shared.value)), Words(), []
        for b in batches:
            seen += [(example(t, words), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        rng = np.random.default_rng(len(seen))
        for _ in range(epochs):
            for k in rng.permutation(len(seen)).tolist():
                (i, x), y = seen[k]
                state.learn(i, x, y)
        if seen:
            packed = np.stack([state.z, state.n]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_pydict({"state": pa.array([packed], pa.binary()), "rows": [len(seen)]})

    total, mean = 0, np.zeros((2, SIZE))
    for r in rows.select("raw", "y").mapInArrow(kernel, _STATE).collect():  # one row a shard
        total += r["rows"]
        mean += r["rows"] * np.frombuffer(r["state"], dtype=np.float32).reshape(2, SIZE)
    shared.destroy()
    return Ftrl(mean[0] / total, mean[1] / total)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", per_label: int = 4000, shards: int = 4,
          rounds: int = 3, epochs: int = 2, seed: int = 5) -> np.ndarray | float:
    """Weights (float32), fitted on about ``per_label`` labelled rows of each class.

    That is the documented bound of the sample; ``labels`` holds only rows that
    may be learned from.  The classes' shares in all labels set the bias.
    """
    y = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
         .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y")))
    counts = dict(y.groupBy("y").count().collect())
    if len(counts) < 2:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = F.broadcast(sampled(y, F.col("y"), per_label, seed))  # bounded by per_label
    rows = settle(docs.select("doc_id", raw()).join(chosen, "doc_id"), "quality-sample")
    rows = sharded(rows, shards, seed)
    state = Ftrl.zero()
    own = dict(rows.groupBy("y").count().collect())
    if len(own) < 2:
        return (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    for _ in range(rounds):
        state = _round(rows, state, epochs)
    w = state.weights()
    w[0] += np.log(counts[1] / counts[0]) - np.log(own[1] / own[0])
    return w.astype(np.float32)


def probabilities(texts: list[bytes], w: np.ndarray, words: Words) -> np.ndarray:
    """Of label 1: one sparse dot product for each text."""
    logits = np.empty(len(texts))
    for k, t in enumerate(texts):
        i = indices(t, words)
        logits[k] = float(w[0]) + SCALE * float(w[i].sum(dtype=np.float64)) / max(len(i), 1)
    return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray | float, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), raw())
    if isinstance(weights, float):
        return rows.select("doc_id", "held_out", F.lit(weights).alias("score"),
                           F.lit(int(weights >= threshold)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32())])

    def kernel(batches):
        words = Words()
        for b in batches:
            p = probabilities(b.column(2).to_pylist(), shared.value, words)
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), score=p,
                        predicted=(p >= threshold).astype(np.int32))

    return rows.mapInArrow(kernel, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted 1, all columns as they are, without a shuffle."""
    if isinstance(weights, float):
        return docs if weights >= threshold else docs.where("false")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def judge():
        words = Words()
        return lambda texts: probabilities(texts, shared.value, words) >= threshold

    return keep_rows(docs, judge)
