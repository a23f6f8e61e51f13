"""Toxic spans by a linear-chain conditional random field (CRF) over words.

Labels name documents, so tokens are labelled first: a word, or the first four
to six letters of one, that labelled toxic documents hold far more often than
clean ones marks its tokens.  The CRF (two states, hashed word features,
transitions) learns from those tokens; forward-backward gives every token's
marginal.  A document's score is its highest marginal, which a long text without a
toxic word does not raise; offending tokens have a marginal of 0.5 or more.

Results in special cases: null or empty text: score 0, no spans; no labelled
toxic rows: score 0 for every document; labelled toxic rows, yet no telling word:
every token of a toxic document is labelled toxic; repeated rows: one row each; a
doc_id labelled more than once counts with its highest label.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch, chunks, keep_rows, raw, sampled, sharded
from dqspark.session import settle

BITS = 18
SIZE = 1 << BITS
_CACHE = 400_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BLOCK = 256
THRESHOLD = 0.3


def keys(word: bytes) -> list[bytes]:
    """The word without edge marks, lower-cased, and its first four, five and six letters."""
    w = word.decode("utf-8", "replace").lower().strip(_EDGES.decode())
    out = [b"w" + w.encode()]
    out += [b"p" + w[:k].encode() for k in (4, 5, 6) if len(w) > k]
    return out


def features(word: bytes) -> list[int]:
    """Hashed feature numbers of a word: its keys, its last three letters, its shape; 0 is the bias."""
    own = keys(word)
    w = own[0][1:].decode()
    return [0, *(zlib.crc32(k) % (SIZE - 1) + 1 for k in [*own, b"s" + w[-3:].encode()])]


def mobius(a, b, c, d) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]) from r[-1] = 1, for all t.

    Blocks of positions are walked side by side: first their transforms as
    products of 2 x 2 matrices, then the values on block borders, then all values.
    """
    n = len(a)
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    a, b, c, d = (np.concatenate([v, np.full(pad, k)]).reshape(rows, BLOCK).T.copy()
                  for v, k in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    if rows > 1:
        for k in range(BLOCK):
            p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
    now, border = 1.0, np.ones(rows)
    for k, (w, x, y, z) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        border[k] = now
        now = (w * now + x) / (y * now + z)
    out = np.empty((BLOCK, rows))
    value = border
    for k in range(BLOCK):
        value = (a[k] * value + b[k]) / (c[k] * value + d[k])
        out[k] = value
    return out.T.reshape(-1)[:n]


def forward_backward(emission: np.ndarray, sizes: np.ndarray, chain: np.ndarray):
    """Odds of state 1 against 0 before (forward, own emission included) and after (backward) each token.

    ``chain`` holds the logarithms of moving 0-1, 1-0, 1-1 and of beginning in 1,
    all against 0; documents follow each other, ``sizes`` tokens each.
    """
    move01, move10, move11, begin = np.exp(chain)
    f = np.exp(np.clip(emission, -30, 30))
    n, ones = len(f), np.ones(len(f))
    own = sizes[sizes > 0]
    ends = np.cumsum(own)
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    first[ends - own], last[ends - 1] = True, True
    before = mobius(np.where(first, 0, f * move11), np.where(first, f * begin, f * move01),
                    np.where(first, 0, move10), ones)
    follows = np.append(f[1:], 1.0)
    after = mobius(np.where(last, 0, follows * move11)[::-1], np.where(last, 1, move10)[::-1],
                   np.where(last, 0, follows * move01)[::-1], ones)[::-1]
    return before, after, f, first


@dataclass
class Crf:
    weights: np.ndarray
    chain: np.ndarray

    @staticmethod
    def zero() -> Crf:
        start = np.zeros(SIZE)
        start[0] = -3.0
        return Crf(start, np.array([-1.0, 0.0, -1.0, -1.0]))

    def learn(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], speed: list[np.ndarray], rate: float) -> None:
        """One Adagrad step on documents of (feature numbers, their token, token labels)."""
        sizes = np.array([len(y) for _, _, y in docs])
        offset = np.cumsum(sizes) - sizes
        index = np.concatenate([i for i, _, _ in docs])
        token = np.concatenate([t + o for (_, t, _), o in zip(docs, offset, strict=True)])
        y = np.concatenate([y for _, _, y in docs]).astype(np.float64)
        emission = np.bincount(token, weights=self.weights[index], minlength=len(y))
        before, after, f, first = forward_backward(emission, sizes, self.chain)
        odds = before * after
        error = odds / (1 + odds) - y
        touched, inverse = np.unique(index, return_inverse=True)
        g = np.bincount(inverse, weights=error[token])
        speed[0][touched] += g * g
        self.weights[touched] -= rate * g / np.sqrt(speed[0][touched] + 1)
        inner = ~first[1:]
        prior, here, later = before[:-1][inner], f[1:][inner], after[1:][inner]
        move01, move10, move11, _ = np.exp(self.chain)
        pairs = np.stack([np.ones_like(prior), move01 * here * later, prior * move10, prior * move11 * here * later])
        pairs /= pairs.sum(axis=0)
        was, now = y[:-1][inner], y[1:][inner]
        seen = np.stack([(1 - was) * now, was * (1 - now), was * now])
        p0 = odds[first] / (1 + odds[first])
        g = np.append((pairs[1:] - seen).sum(axis=1), (p0 - y[first]).sum())
        speed[1] += g * g
        self.chain = np.clip(self.chain - rate * g / np.sqrt(speed[1] + 1), -12, 12)


def telling_keys(rows: DataFrame, least: int = 3, share: float = 0.95) -> list[bytes]:
    """Keys that nearly only toxic documents have.

    At least ``least`` toxic documents hold the key, and this (smoothed) share of
    all that do are toxic; no share of all toxic documents is asked for, which
    words of a rare language would not reach.  Copies of a text count once, so that one copied passage makes none of its words telling; where
    in a text a key stands does not matter.

    ``rows`` is the bounded training sample (raw, y); what comes to the driver are
    the keys that pass both rules.
    """
    schema = pa.schema([("key", pa.binary()), ("y", pa.int32()), ("n", pa.int64())])

    def kernel(batches):
        for b in batches:
            for y in (0, 1):
                counts: dict[bytes, int] = {}
                for t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if own == y:
                        for k in {k for w in set(t.split()) for k in keys(w) if len(k) > 3}:
                            counts[k] = counts.get(k, 0) + 1
                yield batch(schema, key=list(counts), y=[y] * len(counts), n=list(counts.values()))

    texts = settle(rows.select("raw", "y").distinct(), "toxic-texts")
    totals = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    counted = texts.mapInArrow(kernel, "key binary, y int, n bigint").groupBy("key").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    bad, good = F.col("bad") / totals.get(1, 1), (F.col("good") + 0.5) / totals.get(0, 1)
    told = counted.where((F.col("bad") >= least) & (bad / (bad + good) >= share))
    return [bytes(r["key"]) for r in told.select("key").toLocalIterator()]


def _round(rows: DataFrame, start: Crf, told: set[bytes], epochs: int, rate: float) -> Crf:
    """One pass of every shard from the same weights; their mean, weighted by rows.

    Without told keys every token of a toxic document counts as toxic.
    """
    shared = rows.sparkSession.sparkContext.broadcast((start.weights, start.chain, told))

    def kernel(batches):
        weights, chain, known = shared.value
        crf, seen = Crf(weights.copy(), chain.copy()), []
        speed = [np.zeros(SIZE), np.zeros(4)]
        cache: dict[bytes, tuple[list[int], bool]] = {}
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = t.split()
                for w in words:
                    if w not in cache:
                        cache[w] = (features(w), not known or any(k in known for k in keys(w)))
                y = np.array([toxic and cache[w][1] for w in words], dtype=np.int8)
                if words and (not toxic or y.any()):  # a toxic document without a telling word says nothing
                    own = [cache[w][0] for w in words]
                    seen.append((np.array([i for x in own for i in x], dtype=np.int32),
                                 np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own]), y))
        rng = np.random.default_rng(len(seen))
        for _ in range(epochs):
            order = rng.permutation(len(seen)).tolist()
            for k in range(0, len(order), 16):
                crf.learn([seen[i] for i in order[k : k + 16]], speed, rate)
        if seen:
            packed = np.concatenate([crf.weights, crf.chain]).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_pydict({"state": pa.array([packed], pa.binary()), "rows": [len(seen)]})

    total, mean = 0, np.zeros(SIZE + 4)
    for r in rows.select("raw", "y").mapInArrow(kernel, "state binary, rows bigint").collect():  # one row a shard
        total += r["rows"]
        mean += r["rows"] * np.frombuffer(r["state"], dtype=np.float32)
    shared.destroy()
    return Crf(mean[:SIZE] / total, mean[SIZE:] / total) if total else start


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2500, shards: int = 4, rounds: int = 3,
          epochs: int = 2, rate: float = 0.5, seed: int = 3) -> Crf | None:
    """Fit on about ``per_label`` labelled documents of each class, the documented bound of the sample.

    ``labels`` (doc_id, toxic) holds only rows that may be learned from.
    """
    y = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
         .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")))
    chosen = F.broadcast(sampled(y, F.col("y"), per_label, seed))  # bounded by per_label
    rows = settle(docs.select("doc_id", raw()).join(chosen, "doc_id"), "toxic-sample")
    if rows.where("y = 1").isEmpty():
        return None
    told = set(telling_keys(rows))
    rows = sharded(rows, shards, seed)
    crf = Crf.zero()
    for _ in range(rounds):
        crf = _round(rows, crf, told, epochs, rate)
    return crf


class _Emissions(dict):
    """word -> sum of its features' weights; remembers up to _CACHE words."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        value = self[word] = float(self.weights[features(word)].sum())
        return value


def _offsets(text: bytes, flagged: np.ndarray) -> str:
    """start:end in code points of the flagged words, comma-joined."""
    spans = []
    at = chars = 0
    marks = set(np.flatnonzero(flagged).tolist())
    for k, m in enumerate(_WORD.finditer(text)):
        if k in marks:
            chars += len(text[at : m.start()].decode())
            word = len(m.group().decode())
            spans.append(f"{chars}:{chars + word}")
            chars, at = chars + word, m.end()
    return ",".join(spans)


class _Reader:
    """Scores and spans of texts under one model, with what it remembers of words."""

    def __init__(self, crf: Crf) -> None:
        self.crf, self.cache = crf, _Emissions(crf.weights)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[str]]:
        scores, spans = np.zeros(len(texts)), [""] * len(texts)
        for lo, hi in chunks(texts):
            if len(self.cache) > _CACHE:
                self.cache.clear()
            look = self.cache.__getitem__
            own = [np.array(list(map(look, t.split())), dtype=np.float64) for t in texts[lo:hi]]
            sizes = np.array([len(x) for x in own])
            if not sizes.sum():
                continue
            before, after, _, _ = forward_backward(np.concatenate(own), sizes, self.crf.chain)
            odds = before * after
            marginal, flagged = odds / (1 + odds), odds >= 1.0
            at = 0
            for k, n in enumerate(sizes.tolist()):
                if n:
                    scores[lo + k] = marginal[at : at + n].max()
                    if flagged[at : at + n].any():
                        spans[lo + k] = _offsets(texts[lo + k], flagged[at : at + n])
                at += n
        return scores, spans


def score(docs: DataFrame, crf: Crf | None, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (offending tokens in code points, end exclusive)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), raw())
    if crf is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
                           F.lit("").alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32()), ("spans", pa.string())])

    def kernel(batches):
        read = _Reader(shared.value)
        for b in batches:
            scores, spans = read(b.column(2).to_pylist())
            yield batch(schema, doc_id=b.column(0), held_out=b.column(1), score=scores,
                        predicted=(scores >= threshold).astype(np.int32), spans=spans)

    return rows.mapInArrow(kernel, "doc_id bigint, held_out boolean, score double, predicted int, spans string")


def keep_clean(docs: DataFrame, crf: Crf | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are, without a shuffle."""
    if crf is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def judge():
        read = _Reader(shared.value)
        return lambda texts: read(texts)[0] < threshold

    return keep_rows(docs, judge)
