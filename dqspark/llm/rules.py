"""Quality rules: fixed minimum rules, then an isolation forest over the rule statistics.

The forest is grown on a bounded sample of labelled rows (random splits of
random subsamples); a document's path length over all trees says how easily it
is set apart.  The threshold is calibrated from all labelled rows: the lowest
anomaly score that turns away at most a given share of the good ones.

Results in special cases: null or empty text: all counts 0 and base_failed; no
labelled rows: only the base rules decide; repeated rows: one row each; a doc_id
labelled more than once counts with its highest label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch, chunks, raw, sampled, tokens
from dqspark.session import settle

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "n_lines", "n_upper", "n_distinct", "n_stops")
_DROP_TO_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = bytes(range(9, 14)) + b" " + bytes(range(0x80, 0xC0))  # white space and UTF-8 continuation bytes
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCHEMA = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in STATISTICS])


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(ids) < 4:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    width = int(ids.max()) + 1
    _, pair = np.unique(ids[:-1] * width + ids[1:], return_inverse=True)
    window = pair[:-1] * width + ids[2:]
    _, inverse, n = np.unique(window, return_inverse=True, return_counts=True)
    twice = n[inverse] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : len(twice) + shift] |= twice
    return int(covered.sum())


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of STATISTICS of every whole text."""

    def kernel(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = []
            for lo, hi in chunks(texts):
                own = texts[lo:hi]
                _, ids, sizes = tokens(own, lower=False)
                at = 0
                for t, n in zip(own, sizes.tolist(), strict=True):
                    lines = [x for x in t.split(b"\n") if x.strip()]
                    mine = ids[at : at + n]
                    at += n
                    rows.append((
                        n, len(t.translate(None, _NOT_CHARS)), len(t) - len(t.translate(None, _DROP_TO_SYMBOLS)),
                        len(lines) - len(set(lines)), repeated_words(mine), len(lines),
                        len(t) - len(t.translate(None, _UPPER)), len(set(mine.tolist())),
                        len(t) - len(t.translate(None, b".!?"))))
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(STATISTICS)).T
            yield batch(_SCHEMA, doc_id=b.column(0), **dict(zip(STATISTICS, columns, strict=True)))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw())
    return rows.mapInArrow(kernel, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Scale-free forms of the statistics, one row per document."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, np.sqrt(s["n_symbols"] / chars),
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words,
        np.log1p(words / np.maximum(s["n_lines"], 1)), np.sqrt(s["n_upper"] / chars),
        s["n_distinct"] ** 1.1 / words, np.sqrt(s["n_stops"] / words),
    ], axis=1).astype(np.float64)


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=np.float64)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), split, left child (right is next), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    subsample: int

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): 0 to 1, higher is easier to set apart."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, length in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return np.exp2(-total / max(len(self.trees), 1) / _expected(self.subsample))


def grow(x: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    depth_limit = int(np.ceil(np.log2(max(size, 2)))) + 4
    grown = []
    for _ in range(trees):
        feature, split, left, length = [-1], [0.0], [0], [0.0]
        todo = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            varied = np.flatnonzero(high > low)
            if len(own) <= 1 or depth >= depth_limit or not len(varied):
                length[node] = depth + float(_expected(len(own)))
                continue
            f = int(rng.choice(varied))
            at = rng.uniform(low[f], high[f])
            side = own[:, f] >= at
            feature[node], split[node], left[node] = f, at, len(feature)
            for part in (own[~side], own[side]):
                feature.append(-1), split.append(0.0), left.append(0), length.append(float(depth + 1))
                if len(part):
                    todo.append((len(feature) - 1, part, depth + 1))
        grown.append((np.array(feature), np.array(split), np.array(left), np.array(length)))
    return Forest(grown, size)


def fit(stats: DataFrame, y: DataFrame, rows: int = 8192, contamination: float = 0.05, trees: int = 100,
        subsample: int = 512, seed: int = 11) -> Forest | None:
    """Forest over about ``rows`` labelled good rows and ``contamination`` times as many bad ones.

    Few and different, the bad rows stretch the ranges that splits are drawn from
    and so end on short paths.  ``rows`` is the documented bound of the sample
    that comes to the driver.
    """
    known = stats.join(y, "doc_id")
    good = sampled(known.where("y = 1"), F.col("y"), rows, seed)
    bad = sampled(known.where("y = 0"), F.col("y"), max(1, int(rows * contamination)), seed)
    pdf = good.unionByName(bad).orderBy("doc_id", *STATISTICS).select(*STATISTICS).toPandas()
    if len(pdf) < 2:
        return None
    return grow(features({c: pdf[c].to_numpy() for c in STATISTICS}), trees, subsample, seed)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """stats with a column anomaly."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    schema = pa.schema([*_SCHEMA, ("anomaly", pa.float64())])

    def kernel(batches):
        for b in batches:
            columns = {c: b.column(i + 1).to_numpy() for i, c in enumerate(STATISTICS)}
            anomaly = shared.value.anomaly(features(columns)) if b.num_rows else []
            yield batch(schema, doc_id=b.column(0), **columns, anomaly=anomaly)

    names = ["doc_id", *STATISTICS]
    return stats.select(*names).mapInArrow(kernel, ", ".join(f"{c} bigint" for c in names) + ", anomaly double")


def calibrate(scored: DataFrame, y: DataFrame, max_clean_loss: float = 0.005, bins: int = 4000) -> float:
    """The lowest threshold that turns away at most this share of the labelled good rows."""
    good = scored.where(~base_failed()).join(y.where("y = 1"), "doc_id")
    counts = dict(good.groupBy(F.ceil(F.col("anomaly") * bins).alias("bin")).count().collect())
    allowed, at = max_clean_loss * sum(counts.values()), bins
    for b in sorted(counts, reverse=True):
        allowed -= counts[b]
        if allowed < 0:
            at = b
            break
    return at / bins


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Counts, base_failed, anomaly and kept of every document.

    The statistics are written once to the shared folder (ten numbers a
    document), so texts are read once.
    """
    stats = settle(statistics(docs), "rules")
    y = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
         .groupBy("doc_id").agg(F.max("quality").alias("y")))
    forest = fit(stats, y, **options)
    if forest is None:
        scored, passed = stats.withColumn("anomaly", F.lit(0.0)), F.lit(True)
    else:
        scored = score(stats, forest)
        passed = F.col("anomaly") <= calibrate(scored, y)
    return scored.select("*", base_failed().alias("base_failed"), (~base_failed() & passed).alias("kept"))
