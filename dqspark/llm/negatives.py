"""Hard negatives of embeddings by exact integer scores.

Vectors become integers, floor(256 x).  The score of an anchor and a candidate is
their inner product, computed tile by tile with Strassen's recursion: a tile of
anchors times a tile of candidates, zero-padded to halves that divide evenly,
seven products instead of eight a level.  All sums are of int64, hence exact.

Candidates stream through the tasks once for the positives and once for the
negatives.  A task keeps a heap a query: the best ``k`` other rows of the
anchor's label, or, for each anchor and positive, the best ``k`` rows of other
labels whose score lies in the positive's window.  Heaps of tasks merge by
ranking, each task sending ``k`` entries at most.

The anchors are the stated query set, taken in rounds of ``ROUND_BYTES``, which
is what is broadcast at most; each round reads all candidates.

Results in special cases: rows with a null id or label, a null vector, a null or
non-finite component take no part; shorter vectors count as padded with zeros;
equal scores go by the smaller id; rows that share an id are never each other's
positives, and each is a candidate of its own; no anchors or an empty table: no
rows; components so large that a score may pass 63 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.text import batch, numbered
from dqspark.session import settle

SCALE = 256
WINDOW = (80, 100)  # percent of the positive's score
KEEP = 5
LEAF = 8  # a side of this size is multiplied directly
ANCHORS, CANDIDATES = 256, 2048  # sides of a tile
ROUND_BYTES = 16_000_000
NONE = np.iinfo(np.int64).min
_HEAP = pa.schema([("query", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_HEAP_SQL = "query bigint, slot int, id bigint, score bigint"
RESULT_SQL = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
              "negative_score bigint")


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two int64 matrices."""
    (m, k), n = a.shape, b.shape[1]
    levels, side = 0, min(m, k, n)
    while side > LEAF:
        levels, side = levels + 1, -(-side // 2)
    even = 2**levels
    a = np.pad(a, ((0, -m % even), (0, -k % even)))
    b = np.pad(b, ((0, -k % even), (0, -n % even)))
    return _product(a, b, levels)[:m, :n]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), dtype=np.int64)
    p = _product(a11 + a22, b11 + b22, levels - 1)
    out[:m, :n], out[m:, n:] = p, p
    p = _product(a21 + a22, b11, levels - 1)
    out[m:, :n] = p
    out[m:, n:] -= p
    p = _product(a11, b12 - b22, levels - 1)
    out[:m, n:] = p
    out[m:, n:] += p
    p = _product(a22, b21 - b11, levels - 1)
    out[:m, :n] += p
    out[m:, :n] += p
    p = _product(a11 + a12, b22, levels - 1)
    out[:m, :n] -= p
    out[:m, n:] += p
    out[m:, n:] += _product(a21 - a11, b11 + b12, levels - 1)
    out[:m, :n] += _product(a12 - a22, b21 + b22, levels - 1)
    return out


class Heaps:
    """The ``k`` best (score, id) of each query, the best first; equal scores go by the smaller id."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), NONE, dtype=np.int64)
        self.ids = np.zeros((queries, k), dtype=np.int64)

    def least(self, lo: int, hi: int) -> np.ndarray:
        """The score that an entry of these queries must reach."""
        return self.scores[lo:hi, -1]

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge entries of any queries."""
        k = self.scores.shape[1]
        met = np.unique(query)
        old_query = np.repeat(met, k)
        old_scores, old_ids = self.scores[met].ravel(), self.ids[met].ravel()
        held = old_scores != NONE
        query = np.concatenate([old_query[held], query])
        scores = np.concatenate([old_scores[held], scores])
        ids = np.concatenate([old_ids[held], ids])
        order = np.lexsort((ids, -scores, query))
        query, scores, ids = query[order], scores[order], ids[order]
        begin = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        best = place < k
        self.scores[query[best], place[best]] = scores[best]
        self.ids[query[best], place[best]] = ids[best]

    def entries(self):
        """query, place, score and id of what is held."""
        query, place = np.nonzero(self.scores != NONE)
        return query, place, self.scores[query, place], self.ids[query, place]


def usable(table: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): rows that take part, components as integers."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & fine).select(
        "vec_id", "label", whole.alias("v"))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of ``dim`` integers; shorter ones end in zeros, what a query has no component for is left out."""
    starts = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    if (sizes == dim).all():
        return flat[starts[0] : starts[-1]].reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    kept = np.minimum(sizes, dim)
    row = np.repeat(np.arange(len(sizes)), kept)
    at = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
    out[row, at] = flat[np.repeat(starts[:-1], kept) + at]
    return out


class Anchors:
    """The queries of a round: numbers, ids, labels and vectors, and the largest size of a component."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.query, self.ids, self.labels = (rows[c].to_numpy().astype(np.int64) for c in ("pos", "vec_id", "label"))
        lists = rows["v"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.dim = max(int(np.diff(lists.offsets.to_numpy()).max(initial=0)), 1)
        self.vectors = _matrix(lists, self.dim)
        self.largest = float(np.abs(self.vectors.astype(np.float64)).max(initial=0.0))

    def tiles(self, batches):
        """(first, last) of a run of queries, their scores with a run of candidates, the candidates' ids and labels."""
        for b in batches:
            ids, labels, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), self.dim)
            size = float(np.abs(vectors.astype(np.float64)).max(initial=0.0))
            if self.dim * max(size, 1.0) * max(self.largest, 1.0) * max(WINDOW) >= 2.0**62:
                raise OverflowError("scores may not fit 64 bits")
            for s in range(0, len(ids), CANDIDATES):
                own = slice(s, s + CANDIDATES)
                turned = np.ascontiguousarray(vectors[own].T)
                for lo in range(0, len(self.ids), ANCHORS):
                    hi = min(lo + ANCHORS, len(self.ids))
                    yield lo, hi, strassen(self.vectors[lo:hi], turned), ids[own], labels[own]


def _ranked(heaps: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query and slot over all tasks, with their rank."""
    order = Window.partitionBy("query", "slot").orderBy(F.col("score").desc(), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(candidates: DataFrame, anchors, k: int) -> DataFrame:
    def kernel(batches):
        a = anchors.value
        heaps = Heaps(len(a.ids), k)
        for lo, hi, s, ids, labels in a.tiles(batches):
            fits = (a.labels[lo:hi, None] == labels) & (a.ids[lo:hi, None] != ids) & (s >= heaps.least(lo, hi)[:, None])
            row, col = np.nonzero(fits)
            heaps.add(row + lo, s[row, col], ids[col])
        query, _, scores, ids = heaps.entries()
        yield batch(_HEAP, query=a.query[query], slot=np.zeros(len(query), np.int32), id=ids, score=scores)

    return _ranked(candidates.mapInArrow(kernel, _HEAP_SQL), k)


def _negatives(candidates: DataFrame, anchors, positives, k: int, slots: int, window: tuple[int, int]) -> DataFrame:
    """Heaps of the windows; ``positives`` are the scores by query and slot, NONE where there is none."""

    def kernel(batches):
        a, top = anchors.value, positives.value
        lowest = np.where(top == NONE, np.iinfo(np.int64).max, -(-window[0] * np.where(top == NONE, 0, top) // 100))
        highest = np.where(top == NONE, NONE, window[1] * np.where(top == NONE, 0, top) // 100)
        heaps = [Heaps(len(a.ids), k) for _ in range(slots)]
        for lo, hi, s, ids, labels in a.tiles(batches):
            other = a.labels[lo:hi, None] != labels
            for slot, heap in enumerate(heaps):
                least = np.maximum(heap.least(lo, hi), lowest[lo:hi, slot])
                row, col = np.nonzero(other & (s >= least[:, None]) & (s <= highest[lo:hi, slot, None]))
                heap.add(row + lo, s[row, col], ids[col])
        for slot, heap in enumerate(heaps):
            query, _, scores, ids = heap.entries()
            yield batch(_HEAP, query=a.query[query], slot=np.full(len(query), slot, np.int32), id=ids, score=scores)

    return _ranked(candidates.mapInArrow(kernel, _HEAP_SQL), k)


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = KEEP, negatives: int = KEEP,
         window: tuple[int, int] = WINDOW, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ``usable`` rows.

    ``window``: percent of the positive's score that a negative's must lie between.
    """
    spark = rows.sparkSession
    candidates = settle(rows, "negatives-rows")
    asked = candidates.where(is_anchor).select(F.lit(0).alias("key"), F.col("vec_id").alias("ord"), "vec_id", "label", "v")
    anchors = settle(numbered(asked, "anchors"), "anchors")
    count, dim = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    step = max(1, round_bytes // (8 * dim + 64))
    found = spark.createDataFrame([], RESULT_SQL)
    for lo in range(0, count, step):
        own = Anchors(anchors.where(F.col("pos").between(lo, lo + step - 1)).select("pos", "vec_id", "label", "v").toArrow())
        shared = spark.sparkContext.broadcast(own)
        places = {int(q): i for i, q in enumerate(own.query)}
        best = settle(_positives(candidates, shared, positives), "positives")
        top = np.full((len(own.ids), positives), NONE, dtype=np.int64)
        for r in best.select("query", "rank", "score").toLocalIterator():
            top[places[r["query"]], r["rank"] - 1] = r["score"]
        low = _negatives(candidates, shared, spark.sparkContext.broadcast(top), negatives, positives, window)
        named = best.select("query", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
        done = low.select("query", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
                          ).join(named, ["query", "slot"])
        ids = anchors.select(F.col("pos").alias("query"), F.col("vec_id").alias("anchor_id"))
        part = done.join(ids, "query").select(*found.columns)
        found = found.union(settle(part, "negatives"))
    return found
