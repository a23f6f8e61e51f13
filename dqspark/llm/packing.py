"""Batches of similar length: optimal length buckets, then token-budget batches inside each.

Lengths are counted once and stored.  Dynamic programming over the histogram of
all lengths picks the bucket boundaries with the least padding; the best cut moves
only up with the length, so halving the ranges finds each layer in d log d steps.
The histogram has a row for each distinct length, at most as many as the longest
document has words; it is all that reaches the driver.  Inside a bucket a batch takes as many documents
as fit the budget when all are padded to the bucket's length; a bucket with many
documents is dealt over independent slots, each with its own last batch.

Results in special cases: null or empty text: length 0, batched like any other;
a document longer than the budget: a batch of its own, whole; repeated rows: one
row each; no rows: no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.session import settle

WORD = r"[^\x20\x09-\x0D]+"


def length(text: str = "text") -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _layer(best: np.ndarray, top: np.ndarray, count: np.ndarray, length_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j classes with one bucket more than ``best``, and the first best cut of each j."""
    d = len(top)
    now, cut = np.full(d + 1, np.inf), np.zeros(d + 1, dtype=np.int64)
    low, high = np.array([1]), np.array([d])  # ranges of j
    first, last = np.array([0]), np.array([d - 1])  # where their cuts lie
    while len(low):
        mid = (low + high) // 2
        end = np.minimum(last, mid - 1)
        size = end - first + 1
        start = np.cumsum(size) - size
        own = np.repeat(np.arange(len(mid)), size)
        i = np.arange(size.sum()) - start[own] + first[own]
        j = mid[own]
        cost = best[i] + top[j - 1] * (count[j] - count[i]) - (length_sum[j] - length_sum[i])
        least = np.minimum.reduceat(cost, start)
        at = np.minimum.reduceat(np.where(cost == least[own], i, d), start)
        now[mid], cut[mid] = least, at
        low, high, first, last = (np.concatenate(x) for x in (
            (low, mid + 1), (mid - 1, high), (first, at), (at, last)))
        left = low <= high
        low, high, first, last = low[left], high[left], first[left], last[left]
    return now, cut


def boundaries(top: np.ndarray, rows: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths with the least padding for classes in order: longest, rows, sum of lengths of each."""
    d = len(top)
    if d == 0:
        return []
    count = np.append(0, np.cumsum(rows)).astype(np.float64)
    length_sum = np.append(0, np.cumsum(total)).astype(np.float64)
    best = np.full(d + 1, np.inf)
    best[0] = 0.0
    choices = []
    for _ in range(min(buckets, d)):
        best, cut = _layer(best, top.astype(np.float64), count, length_sum)
        choices.append(cut)
    at, found = d, []
    for cut in reversed(choices):
        if at == 0:
            break
        found.append(int(top[at - 1]))
        at = int(cut[at])
    return found[::-1]


def plan(lengths: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """(bucket length, documents) of the best buckets for the column n_tokens."""
    pdf = lengths.groupBy(F.col("n_tokens").alias("top")).agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values("top")
    top, rows = (pdf[c].to_numpy(dtype=np.int64) for c in ("top", "rows"))
    ends = boundaries(top, rows, top * rows, buckets)
    place = np.searchsorted(ends, pdf["top"].to_numpy(dtype=np.int64))
    sizes = np.bincount(place, weights=pdf["rows"].to_numpy(dtype=np.int64), minlength=len(ends))
    return [(e, int(n)) for e, n in zip(ends, sizes, strict=True)]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16_384, slot_rows: int = 8192) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch of every document.

    ``batch`` names the bucket, the slot and the batch in it; a batch's documents
    times bucket_length stay within ``budget``, except for a document alone.
    """
    lengths = settle(docs.select("doc_id", length().alias("n_tokens")), "lengths")
    found = plan(lengths, buckets)
    bucket, size, slots = F.lit(0), F.lit(0), F.lit(1)
    for k in range(len(found) - 1, -1, -1):
        end, rows = found[k]
        here = F.col("n_tokens") <= end
        bucket = F.when(here, F.lit(k)).otherwise(bucket)
        size = F.when(here, F.lit(end)).otherwise(size)
        slots = F.when(here, F.lit(max(1, -(-rows // slot_rows)))).otherwise(slots)
    dealt = lengths.select(
        "doc_id", "n_tokens", bucket.alias("bucket"), size.cast("bigint").alias("bucket_length"),
        F.pmod(F.xxhash64("doc_id", "n_tokens"), slots).alias("slot"))
    order = Window.partitionBy("bucket", "slot").orderBy("n_tokens", "doc_id")
    fit = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1))
    number = F.floor((F.row_number().over(order) - 1) / fit)
    return dealt.select("doc_id", "n_tokens", "bucket", "bucket_length",
                        F.concat_ws("-", "bucket", "slot", number).alias("batch"))
