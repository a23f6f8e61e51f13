"""What the text operators share: tables, folds, bounded training samples, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.session import settle

#: Bytes of text that a kernel holds as token arrays at once; one longer document is taken alone.
CHUNK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def raw(text: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")


def sampled(docs: DataFrame, key: Column, per_key: int, seed: int) -> DataFrame:
    """About ``per_key`` documents of every value of ``key`` (few values), by hash of doc_id.

    Values with fewer documents are taken whole.  The choice depends on doc_id
    only, so it is the same on every run and needs no shuffle of texts.
    """
    counts = docs.groupBy(key.alias("k")).count().collect()
    if not counts:
        return docs.where("false")
    share = None
    for r in counts:
        limit = int(min(1.0, per_key / r["count"]) * (2**31 - 1))
        share = (F if share is None else share).when(key == F.lit(r["k"]), F.lit(limit))
    return docs.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**31 - 1)) <= share)


def sharded(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """A training sample in at most ``shards`` parts by hash of doc_id, each in order.

    Every part sends one model state to the driver, so their number is a bound:
    coalesce keeps it even where the session deals keys over more partitions.
    """
    dealt = rows.repartition(shards, F.xxhash64(F.lit(seed), "doc_id")).coalesce(shards)
    return dealt.sortWithinPartitions("doc_id")


def fresh(taken: list[str], n: int) -> list[str]:
    """Names that no column has, whatever its case."""
    low = {c.lower() for c in taken}
    return [name for i in range(len(low) + n) if (name := f"_own{i}") not in low][:n]


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """Rows of (key, ord, ...) with ``pos``, their number in the key from 0, and ``n``, the key's rows.

    Only counts per key and partition are summed in one place for a key.
    """
    order = ["key", "ord", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    placed = settle(dealt.sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
                    .withColumn("part", F.shiftright("at", 33)), f"{label}-sorted")
    counts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    own = Window.partitionBy("key")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select(
        "key", "part", (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("c").over(own).alias("n")), f"{label}-starts")
    return (placed.join(starts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
            .drop("at", "part", "shift", "ord"))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of documents of about ``limit`` bytes: (from, to)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class Interner:
    """Numbers words in the order they come; afterwards the distinct words are at hand."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}

    def add(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        get = ids.get
        out = [get(w) for w in words]
        if None in out:
            put = ids.setdefault
            out = [put(w, len(ids)) for w in words]
        return np.array(out, dtype=np.int64)

    def words(self) -> list[bytes]:
        return list(self.ids)


def tokens(texts: list[bytes], lower: bool) -> tuple[Interner, np.ndarray, np.ndarray]:
    """Words of a run of documents, white space being [\\x20\\x09-\\x0D].

    Returns the distinct words, the word number of every token in order, and
    the number of tokens of every document.
    """
    seen, ids, sizes = Interner(), [], []
    for t in texts:
        words = (t.lower() if lower else t).split()
        sizes.append(len(words))
        ids.append(seen.add(words))
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    return seen, flat, np.array(sizes, dtype=np.int64)


def per_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each document's tokens; 0 where it has none."""
    out, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values.astype(np.float64), (np.cumsum(sizes) - sizes)[some])
    return out


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def keep_rows(docs: DataFrame, judge: Callable[[], Callable[[list[bytes]], np.ndarray]]) -> DataFrame:
    """The rows whose text passes; every column goes through unchanged.

    ``judge`` is called once a task and gives a function from texts (null as
    empty) to a mask.
    """
    names = docs.columns
    at = [c.lower() for c in names].index("text")

    def kernel(batches):
        passes = judge()
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            mask = passes(texts) if texts else np.zeros(0, dtype=bool)
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(kernel, docs.schema)
