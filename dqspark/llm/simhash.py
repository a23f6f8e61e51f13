"""SimHash near duplicates through an inverted index of byte positions.

Fingerprints that differ in at most four of 64 bits share at least four of their
eight bytes (in place).  The index is keyed by triples of byte positions; twenty
triples are enough to hit every choice of four positions, so linked fingerprints
meet under some key.  Under a key the shared bytes of a pair are tallied, pairs
with fewer than four are dropped, and the rest are verified by their bits.

Only classes of equal fingerprints are compared, and a key's rows give a spanning
forest of their links, never all pairs: what is reachable stays reachable.  Keys
with more than ``limit`` fingerprints are split by five more segments of the bits
they do not share yet (two linked fingerprints agree in one of five), again and
again; after four splits the free bits bound a key's rows to 2 ** 17.

Results in special cases: null or empty text: fingerprint 0, linked like any
other; fewer than four words: one shingle of all of them; a null doc_id takes
its class' component; repeated rows: one row each, in the same component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch, fresh, raw
from dqspark.operators.components import components
from dqspark.session import settle

WIDTH = 4  # words in a shingle
SEED = 42
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
SPLITS = 4
_MARKED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEYED = pa.schema([("k", pa.int64()), ("mask", pa.int64()), ("fp", pa.int64()), ("id", pa.int64())])


def triples() -> list[tuple[int, ...]]:
    """Byte triples that hit every four of eight positions.

    Positions fall into three classes in a ring; a triple lies in one class, or
    has two positions in one class and one in the next.
    """
    classes = (range(0, 3), range(3, 6), range(6, 8))
    found = [t for c in classes for t in combinations(c, 3)]
    for i, c in enumerate(classes):
        found += [(*pair, x) for pair in combinations(c, 2) for x in classes[(i + 1) % 3]]
    return found


def fingerprint(text: bytes) -> int:
    """Unsigned 64 bits; a bit is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(len(words) - WIDTH + 1, 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(WIDTH, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; fp as a signed number."""

    def kernel(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield batch(_FP, doc_id=b.column(0), fp=fps.view(np.int64))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw())
    return rows.mapInArrow(kernel, "doc_id bigint, fp bigint")


def _index(classes: DataFrame) -> DataFrame:
    """Postings (k, mask, fp, id): k hashes a byte triple and its values; mask has the bits that k fixes."""
    masks = [sum(255 << 8 * p for p in t) for t in triples()]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    each = classes.select("fp", "id", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    return each.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("k"), "mask", "fp", "id")


def _split(rows: DataFrame) -> DataFrame:
    """Five longer keys for each posting: its own and one of five segments of the bits still free."""

    def kernel(batches):
        for b in batches:
            k, mask, fp, ids = (b.column(i).to_numpy() for i in range(4))
            for m in np.unique(mask).tolist():
                own = mask == m
                free = [j for j in range(64) if not m >> j & 1]
                for part in np.array_split(np.array(free, dtype=np.uint64), MAX_BITS + 1):
                    wide = np.uint64(m & (2**64 - 1))
                    for j in part:
                        wide |= np.uint64(1) << j
                    n = int(own.sum())
                    yield batch(_KEYED, k=k[own], mask=np.full(n, wide).view(np.int64), fp=fp[own], id=ids[own])

    deeper = rows.mapInArrow(kernel, "k bigint, mask bigint, fp bigint, id bigint")
    return deeper.withColumn("k", F.xxhash64("k", "mask", F.col("fp").bitwiseAND(F.col("mask"))))


def linked(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Tally shared positional bytes, then verify the pairs with enough of them by their bits."""
    differ = np.bitwise_xor(one, others)
    enough = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_BYTES
    enough[enough] = np.bitwise_count(differ[enough]) <= MAX_BITS
    return enough


def forest(fp: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what links join: each fingerprint reached looks for those not reached yet."""
    edges, rest = [], np.arange(len(fp))
    while len(rest):
        reach, rest = [int(rest[0])], rest[1:]
        while reach and len(rest):
            at = reach.pop()
            hit = linked(fp[at], fp[rest])
            new = rest[hit].tolist()
            edges += [(int(ids[at]), int(ids[k])) for k in new]
            reach += new
            rest = rest[~hit]
    return edges


def _forests(rows: DataFrame) -> DataFrame:
    """Edges of every key's rows; rows arrive sorted, so one key is held at a time."""

    def kernel(batches):
        held = [np.zeros(0, dtype=np.int64)] * 3
        for b in _and_end(batches):
            if b is not None:
                held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            k = held[0]
            if not len(k):
                continue
            begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            whole = len(k) if b is None else int(begin[-1])  # the last key may go on
            begin = begin[begin < whole]
            size = np.diff(np.append(begin, whole))
            fp, ids = held[1].view(np.uint64), held[2]
            two = begin[size == 2]
            near = linked(fp[two], fp[two + 1]) if len(two) else np.zeros(0, dtype=bool)
            a, c = ids[two[near]].tolist(), ids[two[near] + 1].tolist()
            for s, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for x, y in forest(fp[s : s + n], ids[s : s + n]):
                    a.append(x), c.append(y)
            yield batch(_EDGE, a=a, b=c)
            held = [h[whole:] for h in held]

    return (rows.select("k", "fp", "id").repartition("k").sortWithinPartitions("k")
            .mapInArrow(kernel, "a bigint, b bigint"))


def _and_end(batches):
    yield from batches
    yield None


def links(classes: DataFrame, limit: int = 4096) -> DataFrame:
    """Edges (a, b) between ids of classes (fp, id) that keep every link's reachability."""
    rows, done = _index(classes), None
    for level in range(SPLITS + 1):
        hot = None
        if level < SPLITS:
            hot = settle(rows.groupBy("k").count().where(F.col("count") > limit).select("k"), "simhash-hot")
            if hot.isEmpty():
                hot = None
        leaf = rows if hot is None else rows.join(hot, "k", "left_anti")
        done = leaf if done is None else done.unionByName(leaf)
        if hot is None:
            break
        rows = settle(_split(rows.join(hot, "k", "left_semi")), "simhash-split")
    return _forests(done)


def group(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable."""
    fps = settle(fingerprints(docs), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("id"))
    joined = components(links(classes.where("id IS NOT NULL"), limit), "simhash-links")
    named = classes.join(joined, "id", "left")
    named = named.select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: the smallest doc_id, of a doc_id that comes more than once the smallest fingerprint.

    Classes of equal fingerprints are linked by the fingerprint, so rows without a
    doc_id, or with one that other texts have too, are like any others: a unique
    text stays.  Rows without a doc_id come after the others of their component.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("th"), raw())

    def kernel(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield batch(_MARKED, doc_id=b.column(0), th=b.column(1), fp=fps.view(np.int64))

    marked = settle(rows.mapInArrow(kernel, "doc_id bigint, th bigint, fp bigint"), "simhash-rows")
    classes = marked.select("fp").distinct().withColumn("id", F.col("fp"))
    joined = components(links(classes), "simhash-links").withColumnRenamed("id", "fp")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "th")).alias("best")
    firsts = marked.groupBy("fp").agg(best).join(joined, "fp", "left")
    firsts = firsts.groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("best").alias("best"))
    doc, text = fresh(docs.columns, 2)
    firsts = settle(firsts.select(F.col("best.doc_id").alias(doc), F.col("best.th").alias(text)), "simhash-firsts")
    kept = docs.join(firsts, _text_hash().eqNullSafe(F.col(text)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi")
    again = marked.groupBy("doc_id", "th").count().where("count > 1").select(
        F.col("doc_id").alias(doc), F.col("th").alias(text))
    match = firsts[text].eqNullSafe(again[text]) & firsts[doc].eqNullSafe(again[doc])
    if firsts.join(again, match, "left_semi").isEmpty():
        return kept
    return kept.withColumn(text, _text_hash()).dropDuplicates(["doc_id", text]).drop(text)


def _text_hash() -> Column:
    """64 bits of the text, null as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
