"""Merkle manifest of a dataset: a leaf for every document, a root for every source, one root for all.

Leaves of a source ascend by doc_id; runs of three consecutive nodes become their
parent until one node is left, the source's root; the roots of the sources, in
order of the source, give the root of the dataset in the same way.

Nodes get their number in their source from a range-sorted table (a partition's
first number is the count of the source's rows in the partitions before it), so a
source of any size spreads over many tasks.  A chunk of 3**6 consecutive nodes is
a whole subtree: its six levels are windows over one sorted chunk.  At level j
only the first row of every 3**j rows holds a node; its siblings are the rows at
the fixed offsets 3**j and 2 * 3**j before (lag) and behind (lead), masked by its
slot in the run and by the length of the run; the first child of a run hashes the
parent.  On the way down, rows of slot 1 and 2 take their parent's path by lag.
The chunks' nodes are the next table, 729 times smaller.

Results in special cases: null fields are ``-`` in the leaf; a null source is a
source of its own and the first; documents without a doc_id come first in their
source; documents that share a doc_id are ordered by their leaf, and equal rows
are leaves of their own; empty and very long texts are hashed whole; a source
with one document has its leaf as root and an empty proof; an empty table has no
rows and the root None; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.llm.text import numbered
from dqspark.session import settle

RUN = 3
LEVELS = 6  # per chunk
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _written(value: Column) -> Column:
    """UTF-8 byte count, colon, value; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a document's fields; ``text`` stands in for the text."""
    fields = [F.col(c) for c in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return _digest(*map(_written, fields))


def _siblings(j: int) -> tuple[Column, Column, Column]:
    """Whether a row holds a node of level ``j`` that has a parent; digests left and right of it in its run."""
    step, node = RUN**j, Window.partitionBy("key", "chunk").orderBy("pos")
    at, nodes = F.expr(f"pos div {step}"), F.expr(f"(n + {step - 1}) div {step}")
    slot, none = at % RUN, F.lit("")
    before = [F.lag("node", d * step).over(node) for d in (1, 2)]
    behind = [F.lead("node", d * step).over(node) for d in (1, 2)]
    left = F.when(slot == 2, F.concat(before[1], before[0])).when(slot == 1, before[0]).otherwise(none)
    right = F.concat(F.when((slot < 2) & (at + 1 < nodes), behind[0]).otherwise(none),
                     F.when((slot == 0) & (at + 2 < nodes), behind[1]).otherwise(none))
    return (F.col("pos") % step == 0) & (nodes > 1), left, right


def _climb(nodes: DataFrame, levels: int) -> DataFrame:
    """Adds ``chunk``, ``top`` (its node, on its first row) and ``path``, the siblings of each level, lowest first."""
    out = nodes.withColumn("chunk", F.expr(f"pos div {RUN**levels}")).withColumn("own", F.col("node"))
    for j in range(levels):
        inner, left, right = _siblings(j)
        out = out.withColumns({"inner": inner, "left": left, "right": right}).withColumn(
            f"s{j}", F.when(F.col("inner"), F.struct("left", "right")))
        parent = F.when(F.col("inner"), _digest(F.col("node"), F.col("right"))).otherwise(F.col("node"))
        out = out.withColumn("node", F.when(F.col("pos") % RUN ** (j + 1) == 0, parent)).drop("inner", "left", "right")
    out = out.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    row = Window.partitionBy("key", "chunk").orderBy("pos")
    for j in reversed(range(levels)):
        step = RUN**j
        slot = F.expr(f"pos div {step}") % RUN
        above = F.when(slot == 0, F.col("path"))
        for d in (1, 2):
            above = above.when(slot == d, F.lag("path", d * step).over(row))
        out = out.withColumn("path", above).withColumn("path", F.when(F.col(f"s{j}").isNotNull(), F.concat(
            F.array(f"s{j}"), "path")).otherwise(F.col("path"))).drop(f"s{j}")
    return out.withColumnsRenamed({"node": "top", "own": "node"})


def _tree(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes with their paths in the chunk, lowest first, and (key, top): the last node of every key."""
    tiers, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        levels = next(k for k in range(LEVELS + 1) if k == LEVELS or RUN**k >= most)
        tier = settle(_climb(nodes, levels), label)
        tiers.append(tier)
        chunk = RUN**levels
        tops = tier.where(F.col("pos") % chunk == 0)
        if most <= chunk:
            return tiers, tops.select("key", "top")
        most = -(-most // chunk)
        nodes = tops.select("key", F.col("chunk").alias("pos"), F.expr(f"(n + {chunk - 1}) div {chunk}").alias("n"),
                            F.col("top").alias("node"))


def _descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest tier with whole paths; ``tops`` has (key, upper, ...) for every key and its columns are kept."""
    more = [c for c in tops.columns if c not in ("key", "upper")]
    above = tops.withColumn("chunk", F.lit(0).cast("bigint"))
    for tier in reversed(tiers):
        whole = tier.join(above, ["key", "chunk"]).withColumn("path", F.concat("path", "upper"))
        above = whole.select("key", F.col("pos").alias("chunk"), F.col("path").alias("upper"), *more)
    return whole.drop("upper")


@dataclass
class Manifest:
    """``rows``: doc_id, leaf, altered (the leaf of the altered text), subroot, path; ``root``: None if there are no rows."""

    rows: DataFrame
    root: str | None


def build(docs: DataFrame, altered_text: Column | None = None) -> Manifest:
    """Leaves, roots and proofs of all documents.

    A path holds, from the leaf to the root, the digests left and right of the
    node in its run.  ``altered_text`` replaces the texts in ``altered`` only.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        leaf().alias("node"), leaf(altered_text).alias("altered"), F.col("doc_id").cast("bigint").alias("doc_id"))
    rows = numbered(settle(leaves.withColumn("ord", F.struct("doc_id", "node")), "merkle-leaves"), "merkle-leaves")
    tiers, subroots = _tree(rows, "merkle-nodes")
    sources = subroots.select(F.lit("").alias("key"), F.struct("key").alias("ord"), F.col("key").alias("source"),
                              F.col("top").alias("node"))
    upper, last = _tree(numbered(sources, "merkle-subroots"), "merkle-sources")
    root = last.first()
    top = last.select("key", F.array().cast("array<struct<left:string,right:string>>").alias("upper"))
    tops = _descend(upper, top).select(F.col("source").alias("key"), F.col("node").alias("subroot"),
                                       F.col("path").alias("upper"))
    whole = _descend(tiers, tops)
    return Manifest(whole.select("doc_id", F.col("node").alias("leaf"), "altered", "subroot", "path"),
                    root["top"] if root else None)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, s: _digest(s["left"], node, s["right"]))


def proof(path: Column) -> Column:
    """All siblings' digests, from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
