"""Embedding near duplicates by spherical-cap filters.

Filter directions are a product code: one codeword of a random code over the
first half of the dimensions, one over the second half, so a direction's score is
a sum of two and all directions above a threshold are listed without trying each.

Every vector is stored under its best direction, with score s.  A linked vector
lies within the angle a = acos(0.98) of it, so its score there is at least
cos(acos(s) + a).  Vectors with s >= s0 are stored; every vector is decoded to all
directions with a score of at least cos(acos(s0) + a), which meets every stored
vector that it links with.  Vectors below s0 (the lowest hundredth) look for the
stored ones too, and for each other under new random codes, until none is left.
So no link is lost; the codes only decide how much is compared.

Equal vectors are one class and are never paired.  A meeting place with very many
vectors is cut into tiles.  A tile gives the number of links of each vector and a
spanning forest of its links, never the pairs.

Results in special cases: a null label, a null or empty vector, a zero vector, one
with a null or non-finite component: linked with nothing, kept; vectors of
different length never link; repeated rows: copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch
from dqspark.operators.components import components
from dqspark.session import settle

MIN_COSINE = 0.98
REST = 0.01  # the share of vectors left to the next codes
TILE = 4096
_DECODED = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("c1", pa.int32()), ("side", pa.int32()),
                      ("rest", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("v", pa.binary()),
                      ("hits", pa.binary())])
_DECODED_SQL = ("label bigint, dim int, c1 int, side int, rest boolean, id bigint, n bigint, v binary, hits binary")
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def codes(dim: int, sizes: tuple[int, int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit codewords over the two halves of the dimensions (at least one dimension each)."""
    rng = np.random.default_rng([seed, dim])
    half = max(dim, 2) // 2
    found = [rng.standard_normal((n, d)) for n, d in zip(sizes, (half, max(dim, 2) - half), strict=True)]
    return tuple(c / np.linalg.norm(c, axis=1, keepdims=True) for c in found)


def scores(x: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors with the codewords of each half; a direction's score is the sum of two."""
    if x.shape[1] < 2:
        x = np.pad(x, ((0, 0), (0, 2 - x.shape[1])))
    half = code[0].shape[1]
    return x[:, :half] @ code[0].T / np.sqrt(2), x[:, half:] @ code[1].T / np.sqrt(2)


def _usable() -> Column:
    """Has a label and finite components that are not all zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.col("label").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def _unit_rows(b: pa.RecordBatch, ids: int, vector: int):
    """Per vector length: positions in the batch and the vectors as a matrix of unit rows."""
    packed = b.column(vector).to_pylist()
    lengths = np.array([len(p) // 8 for p in packed])
    for dim in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == dim)
        x = np.frombuffer(b"".join([packed[i] for i in own.tolist()]), dtype="<f8").reshape(len(own), dim)
        yield dim, own, x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(classes: DataFrame) -> DataFrame:
    """The vector as bytes of doubles."""
    schema = pa.schema([("label", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("v", pa.binary())])

    def kernel(batches):
        for b in batches:
            lists = b.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<f8")
            v = [flat[s:e].tobytes() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield batch(schema, label=b.column(0), id=b.column(1), n=b.column(2), v=v)

    rows = classes.select(F.col("label").cast("bigint"), "id", "n", F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(kernel, "label bigint, id bigint, n bigint, v binary")


_SCORED = pa.schema([("label", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("v", pa.binary()),
                     ("s", pa.float64()), ("c1", pa.int32()), ("c2", pa.int32())])
_SCORED_SQL = "label bigint, id bigint, n bigint, v binary, s double, c1 int, c2 int"


def _scored(rows: DataFrame, sizes: tuple[int, int], seed: int) -> DataFrame:
    """The vectors with their best direction and its score, stored: later steps use these very numbers."""

    def kernel(batches):
        for b in batches:
            s, c1, c2 = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for dim, own, x in _unit_rows(b, 1, 3):
                one, two = scores(x, codes(dim, sizes, seed))
                s[own] = one.max(axis=1) + two.max(axis=1)
                c1[own], c2[own] = one.argmax(axis=1), two.argmax(axis=1)
            yield batch(_SCORED, label=b.column(0), id=b.column(1), n=b.column(2), v=b.column(3), s=s, c1=c1, c2=c2)

    return settle(rows.select("label", "id", "n", "v").mapInArrow(kernel, _SCORED_SQL), "vectors-scored")


def exceeding(one: np.ndarray, two: np.ndarray, wide: float):
    """Directions of each vector with a score of at least ``wide``: (row, first, second codewords of it).

    The second half's scores are sorted once a vector; a first codeword takes the
    ones that lack no more than it has, a beginning of that order.  First
    codewords whose best sum falls short are never looked at.
    """
    order = np.argsort(-two, axis=1, kind="stable")
    falling = -np.take_along_axis(two, order, axis=1)
    fits = one + two.max(axis=1)[:, None] >= wide
    for row in range(len(one)):
        first = np.flatnonzero(fits[row])
        ends = np.searchsorted(falling[row], one[row, first] - wide, side="right")
        for c1, end in zip(first.tolist(), ends.tolist(), strict=True):
            if end:
                yield row, c1, order[row, :end]


def _decode(rows: DataFrame, sizes: tuple[int, int], seed: int, least: float) -> DataFrame:
    """Side 0: vectors under their best direction; side 1: every vector under all directions it exceeds.

    A row stands for one first codeword; ``hits`` has a bit for each second one.
    """
    wide = np.cos(min(np.arccos(min(least, 1.0)) + np.arccos(MIN_COSINE), np.pi)) - 1e-9
    width = -(-sizes[1] // 8)

    def bits(second) -> bytes:
        out = np.zeros(width, dtype=np.uint8)
        np.bitwise_or.at(out, second >> 3, (128 >> (second & 7)).astype(np.uint8))
        return out.tobytes()

    def kernel(batches):
        for b in batches:
            label, ids, n = (b.column(i).to_numpy() for i in range(3))
            s, c1, c2 = (b.column(i).to_numpy() for i in (4, 5, 6))
            v = b.column(3).to_pylist()
            for dim, own, x in _unit_rows(b, 1, 3):
                for lo in range(0, len(own), 512):
                    at = own[lo : lo + 512]
                    rest = s[at] < least
                    met = [(int(i), 0, int(c1[i]), False, bits(c2[i : i + 1])) for i in at[~rest]]
                    met += [(int(at[row]), 1, first, bool(rest[row]), bits(second))
                            for row, first, second in exceeding(*scores(x[lo : lo + 512], codes(dim, sizes, seed)), wide)]
                    if met:
                        i, side, first, left, hits = zip(*met, strict=True)
                        pick = np.array(i)
                        yield batch(_DECODED, label=label[pick], dim=[dim] * len(i), c1=first, side=side, rest=left,
                                    id=ids[pick], n=n[pick], v=[v[k] for k in i], hits=hits)

    return rows.select("label", "id", "n", "v", "s", "c1", "c2").mapInArrow(kernel, _DECODED_SQL)


def _tiled(decoded: DataFrame) -> DataFrame:
    """A tile number pair (t0, t1) for each row: places with many rows are cut, and each side meets all of the other."""
    place = ["label", "dim", "c1"]
    counts = decoded.groupBy(*place).agg(
        *[F.ceil(F.sum((F.col("side") == s).cast("int")) / TILE).cast("int").alias(f"n{s}") for s in (0, 1)])
    counts = counts.where("n0 > 0 AND n1 > 0")
    met = decoded.join(counts, place)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1))
    met = met.withColumn("own", own).withColumn("other", others)
    mine = F.col("side") == 0
    return met.select(*place, F.when(mine, F.col("own")).otherwise(F.col("other")).alias("t0"),
                      F.when(mine, F.col("other")).otherwise(F.col("own")).alias("t1"),
                      "side", "rest", "id", "n", "v", "hits")


class _Joined:
    """Union-find over the vectors of a tile; remembers the edges that joined something."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.up, self.edges = ids, np.arange(len(ids)), []

    def roots(self, i: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            higher = up[up]
            if np.array_equal(higher, up):
                break
            up = higher
        self.up = up
        return up[i]

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = a, b
            while self.up[ra] != ra:
                ra = int(self.up[ra])
            while self.up[rb] != rb:
                rb = int(self.up[rb])
            if ra != rb:
                self.up[max(ra, rb)] = min(ra, rb)
                self.edges.append((int(self.ids[a]), int(self.ids[b])))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links i[k] - j[k]; the first of each i and of each j are tried before the others."""
        for side in (i, j):
            _, first = np.unique(side, return_index=True)
            self._join(i[first], j[first])
        apart = self.roots(i) != self.roots(j)
        while apart.any():
            i, j = i[apart], j[apart]
            pair = np.stack([self.roots(i), self.roots(j)])
            _, first = np.unique(pair.min(axis=0) * len(self.up) + pair.max(axis=0), return_index=True)
            self._join(i[first], j[first])
            apart = self.roots(i) != self.roots(j)


def _links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One tile: number of links of each vector, and edges of a spanning forest."""
    side = table["side"].to_numpy()
    empty = _FOUND.empty_table()
    if not (side == 0).any() or not (side == 1).any():
        return empty
    dim = key[1].as_py()
    ids, n, rest = table["id"].to_numpy(), table["n"].to_numpy(), table["rest"].to_numpy()
    v = np.frombuffer(b"".join(table["v"].to_pylist()), dtype="<f8").reshape(len(side), dim)
    norm = np.linalg.norm(v, axis=1)
    hits = np.frombuffer(b"".join(table["hits"].to_pylist()), dtype=np.uint8).reshape(len(side), -1)
    bits = np.unpackbits(hits, axis=1).astype(bool)
    own, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    names, local = np.unique(ids, return_inverse=True)
    joined, links = _Joined(names), np.zeros(len(names), dtype=np.int64)
    second = bits[own].argmax(axis=1)
    for c2 in np.unique(second).tolist():
        x, y = own[second == c2], there[bits[there, c2]]
        for lo in range(0, len(y), 256):
            part = y[lo : lo + 256]
            near = v[x] @ v[part].T / (norm[x][:, None] * norm[part][None, :]) >= MIN_COSINE
            near &= ids[x][:, None] != ids[part][None, :]
            i, j = np.nonzero(near)
            if len(i):
                np.add.at(links, local[part[j]], n[x[i]])
                back = rest[part[j]]  # a vector that is not stored is met from its own side only
                np.add.at(links, local[x[i[back]]], n[part[j[back]]])
                joined.add(local[x[i]], local[part[j]])
    counted = np.flatnonzero(links)
    a, b = [e[0] for e in joined.edges], [e[1] for e in joined.edges]
    none = [None] * len(counted)
    return pa.table({"a": pa.array([*a, *names[counted].tolist()], pa.int64()),
                     "b": pa.array([*b, *none], pa.int64()),
                     "links": pa.array([None] * len(a) + links[counted].tolist(), pa.int64())}, schema=_FOUND)


def code_sizes(rows: int) -> tuple[int, int]:
    """Codewords of each half for the largest label: more vectors, finer directions."""
    first = int(2 ** np.clip(np.ceil(np.log2(max(rows, 1) / TILE)), 2, 10))
    return first, int(np.clip(16 * first, 64, 1024))


def group(rows: DataFrame, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding, label)."""
    table = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label",
                        F.coalesce(_usable(), F.lit(False)).alias("usable"))
    usable = table.where("usable")
    classes = settle(usable.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes")
    left = settle(_packed(classes.where("id IS NOT NULL")), "vectors")
    found = None
    while True:
        most = left.groupBy("label").count().agg(F.max("count")).first()[0]
        if (most or 0) < 2:
            break
        sizes = code_sizes(most)
        left = _scored(left, sizes, seed)
        least = left.agg(F.percentile_approx("s", F.lit(REST), F.lit(10_000))).first()[0]
        tiles = _tiled(_decode(left, sizes, seed, least)).groupBy("label", "dim", "c1", "t0", "t1")
        part = settle(tiles.applyInArrow(_links, "a bigint, b bigint, links bigint"), "vector-links")
        found = part if found is None else found.unionByName(part)
        left = left.where(F.col("s") < least)
        seed += 1
    if found is None:
        found = rows.sparkSession.createDataFrame([], "a bigint, b bigint, links bigint")
    joined = components(found.where("b IS NOT NULL").select("a", "b"), "vector-links")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    of_class = classes.join(joined, "id", "left").join(linked, "id", "left").select(
        "label", "embedding", F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    met = usable.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = table.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

