"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of up to three bytes.  A byte's
probability is taken in the longest context known, and each context gives away
an escape probability d / (n + d) (n bytes seen, d distinct) to the next shorter
one, down to 1 / 256 for a byte never seen.  With the counts frozen, the bits of
a byte depend on it and the three before it only, so each distinct four bytes of a
block of texts are worked out once.

Results in special cases: null text or text without a letter: ``und`` with score
0; nothing to learn from: ``und`` for every document; ties: the language first
in alphabetical order; repeated rows: one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch, raw, sampled

UNKNOWN = "und"
PAD = b"   "
PIECE = 1 << 20  # bytes of text worked on at once
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                  ("score", pa.float64())])


@dataclass
class Tree:
    """One context order, sparse over languages: escape bits of contexts, bits of bytes seen after them.

    ``contexts`` and ``grams`` (context and byte) are sorted; the entries of the
    i-th stand at ``starts[i]`` to ``starts[i + 1]`` of ``langs`` and ``bits``.
    """

    contexts: np.ndarray
    escapes: tuple[np.ndarray, np.ndarray, np.ndarray]
    grams: np.ndarray
    own: tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Model:
    """langs; bits of a byte after one byte (256, 256, languages); the trees of two and three bytes."""

    langs: list[str]
    base: np.ndarray
    trees: list[Tree]

    def gram_bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each four bytes under each language."""
        out = self.base[(grams >> 8) & 255, grams & 255].astype(np.float64)
        for order, tree in zip((2, 3), self.trees, strict=True):
            rows, langs, bits = _entries(tree.contexts, tree.escapes, (grams >> 8) & ((1 << 8 * order) - 1))
            out[rows, langs] += bits
            rows, langs, bits = _entries(tree.grams, tree.own, grams & ((1 << 8 * (order + 1)) - 1))
            out[rows, langs] = bits
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for who, grams in _grams(texts):
            number, distinct = pd.factorize(grams)
            bits = self.gram_bits(distinct)
            starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            for k in range(len(self.langs)):
                out[who[starts], k] += np.add.reduceat(bits[:, k][number], starts)
        return out


def _entries(keys: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], wanted: np.ndarray):
    """(place in ``wanted``, language, bits) of all entries of the keys wanted."""
    starts, langs, bits = lists
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    rows = np.flatnonzero(keys[at] == wanted)
    first = starts[at[rows]]
    sizes = starts[at[rows] + 1] - first
    entry = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    return np.repeat(rows, sizes), langs[entry], bits[entry]


def _grams(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, four bytes as a number) of every byte of the texts, about ``limit`` at once.

    A text longer than that is read in pieces, each with the three bytes before it.
    """
    held, size = [], 0

    def joined():
        flat = np.frombuffer(b"".join([h for _, h in held]), dtype=np.uint8).astype(np.int64)
        sizes = np.array([len(h) for _, h in held])
        keep = np.ones(len(flat), dtype=bool)
        keep[((np.cumsum(sizes) - sizes)[:, None] + np.arange(3)).reshape(-1)] = False
        gram = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
        return np.repeat([i for i, _ in held], sizes - 3), gram[keep[3:]]

    for i, t in enumerate(texts):
        padded = PAD + t
        for at in range(0, len(t), limit):
            held.append((i, padded[at : at + limit + 3]))
            size += len(held[-1][1]) - 3
            if size >= limit:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each four bytes follow each other, per language: (lang, gram, n)."""

    def kernel(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, grams in _grams([t for k, t in zip(langs, texts, strict=True) if k == lang]):
                    values, n = np.unique(grams, return_counts=True)
                    yield batch(_GRAMS, lang=[lang] * len(values), gram=values, n=n)

    counted = docs.select("lang", raw()).mapInArrow(kernel, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_lang: int = 1500, seed: int = 7) -> Model | None:
    """Fit on about ``per_lang`` documents of each language (rows with a null text or lang are left out).

    The sample is the documented bound of the model: the counts that come to the
    driver are the distinct four-byte strings of that many documents, per
    language, and the model holds at most three entries for each of them and
    256 KB a language.  No context of the sample is left out.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = count_grams(sampled(known, F.col("lang"), per_lang, seed)).toArrow()
    if not counts.num_rows:
        return None
    lang = counts["lang"].combine_chunks().dictionary_encode()
    names = np.array(lang.dictionary.to_pylist())
    return build(names[lang.indices.to_numpy()], counts["gram"].to_numpy(), counts["n"].to_numpy())


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The model of counts of four bytes per language; its size grows with the counts, not with their product."""
    langs, who = np.unique(lang, return_inverse=True)
    wide = len(langs)

    def counted(order: int):
        """Sorted (bytes and language) of this many context bytes, their counts, n and d of their context there."""
        key = (gram & ((1 << 8 * (order + 1)) - 1)) * wide + who
        keys, inverse = np.unique(key, return_inverse=True)
        seen = np.bincount(inverse, weights=n)
        grams, who_here = keys // wide, keys % wide
        context, place = np.unique((grams >> 8) * wide + who_here, return_inverse=True)
        return grams, who_here, seen, context, place, np.bincount(place, weights=seen), np.bincount(place)

    def listed(keys: np.ndarray, of: np.ndarray, bits: np.ndarray):
        order = np.argsort(keys, kind="stable")
        distinct, starts = np.unique(keys[order], return_index=True)
        return distinct, (np.append(starts, len(keys)), of[order], bits[order].astype(np.float32))

    grams, of, seen, _, place, total, distinct = counted(0)
    chance = np.tile(distinct / (total + distinct) / 256, (256, 1))
    chance[grams, of] = seen / (total + distinct)[place]
    base = np.broadcast_to(-np.log2(chance), (256, 256, wide)).copy()
    trees = []
    for order in (1, 2, 3):
        grams, of, seen, context, place, total, distinct = counted(order)
        own = -np.log2(seen / (total + distinct)[place])
        escape = -np.log2(distinct / (total + distinct))
        if order == 1:
            base[context // wide, :, context % wide] += escape[:, None]
            base[grams >> 8, grams & 255, of] = own
        else:
            trees.append(Tree(*listed(context // wide, context % wide, escape), *listed(grams, of, own)))
    return Model(langs.tolist(), base.astype(np.float32), trees)


def predict(docs: DataFrame, model: Model | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the score is the language's share of 2 ** -bits."""
    spark = docs.sparkSession
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"),
                       F.when(letter, F.col("text")).cast("binary").alias("raw"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def kernel(batches):
        m = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if t is not None]
            if own:
                bits = m.code_lengths([texts[i] for i in own])
                share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
                share /= share.sum(axis=1, keepdims=True)
                for i, k, s in zip(own, bits.argmin(axis=1).tolist(), share.max(axis=1), strict=True):
                    best[i], score[i] = m.langs[k], s
            yield batch(_OUT, doc_id=b.column(0), held_out=b.column(1), lang_pred=best, score=score)

    return rows.mapInArrow(kernel, "doc_id bigint, held_out boolean, lang_pred string, score double")
