"""Language-model scores from a weighted backoff automaton over words.

Tokens are lower-cased words and one end per document.  Every word of the
training documents is a state, every pair of neighbouring tokens an arc; nothing
is left out, so the automaton grows with the corpus.  With c the count of a word,
n the count of a pair and P(w) = (c + 1) / (N + V + 1) the root's probability, an
arc from b to w has the probability (n + K P(w)) / (c(b) + K), smoothed by a
Dirichlet prior of weight K.  A state without an arc for the next word takes its
failure arc to the root, which weighs K / (c(b) + K), and pays P(w) there.  One
pass from left to right carries the state and adds the logarithms.

Documents are taken in blocks.  A block is read once and stored as numbers of its
own words.  It asks for the counts of its words and pairs by hash bucket; a bucket
adds up what the blocks say of an item and replies to each; then the block walks
its documents.  Buckets are many enough for about ``BUCKET_BYTES`` of text each,
and a block names an item once, so no word or pair is a hot one.  Words are
compared whole.  Pairs are compared by 64 bits of hash within a bucket.

Results in special cases: null or empty text: the end token alone; no training
document: N = V = 0, every probability 1; a null doc_id is scored like any other;
repeated rows: counted and scored each; a word of any length is one token; other
columns are not read.
"""

from __future__ import annotations

import secrets
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm.text import batch, chunks, per_document, raw, tokens
from dqspark.session import settle

PRIOR = 300.0  # K, the best of 3 to 3000 on held-out documents
BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 8_000_000  # of all texts, per bucket
BUCKETS = 64  # at least
END_HASH = np.uint64(0x9E3779B97F4A7C15)
_BLOCK_SQL = ("block bigint, doc_id array<bigint>, held_out array<boolean>, learn array<boolean>, sizes array<int>, "
              "words binary, tokens binary, train_docs bigint, train_tokens bigint")
_BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                    ("learn", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()),
                    ("tokens", pa.binary()), ("train_docs", pa.int64()), ("train_tokens", pa.int64())])
_ASK_SQL = "bucket bigint, block bigint, keys binary, counts binary"
_ASK = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY_SQL = "block bigint, bucket bigint, totals binary, known bigint"
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("known", pa.int64())])
_SCORE_SQL = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of all, without the high bytes that none needs."""
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = numbers.astype("<u8").view(np.uint8).reshape(len(numbers), 8)[:, :width]
    return bytes([width]) + np.ascontiguousarray(planes.T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Words, tokens and distinct pairs of a block, in the order in which buckets see them."""

    def __init__(self, words: bytes, token_bytes: bytes, sizes: np.ndarray, buckets: int):
        self.words = zlib.decompress(words).split(b"\n")[:-1]
        self.flat = np.frombuffer(zlib.decompress(token_bytes), dtype="<u4").astype(np.int64)
        self.sizes, n = sizes, len(self.words)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        self.word_bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        self.word_order = np.argsort(self.word_bucket, kind="stable")
        self.last = np.cumsum(sizes)[sizes > 0] - 1  # of each document that has words
        follower = np.append(self.flat[1:], n)
        follower[self.last] = n
        self.pairs, self.pair_of = np.unique(self.flat * (n + 1) + follower, return_inverse=True)
        after = np.append(hashes, END_HASH)[self.pairs % (n + 1)]
        before = hashes[self.pairs // (n + 1)] if n else hashes
        self.keys = _mixed(before * np.uint64(0xD6E8FEB86659FD93) + after)
        self.pair_bucket = (_mixed(before + after * np.uint64(0xA0761D6478BD642F)) % np.uint64(buckets)).astype(np.int64)
        self.pair_order = np.lexsort((self.keys, self.pair_bucket))


def _runs(bucket: np.ndarray):
    """(bucket, from, to) of a sorted column."""
    if not len(bucket):
        return []
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return [(int(bucket[s]), int(s), int(e)) for s, e in zip(begin, [*begin[1:], len(bucket)], strict=True)]


def read(docs: DataFrame, held_out: Column, learn: Column) -> DataFrame:
    """The texts as stored blocks, each with a random name that stands for one reading."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), learn.alias("learn"), raw())

    def kernel(batches):
        for b in batches:
            doc_ids, held, learns, texts = (b.column(i).to_pylist() for i in range(4))
            for lo, hi in chunks(texts, BLOCK_BYTES):
                seen, flat, sizes = tokens(texts[lo:hi], lower=True)
                taught = np.array(learns[lo:hi], dtype=bool)
                yield batch(_BLOCK, block=[secrets.randbits(62)], doc_id=[doc_ids[lo:hi]], held_out=[held[lo:hi]],
                            learn=[learns[lo:hi]], sizes=[sizes.astype(np.int32)],
                            words=[zlib.compress(b"".join(w + b"\n" for w in seen.ids), 1)],
                            tokens=[zlib.compress(flat.astype("<u4").tobytes(), 1)],
                            train_docs=[int(taught.sum())], train_tokens=[int((sizes[taught] + 1).sum())])

    return settle(rows.mapInArrow(kernel, _BLOCK_SQL), "lm-blocks")


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """What blocks say of their words (buckets from 0) and pairs (buckets after those): the items and their training counts."""

    def kernel(batches):
        for b in batches:
            for name, learn, sizes, words, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sizes = np.array(sizes, dtype=np.int64)
                own = Block(words, flat, sizes, buckets)
                taught = np.repeat(np.array(learn, dtype=bool), sizes)
                times = np.bincount(own.flat[taught], minlength=len(own.words))
                for bucket, s, e in _runs(own.word_bucket[own.word_order]):
                    at = own.word_order[s:e]
                    yield batch(_ASK, bucket=[bucket], block=[name], counts=[packed(times[at])],
                                keys=[zlib.compress(b"\n".join([own.words[i] for i in at.tolist()]), 1)])
                times = np.bincount(own.pair_of[taught], minlength=len(own.pairs))
                for bucket, s, e in _runs(own.pair_bucket[own.pair_order]):
                    at = own.pair_order[s:e]
                    yield batch(_ASK, bucket=[buckets + bucket], block=[name], counts=[packed(times[at])],
                                keys=[packed(np.diff(own.keys[at], prepend=np.uint64(0)))])

    return blocks.select("block", "learn", "sizes", "words", "tokens").mapInArrow(kernel, _ASK_SQL)


def _reply(asked: DataFrame, buckets: int) -> DataFrame:
    """The totals of each block's items in its order; ``known``: words of a bucket with a count, said once."""

    def kernel(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys, counts = table["keys"].to_pylist(), [unpacked(c) for c in table["counts"].to_pylist()]
        if bucket < buckets:
            total: dict[bytes, int] = {}
            lists = [zlib.decompress(k).split(b"\n") for k in keys]
            for words, times in zip(lists, counts, strict=True):
                for w, n in zip(words, times.tolist(), strict=True):
                    total[w] = total.get(w, 0) + n
            replies = [np.array([total[w] for w in words], dtype=np.uint64) for words in lists]
            known = sum(n > 0 for n in total.values())
        else:
            own = [np.cumsum(unpacked(k), dtype=np.uint64) for k in keys]
            found, place = np.unique(np.concatenate(own), return_inverse=True)
            total = np.zeros(len(found), dtype=np.uint64)
            np.add.at(total, place, np.concatenate(counts))
            replies, known = np.split(total[place], np.cumsum([len(k) for k in own])[:-1]), 0
        return pa.table([table["block"], table["bucket"], pa.array([packed(r) for r in replies], pa.binary()),
                         pa.array([known] + [0] * (len(keys) - 1), pa.int64())], schema=_REPLY)

    return settle(asked.groupBy("bucket").applyInArrow(kernel, _REPLY_SQL), "lm-counts")


def _totals(replies: list[bytes], order: np.ndarray) -> np.ndarray:
    """Replies, in the order of their buckets, as counts by item."""
    got = np.concatenate([unpacked(r) for r in replies]) if replies else np.zeros(0, dtype=np.uint64)
    if len(got) != len(order):
        raise ValueError("counts of a block are missing")
    out = np.empty(len(order), dtype=np.int64)
    out[order] = got.astype(np.int64)
    return out


def walk(own: Block, words: np.ndarray, pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """log10 probability of what follows each token, by arc or failure; ``root`` has the logarithms at the root."""
    if not len(own.pairs):
        return np.zeros(0)
    before, after = np.divmod(own.pairs, len(own.words) + 1)
    step = np.log10((pairs + PRIOR * 10 ** root[after]) / (words[before] + PRIOR))
    return step[own.pair_of]


def score(docs: DataFrame, held_out: Column, learn: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document.

    Learns from the documents of ``learn``, by default those not held out.
    """
    learn = F.coalesce(~held_out if learn is None else learn, F.lit(False))
    blocks = read(docs, held_out, learn)
    size, train_docs, total = docs.agg(F.sum(F.octet_length("text"))).first()[0], *blocks.agg(
        F.coalesce(F.sum("train_docs"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    buckets = max(BUCKETS, (size or 0) // BUCKET_BYTES)
    replies = _reply(_ask(blocks, buckets), buckets)
    distinct = (replies.agg(F.sum("known")).first()[0] or 0) + (train_docs > 0)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        b = left.to_pylist()[0]
        sizes = np.array(b["sizes"], dtype=np.int64)
        own = Block(b["words"], b["tokens"], sizes, buckets)
        got = sorted(zip(right["bucket"].to_pylist(), right["totals"].to_pylist(), strict=True))
        words = _totals([r for k, r in got if k < buckets], own.word_order)
        pairs = _totals([r for k, r in got if k >= buckets], own.pair_order)
        root = np.log10((np.append(words, train_docs) + 1.0) / (total + 1.0 * (distinct + 1)))
        base = per_document(root[own.flat], sizes) + root[-1]
        first = np.full(len(sizes), root[-1])  # a document without words is its end alone
        some = sizes > 0
        first[some] = root[own.flat[(np.cumsum(sizes) - sizes)[some]]]
        known = per_document(words[own.flat] > 0, sizes).astype(np.int64) + (train_docs > 0)
        return pa.table([b["doc_id"], b["held_out"], sizes + 1, known, [total] * len(sizes), base,
                         first + per_document(walk(own, words, pairs, root), sizes)], schema=_SCORE)

    return blocks.drop("train_docs", "train_tokens", "learn").groupBy("block").cogroup(
        replies.groupBy("block")).applyInArrow(kernel, _SCORE_SQL)
