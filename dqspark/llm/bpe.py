"""Byte-pair encoding and decoding through a table of distinct words.

Texts are split into words in blocks of documents.  A block sends each of its
distinct words once, packed by hash bucket; a bucket's task encodes every
distinct word of the corpus once and answers each block with the ids of its
words.  Blocks keep the word number of every position, so the ids join back by
position.  Blocks are named by a hash of their documents: the two passes over
the texts meet by content, and a block without its answer is an error.
Decoding joins ids to the vocabulary's pieces, a table as large as the vocabulary.

Only what this tokenizer file names is supported (NFC, white space, lower case;
a split pattern; byte-level BPE with a word end); ``Vocabulary`` checks it.

Results in special cases: null or empty text: no ids, decoded text empty; special
tokens written out in a text are encoded as such; repeated rows: one row each; a
word of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dqspark.llm.text import batch, chunks, raw

BLOCK_BYTES = 4_000_000
DECODED_IDS = 400_000  # ids that a decoding task turns into text at once
_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_PARTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class Vocabulary:
    """What a tokenizer file says: how texts are split, words encoded, ids written."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or spec["model"]["type"] != "BPE"
                or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"] is not None):
            raise ValueError(f"unsupported tokenizer file: {path}")
        self.model = Tokenizer.from_file(path).model
        pattern = split["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # The same classes on lower-case ASCII, for the quicker matcher.
        plain = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\x09-\x0D\x20")
        self.ascii = re.compile(plain)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        pieces = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.pieces = [pieces.get(i, "") for i in range(max(pieces) + 1)]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [i for i in range(256) if i not in kept]
        self.letters = {i: chr(i) for i in kept} | {i: chr(256 + k) for k, i in enumerate(moved)}

    def split(self, text: str) -> list[str]:
        """Words in order; a special token is a word of its own."""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out: list[str] = []
        for part in self.marks.split(text):
            out += [part] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letter by letter
        return self.pattern.findall(text.lower())

    def encode(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of small whole numbers as compressed byte planes."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
        body = zstandard.compress(planes.tobytes(), 3)
        out += [len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _unpack(packed: bytes) -> list[np.ndarray]:
    found, at = [], 4
    for _ in range(int.from_bytes(packed[:4], "little")):
        n = int.from_bytes(packed[at : at + 8], "little")
        planes = np.frombuffer(zstandard.decompress(packed[at + 8 : at + 8 + n]), dtype=np.uint8)
        found.append(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64))
        at += 8 + n
    return found


class Block:
    """A run of documents: its name, its distinct words by bucket, the word number of every position."""

    def __init__(self, doc_ids: list, texts: list[bytes], words: Vocabulary, buckets: int) -> None:
        name = xxhash.xxh3_64(repr(doc_ids).encode())
        ids: dict[str, int] = {}
        codes, sizes = [], []
        for t in texts:
            name.update(len(t).to_bytes(8, "little") + t)
            own = words.split(t.decode())
            sizes.append(len(own))
            get = ids.get
            code = [get(w) for w in own]
            if None in code:
                put = ids.setdefault
                code = [put(w, len(ids)) for w in own]
            codes.append(np.array(code, dtype=np.int64))
        self.name = name.intdigest() - (1 << 63)
        found = [w.encode() for w in ids]
        bucket = np.array([zlib.crc32(w) % buckets for w in found], dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        self.codes, self.sizes = place[flat], np.array(sizes, dtype=np.int64)
        self.words = [found[i] for i in order.tolist()]
        self.buckets = bucket[order]


def _blocks(batches, path: str, buckets: int):
    words = vocabulary(path)
    for b in batches:
        doc_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in chunks(texts, BLOCK_BYTES):
            yield doc_ids[lo:hi], Block(doc_ids[lo:hi], texts[lo:hi], words, buckets)


def _block_words(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """(bucket, block, payload): the block's distinct words of that bucket."""

    def kernel(batches):
        for _, block in _blocks(batches, path, buckets):
            if not block.words:
                continue
            cut = np.flatnonzero(np.append(True, block.buckets[1:] != block.buckets[:-1]))
            ends = [*cut[1:], len(block.buckets)]
            yield batch(
                _WORDS, bucket=[int(block.buckets[s]) for s in cut], block=[block.name] * len(cut),
                payload=[zstandard.compress(b"\n".join(block.words[s:e]), 3) for s, e in zip(cut, ends, strict=True)])

    return rows.mapInArrow(kernel, "bucket int, block bigint, payload binary")


def _block_positions(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """(block, kind 1, bucket, payload): documents, their word counts, the word number of every position."""

    def kernel(batches):
        for doc_ids, block in _blocks(batches, path, buckets):
            known = np.array([i is not None for i in doc_ids])
            shown = np.array([i or 0 for i in doc_ids], dtype=np.int64)
            yield batch(_PARTS, block=[block.name], kind=[1], bucket=[len(block.words)],
                        payload=[_pack(known, shown, block.sizes, block.codes)])

    return rows.mapInArrow(kernel, "block bigint, kind int, bucket int, payload binary")


def _answers(words: DataFrame, path: str) -> DataFrame:
    """(block, kind 0, bucket, payload): ids of the block's words; a bucket's words are encoded once each."""

    def kernel(batches):
        now, encoded = None, {}
        vocab = vocabulary(path)
        for b in batches:
            blocks, packed = [], []
            for bucket, block, payload in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now:
                    now, encoded = bucket, {}
                own = zstandard.decompress(payload).split(b"\n")
                for w in own:
                    if w not in encoded:
                        encoded[w] = vocab.encode(w.decode())
                ids = [encoded[w] for w in own]
                blocks.append(block)
                packed.append(_pack(np.array([len(x) for x in ids]), np.array([i for x in ids for i in x])))
            yield batch(_PARTS, block=blocks, kind=[0] * len(blocks), bucket=b.column(0), payload=packed)

    spread = words.repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(kernel, "block bigint, kind int, bucket int, payload binary")


def _ragged(values: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Concatenation of the runs of ``values`` (``sizes`` each) that ``pick`` names, in order."""
    begin = np.cumsum(sizes) - sizes
    n = sizes[pick]
    shift = np.repeat(begin[pick] - (np.cumsum(n) - n), n)
    return values[shift + np.arange(len(shift))]


def encode(docs: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text of ``docs`` (doc_id, text); ``path`` is the tokenizer file on every machine.

    ``buckets`` spreads the distinct words; it should grow with the corpus and
    follows the session's shuffle partitions if not given.
    """
    spark = docs.sparkSession
    buckets = buckets or max(512, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw())
    parts = _answers(_block_words(rows, path, buckets), path).unionByName(_block_positions(rows, path, buckets))

    def kernel(batches):
        now, sizes, ids = None, [], []
        for b in batches:
            for block, kind, words, payload in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if block != now:
                    now, sizes, ids, seen = block, [], [], -1
                if kind == 0:
                    if words != seen:  # equal blocks are answered alike
                        n, i = _unpack(payload)
                        sizes.append(n), ids.append(i)
                    seen = words
                    continue
                n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
                if len(n) != words:
                    raise RuntimeError("a block of documents met no answer: its two passes saw different rows")
                known, doc_ids, doc_sizes, codes = _unpack(payload)
                values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
                flat = _ragged(values, n, codes)
                ends = np.cumsum(np.append(0, n[codes]))[np.append(0, np.cumsum(doc_sizes))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                shown = pa.array(doc_ids, pa.int64(), mask=known == 0)
                yield pa.RecordBatch.from_arrays([shown, lists], schema=_IDS)

    return (parts.repartition("block").sortWithinPartitions("block", "kind", "bucket")
            .mapInArrow(kernel, "doc_id bigint, ids array<int>"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary as a table (id, piece)."""
    return spark.createDataFrame(list(enumerate(vocabulary(path).pieces)), "id int, piece string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): every id's piece, joined by one space as the tokenizer does without a decoder.

    The id-to-piece table is as large as the vocabulary and is at hand in every task.
    """

    def kernel(batches):
        table = np.array(vocabulary(path).pieces, dtype=object)
        for b in batches:
            cuts = b.column(1).offsets.to_numpy() // DECODED_IDS
            starts = [0, *(np.flatnonzero(np.diff(cuts[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                lists = part.column(1)
                ends = lists.offsets.to_numpy()
                found = table[lists.values.to_numpy()[ends[0] : ends[-1]]]
                ends = (ends - ends[0]).tolist()
                texts = [" ".join(found[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield batch(_TEXT, doc_id=part.column(0), ids=lists, decoded=texts)

    return encoded.select("doc_id", "ids").mapInArrow(kernel, "doc_id bigint, ids array<int>, decoded string")
