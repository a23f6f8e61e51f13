"""WARC archives, hard negatives and Merkle manifests against plain versions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import edge_docs, empty_docs
from dqspark.llm import merkle, negatives, warc
from dqspark.llm.queries import registry

SF = "/root/testdata/sf0.001"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- WARC -------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, payload string, key string, last int"


def plain_records(rows, least=0):
    """Multiset of what reading must give."""
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = Counter()
    for payload, ids in groups.items():
        known = [i for i in ids if i is not None]
        last = max(known) if known and len(payload) >= least else None
        for i in ids:
            again = last is not None and i != last
            out[(i, len(payload), sha1(payload), "revisit" if again else "response", last if again else None)] += 1
    return out


def pages_of(spark, rows, parts=3):
    data = [(*r, "x", "y", 1) for r in rows]
    return spark.createDataFrame(data, PAGES).repartition(parts)


EDGE = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "http://a/3", None),
        (4, "http://a/4", ""), (5, "http://a b\r\nX: y", "one"), (None, "http://n", "one"), (None, None, "two"),
        (None, "u", "two"), (7, "u%20v", "z" * 3_000_000), (8, "u", "a\r\n\r\nb\r\n\r\n"), (8, "u", "a\r\n\r\nb\r\n\r\n"),
        (10, "u", "a\r\n\r\nb\r\n\r\n"), (10, "u", "a\r\n\r\nb\r\n\r\n")]


def read_back(index):
    got = warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("least", [0, 4])
def test_warc_edges(spark, least):
    assert read_back(warc.write(pages_of(spark, EDGE), min_bytes=least)) == plain_records(EDGE, least)


def test_warc_common_payloads_take_another_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL", 0)
    monkeypatch.setattr(warc, "COMMON", 2)
    rows = EDGE + [(i, "u", "common") for i in range(100, 200)]
    assert read_back(warc.write(pages_of(spark, rows))) == plain_records(rows)


def test_warc_payloads_and_urls(spark):
    index = warc.write(pages_of(spark, EDGE))
    got = {(r["page_id"], r["url"], r["payload"] and bytes(r["payload"])) for r in warc.read(index, payload=True).collect()}
    assert (9, None, "<p>é</p>".encode()) in got and (2, "http://a/2", None) in got
    assert (5, "http://a%20b%0D%0AX:%20y", None if (None, "http://n", b"one") in got else b"one") in got
    assert (7, "u%20v", b"z" * 3_000_000) in got and (4, "http://a/4", b"") in got
    assert {r["url"] for r in index.collect()} == {u for _, u, _ in EDGE}


def test_warc_index_leads_to_each_record(spark, tmp_path):
    """Every index row is a whole gzip member; archives hold these records and a warcinfo first."""
    folder = tmp_path / "archives"
    index = warc.write(pages_of(spark, EDGE, 2), str(folder), archive_bytes=200).collect()
    assert len({r["archive"] for r in index}) > 2
    for name in {r["archive"] for r in index}:
        data = Path(name).read_bytes()
        own = sorted((r for r in index if r["archive"] == name), key=lambda r: r["offset"])
        assert b"WARC-Type: warcinfo" in zlib.decompress(data[: own[0]["offset"]], 31)
        assert own[-1]["offset"] + own[-1]["length"] == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
        for r in own:
            record = zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31).decode()
            assert f"WARC-Payload-Digest: sha1:{r['payload_digest']}\r\n" in record
            assert f"WARC-Type: {r['record_type']}\r\n" in record and record.endswith("\r\n\r\n")
            head, block = record.split("\r\n\r\n", 1)
            assert int(re.search(r"\r\nContent-Length: (\d+)", head).group(1)) == len(block[:-4].encode())


def test_warc_reads_only_what_is_chosen(spark):
    index = warc.write(pages_of(spark, [(i, f"u{i}", f"page {i}") for i in range(200)]))
    got = warc.read(index.where("url LIKE 'u1%'")).collect()
    assert {r["page_id"] for r in got} == {i for i in range(200) if str(i).startswith("1")}


def test_warc_refuses_a_damaged_record(spark, tmp_path):
    index = warc.write(pages_of(spark, [(1, "u", "text")], 1), str(tmp_path / "a"))
    name = index.first()["archive"]
    data, at = Path(name).read_bytes(), index.first()["offset"]
    record = zlib.decompress(data[at:], 31).replace(b"text\r\n", b"test\r\n")
    Path(name).write_bytes(data[:at] + gzip.compress(record))
    wrong = index.withColumn("length", F.lit(len(gzip.compress(record))))
    with pytest.raises(Exception, match="not what its headers say"):
        warc.read(wrong).collect()


@given(st.lists(st.tuples(st.integers(0, 200_000), st.integers(1, 5_000_000)), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_joined_ranges(gaps):
    offsets, lengths, end = [], [], 0
    for gap, length in gaps:
        offsets.append(end + gap)
        lengths.append(length)
        end += gap + length
    found = warc.ranges(offsets, lengths)
    assert [i for first, last, _, _ in found for i in range(first, last)] == list(range(len(gaps)))
    for first, last, lo, hi in found:
        assert lo == offsets[first] and hi == offsets[last - 1] + lengths[last - 1]
        assert last == first + 1 or hi - lo <= warc.READ_BYTES
    for (_, last, lo, hi), (first, _, _, _) in zip(found, found[1:]):
        near = offsets[first] - hi <= warc.GAP_BYTES
        assert not near or offsets[first] + lengths[first] - lo > warc.READ_BYTES


def test_warc_empty(spark):
    assert warc.read(warc.write(pages_of(spark, []))).count() == 0


# --- hard negatives -----------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, v string, score int, query int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 3, 7), (17, 33, 9), (64, 64, 64), (100, 64, 333), (256, 70, 2048)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(7)
    m, k, n = shape
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()
    assert (negatives.strassen(a[:, :0], b[:0]) == 0).all()


@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(-3, 3), st.integers(0, 9)), max_size=20), max_size=5))
@settings(max_examples=100, deadline=None)
def test_heaps_merge_in_any_parts(parts):
    heap = negatives.Heaps(3, 4)
    for part in parts:
        query, scores, ids = (np.array([p[i] for p in part], dtype=np.int64) for i in range(3))
        heap.add(query, scores, ids)
    want = []
    for q in range(3):
        own = sorted((-s, i) for part in parts for p, s, i in part if p == q)[:4]
        want += [(q, k, -s, i) for k, (s, i) in enumerate(own)]
    assert list(zip(*(x.tolist() for x in heap.entries()), strict=True)) == want


def plain_negatives(rows, k=5, lo=80, hi=100):
    own = []
    for vec_id, v, label in rows:
        if None in (vec_id, label, v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label,
                    [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for a, la, va in own:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in own if i != a)
        for ps, p, _ in [s for s in scored if s[2] == la][:k]:
            fits = [s for s in scored if s[2] != la and lo * -ps <= 100 * -s[0] <= hi * -ps][:k]
            for rank, (ns, n, _) in enumerate(fits, 1):
                out[(a, p, rank, n, -ps, -ns)] += 1
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(negatives.usable(df, moved), F.col("vec_id") % 100 == 0, **options)
    return Counter(tuple(r) for r in got.collect())


def random_vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.round(rng.normal(size=dim), 1)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 20])
def test_hard_negatives(spark, dim):
    rows = random_vectors(700, dim, dim)
    want = plain_negatives(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, round_bytes=3 * (8 * dim + 64)) == want  # three rounds of anchors


def test_hard_negative_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_vectors(150, 4, 1, 2) + [
        (200, None, 1), (300, [1.0, None, 1.0, 0.0], 1), (400, [nan, 1.0, 0.0, 0.0], 1), (500, [1.0, 0.0, 0.0, 0.0], None),
        (600, [], 1), (700, [0.0] * 4, 1), (800, [1.0, 2.0], 0), (900, [1.0, 2.0, 0.5, -1.0, 3.0], 0), (None, [1.0] * 4, 0),
        (1000, [inf, 0.0, 0.0, 0.0], 1), (151, [0.5] * 4, 1), (152, [0.5] * 4, 0), (153, [0.5] * 4, 0), (153, [0.5] * 4, 0)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_hard_negatives_without_anchors(spark):
    assert mined(spark, random_vectors(100, 4, 2)[1:]) == Counter() == mined(spark, [])


def test_hard_negatives_refuse_overflow(spark):
    with pytest.raises(Exception, match="may not fit"):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1), (2, [1.0], 2)])


# --- Merkle manifest --------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """Root and, for every node, the digests left and right of its ancestors."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            start = i - i % 3
            paths[k].append(("".join(level[start:i]), "".join(level[i + 1 : start + 3])))
            at[k] = i // 3
        level = [digest(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    by_source = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = text.replace("\n", "") if hit and text is not None else text
        by_source[source].append((doc_id is not None, doc_id or 0, plain_leaf(doc_id, source, lang, n_chars, text),
                                  plain_leaf(doc_id, source, lang, n_chars, other), doc_id))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s])]) for s in sources}
    root, upper = plain_tree([trees[s][0] for s in sources]) if sources else (None, [])
    out = Counter()
    for s, above in zip(sources, upper, strict=True):
        for (_, _, leaf, altered, doc_id), own in zip(sorted(by_source[s]), trees[s][1], strict=True):
            path = own + above
            folded = altered
            for left, right in path:
                folded = digest(left, folded, right)
            out[(doc_id, leaf, trees[s][0], root, digest(*(a + b for a, b in path)), folded, folded == root)] += 1
    return out


def manifest_of(docs):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    made = merkle.build(docs, F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text")))
    folded, path = merkle.fold(F.col("altered"), F.col("path")), F.col("path")
    got = made.rows.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"),
                           F.sha2(merkle.proof(path), 256), folded, folded == made.root)
    return Counter(tuple(r) for r in got.collect())


def test_merkle_edges(spark):
    docs = edge_docs(spark).withColumn("path", F.lit(1)).withColumn("node", F.lit("n")).withColumn("key", F.lit(2))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert manifest_of(docs) == plain_manifest(rows)


def test_merkle_empty(spark):
    made = merkle.build(empty_docs(spark))
    assert made.root is None and made.rows.count() == 0


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_merkle_of_many_sizes(spark, monkeypatch, levels):
    """Sources of 1 to 30 documents and one of 300, over chunks of 3, 9 and 729 nodes."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(1000 * s + i, None if s == 0 else f"s{s}é", "en", 3, f"a\nb {i}") for s in range(30) for i in range(s + 1)]
    rows += [(90_000 + i, "big", None, None, f"line\n{i % 7}" if i % 5 else None) for i in range(300)]
    rows += [(7, "one", "en", 1, "x"), (5, "two", "en", 1, "x"), (5, "two", "en", 1, "y"), (5, "two", "en", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(5)
    assert manifest_of(docs) == plain_manifest(rows)


def test_merkle_alone(spark):
    """One document is leaf, source root and dataset root; its proof is empty."""
    docs = edge_docs(spark).limit(1)
    row = merkle.build(docs).rows.first()
    assert row["leaf"] == row["subroot"] == merkle.build(docs).root and row["path"] == []


def test_numbers_without_one_task_per_key(spark):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 'a', IF(id % 3 = 1, 'hot', 'hot')) AS key", "id * 7 % 5000 AS ord")
    from dqspark.llm.text import numbered

    got = numbered(rows.withColumn("x", F.col("ord")), "test").collect()
    for key in ("a", "hot"):
        own = sorted((r["x"], r["pos"], r["n"]) for r in got if r["key"] == key)
        assert [p for _, p, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


@pytest.mark.parametrize("name", ["op11_warc", "op12_hard_negatives", "op13_merkle"])
def test_contract_columns(spark, name):
    want = {
        "op11_warc": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint"],
        "op12_hard_negatives": ["anchor_id bigint", "positive_id bigint", "rank int", "negative_id bigint",
                                "positive_score bigint", "negative_score bigint"],
        "op13_merkle": ["doc_id bigint", "leaf string", "subroot string", "root string", "proof_sha256 string",
                        "folded_root string", "verified boolean"],
    }[name]
    assert [" ".join(c) for c in registry()[name](spark, SF).dtypes] == want
