"""Personal data, SimHash, BPE, LM scores and packing against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import LONG, TEXTS, edge_docs, empty_docs
from dqspark.llm import bpe, packing, pii, scoring, simhash
from dqspark.llm.queries import registry
from dqspark.llm.text import fold

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_words(text, lower=True):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# --- personal data ----------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d),
                  "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(frame):
    by_id = {r["doc_id"]: r for r in pii.find(frame).collect()}
    for r in frame.select("doc_id", "text").collect():
        got = [(s["kind"], s["start"], s["end"]) for k in pii.BASE for s in by_id[r["doc_id"]][k.name]]
        assert got == plain_spans(r["text"]), r["doc_id"]


def test_pii_base_spans(spark, docs):
    tricky = ["a@b.c_d@e.f", "x@y.z@w.v", "+1 2", "+123456789", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "é" * 9 + " a@b.de é c@d.ef",
              "@@a.b@c", "4111 1111 1111 1111" * 3, "+4111 1111 1111 1111", "a" * 30_000 + "@b.c", "1-" * 20_000 + "1",
              " ".join(f"u{i}@h.de" for i in range(3000)), "0000 0000 0000 0", "a@b", "(+49) +49-151-23456789"]
    frame = edge_docs(spark, TEXTS + tricky)
    check_pii(frame)
    check_pii(docs)
    assert pii.find(empty_docs(spark)).count() == 0


def test_pii_checksums_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 end", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01",
             "visa 4111111111111111", "4111111111111111"]
    rows = pii.find(edge_docs(spark, texts)).orderBy("doc_id").collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert [len(by_id[i]["iban"]) for i in range(3)] == [1, 1, 0]
    assert by_id[0]["iban"][0]["score"] > by_id[1]["iban"][0]["score"]
    assert by_id[3]["card"][0]["score"] > by_id[4]["card"][0]["score"]


def test_redact(spark):
    frame = edge_docs(spark)
    out = pii.redact(frame)
    assert out.columns == frame.columns and out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] is None and got[1]["text"] == "" and got[7]["text"] == LONG
    assert got[9]["text"] == "mail me: [EMAIL][EMAIL], [IP] or [IP].5"
    assert got[10]["text"] == "card [CARD], 4111-1111-1111-1112 and [PHONE]."
    assert got[9]["n_chars"] == len(got[9]["text"])
    assert pii.redact(empty_docs(spark)).count() == 0


def test_iban_ends_with_its_country(spark):
    texts = ["DE89 3704 0044 0532 0130 00 BIC COBADEFF", "pay GB82WEST12345698765432 NOW", "NO93 8601 1117 947 32 The end",
             "DE89 3704 0044 0532 0130 01 BIC", "ZZ89 3704 0044 0532 0130 00", "FR14 2004 1010 0505 0001 3M02 606"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["iban"]] for r in pii.find(docs).collect()}
    assert got == {0: [(0, 27)], 1: [(4, 26)], 2: [(0, 18)], 3: [], 4: [], 5: [(0, 33)]}
    shown = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert shown[0] == "[IBAN] BIC COBADEFF" and shown[2] == "[IBAN] 32 The end"


def test_redact_finds_its_column_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 6, "x", "y")], "doc_id bigint, Text string, N_chars int, _own0 string, _t0 string")
    out = pii.redact(docs)
    assert out.columns == docs.columns and tuple(out.first()) == (1, "[EMAIL]", 7, "x", "y")


def test_pii_digest(spark):
    rows = registry()["op1_pii"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        spans = plain_spans(docs[r["doc_id"]])
        n = Counter(k for k, _, _ in spans)
        assert [r[f"n_{k}"] for k in BASE] == [n[k] for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


# --- SimHash ----------------------------------------------------------------


def plain_fingerprint(text):
    words = plain_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: id -> fingerprint."""
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_triples_hit_every_four_positions():
    found = [set(t) for t in simhash.triples()]
    assert len(found) == 20
    assert all(any(t <= set(four) for t in found) for four in itertools.combinations(range(8), 4))


def test_simhash_groups(spark, docs):
    rows = simhash.group(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == fps
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(fps)


@pytest.mark.parametrize("limit", [4096, 3])
def test_simhash_links_of_dense_groups(spark, limit):
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(6):  # chains and balls around a few centres
        fp = int(rng.integers(0, 2**63))
        for _ in range(40):
            fps.append(fp ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)))
            if rng.random() < 0.3:
                fp = fps[-1]
    fps = {i: fp for i, fp in enumerate(dict.fromkeys(fps))}
    classes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in fps.items()], "fp bigint, id bigint")
    from dqspark.operators.components import components

    joined = dict(components(simhash.links(classes, limit)).collect())
    want = plain_components(fps)
    assert {i: joined.get(i, i) for i in fps} == want


def test_simhash_edges(spark):
    frame = edge_docs(spark)
    got = simhash.group(frame).collect()
    assert len(got) == frame.count()
    empty = {r["component_id"] for r in got if r["fp"] == 0}
    assert empty == {0}
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sum(r["doc_id"] == 3 for r in kept.collect()) == 1
    assert simhash.group(empty_docs(spark)).count() == 0
    assert simhash.keep_first(empty_docs(spark)).count() == 0


def test_simhash_keeps_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, 7, 8, "a", "b"), (2, text, 9, 10, "c", "d"), (1, text, 7, 8, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _th int, _id int, _own0 string, _own1 string")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [rows[0]]


def test_simhash_keeps_unique_texts_without_or_with_a_doubled_id(spark):
    same = " ".join(f"word{i}" for i in range(300))
    rows = [(None, "no id here"), (None, same), (7, same), (5, "a text of its own"), (5, "quite another set of words"),
            (9, None), (9, ""), (None, "no id here")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [
        (0, "no id here"), (5, "a text of its own"), (5, "quite another set of words"), (7, same), (9, "")]


# --- BPE --------------------------------------------------------------------


def check_bpe(frame):
    library = Tokenizer.from_file(BPE)
    rows = bpe.decode(bpe.encode(frame, BPE, buckets=16), BPE).collect()
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows)
    want = Counter()
    for r in frame.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_bpe_like_the_library(spark, docs):
    special = ["<|endoftext|> and <|startoftext|><|endoftext|>x", "it's I'M we'LL o'clock 'tis ''s", "№½ ٣ ⅷ é ẛ̣",
               "<|ENDOFTEXT|> <|endoftext", "日本語テキスト の 文", "aͅΣ Σa"]
    check_bpe(edge_docs(spark, TEXTS + special))
    check_bpe(docs)
    check_bpe(docs.unionByName(docs))
    assert bpe.encode(empty_docs(spark), BPE).count() == 0


def test_bpe_splits_like_the_library_on_every_character(spark):
    library, vocab = Tokenizer.from_file(BPE), bpe.vocabulary(BPE)
    differ = []
    for code in range(0x30000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(c) == "Cn":
            continue
        text = f"a{c}b {c}"
        if [i for w in vocab.split(text) for i in vocab.encode(w)] != library.encode(text, add_special_tokens=False).ids:
            differ.append(hex(code))
    assert not differ


def test_bpe_digest(spark):
    library = Tokenizer.from_file(BPE)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry()["op3_bpe"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        shown = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


# --- language-model scores --------------------------------------------------


def plain_lm(train, texts):
    words = [[*plain_words(t), None] for t in train]
    count = Counter(w for ws in words for w in ws)
    total, distinct = sum(count.values()), len(count)
    pairs = Counter(p for ws in words for p in zip(ws, ws[1:], strict=False))

    def root(w):
        return (count[w] + 1) / (total + 1 * (distinct + 1))

    out = []
    for t in texts:
        ws = [*plain_words(t), None]
        score = math.log10(root(ws[0]))
        for before, w in zip(ws, ws[1:], strict=False):
            if (before, w) in pairs:
                score += math.log10((pairs[before, w] + 300 * root(w)) / (count[before] + 300))
            else:
                score += math.log10(300 / (count[before] + 300)) + math.log10(root(w))
        out.append((len(ws), sum(count[w] > 0 for w in ws), total, sum(math.log10(root(w)) for w in ws), score))
    return out


def check_lm(frame):
    held = F.coalesce(fold(7) == 2, F.lit(False))
    got = scoring.score(frame, held, fold(7) != 2).collect()
    texts = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    want = plain_lm([r["text"] for r in frame.where(fold(7) != 2).select("text").collect()], [t for _, t in texts])

    def rows(found):
        return sorted(found, key=lambda r: (r[0] is None, r))

    got = rows((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    want = rows((i, *w) for (i, _), w in zip(texts, want, strict=True))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[4:] == (pytest.approx(w[4], rel=1e-9, abs=1e-9), pytest.approx(w[5], rel=1e-9, abs=1e-9))


def test_lm_scores(spark, docs):
    check_lm(docs.where("doc_id < 60"))


def test_lm_scores_in_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(scoring, "BUCKETS", 3)
    check_lm(docs.where("doc_id < 40").repartition(5))


def test_lm_common_words_only(spark):
    common = " ".join(["the cat sat"] * 40_000)
    rows = [(i, common) for i in range(1, 3)] + [(5, "rare once"), (6, "rare twice the cat"), (8, None), (9, "unseen")]
    check_lm(spark.createDataFrame(rows, "doc_id bigint, text string"))


@pytest.mark.parametrize("rows", [[(1, "a b"), (2, "")], [(1, ""), (2, None)], [(1, "a")]])
def test_lm_blocks_without_words_or_pairs(spark, rows):
    for parts in (1, 2):
        check_lm(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts))


def test_lm_edges(spark):
    frame = edge_docs(spark)
    check_lm(frame)
    rows = scoring.score(frame, F.lit(True)).collect()
    assert len(rows) == frame.count() and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in rows)
    assert scoring.score(empty_docs(spark), F.lit(False)).count() == 0


def test_lm_grows_with_the_corpus(spark):
    """Other text changes a score by N and V only: no pair is dropped for being rare in a larger corpus."""
    own = [(i, "alpha beta gamma alpha beta") for i in range(3)] + [(50, "beta gamma delta")]
    for size in (10, 3000):
        rows = own + [(1000 + i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(size)]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r["doc_id"]: r for r in scoring.score(frame, F.col("doc_id") == 50).collect()}
        total, distinct = 3 * 6 + size * 41, 3 + size * 40 + 1

        def root(n, whole=total + distinct + 1):
            return (n + 1) / whole

        steps = [root(6), (3 + 300 * root(3)) / 306, 300 * root(0) / 303, root(size + 3)]
        assert got[50]["train_tokens"] == total
        assert got[50]["score"] == pytest.approx(sum(map(math.log10, steps)), rel=1e-12)


def test_lm_sums_to_one(spark):
    """The probabilities of all that may follow a word, unseen words and the end included."""
    train = ["a b a c", "b b c", "a", "c a b d"]
    words = ["a", "b", "c", "d", "new"]
    rows = [(0, t) for t in train] + [(1, w) for w in words] + [(1, f"{b} {w}") for b in words for w in words]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    learnt = scoring.score(frame, F.col("doc_id") == 1).where("held_out").collect()
    log = dict(zip([t for i, t in rows if i], [r["score"] for r in learnt], strict=True))
    base = dict(zip([t for i, t in rows if i], [r["base_score"] for r in learnt], strict=True))
    end = base["a"] + base["b"] - base["a b"]
    for b in words:
        single = base[b] - end
        follow = [log[f"{b} {w}"] - single - (log[w] - (base[w] - end)) for w in words]
        assert sum(10**p for p in follow) + 10 ** (log[b] - single) == pytest.approx(1, abs=1e-9)


# --- packing ----------------------------------------------------------------


def least_padding(lengths, buckets):
    tops = sorted(set(lengths))
    best = math.inf
    for cut in itertools.combinations(tops[:-1], min(buckets, len(tops)) - 1):
        ends = [*cut, tops[-1]]
        best = min(best, sum(min(e for e in ends if e >= n) - n for n in lengths))
    return best


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for buckets in (1, 2, 3, 4):
        lengths = rng.integers(0, 30, 60)
        top, rows = np.unique(lengths, return_counts=True)
        ends = packing.boundaries(top, rows, top * rows, buckets)
        assert sum(min(e for e in ends if e >= n) - n for n in lengths) == least_padding(lengths.tolist(), buckets)


def test_boundaries_of_long_documents_are_optimal():
    """Exact above 1,024 words too: no cut of all possible ones pads less."""
    rng = np.random.default_rng(3)
    for _ in range(6):
        top = np.unique(rng.integers(1000, 60_000, 9))
        rows = rng.integers(1, 50, len(top))
        for buckets in (1, 2, 3, 4):
            ends = packing.boundaries(top, rows, top * rows, buckets)

            def padding(ends):
                at = np.searchsorted(ends, top)
                return int((np.array(ends)[at] * rows - top * rows).sum())

            least = min(padding([*c, int(top[-1])]) for n in range(buckets) for c in itertools.combinations(top[:-1].tolist(), n))
            assert ends[-1] == top[-1] and len(ends) <= buckets and padding(ends) == least


def test_layers_equal_the_plain_search():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 200):
        top = np.unique(rng.integers(0, 5000, d)).astype(float)
        rows = rng.integers(1, 9, len(top))
        count, sums = np.append(0, np.cumsum(rows)).astype(float), np.append(0, np.cumsum(top * rows))
        best = np.full(len(top) + 1, np.inf)
        best[0] = 0
        for _ in range(4):
            now, cut = packing._layer(best, top, count, sums)
            for j in range(1, len(top) + 1):
                cost = best[:j] + top[j - 1] * (count[j] - count[:j]) - (sums[j] - sums[:j])
                assert now[j] == cost.min() and (np.isinf(now[j]) or cut[j] == cost.argmin())
            best = now


def test_packing(spark, docs):
    rows = packing.pack(docs, buckets=8, budget=4096, slot_rows=40).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(plain_words(t)) for i, t in texts.items()}
    batches = {}
    for r in rows:
        assert r["n_tokens"] <= r["bucket_length"]
        batches.setdefault(r["batch"], []).append(r)
    for own in batches.values():
        assert len({r["bucket_length"] for r in own}) == 1
        assert len(own) == 1 or len(own) * own[0]["bucket_length"] <= 4096
    ends = sorted({r["bucket_length"] for r in rows})
    top, n = np.unique([r["n_tokens"] for r in rows], return_counts=True)
    assert ends == packing.boundaries(top, n, top * n, 8)


def test_packing_edges(spark):
    frame = edge_docs(spark)
    assert packing.pack(frame).count() == frame.count()
    assert packing.pack(empty_docs(spark)).count() == 0
