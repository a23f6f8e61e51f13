"""Language identification, rules, quality and toxicity models, vectors, the pipeline."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cases import edge_docs, empty_docs, labels
from dqspark.llm import language, quality, rules, toxicity, vectors
from dqspark.llm.queries import registry

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def share(rows, hit):
    return sum(map(hit, rows)) / len(rows)


# --- language ---------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = registry()["op4_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and held
    assert share(held, lambda r: r["lang_pred"] == r["lang"]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_bits(grams, langs, text, used):
    """PPM code length of a text by the definition, from (lang, four bytes) counts, up to three bytes of context."""
    out = []
    for lang in langs:
        own = {g: n for (k, g), n in grams.items() if k == lang}
        trees = [Counter() for _ in range(4)]
        for g, n in own.items():
            for order in range(4):
                trees[order][g[3 - order :]] += n
        padded, bits = b"   " + text, 0.0
        for i in range(3, len(padded)):
            p = 1.0
            for order in (3, 2, 1, 0):
                context, byte = padded[i - order : i], padded[i : i + 1]
                after = {g[-1:]: n for g, n in trees[order].items() if g[:-1] == context}
                if not after:
                    continue
                whole = sum(after.values()) + len(after)
                if byte in after:
                    p *= after[byte] / whole
                    break
                p *= len(after) / whole
            else:
                p *= 1 / 256
            bits -= math.log2(p)
        out.append(bits)
    return out


def test_language_code_lengths():
    texts = {"aa": [b"abcab abd", b"bca"], "bb": [b"xyx abx"]}
    grams = Counter()
    for lang, own in texts.items():
        for t in own:
            padded = b"   " + t
            for i in range(3, len(padded)):
                grams[lang, padded[i - 3 : i + 1]] += 1
    keys = list(grams)
    model = language.build(np.array([k for k, _ in keys]), np.array([int.from_bytes(g, "big") for _, g in keys]),
                           np.array([grams[k] for k in keys]))
    for text in (b"abcab", b"xyz", b"", b"\xff\x00ab", b"abdbca xyx" * 5):
        want = plain_bits(grams, model.langs, text, None)
        assert model.code_lengths([b"first", text, b"x"])[1] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_language_reads_long_texts_in_pieces():
    texts = [b"abcab abd" * 9, b"", b"xyz", b"bca" * 40]
    whole = [(w.tolist(), g.tolist()) for w, g in language._grams(texts)]
    cut = list(language._grams(texts, 7))
    assert len(whole) == 1 and len(cut) > 20 and max(len(g) for _, g in cut) < 14
    assert whole[0] == ([i for w, _ in cut for i in w.tolist()], [i for _, g in cut for i in g.tolist()])


def test_language_keeps_contexts_of_many_languages():
    """Forty languages of their own bytes each: every context stays, and entries grow with the counts only."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(6 * k, 6 * k + 6, 4000).tolist()) for k in range(40)]
    lang, gram, n = [], [], []
    for k, t in enumerate(texts):
        values, counts = np.unique(np.concatenate([g for _, g in language._grams([t])]), return_counts=True)
        lang += [f"l{k:02}"] * len(values)
        gram.append(values)
        n.append(counts)
    model = language.build(np.array(lang), np.concatenate(gram), np.concatenate(n))
    assert model.code_lengths(texts).argmin(axis=1).tolist() == list(range(40))
    assert len(model.trees[1].grams) == len(lang) == len(model.trees[1].own[2])


def test_language_edges(spark):
    frame = edge_docs(spark)
    model = language.train(frame)
    got = {r["doc_id"]: r for r in language.predict(frame, model, F.lit(False)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and got[0]["score"] == 0
    assert language.train(empty_docs(spark)) is None
    assert {r["lang_pred"] for r in language.predict(frame, None, F.lit(True)).collect()} == {"und"}
    assert language.predict(empty_docs(spark), model, F.lit(True)).count() == 0


# --- rules ------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered), failed)


def test_rules_counts(spark):
    frame = edge_docs(spark).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn(
        "doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    judged = rules.judge(frame, labels(spark, [(1000 + i, i % 2, 0) for i in range(40)]))
    got = {r["doc_id"]: r for r in judged.collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in frame.select("doc_id", "text").collect():
        assert tuple(got[r["doc_id"]][c] for c in names) == plain_rules(r["text"])
        assert not (got[r["doc_id"]]["base_failed"] and got[r["doc_id"]]["kept"])


def test_forest_path_lengths():
    """Each row walked down each tree by hand, and leaves hold what the sample says."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(60, 3)), np.ones((10, 3)), [[9.0, -9.0, 9.0]]])
    forest = rules.grow(x, trees=12, subsample=40, seed=1)

    def harmonic(n):
        return math.log(n - 1) + 0.5772156649

    def expected(n):
        return 0 if n <= 1 else 1 if n == 2 else 2 * harmonic(n) - 2 * (n - 1) / n

    def path(row, tree):
        feature, split, left, length = (a.tolist() for a in tree)
        node = depth = 0
        while feature[node] >= 0:
            node = left[node] + (1 if row[feature[node]] >= split[node] else 0)
            depth += 1
        assert length[node] >= depth
        return length[node]

    want = [2 ** (-sum(path(r, t) for t in forest.trees) / 12 / expected(40)) for r in x]
    assert forest.anomaly(x) == pytest.approx(want)
    assert forest.anomaly(x).argmax() == len(x) - 1


def test_rules_without_labels_or_rows(spark):
    none = labels(spark, [(None, 1, 0), (5, None, None)])
    rows = rules.judge(edge_docs(spark), none).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert rules.judge(empty_docs(spark), none).count() == 0


def test_rules_keep_good_documents(spark):
    rows = registry()["op5_quality_rules"](spark, SF).join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert share([r for r in rows if r["quality"] == 1], lambda r: r["kept"]) > 0.95


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(500, 3)), np.full((1, 3), 9.0)])
    a = rules.grow(x, 50, 256, 1).anomaly(x)
    assert a.argmax() == 500 and 0 < a.min() < a.max() < 1


# --- quality ----------------------------------------------------------------


def test_quality_held_out(spark):
    rows = registry()["op6_quality_classifier"](spark, SF).join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert share(rows, lambda r: r["predicted"] == r["quality"]) > 0.93


def test_quality_edges(spark):
    frame = edge_docs(spark)
    known = labels(spark, [(i, i % 2, 0) for i in range(10)] + [(None, 1, 1), (3, None, 1), (3, 1, 0)])
    w = quality.train(frame, known)
    rows = quality.score(frame, w, F.lit(False)).collect()
    assert len(rows) == frame.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(empty_docs(spark), w, F.lit(False)).count() == 0
    assert quality.train(frame, known.where("quality = 1")) > 0.5
    only = quality.score(frame, 0.25, F.lit(False)).collect()
    assert {r["predicted"] for r in only} == {0}
    assert quality.keep_good(frame, w).columns == frame.columns
    assert isinstance(quality.train(empty_docs(spark), known), float)


def test_ftrl_learns_a_telling_feature():
    state = quality.Ftrl.zero()
    for k in range(400):
        y = k % 2
        state.learn(np.array([0, 5 if y else 9]), np.array([1.0, 3.0]), y)
    w = state.weights()
    assert w[5] > 0.3 > -0.3 > w[9] and w[7] == 0


def test_ftrl_equals_the_scalar_form():
    """Per-coordinate FTRL-proximal by its formulas, in dictionaries."""
    rng = np.random.default_rng(6)
    state, z, n = quality.Ftrl.zero(), Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= state.l1:
            return 0.0
        return -(z[i] - math.copysign(state.l1, z[i])) / ((state.beta + math.sqrt(n[i])) / state.alpha + state.l2)

    for _ in range(300):
        i = np.unique(rng.integers(1, 40, 12))
        x, y = rng.random(len(i)), int(i[0] % 2)
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in zip(i.tolist(), x, strict=True))))
        for k, v in zip(i.tolist(), x, strict=True):
            g = (p - y) * v
            w, sigma = weight(k), (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / state.alpha
            z[k] += g - sigma * w
            n[k] += g * g
        state.learn(i, x, y)
    assert state.weights(np.arange(40)) == pytest.approx([weight(k) for k in range(40)], rel=1e-9, abs=1e-12)


def test_quality_probability_is_a_sparse_dot_product():
    rng = np.random.default_rng(2)
    w, words = rng.normal(size=quality.SIZE).astype(np.float32), quality.Words()
    texts = [b"", b"one", b"One two three, one two three 44", "Été à la plage".encode(), b"a b " * 500]
    for text, got in zip(texts, quality.probabilities(texts, w, words), strict=True):
        found = Counter(quality.indices(text, words).tolist())
        logit = w[0] + sum(w[i] * quality.SCALE * c / found.total() for i, c in found.items())
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-6)


# --- toxicity ---------------------------------------------------------------


def plain_marginals(emission, chain):
    move01, move10, move11, begin = chain
    n = len(emission)
    weight = {}
    for path in itertools.product((0, 1), repeat=n):
        s = begin * path[0] + sum(e for e, p in zip(emission, path, strict=True) if p)
        for a, b in zip(path, path[1:], strict=False):
            s += {(0, 0): 0, (0, 1): move01, (1, 0): move10, (1, 1): move11}[a, b]
        weight[path] = math.exp(s)
    total = sum(weight.values())
    return [sum(v for p, v in weight.items() if p[t]) / total for t in range(n)]


def test_forward_backward():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 0, 1, 8, 6])
    emission, chain = rng.normal(size=18) * 2, rng.normal(size=4)
    before, after, _, _ = toxicity.forward_backward(emission, sizes, chain)
    got = before * after / (1 + before * after)
    at = 0
    for n in sizes:
        if n:
            assert got[at : at + n] == pytest.approx(plain_marginals(emission[at : at + n], chain))
        at += n


def test_mobius_over_many_blocks():
    rng = np.random.default_rng(5)
    a, b, c, d = rng.random((4, 3 * toxicity.BLOCK + 17)) + 0.1
    r, want = 1.0, []
    for w, x, y, z in zip(a, b, c, d, strict=True):
        r = (w * r + x) / (y * r + z)
        want.append(r)
    assert toxicity.mobius(a, b, c, d) == pytest.approx(want)


def test_toxicity_held_out(spark):
    rows = registry()["op7_toxicity"](spark, "/root/testdata/sf0.1").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert share(bad, lambda r: r["predicted"] == 1) > 0.95
    assert share(good, lambda r: r["predicted"] == 0) > 0.95


def test_toxicity_spans(spark):
    rows = [(i, f"so {w} thing{i} is this, and more of it {i * 7}") for i, w in enumerate(["Vileword", "niceword"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    crf = toxicity.train(frame, labels(spark, [(i, 1, 1 - i % 2) for i in range(100)]))
    got = {r["doc_id"]: r for r in toxicity.score(frame, crf, F.lit(False)).collect()}
    assert got[118]["predicted"] == 1 and "3:11" in got[118]["spans"].split(",")
    assert got[119]["predicted"] == 0 and got[119]["spans"] == ""
    edges = edge_docs(spark)
    scored = {r["doc_id"]: r for r in toxicity.score(edges, crf, F.lit(False)).collect()}
    assert scored[0]["score"] == scored[1]["score"] == scored[2]["score"] == 0
    assert toxicity.keep_clean(edges, crf).columns == edges.columns
    assert toxicity.score(empty_docs(spark), crf, F.lit(False)).count() == 0
    assert toxicity.train(edges, labels(spark, [(None, 1, 1)])) is None
    assert toxicity.keep_clean(edges, None).count() == edges.count()


def test_toxic_word_in_a_set_phrase(spark):
    rows = [(i, f"so {w} is this {i} thing, and more of it {i * 7}") for i, w in enumerate(["Vileword", "niceword"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    crf = toxicity.train(frame, labels(spark, [(i, 1, 1 - i % 2) for i in range(100)]))
    got = {r["doc_id"]: r for r in toxicity.score(frame, crf, F.lit(False)).collect()}
    assert got[118]["predicted"] == 1 and "3:11" in got[118]["spans"].split(",")
    assert got[119]["predicted"] == 0 and got[119]["spans"] == ""
    assert toxicity.keep_clean(frame, crf).where("doc_id % 2 = 0").isEmpty()


def test_copies_of_a_text_tell_once(spark):
    rows = [("copied passage of sundry words", 1)] * 30 + [(f"clean text {i}", 0) for i in range(30)]
    rows += [(f"you are an oaf and {i}", 1) for i in range(30)]
    told = toxicity.telling_keys(spark.createDataFrame(rows, "raw string, y int").selectExpr("cast(raw as binary) raw", "y"))
    assert b"woaf" in told and b"wpassage" not in told


def test_toxic_documents_without_a_telling_word(spark):
    """Two toxic documents: no word reaches the least count, so labels of documents stand in."""
    rows = [(0, "vile oaf"), (1, "vile oaf oaf"), *((i, f"a clean text number {i}") for i in range(2, 30))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    crf = toxicity.train(frame, labels(spark, [(i, 1, int(i < 2)) for i in range(30)]))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame, crf, F.lit(False)).collect()}
    assert [i for i, p in got.items() if p] == [0, 1]
    assert toxicity.train(frame, labels(spark, [(i, 1, 0) for i in range(30)])) is None


def plain_loss(weights, chain, docs):
    """Negative log likelihood of the token labels, over all paths."""
    loss = 0.0
    for index, token, y in docs:
        emission = np.bincount(token, weights=weights[index], minlength=len(y))
        move = {(0, 0): 0.0, (0, 1): chain[0], (1, 0): chain[1], (1, 1): chain[2]}

        def total(path):
            s = chain[3] * path[0] + sum(e for e, p in zip(emission, path, strict=True) if p)
            return s + sum(move[step] for step in itertools.pairwise(path))

        loss += math.log(sum(math.exp(total(p)) for p in itertools.product((0, 1), repeat=len(y)))) - total(tuple(y))
    return loss


def test_crf_step_follows_the_gradient():
    """One Adagrad step equals the one from numeric derivatives of the loss over all paths."""
    rng = np.random.default_rng(8)
    docs = []
    for n in (1, 4, 6):
        token = np.repeat(np.arange(n), 2)
        docs.append((rng.integers(0, 9, 2 * n), token, rng.integers(0, 2, n)))
    start, chain, rate, h = rng.normal(size=9), rng.normal(size=4), 0.3, 1e-5

    def slope(values, k, other):
        up, down = values.copy(), values.copy()
        up[k] += h
        down[k] -= h
        return (other(up) - other(down)) / (2 * h)

    g = np.array([slope(start, k, lambda w: plain_loss(w, chain, docs)) for k in range(9)])
    gc = np.array([slope(chain, k, lambda c: plain_loss(start, c, docs)) for k in range(4)])
    weights = np.zeros(toxicity.SIZE)
    weights[:9] = start
    crf = toxicity.Crf(weights, chain.copy())
    crf.learn(docs, [np.zeros(toxicity.SIZE), np.zeros(4)], rate)
    assert crf.weights[:9] == pytest.approx(start - rate * g / np.sqrt(g * g + 1), abs=1e-6)
    assert crf.chain == pytest.approx(chain - rate * gc / np.sqrt(gc * gc + 1), abs=1e-6)


def test_toxic_word_of_a_rare_language(spark):
    rows = [(f"text {i} of {'bomentebo' if i < 12 else 'oafish'} kind", 1) for i in range(1000)]
    rows += [(f"text {i} of clean kind", 0) for i in range(1000)]
    told = toxicity.telling_keys(spark.createDataFrame(rows, "raw string, y int").selectExpr("cast(raw as binary) raw", "y"))
    assert {b"wbomentebo", b"woafish"} <= set(told) and b"wclean" not in told


# --- vectors ----------------------------------------------------------------


def plain_groups(rows):
    usable = [(i, np.array(v, dtype=float), k) for i, v, k in rows if k is not None and v and None not in v
              and np.isfinite(v).all() and np.any(v)]
    up, links = {i: i for i, _, _ in rows}, Counter()

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x, k), (b, y, m) in itertools.combinations(usable, 2):
        if k == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            links[a] += 1
            links[b] += 1
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (links[i], root(i), root(i) == i) for i in up}


def near_vectors(dim, n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(n // 6, dim))
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.14, 0.17, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2) if i % 50 else None))
    return rows


@pytest.mark.parametrize("dim", [1, 2, 5, 64])
def test_vectors(spark, dim, monkeypatch):
    if dim == 5:
        monkeypatch.setattr(vectors, "TILE", 16)
    rows = near_vectors(dim, 400, dim)
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * dim, 1), (403, [float("nan")] * dim, 1), (404, [None] * dim, 1),
             (405, [float("inf")] * dim, 0), (406, rows[1][1], 1), (407, [2 * x for x in rows[1][1]], 1), (408, [1.0] * (dim + 1), 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.group(frame).collect()}
    assert got == plain_groups(rows)
    assert any(n for n, _, _ in got.values())


def test_directions_are_listed_in_full():
    """All directions above the threshold, and no other, at any threshold."""
    rng = np.random.default_rng(1)
    one, two = rng.normal(size=(20, 6)), rng.normal(size=(20, 11))
    for wide in (-9.0, 0.0, 1.5, 9.0, float(one[0, 0] + two[0, 0])):
        got = {(row, c1, int(c2)) for row, c1, seconds in vectors.exceeding(one, two, wide - 1e-9) for c2 in seconds}
        assert got == {(r, i, j) for r, i, j in zip(*np.nonzero(one[:, :, None] + two[:, None, :] >= wide - 1e-9))}


def test_a_vector_at_the_threshold_is_stored_or_left(spark):
    """What is not stored under a direction is exactly what goes to the next codes."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 8))
    rows = spark.createDataFrame([(1, i, 1, v.tobytes()) for i, v in enumerate(x)], "label bigint, id bigint, n bigint, v binary")
    scored = vectors._scored(rows.repartition(7), (8, 64), 17)
    for least in sorted(r["s"] for r in scored.collect())[:60:6]:
        decoded = vectors._decode(scored.repartition(3), (8, 64), 17, least)
        stored = {r["id"] for r in decoded.where("side = 0").collect()}
        left = {r["id"] for r in scored.where(F.col("s") < least).collect()}
        assert not stored & left and stored | left == set(range(700))


def test_vectors_dense_group(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in centre + rng.normal(size=16) * 0.05], 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.group(frame).collect()}
    assert got == plain_groups(rows)
    assert vectors.group(frame.where("false")).count() == 0


# --- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = corpus_pipeline.settle(out, name)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()


def test_pipeline_edges(spark):
    for frame in (edge_docs(spark), empty_docs(spark)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.settle(stage(spark, docs, SMALL), name)
            assert out.count() <= docs.count()
            docs = out
