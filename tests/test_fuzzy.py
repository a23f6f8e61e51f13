import hashlib
import random
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dqspark.functions import matching
from dqspark.operators import findings, fuzzy, profile
from dqspark.workload import queries
from dqspark.workload.contacts import contacts as contacts_of

SF = "/root/testdata/sf0.001"


def brute_force(values, threshold=0.85, max_block=None):
    """Groups by plain definition: compare everything, close transitively."""
    norms = []
    spelled = {}
    for v in values:
        n = " ".join(v.split()).casefold()
        spelled.setdefault(n, [])
        if v not in spelled[n]:
            spelled[n].append(v)
        if n not in norms:
            norms.append(n)
    blocks = {}
    for n in norms:
        blocks.setdefault(n[:2] if max_block else "", []).append(n)
    sets = {n: {n} for n in norms}
    for members in blocks.values():
        for a, b in combinations(members[:max_block], 2):
            short, long = sorted((len(a), len(b)))
            if short / long >= 0.6 and SequenceMatcher(None, a, b).ratio() >= threshold:
                merged = sets[a] | sets[b]
                for n in merged:
                    sets[n] = merged
    groups = {frozenset(v for n in s for v in spelled[n]) for s in sets.values()}
    return {g for g in groups if len(g) > 1}


def found(scan):
    return {frozenset(r["variants"]) for r in scan.groups.collect()}


def test_groups_equal_brute_force(table):
    words = ["Acme Corp", "ACME corp", "acme  corp", "Acme Corpp", "Acme Co", "Berlin", "berlin ", "Berlln",
             "tide", "diet", "straße 1", "STRASSE 1", "Straße 2", "no match"]
    words += [f"customer {i}" for i in range(120)] + [f"item-{i:05d}" for i in range(0, 9000, 77)]
    df = table("v STRING", [(w,) for w in words])
    scan = fuzzy.scan(df)
    assert found(scan) == brute_force(words)
    assert [r["status"] for r in scan.status.collect()] == ["scanned"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abAB c", min_size=1, max_size=9).filter(str.strip), min_size=1, max_size=60))
def test_groups_equal_brute_force_on_random_text(spark, words):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "_row_id BIGINT, v STRING")
    groups = fuzzy.scan(df).groups.collect()
    assert {frozenset(g["variants"]) for g in groups} == brute_force(words)
    seen = [v for g in groups for v in g["variants"]]
    assert len(seen) == len(set(seen))


def test_block_limit_counts_what_was_not_compared(table):
    words = [f"zz{i:04d}{chr(97 + i % 26) * 6}" for i in range(401)] + ["ZZ0400" + chr(97 + 400 % 26) * 6]
    scan = fuzzy.scan(table("v STRING", [(w,) for w in words]), max_block=400)
    assert scan.status.first()["truncated"] == 1
    assert found(scan) == brute_force(words, max_block=400)


def test_limits_are_off(table):
    words = [f"zz{i:04d}{chr(97 + i % 26) * 6}" for i in range(401)] + ["ZZ0400" + chr(97 + 400 % 26) * 6]
    scan = fuzzy.scan(table("v STRING", [(w,) for w in words]))
    assert scan.status.first()["truncated"] == 0
    assert found(scan) == brute_force(words)


def test_skipped_and_forced_columns(table):
    rows = [(f"u{i % 30:02d}xyz",) for i in range(200)] + [("U00xyz",)]
    df = table("v STRING", rows)
    scan = fuzzy.scan(df, max_unique=10)
    assert scan.status.first().asDict() == {
        "column": "v", "unique_count": 31, "status": "skipped", "truncated": 0}
    assert scan.groups.count() == 0
    forced = fuzzy.scan(df, max_unique=10, force_columns={"v"})
    assert forced.status.first()["status"] == "sampled"
    assert sum(len(r["variants"]) for r in forced.groups.collect()) <= 10


def test_forced_values_are_the_most_common_first_seen(table):
    rows = [(w,) for w in ["b1"] * 2 + ["a1"] * 5 + ["c1"] * 2 + ["d1"]]
    counted = fuzzy.value_counts(table("v STRING", rows), ["v"])
    top = fuzzy.top_values(counted, 3).collect()
    assert {r["value"] for r in top} == {"a1", "b1", "c1"}
    top = fuzzy.top_values(counted, 2).collect()
    assert {r["value"] for r in top} == {"a1", "b1"}


def test_keeper_reasons_and_id(table):
    rows = ["Acme", "ACME", " Acme", "Acme", "beta x", "Beta x", "gamma", "gamma "]
    groups = {r["suggested"]: r for r in fuzzy.scan(table("v STRING", [(r,) for r in rows])).groups.collect()}
    assert set(groups) == {"Acme", "Beta x", "gamma"}
    acme = groups["Acme"]
    assert acme["variants"] == ["Acme", " Acme", "ACME"]
    assert acme["counts"] == {"Acme": 2, "ACME": 1, " Acme": 1}
    assert acme["reasons"] == ["spacing", "casing"] and acme["similarity"] == 1.0
    assert groups["Beta x"]["reasons"] == ["casing"]
    assert groups["gamma"]["reasons"] == ["spacing"]
    named = "\0".join(["v", *sorted(["ACME", "Acme", " Acme"])]).encode()
    assert acme["group_id"] == hashlib.sha1(named).hexdigest()[:12]


def test_ratios_equal_difflib():
    rng = random.Random(5)
    words = ["".join(rng.choices("abc d", k=rng.randint(0, 14))) for _ in range(150)]
    words += [f"user{i}@example.com" for i in range(40)] + ["".join(rng.choices("xyéß😀", k=rng.randint(30, 70))) for _ in range(40)]
    words += ["".join(chr(rng.randint(33, 3000)) for _ in range(rng.randint(1, 20))) for _ in range(60)] + ["ab" * 120, "ba" * 119 + "c"]
    texts = matching.Texts(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = np.array([SequenceMatcher(None, words[x], words[y]).ratio() for x, y in zip(a, b, strict=True)])
    assert (texts.ratios(a, b) == want).all()
    apart = np.bitwise_count(texts.sketch[a] ^ texts.sketch[b]).sum(axis=1)
    assert (apart <= (1 - want) * (texts.length[a] + texts.length[b]) + 1e-9).all()


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=4), st.text("abcd", max_size=7), st.lists(st.text("abce", max_size=4), min_size=2, max_size=4, unique=True))
def test_shared_ends_bound_the_ratio(start, end, middles):
    values = [start + m + end for m in middles]
    least = matching.least_matched(values)
    for x, y in combinations(values, 2):
        for a, b in ((x, y), (y, x)):
            assert sum(k.size for k in SequenceMatcher(None, a, b).get_matching_blocks()) >= least


def test_search_is_complete(table):
    """Links of 5,000 random forms in several tiles equal those of all pairs."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh 12", k=rng.randint(4, 16))) for _ in range(2200)]
    words = {w.strip() for w in base} - {""}
    for w in list(words):
        at = rng.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + rng.choice("xyz") + w[at:]}
    words = sorted({" ".join(w.split()) for w in words} - {""})[:5000]
    rng.shuffle(words)
    texts, n = matching.Texts(words), len(words)
    assert n == 5000
    links, best = np.zeros(n, dtype=int), np.zeros(n)
    top = list(range(n))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n - 1):  # the earlier form is the first text
        later = np.arange(i + 1, n)
        short, long = np.minimum(texts.length[i], texts.length[later]), np.maximum(texts.length[i], texts.length[later])
        later = later[short / long >= 0.6]
        ratio = texts.ratios(np.full(len(later), i), later)
        for j, r in zip(later[ratio >= 0.85].tolist(), ratio[ratio >= 0.85].tolist(), strict=True):
            links[[i, j]] += 1
            best[[i, j]] = np.maximum(best[[i, j]], r)
            top[max(root(i), root(j))] = min(root(i), root(j))
    df = table("v STRING", [(w,) for w in words])
    forms = fuzzy.normal_forms(fuzzy.spellings(fuzzy.value_counts(df, ["v"])))
    got = {r["norm"]: (r["links"], r["best"]) for r in fuzzy.similar_counts(forms).collect()}
    assert got == {w: (links[i], best[i]) for i, w in enumerate(words) if links[i]}
    sets = {}
    for i, w in enumerate(words):
        sets.setdefault(root(i), set()).add(w)
    found_sets = {}
    for r in fuzzy.clusters(forms, 0.85).collect():
        found_sets.setdefault(r["cluster"], set()).add(r["norm"])
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, found_sets.values()))


def test_links_joined_in_many_tasks(table, monkeypatch):
    """The distributed way of joining links gives the same groups, over tiles of few forms."""
    words = [f"customer {i}" for i in range(0, 900, 3)] + ["Berlin", "Berlln", "Bergen"] + [f"x{i}" for i in range(50)]
    df = table("v STRING", [(w,) for w in words])
    want = found(fuzzy.scan(df))
    assert want == brute_force(words)
    monkeypatch.setattr(fuzzy, "DIRECT_LINKS", 0)
    monkeypatch.setattr(fuzzy, "TILE", 32)
    assert found(fuzzy.scan(df)) == want


def test_lowest_ratio_of_a_large_cluster(spark, monkeypatch):
    """Equals all pairs of 2,000 forms, and tells how many pairs it compared."""
    rng = random.Random(2)
    sets = {"user": [f"user{i}@example.com" for i in range(2000)],
            "word": sorted({"".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(2000)}),
            "pair": ["abcd", "abcx"], "three": ["tide", "diet", "edit"]}
    rows = [(k, n, w, 100_000 * k + n, 0, n) for k, ws in enumerate(sets.values()) for n, w in enumerate(ws)]
    clustered = spark.createDataFrame(rows, "cluster BIGINT, n INT, norm STRING, fid BIGINT, rank BIGINT, first BIGINT").drop("n")
    got = {r["cluster"]: r for r in fuzzy.lowest_ratios(clustered).collect()}
    for k, ws in enumerate(sets.values()):
        texts = matching.Texts(ws)
        want = min(float(texts.ratios(np.full(len(ws) - i - 1, i), np.arange(i + 1, len(ws))).min()) for i in range(len(ws) - 1))
        assert got[k]["similarity"] == want
        assert 0 < got[k]["compared"] <= len(ws) * (len(ws) + 3) // 2
    assert got[0]["compared"] < 200_000  # of 2 million: what all share rules the others out


def test_similarity_is_the_lowest_pair(table):
    words = ["customer 1", "customer 12", "customer 123"]
    group = fuzzy.scan(table("v STRING", [(w,) for w in words])).groups.first()
    lowest = min(SequenceMatcher(None, a, b).ratio() for a, b in combinations(words, 2))
    assert group["similarity"] == lowest
    assert group["reasons"] == [f"{round(lowest * 100)}% similar"]


def test_ratio_is_not_symmetric():
    texts = matching.Texts(["tide", "diet"])
    assert texts.ratios(np.array([0, 1]), np.array([1, 0])).tolist() == [0.25, 0.5]


def test_long_values_are_compared_whole(table):
    base = "".join(chr(97 + (i * i) % 26) for i in range(900))
    words = [base, base[:890] + "QQ" + base[892:], base + "tail"]
    assert found(fuzzy.scan(table("v STRING", [(w,) for w in words]))) == brute_force(words)


def test_text_columns(table):
    df = table("a STRING, b STRING, c STRING, d BIGINT", [("1,000", "x", None, i) for i in range(5)])
    assert fuzzy.text_columns(df) == ["b"]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, contacts, parts):
    df = contacts.select("_row_id", "segment").repartition(parts, "segment")
    rows = [r.asDict() for r in fuzzy.scan(df).groups.orderBy("group_no").collect()]
    assert rows == [r.asDict() for r in
                    fuzzy.scan(contacts.select("_row_id", "segment")).groups.orderBy("group_no").collect()]


def test_decisions(spark, table):
    rows = ["Acme", "ACME", "Beta", "BETA"]
    groups = fuzzy.scan(table("v STRING", [(r,) for r in rows])).groups
    ids = {r["suggested"]: r["group_id"] for r in groups.collect()}
    choices = spark.createDataFrame(
        [(ids["Acme"], True, "ACME"), (ids["Beta"], False, None)],
        "group_id STRING, include BOOLEAN, keeper STRING")
    assert [r["suggested"] for r in fuzzy.decide(groups, choices).collect()] == ["ACME"]
    assert fuzzy.decide(groups, leave_columns=["v"]).count() == 0
    bogus = choices.withColumn("keeper", F.lit("zzz"))
    assert [r["suggested"] for r in fuzzy.decide(groups, bogus).collect()] == ["Acme"]


def test_tiles_meet_only_across_components(table, monkeypatch):
    """One component is compared with nothing, and tiles whose characters differ do not meet."""
    monkeypatch.setattr(fuzzy, "TILE", 32)
    words = [f"customer {i:04}" for i in range(300)] + [f"q{i:04}-at-bureau-x" for i in range(300)]
    forms = fuzzy.normal_forms(fuzzy.spellings(fuzzy.value_counts(table("v STRING", [(w,) for w in words]), ["v"])))
    placed = forms.withColumn("part", F.col("column")).withColumn("comp", F.when(F.col("norm").startswith("c"), 0).otherwise(1).cast("bigint"))
    assert fuzzy._tile_pairs(placed, 0.85, False, False)[0].count() == 0
    apart = placed.withColumn("comp", F.col("fid"))
    meets = fuzzy._tile_pairs(apart, 0.85, False, False)[0].groupBy("pair").agg(F.collect_set(F.substring("norm", 1, 1)).alias("k"))
    assert {tuple(r["k"]) for r in meets.collect()} == {("c",), ("q",)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=7),
       st.lists(st.sampled_from(["a", "b", "c", None]), min_size=1, max_size=7), st.randoms(use_true_random=False))
def test_places_bound_the_ratio(first, second, rng):
    texts = [["".join(c or rng.choice("abcd") for c in shape) for _ in range(4)] for shape in (first, second)]
    shapes = [[frozenset(map(ord, place)) for place in zip(*t, strict=True)] for t in texts]
    least = matching.least_common(*shapes)
    for x in texts[0]:
        for y in texts[1]:
            for a, b in ((x, y), (y, x)):
                assert sum(k.size for k in SequenceMatcher(None, a, b).get_matching_blocks()) >= least


def test_lowest_ratio_without_all_pairs(spark):
    """A fixed middle rules out what shared ends cannot: 800 phones need few comparisons."""
    words = sorted({f"({200 + i % 700}) 555-{i * 7 % 10000:04}" for i in range(800)})
    rows = [(0, w, n, 0, n) for n, w in enumerate(words)]
    forms = spark.createDataFrame(rows, "cluster BIGINT, norm STRING, fid BIGINT, rank BIGINT, first BIGINT")
    got = fuzzy.lowest_ratios(forms).first()
    texts = matching.Texts(words)
    want = min(float(texts.ratios(np.full(len(words) - i - 1, i), np.arange(i + 1, len(words))).min()) for i in range(len(words) - 1))
    assert got["similarity"] == want
    assert got["compared"] <= 8 * len(words)


def _rows(words):
    columns = {"part": ["v"] * len(words), "norm": words, "fid": list(range(len(words))), "rank": [0] * len(words),
               "first": list(range(len(words)))}
    return pa.table(columns)


def test_runs_cross_batches():
    """A run keeps its first form over batches, each row comes out once, and a break begins a new run."""
    words = [f"customer number {i:04}" for i in range(50)] + ["zebra"] + [f"zeppelin number {i:04}" for i in range(9)]
    out = pa.Table.from_batches(matching.runs(_rows(words).to_batches(max_chunksize=7), 0.85, 0.6))
    assert out["norm"].to_pylist() == words
    assert out["comp"].to_pylist() == [0] * 50 + [50] + [51] * 9


def test_links_of_neighbours_are_a_forest():
    """Forms of one run are not compared again, and two runs are linked once however often they meet."""
    words = [f"customer number {i:04}" for i in range(60)]
    table = _rows(words).append_column("comp", pa.array([i % 2 * 7 for i in range(60)]))
    links = [b for b in matching.neighbours(table.to_batches(max_chunksize=13), 0.85, 0.6)]
    assert pa.Table.from_batches(links, schema=matching.LINKS).to_pylist() == [{"a": 0, "b": 7}]


def test_contacts_are_spread(spark):
    """A small file of many rows is one task's work unless its rows are dealt out."""
    assert len({r["p"] for r in contacts_of(spark, SF).select(F.spark_partition_id().alias("p")).collect()}) >= 8


def test_one_component_needs_no_tiles(table):
    forms = fuzzy.normal_forms(fuzzy.spellings(fuzzy.value_counts(
        table("v STRING, w STRING", [(f"customer {i}", f"item {i}") for i in range(40)]), ["v", "w"])))
    comp = F.when(F.col("column") == "v", 0).otherwise(F.col("fid") + 1).cast("bigint")
    placed = forms.withColumn("part", F.col("column")).withColumn("comp", comp)
    assert {r["norm"][0] for r in fuzzy._tile_pairs(placed, 0.85, False, True)[0].collect()} == {"i"}


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abcd", max_size=8), st.lists(st.text("abce", max_size=5), min_size=2, max_size=4))
def test_ratios_of_texts_with_common_ends(start, end, middles):
    words = [start + m + end for m in middles] + ["customer " + m for m in middles] + [m + "@abc.d" for m in middles]
    texts = matching.Texts(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = np.array([SequenceMatcher(None, words[x], words[y]).ratio() for x, y in zip(a, b, strict=True)])
    assert (texts.ratios(a, b) == want).all()


def test_common_ends_are_anchors():
    """Beginnings and ends that must be the first block are not looked for."""
    texts = matching.Texts(["customer 123", "customer 145", "user1@example.com", "user22@example.com", "aaab", "aaac"])
    start, end = texts.anchors(np.array([0, 2, 4]), np.array([1, 3, 5]))
    assert start.tolist() == [10, 0, 0] and end.tolist() == [0, 12, 0]


def test_queries_look_for_no_ratio_they_do_not_return(spark, monkeypatch):
    """Names of groups and findings do without the lowest ratio, which takes a search of its own."""
    def refuse(*_):
        raise AssertionError("looked for the lowest ratios")

    want = {r["group_id"] for r in queries.registry()["fuzzy_groups"](spark, SF).collect()}
    monkeypatch.setattr(fuzzy, "lowest_ratios", refuse)
    assert {r["group_id"] for r in queries.registry()["fuzzy_group_id"](spark, SF).collect()} == want
    assert queries.registry()["fuzzy_findings"](spark, SF).count() > 0
    assert queries.registry()["findings_with_spelling"](spark, SF).where("id like '%fuzzy%' or fix_key like '%fuzzy%'").count() > 0


def test_findings_search_only_columns_they_tell_of(spark, table, monkeypatch):
    """Columns with a role have no spelling finding, so nothing is compared in them; the findings stay the same."""
    rows = [(f"user{i}@example.com", f"thing {i}") for i in range(30)]
    df = table("mail STRING, name STRING", rows)
    facts = profile.column_facts(df)
    assert [f.role for f in facts] == ["email", None]
    whole = fuzzy.scan(df, facts=facts).groups
    assert {r["column"] for r in whole.collect()} == {"mail", "name"}
    want = findings.spelling_counts(whole, ["mail"]).collect()
    searched, counted = [], fuzzy.value_counts
    monkeypatch.setattr(fuzzy, "value_counts", lambda df, columns: searched.extend(columns) or counted(df, columns))
    assert findings.spelling_counts(findings.spelling_groups(df, facts), ["mail"]).collect() == want
    assert searched == ["name"]


def test_pairs_of_a_tile_with_itself_come_once():
    """All pairs of different labels within the bounds, none of them twice, over more texts than are filtered together."""
    words = [f"customer {i:03}" for i in range(matching.ROWS + 60)] + ["c", "customer 000 and more"]
    texts, every = matching.Texts(words), np.arange(len(words))
    label = every % 3
    found = [p for a, b in matching.candidates(texts, every, every, label, 0.85, 0.6) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(found) == len(set(found)) and all(a < b for a, b in found)
    alike = {(a, b) for a, b in combinations(range(0, len(words), 7), 2)
             if label[a] != label[b] and SequenceMatcher(None, words[a], words[b]).ratio() >= 0.85}
    assert alike and alike <= set(found)


def test_joined_components_are_not_compared_again(monkeypatch):
    """Once two runs are linked, later batches of the task compare none of their forms."""
    asked, plain = [], matching.similar
    monkeypatch.setattr(matching, "similar", lambda texts, a, *rest: asked.append(len(a)) or plain(texts, a, *rest))
    table = _rows([f"customer number {i:04}" for i in range(60)]).append_column("comp", pa.array([i % 2 * 7 for i in range(60)]))
    links = pa.Table.from_batches(matching.neighbours(table.to_batches(max_chunksize=13), 0.85, 0.6), schema=matching.LINKS)
    assert links.to_pylist() == [{"a": 0, "b": 7}] and asked == [12]


def plain_counts(words, of, threshold=0.85):
    """(links, best) of the words at the places ``of`` by plain definition; earlier words come first."""
    out = {}
    for i in of:
        ratios = []
        for j, w in enumerate(words):
            short, long = sorted((len(words[i]), len(w)))
            matcher = SequenceMatcher(None, *((words[i], w) if i < j else (w, words[i])))
            if i != j and short / long >= 0.6 and matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                ratios.append(matcher.ratio())
        if ratios:
            out[words[i]] = len(ratios), max(ratios)
    return out


def _sides(first, second, turn):
    rows = [(0, w) for w in first] + [(1, w) for w in second]
    ids = [turn[w] for _, w in rows]
    return pa.table({"side": [s for s, _ in rows], "norm": [w for _, w in rows], "fid": ids, "rank": [0] * len(rows), "first": ids})


@pytest.mark.parametrize(("one", "other", "threshold"), [
    ("customer {:04}", "customer {:04}", 0.85), ("user{:04}@example.com", "user{:04}@example.com", 0.85),
    ("customer {:03}", "customer {:04}", 0.85), ("customer {:05}", "customer {:03}", 0.7), ("é{:04}x", "x{:04}é", 0.4)])
def test_forms_that_differ_in_digits_are_counted_by_digits(monkeypatch, one, other, threshold):
    """As by comparing all pairs, whichever form comes first, but only ways in which digits repeat are compared."""
    rng = random.Random(3)
    first, second = ([f.format(i) for i in rng.sample(range(10 ** int(f[f.index("0") + 1])), 900)] for f in (one, other))
    second = first if one == other else second
    words = list(dict.fromkeys(first + second))
    rng.shuffle(words)
    turn = {w: i for i, w in enumerate(words)}
    asked, plain = [], matching.Texts.matched
    monkeypatch.setattr(matching.Texts, "matched", lambda texts, a, b, *rest: asked.append(len(a)) or plain(texts, a, b, *rest))
    rows = matching.counted_by_digits(_sides(first, second, turn), threshold, 0.6).to_pylist()
    got = {words[r["fid"]]: (r["links"], r["best"]) for r in rows}
    some = first[:60]
    members = set(second)
    for w in some:  # links to the second forms only
        others = [x for x in words if x in members or x == w]
        want = plain_counts(others, [others.index(w)], threshold)
        assert got.get(w) == want.get(w)
    assert 0 < sum(asked) < 50_000 < len(first) * len(second) / 10


def test_links_of_common_shapes_and_others(table, monkeypatch):
    """Links within and between common shapes, and between them and other forms, are all counted, once each."""
    monkeypatch.setattr(fuzzy, "SHAPE", 300)
    rng = random.Random(4)
    words = [f"customer {i}" for i in range(1500)] + [f"user{i}@example.com" for i in range(100, 700)] + [f"+{i} 555" for i in range(40)]
    words += ["custmer 12", "customer 1,5", "customers 800", "user12@example.co", "user@example.com", "customer", "x", "7", ""]
    rng.shuffle(words)
    forms = fuzzy.normal_forms(fuzzy.spellings(fuzzy.value_counts(table("v STRING, w STRING", [(w, w.upper()) for w in words]), ["v", "w"])))
    shapes = {(r["column"], r["shape"], r["forms"]) for r in fuzzy._common_shapes(forms).collect()}
    assert shapes == {(c, *s) for c in "vw" for s in (("customer 000", 900), ("customer 0000", 500), ("user000@example.com", 600))}
    texts = [w for w in words if w]
    of = [i for i, w in enumerate(texts) if i % 23 == 0 or not w[-1].isdigit() and not w.startswith("user") or len(w) < 12 or "," in w]
    got = {(r["column"], r["norm"]): (r["links"], r["best"]) for r in fuzzy.similar_counts(forms).collect()}
    want = plain_counts(texts, of)
    assert {c: {texts[i]: got[c, texts[i]] for i in of if (c, texts[i]) in got} for c in "vw"} == {"v": want, "w": want}
    assert sum(n for (c, _), (n, _) in got.items() if c == "v") % 2 == 0


def test_no_pair_of_forms_of_common_shapes_meets_by_tiles(table):
    """In a column of numbered names hardly any pairs are left to compare."""
    forms = fuzzy.normal_forms(fuzzy.spellings(fuzzy.value_counts(table("v STRING", [(f"customer {i}",) for i in range(1000, 4000)]), ["v"])))
    seen, plain = [], fuzzy._tile_pairs

    def tile_pairs(*args):
        seen.append(plain(*args)[0].count())
        return plain(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fuzzy, "_tile_pairs", tile_pairs)
        assert fuzzy.similar_counts(forms).count() == 3000
    assert seen == [0]


def test_shapes_that_cannot_meet_are_left_out():
    shapes = ["user000@example.com", "user0000@example.com", "user0000-at-example", "customer 000", "customers 0000", "nothing 00"]
    rows = pa.table({"a": pa.array([i for i in range(6) for _ in range(6)], pa.int64()), "b": pa.array([i for _ in range(6) for i in range(6)], pa.int64()),
                     "n": pa.array([1] * 36, pa.int64()), "first": [s for s in shapes for _ in shapes], "second": [s for _ in shapes for s in shapes]})
    met = pa.Table.from_batches(matching.shapes_meet(rows.to_batches(), 0.85, 0.6))
    pairs = set(zip(met["a"].to_pylist(), met["b"].to_pylist(), strict=True))
    assert pairs == {(i, i) for i in range(6)} | {(0, 1), (1, 0), (3, 4), (4, 3)}


@pytest.mark.parametrize("make", ["({0:03}) 555-{1:04}", "{1:04}{0:012}", "{1:032}", "é{1}-{0}", "{1:061}{0:03}", "{1:062}{0:03}"])
def test_pairs_are_ruled_out_by_their_longest_common_subsequence(make):
    """No similar pair is lost, and pairs within the sketches' bound that only share their characters are ruled out."""
    rng = random.Random(5)
    words = sorted({make.format(rng.randrange(1000), rng.randrange(10000)) for _ in range(300)})
    texts, every = matching.Texts(words), np.arange(len(words))
    asked = list(matching.candidates(texts, every, every, every, 0.85, 0.6))
    left = list(matching.reaching(texts, iter(asked), 0.85))
    pairs, kept = ({p for a, b in x for p in zip(a.tolist(), b.tolist(), strict=True)} for x in (asked, left))
    hits = {(a, b) for a, b in pairs if SequenceMatcher(None, words[a], words[b]).ratio() >= 0.85}
    assert hits <= kept <= pairs
    if make.startswith("("):
        assert len(kept) < len(pairs) / 3
