import random
import statistics

import pytest
from pyspark.sql import functions as F

from dqspark.operators import audit, fuzzy, median, preview, report
from dqspark.operators import clean as cleaner
from dqspark.operators.clean import CleaningOptions, clean, merge_spellings
from dqspark.operators.rename import compose, plan_renames, snake
from dqspark.plans import recipe


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("_row_id").select(*cols).collect()]


def test_nothing_selected(table):
    out, log = clean(table("a STRING", [(" x",)]), CleaningOptions())
    assert rows(out, "a") == [(" x",)] and log.steps == ["No cleaning steps were selected."]
    assert (log.rows_before, log.rows_after, log.cols_after) == (1, 1, 1)


@pytest.mark.parametrize("keys", [
    ["trim_whitespace"], ["fix_emails"], ["normalize_phones"], ["drop_exact_duplicates"],
    ["trim_whitespace", "fix_emails", "normalize_phones", "drop_exact_duplicates"],
])
def test_cleaning_twice_changes_nothing_more(contacts, keys):
    once, _ = clean(contacts, CleaningOptions.from_keys(keys))
    twice, log = clean(once, CleaningOptions.from_keys(keys))
    assert audit.changed_cells(once, twice).count() == 0 and log.duplicates_dropped == 0


def test_dropped_and_kept_make_the_original(contacts):
    out, log = clean(contacts, recipe.options_from_profile("transactions"))
    dropped = audit.dropped_rows(contacts, out)
    assert dropped.count() == log.rows_before - log.rows_after
    assert dropped.count() + out.count() == contacts.count() == log.rows_before


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_result_does_not_depend_on_partitions(contacts, parts):
    out, log = clean(contacts.repartition(parts, "note"), recipe.options_from_profile("transactions"))
    base, base_log = clean(contacts, recipe.options_from_profile("transactions"))
    assert out.exceptAll(base).isEmpty() and base.exceptAll(out).isEmpty()
    assert log == base_log


def test_currency_half_must_parse(table):
    df = table("a STRING, b STRING, c STRING", [
        ("$1,000.50", "$1", "$x"), ("€2", "3", "$y"), (None, "$4", "$5"), ("junk", "7", "$z")])
    out, log = clean(df, CleaningOptions(strip_currency=True))
    assert rows(out, "a", "b", "c") == [
        (1000.5, 1, "$x"), (2.0, 3, "$y"), (None, 4, "$5"), (None, 7, "$z")]
    assert dict(out.dtypes)["b"] == "bigint" and log.currency_lost == {"a": 1, "b": 0}


def test_dates_keep_mixed_formats_and_skip_numbers(table):
    df = table("v STRING, updated_count BIGINT, candidate STRING", [
        ("2024-01-05", 1, "Bob"), ("31/12/24", 2, "Eve"), ("nope", 3, "Al")])
    out, log = clean(df, CleaningOptions(fix_dates=True, dayfirst=True))
    assert log.dates_parsed == ["v"] and log.dates_lost == {"v": 1}
    assert dict(out.dtypes)["updated_count"] == "bigint"
    assert [str(r[0])[:10] for r in rows(out, "v")] == ["2024-01-05", "2024-12-31", "None"]


def test_a_currency_column_is_not_tried_as_date(table):
    df = table("date_paid STRING", [("$1",), ("$2",)])
    _, log = clean(df, CleaningOptions(strip_currency=True, fix_dates=True))
    assert log.standardized == ["currency:date_paid"] and not log.dates_parsed


def test_spellings_leave_role_columns_alone(table):
    data = [(f"user{i}@x.com", "Acme" if i % 3 else "ACME") for i in range(30)]
    df = table("email STRING, firm STRING", data)
    out, log = clean(df, CleaningOptions(collapse_fuzzy=True))
    assert out.select("email").distinct().count() == 30
    assert out.select("firm").distinct().count() == 1 and log.fuzzy_collapsed == 10
    out, _ = clean(df, CleaningOptions(collapse_fuzzy=True, include_role_columns=True))
    assert out.select("email").distinct().count() < 30


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def spelled(table):
    rnd = random.Random(5)
    firms = ["Acme", "ACME", "acme", "Bolt Ltd", "BOLT ltd", "Zürich 1", "ZÜRICH 1", None, "", " Acme"]
    data = [("hot HOT" if i % 3 else rnd.choice(["Hot hot", "hot hot"]), rnd.choice(firms),
             rnd.choice(["0:x", "0:X", "1:Acme", None]), f"+49 30 {i:07}") for i in range(400)]
    return table("a STRING, `firm name` STRING, c STRING, phone STRING", data)


def test_merging_is_one_lookup_or_one_join(spelled, monkeypatch):
    options = CleaningOptions(collapse_fuzzy=True)
    small, log = clean(spelled, options)
    assert "Join" not in plan_of(small)
    counted = merge_spellings(spelled, fuzzy.scan(spelled).groups)
    assert counted[1] == log.fuzzy_collapsed > 0 and counted[2] == ["a", "firm name", "c"]
    monkeypatch.setattr(cleaner, "BROADCAST_SPELLINGS", 0)
    large, large_log = clean(spelled, options)
    assert plan_of(large).count("Join") == 2 and log == large_log and large.columns == small.columns
    want = {}
    for g in fuzzy.scan(spelled).groups.collect():
        want |= {(g["column"], v): g["suggested"] for v in g["variants"]}
    names = ["a", "firm name", "c"]
    plain = [(r["_row_id"], *[want.get((c, r[c]), r[c]) for c in names]) for r in spelled.collect()]
    for out in (small, large):
        assert rows(out, "_row_id", "a", "`firm name`", "c") == sorted(plain)
        assert counted[0].exceptAll(out).isEmpty()


def test_merging_with_doubtful_groups(spelled):
    """Variants named twice, unknown columns, values that are not there: each cell is still replaced once."""
    groups = fuzzy.scan(spelled).groups.where("false").drop("variants", "counts", "suggested", "column")
    rows_ = [("a", ["hot hot", "Hot hot", "x"], "hot hot"), ("a", ["Hot hot"], "Other"), ("gone", ["u", "v"], "u")]
    given = spelled.sparkSession.createDataFrame(rows_, "column string, variants array<string>, suggested string")
    given = given.join(groups, F.lit(False), "left").withColumn("counts", F.lit(None).cast("map<string,bigint>"))
    out, changed, columns, used = merge_spellings(spelled, given)
    hot = spelled.where("a = 'Hot hot'").count()
    assert (changed, columns, used) == (hot, ["a"], 1) and out.count() == 400
    assert out.where("a = 'Other'").count() == hot  # the first in order of two spellings named
    assert merge_spellings(spelled.where("false"), given)[0].count() == 0


def test_only_changed_columns_are_profiled_again(spelled, monkeypatch):
    asked, real = [], cleaner.column_facts

    def noted(df, **options):
        asked.append(df.columns[1:])
        return real(df, **options)

    monkeypatch.setattr(cleaner, "column_facts", noted)
    options = CleaningOptions(collapse_fuzzy=True, fix_emails=True, normalize_phones=True, fix_dates=True)
    out, log = clean(spelled, options)
    assert asked == [["a", "firm name", "c", "phone"], ["a", "firm name", "c"], ["phone"]]
    assert log.rows_before == 400 and rows(out, "phone")[0] == ("49300000000",)


@pytest.mark.parametrize("empty", [None, "x"])
def test_rows_with_gaps_are_counted_with_the_nulls(table, empty):
    df = table("a STRING, b STRING, c STRING", [("x", None, empty), (None, None, None), ("y", "z", empty)])
    out, log = clean(df, CleaningOptions(drop_empty_columns=True, drop_empty_rows=True, missing_strategy="drop_rows"))
    assert rows(out, "a") == [("y",)] and (log.rows_after, out.count(), log.empty_rows_removed) == (1, 1, 1)


def test_spellings_are_looked_for_after_trimming(table):
    df = table("v STRING", [("a b",), (" a b",), ("a b ",)])
    out, log = clean(df, CleaningOptions(trim_whitespace=True, collapse_fuzzy=True))
    assert out.select("v").distinct().count() == 1
    assert log.steps[-1].startswith("Similar-spelling merge skipped")


def test_placeholders_stay_text_when_trimmed(table):
    out, _ = clean(table("v STRING", [("  ",), (" NULL ",), (None,)]), CleaningOptions(trim_whitespace=True))
    assert rows(out, "v") == [("",), ("NULL",), (None,)]


def test_casing_skips_ids_and_emails(table):
    data = [(f"{i}", f"u{i}@X.com", "mary o'neil") for i in range(12)]
    df = table("code STRING, mail STRING, name STRING", data)
    out, _ = clean(df, CleaningOptions(casing="title"))
    assert rows(out, "mail", "name")[0] == ("u0@X.com", "Mary O'Neil")


def test_fill_values(table):
    df = table("n BIGINT, d DOUBLE, s STRING, t TIMESTAMP_NTZ", [
        (1, 1.0, "a", None), (None, float("nan"), None, None), (4, 5.0, "b", None), (7, None, "", None)])
    out, log = clean(df, CleaningOptions(missing_strategy="fill", numeric_fill="median", fill_value="?"))
    assert rows(out, "n", "d", "s", "t")[1] == (4.0, 3.0, "?", None)
    assert log.missing_filled == 4
    out, log = clean(df, CleaningOptions(missing_strategy="fill", fill_value="x"))
    assert log.fill_skipped == ["n", "d"] and rows(out, "n", "s")[1] == (None, "x")
    out, log = clean(df, CleaningOptions(missing_strategy="fill", fill_value="9"))
    assert rows(out, "n", "d")[1] == (9, 9.0)


def test_row_and_column_drops_share_counts(table):
    df = table("a STRING, b STRING, c STRING", [("x", None, None), (None, None, None), ("y", "z", None)])
    out, log = clean(df, CleaningOptions(
        drop_empty_columns=True, drop_empty_rows=True, missing_strategy="drop_columns",
        missing_threshold_pct=50))
    assert out.columns == ["_row_id", "a"] and (log.empty_rows_removed, log.rows_after) == (1, 2)
    out, log = clean(df, CleaningOptions(drop_empty_columns=True, missing_strategy="drop_rows"))
    assert rows(out, "a", "b") == [("y", "z")] and (log.rows_before, log.rows_after) == (3, 1)


@pytest.mark.parametrize("kind", ["spread", "ties", "even", "negative"])
def test_bracketed_median_is_exact(spark, kind):
    rnd = random.Random(kind)
    n = 6001 if kind != "even" else 6000
    data = {
        "spread": [rnd.uniform(-1e6, 1e6) for _ in range(n)],
        "ties": [float(rnd.choice([1, 1, 1, 1, 2, 3])) for _ in range(n)],
        "even": [float(i) for i in range(n)],
        "negative": [-rnd.expovariate(1) for _ in range(n)],
    }[kind]
    rnd.shuffle(data)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "_row_id BIGINT, x DOUBLE")
    ordered = sorted(data)
    want = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert median.exact_medians(df, {"x": n}, direct=50)["x"] == want
    assert median.exact_medians(df, {"x": n})["x"] == want


def test_medians_of_many_columns_take_three_jobs(spark):
    rnd = random.Random(4)
    data = [[rnd.choice([None, float("nan"), rnd.uniform(-9, 9), float(rnd.randint(0, 3))]) for _ in range(7)] for _ in range(3000)]
    df = spark.createDataFrame(data, ", ".join(f"x{i} DOUBLE" for i in range(7)))
    real = [[r[i] for r in data if r[i] is not None and r[i] == r[i]] for i in range(7)]
    counts = {f"x{i}": len(v) for i, v in enumerate(real)} | {"none": 0}
    spark.sparkContext.setJobGroup("medians", "medians")
    got = median.exact_medians(df, counts, direct=100)
    assert got == {f"x{i}": statistics.median(v) for i, v in enumerate(real)}
    queries = len(spark.sparkContext.statusTracker().getJobIdsForGroup("medians"))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert queries <= 7  # adaptive queries run a job a stage: two of two stages, one of three


def test_traced_changes_equal_joined_ones(contacts):
    for profile_id in ("transactions", "survey"):
        options = recipe.options_from_profile(profile_id)
        plain, log = clean(contacts, options)
        traced, same = clean(contacts, options, trace=True)
        assert log.items() == same.items()
        assert plain.exceptAll(traced.drop("_before")).isEmpty()
        want = audit.changed_cells(contacts, plain, log.columns_renamed, log.touched)
        got = audit.changed_cells(contacts, traced, log.columns_renamed, log.touched)
        assert want.count() == got.count() and want.exceptAll(got).isEmpty()


def test_traced_changes_need_no_join(contacts):
    after, log = clean(contacts, CleaningOptions(trim_whitespace=True, fix_dates=True, strip_currency=True), trace=True)
    plan = audit.changed_cells(contacts, after, log.columns_renamed, log.touched)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_renames():
    assert snake("Total ($)") == "total"
    assert plan_renames(["x", "y"], manual={"x": "y", "zz": "q", "y": " "}) == {"x": "y_2"}
    assert compose({"a": "b"}, {"b": "c", "d": "e", "a": "zz"}) == {"a": "c", "d": "e"}
    assert compose({"a": "b"}, {"b": "a"}) == {}


def test_snake_collisions():
    got = plan_renames(["A", "a b", "A B", "Total ($)"], "snake")
    assert got == {"A": "a", "a b": "a_b", "A B": "a_b_2", "Total ($)": "total"}


def test_changed_cells_compare_whole_text_and_line_up_renames(table):
    before = table("v STRING, n BIGINT, w STRING", [("x" * 90 + "a", 5, None), ("b", 6, "k")])
    after = before.select("_row_id", F.regexp_replace("v", "a$", "b").alias("V 2"),
                          F.col("n").cast("double").alias("n"), F.coalesce("w", F.lit("")).alias("w"))
    changes = audit.changed_cells(before, after, {"v": "V 2"})
    assert [(r["_row_id"], r["column"]) for r in changes.collect()] == [(0, "v → V 2")]
    assert len(audit.changed_sample(changes).first()["before"]) == 80


def test_changed_sample_is_in_row_then_column_order(contacts):
    out, log = clean(contacts, recipe.options_from_profile("transactions"))
    sample = audit.changed_sample(audit.changed_cells(contacts, out)).collect()
    assert len(sample) == 12 and sample[0]["_row_id"] == 0
    places = [(r["_row_id"], contacts.columns.index(r["column"])) for r in sample]
    assert places == sorted(places)


def test_audit_tables(spark, contacts):
    out, log = clean(contacts, recipe.options_from_profile("survey"))
    old, new = report.build_report(contacts), report.build_report(out)
    made = audit.audit(contacts, out, log, old, new, source="contacts", remaining_findings=3)
    row = made.summary.first()
    assert row["dropped_total"] == made.dropped.count() == log.duplicates_dropped
    assert row["score_delta"] == new.score - old.score and row["remaining_findings"] == 3
    assert audit.dropped_sample(made.dropped).count() == min(8, row["dropped_total"])


def test_logs_of_two_runs_add_up(contacts):
    first, log1 = clean(contacts, CleaningOptions(drop_exact_duplicates=True, manual_renames={"note": "n1"}))
    _, log2 = clean(first, CleaningOptions(manual_renames={"n1": "n2"}))
    both = log1.followed_by(log2)
    assert both.duplicates_dropped == log1.duplicates_dropped > 0
    assert both.columns_renamed == {"note": "n2"} and both.rows_before == log1.rows_before


def test_preview(table):
    df = table("a STRING, b STRING", [(None, None), ("x", None)])
    row = preview.effects(df).first()
    assert (row["empty_columns"], row["empty_rows"], row["rows_with_gaps"]) == (["b"], 1, 2)
    many = table("a STRING", [("x",)] * 60)
    assert rows(preview.duplicates(many), "_row_id") == [(i,) for i in range(1, 51)]


def test_saved_plans():
    text = recipe.save_plan("crm", ["fix_emails", "trim_whitespace", "zzz"], True)
    assert recipe.load_plan(text) == ("crm", ["trim_whitespace", "fix_emails"], True)
    assert recipe.load_plan('{"fix_keys": ["fix_dates"], "profile": 3}')[0] == "findings"
    for bad in ("[]", "{}", '{"fix_keys": ["zzz"]}', '{"fix_keys": null}'):
        with pytest.raises(recipe.PlanError):
            recipe.load_plan(bad)
    assert recipe.profile("unknown") == recipe.profile("findings")


def test_plan_without_findings(spark):
    from dqspark.operators.findings import SCHEMA

    none = spark.createDataFrame([], SCHEMA)
    assert recipe.propose(none).count() == 0
    assert recipe.plan_line(recipe.propose(none)).first()["line"] == "No steps selected"
    assert [r["fix_key"] for r in recipe.propose(none, "survey").collect()] == [
        "trim_whitespace", "drop_empty_columns", "drop_exact_duplicates"]


def test_a_fill_value_is_tested_against_all_types_at_once(table):
    df = table("s STRING, n BIGINT, d DATE", [(None, None, None), ("a", 1, None)])
    out, log = clean(df, CleaningOptions(missing_strategy="fill", fill_value="x"))
    assert log.fill_skipped == ["n"] and out.orderBy("_row_id").first()["s"] == "x"


def test_audit_counts_what_is_left(spark, contacts):
    out, log = clean(contacts, recipe.options_from_profile("survey"))
    old, new = report.build_report(contacts), report.build_report(out)
    from dqspark.operators import findings

    left = findings.findings(out, new).count()
    made = audit.audit(contacts, out, log, old, new, source="contacts", remaining_findings=left)
    assert made.summary.first()["remaining_findings"] == left > 0


def test_plan_merges_spellings_that_were_found(table):
    from dqspark.operators import findings, fuzzy

    df = table("city STRING", [("Berlin",), ("berlin",), ("BERLIN ",), ("Paris",)])
    made = report.build_report(df)
    found = findings.findings(df, made, fuzzy.scan(df, facts=made.facts).groups)
    assert "collapse_fuzzy" in [r["fix_key"] for r in recipe.propose(found).collect()]


def test_common_variants_are_not_joined(spelled, monkeypatch):
    """Cells of a common variant are looked up, the rest is joined once and not multiplied; both give one lookup's result."""
    groups = fuzzy.scan(spelled).groups
    want = merge_spellings(spelled, groups)[0]
    monkeypatch.setattr(cleaner, "BROADCAST_SPELLINGS", 4)
    monkeypatch.setattr(cleaner, "HOT_ROWS", 50)
    for stored in (False, True):
        out = merge_spellings(spelled, groups, stored=stored)[0]
        assert "_spellings_kept" in plan_of(out) or stored
        assert "explode(sequence" not in plan_of(out)
        assert want.exceptAll(out).isEmpty() and out.count() == want.count()
