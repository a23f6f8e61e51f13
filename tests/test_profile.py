import re

import pytest
from pyspark.sql import functions as F

from dqspark import fixed
from dqspark.functions import cells
from dqspark.operators import dedupe, findings, profile, report
from dqspark.operators.profile import column_facts, column_sample, count_cells


def roles(df):
    return {f.name: f.own_role for f in column_facts(df)}


def test_number_of_six_digits_reads_as_phone_before_id(table):
    df = table("order_id BIGINT, ref BIGINT", [(1234567 + i, i) for i in range(12)])
    assert roles(df) == {"order_id": "phone", "ref": "id"}


def test_id_by_content_needs_ten_unique_numbers(table):
    assert roles(table("n BIGINT", [(i,) for i in range(9)])) == {"n": None}
    assert roles(table("n BIGINT", [(i,) for i in range(10)])) == {"n": "id"}
    assert roles(table("n BIGINT", [(i // 2,) for i in range(20)])) == {"n": None}
    assert roles(table("s STRING", [(f" {i} ",) for i in range(19)] + [("x",)])) == {"s": "id"}


def test_one_repeat_makes_no_id(table):
    rows = [(i, i, i / 4, f" {i}") for i in range(3000)] + [(0, 3000, 0.0, "0 ")]
    assert roles(table("n BIGINT, m BIGINT, x DOUBLE, s STRING", rows)) == {"n": None, "m": "id", "x": None, "s": None}


def test_zeros_of_both_signs_are_written_differently(table):
    rows = [(i / 4,) for i in range(1, 300)] + [(0.0,), (-0.0,)]
    assert roles(table("x DOUBLE", rows)) == {"x": "id"}
    assert roles(table("x DOUBLE", rows + [(0.25,)])) == {"x": None}


CELLS = [
    "2024-01-05", " 5/1/2024 ", "05-11-24", "2024/1/5", "1.2.2024", "January 5, 2024", "Sep 5 2024", "5-Jan-24",
    "2024-01-05T10:11:12", "2024-01-05 10:11:12+02:00", "2024-01-05T10:11Z and more text of any kind, as long as it may be here",
    "a@b.co", "a@b", "  A.b+c@x-y.co.uk", "@", "12", "-12.5", "1e5", "1E-5", ".5", "5.", "1,234", "1 234", "$1,234.50", "€5",
    "inf", "-Infinity", "infinite", "nan", " NaN", "None", "NULL", "null ", "", "  ", "\u00a0", "\u2003x\u2003", "x\t",
    "+1 (555) 123-4567", "(555) 123-4567", "555.123.4567", "5551234567", "123456", "12345", "1" * 15, "1" * 16, "1" * 60,
    "123-4567 ext", "12-3456", "Customer 1234567", "a,b", ",123", "x" * 200, "1T2", "e", "T", "=1+1", "=10000", "12:30", "12/2024",
]


def _one_by_one(value):
    """What a column of this one cell counts, by the patterns as they stand."""
    text = value.strip(fixed.WHITESPACE)
    filled = text.lower() not in fixed.BLANK_WORDS
    own = text if filled else None
    flat = re.sub(r"[,\s]", "", text)

    def number(x):
        return bool(re.search(fixed.NUMBER, x, re.A) or re.search(fixed.INFINITE, x, re.A))

    label = next((n for n, p in fixed.DATE_FORMATS if own and re.search(p, own, re.A)), None)
    return {
        "filled": filled, "placeholders": text in fixed.PLACEHOLDERS, "padded": text != value,
        "emails": bool(own and re.search(fixed.EMAIL, own)), "numbers": bool(own and number(own)),
        "phones": bool(own and re.search(fixed.PHONE, own, re.A) and label is None),
        "good_phones": bool(own and 7 <= len(re.findall("[0-9]", own)) <= 15), "loose_numbers": bool(own and number(flat)),
        "currency_found": bool(re.search(fixed.CURRENCY_FINDING, value, re.A)),
        "currency_hits": bool(re.search(fixed.CURRENCY_SYMBOL, value)),
        "currency_cleanable": bool(re.search(fixed.CURRENCY_CLEANER, value)), "labels": [(label, 1)] if label else [],
    }


def test_shapes_tell_what_the_patterns_tell(table):
    """Every cell as a column of its own: counts equal those of the patterns tried on it."""
    schema = ", ".join(f"c{i} STRING" for i in range(len(CELLS)))
    facts = count_cells(table(schema, [tuple(CELLS)]))
    for value, fact in zip(CELLS, facts, strict=True):
        want = _one_by_one(value)
        got = {k: getattr(fact, k) if k == "labels" else bool(getattr(fact, k)) for k in want}
        assert got == want, value


def test_numbers_tell_what_their_texts_tell(table):
    """Phones and digit counts of numbers by size equal those of their texts."""
    doubles = [0.0, -0.0, 1.5, 12345.67, 1234567.0, 123456.7, 1e6, 99999.99, 1e9, 1e12, 1.0e15, 1e16, 1e-5, 0.001, 123.4567,
               1234.5678, 555123.4567, -1234567.25, 1.2300000000000002, float("nan"), float("inf"), 4.35, 123456789.12, 100000.0]
    whole = [0, 99999, 100000, 999999, 1000000, -1000000, 10**15 - 1, 10**15, -(2**63)] + [7] * 15
    rows = list(zip(doubles, whole, strict=True))
    for i, (x, n) in enumerate(rows):
        facts = count_cells(table("x DOUBLE, n BIGINT", [(x, n)]))
        texts = table("x DOUBLE, n BIGINT", [(x, n)]).select(
            cells.as_text(F.col("x"), facts[0].dtype), cells.as_text(F.col("n"), facts[1].dtype)).first()
        for fact, text in zip(facts, texts, strict=True):
            phone = text is not None and re.search(fixed.PHONE, text, re.A) is not None
            good = text is not None and 7 <= len(re.findall("[0-9]", text)) <= 15
            assert (fact.phones, fact.good_phones) == (phone, good), (i, text)


def test_a_cell_is_stripped_once(table):
    """At most two trims a text column in the optimised plan of the counts."""
    df = table("a STRING, b STRING", [("x", "1")])
    facts = [profile.ColumnFacts(f"c{i}", f.dataType) for i, f in enumerate(df.schema.fields[1:])]
    rows = df.select(F.col("_row_id").alias("id"), F.col("a").alias("c0"), F.col("b").alias("c1"))
    plan = profile._text_counts(rows, facts, [0, 1])._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("trim(") <= 2 * 2


def test_empty_column_gets_role_by_name_only(table):
    assert roles(table("user_id STRING, paid STRING", [(None, " "), (None, "nan")])) == {
        "user_id": "id", "paid": None}


def test_mixed_dates_make_a_role_less_column_a_date(table):
    rows = [("2024-01-05",), ("5/1/2024",), ("a",), ("b",), ("c",)]
    df = table("v STRING", rows)
    fact = report.build_report(df).facts[0]
    assert (fact.own_role, fact.role, len(fact.date_formats)) == (None, "date", 2)


def test_midnight_timestamps_read_as_days(spark):
    df = spark.sql("SELECT id AS _row_id, timestamp_ntz'2024-01-01' + make_dt_interval(id) AS d, "
                   "timestamp_ntz'2024-01-01' + make_dt_interval(id, 1) AS t FROM range(20)")
    facts = {f.name: f.date_formats for f in column_facts(df)}
    assert facts == {"d": ["YYYY-MM-DD"], "t": ["ISO datetime"]}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sample_is_the_first_values_whatever_the_partitions(spark, parts):
    df = spark.range(0, 30000, 1, 3).select(
        (F.col("id") * 7 + 5).alias("_row_id"),
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).alias("sparse"),
        F.when(F.col("id") >= 29000, F.concat(F.lit(" v"), "id")).alias("late"),
        F.when(F.col("id") % 2 == 0, "  ").otherwise(F.col("id").cast("string")).alias("half"),
        F.lit(None).cast("string").alias("none"),
    ).repartition(parts, "half")
    got = {}
    for r in column_sample(df, 2000).orderBy("column", "rn").collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got["sparse"] == [str(i) for i in range(0, 30000, 50)]
    assert got["late"] == [f"v{i}" for i in range(29000, 30000)]
    assert got["half"] == [str(i) for i in range(1, 4000, 2)]
    assert "none" not in got
    facts = {f.name: f for f in column_facts(df)}
    assert (facts["half"].filled, facts["late"].filled, facts["sparse"].filled) == (15000, 1000, 600)


def test_decisions_look_at_whole_columns(spark):
    """Old rows first: what the column is shows only after thousands of rows."""
    late = F.col("id") >= 3000
    df = spark.range(10000).select(
        F.col("id").alias("_row_id"),
        F.when(late, F.concat("id", F.lit("@x.org"))).otherwise("none yet").alias("contact"),
        F.when(late, "2024-01-05").otherwise("5/1/2024").alias("day"),
        F.when(late, F.concat(F.lit("$"), "id")).otherwise("free").alias("price"),
        F.when(late, "text").otherwise("1").alias("kind"),
    )
    facts = {f.name: f for f in column_facts(df)}
    assert facts["contact"].role == "email" and facts["contact"].invalid_emails == 3000
    assert facts["day"].date_formats == ["YYYY-MM-DD", "DD/MM/YYYY or MM/DD/YYYY"]
    assert facts["price"].currency_hits == 7000
    from dqspark.operators import fuzzy

    assert "kind" in fuzzy.text_columns(df)


def test_counts_treat_nan_as_missing(table):
    facts = count_cells(table("d DOUBLE, s STRING", [(1.0, "a"), (float("nan"), None), (None, " ")]))
    assert [f.missing for f in facts] == [2, 1]
    assert facts[1].placeholders == 1 and facts[1].padded == 1


def test_many_columns(spark):
    df = spark.range(40).select(F.col("id").alias("_row_id"), *[
        (F.col("id") % 3).cast("string").alias(f"c {i}.x") for i in range(70)])
    rep = report.build_report(df)
    assert len(rep.facts) == 70 and rep.duplicates == 37


def test_odd_column_names(table):
    df = table("`a.b` STRING, `c``d` STRING, `e f` STRING", [("x", " y", "z")] * 3)
    rep = report.build_report(df)
    assert [f.name for f in rep.facts] == ["a.b", "c`d", "e f"] and rep.facts[1].padded == 3


def test_empty_table(table):
    rep = report.build_report(table("a STRING, b DOUBLE", []))
    assert (rep.n_rows, rep.score, rep.duplicates) == (0, 100, 0)


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("parts", [1, 5])
def test_duplicates_both_ways(spark, monkeypatch, limit, parts):
    monkeypatch.setattr(dedupe, "BROADCAST_HASHES", limit)
    df = spark.range(900).select(
        F.col("id").alias("_row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.when(F.col("id") % 3 != 0, F.lit(float("nan"))).alias("x"),
    ).withColumn("x", F.when(F.col("_row_id") % 2 == 0, F.col("x"))).repartition(parts)
    assert dedupe.duplicate_count(df) == 299
    kept = [r[0] for r in dedupe.drop_duplicates(df).select("_row_id").orderBy("_row_id").collect()]
    assert kept == [0] + [i for i in range(900) if i % 3]
    extra = dedupe.duplicate_rows(df).select("_row_id").count()
    assert extra == 299 and len(kept) + extra == 900


def test_null_and_nan_rows_are_equal(table):
    df = table("x DOUBLE, s STRING", [(None, "a"), (float("nan"), "a"), (0.0, "b"), (-0.0, "b"), (None, None)])
    assert dedupe.duplicate_count(df) == 2


def test_map_columns_can_be_compared(spark):
    df = spark.sql("SELECT id AS _row_id, map('a', id % 2) AS m, array(id % 2) AS r FROM range(6)")
    assert dedupe.duplicate_count(df) == 4


def test_unknown_subset(table):
    df = table("a STRING", [("x",), ("x",)])
    assert dedupe.duplicate_rows(df, ["zz"]).count() == 0
    assert dedupe.drop_duplicates(df, ["zz"]).count() == 1


def test_findings_of_contacts(spark, contacts):
    rep = report.build_report(contacts)
    found = findings.findings(contacts, rep).collect()
    assert [f["severity"] for f in found] == sorted(
        (f["severity"] for f in found), key=["high", "medium", "low"].index)
    by_id = {f["id"]: f for f in found}
    assert by_id["empty-column:fax"]["severity"] == "high"
    assert by_id["placeholders:note"]["samples"] == ["NULL", "nan"]
    assert by_id["whitespace:note"]["samples"] == ["'  '", "' nan'"]
    assert len(by_id["currency:balance"]["samples"]) == 4
    assert by_id["exact-duplicates"]["samples"][0].startswith("Customer 0 · ")


def test_severity_edges():
    assert findings.severity(5, 100, "duplicates") == "high"
    assert findings.severity(1, 100, "duplicates") == "medium"
    assert findings.severity(1, 101, "duplicates") == "low"
    assert findings.severity(0, 0, "missing") == "low"


def test_nested_columns_pass_through(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "_row_id")
    rep = report.build_report(df)
    assert [(f.name, f.role, f.missing) for f in rep.facts] == [("embedding", None, 0), ("label", None, 0)]
    assert rep.duplicates == 0 and findings.findings(df, rep).count() == 0
