import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import fixed
from dqspark.functions import cells, dates, spelling


def values(table, dtype, rows, column):
    df = table(f"v {dtype}", [(r,) for r in rows])
    return [r[0] for r in df.orderBy("_row_id").select(column).collect()]


def test_strip_is_python_strip(table):
    rows = ["  a ", " x ", "\x1cq\x1d", "a b", "", "　", "\ttab\n", "​z"]
    assert values(table, "STRING", rows, cells.strip(F.col("v"))) == [r.strip() for r in rows]


@pytest.mark.parametrize("x", [
    0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e20, 1e-3, 1e-4, 1.5e-5, 2e-10, 123456789012.25,
    -1e22, float("inf"), float("-inf"),
])
def test_float_text_is_python_repr(table, x):
    assert values(table, "DOUBLE", [x], cells.as_text(F.col("v"), T.DoubleType())) == [repr(x)]


def test_nan_is_missing(table):
    df = table("v DOUBLE", [(1.0,), (float("nan"),), (None,)])
    assert df.where(cells.missing(F.col("v"), T.DoubleType())).count() == 2


def test_to_number_takes_what_a_number_is(table):
    rows = ["1", " 2 ", "-.5", "5.", "1e3", "+4", "inf", "-Infinity", "1d", "1f", "0x10", "1_000", "1,2",
            "", "nan", "True", None]
    got = values(table, "STRING", rows, cells.to_number(F.col("v")))
    assert got == [1.0, 2.0, -0.5, 5.0, 1000.0, 4.0, math.inf, -math.inf] + [None] * 9


def test_date_labels_first_match(table):
    rows = ["2024-1-5", "5/1/24", "05-01-2024", "2024/1/5", "5.1.2024", "March 5, 2024", "Mar 5 2024",
            "5-Mar-24", "2024-01-05 10:00:00 and more", "2024-01", "hello"]
    names = [n for n, _ in fixed.DATE_FORMATS]
    got = values(table, "STRING", rows, cells.date_label(F.col("v")))
    assert got == [*names[:6], names[5], names[6], names[7], None, None]


def test_dates_each_by_its_own_pattern(table):
    rows = ["2024-01-05", "31/12/24", "31/12/70", "13/13/2024", "05.02.2024", "September 3, 2024",
            "Sept 3 2024", "sep 3, 2024", "3-Sep-68", "29/02/96", "2024-01-05T10:11:12", "1/2/024", "x"]
    got = values(table, "STRING", rows, dates.parse_date(F.col("v"), dayfirst=True).cast("string"))
    assert got == [
        "2024-01-05 00:00:00", "2024-12-31 00:00:00", "1970-12-31 00:00:00", None,
        "2024-02-05 00:00:00", "2024-09-03 00:00:00", "2024-09-03 00:00:00", "2024-09-03 00:00:00",
        "2068-09-03 00:00:00", "1996-02-29 00:00:00", "2024-01-05 10:11:12", None, None]


def test_month_first_does_not_touch_iso_or_dotted(table):
    rows = ["2024-01-05", "5/2/2024", "5.2.2024"]
    got = values(table, "STRING", rows, dates.parse_date(F.col("v")).cast("date").cast("string"))
    assert got == ["2024-01-05", "2024-05-02", "2024-02-05"]


def test_phones(table):
    rows = ["(200) 555-0001", "1 200 555 0001", "ext", "", None, "555-123"]
    digits = values(table, "STRING", rows, cells.clean_phone(F.col("v"), T.StringType()))
    assert digits == ["2005550001", "12005550001", "ext", "", None, "555123"]
    dashed = values(table, "STRING", rows, cells.clean_phone(F.col("v"), T.StringType(), "dashed"))
    assert dashed[:2] == ["200-555-0001", "1-200-555-0001"]


def test_whole_float_phone_has_no_extra_zero(table):
    got = values(table, "DOUBLE", [5551234567.0, None], cells.clean_phone(F.col("v"), T.DoubleType()))
    assert got == ["5551234567", None]


def test_formulas(table):
    rows = ["=1", " +1", "\t-x", "@a", "'=1", "a=1", "", None, "\t"]
    got = values(table, "STRING", rows, cells.neutralize(F.col("v")))
    assert got == ["'=1", "' +1", "'\t-x", "'@a", "'=1", "a=1", "", None, "\t"]


def test_display_cuts_at_eighty(table):
    got = values(table, "STRING", ["a" * 80, "a" * 81, None], cells.display(F.col("v")))
    assert got == ["a" * 80, "a" * 79 + "…", ""]


def test_title_is_python_title(table):
    rows = ["o'neil x-ray", "ÉCOLE 3rd", None]
    got = values(table, "STRING", rows, cells.title(F.col("v")))
    assert got == ["O'Neil X-Ray", "École 3Rd", None]
