"""Parse dates that come in several written forms within one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqspark import fixed
from dqspark.functions.cells import date_label_no, strip

# Parse patterns by date format, in the order of fixed.DATE_FORMATS.
# Each entry: patterns when the month comes first, patterns when the day does.
_PATTERNS = {
    "YYYY-MM-DD": (["yyyy-M-d"], ["yyyy-M-d"]),
    "DD/MM/YYYY or MM/DD/YYYY": (["M/d/yyyy", "M/d/yy"], ["d/M/yyyy", "d/M/yy"]),
    "DD-MM-YYYY or MM-DD-YYYY": (["M-d-yyyy", "M-d-yy"], ["d-M-yyyy", "d-M-yy"]),
    "YYYY/MM/DD": (["yyyy/M/d"], ["yyyy/M/d"]),
    "DD.MM.YYYY": (["d.M.yyyy", "d.M.yy"], ["d.M.yyyy", "d.M.yy"]),
    "Month DD, YYYY": (["MMM d yyyy", "MMMM d yyyy"], ["MMM d yyyy", "MMMM d yyyy"]),
    "DD-Mon-YYYY": (["d-MMM-yyyy", "d-MMM-yy"], ["d-MMM-yyyy", "d-MMM-yy"]),
}


def _by_pattern(text: Column, pattern: str) -> Column:
    day = F.try_to_date(text, pattern)
    if not pattern.endswith("yyyy") and pattern.endswith("yy"):
        # Two-digit years run from 1969 to 2068.
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return day.cast("timestamp_ntz")


def parse_date(col: Column, *, dayfirst: bool = False) -> Column:
    """Text to TIMESTAMP_NTZ, each value by the pattern it matches.

    Deviation: values are parsed one by one, so a column mixing formats keeps
    all of them; year-first dates never swap day and month, and dotted dates are
    always day-first.  What fits no pattern becomes null.
    """
    text = strip(col)
    label = date_label_no(text)
    chain = None
    for i, (name, _) in enumerate(fixed.DATE_FORMATS):
        if name == "ISO datetime":
            value = text.try_cast("timestamp_ntz")
        else:
            source = text
            if name == "Month DD, YYYY":
                source = F.regexp_replace(F.regexp_replace(text, ",", " "), r"\s+", " ")
                source = F.regexp_replace(source, r"(?i)^sept ", "Sep ")
            value = F.coalesce(*[_by_pattern(source, p) for p in _PATTERNS[name][dayfirst]])
        chain = F.when(label == i, value) if chain is None else chain.when(label == i, value)
    return chain
