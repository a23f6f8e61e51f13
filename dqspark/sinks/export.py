"""Write cleaned tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dqspark import fixed
from dqspark.functions import cells


# Write cells as they are: no trimming, quotes doubled, empty text as nothing.
CSV_OPTIONS = {
    "header": True, "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def neutralize_formulas(df: DataFrame) -> DataFrame:
    """Text cells a spreadsheet would run as a formula get a leading quote."""
    return df.select(*[
        cells.neutralize(cells.ref(f.name)).alias(f.name) if cells.is_text(f.dataType)
        else cells.ref(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Neutralised CSV with a header and no row ids, one file per partition."""
    out = neutralize_formulas(df).drop(fixed.ROW_ID, fixed.BEFORE)
    out.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Parquet for further jobs; row ids kept so that audits can match rows."""
    df.write.mode(mode).parquet(path)


def write_log(log_rows: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Change log of a dozen rows as one CSV file."""
    log_rows.coalesce(1).write.mode(mode).options(**CSV_OPTIONS).csv(path)
