"""Look before cleaning: what a step would affect, and the first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark import fixed
from dqspark.functions import cells
from dqspark.operators.dedupe import duplicate_rows


def duplicates(df: DataFrame, subset: list[str] | None = None,
               n: int = fixed.PREVIEW_DUPLICATES) -> DataFrame:
    """First of the rows that dropping duplicates would remove."""
    return head(duplicate_rows(df, subset), n)


def effects(df: DataFrame) -> DataFrame:
    """(empty_columns, empty_rows, rows_with_gaps), in one aggregate."""
    fields = cells.data_fields(df)
    gaps = [cells.missing(cells.ref(f.name), f.dataType) for f in fields]
    every, some = F.lit(True), F.lit(False)
    for g in gaps:
        every, some = every & g, some | g
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(every).alias("empty_rows"),
        F.count_if(some).alias("rows_with_gaps"),
        *[F.count_if(g).alias(f"m{i}") for i, g in enumerate(gaps)],
    )
    names = F.array_compact(F.array(*[
        F.when((F.col(f"m{i}") == F.col("n")) & (F.col("n") > 0), F.lit(f.name))
        for i, f in enumerate(fields)
    ]))
    return counts.select(names.alias("empty_columns"), "empty_rows", "rows_with_gaps")


def head(df: DataFrame, n: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """First rows by row id; a bounded top-k, not a full sort."""
    return df.orderBy(fixed.ROW_ID).limit(n)
