"""Compare a table before and after cleaning.

A traced clean carries old values beside the new ones, so its changes come from
one reading of the cleaned table.  Otherwise rows are matched by ``_row_id``, a
unique key, so the joins have no hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import fixed
from dqspark.functions import cells
from dqspark.operators.clean import ChangeLog
from dqspark.operators.report import QualityReport


def dropped_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``before`` that ``after`` no longer has."""
    return before.join(after.select(fixed.ROW_ID), fixed.ROW_ID, "left_anti").select(*before.columns)


def changed_cells(before: DataFrame, after: DataFrame,
                  renames: Mapping[str, str] | None = None,
                  touched: Iterable[str] | None = None) -> DataFrame:
    """(_row_id, column, before, after, column_no) of every cell whose text differs.

    Covers rows and columns present in both; ``renames`` lines up new names with
    old ones; ``touched`` (see ChangeLog) names the columns that can differ, so
    that no others are read and shuffled.  If ``after`` is of a traced clean, only
    the schema of ``before`` is used, and nothing is joined.  Null and empty text are the same.  Deviation: texts are compared
    whole and only cut for display, and a number stays unchanged when only its
    type widened.
    """
    renames = dict(renames or {})
    touched = None if touched is None else set(touched)
    new_fields = {f.name: f for f in cells.data_fields(after)}
    pairs = []
    for no, f in enumerate(cells.data_fields(before)):
        target = new_fields.get(renames.get(f.name, f.name))
        if target is not None and (touched is None or f.name in touched):
            pairs.append((no, f, target))
    if not pairs:
        return before.sparkSession.createDataFrame(
            [], "_row_id BIGINT, column STRING, before STRING, after STRING, column_no INT")
    if fixed.BEFORE in after.columns:
        both = after.select(fixed.ROW_ID, *[F.col(fixed.BEFORE)[f"c{no}"].alias(f"_l{no}") for no, _, _ in pairs], *[
            cells.ref(t.name).alias(f"_r{no}") for no, _, t in pairs])
    else:
        left = before.select(fixed.ROW_ID, *[cells.ref(f.name).alias(f"_l{no}") for no, f, _ in pairs])
        right = after.select(fixed.ROW_ID, *[cells.ref(t.name).alias(f"_r{no}") for no, _, t in pairs])
        both = left.join(right, fixed.ROW_ID)
    entries = []
    for no, f, target in pairs:
        old, old_type, new, new_type = F.col(f"_l{no}"), f.dataType, F.col(f"_r{no}"), target.dataType
        if old_type != new_type and cells.is_number(old_type) and cells.is_number(new_type):
            old, new = old.cast("double"), new.cast("double")
            old_type = new_type = T.DoubleType()
        was = F.coalesce(cells.as_text(old, old_type), F.lit(""))
        now = F.coalesce(cells.as_text(new, new_type), F.lit(""))
        name = f"{f.name} → {target.name}" if f.name in renames else f.name
        entries.append(F.when(was != now, F.struct(
            F.lit(name).alias("column"), was.alias("before"), now.alias("after"),
            F.lit(no).alias("column_no"))))
    return (
        both.select(fixed.ROW_ID, F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .select(fixed.ROW_ID, "e.column", "e.before", "e.after", "e.column_no")
    )


def changed_sample(changes: DataFrame, n: int = fixed.CHANGED_SAMPLE) -> DataFrame:
    """First changes by row, then column, with texts cut for display."""
    return (
        changes.orderBy(fixed.ROW_ID, "column_no").limit(n)
        .select(fixed.ROW_ID, "column", cells.display(F.col("before")).alias("before"),
                cells.display(F.col("after")).alias("after"))
    )


def dropped_sample(dropped: DataFrame, n: int = fixed.DROPPED_SAMPLE) -> DataFrame:
    """First dropped rows by row id, every cell as display text."""
    shown = [
        cells.display(cells.as_text(cells.ref(f.name), f.dataType)).alias(f.name)
        for f in cells.data_fields(dropped)
    ]
    return dropped.orderBy(fixed.ROW_ID).limit(n).select(fixed.ROW_ID, *shown)


DELTA_SCHEMA = (
    "score_before INT, score_after INT, completeness_before DOUBLE, completeness_after DOUBLE, "
    "uniqueness_before DOUBLE, uniqueness_after DOUBLE, consistency_before DOUBLE, "
    "consistency_after DOUBLE, score_delta INT"
)


def _delta(before: QualityReport, after: QualityReport) -> tuple:
    pillars = [round(p, 1) for pair in zip(before.pillars, after.pillars) for p in pair]
    return (before.score, after.score, *pillars, after.score - before.score)


def score_delta(spark, before: QualityReport, after: QualityReport) -> DataFrame:
    """One row: score and pillars before and after, and the score's change."""
    return spark.createDataFrame([_delta(before, after)], DELTA_SCHEMA)


@dataclass
class Audit:
    """Everything a cleaning certificate states."""

    summary: DataFrame
    dropped: DataFrame
    changed: DataFrame


def audit(before: DataFrame, after: DataFrame, log: ChangeLog, old: QualityReport,
          new: QualityReport, *, source: str, remaining_findings: int) -> Audit:
    """Audit tables of a run; the summary is one row.

    ``remaining_findings`` is the number of findings of the cleaned table.
    """
    spark = before.sparkSession
    dropped = dropped_rows(before, after)
    changed = changed_cells(before, after, log.columns_renamed, log.touched)
    # Dropped rows follow from the counts of the log: cleaning only filters.
    facts = (source, log.rows_before, log.rows_after, log.cols_before, log.cols_after, log.steps,
             log.rows_before - log.rows_after, changed.count(), remaining_findings)
    summary = spark.createDataFrame([(*_delta(old, new), *facts)], (
        DELTA_SCHEMA + ", source STRING, rows_before BIGINT, rows_after BIGINT, cols_before INT, "
        "cols_after INT, rules ARRAY<STRING>, dropped_total BIGINT, changed_total BIGINT, "
        "remaining_findings BIGINT"))
    return Audit(summary, dropped, changed)
