"""Exact duplicate rows: counting, listing and dropping.

Whole rows are wide, so they are shuffled only where they might repeat.  A first
pass groups 8-byte row hashes with map-side combining; if few hashes repeat, the
rows carrying them (and only those) are compared in full.  A hot row collapses
to one entry per task before any shuffle.  If many hashes repeat, the full keys
are grouped in one ordinary hash aggregate.  Both ways are exact: a hash only
selects candidates, it never decides.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import fixed
from dqspark.functions import cells
from dqspark.session import settle

BROADCAST_HASHES = 1_000_000  # 8 bytes each


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return False


def _key(field: T.StructField) -> Column:
    """Grouping key of a cell: NaN equals null, -0.0 equals 0.0."""
    col = cells.ref(field.name)
    if cells.is_float(field.dataType):
        return F.when(~F.isnan(col), col + F.lit(0.0).cast(field.dataType))
    return F.to_json(col) if _has_map(field.dataType) else col


def key_fields(df: DataFrame, subset: list[str] | None) -> list[T.StructField]:
    """Columns rows are matched on; unknown names are ignored."""
    fields = cells.data_fields(df)
    known = [f for f in fields if subset and f.name in subset]
    return known or fields


class Duplicates:
    """Duplicate rows of one table, matched on all columns or on a subset.

    Looks for repeated hashes once, when created; counting, keeping and listing
    then work on what that left over.
    """

    def __init__(self, df: DataFrame, subset: list[str] | None = None):
        self.df = df
        self._fields = key_fields(df, subset)
        self._keys = [f"_k{i}" for i in range(len(self._fields))]
        self._hash = F.xxhash64(*[_key(f) for f in self._fields])
        self._repeated = settle(
            df.groupBy(self._hash.alias("_h")).agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").select("_h"),
            "repeated-hashes",
        )
        self._n_repeated = self._repeated.count()

    @property
    def _narrow(self) -> bool:
        return self._n_repeated <= BROADCAST_HASHES

    def _near(self, how: str) -> DataFrame:
        hashes = F.broadcast(self._repeated)  # at most BROADCAST_HASHES numbers
        return self.df.join(hashes, self._hash == F.col("_h"), how)

    @cached_property
    def _groups(self) -> DataFrame:
        """(_row_id, n): first row id and size of each key that may repeat, written once."""
        rows = self._near("left_semi") if self._narrow else self.df
        row_id = F.col(fixed.ROW_ID) if fixed.ROW_ID in rows.columns else F.lit(0).cast("bigint")
        keys = [_key(f).alias(k) for f, k in zip(self._fields, self._keys)]
        return settle(
            rows.select(row_id.alias(fixed.ROW_ID), *keys).groupBy(*self._keys)
            .agg(F.min(fixed.ROW_ID).alias(fixed.ROW_ID), F.count(F.lit(1)).alias("n"))
            .select(fixed.ROW_ID, "n"),
            "repeated-rows",
        )

    def _first_ids(self) -> DataFrame:
        return self._groups.select(fixed.ROW_ID)

    def count(self) -> int:
        """Rows beyond the first copy; nulls are equal."""
        if not self._n_repeated:
            return 0
        return int(self._groups.agg(F.sum(F.col("n") - 1)).first()[0] or 0)

    def kept(self) -> DataFrame:
        """The table with the first copy, by row id, of each key."""
        if not self._n_repeated:
            return self.df
        if not self._narrow:
            return self.df.join(self._first_ids(), fixed.ROW_ID, "left_semi")
        # One reading of the table: both lists have at most one entry for each repeated key.
        first = F.broadcast(self._first_ids().select(F.col(fixed.ROW_ID).alias("_first")))
        marked = self._near("left").join(first, F.col(fixed.ROW_ID) == F.col("_first"), "left")
        return marked.where("_h IS NULL OR _first IS NOT NULL").drop("_h", "_first")

    def extra(self) -> DataFrame:
        """Later copies: exactly the rows `kept` leaves out."""
        if not self._n_repeated:
            return self.df.limit(0)
        rows = self._near("left_semi") if self._narrow else self.df
        return rows.join(self._first_ids(), fixed.ROW_ID, "left_anti").select(*self.df.columns)


def duplicate_count(df: DataFrame, subset: list[str] | None = None) -> int:
    return Duplicates(df, subset).count()


def drop_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return Duplicates(df, subset).kept().select(*df.columns)


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows `drop_duplicates` would remove.

    A subset none of whose columns exist has no duplicates to show.
    """
    if subset and not any(f.name in subset for f in cells.data_fields(df)):
        return df.limit(0)
    return Duplicates(df, subset).extra()
