"""Type tables after reading, stack them, check them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import fixed
from dqspark.functions import cells

SUFFIXES = (".csv", ".parquet")


class TableReadError(Exception):
    """An input that cannot be read as a table."""


def null_tokens(df: DataFrame) -> DataFrame:
    """Words that mean "no value" become null; padded ones stay text."""
    return df.select(*[
        F.when(~cells.ref(f.name).isin(*fixed.NULL_TOKENS), cells.ref(f.name)).alias(f.name)
        if cells.is_text(f.dataType) and f.name != fixed.SOURCE_FILE else cells.ref(f.name)
        for f in df.schema.fields
    ])


def _integer(col):
    return F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), col.try_cast("bigint"))


def _boolean(col):
    return F.when(col.isin(*fixed.TRUE_WORDS), F.lit(True)).when(
        col.isin(*fixed.FALSE_WORDS), F.lit(False))


_READERS = {"bigint": _integer, "double": cells.to_number, "boolean": _boolean}


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type per text column: bigint, double, boolean or string, from one aggregate.

    A column gets a type when every value reads as it; dates stay text, and a
    column without values is double.
    """
    texts = [f.name for f in cells.data_fields(df)
             if cells.is_text(f.dataType) and f.name != fixed.SOURCE_FILE]
    if not texts:
        return {}
    aggs = []
    for i, name in enumerate(texts):
        col = cells.ref(name)
        aggs.append(F.count(col).alias(f"n{i}"))
        aggs += [F.count(read(col)).alias(f"{kind}{i}") for kind, read in _READERS.items()]
    row = df.agg(*aggs).first()
    types = {}
    for i, name in enumerate(texts):
        n = row[f"n{i}"]
        if n == 0:
            types[name] = "double"
            continue
        types[name] = next((k for k in _READERS if row[f"{k}{i}"] == n), "string")
    return types


def apply_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return df.select(*[
        _READERS[types[c]](cells.ref(c)).alias(c) if types.get(c) in _READERS else cells.ref(c)
        for c in df.columns
    ])


def _wider(types: set[str]) -> str:
    """Common type of one column over several tables."""
    if len(types) == 1:
        return next(iter(types))
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    if types <= numbers:
        return "double" if types & {"float", "double"} else "bigint"
    return "string"


def stack(tables: Mapping[str, DataFrame]) -> tuple[DataFrame, bool]:
    """Rows of all tables, matched by column name, labelled in ``_source_file``.

    Columns a table lacks are null; a column of different types gets the wider
    one.  Also tells whether the headers differ.
    """
    seen: dict[str, set[str]] = {}
    for df in tables.values():
        for f in df.schema.fields:
            seen.setdefault(f.name, set()).add(f.dataType.simpleString())
    target = {name: _wider(types) for name, types in seen.items()}
    out = None
    for label, df in tables.items():
        piece = df.select(F.lit(label).alias(fixed.SOURCE_FILE), *[
            _as_type(f, target[f.name]).alias(f.name) for f in df.schema.fields
        ])
        out = piece if out is None else out.unionByName(piece, allowMissingColumns=True)
    headers = {tuple(f.name for f in cells.data_fields(df)) for df in tables.values()}
    return out, len(headers) > 1


def _as_type(f: T.StructField, target: str):
    col = cells.ref(f.name)
    if f.dataType.simpleString() == target:
        return col
    return cells.as_text(col, f.dataType) if target == "string" else col.cast(target)


def check(df: DataFrame, name: str) -> DataFrame:
    """The table itself, or `TableReadError` when it cannot be worked with."""
    problem = problem_of(df, name)
    if problem:
        raise TableReadError(problem)
    return df


def check_suffix(name: str) -> None:
    if not name.lower().endswith(SUFFIXES):
        raise TableReadError(f"Unsupported file type: {name}. Use {' or '.join(SUFFIXES)}.")


def problem_of(df: DataFrame, name: str) -> str | None:
    if not cells.data_fields(df):
        return f"'{name}' has no columns."
    if df.isEmpty():
        return f"'{name}' has no rows. Use a file that contains data."
    return None
