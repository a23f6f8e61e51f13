"""Column expressions over single cells.

All of them are built-in expressions, so they stay inside whole-stage codegen
and work the same in batch and streaming plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import fixed


def ref(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_fields(df: DataFrame) -> list[T.StructField]:
    """The table's own columns: everything but the engine's row id and the values carried for an audit."""
    return [f for f in df.schema.fields if f.name not in (fixed.ROW_ID, fixed.BEFORE)]


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_scalar(dtype: T.DataType) -> bool:
    """True for the types text checks look at; nested columns pass through."""
    return (
        is_text(dtype) or is_number(dtype) or is_moment(dtype)
        or isinstance(dtype, T.BooleanType)
    )


def missing(col: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a float column."""
    return col.isNull() | F.isnan(col) if is_float(dtype) else col.isNull()


def _float_text(col: Column) -> Column:
    """Positional digits for 1e-4 <= |x| < 1e16, else ``1e+16`` / ``1e-05`` style."""
    text = col.cast("string")
    size = F.abs(col)
    plain = text.try_cast("decimal(38,21)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", ".0")
    short = F.regexp_replace(text, r"\.0E", "E")
    for pattern, form in (
        (r"E(\d)$", "e+0$1"), (r"E(\d\d+)$", "e+$1"),
        (r"E-(\d)$", "e-0$1"), (r"E-(\d\d+)$", "e-$1"),
    ):
        short = F.regexp_replace(short, pattern, form)
    return (
        F.when(F.isnan(col), F.lit(None).cast("string"))
        .when(text.contains("Inf"), F.lower(F.regexp_replace(text, "inity", "")))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(short)
    )


def as_text(col: Column, dtype: T.DataType, *, date_only: bool = False) -> Column:
    """The text a person sees in the cell; null stays null.

    ``date_only`` renders a timestamp column without its time, which is how a
    column holding midnights only is shown.
    """
    if is_text(dtype):
        return col.cast("string")
    if is_float(dtype):
        return _float_text(col)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(col.cast("string"))
    if date_only and is_moment(dtype):
        return col.cast("date").cast("string")
    if is_scalar(dtype):
        return col.cast("string")
    return F.to_json(col)


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace, not just spaces."""
    return F.btrim(col, F.lit(fixed.WHITESPACE))


def non_blank(col: Column) -> Column:
    """Stripped value, or null where the cell is blank, nan or none."""
    text = strip(col)
    return F.when(~F.lower(text).isin(*fixed.BLANK_WORDS), text)


def is_placeholder(col: Column) -> Column:
    return F.coalesce(strip(col).isin(*fixed.PLACEHOLDERS), F.lit(False))


def is_padded(col: Column) -> Column:
    return F.coalesce(strip(col) != col, F.lit(False))


def is_email(col: Column) -> Column:
    return col.rlike(fixed.EMAIL)


def date_label_no(col: Column) -> Column:
    """Position of the first date format the value matches, else null."""
    chain = None
    for i, (_, pattern) in enumerate(fixed.DATE_FORMATS):
        chain = (
            F.when(col.rlike(pattern), F.lit(i)) if chain is None
            else chain.when(col.rlike(pattern), F.lit(i))
        )
    return chain


def date_label(col: Column) -> Column:
    """Name of the first date format the stripped value matches, else null."""
    labels = F.array(*[F.lit(name) for name, _ in fixed.DATE_FORMATS])
    return F.get(labels, date_label_no(strip(col)))


def is_phone_like(col: Column) -> Column:
    """Phone pattern, unless the value reads as a date."""
    return col.rlike(fixed.PHONE) & date_label_no(col).isNull()


def digits(col: Column) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(col, "[^0-9]", "")


def is_bad_phone(col: Column) -> Column:
    low, high = fixed.PHONE_DIGITS
    found = F.length(col) - F.length(F.translate(col, "0123456789", ""))
    return ~found.between(low, high)


def to_number(col: Column) -> Column:
    """Text to DOUBLE, null where it does not read as a number.

    The pattern keeps out forms the cast would take, such as ``1d`` and ``1f``.
    """
    infinite = F.lower(col).contains("inf") & col.rlike(fixed.INFINITE)
    return F.when(col.rlike(fixed.NUMBER), col.try_cast("double")).when(
        infinite, F.when(col.contains("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )


def currency_number(col: Column) -> Column:
    """Text without currency symbols, commas and spaces, as DOUBLE."""
    return to_number(F.regexp_replace(col, fixed.CURRENCY_REMOVED, ""))


def currency_integer(col: Column) -> Column:
    """As `currency_number`, but only for whole numbers, as BIGINT."""
    text = F.regexp_replace(col, fixed.CURRENCY_REMOVED, "")
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def display(col: Column) -> Column:
    """Cell text for reports: null is empty, long text is cut with an ellipsis."""
    text = F.coalesce(col, F.lit(""))
    cut = F.concat(F.substring(text, 1, fixed.CELL_CHARS - 1), F.lit("…"))
    return F.when(F.length(text) > fixed.CELL_CHARS, cut).otherwise(text)


def clean_email(col: Column) -> Column:
    return F.lower(strip(col))


def clean_phone(col: Column, dtype: T.DataType, style: str = "digits") -> Column:
    """Digits of the cell's text; ``dashed`` groups 10 and 11 digits.

    Deviation: a whole number held as a float is read without its ``.0``, so the
    zero after the point is not taken for a digit.
    """
    text = as_text(col, dtype)
    if is_float(dtype):
        whole = (col == F.floor(col)) & (F.abs(col) < 2.0**53)
        text = F.when(whole, col.cast("decimal(20,0)").cast("bigint").cast("string")).otherwise(text)
    only = digits(text)
    if style == "dashed":
        d10 = F.regexp_replace(only, r"^(\d{3})(\d{3})(\d{4})$", "$1-$2-$3")
        d11 = F.regexp_replace(only, r"^(\d)(\d{3})(\d{3})(\d{4})$", "$1-$2-$3-$4")
        shaped = F.when(F.length(only) == 10, d10).when(F.length(only) == 11, d11).otherwise(only)
    else:
        shaped = only
    return F.when(only == "", as_text(col, dtype)).otherwise(shaped)


def title(col: Column) -> Column:
    """A letter after any character without case is a capital, other letters are small.

    Deviation: a capital is the letter's one title-case character, so a leading
    sharp s stays.
    """
    runs = F.regexp_extract_all(col, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike(r"^[\p{Lu}\p{Ll}\p{Lt}]"), F.initcap(run)).otherwise(run)), "")


def neutralize(col: Column) -> Column:
    """Quote text a spreadsheet would run as a formula."""
    return F.when(col.rlike(fixed.FORMULA_START), F.concat(F.lit("'"), col)).otherwise(col)
