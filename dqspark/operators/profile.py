"""Per-column profile: counts, roles, date formats, invalid values.

Everything a decision needs is counted over whole columns.  Types that leave no
choice are counted by their type: a date has one format, an integer is like a
phone by its size.  Cells of text columns become rows (column number, text), so
that one short piece of generated code serves any number of columns; a cell is
stripped once.  Cells of digits and punctuation are grouped by shape (every digit
a 9), and the patterns are tried on the distinct shapes only; other cells with
digits or an ``@`` are tried one by one.  A second scan, of candidate columns
only, finds out whether every value is unique.  One small row per column reaches
the driver.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqspark import fixed
from dqspark.functions import cells
from dqspark.session import prepare

COLUMNS = 100  # per job, to keep generated code small
SHAPE_CHARS = 48  # longer cells are tried one by one
SURELY_REPEATED = 0.8  # estimated share of distinct values below which a column has repeats (error of the estimate: 2 %)
REPEATED_HASHES = 100  # looked at to tell a repeated value from a collision
SALTS = 64  # first-round buckets when the first values of a column are ranked


@dataclass
class ColumnFacts:
    """What the scans found out about one column."""

    name: str
    dtype: T.DataType
    n_rows: int = 0
    missing: int = 0
    placeholders: int = 0
    padded: int = 0
    filled: int = 0
    date_only: bool = False
    emails: int = 0
    phones: int = 0
    good_phones: int = 0  # digit counts in range, whatever the layout
    numbers: int = 0
    labels: list[tuple[str, int]] = field(default_factory=list)
    currency_found: int = 0
    currency_hits: int = 0
    currency_cleanable: int = 0
    room: int | None = None  # different values that fit between the lowest and the highest
    loose_numbers: int = 0  # numbers when commas and spaces are left out
    own_role: str | None = None
    role: str | None = None
    date_formats: list[str] = field(default_factory=list)
    invalid_emails: int = 0
    invalid_phones: int = 0

    @property
    def present(self) -> int:
        return self.n_rows - self.missing

    @property
    def missing_pct(self) -> float:
        return round(100.0 * self.missing / self.n_rows, 2) if self.n_rows else 0.0

    def of_filled(self, count: int) -> float:
        return count / self.filled if self.filled else 0.0

    def of_present(self, count: int) -> float:
        return count / self.present if self.present else 0.0

    def text(self):
        return cells.as_text(cells.ref(self.name), self.dtype, date_only=self.date_only)


def _by_type(i: int, fact: ColumnFacts) -> list[Column]:
    """What is counted of a column without looking at texts."""
    col, dtype = cells.ref(fact.name), fact.dtype
    aggs = [] if cells.is_text(dtype) else [F.count_if(cells.missing(col, dtype)).alias(f"m{i}")]
    if isinstance(dtype, T.IntegralType) or isinstance(dtype, T.DecimalType) and dtype.scale == 0:
        low, high = fixed.PHONE_DIGITS
        aggs += [F.count_if(col.between(10**5, 10**15 - 1)).alias(f"h{i}"),  # 6 to 15 digits without a sign
                 F.count_if(F.abs(col.cast("decimal(38,0)")).between(10 ** (low - 1), 10**high - 1)).alias(f"g{i}"),
                 (F.max(col).cast("decimal(38,0)") - F.min(col).cast("decimal(38,0)")).alias(f"z{i}")]
    elif cells.is_moment(dtype):
        four = F.year(col).between(0, 9999)
        first = F.min(F.when(four, F.col("id")))
        aggs += [F.count_if(four).alias(f"d{i}"), first.alias(f"f{i}")]
        if not isinstance(dtype, T.DateType):
            aggs.append(F.count_if(col != F.date_trunc("day", col)).alias(f"t{i}"))
    return aggs


def _cells(df: DataFrame, facts: list[ColumnFacts], cols: list[int], value) -> DataFrame:
    """(id, i, value) of the cells that are not null, a row each."""
    pairs = [x for i in cols for x in (F.lit(i), value(facts[i]))]
    return df.select("id", F.stack(F.lit(len(cols)), *pairs).alias("i", "value")).where("value IS NOT NULL")


def _text_counts(df: DataFrame, facts: list[ColumnFacts], cols: list[int]) -> DataFrame:
    """Counts of text columns, a row each, by way of the shapes of their cells."""
    raw, text, value = F.col("value"), F.col("text"), F.col("v")
    ends = [F.substring(raw, 1, 1), F.substring(raw, -1, 1)]
    tidy = (ends[0] > " ") & (ends[0] < "\x7f") & (ends[1] > " ") & (ends[1] < "\x7f")
    rows = _cells(df, facts, cols, lambda f: cells.ref(f.name).cast("string"))
    rows = rows.withColumn("text", F.when(tidy, raw).otherwise(cells.strip(raw)))
    short = F.length(text) <= max(map(len, fixed.PLACEHOLDERS + fixed.BLANK_WORDS))
    blank = short & F.lower(text).isin(*fixed.BLANK_WORDS)
    symbol = raw.rlike(fixed.CURRENCY_SYMBOL)
    rows = rows.select(
        "i", "id", F.when(~blank, text).alias("v"), (short & text.isin(*fixed.PLACEHOLDERS)).alias("p"), (text != raw).alias("w"),
        symbol.alias("y"), (symbol | raw.contains(",")).alias("c"), (symbol | raw.contains(",") & raw.rlike(fixed.CURRENCY_FINDING)).alias("k"))
    bare = value.rlike(rf"^[-+0-9\s./,:()eET]{{1,{SHAPE_CHARS}}}$")
    telling = value.rlike("[0-9@]") | F.lower(F.substring(value, 1, 4)).contains("inf")
    # A cell tried by itself: email, number, number without commas and spaces, digits in range, date format.
    flags = [value.contains("@") & cells.is_email(value), cells.to_number(value).isNotNull(),
             cells.to_number(F.regexp_replace(value, r"[,\s]", "")).isNotNull(), ~cells.is_bad_phone(value)]
    tried = F.concat(F.lit("="), *[F.when(x, "1").otherwise("0") for x in flags],
                     F.coalesce(cells.date_label_no(value).cast("string"), F.lit("")))
    shape = F.when(bare, F.translate(value, "0123456789", "9999999999")).when(telling, tried)
    flag = ("p", "w", "y", "c", "k")
    shapes = rows.withColumn("shape", shape).groupBy("i", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("b"), F.min("id").alias("first"),
        *[F.count_if(x).alias(x) for x in flag])
    return _of_shapes(shapes, flag)


def _of_shapes(shapes: DataFrame, flag: tuple[str, ...]) -> DataFrame:
    """Try the patterns on the distinct shapes and sum up by column."""
    shape = F.col("shape")
    own = shape.startswith("=")
    label = F.when(own, F.substring(shape, 6, 1).try_cast("int")).otherwise(cells.date_label_no(shape))
    told = dict(zip("evug", range(2, 6)))
    tests = {
        "e": F.lit(False), "v": shape.rlike(fixed.NUMBER), "u": F.regexp_replace(shape, r"[,\s]", "").rlike(fixed.NUMBER),
        "g": ~cells.is_bad_phone(shape)}
    found = shapes.withColumns({
        "d": label, "h": ~own & shape.rlike(fixed.PHONE),
        **{k: F.when(own, F.substring(shape, told[k], 1) == "1").otherwise(t) for k, t in tests.items()}})
    rows = F.col("n")
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b"), *[F.sum(x).alias(x) for x in flag],
            *[F.sum(F.when(F.col(x), rows)).alias(x) for x in tests],
            F.sum(F.when(F.col("h") & F.col("d").isNull(), rows)).alias("h")]
    for k in range(len(fixed.DATE_FORMATS)):
        sums += [F.sum(F.when(F.col("d") == k, rows)).alias(f"n{k}"), F.min(F.when(F.col("d") == k, F.col("first"))).alias(f"f{k}")]
    return found.groupBy("i").agg(*sums)


def _double_counts(df: DataFrame, facts: list[ColumnFacts], cols: list[int]) -> DataFrame:
    """Phone-like numbers and digit counts in range.

    A number of at most two decimals is no phone, and its size tells its digits;
    only others are written out.
    """
    x = F.col("value")
    size, cents = F.abs(x), F.rint(x * 100)
    plain = (size < 1e9) & (cents / 100 == x)
    text = F.when(~plain, cells.as_text(x, T.DoubleType()))
    digits = F.when(cents % 10 == 0, size >= 1e5).otherwise(size >= 1e4)  # 7 or more; below 1e9 never over 15
    rows = _cells(df, facts, cols, lambda f: cells.ref(f.name)).where(~F.isnan("value"))
    rows = rows.select("i", plain.alias("plain"), digits.alias("digits"), text.alias("text"),
                       F.when(plain, cents).alias("cents"))
    return rows.groupBy("i").agg(
        F.when(F.bool_and("plain"), F.max("cents") - F.min("cents")).alias("z"),  # all of two decimals at most
        F.count_if(~F.col("plain") & F.col("text").rlike(fixed.PHONE)).alias("h"),
        F.count_if(F.when(F.col("plain"), F.col("digits")).otherwise(~cells.is_bad_phone(F.col("text")))).alias("g"))


def _number_counts(df: DataFrame, facts: list[ColumnFacts], cols: list[int]) -> DataFrame:
    """The same for other numbers, by their text."""
    text = F.col("value")
    rows = _cells(df, facts, cols, lambda f: cells.as_text(cells.ref(f.name), f.dtype))
    return rows.groupBy("i").agg(F.count_if(text.rlike(fixed.PHONE)).alias("h"), F.count_if(~cells.is_bad_phone(text)).alias("g"))


def count_cells(df: DataFrame) -> list[ColumnFacts]:
    """Scan 1: everything that is counted over whole columns."""
    facts = [ColumnFacts(f.name, f.dataType) for f in cells.data_fields(df)]
    row_id = F.col(fixed.ROW_ID) if fixed.ROW_ID in df.columns else F.lit(0).cast("bigint")
    named = [ColumnFacts(f"c{i}", f.dtype) for i, f in enumerate(facts)]
    rows = df.select(row_id.alias("id"), *[cells.ref(f.name).alias(n.name) for f, n in zip(facts, named)])
    every = range(len(facts))
    ways = [(_text_counts, [i for i in every if cells.is_text(facts[i].dtype)]),
            (_double_counts, [i for i in every if isinstance(facts[i].dtype, T.DoubleType)]),
            (_number_counts, [i for i in every if isinstance(facts[i].dtype, T.FloatType)
                              or isinstance(facts[i].dtype, T.DecimalType) and facts[i].dtype.scale > 0])]
    jobs = [(None, list(every)[s : s + COLUMNS]) for s in range(0, len(facts), COLUMNS)]
    jobs += [(way, cols[s : s + COLUMNS]) for way, cols in ways for s in range(0, len(cols), COLUMNS)]

    def run(job) -> dict[int, dict]:
        way, cols = job
        if way:
            return {r["i"]: r.asDict() for r in way(rows, named, cols).collect()}
        own = [a for i in cols for a in _by_type(i, named[i])]
        row = rows.agg(F.count(F.lit(1)).alias("n"), *own).first().asDict()
        return {i: {"rows": row["n"], **{k.rstrip("0123456789"): v for k, v in row.items() if k[1:] == str(i)}} for i in cols}

    if not jobs:
        return facts
    with ThreadPoolExecutor(min(len(jobs), 4)) as pool:  # they read different columns
        for found in pool.map(run, jobs):
            for i, counts in found.items():
                _store(facts[i], counts)
    for fact in facts:
        if cells.is_text(fact.dtype):
            fact.missing = fact.n_rows - fact.missing
    return facts


def count_loose_numbers(df: DataFrame) -> list[ColumnFacts]:
    """Of text columns only the cells there are, and those that are numbers when commas and spaces are left out."""
    facts = [ColumnFacts(f.name, f.dataType) for f in cells.data_fields(df) if cells.is_text(f.dataType)]
    rows = df.select(F.lit(0).alias("id"), *[cells.ref(f.name).alias(f"c{i}") for i, f in enumerate(facts)])
    named = [ColumnFacts(f"c{i}", f.dtype) for i, f in enumerate(facts)]
    raw, text = F.col("value"), F.col("text")
    tidy = (F.substring(raw, 1, 1) > " ") & (F.substring(raw, 1, 1) < "\x7f")
    telling = text.rlike("[0-9]") | F.lower(F.substring(text, 1, 4)).contains("inf")
    may = F.substring(text, 1, 1).isin(*"+-.,0123456789iI") & telling
    for s in range(0, len(facts), COLUMNS):
        values = _cells(rows, named, list(range(len(facts)))[s : s + COLUMNS], lambda f: cells.ref(f.name).cast("string"))
        found = values.withColumn("text", F.when(tidy, raw).otherwise(cells.strip(raw))).groupBy("i").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.when(may, cells.to_number(F.regexp_replace(text, r"[,\s]", "")).isNotNull())).alias("u"))
        for r in found.collect():
            facts[r["i"]].n_rows, facts[r["i"]].loose_numbers = r["n"], r["u"]
    return facts


def _store(fact: ColumnFacts, row: dict) -> None:
    got = {k: int(row.get(k) or 0) for k in "nmpwbegvuhkycdt"}
    if "rows" in row:
        fact.n_rows = int(row["rows"])
        if not cells.is_text(fact.dtype):
            fact.missing = got["m"]
            fact.filled = fact.present
            fact.numbers = fact.filled if cells.is_number(fact.dtype) else 0
        if cells.is_moment(fact.dtype):
            fact.date_only = "t" in row and fact.present > 0 and not got["t"]
            day = fact.date_only or isinstance(fact.dtype, T.DateType)
            names = [name for name, _ in fixed.DATE_FORMATS]
            fact.labels = [(names[0] if day else names[-1], got["d"])] if got["d"] else []
    else:
        if cells.is_text(fact.dtype):
            fact.missing = got["n"]  # cells there are, until all counts are in
            fact.filled, fact.placeholders, fact.padded, fact.emails = got["b"], got["p"], got["w"], got["e"]
            fact.numbers, fact.loose_numbers = got["v"], got["u"]
            fact.currency_found, fact.currency_hits, fact.currency_cleanable = got["k"], got["y"], got["c"]
            seen = [(-row[f"n{k}"], row[f"f{k}"], name) for k, (name, _) in enumerate(fixed.DATE_FORMATS) if row[f"n{k}"]]
            fact.labels = [(name, -count) for count, _, name in sorted(seen)]
    if row.get("z") is not None:
        fact.room = int(row["z"]) + 1
    if "h" in row:
        fact.phones, fact.good_phones = got["h"], got["g"]


def _is_id_name(name: str) -> bool:
    return re.search(fixed.ID_NAME, name, re.IGNORECASE) is not None


def assign_roles(df: DataFrame, facts: list[ColumnFacts], *, id_by_content: bool = True) -> None:
    """Role per column: email, date, phone, id by name, then id by content.

    Id by content needs every value to be unique.  A repeat among some rows rules
    a column out; only what is left is counted over the whole table.
    """
    open_cols = []
    for i, fact in enumerate(facts):
        if fact.filled:
            dates = sum(n for _, n in fact.labels)
            by_share = (("email", fact.emails), ("date", dates), ("phone", fact.phones))
            fact.own_role = next((r for r, n in by_share if fact.of_filled(n) >= fixed.ROLE_SHARE), None)
        if fact.own_role is None and _is_id_name(fact.name):
            fact.own_role = "id"
        elif (fact.own_role is None and fact.filled >= fixed.ID_MIN_VALUES
              and fact.of_filled(fact.numbers) > fixed.ID_NUMERIC_SHARE):
            open_cols.append(i)
    if id_by_content and open_cols:
        for i in _unique(df, facts, open_cols):
            facts[i].own_role = "id"
    for fact in facts:
        fact.role = fact.own_role
        if fact.own_role in ("date", None):
            fact.date_formats = [name for name, _ in fact.labels]
        if len(fact.date_formats) >= 2 and fact.role is None:
            fact.role = "date"
        fact.invalid_emails = fact.filled - fact.emails if fact.role == "email" else 0
        fact.invalid_phones = fact.filled - fact.good_phones if fact.role == "phone" else 0


def _entries(facts: list[ColumnFacts], cols: list[int], value) -> Column:
    return F.explode(F.array_compact(F.array(*[
        F.when(_quick(facts[i]).isNotNull(), F.struct(F.lit(i).alias("col_no"), value(_quick(facts[i])).alias("value")))
        for i in cols])))


def _unique(df: DataFrame, facts: list[ColumnFacts], cols: list[int]) -> list[int]:
    """The columns whose values are all different.

    More cells than values that fit between the lowest and the highest, or a sketch
    of the distinct values, rule out most columns.  For the others,
    8-byte hashes that all differ prove that the values do; where hashes repeat,
    the values behind some of them are compared.
    """
    cols = [i for i in cols if facts[i].room is None or facts[i].room >= facts[i].filled]
    if not cols:
        return []
    about = df.agg(*[F.approx_count_distinct(_quick(facts[i]), 0.02).alias(f"n{i}") for i in cols]).first()
    left = [i for i in cols if about[f"n{i}"] >= SURELY_REPEATED * facts[i].filled]
    if not left:
        return []
    hashes = df.select(_entries(facts, left, F.xxhash64).alias("e")).groupBy("e.col_no", "e.value").count().where("count > 1")
    first = Window.partitionBy("col_no").orderBy("value")
    some = hashes.withColumn("place", F.row_number().over(first)).where(F.col("place") <= REPEATED_HASHES)
    alike: dict[int, list[int]] = {}
    for r in some.collect():
        alike.setdefault(r["col_no"], []).append(r["value"])
    unique = [i for i in left if i not in alike]
    for i, picked in alike.items():
        value = _comparable(facts[i])
        rows = df.where(F.xxhash64(_quick(facts[i])).isin(picked)).agg(F.count(value), F.count_distinct(value)).first()
        if rows[0] == rows[1]:  # nothing but collisions among them: count the whole column
            rows = df.agg(F.count(value), F.count_distinct(value)).first()
        if rows[0] == rows[1]:
            unique.append(i)
    return sorted(unique)


def _quick(fact: ColumnFacts):
    """As `_comparable`, but zeros of both signs may be alike: for sketches and hashes."""
    col = cells.ref(fact.name)
    return F.when(~F.isnan(col), col) if cells.is_float(fact.dtype) else _comparable(fact)


def _comparable(fact: ColumnFacts):
    """Value whose equality is the equality of the column's stripped text."""
    col = cells.ref(fact.name)
    if cells.is_text(fact.dtype):
        return cells.non_blank(col)
    if cells.is_float(fact.dtype):
        return cells.as_text(col, fact.dtype)
    return col


def column_facts(df: DataFrame, *, id_by_content: bool = True) -> list[ColumnFacts]:
    """Counts and roles of every column; ``_row_id``, if there, orders date formats that come equally often."""
    prepare(df.sparkSession)
    facts = count_cells(df)
    assign_roles(df, facts, id_by_content=id_by_content)
    return facts


def column_sample(df: DataFrame, n: int, *, non_blank: bool = True) -> DataFrame:
    """First ``n`` values of every scalar column: (column, rn, _row_id, value).

    Ranked within buckets of row ids first, so that the final ranking of a column
    reads at most ``SALTS * n`` rows.
    """
    prepare(df.sparkSession)
    entries = []
    for f in cells.data_fields(df):
        if cells.is_scalar(f.dataType):
            value = cells.as_text(cells.ref(f.name), f.dataType)
            value = cells.non_blank(value) if non_blank else value
            entries.append(F.when(value.isNotNull(), F.struct(F.lit(f.name).alias("column"), value.alias("value"))))
    if not entries:
        return df.sparkSession.createDataFrame([], f"column STRING, rn INT, {fixed.ROW_ID} BIGINT, value STRING")
    salted = Window.partitionBy("column", "salt").orderBy(fixed.ROW_ID)
    final = Window.partitionBy("column").orderBy(fixed.ROW_ID)
    return (
        df.select(fixed.ROW_ID, F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .select("e.column", fixed.ROW_ID, "e.value", F.pmod(F.xxhash64(fixed.ROW_ID), F.lit(SALTS)).alias("salt"))
        .withColumn("rn", F.row_number().over(salted)).where(F.col("rn") <= n)
        .withColumn("rn", F.row_number().over(final)).where(F.col("rn") <= n)
        .select("column", "rn", fixed.ROW_ID, "value")
    )
