"""Clean a table in one pass.

Every step adds column expressions or a filter to one plan.  Steps whose effect
depends on the data first ask a small aggregate; questions that cannot affect
each other share one.  Step order is fixed: trim, similar spellings, casing,
emails, phones, currency, dates, empty columns, empty rows, missing values,
duplicates, renames.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark import fixed
from dqspark.functions import cells
from dqspark.functions.dates import parse_date
from dqspark.operators import fuzzy
from dqspark.operators.dedupe import Duplicates
from dqspark.operators.median import exact_medians
from dqspark.operators.profile import ColumnFacts, column_facts
from dqspark.operators.rename import compose, plan_renames
from dqspark.session import prepare, settle

BROADCAST_SPELLINGS = 200_000  # mapping rows
BROADCAST_BYTES = 64 << 20
HOT_ROWS = 1000  # cells from which on a variant is looked up even if the mapping is too large to be
_CHANGES = "_spellings_kept"


@dataclass
class CleaningOptions:
    """What a cleaning run does; everything is off by default."""

    trim_whitespace: bool = False
    collapse_fuzzy: bool = False
    fuzzy_groups: DataFrame | None = None
    include_role_columns: bool = False
    casing: Literal["none", "title", "lower", "upper"] = "none"
    fix_emails: bool = False
    normalize_phones: bool = False
    phone_format: Literal["digits", "dashed"] = "digits"
    strip_currency: bool = False
    fix_dates: bool = False
    dayfirst: bool = False
    drop_empty_columns: bool = False
    drop_empty_rows: bool = False
    missing_strategy: Literal["leave", "drop_rows", "drop_columns", "fill"] = "leave"
    missing_threshold_pct: float = 100.0
    numeric_fill: Literal["none", "mean", "median"] = "none"
    fill_value: str = ""
    drop_exact_duplicates: bool = False
    duplicate_subset: list[str] | None = None
    rename_style: Literal["none", "snake", "lower"] = "none"
    manual_renames: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def from_keys(cls, keys, *, dayfirst: bool = False, fuzzy_groups: DataFrame | None = None):
        """Options for a list of plan step keys; unknown keys are ignored."""
        known = {k: True for k, _ in fixed.STEPS if k in set(keys)}
        return cls(**known, dayfirst=dayfirst, fuzzy_groups=fuzzy_groups)


@dataclass
class ChangeLog:
    """Counters and step texts of a run."""

    rows_before: int = 0
    rows_after: int = 0
    cols_before: int = 0
    cols_after: int = 0
    duplicates_dropped: int = 0
    empty_rows_removed: int = 0
    empty_cols_removed: int = 0
    missing_filled: int = 0
    fuzzy_collapsed: int = 0
    columns_renamed: dict[str, str] = field(default_factory=dict)
    dates_parsed: list[str] = field(default_factory=list)
    standardized: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    dates_lost: dict[str, int] = field(default_factory=dict)
    currency_lost: dict[str, int] = field(default_factory=dict)
    fill_skipped: list[str] = field(default_factory=list)
    touched: list[str] = field(default_factory=list)  # columns whose values may have changed

    def say(self, step: str, **words) -> None:
        self.steps.append(fixed.STEP_TEXT[step].format(**words))

    def items(self) -> list[tuple[str, str]]:
        shown = []
        for label, name in fixed.LOG_ITEMS:
            value = getattr(self, name)
            if isinstance(value, dict):
                value = _arrows(value) or "—"
            elif isinstance(value, list):
                value = ", ".join(value) or "—"
            shown.append((label, str(value)))
        return shown

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.items(), "item STRING, value STRING")

    def followed_by(self, later: ChangeLog) -> ChangeLog:
        """One log for two runs in a row: counts summed, renames chained."""
        before = {new: old for old, new in self.columns_renamed.items()}
        return ChangeLog(
            rows_before=self.rows_before, rows_after=later.rows_after,
            cols_before=self.cols_before, cols_after=later.cols_after,
            duplicates_dropped=self.duplicates_dropped + later.duplicates_dropped,
            empty_rows_removed=self.empty_rows_removed + later.empty_rows_removed,
            empty_cols_removed=self.empty_cols_removed + later.empty_cols_removed,
            missing_filled=self.missing_filled + later.missing_filled,
            fuzzy_collapsed=self.fuzzy_collapsed + later.fuzzy_collapsed,
            columns_renamed=compose(self.columns_renamed, later.columns_renamed),
            dates_parsed=self.dates_parsed + later.dates_parsed,
            standardized=self.standardized + later.standardized,
            steps=self.steps + later.steps,
            dates_lost={**self.dates_lost, **later.dates_lost},
            currency_lost={**self.currency_lost, **later.currency_lost},
            fill_skipped=self.fill_skipped + later.fill_skipped,
            touched=self.touched + [before.get(c, c) for c in later.touched],
        )


def _arrows(renames: Mapping[str, str]) -> str:
    return ", ".join(f"{a} → {b}" for a, b in renames.items())


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in cells.data_fields(df) if cells.is_text(f.dataType)]


def _replace(df: DataFrame, new: dict) -> DataFrame:
    """Swap in new column expressions, keeping the column order."""
    return df.select(*[new[c].alias(c) if c in new else cells.ref(c) for c in df.columns])


def trim(df: DataFrame) -> DataFrame:
    return _replace(df, {c: cells.strip(cells.ref(c)) for c in _texts(df)})


def merge_spellings(df: DataFrame, groups: DataFrame, *, counted: bool = False,
                    stored: bool = False) -> tuple[DataFrame, int, list[str], int]:
    """Replace variants by the spelling kept: (table, cells changed, columns changed, groups used).

    ``counted`` says that the groups count the cells of this very table, which
    then need no counting again.  A mapping of checked size is looked up in
    place, for all columns in one projection; a larger one is joined once, all but
    its common variants, and with ``stored`` the joined table is written for those
    who read it several times.
    """
    rows = F.coalesce(F.map_values("counts"), F.array().cast("array<bigint>")).alias("rows")  # in the order of the variants
    mapping = settle(
        groups.withColumn("rows", rows).select("column", "suggested", F.inline(F.arrays_zip(F.col("variants").alias("variant"), "rows")))
        .where("variant != suggested").groupBy("column", "variant").agg(F.min("suggested").alias("suggested"), F.max("rows").alias("rows")),
        "spelling-map",
    )
    length, hot = F.octet_length("variant") + F.octet_length("suggested"), F.col("rows") >= HOT_ROWS
    sizes = {
        r["column"]: r for r in mapping.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.sum(length).alias("bytes"),
            F.count_if(hot).alias("hot"), F.coalesce(F.sum(F.when(hot, length)), F.lit(0)).alias("hot_bytes"),
        ).collect()
    }
    columns = [c for c in _texts(df) if c in sizes]
    if not columns:
        return df, 0, [], 0
    rows, size, common, common_size = (sum(sizes[c][k] for c in columns) for k in ("n", "bytes", "hot", "hot_bytes"))
    number = F.lit(None).cast("int")
    for i, c in enumerate(columns):
        number = F.when(F.col("column") == c, F.lit(i)).otherwise(number)
    mapping = mapping.select(number.alias("no"), "variant", "suggested", "rows").where("no IS NOT NULL")
    if rows <= BROADCAST_SPELLINGS and size <= BROADCAST_BYTES:
        found = _looked_up(df, mapping, columns, rows)
    else:
        small = common <= BROADCAST_SPELLINGS and common_size <= BROADCAST_BYTES
        df, found = _joined(df, mapping, columns, common if small else 0, stored)
    own = groups.where(F.col("column").isin(*columns) & (F.size("variants") > 1))
    if counted:
        cells_of = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda x, y: x + y)
        used, changed = own.agg(F.count(F.lit(1)), F.sum(cells_of - F.col("counts")[F.col("suggested")])).first()
    else:
        used = own.count()
        changed = sum(df.agg(*[F.count(found[c]) for c in columns]).first())
    names = [c for c in df.columns if c != _CHANGES]
    out = df.select(*[(F.coalesce(found[c], cells.ref(c)) if c in found else cells.ref(c)).alias(c) for c in names])
    return out, int(changed or 0), columns, used


def _looked_up(df: DataFrame, mapping: DataFrame, columns: list[str], rows: int) -> dict:
    """The spelling kept per column, null for cells that stay, from an array of small maps by hash.

    The array is the value of a scalar subquery, so rows are neither joined nor shuffled.
    """
    slots = max(2 * rows, 1)

    def slot(no, value):
        return F.pmod(F.xxhash64(no, value), F.lit(slots)).cast("int")

    entry = F.struct(F.concat_ws(":", "no", "variant").alias("key"), "suggested")
    filled = mapping.select(slot(F.col("no"), F.col("variant")).alias("slot"), entry.alias("entry"))
    empty = df.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(None).cast(
        filled.schema["entry"].dataType).alias("entry"))
    maps = filled.unionByName(empty).groupBy("slot").agg(F.map_from_entries(F.collect_list("entry")).alias("m"))
    table = maps.agg(F.array_sort(F.collect_list(F.struct("slot", F.map_entries("m").alias("m")))).alias("t")).select(
        F.transform("t", lambda x: F.map_from_entries(x["m"])).alias("t")).scalar()
    found = {}
    for i, c in enumerate(columns):
        value = cells.ref(c)
        found[c] = F.get(table, slot(F.lit(i), value))[F.concat_ws(":", F.lit(str(i)), value)]
        found[c] = F.when(value.isNotNull(), found[c])
    return found


def _joined(df: DataFrame, mapping: DataFrame, columns: list[str], common: int, stored: bool) -> tuple[DataFrame, dict]:
    """The same by one join of all columns' cells, gathered by row.

    Cells of the ``common`` variants are looked up, so that no hot value is joined.
    """
    hot = F.coalesce(F.col("rows") >= HOT_ROWS, F.lit(False))
    near = _looked_up(df, mapping.where(hot), columns, common) if common else {}
    left = mapping.where(~hot) if common else mapping
    held = F.array_compact(F.array(*[
        F.when(cells.ref(c).isNotNull() & (near[c].isNull() if common else F.lit(True)),
               F.struct(F.lit(i).alias("no"), cells.ref(c).alias("variant")))
        for i, c in enumerate(columns)]))
    long = df.select(fixed.ROW_ID, F.explode(held).alias("e")).select(fixed.ROW_ID, "e.no", "e.variant")
    changes = (long.join(left.select("no", "variant", "suggested"), ["no", "variant"]).groupBy(fixed.ROW_ID)
               .agg(F.map_from_entries(F.collect_list(F.struct("no", "suggested"))).alias(_CHANGES)))
    out = df.join(changes, fixed.ROW_ID, "left").select(*[cells.ref(c) for c in df.columns], _CHANGES)
    out = settle(out, "spellings-merged") if stored else out
    found = {c: F.col(_CHANGES)[F.lit(i)] for i, c in enumerate(columns)}
    return out, {c: F.coalesce(near[c], found[c]) for c in columns} if common else found


def change_case(df: DataFrame, style: str, facts: list[ColumnFacts]) -> DataFrame:
    """Casing of text columns other than emails and ids."""
    functions = {"lower": F.lower, "upper": F.upper, "title": cells.title}
    skip = {f.name for f in facts if f.own_role in ("email", "id")}
    return _replace(df, {c: functions[style](cells.ref(c)) for c in _texts(df) if c not in skip})


def email_columns(facts: list[ColumnFacts]) -> list[str]:
    return [f.name for f in facts if f.own_role == "email" or "email" in f.name.lower()]


def phone_columns(facts: list[ColumnFacts]) -> list[str]:
    named = ("phone", "mobile")
    return [
        f.name for f in facts if cells.is_scalar(f.dtype)
        and (f.own_role == "phone" or any(w in f.name.lower() for w in named))
    ]


def currency_candidates(facts: list[ColumnFacts]) -> list[ColumnFacts]:
    return [f for f in facts if cells.is_text(f.dtype)
            and f.present and f.of_present(f.currency_cleanable) >= fixed.CURRENCY_SHARE]


def date_candidates(facts: list[ColumnFacts]) -> list[ColumnFacts]:
    """Deviation: text columns only; numbers are never read as dates."""
    return [
        f for f in facts if cells.is_text(f.dtype)
        and (f.labels or f.own_role == "date" or "date" in f.name.lower())
    ]


def convert(df: DataFrame, facts: list[ColumnFacts], options: CleaningOptions,
            log: ChangeLog) -> DataFrame:
    """Currency text to numbers and dates to timestamps, where at least half parse.

    One aggregate answers for all candidates; a column that becomes a number is
    no longer tried as a date.
    """
    money = currency_candidates(facts) if options.strip_currency else []
    dates = date_candidates(facts) if options.fix_dates else []
    if not money and not dates:
        return df
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(money):
        col = cells.ref(f.name)
        aggs += [F.count(col).alias(f"p{i}"), F.count(cells.currency_number(col)).alias(f"c{i}"),
                 F.count(cells.currency_integer(col)).alias(f"i{i}")]
    for i, f in enumerate(dates):
        col = cells.ref(f.name)
        aggs += [F.count(col).alias(f"q{i}"),
                 F.count(parse_date(col, dayfirst=options.dayfirst)).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    new = {}
    for i, f in enumerate(money):
        have, parsed = row[f"p{i}"], row[f"c{i}"]
        if parsed >= max(1, int(fixed.KEEP_SHARE * have)):
            whole = row[f"i{i}"] == row["n"]
            number = cells.currency_integer if whole else cells.currency_number
            new[f.name] = number(cells.ref(f.name))
            log.standardized.append(f"currency:{f.name}")
            log.currency_lost[f.name] = have - parsed
    if new:
        log.say("currency")
    for i, f in enumerate(dates):
        have, parsed = row[f"q{i}"], row[f"d{i}"]
        if f.name not in new and parsed >= max(1, int(fixed.KEEP_SHARE * have)):
            new[f.name] = parse_date(cells.ref(f.name), dayfirst=options.dayfirst)
            log.dates_parsed.append(f.name)
            log.dates_lost[f.name] = have - parsed
    if log.dates_parsed:
        log.say("dates_dayfirst" if options.dayfirst else "dates")
    log.touched += new
    return _replace(df, new)


def _null_counts(df: DataFrame, stats: str = "none"):
    fields = cells.data_fields(df)
    gaps = [cells.missing(cells.ref(f.name), f.dataType) for f in fields]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count_if(g).alias(f"m{i}") for i, g in enumerate(gaps)]
    every = some = gaps[0]
    for g in gaps[1:]:
        every, some = every & g, some | g
    aggs += [F.count_if(every).alias("all_null"), F.count_if(some).alias("any_null")]
    if stats == "mean":
        for i, f in enumerate(fields):
            if cells.is_number(f.dataType):
                col = cells.ref(f.name).cast("double")
                aggs.append(F.avg(F.when(~F.isnan(col), col)).alias(f"a{i}"))
    return fields, df.agg(*aggs).first()


def _any_missing(df: DataFrame):
    gaps = [cells.missing(cells.ref(f.name), f.dataType) for f in cells.data_fields(df)]
    some = F.lit(False)
    for g in gaps:
        some = some | g
    return some


def _all_missing(df: DataFrame):
    every = F.lit(True)
    for f in cells.data_fields(df):
        every = every & cells.missing(cells.ref(f.name), f.dataType)
    return every


def _fitting(df: DataFrame, fields, value: str) -> list[bool]:
    """Whether the text reads as a value of each column's type, asked all at once."""
    tests = [F.lit(value).try_cast(f.dataType).isNotNull() if cells.is_scalar(f.dataType) else F.lit(False)
             for f in fields]
    return list(df.sparkSession.range(1).select(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first())


def _fill(df, fields, row, options, log) -> DataFrame:
    new: dict = {}
    medians: dict[str, float] = {}
    gaps = {f.name: row[f"m{i}"] for i, f in enumerate(fields) if row[f"m{i}"]}
    if options.numeric_fill == "median":
        wanted = {f.name: row["n"] - gaps[f.name]
                  for f in fields if f.name in gaps and cells.is_number(f.dataType)}
        medians = exact_medians(df, wanted)
    fits = _fitting(df, fields, options.fill_value)
    for i, f in enumerate(fields):
        if f.name not in gaps:
            continue
        col = cells.ref(f.name)
        count = gaps[f.name] - (row["all_null"] if options.drop_empty_rows else 0)
        if count <= 0:
            continue
        if options.numeric_fill in ("mean", "median") and cells.is_number(f.dataType):
            value = row[f"a{i}"] if options.numeric_fill == "mean" else medians.get(f.name)
            log.missing_filled += count
            if value is not None:
                fill = F.lit(float(value))
                kept = F.when(~cells.missing(col, f.dataType), col.cast("double"))
                new[f.name] = F.coalesce(kept, fill)
        elif options.fill_value != "" and cells.is_scalar(f.dataType) and not cells.is_moment(f.dataType):
            # Deviation: a column has one type, so the value must fit it.
            fill = F.lit(options.fill_value).try_cast(f.dataType)
            if not fits[i]:
                log.fill_skipped.append(f.name)
                continue
            log.missing_filled += count
            new[f.name] = F.coalesce(F.when(~cells.missing(col, f.dataType), col), fill)
    if log.missing_filled:
        log.say("filled", n=log.missing_filled)
    log.touched += new
    return _replace(df, new)


def _handle_missing(df: DataFrame, options: CleaningOptions,
                    log: ChangeLog) -> tuple[DataFrame, int, int]:
    """Empty columns, empty rows, missing values: (table, rows before, rows left)."""
    by_mean = options.missing_strategy == "fill" and options.numeric_fill == "mean"
    fields, row = _null_counts(df, "mean" if by_mean else "none")
    n, gone = row["n"], []
    if options.drop_empty_columns:
        gone = [f.name for i, f in enumerate(fields) if row[f"m{i}"] == n]
        if gone:
            df = df.drop(*gone)
            log.empty_cols_removed = len(gone)
            log.say("empty_columns", names=", ".join(gone))
    blank = row["all_null"] if cells.data_fields(df) else 0
    if options.drop_empty_rows and blank:
        df = df.where(~_all_missing(df))
        n -= blank
        log.empty_rows_removed = blank
        log.say("empty_rows", n=blank)
    removed_blank = blank if options.drop_empty_rows else 0
    if options.missing_strategy == "drop_rows":
        some = _any_missing(df)
        # dropped columns change which rows have gaps, so only then the table is asked again
        lost = df.agg(F.count_if(some)).first()[0] if gone else row["any_null"] - removed_blank
        df = df.where(~some)
        n -= lost
        log.say("any_null", n=lost)
    elif options.missing_strategy == "drop_columns":
        left = {f.name for f in cells.data_fields(df)}
        sparse = [
            f.name for i, f in enumerate(fields) if f.name in left
            and 100.0 * (row[f"m{i}"] - removed_blank) / max(n, 1) >= options.missing_threshold_pct
        ]
        if sparse:
            df = df.drop(*sparse)
            log.say("sparse_columns", pct=options.missing_threshold_pct, names=", ".join(sparse))
    elif options.missing_strategy == "fill":
        left = {f.name for f in cells.data_fields(df)}
        keep = [(i, f) for i, f in enumerate(fields) if f.name in left]
        values = row.asDict()
        picked = {"n": values["n"], "all_null": values["all_null"]}
        for k, (i, _) in enumerate(keep):
            picked[f"m{k}"] = values[f"m{i}"]
            picked[f"a{k}"] = values.get(f"a{i}")
        df = _fill(df, [f for _, f in keep], picked, options, log)
    return df, row["n"], n


def clean(df: DataFrame, options: CleaningOptions, *, trace: bool = False) -> tuple[DataFrame, ChangeLog]:
    """Run the selected steps over a table with a ``_row_id``.

    Returns the cleaned table and its log.  Rows keep their ``_row_id``.  With
    ``trace`` the cleaned table carries the old values beside the new ones, in the
    struct ``_before``, so that changed cells follow from one reading of it.
    """
    prepare(df.sparkSession)
    log = ChangeLog(cols_before=len(cells.data_fields(df)))
    out = df
    if trace:
        old = [cells.ref(f.name).alias(f"c{no}") for no, f in enumerate(cells.data_fields(df))]
        out = df.withColumn(fixed.BEFORE, F.struct(*old) if old else F.lit(None))
    if options.trim_whitespace:
        log.touched += _texts(out)
        out = trim(out)
        log.say("trim")
        log.standardized.append("whitespace")
    facts, stale = None, []
    if options.collapse_fuzzy:
        out, facts, stale = _merge(out, options, log)
    if options.casing != "none" or options.fix_emails or options.normalize_phones:
        facts = _refreshed(out, facts, stale, id_by_content=options.casing != "none")
        log.rows_before = facts[0].n_rows if facts else 0
        out, stale = _standardize(out, facts, options, log)
    if options.strip_currency or options.fix_dates:
        facts = _refreshed(out, facts, stale, id_by_content=False)
        log.rows_before = facts[0].n_rows if facts else 0
        out = convert(out, facts, options, log)
    n = None
    if options.drop_empty_columns or options.drop_empty_rows or options.missing_strategy != "leave":
        out, log.rows_before, n = _handle_missing(out, options, log)
    if n is None:
        n = log.rows_before = log.rows_before or df.count()
    if options.drop_exact_duplicates:
        out, n = _drop_copies(out, options, log, n)
    renames = plan_renames([f.name for f in cells.data_fields(out)], options.rename_style,
                           options.manual_renames)
    if renames:
        out = out.select(*[cells.ref(c).alias(renames.get(c, c)) for c in out.columns])
        log.columns_renamed = renames
        log.say("renamed", pairs=_arrows(renames))
    log.rows_after, log.cols_after = n, len(cells.data_fields(out))
    if not log.steps:
        log.say("nothing")
    return out, log


def _refreshed(df: DataFrame, facts: list[ColumnFacts] | None, stale: list[str], *,
               id_by_content: bool) -> list[ColumnFacts]:
    """Facts of the table as it is now; of known ones only ``stale`` columns are read again."""
    if facts is None:
        return column_facts(df, id_by_content=id_by_content)
    if not stale:
        return facts
    own = df.select(fixed.ROW_ID, *[cells.ref(c) for c in stale])
    again = {f.name: f for f in column_facts(own, id_by_content=id_by_content)}
    return [again.get(f.name, f) for f in facts]


def _merge(out: DataFrame, options: CleaningOptions,
           log: ChangeLog) -> tuple[DataFrame, list[ColumnFacts] | None, list[str]]:
    """The table, facts of it before (if asked for), and the columns changed since.

    Deviation: unless asked, columns with a role (emails, ids, ...) are left alone.
    """
    groups = options.fuzzy_groups
    facts = None
    if groups is None or not options.include_role_columns:
        facts = column_facts(out)
    if groups is None:
        groups = fuzzy.scan(out, facts=facts, explain=False).groups
    if not options.include_role_columns:
        roles = [f.name for f in facts if f.role]
        if roles:
            groups = groups.where(~F.col("column").isin(*roles))
    again = (options.casing != "none" or options.fix_emails or options.normalize_phones or options.strip_currency or options.fix_dates
             or options.drop_empty_columns or options.drop_empty_rows or options.missing_strategy != "leave" or options.drop_exact_duplicates)
    merged, changed, columns, used = merge_spellings(out, groups, counted=options.fuzzy_groups is None, stored=again)
    log.fuzzy_collapsed = changed
    log.touched += _texts(out)
    if changed:
        log.say("fuzzy", n=changed, groups=used)
    elif groups.isEmpty():
        log.say("fuzzy_none")
    return merged, facts, columns if changed else []


def _standardize(out, facts, options, log) -> tuple[DataFrame, list[str]]:
    """The table and the columns whose facts no longer hold."""
    stale: set[str] = set()
    if options.casing != "none":
        log.touched += _texts(out)
        out = change_case(out, options.casing, facts)
        stale.update(_texts(out))
        log.say("casing", style=options.casing)
        log.standardized.append(f"casing:{options.casing}")
    if options.fix_emails:
        names = email_columns(facts)
        texts = set(_texts(out))
        log.touched += names
        out = _replace(out, {c: cells.clean_email(cells.ref(c)) for c in names if c in texts})
        stale.update(c for c in names if c in texts)
        log.standardized += [f"email:{c}" for c in names]
        log.say("emails")
    if options.normalize_phones:
        names = phone_columns(facts)
        types = {f.name: f.dataType for f in cells.data_fields(out)}
        log.touched += names
        out = _replace(out, {
            c: cells.clean_phone(cells.ref(c), types[c], options.phone_format) for c in names})
        log.standardized += [f"phone:{c}" for c in names]
        log.say("phones")
        stale.update(names)
    return out, [f.name for f in facts if f.name in stale]


def _drop_copies(out, options, log, n) -> tuple[DataFrame, int]:
    known = {f.name for f in cells.data_fields(out)}
    subset = [c for c in options.duplicate_subset or [] if c in known] or None
    copies = Duplicates(out, subset)
    dropped = copies.count()
    out = copies.kept().select(*out.columns)
    log.duplicates_dropped = dropped
    if subset:
        log.say("duplicates_on", n=dropped, names=", ".join(subset))
    else:
        log.say("duplicates", n=dropped)
    return out, n - dropped
