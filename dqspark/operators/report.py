"""The quality report of a table: column report, pillars, score, notes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark import fixed
from dqspark.functions import cells
from dqspark.operators.dedupe import Duplicates
from dqspark.operators.profile import ColumnFacts, column_facts
from dqspark.session import prepare

COLUMNS_SCHEMA = (
    "name STRING, missing_count BIGINT, missing_pct DOUBLE, empty_string_count BIGINT, "
    "inferred_role STRING, date_formats ARRAY<STRING>, invalid_email_count BIGINT, "
    "invalid_phone_count BIGINT"
)
SUMMARY_SCHEMA = (
    "n_rows BIGINT, n_cols INT, exact_duplicate_rows BIGINT, overall_missing_pct DOUBLE, "
    "completeness DOUBLE, uniqueness DOUBLE, consistency DOUBLE, score INT"
)


@dataclass
class QualityReport:
    """One number per pillar, one entry per column; a few kilobytes at any scale.

    ``pillars`` are unrounded; the summary rounds them for display only.
    """

    facts: list[ColumnFacts]
    n_rows: int
    duplicates: int
    missing_pct: float
    pillars: tuple[float, float, float]
    score: int
    copies: Duplicates | None = None  # handle on the duplicate rows, for examples

    def summary(self, spark) -> DataFrame:
        done, unique, steady = (round(p, 1) for p in self.pillars)
        row = (self.n_rows, len(self.facts), self.duplicates, round(self.missing_pct, 2),
               done, unique, steady, self.score)
        return spark.createDataFrame([row], SUMMARY_SCHEMA)

    def columns(self, spark) -> DataFrame:
        rows = [
            (f.name, f.missing, f.missing_pct, f.placeholders, f.role, f.date_formats,
             f.invalid_emails, f.invalid_phones)
            for f in self.facts
        ]
        return spark.createDataFrame(rows, COLUMNS_SCHEMA)

    def notes(self, spark) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.note_texts())), "note_no INT, note STRING")

    def note_texts(self) -> list[str]:
        say, names = fixed.NOTES, ", ".join
        mixed = [f.name for f in self.facts if len(f.date_formats) > 1]
        roles = [say["role"].format(name=f.name, role=f.role) for f in self.facts if f.role]
        empty = [f.name for f in self.facts if is_empty(f)]
        notes = [say["mixed_dates"].format(names=names(mixed))] if mixed else []
        notes += [f"{'; '.join(roles)}."] if roles else []
        notes += [say["empty"].format(names=names(empty))] if empty else []
        notes += [say["duplicates"].format(n=self.duplicates)] if self.duplicates else []
        return notes or [fixed.NO_ISSUES]


def is_empty(fact: ColumnFacts) -> bool:
    """Deviation: every cell missing, not a percentage that rounds to 100."""
    return fact.n_rows > 0 and fact.missing == fact.n_rows


def consistency(facts: list[ColumnFacts], n_rows: int) -> float:
    """100 less the mean penalty over everything checked.

    A column is checked once for its date formats and once for its role.
    """
    penalties = []
    for fact in facts:
        if fact.date_formats:
            extra = len(fact.date_formats) - 1
            penalties.append(min(fixed.PENALTY_CAP, fixed.DATE_PENALTY * extra))
        bad = {"email": fact.invalid_emails, "phone": fact.invalid_phones}.get(fact.role)
        if bad is not None:
            penalties.append(min(fixed.PENALTY_CAP, 100.0 * bad / max(n_rows, 1)))
    if n_rows == 0 or not penalties:
        return 100.0
    return max(0.0, 100.0 - sum(penalties) / len(penalties))


def build_report(df: DataFrame) -> QualityReport:
    """Profile and score a table that has a ``_row_id``.

    Duplicates are looked for while the columns are profiled: the two need no
    results of each other, so their jobs share the cluster.
    """
    prepare(df.sparkSession)
    if not cells.data_fields(df):
        return score_facts([], df.count(), 0)
    with ThreadPoolExecutor(1) as pool:
        search = pool.submit(_find_copies, df)
        facts = column_facts(df)
        copies, duplicates = search.result()
    report = score_facts(facts, facts[0].n_rows, duplicates)
    report.copies = copies
    return report


def _find_copies(df: DataFrame) -> tuple[Duplicates, int]:
    copies = Duplicates(df)
    return copies, copies.count()


def score_facts(facts: list[ColumnFacts], n_rows: int, duplicates: int) -> QualityReport:
    cells_total = n_rows * len(facts)
    missing = sum(f.missing for f in facts)
    missing_pct = 100.0 * missing / cells_total if cells_total else 0.0
    pillars = (
        max(0.0, 100.0 - missing_pct),
        100.0 * (1.0 - duplicates / n_rows) if n_rows else 100.0,
        consistency(facts, n_rows),
    )
    # Python rounds halves to even, as report scalars must.
    score = round(sum(w * p for w, p in zip(fixed.WEIGHTS, pillars)))
    return QualityReport(facts, n_rows, duplicates, missing_pct, pillars, max(0, min(100, score)))


def verdict(score: Column) -> Column:
    """Caption for a score."""
    chain = None
    for floor, text in fixed.VERDICTS:
        if floor is None:
            return chain.otherwise(F.lit(text))
        chain = (
            F.when(score >= floor, F.lit(text)) if chain is None
            else chain.when(score >= floor, F.lit(text))
        )
    return chain
