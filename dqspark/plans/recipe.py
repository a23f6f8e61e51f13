"""Cleaning plans: proposed from findings, forced by profiles, saved as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark import fixed
from dqspark.operators.clean import CleaningOptions

PLAN_COLUMNS = (
    "step_no", "fix_key", "label", "summary", "finding_ids", "columns", "default_include",
    "highest_severity",
)


class PlanError(ValueError):
    """A saved plan that cannot be used."""


def profile(profile_id: str) -> tuple[str, str, tuple[str, ...] | None, bool]:
    """(label, summary, forced steps, day first); unknown ids mean ``findings``."""
    return fixed.PROFILES.get(profile_id, fixed.PROFILES["findings"])


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITIES]), severity)


def propose(found: DataFrame, profile_id: str = "findings",
            table_columns: Iterable[str] = ()) -> DataFrame:
    """One step per fix key, in running order (see PLAN_COLUMNS).

    ``table_columns`` names extra key columns when findings of many tables are
    planned together.
    """
    spark, keys = found.sparkSession, list(table_columns)
    forced = profile(profile_id)[2]
    steps = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(k).alias("fix_key"),
                 F.lit(label).alias("label"), F.lit(k in (forced or ())).alias("forced"))
        for i, (k, label) in enumerate(fixed.STEPS)
    ]))
    entry = F.struct(_rank(F.col("severity")).alias("rank"), (-F.col("count")).alias("less"),
                     "title", "id", "severity")
    grouped = found.where("fix_key IS NOT NULL").groupBy(*keys, "fix_key").agg(
        F.array_sort(F.collect_list(entry)).alias("items"),
        F.array_sort(F.collect_set("column")).alias("columns"),
    )
    tables = found.select(*keys).distinct() if keys else spark.range(1)
    frame = tables.select(*keys, steps.alias("s")).select(*keys, "s.*")
    titles = F.transform(F.slice("items", 1, 3), lambda x: x["title"])
    more = F.when(F.size("items") > 3, F.concat(F.lit("+"), F.size("items") - 3, F.lit(" more")))
    flagged = F.col("items").isNotNull()
    worst = F.col("items")[0]["severity"]
    include = F.col("forced") if forced is not None else (
        worst.isin("high", "medium") | (F.col("fix_key") == "trim_whitespace"))
    return (
        frame.join(grouped, [*keys, "fix_key"], "left")
        .where(flagged | F.col("forced"))
        .select(
            *keys, "step_no", "fix_key", "label",
            F.when(flagged, F.concat_ws(" · ", titles, more))
            .otherwise(F.lit(fixed.FORCED_SUMMARY)).alias("summary"),
            F.coalesce(F.transform("items", lambda x: x["id"]), _no_texts()).alias("finding_ids"),
            F.coalesce("columns", _no_texts()).alias("columns"),
            F.coalesce(include, F.lit(True)).alias("default_include"),
            F.when(flagged, worst).otherwise(F.lit("low")).alias("highest_severity"),
        )
        .orderBy(*keys, "step_no")
    )


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def plan_line(plan: DataFrame, included: Iterable[str] | None = None,
              table_columns: Iterable[str] = ()) -> DataFrame:
    """One row (per table) with the labels of the chosen steps, joined by arrows."""
    keep = F.col("fix_key").isin(*included) if included is not None else F.col("default_include")
    labels = F.array_sort(F.collect_list(F.when(keep, F.struct("step_no", "label"))))
    text = F.array_join(F.transform(labels, lambda x: x["label"]), " → ")
    line = plan.groupBy(*table_columns).agg(text.alias("line"))
    return line.withColumn(
        "line", F.when(F.col("line") == "", fixed.NO_STEPS).otherwise(F.col("line")))


def _steps(value) -> tuple[str, ...] | None:
    """Known step keys among a saved list."""
    return tuple(k for k in value if k in dict(fixed.STEPS)) if isinstance(value, list) else None


#: What a saved plan holds besides its version and time: how a value is read (None: not usable), and what stands in.
_FIELDS = {
    "profile": (lambda v: v if isinstance(v, str) and v else None, "findings"),
    "fix_keys": (_steps, ()),
    "dayfirst": (bool, False),
}


@dataclass(frozen=True)
class SavedPlan:
    """A plan as it is kept between tables."""

    profile: str
    fix_keys: tuple[str, ...]
    dayfirst: bool

    def to_json(self) -> str:
        order = {k: i for i, (k, _) in enumerate(fixed.STEPS)}
        steps = sorted(filter(order.__contains__, set(self.fix_keys)), key=order.__getitem__)
        stamp = datetime.now(timezone.utc).strftime(fixed.PLAN_TIME)
        kept = asdict(self) | {"fix_keys": steps, "saved_at": stamp}
        return json.dumps({"version": fixed.PLAN_VERSION, **kept}, indent=2) + "\n"

    @classmethod
    def from_json(cls, text: str | bytes) -> SavedPlan:
        """Fields are read one by one; what is missing or unusable takes its default."""
        saved = json.loads(text)
        if not (isinstance(saved, dict) and saved.keys() & {"fix_keys"}):
            raise PlanError(fixed.NOT_A_PLAN)
        read = {}
        for name, (usable, default) in _FIELDS.items():
            value = usable(saved[name]) if name in saved else None
            read[name] = default if value is None else value
        if not read["fix_keys"]:
            raise PlanError(fixed.PLAN_WITHOUT_STEPS)
        return cls(**read)


def save_plan(profile_id: str, fix_keys: Iterable[str], dayfirst: bool) -> str:
    """JSON text of a plan, steps in running order."""
    return SavedPlan(profile_id, tuple(fix_keys), bool(dayfirst)).to_json()


def load_plan(text: str | bytes) -> tuple[str, list[str], bool]:
    """(profile, step keys, day first) of a saved plan; unknown steps are dropped."""
    plan = SavedPlan.from_json(text)
    return plan.profile, list(plan.fix_keys), plan.dayfirst


def options_from_plan(text: str | bytes, fuzzy_groups: DataFrame | None = None) -> CleaningOptions:
    """Cleaning options for a saved plan."""
    _, keys, dayfirst = load_plan(text)
    return CleaningOptions.from_keys(keys, dayfirst=dayfirst, fuzzy_groups=fuzzy_groups)


def options_from_profile(profile_id: str, fuzzy_groups: DataFrame | None = None) -> CleaningOptions:
    """Cleaning options that run a profile's forced steps."""
    _, _, forced, dayfirst = profile(profile_id)
    return CleaningOptions.from_keys(forced or (), dayfirst=dayfirst, fuzzy_groups=fuzzy_groups)
