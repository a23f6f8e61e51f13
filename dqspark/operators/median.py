"""Exact medians of any number of columns in three jobs at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.functions import cells

DIRECT = 2_000_000  # values up to which the built-in exact median is used
ACCURACY = 100_000  # of the sketches that bracket a median


def _present(name: str):
    col = cells.ref(name).cast("double")
    return F.when(~F.isnan(col), col)


def exact_medians(df: DataFrame, counts: dict[str, int], *, direct: int = DIRECT) -> dict[str, float]:
    """Median per column; ``counts`` holds the number of non-missing values.

    The built-in ``median`` keeps every distinct value in memory.  For columns
    with more than ``direct`` values, mergeable quantile sketches of all of them,
    in the job of the other medians, bracket the two middle places; a second job
    counts what lies below and within each bracket; a third one ranks the values
    within.  A bracket that misses its place is opened on that side, which costs
    time only.
    """
    wanted = {c: n for c, n in counts.items() if n > 0}
    if not wanted:
        return {}
    large = [c for c, n in wanted.items() if n > direct]
    aggs = []
    for i, (c, n) in enumerate(wanted.items()):
        if n <= direct:
            aggs.append(F.median(_present(c)).alias(f"v{i}"))
            continue
        slack = 2.0 / ACCURACY
        ends = [max(0.0, ((n - 1) // 2) / n - slack), min(1.0, (n // 2 + 1) / n + slack)]
        aggs.append(F.percentile_approx(_present(c), ends, ACCURACY).alias(f"v{i}"))
    found = dict(zip(wanted, df.agg(*aggs).first(), strict=True))
    if not large:
        return found
    bracket = {c: found.pop(c) for c in large}
    placed = df.agg(*[f for c in large for f in (
        F.count_if(_present(c) < bracket[c][0]), F.count_if(_present(c) <= bracket[c][1]))]).first()
    below, cells_in = {}, []
    for i, c in enumerate(large):
        low, high = bracket[c]
        under, upto = placed[2 * i], placed[2 * i + 1]
        first, last = (wanted[c] - 1) // 2, wanted[c] // 2
        x, inside = _present(c), F.lit(True)
        below[i] = under if under <= first else 0
        if under <= first:
            inside &= x >= low
        if upto > last:
            inside &= x <= high
        cells_in.append(F.when(inside & x.isNotNull(), F.struct(F.lit(i).alias("i"), x.alias("x"))))
    ranks = F.create_map(*[F.lit(v) for i, c in enumerate(large) for v in (i, below[i])])
    goals = F.create_map(*[F.lit(v) for i, c in enumerate(large) for v in (i, (wanted[c] - 1) // 2)])
    ends = F.create_map(*[F.lit(v) for i, c in enumerate(large) for v in (i, wanted[c] // 2)])
    own = Window.partitionBy("i").orderBy("x")
    counted = (df.select(F.explode(F.array_compact(F.array(*cells_in))).alias("e"))
               .groupBy("e.i", "e.x").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("upto", F.sum("n").over(own) + ranks[F.col("i")]))
    middle = counted.groupBy("i").agg(F.min(F.when(F.col("upto") > goals[F.col("i")], F.col("x"))).alias("a"),
                                      F.min(F.when(F.col("upto") > ends[F.col("i")], F.col("x"))).alias("b"))
    for r in middle.collect():
        found[large[r["i"]]] = (r["a"] + r["b"]) / 2
    return found
