"""Connected components by rounds of label contraction, each settled to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqspark.functions import matching
from dqspark.session import settle


def components(edges: DataFrame, label: str = "components", direct: int = 0) -> DataFrame:
    """Smallest reachable id of every id that an edge names: (id, component).

    ``edges`` has two bigint columns, a and b; direction, repeats, loops and
    nulls do not matter.  Large-star and small-star steps alternate, so the
    number of rounds grows with the logarithm of the longest chain.  A vertex
    with very many neighbours only needs their minimum, which is aggregated
    before the shuffle.  Every round is written to the shared folder; the
    driver sees two numbers per round.  Up to ``direct`` edges, counted first, are
    joined in one task instead, with the same result.
    """
    known = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    now = settle(known.distinct(), label)
    if direct and now.count() <= direct:
        return settle(now.repartition(1).mapInArrow(matching.joined, "id bigint, component bigint"), label)
    state = None
    while True:
        now = settle(_small_star(_large_star(now)), label)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _both(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.unionByName(turned)


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour to the smallest id around."""
    around = _both(edges)
    least = around.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return (around.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie every smaller neighbour, and the id itself, to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()
