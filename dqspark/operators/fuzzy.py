"""Similar spellings: values of a column that look like one value.

Rows become distinct values with counts, values become normal forms, and forms
with a ratio of at least ``threshold`` are linked; a group is what links reach.

The search for links is complete.  A ratio of t allows additions and removals of
(1 - t) times the joint length, so forms meet only within classes of near lengths,
in tiles of ``TILE`` forms; in a pair of tiles, sketches of the characters rule
out nearly all pairs at a few nanoseconds each, and the rest is compared in full.
Forms that are joined already are not compared: neighbours in sorted order (of
the forms and of the reversed forms) are linked first, and a pair of tiles gives a
spanning forest, never all its links.  No task holds more than two tiles, however
large a column, a first letter or a group.

``max_unique`` and ``max_block`` are limits that a user may set; both are off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dqspark import fixed
from dqspark.functions import cells, matching, spelling
from dqspark.operators.components import components
from dqspark.operators.numbering import number
from dqspark.operators.profile import ColumnFacts, count_loose_numbers
from dqspark.session import prepare, settle

TILE = 2048  # forms per tile side
FEW_PAIRS = 1  # pairs of tiles per tile up to which all are compared at once
DIRECT_LINKS = 500_000  # links up to which one task joins them
SHAPE = 512  # forms that differ in digits only from which on they are counted by digits
SHAPE_TASK = 1 << 37  # pairs of forms of two shapes for each task that forms with as many different digits meet in
LOWEST_TILE = 1024  # forms per tile side when the lowest ratio is looked for
SMALL_CLUSTER = 64  # forms of clusters that are compared many at a time
SALTS = 32  # first-round buckets when ranking the values of a forced column

GROUP_SCHEMA = (
    "column STRING, variants ARRAY<STRING>, counts MAP<STRING,BIGINT>, suggested STRING, "
    "reasons ARRAY<STRING>, similarity DOUBLE, group_id STRING, group_no BIGINT"
)
_LINK_SQL = "a bigint, b bigint"
_TILES = ("part string, class int, owner bigint, tile int, low bigint, high bigint, short int, long int, "
          "least array<int>, most array<int>")


@dataclass
class FuzzyScan:
    groups: DataFrame  # GROUP_SCHEMA; group_no orders the groups of a column
    status: DataFrame  # column, unique_count, status, truncated


def text_columns(df: DataFrame, facts: list[ColumnFacts] | None = None) -> list[str]:
    """Text columns with values that are not mostly numbers."""
    texts = [f.name for f in cells.data_fields(df) if cells.is_text(f.dataType)]
    if not texts:
        return []
    if facts is None:
        facts = count_loose_numbers(df.select(*[cells.ref(c) for c in texts]))
    return [
        f.name for f in facts
        if cells.is_text(f.dtype) and f.present and f.of_present(f.loose_numbers) <= fixed.TEXT_NUMERIC_SHARE
    ]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, _row_id) of the non-blank cells."""
    entries = []
    for name in columns:
        value = cells.ref(name)
        keep = value.isNotNull() & (cells.strip(value) != "")
        entries.append(F.when(keep, F.struct(F.lit(name).alias("column"), value.alias("value"))))
    return (
        df.select(fixed.ROW_ID, F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .select("e.column", "e.value", fixed.ROW_ID)
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows, first_id) per exact spelling; blanks left out."""
    return (
        _long(df, columns).groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(fixed.ROW_ID).alias("first_id"))
    )


def unique_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, unique_count).  Long values travel as SHA-256 digests."""
    value = F.col("value")
    narrow = F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)
    return (
        _long(df, columns).select("column", narrow.alias("value")).distinct()
        .groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    )


def top_values(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` most common values per column, ties to the first seen.

    Ranked within hash buckets first, so the final ranking of a column reads at
    most ``SALTS * n`` rows however many values it has.
    """
    best = [F.col("rows").desc(), F.col("first_id")]
    salted = Window.partitionBy("column", "salt").orderBy(*best)
    final = Window.partitionBy("column").orderBy(*best)
    return (
        counted.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)))
        .withColumn("rn", F.row_number().over(salted)).where(F.col("rn") <= n)
        .withColumn("rn", F.row_number().over(final)).where(F.col("rn") <= n)
        .drop("salt", "rn")
    )


def spellings(counted: DataFrame, forced: list[str] = ()) -> DataFrame:
    """Values with their normal form: adds norm, stripped, fold, rank, first.

    (rank, first) is the order in which values are taken up: first appearance, or
    frequency in a forced column.
    """
    rank = F.when(F.col("column").isin(*forced), -F.col("rows")).otherwise(0) if forced else F.lit(0)
    shape = T.StructType([T.StructField(c, T.StringType()) for c in ("norm", "stripped", "fold")])
    made = F.pandas_udf(spelling.forms, shape)("value")
    return (counted.withColumn("form", made).select("column", "value", "rows", "first_id", "form.*")
            .withColumns({"rank": rank.cast("bigint"), "first": F.col("first_id")}))


def _key():
    """First of the keys that have a form: a sort by numbers hardly compares texts."""
    return F.xxhash64("norm").alias("key")


def normal_forms(values: DataFrame) -> DataFrame:
    """(fid, column, norm, block, rank, first) per normal form, stored; ``fid`` is any unique number."""
    turn = F.min(F.struct("rank", "first")).alias("turn")
    return settle(
        values.groupBy(_key(), "column", "norm").agg(turn).select(
            F.monotonically_increasing_id().alias("fid"), "column", "norm",
            F.substring("norm", 1, 2).alias("block"), "turn.rank", "turn.first"),
        "normal-forms")


def block_sizes(forms: DataFrame, max_block: int) -> DataFrame:
    """(column, block, norms, compared, truncated): what a limit of forms per block leaves out."""
    return (
        forms.groupBy("column", "block").agg(F.count(F.lit(1)).alias("norms"))
        .withColumn("compared", F.least("norms", F.lit(max_block).cast("bigint")))
        .withColumn("truncated", F.col("norms") - F.col("compared"))
    )


def _parts(forms: DataFrame, max_block: int | None) -> DataFrame:
    """Forms that are compared, with ``part``: forms of different parts are not."""
    if max_block is None:
        return forms.withColumn("part", F.col("column"))
    order = Window.partitionBy("column", "block").orderBy("rank", "first")
    return (forms.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_block).drop("place")
            .withColumn("part", F.concat("column", F.lit("\0"), "block")))


def _neighbours(forms: DataFrame, threshold: float) -> DataFrame:
    """Forms (part, norm, fid, rank, first) with ``comp``, stored.

    Linked are forms that follow each other in the order of the forms, of their second
    halves or of the reversed forms.  The first order gives runs without a join; the
    others only compare forms of different runs, and link runs.
    """
    n, length_ratio = _spread(forms), fixed.LENGTH_RATIO
    find_runs, find_links = matching.runs, matching.neighbours

    def in_runs(batches):
        return find_runs(batches, threshold, length_ratio)

    def in_links(batches):
        return find_links(batches, threshold, length_ratio)

    ordered = forms.repartitionByRange(n, "part", "norm").sortWithinPartitions("part", "norm")
    placed = settle(ordered.select("part", "norm", "fid", "rank", "first").mapInArrow(
        in_runs, "part string, norm string, fid bigint, rank bigint, first bigint, comp bigint"), "spelling-runs")
    half = F.expr("concat(substr(norm, 1 + length(norm) div 2), '\\0', substr(norm, 1, length(norm) div 2))")
    ways = F.explode(F.array(F.struct(F.lit("h").alias("way"), half.alias("by")),
                             F.struct(F.lit("z").alias("way"), F.reverse("norm").alias("by"))))
    rows = placed.withColumn("w", ways).select(
        F.concat("w.way", "part").alias("part"), "w.by", "norm", "comp", "rank", "first")
    links = (rows.repartitionByRange(n, "part", "by").sortWithinPartitions("part", "by")
             .select("part", "norm", "comp", "rank", "first").mapInArrow(in_links, _LINK_SQL))
    return _contracted(placed, links)


def _contracted(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Forms with ``comp`` after components were linked, stored."""
    joined = components(links, "spelling-components", DIRECT_LINKS).select(F.col("id").alias("comp"), "component")
    return settle(placed.join(joined, "comp", "left").withColumn("comp", F.coalesce("component", "comp"))
                  .drop("component"), "spelling-forms")


def _tile_pairs(forms: DataFrame, threshold: float, blocks: bool, rough: bool) -> tuple[DataFrame, list[str], bool]:
    """Forms once for each pair of tiles they are in, with ``side`` (0, 1; 2: a tile with itself); the pair's keys;
    whether these are all pairs.  ``rough``: where many pairs are left, only tiles with themselves.

    Lengths of similar forms differ by a factor of ``wide`` at most, so a class of
    lengths meets itself and the next one.  A component of a tile or more has tiles
    of its own, so that it never meets itself; ``shaped`` forms do not meet each other; a part of one component is left out; and characters that all forms of a tile
    have more often than any of the other rule out whole pairs of tiles.
    """
    if blocks:  # a block is one tile
        return forms.withColumn("side", F.lit(2)), ["part"], True
    wide = max(1.05, min((2 - threshold) / threshold, 1 / fixed.LENGTH_RATIO)) * 1.0001
    shaped = F.col("shaped") if "shaped" in forms.columns else F.lit(False)
    length = F.length("norm")
    classed = forms.withColumn("class", F.floor(F.log(length.cast("double")) / F.lit(math.log(wide))).cast("int"))
    sizes = settle(classed.groupBy("part", "class", "comp").agg(F.count(F.lit(1)).alias("n")), "spelling-sizes")
    large = sizes.where(F.col("n") >= TILE).select("part", "class", "comp", F.lit(True).alias("alone"))
    apart = sizes.groupBy("part").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("part")
    grouped = classed.join(F.broadcast(apart), "part").join(F.broadcast(large), ["part", "class", "comp"], "left").withColumn(
        "owner", F.when(F.col("alone"), F.col("comp")).when(shaped, -2).otherwise(-1)).drop("alone")
    counts = settle(grouped.groupBy("part", "class", "owner").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles")), "spelling-classes")
    tile = F.pmod(F.xxhash64("norm"), F.col("tiles")).cast("int")
    keys = ["part", "class", "owner", "tile"]
    placed = settle(grouped.join(F.broadcast(counts), keys[:3]).withColumn("tile", tile)
                    .select(*keys, "norm", "fid", "rank", "first", "comp"), "spelling-placed")
    tiles = settle(placed.select(*keys, "norm", "comp").repartition(_spread(forms), *keys).groupBy(*keys).applyInArrow(
        matching.tiled, _TILES).withColumn("tid", F.monotonically_increasing_id()), "spelling-tiles")
    x, y = tiles.repartition(_spread(forms)).alias("x"), tiles.alias("y")
    one = (F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low"))

    def missing(least: str, most: str):
        more = F.zip_with(least, most, lambda low, high: F.greatest(low - high, F.lit(0)))
        return F.aggregate(more, F.lit(0), lambda total, n: total + n)

    apart = missing("x.least", "y.most") + missing("y.least", "x.most")
    step = F.col("y.class") - F.col("x.class")
    pairs = settle(x.join(F.broadcast(y), (F.col("x.part") == F.col("y.part")) & (
        (step == 1) | ((step == 0) & (F.col("x.tid") <= F.col("y.tid"))))).where(
        ~one & ~((F.col("x.owner") == -2) & (F.col("y.owner") == -2)) & (F.col("x.long") >= fixed.LENGTH_RATIO * F.col("y.short") - 1e-9)
        & (F.col("y.long") >= fixed.LENGTH_RATIO * F.col("x.short") - 1e-9)
        & (apart <= (1 - threshold) * (F.col("x.long") + F.col("y.long")) + 1e-9)).select(
        F.monotonically_increasing_id().alias("pair"), F.col("x.tid").alias("lo"), F.col("y.tid").alias("hi")), "spelling-tile-pairs")
    whole = not rough or pairs.count() <= FEW_PAIRS * tiles.count()
    if not whole:
        pairs = pairs.where("lo = hi")
    sides = pairs.select("pair", F.col("lo").alias("tid"), F.when(F.col("lo") == F.col("hi"), 2).otherwise(0).alias("side")).unionByName(
        pairs.where("lo <> hi").select("pair", F.col("hi").alias("tid"), F.lit(1).alias("side")))
    rows = placed.join(F.broadcast(tiles.select("part", "class", "owner", "tile", "tid")), ["part", "class", "owner", "tile"])
    return rows.join(sides, "tid"), ["pair"], whole


def _between_tiles(forms: DataFrame, threshold: float, blocks: bool, kernel, schema: str,
                   rough: bool = False) -> tuple[DataFrame, bool]:
    """Run a kernel over each pair of tiles of forms with ``part`` and ``comp``; whether these were all pairs."""
    rows, keys, whole = _tile_pairs(forms, threshold, blocks, rough)
    length_ratio = fixed.LENGTH_RATIO

    def compare(table: pa.Table) -> pa.Table:
        return kernel(table, threshold, length_ratio)

    rows = rows.select(*keys, "side", "norm", "fid", "rank", "first", "comp")
    return rows.repartition(_spread(forms), *keys).groupBy(*keys).applyInArrow(compare, schema), whole


def clusters(forms: DataFrame, threshold: float, max_block: int | None = None) -> DataFrame:
    """Forms with ``cluster``, the smallest ``fid`` that links reach."""
    if threshold > 1:  # no two forms are that similar
        return forms.withColumn("cluster", F.col("fid"))
    placed = _neighbours(_parts(forms, max_block), threshold)
    blocks, whole, rough = max_block is not None, False, True
    while not whole:
        far, whole = _between_tiles(placed, threshold, blocks, matching.linked, _LINK_SQL, rough)
        placed, rough = _contracted(placed, far), False
    if not blocks:
        return placed.select("fid", F.col("part").alias("column"), "norm", "rank", "first", F.col("comp").alias("cluster"))
    known = placed.select("fid", F.col("comp").alias("cluster"))
    return forms.join(known, "fid", "left").withColumn("cluster", F.coalesce("cluster", "fid"))


def similar_counts(forms: DataFrame, threshold: float = fixed.SIMILAR_RATIO, max_block: int | None = None) -> DataFrame:
    """(column, norm, links, best): how many other forms each is similar to, and the highest ratio.

    Forms of common shapes (``_shaped``) meet each other by their digits, all other pairs of forms by tiles.
    """
    placed = _parts(forms, max_block).withColumn("comp", F.col("fid"))
    schema, by_digits = "fid bigint, links bigint, best double", None
    if max_block is None:
        shapes = _common_shapes(forms)
        if not shapes.isEmpty():
            placed = settle(placed.withColumn("shape", _shape()).join(shapes.select("column", "shape", "sid"), ["column", "shape"], "left")
                            .withColumn("shaped", F.col("sid").isNotNull()), "spelling-shaped")
            by_digits = _between_shapes(placed.where("shaped"), shapes, threshold, schema)
    found, _ = _between_tiles(placed, threshold, max_block is not None, matching.counted, schema)
    if by_digits is not None:
        found = found.unionByName(by_digits)
    total = found.groupBy("fid").agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    return forms.join(total, "fid").select("column", "norm", "links", "best")


def _shape():
    return F.regexp_replace("norm", "[0-9]", "0")


def _common_shapes(forms: DataFrame) -> DataFrame:
    """(column, shape, forms, sid) of the shapes, digits as 0, that ``SHAPE`` forms or more with few digits have, stored."""
    digits = F.length(F.regexp_replace("norm", "[^0-9]", ""))
    few = forms.where(digits.between(1, matching.DIGITS) & (F.length("norm") <= matching.WORD))
    return settle(few.groupBy("column", _shape().alias("shape")).agg(F.count(F.lit(1)).alias("forms")).where(
        F.col("forms") >= SHAPE).withColumn("sid", F.monotonically_increasing_id()), "spelling-shapes")


def _between_shapes(forms: DataFrame, shapes: DataFrame, threshold: float, schema: str) -> DataFrame:
    """Similar forms of each form of a common shape in forms of common shapes.

    A task has the forms of one shape with some sets of digits and all forms of another:
    at most a million, as they differ in ``DIGITS`` digits.
    """
    length_ratio = fixed.LENGTH_RATIO
    meet, count = matching.shapes_meet, matching.counted_by_digits

    def may_meet(batches):
        return meet(batches, threshold, length_ratio)

    def compare(table: pa.Table) -> pa.Table:
        return count(table, threshold, length_ratio)

    x = shapes.select("column", F.col("sid").alias("a"), F.col("shape").alias("first"), F.col("forms").alias("m")).repartition(_spread(forms))
    y = shapes.select("column", F.col("sid").alias("b"), F.col("shape").alias("second"), "forms")
    near = F.least(F.length("first"), F.length("second")) >= length_ratio * F.greatest(F.length("first"), F.length("second")) - 1e-9
    pairs = settle(x.join(F.broadcast(y), "column").where(near).select("a", "b", (F.col("m") * F.col("forms")).alias("n"), "first", "second").mapInArrow(
        may_meet, "a bigint, b bigint, n bigint"), "spelling-shape-pairs")
    digits = sum((F.when(F.instr("norm", str(d)) > 0, 1 << d).otherwise(0) for d in range(10)), F.lit(0))
    several = F.ceil(F.col("n") / F.lit(SHAPE_TASK)).cast("int")
    kinds = F.bit_count("digits")  # few forms have three or less
    task = F.when(kinds <= 3, 0).otherwise(kinds * 1024 + F.pmod(F.xxhash64("digits"), several))
    cells_ = ["norm", "fid", "rank", "first"]
    own = forms.withColumn("digits", digits).join(pairs, F.col("sid") == F.col("a")).select(
        "a", "b", task.cast("int").alias("task"), F.lit(0).alias("side"), *cells_)
    tasks = settle(own.select("a", "b", "task").distinct(), "spelling-shape-tasks")
    others = forms.join(tasks, F.col("sid") == F.col("b")).select("a", "b", "task", F.lit(1).alias("side"), *cells_)
    keys = ["a", "b", "task"]
    return own.unionByName(others).repartition(8 * _spread(forms), *keys).groupBy(*keys).applyInArrow(compare, schema)


def ratio_floors(large: DataFrame) -> DataFrame:
    """(cluster, n, m, floor): no ratio between forms of lengths n <= m of a cluster is lower, stored.

    Follows from which characters occur at which place of the forms of one length
    (``matching.least_common``), whatever the number of forms.
    """
    shapes = (large.select("cluster", "norm").mapInArrow(matching.shapes, "cluster bigint, length int, place int, mark int")
              .groupBy("cluster", "length", "place").agg(F.collect_set("mark").alias("marks")))
    known = F.when(F.size("marks") <= matching.ANY, F.array_sort("marks")).otherwise(F.array().cast("array<int>"))
    shapes = shapes.groupBy("cluster", "length").agg(F.array_sort(F.collect_list(F.struct("place", known.alias("marks")))).alias("shape"))
    lengths = settle(large.groupBy("cluster", F.length("norm").alias("length")).agg(F.count(F.lit(1)).alias("forms"))
                     .join(shapes, ["cluster", "length"], "left")
                     .select("cluster", "length", "forms", F.col("shape.marks").alias("shape")), "cluster-shapes")
    x = lengths.select("cluster", F.col("length").alias("n"), "forms", F.col("shape").alias("first"))
    y = lengths.select("cluster", F.col("length").alias("m"), F.col("shape").alias("second"))
    meets = x.join(y, "cluster").where("n < m or (n = m and forms > 1)").select("cluster", "n", "m", "first", "second")
    return settle(meets.repartition(_spread(large)).mapInArrow(matching.floors, "cluster bigint, n int, m int, floor double"), "cluster-floors")


def lowest_ratios(clustered: DataFrame) -> DataFrame:
    """(cluster, similarity, compared): lowest ratio between the forms of each cluster of two or more.

    Clusters of a few forms are compared whole, many in one task.  For larger ones
    far pairs give a first low ratio; what the places of the characters rule out is
    not compared.  The rest goes by tiles, first each with itself, and a tile stops
    when no lower ratio is possible.
    """
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = settle(clustered.join(sizes, "cluster").select("cluster", "n", "norm", "fid", "rank", "first"), "cluster-forms")
    n = _spread(rows)
    small = rows.where(F.col("n") <= SMALL_CLUSTER).repartition(n, "cluster").sortWithinPartitions("cluster")
    schema = "cluster bigint, similarity double, compared bigint"
    found = small.select("cluster", "norm", "rank", "first").mapInArrow(matching.lowest_of_small, schema)
    large = rows.where(F.col("n") > SMALL_CLUSTER)
    if large.isEmpty():
        return found
    floors = ratio_floors(large)
    tiles = F.ceil(F.col("n") / F.lit(LOWEST_TILE)).cast("int")
    tile = F.pmod(F.xxhash64("norm"), F.col("tiles")).cast("int")
    placed = large.withColumn("tiles", tiles).withColumn("tile", tile).withColumn("length", F.length("norm"))
    keys, between = ["cluster", "lo", "hi"], matching.lowest_between

    def alone(forms: DataFrame) -> DataFrame:
        return forms.withColumns({"lo": F.col("tile"), "hi": F.col("tile"), "side": F.lit(2)})

    def others(forms: DataFrame) -> DataFrame:
        paired = forms.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("tile <> other")
        return paired.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other"),
                                   "side": F.when(F.col("tile") < F.col("other"), 0).otherwise(1)})

    def run(all_pairs: bool, forms: DataFrame) -> DataFrame:
        def kernel(table: pa.Table) -> pa.Table:
            return between(table, all_pairs)

        rows = forms.select(*keys, "side", "norm", "fid", "rank", "first", "floor", "known")
        return rows.repartition(n, *keys).groupBy(*keys).applyInArrow(kernel, schema)

    least = floors.groupBy("cluster").agg(F.min("floor").alias("floor"))
    low = run(False, alone(placed.join(least, "cluster").withColumn("known", F.lit(1.0))))
    for round_ in (alone, others, None):
        low = settle(low.groupBy("cluster").agg(F.min("similarity").alias("similarity"), F.sum("compared").alias("compared")),
                     "cluster-ratios")
        known = low.select("cluster", F.col("similarity").alias("known"))
        open_ = floors.join(known, "cluster").where("floor < known")
        if round_ is None or open_.isEmpty():
            break
        left = open_.select("cluster", "known", "floor", F.explode(F.array("n", "m")).alias("length")).groupBy(
            "cluster", "length").agg(F.min("floor").alias("floor"), F.first("known").alias("known"))
        low = low.unionByName(run(True, round_(placed.join(F.broadcast(left), ["cluster", "length"]))))
    return found.unionByName(low)


def _spread(df: DataFrame) -> int:
    """Partitions for little data that costs much CPU (adaptive merging would undo it)."""
    return max(8, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 512))


def describe_groups(values: DataFrame, clustered: DataFrame, explain: bool = True) -> DataFrame:
    """One row per cluster of two or more spellings (GROUP_SCHEMA).

    Without ``explain``, similarity is null and the reasons do not tell it.

    Kept is the most common spelling; then one that begins with a capital but is
    not all capitals; then one without padding; then the longest; then the first.
    """
    stripped = F.col("stripped")
    titled = stripped.rlike(r"^\p{IsUppercase}") & stripped.rlike(r"[\p{IsLowercase}\p{Lt}]")
    known = clustered.select("column", "norm", "cluster", F.col("rank").alias("norm_rank"), F.col("first").alias("norm_first"))
    best = F.struct((-F.col("rows")).alias("less"), (~titled).alias("plain"), (stripped != F.col("value")).alias("padded"),
                    (-F.length("stripped")).alias("shorter"), "norm_rank", "norm_first", "rank", "first", "value")
    # Texts that differ, or differ in case, within one form: forms of a group have none in common.
    same = ["key", "column", "norm"]
    members = values.withColumn("key", _key()).join(known.withColumn("key", _key()), same).groupBy(*same, "cluster").agg(
        F.collect_list(F.struct((-F.col("rows")).alias("order"), "value")).alias("members"), F.min(best).alias("best"),
        F.bool_or((stripped != F.col("value")) | F.col("value").contains("  ")).alias("spaced"),
        F.size(F.collect_set("stripped")).alias("texts"), F.size(F.collect_set("fold")).alias("folds"))
    grouped = members.groupBy("column", "cluster").agg(
        F.sort_array(F.flatten(F.collect_list("members"))).alias("members"), F.min("best")["value"].alias("suggested"),
        F.bool_or("spaced").alias("spaced"), F.sum("texts").alias("texts"), F.sum("folds").alias("folds"),
        F.min(F.struct("best.norm_rank", "best.norm_first")).alias("turn")).where(F.size("members") > 1)
    percent = F.concat(F.bround(F.col("similarity") * 100).cast("int").cast("string"), F.lit("% similar"))
    reasons = F.array_compact(F.array(
        F.when(F.col("spaced"), F.lit("spacing")), F.when(F.col("folds") < F.col("texts"), F.lit("casing")),
        F.when(F.col("similarity").isNotNull(), percent)))
    variants = F.transform("members", lambda m: m["value"])
    low = lowest_ratios(clustered).drop("compared") if explain else None
    grouped = grouped.join(low, "cluster", "left") if explain else grouped.withColumn("similarity", F.lit(None).cast("double"))
    made = settle(grouped.select(
        "column", variants.alias("variants"),
        F.map_from_entries(F.transform("members", lambda m: F.struct(m["value"], -m["order"]))).alias("counts"),
        "suggested", F.when(F.size(reasons) == 0, F.array(F.lit("identical after trim"))).otherwise(reasons).alias("reasons"),
        F.coalesce("similarity", F.lit(1.0 if explain else None)).alias("similarity"), group_id("column", variants).alias("group_id"),
        "turn.norm_rank", "turn.norm_first"), "spelling-groups")
    numbers = number(made.select("column", "norm_rank", "norm_first", "group_id"), "column",
                     ["norm_rank", "norm_first", "group_id"], "group_no", "group-numbers")
    return made.drop("norm_rank", "norm_first").join(numbers.select("column", "group_id", "group_no"), ["column", "group_id"]).select(
        *[f.split()[0] for f in GROUP_SCHEMA.replace("STRING,BIGINT", "").split(", ")])


def group_id(column: str, variants):
    """Stable name of a group: depends on its column and spellings only."""
    return F.substring(F.sha1(F.concat_ws("\0", column, F.sort_array(variants)).cast("binary")), 1, 12)


def scan(
    df: DataFrame,
    *,
    threshold: float = fixed.SIMILAR_RATIO,
    max_unique: int | None = None,
    max_block: int | None = None,
    force_columns: set[str] | None = None,
    columns: list[str] | None = None,
    facts: list[ColumnFacts] | None = None,
    explain: bool = True,
) -> FuzzyScan:
    """Find similar spellings in the text columns of a table.

    Every form of a column is compared.  With ``max_unique``, columns over that
    many values are skipped and reported, unless forced: then their
    ``max_unique`` most common values are scanned.  With ``max_block``, forms meet
    only within a block of equal first two characters, which compares its first
    ``max_block`` forms; others still group by equal normal form and are counted
    as truncated.  Values are compared whole, whatever their length.  ``explain``
    looks for the lowest ratio of each group, which merging does not need.
    """
    spark = prepare(df.sparkSession)
    texts = text_columns(df, facts)
    if columns is not None:
        texts = [c for c in texts if c in columns]
    none = spark.createDataFrame([], GROUP_SCHEMA)
    if not texts:
        return FuzzyScan(none, status_frame(spark, [], {}, set(), max_unique, {}))
    values = settle(spellings(value_counts(df, texts)), "spellings")
    uniques = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [c for c in texts if max_unique is not None and uniques.get(c, 0) > max_unique]
    forced = [c for c in over if c in (force_columns or ())]
    if over:
        left = values.where(~F.col("column").isin(*over))
        if forced:
            common = top_values(values.where(F.col("column").isin(*forced)), max_unique)
            left = left.unionByName(common.withColumn("rank", -F.col("rows")))
        values = settle(left, "spellings")
    forms = normal_forms(values)
    cut = {}
    if max_block is not None:
        cut = {r["column"]: r["truncated"] for r in block_sizes(forms, max_block).groupBy("column").agg(
            F.sum("truncated").alias("truncated")).collect()}
    clustered = settle(clusters(forms, threshold, max_block), "spelling-clusters")
    groups = settle(describe_groups(values, clustered, explain), "spelling-groups")
    return FuzzyScan(groups, status_frame(spark, texts, uniques, set(forced), max_unique, cut))


def status_frame(spark, texts, uniques, forced, max_unique, cut) -> DataFrame:
    rows = []
    for name in texts:
        n = uniques.get(name, 0)
        skipped = max_unique is not None and n > max_unique
        state = "sampled" if name in forced else "skipped" if skipped else "scanned"
        rows.append((name, n, state, int(cut.get(name, 0))))
    return spark.createDataFrame(
        rows, "column STRING, unique_count BIGINT, status STRING, truncated BIGINT"
    )


def decide(groups: DataFrame, decisions: DataFrame | None = None,
           leave_columns: list[str] | None = None) -> DataFrame:
    """Apply a reviewer's choices to groups.

    ``decisions`` has (group_id, include, keeper): a group left out is dropped,
    a keeper that is one of the variants replaces the suggestion.
    """
    if leave_columns:
        groups = groups.where(~F.col("column").isin(*leave_columns))
    if decisions is None:
        return groups
    picked = decisions.select("group_id", "include", "keeper").dropDuplicates(["group_id"])
    names = groups.columns
    valid = F.array_contains("variants", F.col("keeper"))
    return (
        groups.join(picked, "group_id", "left")
        .where(F.coalesce("include", F.lit(True)))
        .withColumn("suggested", F.when(valid, F.col("keeper")).otherwise(F.col("suggested")))
        .select(*names)
    )
