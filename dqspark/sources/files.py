"""Read CSV and Parquet files into tables with a ``_row_id``."""

from __future__ import annotations

import csv
import hashlib
import math
import re
from collections.abc import Iterable
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark import fixed
from dqspark.functions import cells
from dqspark.session import prepare, settle
from dqspark.sources.tables import (
    TableReadError, apply_types, check, check_suffix, infer_types, null_tokens,
)

_EXTRA = "_extra_field"


def unique_labels(names: Iterable[str]) -> list[str]:
    """Labels for names, a second ``data.csv`` becoming ``data (2).csv``."""
    taken: set[str] = set()
    after: dict[str, int] = {}  # the number a name goes on with
    labels = []
    for name in names:
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        label, i = name, after.get(name, 2)
        while label in taken:
            label, i = f"{stem} ({i}){suffix}", i + 1
        taken.add(label)
        after[name] = i
        labels.append(label)
    return labels


def _plain(path: str) -> str:
    """A listed path as a reader takes it: unquoted, characters that would be patterns escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _file_map(spark: SparkSession, paths: list[str], labels: list[str] | None = None) -> DataFrame:
    """Hash of a file's path to its number (and label): 16 bytes a file, always small enough to broadcast.

    Two paths with one hash are an error, never a wrong number.
    """
    rows = list(enumerate(paths)) if labels is None else list(zip(range(len(paths)), paths, labels))
    schema = "file_no BIGINT, path STRING" + ("" if labels is None else ", label STRING")
    index = spark.createDataFrame(rows, schema).withColumn("_file", F.xxhash64("path")).drop("path")
    if len(paths) > 1 and index.select("_file").distinct().count() < len(paths):
        raise TableReadError("Two file names have the same hash.")
    return index


def probe(spark: SparkSession, paths: list[str]) -> list[Row]:
    """What reading needs to know about each file, from one distributed scan.

    (path, size, valid_utf8, spanning, header): whether every line is valid UTF-8,
    whether quoted fields span lines (some line has an odd number of quotes), and
    the first line.  Only this one row per file reaches the driver.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    start = F.col("block") == 0
    return (
        spark.read.text(paths).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            F.is_valid_utf8(line).alias("valid"),
            (quotes % 2 == 1).alias("odd"),
            F.when(F.col("_metadata.file_block_start") == 0, line.cast("binary")).alias("bytes"),
        )
        .groupBy("path")
        .agg(
            F.max("size").alias("size"),
            F.bool_and("valid").alias("valid_utf8"),
            F.bool_or("odd").alias("spanning"),
            F.min_by("bytes", F.when(start, F.col("seq"))).alias("header"),
        )
        .orderBy("path")
        .collect()
    )


def header_names(line: str) -> list[str]:
    """Column names of a header line; repeats (without case) become ``a.1``, gaps ``Unnamed: 1``."""
    names, seen = [], set()
    for i, raw in enumerate(next(csv.reader([line]), [])):
        base = raw or f"Unnamed: {i}"
        name, k = base, 1
        while name.lower() in seen:
            name, k = f"{base}.{k}", k + 1
        seen.add(name.lower())
        names.append(name)
    return names


def load_csv(spark: SparkSession, paths: str | list[str], *, typed: bool = True) -> DataFrame:
    """Read CSV files with a header as one table, in path and row order.

    Files may differ in encoding (UTF-8 with or without a mark, else Latin-1), in
    header and in whether quoted fields span lines; files alike in all three are
    read by one scan.  Everything is read as text, written once to the shared
    scratch folder so that row ids cannot change, then typed.  Several files get a
    ``_source_file`` column.
    """
    prepare(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = probe(spark, paths)
    if not files:
        raise TableReadError("The CSV file is empty.")
    for f in files:
        check_suffix(f["path"])
    labels = unique_labels([unquote(f["path"].rsplit("/", 1)[-1]) for f in files])
    alike: dict[tuple, list[int]] = {}
    for no, f in enumerate(files):
        encoding = "UTF-8" if f["valid_utf8"] else "ISO-8859-1"
        line = (f["header"] or b"").decode("utf-8-sig" if f["valid_utf8"] else "latin-1")
        names = tuple(header_names(line.rstrip("\r\n")))
        alike.setdefault((encoding, names, bool(f["spanning"])), []).append(no)
    index = _file_map(spark, [f["path"] for f in files], labels)
    raw = None
    for (encoding, names, spanning), members in alike.items():
        part = _read(spark, [_plain(files[no]["path"]) for no in members], names, encoding, spanning)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    raw = raw.withColumn("_file", F.xxhash64("path")).join(F.broadcast(index), "_file", "left").drop("_file")
    stored = settle(_with_csv_ids(raw, len(files), max(f["size"] for f in files)), "csv")
    bad = stored.where(F.col(_EXTRA).isNotNull()).select("label").limit(1).collect()
    if bad:
        raise TableReadError(f"Could not read CSV: a row of '{bad[0][0]}' has too many fields.")
    columns = [c for c in stored.columns if c not in ("label", _EXTRA, fixed.ROW_ID)]
    source = [F.col("label").alias(fixed.SOURCE_FILE)] if len(files) > 1 else []
    table = null_tokens(stored.select(fixed.ROW_ID, *source, *[cells.ref(c) for c in columns]))
    check(table, labels[0] if len(files) == 1 else f"{len(files)} files")
    return apply_types(table, infer_types(table)) if typed else table


def _read(spark, paths, names, encoding, spanning) -> DataFrame:
    fields = [T.StructField(n, T.StringType()) for n in (*names, _EXTRA)]
    return (
        spark.read.schema(T.StructType(fields))
        .options(header=True, encoding=encoding, escape='"', multiLine=spanning, mode="PERMISSIVE")
        .csv(paths)
        .select(
            *[cells.ref(f.name) for f in fields],
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        )
    )


def _with_csv_ids(raw: DataFrame, n_files: int, largest: int) -> DataFrame:
    """Row ids in file, block and line order.

    A row id packs the file number, the block within the file and the line within
    the task.  Where those do not fit 63 bits, the rows are range-sorted instead.
    No block is smaller than ``unit``, so blocks get different numbers.
    """
    conf = raw.sparkSession.conf
    biggest = _bytes(conf.get("spark.sql.files.maxPartitionBytes"))
    unit = max(1, min(biggest, _bytes(conf.get("spark.sql.files.openCostInBytes"))))
    line_bits = 33  # lines per task, as monotonically_increasing_id counts them
    file_bits = max(1, math.ceil(math.log2(n_files + 1)))
    block_bits = 63 - line_bits - file_bits
    columns = [c for c in raw.columns if c not in ("path", "block", "seq", "file_no")]
    order = ["file_no", "block", "seq"]
    if block_bits > 0 and largest // unit < 1 << block_bits:
        line = F.col("seq").bitwiseAND(F.lit((1 << line_bits) - 1))
        block = F.shiftleft((F.col("block") / unit).cast("bigint"), line_bits)
        packed = F.shiftleft("file_no", line_bits + block_bits) + block + line
        return raw.select(packed.alias(fixed.ROW_ID), *[cells.ref(c) for c in columns])
    ordered = raw.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(
        F.monotonically_increasing_id().alias(fixed.ROW_ID), *[cells.ref(c) for c in columns])


def _bytes(text: str) -> int:
    text = str(text).lower().removesuffix("b")
    powers = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(text[:-1]) << powers[text[-1]] if text[-1] in powers else int(text)


def load_parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read Parquet files with a ``_row_id`` in path and row order.

    The id is the file's number and the row's index in the file, so it is the
    same whenever the files are read and needs no shuffle.
    """
    prepare(spark)
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return _with_file_ids(df, _listing(df))


_ROW_BITS = 40  # rows per file


def _listing(df: DataFrame) -> list[str]:
    """Files of a table in order.  Listings spell local paths file:///x, file
    metadata spells them file:/x."""
    return sorted(re.sub(r"^file:/+", "file:/", n) for n in df.inputFiles())


def _with_file_ids(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) == 1:
        return df.select(F.col("_metadata.row_index").alias(fixed.ROW_ID), "*")
    index = _file_map(df.sparkSession, names)
    listed = F.coalesce("file_no", F.raise_error(F.lit("a file was added while reading")).cast("bigint"))
    row_id = F.shiftleft(listed, _ROW_BITS) + F.col("row_index")
    return (
        df.select("*", F.xxhash64(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")).alias("_file"),
                  F.col("_metadata.row_index").alias("row_index"))
        .join(F.broadcast(index), "_file", "left")
        .select(row_id.alias(fixed.ROW_ID), *[cells.ref(c) for c in df.columns])
    )


WHOLE_BYTES = 256_000_000  # a longer file is read piece by piece, not as one row
PIECE_BYTES = 8_000_000
_DIGEST = "path string, length bigint, digest string"


def fingerprints(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, bytes, fingerprint): first 16 hex digits of the SHA-256 of each file's content.

    SHA-256 takes the bytes in order, so a file is one task's work.  Files of
    ``WHOLE_BYTES`` or more are read there in pieces, from the shared file system
    that the path names; no file passes the driver.  Empty files are not listed.  The result is the same on
    both ways.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(paths)
    small = files.where(F.col("length") < WHOLE_BYTES).select(
        "path", "length", F.sha2("content", 256).alias("digest"))
    large = settle(files.where(F.col("length") >= WHOLE_BYTES).select("path", "length"), "large-files")
    tasks, digest = min(max(1, large.count()), _FILE_TASKS), _digest_pieces

    def kernel(batches):
        for batch in batches:
            names, lengths = (c.to_pylist() for c in batch.columns)
            for name, length in zip(names, lengths, strict=True):
                row = {"path": [name], "length": [length], "digest": [digest(name, length)]}
                yield pa.RecordBatch.from_pydict(row)

    streamed = large.repartitionByRange(tasks, "path").mapInArrow(kernel, _DIGEST)
    return small.unionByName(streamed).select(
        "path", F.col("length").alias("bytes"), F.substring("digest", 1, 16).alias("fingerprint"))


_FILE_TASKS = 10_000  # tasks for large files; more files share them


def _digest_pieces(name: str, length: int) -> str:
    """SHA-256 of a file's content, of any length, in constant memory, on the executor that runs the task."""
    if name.startswith("file:"):
        store, path = pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", name)
    else:
        store, path = pyarrow.fs.FileSystem.from_uri(name)
    found, seen = hashlib.sha256(), 0
    with store.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(PIECE_BYTES):
            found.update(piece)
            seen += len(piece)
    if seen != length:
        raise ValueError(f"{name} has changed while it was read")
    return found.hexdigest()


def stack_fingerprint(found: DataFrame) -> DataFrame:
    """One row: fingerprint of several files taken together, in path order."""
    parts = F.array_sort(F.collect_list(F.struct("path", "fingerprint")))
    joined = F.array_join(F.transform(parts, lambda p: p["fingerprint"]), "|")
    return found.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))
