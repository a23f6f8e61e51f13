import pytest
from pyspark.sql import functions as F

from dqspark.operators import report
from dqspark.session import scratch_path
from dqspark.sinks import export
from dqspark.sources import files, tables


def write(path, data: bytes):
    path.write_bytes(data)
    return str(path)


def test_encodings_and_marks(spark, tmp_path):
    a = write(tmp_path / "a.csv", "name,n\ncafé,1\n".encode("utf-8"))
    b = write(tmp_path / "b.csv", "name,n\ncafé,2\n".encode("utf-8-sig"))
    c = write(tmp_path / "c.csv", "name,n\ncafé,3\n".encode("latin-1"))
    got = files.load_csv(spark, [a, b, c]).orderBy("_row_id").collect()
    assert [(r["_source_file"], r["name"], r["n"]) for r in got] == [
        ("a.csv", "café", 1), ("b.csv", "café", 2), ("c.csv", "café", 3)]


def test_null_tokens_and_types(spark, tmp_path):
    text = 'a,b,c,d,e\n1,,true,x,NULL\nNA,1.5,FALSE, NULL ,n/a\n"",2,True,None,\n'
    df = files.load_csv(spark, write(tmp_path / "t.csv", text.encode()))
    assert [t for _, t in df.dtypes[1:]] == ["bigint", "double", "boolean", "string", "double"]
    assert [tuple(r)[1:] for r in df.orderBy("_row_id").collect()] == [
        (1, None, True, "x", None), (None, 1.5, False, " NULL ", None), (None, 2.0, True, None, None)]


def test_quotes_and_fields_over_lines(spark, tmp_path):
    text = 'a,b\n"x ""q""","two\nlines"\n1,2\n'
    got = files.load_csv(spark, write(tmp_path / "q.csv", text.encode()), typed=False)
    assert [tuple(r)[1:] for r in got.orderBy("_row_id").collect()] == [('x "q"', "two\nlines"), ("1", "2")]


def test_headers_repeated_missing_and_different(spark, tmp_path):
    assert files.header_names("a,a,,b,a") == ["a", "a.1", "Unnamed: 2", "b", "a.2"]
    a = write(tmp_path / "a.csv", b"id,x\n1,p\n")
    b = write(tmp_path / "b.csv", b"x,id,extra\nq,2,9\n")
    got = files.load_csv(spark, [a, b]).orderBy("_row_id").collect()
    assert [(r["id"], r["x"], r["extra"]) for r in got] == [(1, "p", None), (2, "q", 9)]


def test_unreadable_inputs(spark, tmp_path):
    with pytest.raises(tables.TableReadError, match="too many fields"):
        files.load_csv(spark, write(tmp_path / "m.csv", b"a,b\n1,2,3\n"))
    with pytest.raises(tables.TableReadError, match="no rows"):
        files.load_csv(spark, write(tmp_path / "h.csv", b"a,b\n"))
    with pytest.raises(tables.TableReadError):
        files.load_csv(spark, write(tmp_path / "z.csv", b""))
    with pytest.raises(tables.TableReadError, match="Unsupported"):
        files.load_csv(spark, write(tmp_path / "t.txt", b"a\n1\n"))


def test_short_rows_are_filled_with_nulls(spark, tmp_path):
    df = files.load_csv(spark, write(tmp_path / "s.csv", b"a,b\n1\n2,3\n"))
    assert [tuple(r)[1:] for r in df.orderBy("_row_id").collect()] == [(1, None), (2, 3)]


@pytest.mark.parametrize("pack", [True, False])
def test_row_ids_follow_the_lines_of_split_files(spark, tmp_path, monkeypatch, pack):
    lines = [f"{i},{'x' * 40}" for i in range(4000)]
    a = write(tmp_path / "a.csv", ("n,s\n" + "\n".join(lines[:3000]) + "\n").encode())
    b = write(tmp_path / "b.csv", ("n,s\n" + "\n".join(lines[3000:]) + "\n").encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "10000")
    if not pack:
        monkeypatch.setattr(files, "_bytes", lambda text: 1 << 62)
        monkeypatch.setattr(files.math, "log2", lambda x: 40)
    try:
        df = files.load_csv(spark, [a, b])
        got = [r["n"] for r in df.orderBy("_row_id").collect()]
        assert got == list(range(4000)) and df.select("_row_id").distinct().count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_paths_with_spaces(spark, tmp_path):
    a = write(tmp_path / "a b.csv", b"n\n1\n")
    b = write(tmp_path / "c%20d.csv", b"n\n2\n")
    got = files.load_csv(spark, [a, b]).orderBy("_row_id").collect()
    assert [(r["_source_file"], r["n"]) for r in got] == [("a b.csv", 1), ("c%20d.csv", 2)]


def test_parquet_row_ids(spark, tmp_path):
    path = str(tmp_path / "p q")
    spark.range(0, 1000, 1, 4).write.parquet(path)
    df = files.load_parquet(spark, path)
    assert [r["id"] for r in df.orderBy("_row_id").collect()] == list(range(1000))
    assert df.select("_row_id").distinct().count() == 1000


def test_labels():
    assert files.unique_labels(["d.csv", "d.csv", "d (2).csv", "x", "x", ".h", ".h", "d.csv"]) == [
        "d.csv", "d (2).csv", "d (2) (2).csv", "x", "x (2)", ".h", ".h (2)", "d (3).csv"]


def test_stack(spark):
    jan = spark.createDataFrame([(1, "a"), (2, "b")], "id INT, name STRING")
    feb = spark.createDataFrame([(1, "a", 1.5), (3, "c", None)], "id INT, name STRING, extra DOUBLE")
    out, differ = tables.stack({"jan": jan, "feb": feb})
    assert out.columns == ["_source_file", "id", "name", "extra"] and differ
    assert out.dropDuplicates().count() == 4
    text = spark.createDataFrame([("x",)], "id STRING")
    out, _ = tables.stack({"jan": jan, "text": text})
    assert sorted(r["id"] for r in out.collect()) == ["1", "2", "x"]


def test_fingerprints(spark, tmp_path):
    import hashlib

    a = write(tmp_path / "a.bin", b"hello")
    b = write(tmp_path / "b.bin", b"world")
    found = files.fingerprints(spark, [a, b])
    each = [hashlib.sha256(x).hexdigest()[:16] for x in (b"hello", b"world")]
    assert [r["fingerprint"] for r in found.orderBy("path").collect()] == each
    whole = hashlib.sha256("|".join(each).encode()).hexdigest()[:16]
    assert files.stack_fingerprint(found).first()["fingerprint"] == whole


def test_fingerprints_piece_by_piece(spark, tmp_path, monkeypatch):
    """Files read in pieces on executors have the fingerprints of files read whole; the driver opens none."""
    for i, size in enumerate((1, 999, 1000, 5000, 70_001)):
        (tmp_path / f"f {i}.bin").write_bytes(bytes(range(251)) * (size // 251) + b"x" * (size % 251))
    whole = {tuple(r) for r in files.fingerprints(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000)
    monkeypatch.setattr(files, "PIECE_BYTES", 700)
    assert {tuple(r) for r in files.fingerprints(spark, str(tmp_path)).collect()} == whole and len(whole) == 5


def test_fingerprints_of_large_files_are_their_content(spark, tmp_path):
    import hashlib
    import os

    paths = [write(tmp_path / n, b"") for n in ("a.bin", "b.bin")]
    for p in paths:
        os.truncate(p, 2_000_000_001)  # sparse: takes no room on the disk
    digest = hashlib.sha256()
    for _ in range(2000):
        digest.update(bytes(1_000_000))
    digest.update(b"\0")
    got = files.fingerprints(spark, paths).collect()
    assert [(r["bytes"], r["fingerprint"]) for r in got] == [(2_000_000_001, digest.hexdigest()[:16])] * 2


def test_export_and_load_again(spark, contacts):
    path = scratch_path(spark, "round")
    export.write_csv(contacts, path)
    again = files.load_csv(spark, f"{path}/*.csv", typed=False).drop("_row_id", "_source_file")
    want = tables.null_tokens(export.neutralize_formulas(contacts)).drop("_row_id")
    assert again.exceptAll(want).isEmpty() and want.exceptAll(again).isEmpty()


def test_log_file(spark, contacts):
    from dqspark.operators.clean import CleaningOptions, clean

    _, log = clean(contacts.limit(5), CleaningOptions(trim_whitespace=True))
    path = scratch_path(spark, "log")
    export.write_log(log.to_df(spark), path)
    back = spark.read.options(header=True).csv(path)
    assert back.where(F.col("item") == "Standardized").first()["value"] == "whitespace"


def test_headers_that_differ_by_case_and_names_with_pattern_characters(spark, tmp_path):
    assert files.header_names("Name,name,NAME.1") == ["Name", "name.1", "NAME.1.1"]
    (tmp_path / "a[1].csv").write_text("Name,name\nx,y\n")
    (tmp_path / "a{2}.csv").write_text("Name,name\nv,w\n")
    df = files.load_csv(spark, f"{tmp_path}/a*.csv", typed=False)
    assert {(r["Name"], r["name.1"]) for r in df.collect()} == {("x", "y"), ("v", "w")}
    assert {r["_source_file"] for r in df.collect()} == {"a[1].csv", "a{2}.csv"}


def test_ten_thousand_equal_names_are_numbered_in_one_pass():
    labels = files.unique_labels(["data.csv"] * 10_000)
    assert labels[0] == "data.csv" and labels[-1] == "data (10000).csv" and len(set(labels)) == 10_000


def test_many_files_are_looked_up_by_broadcast(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(0, 100, 1, 4).write.parquet(path)
    listed = files._listing(spark.read.parquet(path)) + [f"file:/no/part-{i}.parquet" for i in range(200_000)]
    df = files._with_file_ids(spark.read.parquet(path), listed)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert df.select("_row_id").distinct().count() == 100


def test_release_deletes_what_the_run_wrote(spark):
    import os

    from dqspark import session

    kept = session._RUN
    session._RUN = "of-a-test"
    try:
        session.settle(spark.range(3), "x")
        folder = session.scratch_dir(spark).removeprefix("file:")
        assert os.path.isdir(folder) and session.release(spark) and not os.path.exists(folder)
    finally:
        session._RUN = kept
