"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session's time zone to UTC, so that texts and timestamps compare alike everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session, for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dqspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def scratch_dir(spark: SparkSession) -> str:
    """This run's folder for intermediate tables, below the shared ``spark.checkpoint.dir``.

    Executors may be lost, so anything that must not be recomputed lives here.
    Only a local session gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share.")
        base = tempfile.mkdtemp(prefix="dqspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/dqspark-{_RUN}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> bool:
    """Delete what this run has written to the shared folder; tables read from it end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the scratch folder and read it back.

    The result has no lineage to recompute and known file sizes, so the planner
    can choose joins by its true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
