"""Session construction, table access and shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, however the driver found it. A cluster
    whose machines do not share that path needs the package installed or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOST_SPREAD = 1 << 30  # bytes of a scan that spread() shuffles at most


def spread(df: DataFrame) -> DataFrame:
    """A scan of at most MOST_SPREAD bytes and of fewer partitions than cores dealt out to all cores; a larger one is left
    alone, however many cores there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= MOST_SPREAD and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset (tests), a local one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    fallback = spark.conf.get("evidloom.local.shared", None)
    if not fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        fallback = tempfile.mkdtemp(prefix="evidloom-")
        atexit.register(shutil.rmtree, fallback, ignore_errors=True)
        spark.conf.set("evidloom.local.shared", fallback)
    return "file://" + os.path.abspath(fallback)


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evidloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in shared storage, which clear() removes."""
    return f"{_own(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to shared storage and read it back: cuts the lineage and survives lost executors. clear() removes
    it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application has materialized; frames that still read it are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
