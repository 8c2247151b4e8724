"""Session settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build(name: str = "tessera", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution, which merges small partitions and splits skewed ones of joins."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    return b.config(map=conf or {}).getOrCreate()


def local_session(cores: int, conf: dict[str, str] | None = None) -> SparkSession:
    """For tests and timing on one machine."""
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": str(cores)}
    spark = build(master=f"local[{cores}]", conf=quiet | (conf or {}))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def keep_until_exit(spark: SparkSession, folder: str) -> None:
    """Has a folder removed when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows written to the shared folder and read back, so that what is used several times is worked out once and a lost task finds it there."""
    spark = rows.sparkSession
    folder = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    keep_until_exit(spark, folder)
    return spark.read.schema(rows.schema).parquet(folder)


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Has rows of whole texts go to Python by so many at once where the session says nothing else: what a task holds doesn't grow with the table."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(rows))


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Narrow rows dealt by a key over several tasks a core: a split of a compact file holds millions of rows, and there may be fewer splits than cores."""
    tasks = 4 * max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    return rows.repartition(tasks, *key)
