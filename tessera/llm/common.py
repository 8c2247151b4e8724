"""Shared helpers: durable intermediate tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts; rows go to Python by the thousand where the session says nothing else, as texts may be long."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DICE = 1 << 63  # numbers that ``dice`` gives lie below it


def dice(*columns) -> F.Column:
    """63 bits of a hash of columns, the same for equal rows."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(DICE - 1))


def below(most: float, count: int) -> int:
    """The number below which ``dice`` falls for about ``most`` of ``count`` rows, all of them if there are no more; never 0, however many there are."""
    return DICE - 1 if most >= count else max(1, int(most / count * DICE))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffled(df: DataFrame) -> DataFrame:
    """df, which joins sort and shuffle whatever its size seems to be: the planner's estimate knows nothing of rows that an explode adds or of packed columns, and what it broadcasts goes through the driver."""
    return df.hint("merge")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it, or else one in the warehouse, which is shared as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


class Workspace:
    """Cuts lineage by writing tables below scratch_root and reading them back.

    What is written stays as long as the driver may read it: it is removed by ``drop``
    or, as Hadoop's own exit hook does, when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def _files(self, target: str, action: str, *more) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        getattr(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), action)(path, *more)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        self.keep()
        return self.spark.read.schema(df.schema).parquet(target)

    def keep(self) -> None:
        """Keeps what is in the folder until the driver ends; takes effect only once the folder exists."""
        self._files(self.path, "deleteOnExit")

    def drop(self, name: str) -> None:
        self._files(f"{self.path}/{name}", "delete", True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (src, dst: long); component is the smallest id reachable.

    Alternates large-star and small-star steps until the edges are a set of stars.
    A hub's edges are joined to its minimum, so AQE can split a hub over tasks; no
    step gathers the neighbours of a node. Self-loops and repeated or null edges are
    ignored; an empty input gives an empty result.
    """
    work = Workspace(edges.sparkSession, "components")
    now = work.save(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "edges-0",
    )
    state = None
    for step in range(1, max_rounds + 1):
        # large star: every larger neighbour of u, and u itself, points at the least neighbour of u
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, point at the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(shuffled(least), large.u == least.k).select("v", "m", "u")
        small = (
            joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = work.save(small, f"edges-{step}")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step > 1:
            work.drop(f"edges-{step - 1}")
        if tuple(after) == state:
            break
        state = tuple(after)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
