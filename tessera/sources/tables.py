"""Stored tables read with what they may lack filled in and conditions that reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import as_declared

CHUNKS = "chunk_id string, corpus string, doc_type string, doc_date string, source string, ticker string, topic string, url string, title string, published_at string, bad_metadata_reason string, company string, file string, section string, text string"


def context_rows(spark: SparkSession, path: str, corpus: str = "", doc_type: str = "") -> DataFrame:
    """Chunks of a corpus and kind; columns that an older table lacks are empty. Both conditions are pushed into the scan."""
    raw = spark.read.parquet(path)
    for name, value in (("corpus", corpus), ("doc_type", doc_type)):
        if value and name in raw.columns:
            raw = raw.where(F.col(name) == value)
    return as_declared(raw, CHUNKS, {n.split()[0]: "" for n in CHUNKS.split(", ")})


def derived_rows(spark: SparkSession, path: str, metrics: list[str], least_conf: int = 0) -> DataFrame:
    """Derived figures of some metrics with enough confidence."""
    r = as_declared(spark.read.parquet(path), "company string, period string, metric string, value double, conf int, integrity int, source_file string")
    return r.where(F.col("metric").isin(*metrics) & (F.coalesce("conf", F.lit(0)) >= least_conf))


def integrity_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a (file, period): the last score and level stored."""
    r = as_declared(spark.read.parquet(path), "file string, period string, integrity_score int, anomaly_level string, updated_at timestamp")
    return r.groupBy("file", "period").agg(F.max_by("integrity_score", F.struct(F.coalesce("updated_at", F.lit(0).cast("timestamp")), "integrity_score")).alias("integrity_score"), F.max_by("anomaly_level", F.struct(F.coalesce("updated_at", F.lit(0).cast("timestamp")), "integrity_score")).alias("anomaly_level"))
