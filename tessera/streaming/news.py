"""Structured Streaming over article tables: seen keys as state, windows with late data, batches written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import articles, text, urls


def keyed(rows: DataFrame) -> DataFrame:
    """rows (url, title, body, published) with the three keys by which an article is known: address, text and openings. Rows without an address have none of that kind."""
    return rows.withColumns({"url_key": text.missing(urls.canonical(F.col("url"))), "exact_key": text.exact_hash(F.col("title"), F.col("body")), "near_key": text.near_key(F.col("title"), F.col("body"))})


def first_seen(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Of rows of one key the first to come, within the time that the watermark allows: first by address, then by text.

    State holds keys no older than the watermark, so it doesn't grow for ever. Rows without
    an address are told apart by their text alone.
    """
    k = keyed(rows).withColumn("any_key", F.coalesce("url_key", "exact_key")).withWatermark("published", late)
    return k.dropDuplicatesWithinWatermark(["any_key"]).dropDuplicatesWithinWatermark(["exact_key"])


def daily_counts(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, source, n_articles) per day; rows that come later than the watermark are left out."""
    return rows.withWatermark("published", late).groupBy(F.window("published", "1 day"), "source").agg(F.count("*").alias("n_articles")).select(F.col("window.start").alias("day"), "source", "n_articles")


def recent(rows: DataFrame, now, hours: float) -> DataFrame:
    """Rows published in the last hours before now, both ends included."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("published")
    return rows.where((age >= 0) & (age <= hours * 3600))


def index_batches(rows: DataFrame, folder: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] | None = None, least_chars: int = 120) -> StreamingQuery:
    """Runs through what is there: every batch is normalised, rejects are put aside with their reason, the rest is written under its batch's number.

    A batch that is tried again overwrites its own folder, so each row is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        parts = articles.title_and_body(F.col("body"), F.col("title"))
        b = batch.withColumn("_p", parts).withColumns({"title": F.col("_p.title"), "body": F.col("_p.body")}).drop("_p")
        b = b.withColumn("reason", articles.drop_reason(F.col("body"), F.array().cast("array<string>"), None, least_chars))
        kept, gone = b.where("reason = 'ok'").drop("reason"), b.where("reason <> 'ok'")
        (enrich(kept) if enrich else kept).write.mode("overwrite").parquet(f"{folder}/articles/batch={number}")
        gone.write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
