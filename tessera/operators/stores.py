"""Stores of rows as tables: keyed upserts, versions, links, rejects, windows and runs, each a new table out of the old one and what came in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filings as ff

c = F.col


def keyed_upsert(stored: DataFrame, incoming: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Both with ``row_id``, the hash of the key; of rows of one id the incoming ones win, the last by ordinal. Columns that one side lacks are null."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("row_id", ff.row_id(*[c(k) for k in key]))
    w = Window.partitionBy("row_id").orderBy(F.desc("_new"), F.desc(ordinal))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def next_versions(stored: DataFrame, incoming: DataFrame, key: str, mark: str, order: str) -> DataFrame:
    """Versions (key, version, mark) to append: those of incoming whose mark differs from the one before, numbered on from the last stored."""
    last = stored.groupBy(key).agg(F.max("version").alias("_last"), F.max_by(mark, "version").alias("_mark"))
    w = Window.partitionBy(key).orderBy(order)
    i = incoming.join(last, key, "left").withColumn("_before", F.coalesce(F.lag(mark).over(w), c("_mark")))
    new = i.where(~c(mark).eqNullSafe(c("_before")))
    return new.withColumn("version", F.coalesce("_last", F.lit(0)) + F.row_number().over(w)).drop("_last", "_mark", "_before")


def discovered(incoming: DataFrame, stored: DataFrame, url: str, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(new documents, counts by group): the first of each address in the batch that isn't stored; counts of discovered, repeated, known and new."""
    w = Window.partitionBy(url).orderBy(order)
    i = incoming.withColumn("_rn", F.row_number().over(w)).join(stored.select(url).distinct().withColumn("_known", F.lit(True)), url, "left")
    state = F.when(c("_rn") > 1, "repeated").when(c("_known"), "known").otherwise("new")
    i = i.withColumn("_state", state)
    counts = i.groupBy(group).agg(F.count("*").alias("discovered"), *[F.count_if(c("_state") == s).alias(s) for s in ("repeated", "known", "new")])
    return i.where("_state = 'new'").drop("_rn", "_known", "_state"), counts


def existing(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """incoming with ``existing_id`` and ``matched_by``: the least id of stored rows that agree on the first of the keys that matches; empty keys match nothing."""
    out = incoming
    for k in keys:
        s = stored.where(F.coalesce(c(k), F.lit("")) != "").groupBy(c(k).alias(f"_{k}")).agg(F.min("id").alias(f"_id_{k}"))
        out = out.join(s, c(k) == c(f"_{k}"), "left")
    hit = F.coalesce(*[c(f"_id_{k}") for k in keys])
    by = F.lit(None).cast("string")
    for k in reversed(keys):
        by = F.when(c(f"_id_{k}").isNotNull(), k).otherwise(by)
    return out.withColumns({"existing_id": hit, "matched_by": by}).drop(*[f"_{k}" for k in keys], *[f"_id_{k}" for k in keys])


def split_rejects(items: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept items, rejected items with their reason)."""
    r = items.withColumn("reason", reason)
    return r.where(c("reason").isNull()).drop("reason"), r.where(c("reason").isNotNull())


def pending_windows(windows: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """Windows that no completed record of the same run covers."""
    return windows.join(done.where("status = 'completed'").select(*by).distinct(), by, "left_anti")


def recorded_windows(stored: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """The last record of every window: what comes in replaces what is stored."""
    return keyed_upsert(stored, incoming, by, "recorded_at").drop("row_id")


def merged_preferring(existing_rows: DataFrame, more: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Both united; of rows of one key the best by rank, the existing one among equals."""
    both = existing_rows.withColumn("_more", F.lit(0)).unionByName(more.withColumn("_more", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(rank.desc(), "_more"))).where("_rn = 1").drop("_rn", "_more")


def first_of_key(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by ordinal; a column is as good as any."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("_rn = 1").drop("_rn")


def regrouped(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_parts, text): an article's distinct parts in order of their place, put together."""
    parts = chunks.withColumn("_h", F.sha1(F.lower(F.trim("text")))).groupBy(key, "_h").agg(F.min(F.struct("place", "text")).alias("p"))
    every = F.sort_array(F.collect_list("p"))
    return parts.groupBy(key).agg(F.count("*").alias("n_parts"), F.array_join(F.transform(every, lambda p: p["text"]), "\n").alias("text"))
