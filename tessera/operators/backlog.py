"""Documents and runs: latest run, gaps, backlog, taxonomy, snapshots and incremental sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by order; a window, as whole rows are wanted."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def age_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 7, "0-7d").when(days <= 30, "8-30d").when(days <= 90, "31-90d").when(days <= 365, "91-365d").otherwise(">365d")


#: Target days between reports and their tolerance, by kind of period.
PERIOD_TARGETS = {"Q": (92, 45), "H": (183, 70), "A": (365, 120)}


def period_gaps(rows: DataFrame, kind: str) -> DataFrame:
    """(key, previous, period, gap_days) where the gap to the previous period is over target plus tolerance."""
    target, slack = PERIOD_TARGETS[kind]
    w = Window.partitionBy("key").orderBy("period")
    g = rows.select("key", "period").distinct().withColumn("previous", F.lag("period").over(w))
    return g.withColumn("gap_days", F.datediff("period", "previous").cast("long")).where(F.col("gap_days") > target + slack)


# Classes of failed extractions and the words that tell them, in the order in which they are tried.
FAILURES = {
    "ocr_or_text_unavailable": ("empty text", "no text", "text unavailable", "ocr", "unable to extract text", "could not extract text"),
    "parser_timeout": ("timeout", "timed out", "deadline exceeded", "took too long"),
    "llm_invalid_json": ("invalid json", "jsondecodeerror", "expecting value", "malformed json", "could not parse json", "json parse"),
    "provider_network": ("connection", "connecterror", "network", "name resolution", "dns", "refused", "temporarily unavailable", "httpx", "ssl"),
    "corrupted_pdf": ("not a pdf", "corrupt", "trailer not found", "eof marker", "pdfsyntaxerror", "cannot open pdf", "invalid pdf"),
}


def failure_class(message: Column, details: Column | None = None) -> Column:
    """The first class of which the message, or where that's empty the details, hold a word; else unknown."""
    m = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    if details is not None:
        m = F.when(m == "", F.lower(F.coalesce(details, F.lit("")))).otherwise(m)
    out = F.lit("unknown")
    for name, words in reversed(FAILURES.items()):
        out = F.when(m.rlike("|".join(words)), name).otherwise(out)
    return out


def samples_per_class(rows: DataFrame, by: str, order: str, most: int = 3) -> DataFrame:
    """Counts per class and the first few ids of each; a top-k per class, kept by rank before anything is gathered."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rn") <= most)
    some = ranked.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x.cast("string")), ",").alias("samples"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(some, by)


def new_since(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return now.join(before.select(key), key, "left_anti")


def sync_states(stored: DataFrame, current: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, state): added, removed, changed or unchanged by comparing marks of both sides."""
    s, c = stored.select(key, F.col(mark).alias("_s"), F.lit(1).alias("_in_s")), current.select(key, F.col(mark).alias("_c"), F.lit(1).alias("_in_c"))
    state = F.when(F.col("_in_s").isNull(), "added").when(F.col("_in_c").isNull(), "removed").when(F.col("_s").eqNullSafe(F.col("_c")), "unchanged").otherwise("changed")
    return s.join(c, key, "full_outer").select(key, state.alias("state"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Both united, one row of each key: the first by order, of which incoming has ``_new`` true."""
    both = stored.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn", "_new")


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of parents that come again are replaced as a whole."""
    return stored.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def regression_gate(baseline: DataFrame, current: DataFrame, slack: int = 1) -> DataFrame:
    """(case_id, verdict) per case of either side: ranks may worsen by the slack, hits may not be lost."""
    b, c = baseline.select("case_id", F.col("rank").alias("b"), F.lit(1).alias("in_b")), current.select("case_id", F.col("rank").alias("c"), F.lit(1).alias("in_c"))
    verdict = F.when(F.col("in_b").isNull(), "new").when(F.col("in_c").isNull(), "gone").when(F.col("b").isNotNull() & F.col("c").isNull(), "lost").when(F.col("c") > F.col("b") + slack, "worse").when(F.col("b").isNull() & F.col("c").isNotNull(), "gained").otherwise("kept")
    return b.join(c, "case_id", "full_outer").select("case_id", F.col("b").alias("baseline_rank"), F.col("c").alias("current_rank"), verdict.alias("verdict"))
