"""News from provider items to stored articles, one window or micro-batch at a time, and days counted again when late rows come.

Whatever a window changes (articles, their keys, versions, links, rejects, failures, its
record and its run's counts) is one commit of a store under the window's token, so a retry
or a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import articles, text, urls
from ..operators import linking, stores
from ..session import written
from ..sources.store import Commit, Store, bucket

c = F.col

# Reasons that are counted even where nothing failed.
BUCKETS = ("provider_fetch_error", "provider_empty_response", "provider_parse_error", "missing_identity", "missing_published_at", "invalid_published_at", "entity_link_filtered", "duplicate_url", "duplicate_exact", "duplicate_near")
KINDS = ("url", "exact", "near")
ITEM = ("id", "title", "description", "body", "url", "published", "source")


def parsed(items: DataFrame, provider: str) -> DataFrame:
    """items (of ``ITEM``, fetched_at) with ``ord``, the candidate's fields, its keys and ``reject_reason``; ord follows time, id and address."""
    p = items.withColumn("p", articles.candidate(provider, {k: c(k) for k in ITEM}, c("fetched_at"))).select("id", "url", "fetched_at", "p.*")
    p = p.withColumns({"_t": text.normalize_text(c("title")), "_b": text.normalize_text(c("body"))})
    p = p.withColumns({
        "url_key": F.nullif("canonical_url", F.lit("")), "exact_key": text.exact_of(c("_t"), c("_b")), "near_key": text.near_of(c("_t"), c("_b")),
        "ord": F.concat_ws("|", F.coalesce("published_at", F.lit("")), F.coalesce("provider_item_id", "id", F.lit("")), F.coalesce("url", F.lit(""))),
    })
    return p.drop("_t", "_b").withColumn("own_id", F.sha1(F.concat_ws("|", F.lit(provider), "provider_item_id")))


def resolved(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """rows (ord, own_id, url_key, exact_key, near_key) with ``article_id`` and ``reason``.

    A row is the stored article that has one of its keys, address before text before
    openings; else, by the same order, the first row of the window that has it and is none
    itself; else an article of its own. keys: kind, value, article_id of what is stored.
    """
    out = rows.select("ord", "own_id", *[c(f"{k}_key").alias(k) for k in KINDS])
    for k in KINDS:
        if keys is None:
            out = out.withColumn(f"s_{k}", F.lit(None).cast("string"))
        else:
            held = keys.where(c("kind") == k).groupBy(c("value").alias(k)).agg(F.min("article_id").alias(f"s_{k}"))
            out = out.join(held, k, "left")
    stored = F.coalesce(*[c(f"s_{k}") for k in KINDS])
    by = F.coalesce(*[F.when(c(f"s_{k}").isNotNull(), F.lit(f"duplicate_{k}")) for k in KINDS])
    out = written(out.select("ord", "own_id", *KINDS, stored.alias("stored"), by.alias("reason")), "resolved").withColumn("to", F.lit(None).cast("string"))
    for k in KINDS:
        alive = out.where(c("stored").isNull() & c("to").isNull() & c(k).isNotNull())
        first = alive.groupBy(k).agg(F.min("ord").alias("first"))
        out = out.join(first, k, "left").withColumn("to", F.when(c("stored").isNull() & c("to").isNull() & (c("ord") > c("first")), c("first")).otherwise(c("to")))
        out = out.withColumn("reason", F.coalesce("reason", F.when(c("to").isNotNull(), f"duplicate_{k}"))).drop("first")
    out = written(out.select("ord", "own_id", "stored", "to", "reason"), "resolved")
    for _ in range(len(KINDS) - 1):  # the first of one kind may have gone to the first of a later one
        hop = out.select(c("ord").alias("to"), c("to").alias("_next"))
        out = out.join(hop, "to", "left").withColumn("to", F.coalesce("_next", "to")).drop("_next")
    owner = out.select(c("ord").alias("to"), c("own_id").alias("_owner"))
    out = out.join(owner, "to", "left")
    return out.select("ord", F.coalesce("stored", "_owner", "own_id").alias("article_id"), "reason")


def _best(rows: DataFrame, size: Column, *more: str) -> DataFrame:
    """An article's row: the better provider's, then the longer body, then the later fetch; seen first at the least time."""
    w = Window.partitionBy("article_id")
    best = F.row_number().over(w.orderBy(F.desc("provider_rank"), size.desc(), F.desc("fetched_at"), *more, "ord"))
    r = rows.withColumns({"_n": best, "first_published": F.min("first_published").over(w), "n_seen": F.sum("n_seen").over(w)})
    return r.where("_n = 1").drop("_n")


def _survivors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of each article's rows the best; stored ones come before new ones as good."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _best(both, F.length("body"), "_new").drop("_new")


def sampled(failures: DataFrame, most: int = 5) -> DataFrame:
    """(reason, n, samples) of failures (reason, ref): a few of each, the least by ref; reasons of ``BUCKETS`` are there with none as well.

    The least of each task's share are chosen first, as a reason may hold most rows.
    """
    some = failures.withColumn("_task", F.pmod(F.xxhash64("ref"), F.lit(64)))
    for by in (["reason", "_task"], ["reason"]):
        some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("ref"))).where(c("_n") <= most)
    picked = some.groupBy("reason").agg(F.array_sort(F.collect_list("ref")).alias("samples"))
    counts = failures.groupBy("reason").agg(F.count("*").alias("n"))
    every = failures.sparkSession.createDataFrame([(b,) for b in BUCKETS], "reason string")
    joined = every.join(counts, "reason", "full_outer").join(picked, "reason", "left")
    return joined.select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def ingest_window(store: Store, items: DataFrame, provider: str, window: tuple[str, str], run_id: str, names: DataFrame, tickers: DataFrame, rank: int = 0, precise: bool = False, enrich: Callable[[DataFrame], DataFrame] | None = None, token: str | None = None, of: int = 64) -> bool:
    """One window of a provider from items to committed tables; False if it was done before.

    items: the columns of ``ITEM`` and fetched_at. Rejected ones are put aside with their
    reason; the others become articles or new versions of articles that share an address,
    a text or openings with them; links of an article are made anew from what it says now.
    With ``precise`` articles without a precise link are counted as filtered. An empty
    window is recorded as such. The window's record and the run's counts tell how many
    items were fetched, inserted, known and rejected.
    """
    commit = store.begin(token or f"{run_id}|{provider}|{window[0]}|{window[1]}")
    if commit is None:
        return False
    mark = F.xxhash64("title", "body")  # tells texts of one ord apart
    whole = parsed(items, provider)
    p = written(whole.withColumns({"mark": mark, "n_body": F.length("body")}).drop("title", "body"), "window")  # texts are read again where they are needed, not written twice
    rejects, good = p.where("reject_reason is not null"), p.where("reject_reason is null")
    known = store.read("article_keys")
    at = written(resolved(good, known), "window")
    thin = good.join(at, "ord").dropDuplicates(["ord"])
    rows = thin.withColumns({"provider": F.lit(provider), "provider_rank": F.lit(rank), "first_published": c("published_at"), "n_seen": F.lit(1).cast("long")})
    rows = rows if enrich else _best(rows, c("n_body"))  # before texts are carried along; what enriches may change them
    texts = whole.where("reject_reason is null").select("ord", mark.alias("mark"), "title", "body")
    rows = rows.join(texts, ["ord", "mark"]).dropDuplicates(["ord", "mark"])
    fresh = rows.select("article_id", "ord", "provider_item_id", "canonical_url", "title", "body", "source_name", "provider", "provider_rank", "fetched_at", "first_published", "published_at", "exact_key", "n_seen")
    fresh = enrich(fresh) if enrich else fresh
    commit.change("articles", fresh, bucket("article_id", of=of), _survivors)
    keys = thin.select("article_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c(f"{k}_key").alias("value")) for k in KINDS])).alias("k")).select("k.kind", "k.value", "article_id").where("value is not null").distinct()
    commit.merge("article_keys", keys, bucket("kind", "value", of=of), ["kind", "value"], "article_id", ("article_id",))
    versions = thin.select("article_id", "exact_key", "ord", F.lit(0).alias("version"))
    commit.change("versions", versions, bucket("article_id", of=of), lambda old, new: old.unionByName(stores.next_versions(old, new.drop("version"), "article_id", "exact_key", "ord").select(*old.columns)))
    touched = thin.select("article_id").distinct()
    now = _touched(commit, "articles", touched)
    said = now.select("article_id", F.concat_ws("\n", "title", "body").alias("text"))
    numbered = said.withColumn("number", F.xxhash64("article_id"))
    found = linking.links(numbered.select(c("number").alias("article_id"), "text"), names, tickers)
    linked = found.withColumnRenamed("article_id", "number").join(numbered.select("number", "article_id"), "number").select("article_id", "ticker", "method", "span_start", "span_end", "precise", "broad").distinct()
    linked = written(touched.join(linked, "article_id", "left"), "links")
    commit.change("links", linked, bucket("article_id", of=of), lambda old, new: old.join(new.select("article_id").distinct(), "article_id", "left_anti").unionByName(new.where("ticker is not null")))
    commit.append("rejects", rejects.select(F.lit(run_id).alias("run_id"), F.lit(provider).alias("provider"), c("id").alias("provider_item_id"), "url", c("reject_reason").alias("reason"), F.lit(window[0]).alias("window_start")), c("window_start"))
    missed = linked.groupBy("article_id").agg(F.count("precise").alias("n")).where("n = 0").select(F.lit("entity_link_filtered").alias("reason"), c("article_id").alias("ref"))
    failures = rejects.select(c("reject_reason").alias("reason"), F.coalesce("id", "url", F.lit("")).alias("ref")).unionByName(at.where("reason is not null").select("reason", c("ord").alias("ref")))
    failures = failures.unionByName(missed) if precise else failures
    fetched, rejected = p.count(), rejects.count()
    new = at.where("reason is null").count()
    if not fetched:
        failures = failures.unionByName(store.spark.createDataFrame([("provider_empty_response", window[0])], "reason string, ref string"))
    commit.append("failures", sampled(failures).withColumns({"provider": F.lit(provider), "window_start": F.lit(window[0])}), c("window_start"))
    figures = {"fetched": fetched, "inserted": new, "deduped": fetched - rejected - new, "rejected": rejected}
    one = store.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(provider).alias("provider"), F.lit(window[0]).alias("window_start"), F.lit(window[1]).alias("window_end"), F.lit("completed").alias("status"), *[F.lit(v).cast("long").alias(k) for k, v in figures.items()])
    commit.merge("windows", one, c("provider"), ["run_id", "provider", "window_start", "window_end"], "status")
    summed = lambda old, more: old.unionByName(more).groupBy("run_id").agg(*[F.sum(k).alias(k) for k in figures])
    commit.change("runs", one.select("run_id", *figures), c("run_id"), summed)
    commit.finish()
    return True


def _touched(commit: Commit, table: str, keys: DataFrame) -> DataFrame:
    """The rows of a table, as the commit has it by now, of some articles."""
    return commit.store._rows(commit.new[table], None).join(keys, "article_id", "left_semi")


def seen_first(rows: DataFrame, hours: float = 24 * 30, late: str = "2 days") -> DataFrame:
    """(ord, kind, first) for each of the three keys of every row (ord, at, url_key, exact_key, near_key): the row that had the key first, itself or another.

    A stream; each key is state of its own, which expires once the watermark is some hours
    past the last row that had it. A batch's answers of one row are put together by ``verdicts``.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c(f"{k}_key").alias("value")) for k in KINDS])
    keyed = rows.withWatermark("at", late).select("ord", "at", F.explode(pairs).alias("k")).select("ord", "at", "k.kind", "k.value").where("value is not null")

    def remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(parts))
        held = state.get[0] if state.exists else found["ord"].min()
        state.update((held,))
        last = int(found["at"].max().timestamp() * 1000 + hours * 3_600_000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ord": found["ord"], "kind": key[0], "first": held})

    return keyed.groupBy("kind", "value").applyInPandasWithState(remember, "ord string, kind string, first string", "first string", "update", GroupStateTimeout.EventTimeTimeout)


def verdicts(seen: DataFrame) -> DataFrame:
    """(ord, reason, first): by address, else text, else openings, if another row had that key first; else null."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), c("kind"))
    hit = F.when(c("first") != c("ord"), F.struct(place.alias("place"), "kind", "first"))
    best = seen.groupBy("ord").agg(F.min(hit).alias("b"))
    return best.select("ord", F.concat(F.lit("duplicate_"), "b.kind").alias("reason"), "b.first")


def index_stream(store: Store, rows: DataFrame, checkpoint: str, provider: str, names: DataFrame, tickers: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs through what is there, a micro-batch as a window: normalised, freed of repeats, enriched and committed under its number."""

    def write(batch: DataFrame, number: int) -> None:
        ingest_window(store, batch, provider, (f"batch-{number:09d}", ""), "stream", names, tickers, enrich=enrich, token=f"stream|{checkpoint}|{number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _days(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy("day", *by).agg(F.count("*").alias("n_rows"))


def flow_days(store: Store, rows: DataFrame, checkpoint: str, time: str, by: list[str]) -> StreamingQuery:
    """A stream into ``items`` and ``daily`` (day, by, n_rows), both by day.

    Rows of a day that is closed are kept but not counted: they go to ``items`` and their
    day is marked open in ``days``, for ``rerun_open`` to count again. Each batch is one commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        commit = store.begin(f"days|{checkpoint}|{number}")
        if commit is None:
            return
        b = written(batch.withColumn("day", F.to_date(time)), "days")
        commit.append("items", b, c("day"))
        days = store.read("days")
        closed = (days.where("status <> 'running'") if days is not None else store.spark.createDataFrame([], "day date, status string")).select("day")
        in_time, late = b.join(closed, "day", "left_anti"), b.join(closed, "day", "left_semi")
        add = lambda old, new: old.unionByName(new).groupBy("day", *by).agg(F.sum("n_rows").alias("n_rows"))
        commit.change("daily", _days(in_time, by), c("day"), add)
        seen = in_time.select("day", F.lit("running").alias("status")).unionByName(late.select("day", F.lit("open").alias("status"))).distinct()
        commit.merge("days", seen, F.trunc("day", "month"), ["day"], "status")
        commit.finish()

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _mark(store: Store, commit: Commit, days: DataFrame) -> None:
    commit.merge("days", days.select("day", F.lit("closed").alias("status")), F.trunc("day", "month"), ["day"], "status")


def close_days(store: Store, before: str) -> None:
    """Closes the running days before a day: what comes for them later is late."""
    commit = store.begin(f"close|{before}")
    if commit is not None:
        _mark(store, commit, store.read("days").where((c("status") == "running") & (c("day") < F.lit(before).cast("date"))))
        commit.finish()


def rerun_open(store: Store, by: list[str]) -> list[str]:
    """Counts the open days again from their items and closes them; no other day is read or written. Which days."""
    days = store.read("days").where("status = 'open'")
    again = sorted(str(r.day) for r in days.collect())  # a row a day
    if again:
        commit = store.begin(f"rerun|{len(store._commits())}")
        commit.replace("daily", _days(store.read("items", again), by), c("day"), again)
        _mark(store, commit, days)
        commit.finish()
    return again
