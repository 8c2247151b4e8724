"""Coverage, health and verification reports over articles, runs, documents and financials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

c = F.col


def pct(part: Column, whole: Column) -> Column:
    """Per cent to four decimals; zero of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 4)).otherwise(0.0)


def per_day(articles: DataFrame) -> DataFrame:
    """(day, provider, articles), newest day first."""
    return articles.groupBy("day", "provider").agg(F.count("*").alias("articles")).orderBy(F.desc("day"), "provider")


def ticker_coverage(links: DataFrame, universe: DataFrame, now, windows: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """(window_days, lane, covered, covered_pct): tickers of the universe with a link published within each window.

    links: ticker, lane, published. Links are cut to the widest window and the universe,
    then each counts for every window that holds it: one partial aggregation.
    """
    total = universe.select("ticker").distinct().agg(F.count("*").alias("total"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("published")) / 86400.0
    some = links.withColumn("age", age).where(c("age") <= max(windows)).join(universe.select("ticker").distinct(), "ticker", "left_semi")
    each = some.select("ticker", "lane", F.explode(F.filter(F.array(*map(F.lit, windows)), lambda w: c("age") <= w)).alias("window_days"))
    g = each.groupBy("window_days", "lane").agg(F.countDistinct("ticker").alias("covered"))
    return g.join(total).select("window_days", "lane", "covered", pct(c("covered"), c("total")).alias("covered_pct"))


def uncovered(links: DataFrame, universe: DataFrame, lanes: tuple[str, ...] = ("high_precision", "high_recall")) -> DataFrame:
    """(ticker, a flag for each lane) of the whole universe, those least covered first."""
    flags = links.groupBy("ticker").agg(*[F.max((c("lane") == x).cast("int")).alias(x) for x in lanes])
    out = universe.select("ticker").distinct().join(flags, "ticker", "left").select("ticker", *[F.coalesce(x, F.lit(0)).alias(f"covered_{x}") for x in lanes])
    return out.orderBy(*[f"covered_{x}" for x in reversed(lanes)], "ticker")


def coverage_summary(links: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: tickers, those with and without an article, the median of articles a ticker (zeros count)."""
    n = links.groupBy("ticker").agg(F.countDistinct("article_id").alias("n"))
    every = universe.select("ticker").distinct().join(n, "ticker", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(F.count("*").alias("tickers_total"), F.count_if(c("n") > 0).alias("tickers_with_hits"), F.count_if(c("n") == 0).alias("tickers_zero_hits"), F.percentile("n", 0.5).alias("median_articles"))


def compared(base: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key with ``<column>_delta`` of every column, missing sides as zero."""
    b, n = base.select(key, *[c(x).alias(f"_b_{x}") for x in columns]), new.select(key, *[c(x).alias(f"_n_{x}") for x in columns])
    return b.join(n, key, "full_outer").select(key, *[(F.coalesce(f"_n_{x}", F.lit(0)) - F.coalesce(f"_b_{x}", F.lit(0))).alias(f"{x}_delta") for x in columns])


def run_counters(increments: DataFrame) -> DataFrame:
    """(run_id, fetched, inserted, deduped, rejected, errors, duplicate_rate_pct): increments of a run summed."""
    names = ("fetched", "inserted", "deduped", "rejected", "errors")
    g = increments.groupBy("run_id").agg(*[F.sum(F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in names])
    return g.withColumn("duplicate_rate_pct", pct(c("deduped"), c("fetched")))


def rejections(items: DataFrame, reasons: tuple[str, ...] = (), samples: int = 5) -> DataFrame:
    """(reason, rejected, samples) with the last few item ids of each reason; reasons that are expected but absent have zero."""
    ranked = items.where(c("reason").isNotNull()).withColumn("_rn", F.row_number().over(Window.partitionBy("reason").orderBy(F.desc("item_id"))))
    some = ranked.where(c("_rn") <= samples).groupBy("reason").agg(F.array_join(F.transform(F.sort_array(F.collect_list("item_id"), False), lambda x: x.cast("string")), ",").alias("samples"))
    counts = items.where(c("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("rejected"))
    out = counts.join(some, "reason")
    if reasons:
        want = F.explode(F.array(*map(F.lit, reasons)))
        out = items.sparkSession.range(1).select(want.alias("reason")).join(out, "reason", "full_outer")
    return out.select("reason", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("samples", F.lit("")).alias("samples"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of every document, by time and then id; of equal ones that of the least status, so that every run of the query gives the same."""
    return runs.withColumn("_rn", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("run_id"), "status"))).where("_rn = 1").drop("_rn")


def structured_coverage(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: documents, those whose last run went well, their share, downloaded ones without a run, last runs that failed."""
    joined = documents.join(latest_runs(runs).select("document_id", F.lower("status").alias("status")), "document_id", "left")
    got = (F.coalesce("pdf_sha256", F.lit("")) != "") & ~F.coalesce("pdf_sha256", F.lit("")).startswith("blocked_")
    s = joined.agg(F.count("*").alias("documents_total"), F.count_if(c("status") == "ok").alias("documents_ok"), F.count_if(got & (F.coalesce("status", F.lit("")) == "")).alias("downloaded_not_extracted"), F.count_if(c("status") == "failed").alias("latest_failed"))
    return s.withColumn("coverage_pct", pct(c("documents_ok"), c("documents_total")))


def failures_of(documents: DataFrame, runs: DataFrame, ticker: str | None = None) -> DataFrame:
    """Failed runs with their document's title and ticker where it's known, newest first."""
    d = documents.select("document_id", "ticker", "title")
    out = runs.where("lower(status) = 'failed'").join(d, "document_id", "left")
    return (out.where(c("ticker") == ticker) if ticker else out).orderBy(F.desc("created_at"), "run_id")


def verification(documents: DataFrame) -> DataFrame:
    """(check, n, samples) of blocked, pending and missing documents by their marks, with the first ten ids."""
    mark = F.coalesce("pdf_sha256", F.lit(""))
    check = F.when(mark.startswith("blocked_"), "blocked_documents").when(mark == "", "pending_downloads").when(~c("on_disk"), "missing_pdf_files")
    d = documents.withColumn("check", check).where(c("check").isNotNull())
    ranked = d.withColumn("_rn", F.row_number().over(Window.partitionBy("check").orderBy("document_id"))).where("_rn <= 10")
    some = ranked.groupBy("check").agg(F.array_join(F.transform(F.sort_array(F.collect_list("document_id")), lambda x: x.cast("string")), ",").alias("samples"))
    return d.groupBy("check").agg(F.count("*").alias("n")).join(some, "check")


def freshness(documents: DataFrame, tickers: DataFrame, now, stale_hours: float = 168.0) -> DataFrame:
    """(ticker, doc_count, age_hours, status) of every ticker: missing without documents, unknown without times, else fresh or stale."""
    g = documents.groupBy("ticker").agg(F.count("*").alias("doc_count"), F.max("published_at").alias("latest"))
    t = tickers.select("ticker").distinct().join(g, "ticker", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("latest")) / 3600.0)
    status = F.when(c("doc_count") == 0, "missing").when(c("latest").isNull(), "unknown").when(age > stale_hours, "stale").otherwise("fresh")
    return t.select("ticker", "doc_count", F.round(F.when(c("latest").isNotNull(), age), 4).alias("age_hours"), status.alias("status"))


def changed_figures(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after, delta) of the figures that differ; a side that's missing gives no delta."""
    b, a = before.select(key, *[c(f).cast("double").alias(f"_b_{f}") for f in fields]), after.select(key, *[c(f).cast("double").alias(f"_a_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c(f"_b_{f}").alias("before"), c(f"_a_{f}").alias("after")) for f in fields])
    out = b.join(a, key, "full_outer").select(key, F.explode(F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x")).select(key, "x.*")
    return out.withColumn("delta", c("after") - c("before"))


def ticker_evidence(articles: DataFrame, providers: tuple[str, ...], since) -> DataFrame:
    """(ticker, n_articles, providers, signals, last_published) of articles (ticker, article_id, provider, signal, published) of some providers since a time."""
    some = articles.where(F.lower("provider").isin(*providers) & (c("published") >= F.lit(since).cast("timestamp")))
    listed = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    return some.groupBy("ticker").agg(F.countDistinct("article_id").alias("n_articles"), listed("provider").alias("providers"), listed("signal").alias("signals"), F.max("published").alias("last_published"))


def metadata_gate(rows: DataFrame, bad: Column, least: int = 20, most_pct: float = 5.0) -> DataFrame:
    """One row: bad rows, their share and whether the gate fails: at least so many and above the share."""
    s = rows.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad"))
    return s.withColumn("bad_pct", pct(c("n_bad"), c("n_rows"))).withColumn("failed", (c("n_bad") >= least) & (c("bad_pct") > most_pct))


def label_scores(rows: DataFrame) -> DataFrame:
    """One row: macro precision, recall, F1 and the rate of exact matches of sets. rows: found, wanted (arrays); those that want nothing are left out."""
    shared = F.size(F.array_intersect("found", "wanted"))
    p, r = F.when(F.size("found") > 0, shared / F.size("found")).otherwise(0.0), shared / F.size("wanted")
    s = rows.where(F.size("wanted") > 0).select(p.alias("p"), r.alias("r"), (F.array_sort(F.array_distinct("found")) == F.array_sort(F.array_distinct("wanted"))).cast("int").alias("same"))
    s = s.withColumn("f", F.when(c("p") + c("r") > 0, 2 * c("p") * c("r") / (c("p") + c("r"))).otherwise(0.0))
    return s.agg(F.count("*").alias("n"), *[F.round(F.avg(x), 6).alias(n) for x, n in (("p", "macro_precision"), ("r", "macro_recall"), ("f", "macro_f1"), ("same", "exact_match_rate"))])


def gold_issues(fields: DataFrame) -> DataFrame:
    """(doc, issue, n): blank values, unknown currencies and repeated (metric, period_end, scope) of gold labels."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    again = F.row_number().over(Window.partitionBy("doc", F.lower(F.trim("metric")), F.trim("period_end"), F.lower(F.trim("scope"))).orderBy("place")) > 1
    f = fields.withColumn("again", again)
    issues = [F.when(blank(k), F.lit(f"blank_{k}")) for k in ("metric", "period_end", "period_type", "currency", "scope")]
    issues += [F.when(blank("currency") | (F.upper(F.trim("currency")) == "UNKNOWN"), F.lit("unknown_currency")), F.when(c("again"), F.lit("duplicate_metric_period_scope"))]
    return f.select("doc", F.explode(F.array_compact(F.array(*issues))).alias("issue")).groupBy("doc", "issue").agg(F.count("*").alias("n"))


def balanced_sample(rows: DataFrame, by: str, order: Column, most: int, most_each: int) -> DataFrame:
    """The first ``most`` rows taken in turn from every group, at most so many of each; within a group by order."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(c("turn") <= most_each)
    return ranked.orderBy("turn", by).limit(most)


def latest_with_forms(files: DataFrame, most: int) -> DataFrame:
    """The ``most`` best files of each ticker by (relevance, day, name), the best annual and half-year one always among them."""
    order = [F.desc("relevance"), F.desc("day"), F.desc("name")]
    one = F.row_number().over(Window.partitionBy("ticker", "form").orderBy(*order)) == 1
    f = files.withColumn("first", one & c("form").isin("annual", "half"))
    turn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.when(c("first") & (c("form") == "annual"), 0).when(c("first"), 1).otherwise(2), *order))
    return f.withColumn("place", turn).where(c("place") <= most).drop("first")


def best_evidence(rows: DataFrame) -> DataFrame:
    """The row of each (metric, period) with most confidence, then a table, a line, the last file and line."""
    w = Window.partitionBy("metric", "period").orderBy(F.desc("conf"), F.desc("confidence"), F.desc((F.coalesce("table_id", F.lit("")) != "").cast("int")), F.desc((c("line_no") > 0).cast("int")), F.desc("file"), F.desc("line_no"))
    return rows.where("metric <> '' and period <> ''").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def risk_states(signals: DataFrame, periods: DataFrame, names: list[str]) -> DataFrame:
    """(company, period, a column for each signal): the worst state, 1 for HIGH and CRITICAL, of every period there is; zero without a signal."""
    state = c("risk_level").isin("HIGH", "CRITICAL").cast("int")
    p = signals.groupBy("company", "period").agg(*[F.max(F.when(c("signal_name") == n, state)).alias(n) for n in names])
    return periods.select("company", "period").distinct().join(p, ["company", "period"], "left").select("company", "period", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def missing_sections(rows: DataFrame) -> DataFrame:
    """(file, period, missing): sections that a statement with a whole income core lacks."""
    s = rows.groupBy("file", "period").agg(F.collect_set("metric").alias("have"))
    has = lambda *m: reduce(lambda a, x: a & F.array_contains("have", x), m, F.lit(True))
    income = has("revenue", "ebit", "net_income")
    balance = has("total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "total_debt")
    cash = has("operating_cash_flow", "capital_expenditure") | has("free_cash_flow")
    gone = F.array_compact(F.array(F.when(income & ~balance, F.lit("balance_sheet")), F.when(income & ~cash, F.lit("cash_flow"))))
    return s.select("file", "period", F.array_join(gone, ",").alias("missing"))


def ambiguous_candidates(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """candidates (file, period, value) less those whose value the file already has, but only for other periods."""
    key = F.round("value", 6).alias("value_key")
    known = canonical.select("file", key, "period").distinct()
    cand = candidates.withColumn("value_key", F.round("value", 6))
    elsewhere = known.select("file", "value_key").distinct()
    here = known.select("file", "value_key", "period")
    bad = cand.join(elsewhere, ["file", "value_key"], "left_semi").join(here, ["file", "value_key", "period"], "left_anti")
    return cand.join(bad.select("file", "value_key", "period").distinct(), ["file", "value_key", "period"], "left_anti").drop("value_key")


def horizon(prices: DataFrame) -> DataFrame:
    """(ticker, points, total_return_pct, max_drawdown_pct, volatility_pct) over each whole series."""
    w = Window.partitionBy("ticker").orderBy("ts")
    peak = F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("close").over(w)
    p = prices.select("ticker", "ts", "close", F.when(peak > 0, (c("close") / peak - 1.0) * 100.0).alias("down"), F.when((before > 0) & (c("close") > 0), F.log(c("close") / before)).alias("r"))
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    return p.groupBy("ticker").agg(
        F.count("*").alias("points"), F.when((F.count("*") >= 2) & (first > 0), (last / first - 1.0) * 100.0).alias("total_return_pct"), F.min("down").alias("max_drawdown_pct"),
        F.when((F.count("*") >= 3) & (F.count("r") >= 2), F.stddev_samp("r") * F.sqrt(F.lit(252.0)) * 100.0).alias("volatility_pct"),
    )


def provider_probe(items: DataFrame) -> DataFrame:
    """(provider, n_items, n_days, n_tickers, rejected, reject_pct) of items (provider, day, ticker, reason)."""
    g = items.groupBy("provider").agg(F.count("*").alias("n_items"), F.countDistinct("day").alias("n_days"), F.countDistinct("ticker").alias("n_tickers"), F.count("reason").alias("rejected"))
    return g.withColumn("reject_pct", pct(c("rejected"), c("n_items")))


def templates(rows: DataFrame, newest: int) -> DataFrame:
    """(ticker, file, metric, period, scope, value): of each ticker's newest files the first row of each (metric, period, scope).

    A ticker's newest files lie on its newest days, so files are ranked of those days alone
    and rows are grouped of the files found; both are few beside the rows.
    """

    def first_of(keys: DataFrame, *order) -> DataFrame:
        return keys.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(*order))).where(c("_n") <= newest).drop("_n")

    days = written(first_of(rows.select("ticker", "day"), F.desc("day")), "days").select(c("ticker").alias("_ticker"), c("day").alias("_day"))
    late = rows.select("ticker", "file", "day").join(days, (c("ticker") == c("_ticker")) & c("day").eqNullSafe(c("_day")), "left_semi")
    f = written(first_of(late, F.desc("day"), F.desc("file")).select("ticker", "file"), "files")
    first = rows.join(f, ["ticker", "file"], "left_semi").groupBy("ticker", "file", "metric", "period", "scope").agg(F.min_by("value", "line_no").alias("value"))
    return first.join(f, ["ticker", "file"])


def label_summary(labels: DataFrame) -> DataFrame:
    """(verdict, metric, n, assisted) of review labels, and the totals of both."""
    return labels.rollup("verdict", "metric").agg(F.count("*").alias("n"), F.count_if("assisted").alias("assisted"))


def eval_baseline(cases: DataFrame, k: int) -> DataFrame:
    """(case_id, rank, hit, reciprocal) of evaluated cases, as later runs are compared with."""
    hit = F.coalesce(c("rank") <= k, F.lit(False))
    return cases.select("case_id", "rank", hit.alias("hit"), F.when(hit, 1.0 / c("rank")).otherwise(0.0).alias("reciprocal"))


def health_gate(sections: DataFrame, allowed: tuple[str, ...] = ("healthy",)) -> DataFrame:
    """One row: the worst status of the sections and whether it is one of the allowed."""
    rank = F.when(c("status") == "healthy", 0).when(c("status") == "degraded", 1).otherwise(2)
    return sections.agg(F.max_by("status", F.struct(rank, "status")).alias("status"), F.count("*").alias("n_sections")).withColumn("passed", c("status").isin(*allowed))
