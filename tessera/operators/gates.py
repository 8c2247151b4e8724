"""Gates of reports of actions, summaries of retrieval against a baseline, headline coverage of two corpora, and texts out of what models return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

#: By action: the reason that holds it back and when, over columns of its report; absent figures are zero.
RULES = {
    "update_ticker_financials": {"after.rows is 0": "after_rows <= 0"},
    "daily_marketindex": {
        "download report missing for quality gate": "not skip_download and not report_found", "download quality_gate.passed is false": "not skip_download and report_found and not gate_passed",
        "downloads are below the minimum": "not skip_download and report_found and downloaded < greatest(1, min_download)",
    },
    "asx_enrichment_sweep": {"totals.days_completed is 0": "days_completed <= 0", "totals.errors": "errors > 0"},
    "daily_asx_marketwide": {"no discovery/insert/process delta observed": "found <= 0 and inserted <= 0 and processed <= 0", "discovery request failures with zero inserts": "request_fail > 0 and inserted = 0"},
    "full_history": {"no backfill delta observed": "found <= 0 and inserted <= 0 and processed <= 0"},
    "rebuild_ticker_financials": {"selected_count is 0": "selected <= 0", "processed_count is 0": "selected > 0 and processed <= 0"},
    "resume_pending": {"totals.errors": "errors > 0"},
    "recover_headed": {"selected_total is 0": "selected <= 0", "recovered is 0 with failures present": "recovered <= 0 and failed > 0"},
}
FIGURES = ("after_rows", "downloaded", "min_download", "days_completed", "errors", "found", "inserted", "processed", "request_fail", "selected", "recovered", "failed")
SWITCHES = ("skip_download", "report_found", "gate_passed")


def action_gate(reports: DataFrame) -> DataFrame:
    """reports (action_id, status, ``FIGURES``, ``SWITCHES``) with ``reasons`` and ``passed``: no status but success, and nothing of the action's rules."""
    r = reports.withColumns({f: F.coalesce(c(f), F.lit(1 if f == "min_download" else 0)) for f in FIGURES} | {s: F.coalesce(c(s), F.lit(False)) for s in SWITCHES})
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    found = [F.when((status != "") & (status != "success"), F.concat(F.lit("report status is '"), status, F.lit("'")))]
    found += [F.when((c("action_id") == action) & F.expr(test), reason) for action, rules in RULES.items() for reason, test in rules.items()]
    return r.withColumn("reasons", F.array_compact(F.array(*found))).withColumn("passed", F.size("reasons") == 0)


def suite_summary(cases: DataFrame) -> DataFrame:
    """(suite, scored, hits, hit_rate, mrr) of cases (suite, case_id, rank); a null rank is no hit."""
    return cases.groupBy("suite").agg(F.count("*").alias("scored"), F.count("rank").alias("hits"), (F.count("rank") / F.count("*")).alias("hit_rate"), F.avg(F.coalesce(1 / c("rank"), F.lit(0.0))).alias("mrr"))


def suite_gate(baseline: DataFrame, current: DataFrame, mrr_tolerance: float = 0.02) -> DataFrame:
    """(suite, failures, passed): every case of a suite hits, and neither its hit rate nor, beyond the tolerance, its mean reciprocal rank is below the baseline's."""
    b = suite_summary(baseline).select("suite", c("hit_rate").alias("_rate"), c("mrr").alias("_mrr"))
    r = suite_summary(current).join(b, "suite", "left")
    failures = F.array_compact(F.array(F.when(c("hits") != c("scored"), "hits_scored_mismatch"), F.when(c("hit_rate") + 1e-12 < c("_rate"), "hit_rate_regressed"), F.when(c("mrr") + mrr_tolerance + 1e-12 < c("_mrr"), "mrr_regressed")))
    return r.withColumn("failures", failures).select("suite", "failures", (F.size("failures") == 0).alias("passed"))


def headline_metrics(identified: DataFrame, universe: DataFrame, sure: tuple[str, ...] = ("strong", "medium")) -> DataFrame:
    """(corpus, n_chunks, sure_pct, tickers_zero_hits) of identified rows (corpus, chunk_id, ticker, strength): chunks that are surely about a ticker, and tickers of the universe (ticker) that none is."""
    hit = c("strength").isin(*sure)
    chunks = identified.groupBy("corpus", "chunk_id").agg(F.max(hit).alias("hit")).groupBy("corpus").agg(F.count("*").alias("n_chunks"), F.count_if("hit").alias("_hits"))
    found = identified.where(hit).select("corpus", "ticker").distinct().join(universe.select("ticker").distinct(), "ticker", "left_semi").groupBy("corpus").agg(F.count("*").alias("_found"))
    # one row joined to a row a corpus
    size = universe.agg(F.countDistinct("ticker").alias("_all"))
    r = chunks.join(found, "corpus", "left").crossJoin(F.broadcast(size))
    return r.select("corpus", "n_chunks", F.round(c("_hits") * 100.0 / c("n_chunks"), 4).alias("sure_pct"), (c("_all") - F.coalesce("_found", F.lit(0))).alias("tickers_zero_hits"))


def _bare(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def one_text(value: Column) -> Column:
    """A text trimmed, or the filled ones of a JSON list of texts by lines; null for none."""
    t = _bare(value)
    listed = F.from_json(F.when(t.startswith("["), t), "array<string>")
    filled = F.filter(F.transform(listed, _bare), lambda x: x != "")
    return F.nullif(F.when(listed.isNotNull(), F.array_join(filled, "\n")).otherwise(t), F.lit(""))


def bullets(value: Column) -> Column:
    """A text as a list: of a JSON list its filled items, else its parts between semicolons and line breaks where there are two or more, else itself; null for none."""
    t = _bare(value)
    listed = F.from_json(F.when(t.startswith("[") & t.endswith("]"), t), "array<string>")
    filled = F.filter(F.transform(listed, _bare), lambda x: x != "")
    parts = F.filter(F.transform(F.split(t, r"[;\n]+"), lambda x: F.btrim(x, F.lit(" -\t"))), lambda x: x != "")
    return F.when(F.coalesce(t, F.lit("")) == "", None).when(listed.isNotNull(), F.when(F.size(filled) > 0, filled)).when(F.size(parts) >= 2, parts).otherwise(F.array(t))
