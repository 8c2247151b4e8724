"""Registered queries of reports, contracts and stores: orders are documents, customers tickers, events items and price ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import articles as fa
from ..functions import dates, numeric
from ..functions import filings as ff
from ..operators import contracts, layout, reports, stores
from .common import FACTS_SQL, expected_sql, facts, scenarios, table

c = F.col
NOW = "2024-02-01 00:00:00"


def _links(spark, d):
    e = table(spark, d, "events")
    lane = F.when(c("event_type") == "purchase", "high_precision").otherwise("high_recall")
    return e.select((c("user_id") % 997).alias("ticker"), lane.alias("lane"), c("ts").alias("published"), c("event_id").alias("article_id"))


def _universe(spark, d):
    return table(spark, d, "customer").select((c("c_custkey") % 1200).alias("ticker")).distinct()


_LINKS = "lk as (select user_id % 997 as ticker, case when event_type = 'purchase' then 'high_precision' else 'high_recall' end as lane, ts as published, event_id as article_id from events), un as (select distinct c_custkey % 1200 as ticker from customer)"


def articles_per_day(spark, d):
    e = table(spark, d, "events").select(c("ts").cast("date").alias("day"), c("event_type").alias("provider"))
    return reports.per_day(e)


def ticker_coverage(spark, d):
    return reports.ticker_coverage(_links(spark, d), _universe(spark, d), _end(spark, d))


def _end(spark, d):
    return "2024-02-01 00:00:00"


def uncovered_tickers(spark, d):
    return reports.uncovered(_links(spark, d), _universe(spark, d))


def coverage_summary(spark, d):
    return reports.coverage_summary(_links(spark, d), _universe(spark, d))


def coverage_deltas(spark, d):
    """Articles by lane, the even ids against all."""
    count = lambda l: l.groupBy("lane").agg(F.count("*").alias("articles"), F.countDistinct("ticker").alias("tickers"))
    links = _links(spark, d)
    return reports.compared(count(links.where("article_id % 2 = 0")), count(links), "lane", ["articles", "tickers"])


def run_counters(spark, d):
    e = table(spark, d, "events").select((c("user_id") % 50).alias("run_id"), F.lit(1).alias("fetched"), (c("event_id") % 3 == 0).cast("int").alias("inserted"), (c("event_id") % 3 == 1).cast("int").alias("deduped"), (c("event_id") % 9 == 2).cast("int").alias("rejected"), F.when(c("event_id") % 100 == 0, 1).alias("errors"))
    return reports.run_counters(e)


REASONS = ("missing_identity", "missing_published_at", "invalid_published_at", "provider_error")


def rejection_samples(spark, d):
    reason = F.when(c("event_id") % 7 == 0, "missing_identity").when(c("event_id") % 11 == 0, "invalid_published_at").when(c("event_id") % 13 == 0, "short_text")
    return reports.rejections(table(spark, d, "events").select(c("event_id").alias("item_id"), reason.alias("reason")), REASONS)


def _documents(spark, d):
    o = table(spark, d, "orders")
    return o.select(c("o_orderkey").alias("document_id"), (c("o_custkey") % 300).alias("ticker"), F.concat(F.lit("t"), c("o_orderkey").cast("string")).alias("title"), F.when(c("o_orderkey") % 5 == 0, "").when(c("o_orderkey") % 7 == 0, "blocked_x").otherwise("sha").alias("pdf_sha256"), (c("o_orderkey") % 11 != 0).alias("on_disk"), F.when(c("o_orderkey") % 13 != 0, c("o_orderdate")).alias("published_at"))


def _runs(spark, d):
    l = table(spark, d, "lineitem").where("l_orderkey % 4 <> 0")
    return l.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("run_id"), c("l_orderkey").alias("document_id"), c("l_shipdate").alias("created_at"), F.when(c("l_returnflag") == "R", "Failed").otherwise("ok").alias("status"))


_DOCS = "dc as (select o_orderkey as document_id, o_custkey % 300 as ticker, 't' || cast(o_orderkey as varchar) as title, case when o_orderkey % 5 = 0 then '' when o_orderkey % 7 = 0 then 'blocked_x' else 'sha' end as sha, o_orderkey % 11 <> 0 as on_disk, case when o_orderkey % 13 <> 0 then o_orderdate end as published_at from orders), rn as (select l_orderkey * 10 + l_linenumber as run_id, l_orderkey as document_id, l_shipdate as created_at, case when l_returnflag = 'R' then 'failed' else 'ok' end as status from lineitem where l_orderkey % 4 <> 0)"


def structured_coverage(spark, d):
    return reports.structured_coverage(_documents(spark, d), _runs(spark, d))


def failed_runs(spark, d):
    """Runs that failed of one ticker's documents."""
    return reports.failures_of(_documents(spark, d), _runs(spark, d), "17").select("run_id", "document_id", "title", "created_at")


def runs_by_ticker(spark, d):
    """Runs met with their documents, counted by ticker; those without a document fall out."""
    return _runs(spark, d).join(_documents(spark, d).select("document_id", "ticker"), "document_id").groupBy("ticker").agg(F.count("*").alias("n_runs"), F.max("created_at").alias("last_run"))


def verification_checks(spark, d):
    return reports.verification(_documents(spark, d))


def announcement_freshness(spark, d):
    return reports.freshness(_documents(spark, d).where("ticker % 10 <> 3"), spark.range(300).select(c("id").alias("ticker")), "1998-08-01 00:00:00")


def documents_by_ticker(spark, d):
    """The five newest documents of every ticker, those without a time last."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("published_at"), "document_id")
    return _documents(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 5").select("ticker", "document_id", c("place").cast("long").alias("place"))


def _financials(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy((c("o_custkey") % 300).alias("ticker"), F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("revenue"), F.min("o_totalprice").alias("ebit"), F.count("*").alias("n"))


def latest_financials(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.desc("year"))
    return _financials(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 3").select("ticker", "year", "revenue", c("place").cast("long").alias("place"))


def low_confidence(spark, d):
    """The hundred figures least to be trusted below the bound."""
    f = _financials(spark, d).withColumn("confidence", F.round(c("n") / 100.0, 4))
    return f.where("confidence < 0.08").orderBy("confidence", "ticker", "year").limit(100).select("ticker", "year", "confidence")


def changed_figures(spark, d):
    f = _financials(spark, d)
    before, after = (f.where(f"year = {y}").select("ticker", "revenue", "ebit", "n") for y in (1995, 1996))
    return reports.changed_figures(before, after, "ticker", ["revenue", "ebit", "n"])


def ticker_evidence(spark, d):
    a = table(spark, d, "events").select((c("user_id") % 500).alias("ticker"), (c("event_id") % 5000).alias("article_id"), c("event_type").alias("provider"), F.concat(F.lit("s"), (c("event_id") % 4).cast("string")).alias("signal"), c("ts").alias("published"))
    return reports.ticker_evidence(a, ("view", "click"), "2024-01-10 00:00:00")


def metadata_gate(spark, d):
    return reports.metadata_gate(table(spark, d, "documents"), F.length("text") < 100)


def label_scores(spark, d):
    """Tags found for a document, by residues, against tags wanted."""
    tags = lambda *mods: F.array_compact(F.array(*[F.when(c("doc_id") % m == 0, F.lit(f"m{m}")) for m in mods]))
    return reports.label_scores(table(spark, d, "labels").select(tags(2, 3, 5).alias("found"), tags(2, 3, 7).alias("wanted")))


def gold_lint(spark, d):
    o = table(spark, d, "orders").select(c("o_custkey").alias("doc"), c("o_orderkey").alias("place"), F.when(c("o_orderkey") % 50 == 0, "").otherwise(F.concat(F.lit("m"), (c("o_orderkey") % 4).cast("string"))).alias("metric"), F.year("o_orderdate").cast("string").alias("period_end"), F.lit("FY").alias("period_type"), F.when(c("o_orderkey") % 31 == 0, "unknown").otherwise("AUD").alias("currency"), F.when(c("o_orderkey") % 41 != 0, c("o_orderstatus")).alias("scope"))
    return reports.gold_issues(o).groupBy("issue").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n"))


def canonical_hygiene(spark, d):
    f = facts(spark, d).select(F.when(c("ord") % 7 == 0, "").otherwise(c("period")).alias("period"), F.when(c("k") == 5, "cashflow_unmapped").otherwise(c("metric")).alias("metric"))
    return f.agg(F.count("*").alias("n_rows"), F.count_if(c("period") == "").alias("blank_period_end"), F.count_if(c("metric") == "cashflow_unmapped").alias("cashflow_unmapped"))


def balanced_sample(spark, d):
    return reports.balanced_sample(table(spark, d, "orders"), "o_orderpriority", F.sha1(c("o_orderkey").cast("string")), 60, 20).select("o_orderkey", "o_orderpriority", c("turn").cast("long").alias("turn"))


def latest_files(spark, d):
    o = table(spark, d, "orders").select((c("o_custkey") % 500).alias("ticker"), c("o_orderkey").alias("name"), c("o_orderdate").alias("day"), (c("o_orderkey") % 5).alias("relevance"), F.when(c("o_orderkey") % 9 == 0, "annual").when(c("o_orderkey") % 9 == 1, "half").otherwise("other").alias("form"))
    return reports.latest_with_forms(o, 4).select("ticker", "name", "form", c("place").cast("long").alias("place"))


def best_evidence(spark, d):
    f = facts(spark, d).select("metric", "period", "conf", (c("k") % 4 / 4.0).alias("confidence"), F.when(c("ord") % 2 == 0, "t1").alias("table_id"), c("ord").alias("line_no"), c("company").alias("file"), "value")
    return reports.best_evidence(f).select("metric", "period", "file", "line_no", "value")


def metric_means(spark, d):
    """The mean of a derived figure by period."""
    from .warehouse import _ratios

    return _ratios(spark, d).where("metric = 'ebit_margin_pct'").groupBy("period").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


def risk_states(spark, d):
    from ..operators import risk
    from .warehouse import _ratios

    return reports.risk_states(risk.leverage_and_liquidity(_ratios(spark, d), "institutional"), facts(spark, d), ["net_debt_to_ebitda_risk", "cash_runway_risk"])


def missing_sections(spark, d):
    f = facts(spark, d).select(c("company").alias("file"), "period", ff.metric_name(F.when(c("metric") == "cash_closing", "cash").otherwise(c("metric"))).alias("metric"))
    return reports.missing_sections(f)


def ambiguous_candidates(spark, d):
    """Candidates repeat an order's price for the next year in every third case."""
    o = table(spark, d, "orders").select((c("o_custkey") % 500).alias("file"), F.year("o_orderdate").alias("period"), c("o_totalprice").alias("value"), c("o_orderkey").alias("id"))
    cand = o.withColumn("period", F.when(c("id") % 3 == 0, c("period") + 1).otherwise(c("period")))
    return reports.ambiguous_candidates(cand, o.where("id % 2 = 0")).select("id", "file", "period")


def price_horizon(spark, d):
    from .events import _closes

    h = reports.horizon(_closes(spark, d))
    return h.select("ticker", "points", *[F.round(x, 4).alias(x) for x in ("total_return_pct", "max_drawdown_pct", "volatility_pct")])


def historical_prices(spark, d):
    """The last close of every ticker on or before a day, and the whole span."""
    from .events import _closes

    p = _closes(spark, d)
    at = F.max_by(F.when(c("ts") <= F.lit("2024-01-15 12:00:00").cast("timestamp"), c("close")), F.when(c("ts") <= F.lit("2024-01-15 12:00:00").cast("timestamp"), c("ts")))
    return p.groupBy("ticker").agg(at.alias("close"), F.count("*").alias("points"), F.min("close").alias("low"), F.max("close").alias("high"))


def provider_probe(spark, d):
    e = table(spark, d, "events")
    return reports.provider_probe(e.select(c("event_type").alias("provider"), c("ts").cast("date").alias("day"), (c("user_id") % 997).alias("ticker"), F.when(c("value").isNull(), "missing_value").alias("reason")))


def gold_templates(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    rows = l.select((c("o_custkey") % 400).alias("ticker"), c("o_orderkey").alias("file"), c("o_orderdate").alias("day"), c("l_returnflag").alias("metric"), F.year("l_shipdate").alias("period"), c("l_linestatus").alias("scope"), (c("l_partkey") * 100 + c("l_linenumber")).alias("line_no"), c("l_quantity").alias("value"))
    return reports.templates(rows, 3).groupBy("ticker", "file").agg(F.count("*").alias("n_fields"))


def label_summary(spark, d):
    o = table(spark, d, "orders")
    return reports.label_summary(o.select(F.when(c("o_orderstatus") == "F", "correct").otherwise("incorrect").alias("verdict"), c("o_orderpriority").alias("metric"), (c("o_orderkey") % 6 == 0).alias("assisted")))


def eval_baseline(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("case_id"), F.when(c("o_custkey") % 9 != 0, c("o_custkey") % 8 + 1).alias("rank"))
    return reports.eval_baseline(o, 5).select("case_id", "rank", "hit", F.round("reciprocal", 6).alias("reciprocal"))


def health_gate(spark, d):
    """A section a language: degraded where a tenth of its texts are short."""
    t = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.length("text") < 200).alias("short"))
    return reports.health_gate(t.select(F.when(c("short") > 0.1 * c("n"), "degraded").otherwise("healthy").alias("status")))


# contracts

_GOOD = {"doc_id": "d", "pdf_path": "p", "page": 1, "pass_name": "ocr", "statement_type": "income", "period_end": "2024-06-30", "scope": "s", "metric": "revenue", "metric_candidate": "", "source_type": "ocr_page", "table_id": ""}
CANDIDATES = [({}, ""), ({"doc_id": " "}, "missing_doc_id"), ({"page": 0, "scope": None}, "missing_page,missing_scope"), ({"metric": "", "metric_candidate": "Rev"}, ""), ({"metric": ""}, "missing_metric_name"), ({"source_type": "camelot_table"}, "camelot_missing_table_id"), ({"source_type": ""}, "missing_source_type")]


def candidate_contract(spark, d):
    kinds = ", ".join(f"{k} {'int' if k == 'page' else 'string'}" for k in _GOOD)
    r = scenarios(spark, d, [_GOOD | x for x, _ in CANDIDATES], kinds)
    return r.select("o_orderkey", F.array_join(contracts.candidate_issues(r), ",").alias("expected"))


PROMOTED = [("revenue", "2024-06-30", "AUD", "native_table", 1.5, ""), ("", "", "UNKNOWN", "ocr", 2.9, "missing_canonical_metric,missing_period_end,unknown_currency,low_confidence"), ("ebit", "x", "A$", "new_pass", 1.9, "low_confidence"), ("ebit", "x", "A$", "", 1.6, ""), ("ebit", "x", None, "bbox_layout", 1.75, "unknown_currency")]


def promotion_gate(spark, d):
    names = ("metric", "period_end", "currency", "pass_name", "confidence")
    r = scenarios(spark, d, [dict(zip(names, x, strict=False)) for x in PROMOTED], "metric string, period_end string, currency string, pass_name string, confidence double")
    return r.select("o_orderkey", F.array_join(contracts.promotion_issues(*[c(n) for n in names]), ",").alias("expected"))


DEPTHS = [(1, [0.0, 1.0, 2.0, 3.0], "t", 1, 2, "s", "r", 9), (0, None, "", None, None, "", "", 0), (3, [1.0], "t", None, 0, "", "raw", 5)]


def provenance_depths(spark, d):
    names = ("page", "bbox", "table_id", "row", "col", "snippet", "raw")
    r = scenarios(spark, d, [dict(zip(names, x, strict=False)) for x in DEPTHS], "page int, bbox array<double>, table_id string, row int, col int, snippet string, raw string")
    return r.select("o_orderkey", contracts.depth(*[c(n) for n in names]).alias("expected"))


SCALES = [(1000.0, 1000.0, 3, 1000.0), (1000.0, 1000000.0, -3, 1000000.0), (1.0, 1100.0, -3, 1000.0), (None, 5.0, 0, None), (1000.0, 0.0, 0, None)]


def unit_scales(spark, d):
    r = scenarios(spark, d, [dict(zip(("said", "applied"), x, strict=False)) for x in SCALES], "said double, applied double")
    bucket = F.when(c("applied") > 0, numeric.bucketize_scale(c("applied")))
    return r.select("o_orderkey", contracts.unit_evidence(c("said"), bucket).alias("evidence"), bucket.alias("bucket"))


def _candidates(spark, d):
    l = table(spark, d, "lineitem")
    passes = F.element_at(F.array(*map(F.lit, contracts.PASS_PRIORITY)), (c("l_linenumber") % 2 + 1).cast("int"))
    return l.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("candidate_id"), c("l_orderkey").alias("doc"), F.lit(2.0).alias("confidence"), passes.alias("pass_name"), F.lit(3).alias("depth"), F.lit("p").alias("pdf_path"), F.lit(1).alias("page"),
        (c("l_suppkey") % 3).cast("int").alias("unit_evidence"), (c("l_quantity") % 3).alias("value"), F.lit("AUD").alias("currency"), F.lit("m").alias("metric"), F.lit("2024").alias("period_end"), F.lit("s").alias("scope"), F.lit("").alias("table_id"),
    )


_CAND = "ca as (select l_orderkey * 10 + l_linenumber as candidate_id, l_orderkey as doc, l_linenumber % 2 as pass, l_suppkey % 3 as ue, l_quantity % 3 as value from lineitem)"


def pass_winners(spark, d):
    return contracts.pass_winners(_candidates(spark, d), ["doc"])


def distinct_candidates(spark, d):
    return contracts.distinct_candidates(_candidates(spark, d)).select("pass_name", "value", "candidate_id", "n_copies")


def _bundles(spark, d):
    o = table(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, (*contracts.SOURCE_TYPES, "blog"))), (c("o_orderkey") % 4 + 1).cast("int"))
    return o.select(c("o_custkey").alias("bundle"), F.when(c("o_orderkey") % 29 == 0, "").otherwise(F.concat(F.lit("e"), (c("o_orderkey") % 5).cast("string"))).alias("evidence_id"), kind.alias("source_type"), F.when(c("o_orderkey") % 3 != 0, "id").alias("source_id"), F.when(c("o_orderkey") % 6 != 0, "url").alias("source_url"), ((c("o_orderkey") % 120) / 100.0).alias("confidence"), F.when(c("o_orderkey") % 17 != 0, "text").alias("content"))


def evidence_issues(spark, d):
    return contracts.evidence_issues(_bundles(spark, d)).groupBy("issue").agg(F.count("*").alias("n_bundles"), F.sum("n").cast("long").alias("n"))


def citation_coverage(spark, d):
    o = table(spark, d, "orders").select(c("o_custkey").alias("report"), c("o_orderkey").alias("k"))
    claims = o.select("report", c("k").cast("string").alias("claim"))
    citations = o.where("k % 40 <> 0").select("report", c("k").cast("string").alias("claim"), F.array(F.concat(F.lit("e"), (c("k") % 6).cast("string"))).alias("evidence_ids"))
    evidence = o.where("k % 6 < 5 or report % 4 <> 0").select("report", F.concat(F.lit("e"), (c("k") % 6).cast("string")).alias("evidence_id"))
    return contracts.citation_coverage(claims, citations, evidence)


def query_guard(spark, d):
    """Queries that name an order's own columns, ended, commented or prefixed by what its customer and day say."""
    o = table(spark, d, "orders")
    verb = F.when(c("o_custkey") % 5 == 0, "delete from ").when(c("o_custkey") % 5 == 1, "WITH a as (select 1) select * from ").when(c("o_custkey") % 5 == 2, "explain select * from ").otherwise("select updated_at from ")
    end = F.when(F.day("o_orderdate") % 4 == 0, ";").when(F.day("o_orderdate") % 4 == 1, " -- note").when(F.day("o_orderdate") % 4 == 2, "").otherwise(F.concat(F.lit(" where p = '"), "o_orderpriority", F.lit("'")))
    q = F.concat(verb, F.lit("orders_"), c("o_orderkey").cast("string"), end, F.when(c("o_orderstatus") == "P", F.repeat(F.lit(" "), 4100)).otherwise(""))
    q = F.when((c("o_orderkey") % 50 == 0) & (c("o_orderstatus") == "F"), F.concat(q, F.lit(" union "), F.repeat(F.lit("x"), 4000))).otherwise(q)
    return o.select("o_orderkey", contracts.read_only(q).alias("expected"))


# stores


def hashed_upsert(spark, d):
    o = table(spark, d, "orders").select((c("o_custkey") % 2000).alias("file"), F.year("o_orderdate").alias("period"), c("o_orderkey").alias("line_no"), c("o_totalprice").alias("value"))
    out = stores.keyed_upsert(o.where("line_no % 2 = 0"), o.where("line_no % 2 = 1").drop("value"), ["file", "period"], "line_no")
    return out.select("row_id", "file", "period", "line_no", "value")


def article_versions(spark, d):
    o = table(spark, d, "orders").select(c("o_custkey").alias("article"), c("o_orderstatus").alias("mark"), c("o_orderkey").alias("ordinal"), c("o_orderdate").alias("day"))
    stored = o.where("day < timestamp'1995-01-01'").groupBy("article").agg(F.max_by("mark", "ordinal").alias("mark")).withColumn("version", F.lit(3))
    return stores.next_versions(stored, o.where("day >= timestamp'1995-01-01'"), "article", "mark", "ordinal").select("article", c("version").cast("long").alias("version"), "mark")


def discovered_documents(spark, d):
    o = table(spark, d, "orders").select((c("o_orderkey") % 9000).alias("url"), (c("o_custkey") % 50).alias("ticker"), c("o_orderkey").alias("ordinal"))
    new, counts = stores.discovered(o.where("ordinal % 3 <> 0"), o.where("ordinal % 3 = 0"), "url", "ticker", "ordinal")
    return counts.join(new.groupBy("ticker").agg(F.count("*").alias("inserted")), "ticker", "left")


def existing_articles(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 2 == 0, (c("o_orderkey") % 4000).cast("string")).otherwise("").alias("url"), (c("o_custkey") % 700).cast("string").alias("exact"), c("o_orderpriority").alias("near"))
    return stores.existing(o.where("id % 10 = 1 or id % 10 = 2"), o.where("id % 10 > 6"), ["url", "exact", "near"]).select("id", "existing_id", "matched_by")


def split_rejects(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    kept, rejected = stores.split_rejects(e, F.when(c("value").isNull(), "missing_value").when(c("value") < 0, "negative_value"))
    return rejected.groupBy("reason").agg(F.count("*").alias("n")).unionAll(kept.agg(F.lit("kept").alias("reason"), F.count("*").alias("n")))


def pending_windows(spark, d):
    """Days of the events that no record says are done."""
    days = table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(dates.day_windows(c("a"), c("b"))).alias("w")).select("w.start", "w.end")
    done = days.where("day(to_date(substring(start, 1, 10))) % 3 = 0").withColumn("status", F.when(F.substring("start", 9, 2) == "15", "failed").otherwise("completed"))
    return stores.pending_windows(days, done, ["start", "end"])


def recorded_windows(spark, d):
    e = table(spark, d, "events").groupBy(c("ts").cast("date").alias("day"), (c("event_id") % 5).alias("attempt")).agg(F.count("*").alias("fetched"))
    r = e.select("day", c("attempt").alias("recorded_at"), "fetched")
    return stores.recorded_windows(r.where("recorded_at < 3"), r.where("recorded_at = 3"), ["day"]).select("day", "recorded_at", "fetched")


def merged_rows(spark, d):
    o = table(spark, d, "orders").select((c("o_custkey") % 3000).alias("key"), F.year("o_orderdate").alias("year"), (c("o_orderkey") % 4).alias("conf"), c("o_orderkey").alias("id"))
    a, b = stores.first_of_key(o.where("id % 2 = 0"), ["key", "year"], "id"), stores.first_of_key(o.where("id % 2 = 1"), ["key", "year"], "id")
    return stores.merged_preferring(a, b, ["key", "year"], c("conf")).select("key", "year", "conf", "id")


def nine_key_dedupe(spark, d):
    l = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("ordinal"), c("l_returnflag").alias("file"), c("l_linestatus").alias("metric"), (c("l_quantity") % 5).alias("value"), (c("l_partkey") % 3).alias("period"), F.lit("a").alias("kind"), F.lit("b").alias("raw"), F.lit("c").alias("line"), F.lit("d").alias("table_id"), F.lit(1).alias("page"))
    return stores.first_of_key(l, ["file", "metric", "value", "period", "kind", "raw", "line", "table_id", "page"], "ordinal").select("ordinal", "file", "metric", "value", "period")


def regrouped_articles(spark, d):
    t = table(spark, d, "conversations").select(c("conv_id").alias("article"), c("turn").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    return stores.regrouped(t.unionAll(t.withColumn("place", c("place") + 100)), "article").select("article", "n_parts", F.sha1("text").alias("text_sha1"))


def evolved_chunks(spark, d):
    """Chunks of an old table and of a newer one with a column more."""
    n = table(spark, d, "nation")
    return n.select("n_nationkey", "n_name").unionByName(n.select(c("n_nationkey") + 100, "n_name", "n_regionkey").toDF("n_nationkey", "n_name", "n_regionkey"), allowMissingColumns=True)


def replaced_links(spark, d):
    from ..operators import backlog

    l = table(spark, d, "lineitem").select(c("l_orderkey").alias("article"), c("l_suppkey").alias("ticker"), c("l_linenumber").alias("n"))
    out = backlog.replace_children(l.where("n <= 3"), l.where("n > 3 and article % 2 = 0"), "article")
    return out.groupBy("article").agg(F.count("*").alias("n_links"), F.sum("ticker").cast("long").alias("tickers"))


def fixed_chunks(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(layout.fixed_chunks(c("text"), 800)).alias("chunk", "text"))
    return t.select("doc_id", c("chunk").cast("long").alias("chunk"), F.sha1("text").alias("text_sha1"))


def quantiles(spark, d):
    """Nearest-index quantiles of the quantities of each part's size."""
    l = table(spark, d, "lineitem").groupBy((c("l_partkey") % 200).alias("part")).agg(F.collect_list("l_quantity").alias("q"))
    return l.select("part", *[numeric.nearest_quantile(c("q"), p).alias(n) for p, n in ((0.25, "q25"), (0.6, "q60"), (0.9, "q90"))])


def update_events(spark, d):
    """The newest hundred purchases with a value."""
    return table(spark, d, "events").where("event_type = 'purchase' and value is not null").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts", "value")


def ticker_set_overlap(spark, d):
    """Tickers that two lanes share and that either has, by day."""
    l = _links(spark, d).withColumn("day", c("published").cast("date")).groupBy("day").agg(*[F.collect_set(F.when(c("lane") == x, c("ticker"))).alias(x) for x in ("high_precision", "high_recall")])
    return l.select("day", F.size(F.array_intersect("high_precision", "high_recall")).cast("long").alias("shared"), F.size(F.array_union("high_precision", "high_recall")).cast("long").alias("either"))


def unambiguous_acronyms(spark, d):
    """Initials of made-up names, a region's and an ore's, that only one nation has."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    a = n.select("n_nationkey", fa.acronym(F.concat_ws(" ", "r_name", F.lit("Bank of Mining"), F.element_at(F.array(*map(F.lit, ("Gold", "Iron", "Coal", "Zinc", "Lead"))), (c("n_nationkey") / 5 + 1).cast("int")))).alias("acronym")).where("acronym <> ''")
    return a.groupBy("acronym").agg(F.count("*").alias("n"), F.min("n_nationkey").alias("nation")).where("n = 1").select("acronym", "nation")


SQL = {
    "articles_per_day": "select cast(ts as date) as day, event_type as provider, count(*) as articles from events group by 1, 2",
    "ticker_coverage": f"with {_LINKS}, a as (select ticker, lane, (epoch(timestamp '{NOW}') - epoch(date_trunc('second', published))) / 86400.0 as age from lk where ticker in (select ticker from un)), w as (select * from a join (values (1), (7), (30)) v(window_days) on age <= window_days) select window_days, lane, count(distinct ticker) as covered, round(count(distinct ticker) * 100.0 / (select count(*) from un), 4) as covered_pct from w group by 1, 2",
    "uncovered_tickers": f"with {_LINKS} select un.ticker, max((coalesce(lane, '') = 'high_precision')::int) as covered_high_precision, max((coalesce(lane, '') = 'high_recall')::int) as covered_high_recall from un left join lk using (ticker) group by 1",
    "coverage_summary": f"with {_LINKS}, n as (select un.ticker, count(distinct article_id) as n from un left join lk using (ticker) group by 1) select count(*) as tickers_total, count(*) filter (where n > 0) as tickers_with_hits, count(*) filter (where n = 0) as tickers_zero_hits, quantile_cont(n, 0.5) as median_articles from n",
    "coverage_deltas": f"with {_LINKS} select lane, count(*) - count(*) filter (where article_id % 2 = 0) as articles_delta, count(distinct ticker) - count(distinct case when article_id % 2 = 0 then ticker end) as tickers_delta from lk group by 1",
    "run_counters": "select user_id % 50 as run_id, count(*) as fetched, count(*) filter (where event_id % 3 = 0) as inserted, count(*) filter (where event_id % 3 = 1) as deduped, count(*) filter (where event_id % 9 = 2) as rejected, count(*) filter (where event_id % 100 = 0) as errors, round(count(*) filter (where event_id % 3 = 1) * 100.0 / count(*), 4) as duplicate_rate_pct from events group by 1",
    "rejection_samples": "with r as (select event_id, case when event_id % 7 = 0 then 'missing_identity' when event_id % 11 = 0 then 'invalid_published_at' when event_id % 13 = 0 then 'short_text' end as reason from events), k as (select *, row_number() over (partition by reason order by event_id desc) as rn from r where reason is not null), g as (select reason, count(*) as rejected, string_agg(case when rn <= 5 then cast(event_id as varchar) end, ',' order by event_id desc) as samples from k group by 1) select reason, coalesce(rejected, 0) as rejected, coalesce(samples, '') as samples from g full join (values ('missing_identity'), ('missing_published_at'), ('invalid_published_at'), ('provider_error')) v(reason) using (reason)",
    "structured_coverage": f"with {_DOCS}, la as (select * from rn qualify row_number() over (partition by document_id order by created_at desc, run_id desc) = 1) select count(*) as documents_total, count(*) filter (where status = 'ok') as documents_ok, count(*) filter (where sha <> '' and not starts_with(sha, 'blocked_') and status is null) as downloaded_not_extracted, count(*) filter (where status = 'failed') as latest_failed, round(count(*) filter (where status = 'ok') * 100.0 / count(*), 4) as coverage_pct from dc left join la using (document_id)",
    "failed_runs": f"with {_DOCS} select run_id, document_id, title, created_at from rn join dc using (document_id) where status = 'failed' and ticker = 17",
    "runs_by_ticker": f"with {_DOCS} select ticker, count(*) as n_runs, max(created_at) as last_run from rn join dc using (document_id) group by 1",
    "verification_checks": f"with {_DOCS}, k as (select document_id, case when starts_with(sha, 'blocked_') then 'blocked_documents' when sha = '' then 'pending_downloads' when not on_disk then 'missing_pdf_files' end as \"check\" from dc), r as (select *, row_number() over (partition by \"check\" order by document_id) as rn from k where \"check\" is not null) select \"check\", count(*) as n, string_agg(case when rn <= 10 then cast(document_id as varchar) end, ',' order by document_id) as samples from r group by 1",
    "announcement_freshness": f"with {_DOCS}, g as (select ticker, count(*) as n, max(published_at) as latest from dc where ticker % 10 <> 3 group by 1), t as (select range as ticker, coalesce(n, 0) as doc_count, greatest(0.0, (epoch(timestamp '1998-08-01') - epoch(latest)) / 3600.0) as age, latest from range(300) left join g on range = ticker) select ticker, doc_count, round(case when latest is not null then age end, 4) as age_hours, case when doc_count = 0 then 'missing' when latest is null then 'unknown' when age > 168 then 'stale' else 'fresh' end as status from t",
    "documents_by_ticker": f"with {_DOCS} select ticker, document_id, row_number() over (partition by ticker order by published_at desc nulls last, document_id) as place from dc qualify place <= 5",
    "latest_financials": "with f as (select o_custkey % 300 as ticker, year(o_orderdate) as year, max(o_totalprice) as revenue from orders group by 1, 2) select *, row_number() over (partition by ticker order by year desc) as place from f qualify place <= 3",
    "low_confidence": "with f as (select o_custkey % 300 as ticker, year(o_orderdate) as year, round(count(*) / 100.0, 4) as confidence from orders group by 1, 2) select * from f where confidence < 0.08 order by confidence, ticker, year limit 100",
    "changed_figures": "with f as (select o_custkey % 300 as ticker, year(o_orderdate) as y, max(o_totalprice) as revenue, min(o_totalprice) as ebit, cast(count(*) as double) as n from orders group by 1, 2), j as (select coalesce(b.ticker, a.ticker) as ticker, b.revenue as br, a.revenue as ar, b.ebit as be, a.ebit as ae, b.n as bn, a.n as an from (select * from f where y = 1995) b full join (select * from f where y = 1996) a on a.ticker = b.ticker), c as (select ticker, 'revenue' as field, br as before, ar as after from j union all select ticker, 'ebit', be, ae from j union all select ticker, 'n', bn, an from j) select *, after - before as delta from c where before is distinct from after",
    "ticker_evidence": "select user_id % 500 as ticker, count(distinct event_id % 5000) as n_articles, string_agg(distinct event_type, ',' order by event_type) as providers, string_agg(distinct 's' || cast(event_id % 4 as varchar), ',' order by 's' || cast(event_id % 4 as varchar)) as signals, max(ts) as last_published from events where event_type in ('view', 'click') and ts >= timestamp '2024-01-10' group by 1",
    "metadata_gate": "with g as (select count(*) as n_rows, count(*) filter (where length(text) < 100) as n_bad from documents) select n_rows, n_bad, round(n_bad * 100.0 / n_rows, 4) as bad_pct, n_bad >= 20 and round(n_bad * 100.0 / n_rows, 4) > 5 as failed from g",
    "label_scores": "with r as (select (doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int as s, (doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int + (doc_id % 5 = 0)::int as f, (doc_id % 2 = 0)::int + (doc_id % 3 = 0)::int + (doc_id % 7 = 0)::int as w from labels), p as (select case when f > 0 then s / f else 0.0 end as p, s / w as r, (s = f and s = w)::int as same from r where w > 0), q as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f1 from p) select count(*) as n, round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(avg(f1), 6) as macro_f1, round(avg(same), 6) as exact_match_rate from q",
    "gold_lint": "with o as (select o_custkey as doc, o_orderkey as k, case when o_orderkey % 50 = 0 then '' else 'm' || cast(o_orderkey % 4 as varchar) end as metric, year(o_orderdate) as y, o_orderkey % 31 = 0 as unk, case when o_orderkey % 41 <> 0 then lower(o_orderstatus) end as scope from orders), a as (select *, row_number() over (partition by doc, metric, y, scope order by k) > 1 as again from o), i as (select doc, 'blank_metric' as issue from a where metric = '' union all select doc, 'blank_scope' from a where scope is null union all select doc, 'unknown_currency' from a where unk union all select doc, 'duplicate_metric_period_scope' from a where again) select issue, count(distinct doc) as n_docs, count(*) as n from i group by 1",
    "canonical_hygiene": FACTS_SQL + " select count(*) as n_rows, count(*) filter (where ord % 7 = 0) as blank_period_end, count(*) filter (where k = 5) as cashflow_unmapped from facts",
    "balanced_sample": "with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by sha1(cast(o_orderkey as varchar))) as turn from orders qualify turn <= 20) select * from r order by turn, o_orderpriority limit 60",
    "latest_files": "with o as (select o_custkey % 500 as ticker, o_orderkey as name, o_orderdate as day, o_orderkey % 5 as rel, case when o_orderkey % 9 = 0 then 'annual' when o_orderkey % 9 = 1 then 'half' else 'other' end as form from orders), f as (select *, form <> 'other' and row_number() over (partition by ticker, form order by rel desc, day desc, name desc) = 1 as first from o), p as (select ticker, name, form, row_number() over (partition by ticker order by case when first and form = 'annual' then 0 when first then 1 else 2 end, rel desc, day desc, name desc) as place from f) select * from p where place <= 4",
    "best_evidence": FACTS_SQL + " select metric, period, company as file, ord as line_no, value from facts qualify row_number() over (partition by metric, period order by conf desc, k % 4 desc, (ord % 2 = 0)::int desc, (ord > 0)::int desc, company desc, ord desc) = 1",
    "ambiguous_candidates": "with o as (select o_custkey % 500 as file, year(o_orderdate) as period, round(o_totalprice, 6) as v, o_orderkey as id from orders), b as (select * from o where id % 2 = 0), cd as (select id, file, v, case when id % 3 = 0 then period + 1 else period end as period from o) select id, file, period from cd where not exists (select 1 from b where b.file = cd.file and b.v = cd.v) or exists (select 1 from b where b.file = cd.file and b.v = cd.v and b.period = cd.period)",
    "missing_sections": FACTS_SQL + ", s as (select company as file, period, bool_or(metric = 'revenue') and bool_or(metric = 'ebit') and bool_or(metric = 'npat') as i, bool_or(metric = 'total_assets') and bool_or(metric = 'total_liabilities') and bool_or(metric = 'total_equity') and bool_or(metric = 'cash_closing') and bool_or(metric = 'total_debt') as b, (bool_or(metric = 'operating_cash_flow') and bool_or(metric = 'capex')) or bool_or(metric = 'free_cash_flow') as c from facts group by 1, 2) select file, period, concat_ws(',', case when i and not b then 'balance_sheet' end, case when i and not c then 'cash_flow' end) as missing from s",
    "candidate_contract": expected_sql([e for _, e in CANDIDATES]),
    "promotion_gate": expected_sql([x[-1] for x in PROMOTED]),
    "provenance_depths": expected_sql([x[-1] for x in DEPTHS]),
    "unit_scales": expected_sql([x[2:] for x in SCALES], names=("evidence", "bucket")),
    "pass_winners": f"with {_CAND}, t as (select * from ca qualify pass = min(pass) over (partition by doc)), g as (select doc, count(*) as tied, max(ue) as mu, count(distinct value) as nv, min(candidate_id) as first_id, arg_max(candidate_id, (ue, -candidate_id)) as by_unit from t group by 1), l as (select doc, count(*) as leaders from t join g using (doc) where ue = mu group by 1), o as (select *, case when tied = 1 then 'single' when leaders = 1 then 'unit_evidence' when nv = 1 then 'reconciled' else 'quarantined' end as outcome from g join l using (doc)) select doc, tied, outcome, case outcome when 'unit_evidence' then by_unit when 'quarantined' then null else first_id end as winner from o",
    "distinct_candidates": f"with {_CAND} select case pass when 0 then 'native_table' else 'bbox_layout' end as pass_name, value, min(candidate_id) as candidate_id, count(*) as n_copies from ca group by 1, 2",
    "evidence_issues": "with b as (select o_custkey as bundle, case when o_orderkey % 29 <> 0 then 'e' || cast(o_orderkey % 5 as varchar) end as eid, o_orderkey as k from orders), rp as (select bundle, sum(n - 1) as n from (select bundle, eid, count(*) as n from b where eid is not null group by 1, 2) where n > 1 group by 1), i as (select bundle, 'missing_evidence_id' as issue from b where eid is null union all select bundle, 'unknown_source_type' from b where k % 4 = 3 union all select bundle, 'missing_source' from b where k % 6 = 0 union all select bundle, 'confidence_out_of_range' from b where (k % 120) / 100.0 > 1 union all select bundle, 'missing_content' from b where k % 17 = 0), g as (select bundle, issue, count(*) as n from i group by 1, 2 union all select bundle, 'repeated_evidence_id', n from rp union all select bundle, 'no_financial_statement', 1 from b group by 1 having not bool_or(k % 4 = 0) union all select bundle, 'no_asx_announcement', 1 from b group by 1 having not bool_or(k % 4 = 1) union all select bundle, 'no_news', 1 from b group by 1 having not bool_or(k % 4 = 2)) select issue, count(*) as n_bundles, cast(sum(n) as bigint) as n from g group by 1",
    "citation_coverage": "with o as (select o_custkey as report, o_orderkey as k from orders), n as (select report, count(*) as n_claims, count(*) filter (where k % 40 <> 0) as n_cited from o group by 1), ev as (select distinct report, k % 6 as e from o where k % 6 < 5 or report % 4 <> 0), u as (select report, count(*) as unknown_ids from (select distinct report, k % 6 as e from o where k % 40 <> 0 except select report, e from ev) group by 1) select report, n_claims, n_cited, coalesce(unknown_ids, 0) as unknown_ids, round(n_cited / n_claims, 6) as coverage, round(n_cited / n_claims, 6) >= 0.95 and coalesce(unknown_ids, 0) = 0 as passed from n left join u using (report)",
    "query_guard": "select o_orderkey, o_custkey % 5 not in (0, 2) and day(o_orderdate) % 4 in (2, 3) and not (o_orderkey % 50 = 0 and o_orderstatus = 'F') as expected from orders",
    "hashed_upsert": "with o as (select o_custkey % 2000 as file, year(o_orderdate) as period, o_orderkey as line_no, case when o_orderkey % 2 = 0 then o_totalprice end as value from orders) select sha1(concat_ws('|', file, period)) as row_id, * from o qualify row_number() over (partition by file, period order by line_no % 2 desc, line_no desc) = 1",
    "article_versions": "with o as (select o_custkey as article, o_orderstatus as mark, o_orderkey as ordinal, o_orderdate as day from orders), s as (select article, arg_max(mark, ordinal) as last_mark from o where day < timestamp '1995-01-01' group by 1), i as (select o.*, coalesce(lag(mark) over (partition by article order by ordinal), last_mark) as before, last_mark from o left join s using (article) where day >= timestamp '1995-01-01') select article, case when last_mark is null then 0 else 3 end + row_number() over (partition by article order by ordinal) as version, mark from i where mark is distinct from before",
    "discovered_documents": "with o as (select o_orderkey % 9000 as url, o_custkey % 50 as ticker, o_orderkey as k from orders), s as (select distinct url from o where k % 3 = 0), i as (select *, row_number() over (partition by url order by k) as rn, url in (select url from s) as known from o where k % 3 <> 0), g as (select ticker, count(*) as discovered, count(*) filter (where rn > 1) as repeated, count(*) filter (where rn = 1 and known) as known, count(*) filter (where rn = 1 and not known) as new from i group by 1) select *, case when new > 0 then new end as inserted from g",
    "existing_articles": "with o as (select o_orderkey as id, case when o_orderkey % 2 = 0 then cast(o_orderkey % 4000 as varchar) else '' end as url, o_custkey % 700 as exact, o_orderpriority as near from orders), s as (select * from o where id % 10 > 6), u as (select url, min(id) as i from s where url <> '' group by 1), e as (select exact, min(id) as i from s group by 1), n as (select near, min(id) as i from s group by 1) select o.id, coalesce(u.i, e.i, n.i) as existing_id, case when u.i is not null then 'url' when e.i is not null then 'exact' when n.i is not null then 'near' end as matched_by from o left join u on o.url = u.url left join e on o.exact = e.exact left join n on o.near = n.near where o.id % 10 in (1, 2)",
    "split_rejects": "select case when value is null then 'missing_value' when value < 0 then 'negative_value' else 'kept' end as reason, count(*) as n from events group by 1",
    "pending_windows": "with d as (select unnest(generate_series(min(cast(ts as date)), max(cast(ts as date)), interval 1 day))::date as d from events) select strftime(d, '%Y-%m-%dT00:00:00Z') as start, strftime(d, '%Y-%m-%dT23:59:59Z') as \"end\" from d where not (day(d) % 3 = 0 and day(d) <> 15)",
    "recorded_windows": "with e as (select cast(ts as date) as day, event_id % 5 as recorded_at, count(*) as fetched from events group by 1, 2) select * from e where recorded_at <= 3 qualify row_number() over (partition by day order by (recorded_at = 3)::int desc, recorded_at desc) = 1",
    "merged_rows": "with o as (select o_custkey % 3000 as key, year(o_orderdate) as year, o_orderkey % 4 as conf, o_orderkey as id from orders), f as (select * from o qualify row_number() over (partition by key, year, id % 2 order by id) = 1) select * from f qualify row_number() over (partition by key, year order by conf desc, id % 2) = 1",
    "nine_key_dedupe": "select min(l_orderkey * 10 + l_linenumber) as ordinal, l_returnflag as file, l_linestatus as metric, l_quantity % 5 as value, l_partkey % 3 as period from lineitem group by 2, 3, 4, 5",
    "regrouped_articles": "with t as (select conv_id as article, turn as place, coalesce(text, '') as text from conversations), p as (select article, lower(trim(text, ' ')) as h, arg_min(text, (place, text)) as text, min(place) as place from t group by 1, 2) select article, count(*) as n_parts, sha1(string_agg(text, chr(10) order by place, text)) as text_sha1 from p group by 1",
    "evolved_chunks": "select n_nationkey, n_name, null::int as n_regionkey from nation union all select n_nationkey + 100, n_name, n_regionkey from nation",
    "replaced_links": "with l as (select l_orderkey as article, l_suppkey as ticker, l_linenumber as n from lineitem), i as (select * from l where n > 3 and article % 2 = 0), a as (select * from l where n <= 3 and article not in (select article from i) union all select * from i) select article, count(*) as n_links, cast(sum(ticker) as bigint) as tickers from a group by 1",
    "fixed_chunks": "with r as (select doc_id, text, unnest(range(0, greatest((length(text) - 1) // 800, 0) + 1)) as chunk from documents) select doc_id, chunk, sha1(substr(text, chunk * 800 + 1, 800)) as text_sha1 from r",
    "quantiles": "with g as (select l_partkey % 200 as part, list_sort(list(l_quantity)) as q from lineitem group by 1) select part, " + ", ".join(f"q[cast(round_even((len(q) - 1) * {p}, 0) as int) + 1] as {n}" for p, n in ((0.25, "q25"), (0.6, "q60"), (0.9, "q90"))) + " from g",
    "update_events": "select event_id, ts, value from events where event_type = 'purchase' and value is not null order by ts desc, event_id desc limit 100",
    "ticker_set_overlap": f"with {_LINKS}, g as (select cast(published as date) as day, ticker, max((lane = 'high_precision')::int) as p, max((lane = 'high_recall')::int) as r from lk group by 1, 2) select day, count(*) filter (where p = 1 and r = 1) as shared, count(*) as either from g group by 1",
    "unambiguous_acronyms": "with w as (select n_nationkey, list_filter(regexp_extract_all(r_name || ' Bank of Mining ' || ['Gold', 'Iron', 'Coal', 'Zinc', 'Lead'][n_nationkey // 5 + 1], '[A-Za-z]+'), lambda x: lower(x) not in ('the', 'and', 'of', 'for', 'to', 'in', 'on', 'at', 'by', 'a', 'an', 'limited', 'ltd', 'group')) as w from nation join region on n_regionkey = r_regionkey), a as (select n_nationkey, upper(array_to_string(list_transform(w, lambda x: x[1]), '')) as acronym from w) select acronym, min(n_nationkey) as nation from a where length(acronym) between 4 and 8 group by 1 having count(*) = 1",
}


def _derived_sql():
    from .events import _CLOSES
    from .warehouse import _RATIOS, _SIGNALS

    return {
        "metric_means": FACTS_SQL + ", " + _RATIOS + " select period, round(avg(value), 4) as mean, count(*) as n from derived where metric = 'ebit_margin_pct' group by 1",
        "risk_states": FACTS_SQL + ", " + _RATIOS + ", " + _SIGNALS + ", st as (select company, period, max(case when signal_name = 'net_debt_to_ebitda_risk' then (risk_level in ('HIGH', 'CRITICAL'))::int end) as a, max(case when signal_name = 'cash_runway_risk' then (risk_level in ('HIGH', 'CRITICAL'))::int end) as b from sig where profile = 'institutional' and risk_level is not null group by 1, 2) select p.company, p.period, coalesce(a, 0) as net_debt_to_ebitda_risk, coalesce(b, 0) as cash_runway_risk from (select distinct company, period from facts) p left join st on p.company = st.company and p.period = st.period",
        "price_horizon": f"with {_CLOSES}, s as (select *, max(close) over (partition by ticker order by ts rows unbounded preceding) as peak, lag(close) over (partition by ticker order by ts) as b from px) select ticker, count(*) as points, round(case when count(*) >= 2 and arg_min(close, ts) > 0 then (arg_max(close, ts) / arg_min(close, ts) - 1.0) * 100.0 end, 4) as total_return_pct, round(min(case when peak > 0 then (close / peak - 1.0) * 100.0 end), 4) as max_drawdown_pct, round(case when count(*) >= 3 and count(case when b > 0 and close > 0 then 1 end) >= 2 then stddev_samp(case when b > 0 and close > 0 then ln(close / b) end) * sqrt(252.0) * 100.0 end, 4) as volatility_pct from s group by 1",
        "historical_prices": f"with {_CLOSES} select ticker, arg_max(close, ts) filter (where ts <= timestamp '2024-01-15 12:00:00') as close, count(*) as points, min(close) as low, max(close) as high from px group by 1",
    }


SQL |= {
    "provider_probe": "select event_type as provider, count(*) as n_items, count(distinct cast(ts as date)) as n_days, count(distinct user_id % 997) as n_tickers, count(*) - count(value) as rejected, round((count(*) - count(value)) * 100.0 / count(*), 4) as reject_pct from events group by 1",
    "gold_templates": "with r as (select o_custkey % 400 as ticker, o_orderkey as file, o_orderdate as day, l_returnflag as metric, year(l_shipdate) as period, l_linestatus as scope from lineitem join orders on l_orderkey = o_orderkey), f as (select ticker, file from (select distinct ticker, file, day from r) qualify row_number() over (partition by ticker order by day desc, file desc) <= 3) select ticker, file, count(*) as n_fields from (select distinct ticker, file, metric, period, scope from r) join f using (ticker, file) group by 1, 2",
    "label_summary": "select case when o_orderstatus = 'F' then 'correct' else 'incorrect' end as verdict, o_orderpriority as metric, count(*) as n, count(*) filter (where o_orderkey % 6 = 0) as assisted from orders group by rollup (1, 2)",
    "eval_baseline": "with o as (select o_orderkey as case_id, case when o_custkey % 9 <> 0 then o_custkey % 8 + 1 end as rank from orders) select case_id, rank, coalesce(rank <= 5, false) as hit, round(case when rank <= 5 then 1.0 / rank else 0.0 end, 6) as reciprocal from o",
    "health_gate": "with s as (select case when count(*) filter (where length(text) < 200) > 0.1 * count(*) then 'degraded' else 'healthy' end as status from documents group by lang) select case when bool_or(status = 'degraded') then 'degraded' else 'healthy' end as status, count(*) as n_sections, not bool_or(status = 'degraded') as passed from s",
}
SQL |= _derived_sql()
QUERIES = {k: globals()[k] for k in SQL}
