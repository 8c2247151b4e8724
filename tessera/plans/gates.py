"""Registered queries of gates over reports, suites, corpora and texts made of the orders' and documents' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, linking, sections
from . import filings
from .columns import _identified
from .common import facts, table
from .filings import _class_rows as class_rows

c = F.col
ACTIONS = ("update_ticker_financials", "daily_marketindex", "asx_enrichment_sweep", "daily_asx_marketwide", "full_history", "rebuild_ticker_financials", "resume_pending", "recover_headed", "other")


def action_gates(spark, d):
    """An order a report of one of nine actions, with figures out of its customer, day and price."""
    o = table(spark, d, "orders").withColumn("p", F.round("o_totalprice").cast("long"))
    n = lambda k: (c("p") % k).cast("int")
    r = o.select(
        "o_orderkey", F.get(F.array(*map(F.lit, ACTIONS)), (c("o_custkey") % 9).cast("int")).alias("action_id"), F.when(c("o_orderstatus") == "P", " Failed ").otherwise("success").alias("status"),
        n(2).alias("after_rows"), n(5).alias("downloaded"), F.when(c("p") % 3 == 0, 3).alias("min_download"), n(3).alias("days_completed"), n(4).alias("errors"), n(2).alias("found"), n(3).alias("inserted"), n(5).alias("processed"), n(7).alias("request_fail"), n(3).alias("selected"), n(2).alias("recovered"), n(5).alias("failed"),
        (c("p") % 11 == 0).alias("skip_download"), F.when(c("p") % 7 != 0, True).alias("report_found"), (c("p") % 2 == 0).alias("gate_passed"),
    )
    return gates.action_gate(r).select("o_orderkey", "action_id", "passed", F.array_join("reasons", "; ").alias("reasons"))


def suite_gates(spark, d):
    """Customers as suites of their orders' ranks, before and after."""
    o = table(spark, d, "orders").select((c("o_custkey") % 500).alias("suite"), c("o_orderkey").alias("case_id"), (F.month("o_orderdate") % 4 + 1).alias("before"), F.when(c("o_orderkey") % 400 != 0, F.when(c("o_custkey") % 3 == 0, F.month("o_orderdate") % 4 + 1).otherwise(F.day("o_orderdate") % 4 + 1)).alias("after"))
    r = gates.suite_gate(o.select("suite", "case_id", c("before").alias("rank")), o.select("suite", "case_id", c("after").alias("rank")))
    return r.select("suite", "passed", F.array_join("failures", ",").alias("failures"))


def headline_metrics(spark, d):
    """Sources as corpora of the documents, by the symbols these are about."""
    i = _identified(spark, d).withColumnRenamed("expected", "strength").join(table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("corpus")), "doc_id")
    universe = spark.range(10, 70).select(F.concat(F.lit("Q"), c("id").cast("string")).alias("ticker"))
    return gates.headline_metrics(i.select("corpus", c("doc_id").alias("chunk_id"), c("symbol").alias("ticker"), "strength"), universe)


def competing_identities(spark, d):
    """Documents as headlines of three symbols each: one that they begin with as a name, a mark or a word, one in brackets and one that isn't there."""
    n = c("doc_id") % 50 + 10
    a, b, z = F.concat(F.lit("Q"), n.cast("string")), F.concat(F.lit("WXY"), n.cast("string")), F.lit("ZZZ")
    begins = F.when(c("doc_id") % 4 == 0, F.concat(F.lit("Quark Holdings and ("), b, F.lit(".AX) "))).when(c("doc_id") % 4 == 1, F.concat(F.lit("ASX: "), a, F.lit(" ahead of "), b, F.lit(" "))).when(c("doc_id") % 4 == 2, F.concat(F.lit("The "), a, F.lit(" share "))).otherwise("")
    t = table(spark, d, "documents").select(c("doc_id").alias("item_id"), F.explode(F.array(a, b, z)).alias("ticker"), c("source").alias("title"), F.concat(begins, F.coalesce("text", F.lit(""))).alias("body"))
    names = F.when(c("ticker").startswith("Q"), F.array(F.lit("Quark Holdings"))).otherwise(F.array().cast("array<string>"))
    r = linking.competing(t.withColumns({"names": names, "source_is_au": F.lit(False)}))
    return r.select(c("item_id").alias("doc_id"), F.array_join("kept", ",").alias("kept"), F.array_join("ambiguous", ",").alias("ambiguous"), "strong", "medium", "n_ambiguous", "weak", "none")


def layer_comparison(spark, d):
    """The facts' periods without and with the sections that are held back at first."""
    more = facts(spark, d).select(F.concat("company", F.lit("/"), "period").alias("period"), F.when(c("metric") == "cash_closing", "cash_and_equivalents_closing").otherwise(c("metric")).alias("metric"), "conf")
    return sections.layer_comparison(class_rows(spark, d), more)


def text_bullets(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", c("o_orderpriority").alias("p"), c("o_orderstatus").alias("s"))
    k = c("o_orderkey") % 5
    raw = F.when(k == 0, F.concat(F.lit('[" '), "p", F.lit('", "", "'), "s", F.lit('"]'))).when(k == 1, F.concat(F.lit("- "), "p", F.lit(";\n - "), "s", F.lit("\n"))).when(k == 2, F.concat(F.lit("  "), "p", F.lit("; "))).when(k == 3, F.lit(" [] ")).otherwise(" ")
    return o.select("o_orderkey", F.array_join(gates.bullets(raw), "|").alias("bullets"), gates.one_text(raw).alias("text"))


def _reasons() -> str:
    cases = ["case when st not in ('', 'success') then 'report status is ''' || st || '''' end"]
    cases += [f"case when action_id = '{a}' and ({t}) then '{r}' end" for a, rules in gates.RULES.items() for r, t in rules.items()]
    return "array_to_string(list_filter([" + ", ".join(cases) + "], lambda v: v is not null), '; ')"


_HELD = "(k % 3 <> 0 or metric not in ('total_debt', 'total_equity', 'total_assets', 'total_liabilities', 'cash_closing')) and (k % 5 <> 0 or metric not in ('capex', 'operating_cash_flow')) and (k % 7 <> 0 or metric <> 'capex')"
_SUMMARY = filings.SQL["forensic_summary"]
_COUNTS = ("total_periods", "income_only", "full_statements", "multi_section_missing", "balance_gaps", "cash_gaps", "structural_pattern")
_COMPARED = f"with b0 as ({_SUMMARY}), a0 as ({_SUMMARY.replace(_HELD, 'true')}), u as (" + " union all ".join(f"select '{k}' as name, cast(b0.{k} as bigint) as before, cast(a0.{k} as bigint) as after from b0, a0" for k in _COUNTS) + ") select *, after - before as delta from u"

SQL = {
    "action_gates": "with o as (select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice) as bigint) as p from orders), r as (select o_orderkey, [" + ", ".join(f"'{a}'" for a in ACTIONS) + "][o_custkey % 9 + 1] as action_id, case when o_orderstatus = 'P' then 'failed' else 'success' end as st, p % 2 as after_rows, p % 5 as downloaded, case when p % 3 = 0 then 3 else 1 end as min_download, p % 3 as days_completed, p % 4 as errors, p % 2 as found, p % 3 as inserted, p % 5 as processed, p % 7 as request_fail, p % 3 as selected, p % 2 as recovered, p % 5 as failed, p % 11 = 0 as skip_download, p % 7 <> 0 as report_found, p % 2 = 0 as gate_passed from o), g as (select o_orderkey, action_id, " + _reasons() + " as reasons from r) select o_orderkey, action_id, reasons = '' as passed, reasons from g",
    "suite_gates": "with o as (select o_custkey % 500 as suite, month(o_orderdate) % 4 + 1 as b, case when o_orderkey % 400 <> 0 then case when o_custkey % 3 = 0 then month(o_orderdate) % 4 + 1 else day(o_orderdate) % 4 + 1 end end as a from orders), s as (select suite, count(*) as n, count(a) as hits, avg(1.0 / b) as bm, avg(coalesce(1.0 / a, 0)) as am from o group by 1), f as (select suite, concat_ws(',', case when hits <> n then 'hits_scored_mismatch' end, case when hits * 1.0 / n + 1e-12 < 1 then 'hit_rate_regressed' end, case when am + 0.02 + 1e-12 < bm then 'mrr_regressed' end) as failures from s) select suite, failures = '' as passed, failures from f",
    "headline_metrics": "with i as (select coalesce(lang, '') as corpus, doc_id, 'Q' || cast(doc_id % 50 + 10 as varchar) as ticker, doc_id % 5 in (1, 3) or (doc_id % 5 = 0 and doc_id // 5 % 2 = 0) as hit from documents) select corpus, count(*) as n_chunks, round(count(*) filter (where hit) * 100.0 / count(*), 4) as sure_pct, 60 - count(distinct case when hit then ticker end) as tickers_zero_hits from i group by 1",
    "competing_identities": """with d as (select doc_id, doc_id % 4 as k, 'Q' || cast(doc_id % 50 + 10 as varchar) as a, 'WXY' || cast(doc_id % 50 + 10 as varchar) as b from documents)
select doc_id, case k when 0 then a || ',' || b when 1 then a else '' end as kept, case k when 1 then b when 2 then a else '' end as ambiguous, (k = 0)::bigint as strong, (k in (0, 1))::bigint as medium, (k in (1, 2))::bigint as n_ambiguous, 0 as weak, case k when 0 then 1 when 1 then 1 when 2 then 2 else 3 end as none from d""",
    "layer_comparison": _COMPARED,
    "text_bullets": "select o_orderkey, case o_orderkey % 5 when 0 then o_orderpriority || '|' || o_orderstatus when 1 then o_orderpriority || '|' || o_orderstatus when 2 then o_orderpriority || ';' end as bullets, case o_orderkey % 5 when 0 then o_orderpriority || chr(10) || o_orderstatus when 1 then '- ' || o_orderpriority || ';' || chr(10) || ' - ' || o_orderstatus when 2 then o_orderpriority || ';' end as text from orders",
}
QUERIES = {k: globals()[k] for k in SQL}
