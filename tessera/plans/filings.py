"""Registered queries of line-level extraction: lines and rows whose right results are written out by hand, dealt over the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric
from ..functions import filings as ff
from ..operators import extract, filings
from .common import expected_sql, scenarios, table

c = F.col

HITS = [
    ("Total revenue from ordinary activities", "revenue"), ("EBITDA before significant items", "ebitda"), ("Underlying EBIT and net profit after tax", "ebit,net_income,npat"),
    ("Net cash and cash equivalents", "cash_and_equivalents"), ("Net assets", "total_equity"), ("Total current assets", "current_assets"),
    ("Free cash flow guidance for the year", "free_cash_flow,guidance"), ("Basic earnings per share", "eps"), ("Operating income margin CAGR", "ebit,growth_pct"),
    ("Total interest-bearing liabilities", "total_debt"), ("Chairman's address to members", ""), ("Net debt and borrowings", "net_debt,total_debt"), ("Media revenue", "revenue,segment_revenue"),
]


def metric_hits(spark, d):
    r = scenarios(spark, d, [{"line": t} for t, _ in HITS], "line string")
    return r.select("o_orderkey", F.array_join(ff.metric_hits(c("line")), ",").alias("expected"))


VARIANTS = [
    ("ebitda", "Statutory EBITDA", "", "", "statutory", ""), ("ebit", "EBIT", "before significant items", "Underlying results", "underlying_before_significant_items", ""),
    ("revenue", "Revenue excluding one-off items", "", "", "ex_significant_items", ""), ("npat", "Adjusted NPAT excl. non-recurring", "", "", "adjusted_ex_significant_items", ""),
    ("total_assets", "Adjusted total assets", "", "", "", ""), ("total_equity", "Net assets", "", "", "", "net_assets"), ("total_equity", "Total shareholders' funds", "", "", "", "shareholders_funds"),
    ("total_equity", "Equity attributable to owners", "Total equity", "", "", "equity_attributable_to_owners"), ("total_equity", "TOTAL  EQUITY", "", "", "", "total_equity"), ("net_income", "Net profit", "", "", "", ""),
]


def metric_variants(spark, d):
    r = scenarios(spark, d, [dict(zip(("metric", "label", "line", "header"), v, strict=False)) for v in VARIANTS], "metric string, label string, line string, header string")
    return r.select("o_orderkey", ff.metric_variant(c("metric"), c("label"), c("line"), c("header")).alias("variant"), ff.metric_alias(c("metric"), c("label"), c("line")).alias("alias"))


SCOPES = [
    ("", "", "", "other", "empty_context"), ("Revenue 1,200", "Parent entity information", "canonical_report", "parent_statement", "parent_marker"),
    ("Trade receivables 12", "Note 7 Receivables", "canonical_report", "note_disclosure", "note_marker"), ("notes to the accounts", "Statement of financial position", "", "note_disclosure", "note_marker"),
    ("Item 1.1 receipts from customers", "Cash flows", "appendix_report", "appendix_statement", "appendix_source_kind"), ("Revenue 100", "Appendix 4E results", "other", "appendix_statement", "appendix_metric_table"),
    ("Cash 10", "Statement of cash flows", "appendix_report", "appendix_statement", "appendix_layout_source_kind"), ("Total assets 9", "Consolidated statement of financial position", "", "consolidated_statement", "consolidated_layout"),
    ("Total assets 9", "Statement of financial position", "canonical_report", "consolidated_statement", "canonical_layout_source_kind"), ("Total assets 9", "Balance sheet", "other", "other", "layout_without_scope_marker"),
    ("lodged today", "Appendix 4C", "other", "other", "appendix_marker_without_layout"), ("Our strategy", "Chairman letter", "other", "narrative", "presentational_context"), ("Drilling at depth", "Site works", "other", "other", "fallback_other"),
]


def statement_scope(spark, d):
    r = scenarios(spark, d, [dict(zip(("block", "header", "kind"), v, strict=False)) for v in SCOPES], "block string, header string, kind string")
    return r.select("o_orderkey", ff.statement_scope(c("block"), c("header"), c("kind")).alias("s")).select("o_orderkey", "s.scope", "s.reason")


FAMILIES = [
    ("Consolidated statement of cash flows", "", "", "cash_flow"), ("Statement of profit or loss", "", "", "income_statement"), ("Statement of changes in equity", "", "", "equity_statement"),
    ("Opening balance of reserves", "", "", "equity_statement"), ("Reserves in the balance sheet", "", "", "balance_sheet"), ("Statement of financial position", "consolidated_statement", "", "balance_sheet"),
    ("Other comprehensive income", "", "", "equity_statement"), ("Comprehensive income", "", "", "income_statement"), ("Review of drilling", "", "", "other"), ("", "", "", "other"),
    ("Appendix 4E", "appendix_statement", "revenue up 10", "income_statement"), ("Appendix 4D", "appendix_statement", "net assets", "balance_sheet"), ("Appendix 4C", "appendix_statement", "receipts", "cash_flow"),
]


def statement_family(spark, d):
    r = scenarios(spark, d, [dict(zip(("title", "scope", "context"), v, strict=False)) for v in FAMILIES], "title string, scope string, context string")
    return r.select("o_orderkey", ff.statement_family(c("title"), c("scope"), c("context")).alias("expected"))


AMOUNTS = [
    ("Revenue for the Group from ordinary activities of $73.671 million was up by 28%", "$73.671 million", 73671000.0), ("2.1 Revenue from customers 12,345 11,200", "12,345", 12345.0),
    ("Revenue Note 18 4,500", "4,500", 4500.0), ("Revenue (1,250) 900", "(1,250)", -1250.0), ("Revenue in 2024", None, None), ("Revenue at 30 June was strong", None, None),
    ("Revenue US$5.2m in the half", "US$5.2m", 5200000.0), ("Revenue 5", None, None), ("Revenue of the 4th quarter $1,000", "$1,000", 1000.0), ("Revenue 1,500 12% 1,300", "1,500", 1500.0), ("Revenue AASB-16 250", "250", 250.0),
]


def amount_rank(spark, d):
    r = scenarios(spark, d, [{"line": t[0]} for t in AMOUNTS], "line string")
    r = ff.ranked_amounts(r.withColumn("metric", F.lit("revenue")), "line", "metric", ff.METRICS["revenue"])
    return r.select("o_orderkey", F.try_element_at("amounts", F.lit(1)).alias("b")).select("o_orderkey", "b.raw", "b.value")


CONFIDENCES = [
    ("percent", "gross_margin_pct", "35%", "", "FY24", "consolidated_statement", True, 0.9), ("amount", "revenue", "$73.6 million", "$", "", "consolidated_statement", True, 1.0), ("amount", "revenue", "1,200", "", "", "", False, 0.7),
    ("amount", "revenue", "1,200", "", "FY24", "note_disclosure", True, 0.0), ("amount", "revenue", "1,200", "", "", "appendix_statement", False, 0.0), ("text", "guidance", "expects growth", "", "FY25", "", False, 0.5),
    ("amount", "revenue", "5.25", "", "", "appendix_statement", True, 0.75), ("text", "revenue", "", "", "", "", True, 0.35),
]


def field_confidence(spark, d):
    names = ("value_type", "metric", "raw", "currency", "period", "scope", "inside")
    r = scenarios(spark, d, [dict(zip(names, v, strict=False)) for v in CONFIDENCES], "value_type string, metric string, raw string, currency string, period string, scope string, inside boolean")
    return r.select("o_orderkey", ff.field_confidence(*[c(n) for n in names]).alias("expected"))


CANONICAL = [
    ("revenue", "consolidated_statement", "income_statement", "30 June 2024", "Total revenue", "", "30 June 2024 30 June 2023", "Income statement", 4), ("revenue", "other", "balance_sheet", "", "Sundry", "", "", "", -1),
    ("revenue", "consolidated_statement", "income_statement", "FY24", "Revenue", "", "2024 2023", "Income statement", 3), ("net_debt", "consolidated_statement", "balance_sheet", "", "Net debt waterfall", "", "Movement 2024", "Net debt waterfall", 2),
    ("total_assets", "appendix_statement", "balance_sheet", "Q4 2024", "Total assets", "", "31 December 2024 30 June 2024", "Group", 3), ("capex", "note_disclosure", "cash_flow", "", "Payments", "net assets disposed", "A B", "Page 3 of 9", -1),
]


def canonical_confidence(spark, d):
    names = ("metric", "scope", "family", "period", "label", "line", "header", "title")
    r = scenarios(spark, d, [dict(zip(names, v, strict=False)) for v in CANONICAL], ", ".join(f"{n} string" for n in names))
    return r.select("o_orderkey", ff.canonical_confidence(*[c(n) for n in names]).cast("int").alias("expected"))


PERIODS = [
    ("30 June 2024", "2024-06-30"), ("Year ended 31 Dec 2023", "2023-12-31"), ("FY2024", "2024-12-31"), ("FY 24", "2024-12-31"), ("2022", "2022-12-31"), ("Q3 2024", "2024-09-30"), ("Q1-24", "2024-03-31"),
    ("Current quarter - 15 May 2024", "2024-03-31"), ("Previous quarter - 15 May 2024", "2023-12-31"), ("Previous quarter - 30 June 2024", "2024-06-30"), ("Quarter ended 10 October 2024", "2024-09-30"), ("31 Febuary 2024", "2024-12-31"), ("half year", None), ("", None),
    ("31 M a r c h 2025", "2025-03-31"), ("31 March 31 December 2025 2024", "2025-12-31"),
]


def period_ends(spark, d):
    r = scenarios(spark, d, [{"label": t} for t, _ in PERIODS], "label string")
    return r.select("o_orderkey", dates.period_end(c("label")).alias("expected"))


LABELS = [
    ("For the year ended 30 June 2024 and 31 December 2023", "For the year ended 30 June 2024|31 December 2023"), ("FY24 against FY23", "FY24|FY23"), ("2024 2023", "2024|2023"), ("Current quarter 2024", "Current quarter"),
    ("quarter ended 31 March 2024 (Q1 24)", "quarter ended 31 March 2024|Q1 24"), ("no period", ""),
]


def line_periods(spark, d):
    r = scenarios(spark, d, [{"line": t} for t, _ in LABELS], "line string")
    return r.select("o_orderkey", F.array_join(dates.period_labels(c("line")), "|").alias("expected"))


def quarter_ends(spark, d):
    """Quarter ends about each order's day."""
    day = c("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", dates.quarter_end_on_or_before(day).alias("this_end"), dates.previous_quarter_end(dates.quarter_end_on_or_before(day)).alias("previous_end"), dates.is_quarter_end(day).alias("at_end"), dates.period_key(day.cast("string")).alias("period_key"))


UNITS = [
    ("$'000", 1000.0, "$"), ("A$'000 2024", 1000.0, "A$"), ("(in thousands of US$)", 1000.0, "US$"), ("NZ$ million", 1000000.0, "NZ$"), ("in millions of EUR", 1000000.0, "€"), ("in billions", 1000000000.0, ""), ("CA$ 5", None, "C$"), ("£5", None, "£"),
    ("€ 7", None, "€"), ("$ 12", None, "$"), ("no hint", None, ""), ("C$ and A$ bn", 1000000000.0, "C$"), ("US$ bn", 1000000000.0, "US$"),
]


def unit_hints(spark, d):
    r = scenarios(spark, d, [{"line": t[0]} for t in UNITS], "line string")
    return r.select("o_orderkey", numeric.unit_multiplier(c("line")).alias("multiplier"), numeric.currency_hint(c("line")).alias("currency"))


WORDS = [
    ("12,345", "amount", 12345.0, "", "", False), ("(1,250)", "amount", -1250.0, "", "", False), ("US$5.2m", "amount", 5200000.0, "US$", "m", False), ("2024", "amount", 2024.0, "", "", True), ("12", "amount", 12.0, "", "", True), ("3.5", "amount", 3.5, "", "", True),
    ("35%", "percent", 35.0, "", "", False), ("(4.5)%", "percent", -4.5, "", "", False), ("$7", "amount", 7.0, "$", "", False), ("Note", None, None, None, None, None), ("1,23", None, None, None, None, None), ("", None, None, None, None, None),
]


def number_words(spark, d):
    r = scenarios(spark, d, [{"word": t[0]} for t in WORDS], "word string")
    return r.select("o_orderkey", numeric.numeric_word(c("word")).alias("w")).select("o_orderkey", "w.value_type", "w.value", "w.currency", "w.suffix", "w.minor")


SCALED = [("1,200", "amount", "revenue", 1200.0, 1200000.0), ("1.2 million", "amount", "revenue", 1200000.0, 1200000.0), ("5m", "amount", "ebit", 5000000.0, 5000000.0), ("12", "amount", "eps", 12.0, 12.0), ("35", "percent", "revenue", 35.0, 35.0)]


def unit_applied(spark, d):
    r = scenarios(spark, d, [dict(zip(("raw", "kind", "metric", "value"), v, strict=False)) for v in SCALED], "raw string, kind string, metric string, value double")
    return r.select("o_orderkey", numeric.apply_multiplier(c("value"), F.lit(1000.0), c("raw"), (c("kind") == "amount") & c("metric").isin(*ff.MONEY)).alias("expected"))


HEADINGS = [
    ("7. Liquidity risk", "liquidity risk"), ("STATEMENT OF CASH FLOWS", "statement of cash flows"), ("Review of Operations", "review of operations"), ("we grew revenue by 20% over the year.", ""), ("Cash at bank 1,200", ""), ("Short sentence heading", "short sentence heading"), ("and then it went", ""), ("", ""),
]


def section_headings(spark, d):
    r = scenarios(spark, d, [{"line": t} for t, _ in HEADINGS], "line string")
    h = ff.section_heading(c("line"))
    return r.select("o_orderkey", h.alias("expected"))


PATHS = [
    ("data/docs/BHP/annual/2024-08-27 report.pdf", "BHP", "annual", "2024-08-27"), ("x/CBA/results.pdf", "CBA", "", ""), ("docs/RIO/half/2024_02_30 bad.pdf", "RIO", "half", ""), ("plain.pdf", "", "", ""), ("/mnt/2023-01-05/WES/q.pdf", "WES", "", "2023-01-05"), ("docs/ABC", "ABC", "", ""),
]


def path_parts(spark, d):
    r = scenarios(spark, d, [{"path": t[0]} for t in PATHS], "path string")
    return r.select("o_orderkey", ff.path_parts(c("path")).alias("p")).select("o_orderkey", "p.company", "p.doc_type", "p.doc_date")


NAMES = [("NPAT ", "net_income"), ("cash", "cash_and_equivalents"), ("total_borrowings", "total_debt"), ("Capex", "capital_expenditure"), ("revenue", "revenue"), (None, "")]


def metric_names(spark, d):
    r = scenarios(spark, d, [{"metric": t} for t, _ in NAMES], "metric string")
    return r.select("o_orderkey", ff.metric_name(c("metric")).alias("expected"))


_ROW = {"metric": "revenue", "row_label": "Total revenue", "line": "", "table_header_text": "30 June 2024 30 June 2023", "statement_title": "Income statement", "statement_scope_header": "", "statement_scope": "consolidated_statement", "statement_family": "income_statement", "statement_period_end": "2024-06-30", "period": "30 June 2024", "inside_table": True, "pro_forma": False, "label_hits": 1}
_BALANCE = {"metric": "total_liabilities", "row_label": "Total liabilities", "statement_title": "Balance sheet", "statement_family": "balance_sheet"}
ROUTES = [
    ({}, "canonical"), ({"inside_table": False}, "not_inside_table"), ({"pro_forma": True}, "pro_forma_context"), ({"line": "net assets disposed"}, "reconciliation_context"), ({"line": "contributed revenue of $5m"}, "acquisition_contribution_context"),
    ({"statement_family": "balance_sheet"}, "metric_statement_mismatch"), ({"row_label": "• Revenue"}, "narrative_row_label"), ({"row_label": "Our revenue"}, "narrative_row_label"), (_BALANCE | {"metric": "current_assets", "row_label": "Non-current assets"}, "non_current_row_label"),
    ({"label_hits": 2}, "ambiguous_row_label"), (_BALANCE | {"metric": "net_debt", "row_label": "Less: net debt"}, "component_adjustment_row"), (_BALANCE | {"row_label": "Total liabilities and equity", "label_hits": 2}, "combined_liabilities_equity_row"),
    (_BALANCE | {"metric": "cash_and_equivalents", "row_label": "Cash and net assets"}, "cash_reconciliation_context"), (_BALANCE | {"metric": "cash_and_equivalents", "row_label": "Cash award"}, "cash_keyword_false_positive"),
    (_BALANCE | {"metric": "cash_and_equivalents", "row_label": "Net increase in cash and cash equivalents"}, "cash_non_balance_context"), ({"metric": "npat", "row_label": "Total comprehensive income"}, "comprehensive_income_context"), ({"statement_period_end": ""}, "missing_statement_period_end"),
    ({"statement_scope": "parent_statement"}, "non_canonical_scope"), ({"row_label": "Sales", "period": "", "statement_title": "Page 1 of 2", "table_header_text": "x", "statement_family": "other"}, "low_canonical_confidence"), ({"statement_period_end": "2024-06-14"}, "canonical"),
    (_BALANCE | {"metric": "free_cash_flow", "row_label": "Free cash flow of", "statement_family": "cash_flow", "statement_title": "Cash flows"}, "narrative_row_label"), ({"statement_family": "cash_flow"}, "canonical"),
]


def scope_routes(spark, d):
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in _ROW.items())
    r = filings.route(scenarios(spark, d, [_ROW | change for change, _ in ROUTES], kinds))
    return r.select("o_orderkey", "reason", "route", "statement_period_end")


def route_rows(spark, d):
    """How many rows go where and why."""
    return scope_routes(spark, d).groupBy("reason", "route").agg(F.count("*").alias("n_rows"))


def _route_sql():
    ends = ["" if reason == "missing_statement_period_end" else "2024-06-30" for _, reason in ROUTES]
    return expected_sql([(reason, {"canonical": "canonical", "not_inside_table": "rejected"}.get(reason, "context"), end) for (_, reason), end in zip(ROUTES, ends, strict=True)], names=("reason", "route", "statement_period_end"))


_FAULT = {"metric": "revenue", "period": "FY24", "statement_period_end": "2024-06-30", "balance_date": "", "statement_title": "Income statement", "line": "", "row_label": "Revenue"}
FAULTS = [
    ({}, ""), ({"period": ""}, "empty_period"), ({"statement_period_end": None, "period": "Current quarter"}, "empty_statement_period_end,relative_only_period"), ({"metric": "cash_and_equivalents_opening"}, "split_missing_balance_date"),
    ({"statement_title": "12"}, "numeric_only_statement_title"), ({"statement_title": "Page 3 of 10"}, "page_footer_statement_title"), ({"statement_title": "This should be read in conjunction"}, "trailing_note_statement_title"),
    ({"metric": "cash_and_equivalents", "line": "Cash and cash equivalents at the end of the year"}, "cash_unsplit_end_phrase"), ({"metric": "cash_and_equivalents", "line": "cash and cash equivalents at beginning of year"}, "cash_unsplit_begin_phrase"),
    ({"row_label": ""}, "non_cash_missing_row_label"), ({"metric": "ebit", "row_label": "Revenue"}, "non_cash_label_metric_mismatch"),
]


def row_issues(spark, d):
    r = scenarios(spark, d, [_FAULT | change for change, _ in FAULTS], ", ".join(f"{k} string" for k in _FAULT))
    return r.select("o_orderkey", F.array_join(filings.row_issues(r), ",").alias("expected"))


def issue_multilabel(spark, d):
    r = scenarios(spark, d, [_FAULT | change for change, _ in FAULTS], ", ".join(f"{k} string" for k in _FAULT))
    return r.select(F.explode(filings.row_issues(r)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n_rows"))


CELLS = [
    ({"header": "31 December 2024 31 December 2023", "column": 0, "n_columns": 2}, "2024-12-31"), ({"header": "31 December 2024 31 December 2023", "column": 1, "n_columns": 2}, "2023-12-31"), ({"header": "30 June 2024 30 June 2023", "column": 2, "n_columns": 3}, "2023-06-30"),
    ({"header": "", "context": "Half year ended 31 December 2022", "column": 0, "n_columns": 1}, "2022-12-31"), ({"header": "2024 2023", "document_hint": "Year ended 30 June 2024", "column": 1, "n_columns": 2}, "2023-06-30"), ({"header": "2024 2023", "column": 0, "n_columns": 2}, "2024-12-31"),
    ({"header": "31 December 2024 31 December 2023", "label": "Cash at 30 June", "column": 0, "n_columns": 2}, "2024-06-30"), ({"header": "", "column": 0, "n_columns": 1}, None),
]


def column_period(spark, d):
    base = {"header": "", "context": "", "document_hint": "", "label": ""}
    r = scenarios(spark, d, [base | x for x, _ in CELLS], "header string, context string, document_hint string, label string, column int, n_columns int")
    return filings.column_periods(r).select("o_orderkey", c("period").alias("expected"))


def header_columns(spark, d):
    """Figures at places across a page under the nearest of four columns."""
    centres = F.array(*map(F.lit, (100.0, 180.0, 260.0, 340.0)))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") * 9).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", numeric.nearest(c("x"), centres, 36.0).alias("column"))


_LINE_NO = "row_number() over (partition by doc_id order by line_no) - 1"


def _numbered(spark, d):
    from .texts import _lines

    return _lines(spark, d).select("doc_id", "line_no", F.when(F.length("line") % 3 == 0, F.length("line")).alias("number"))


def near_numbers(spark, d):
    """Lengths that three divides stand for the figures on lines."""
    r = filings.near_numbers(_numbered(spark, d), "doc_id")
    return r.groupBy("doc_id").agg(F.count("near_number").alias("n_found"), F.sum("near_number").cast("long").alias("total"))


def _documents_as_pages(spark, d):
    from .texts import _lines

    t = _lines(spark, d)
    p = filings.numeric_pages(t.select("doc_id", F.regexp_replace("line", "[aeiou]", "1,000 ").alias("line")), "doc_id")
    return p.select(F.floor(c("doc_id") / 20).alias("file"), (c("doc_id") % 20).cast("int").alias("page"), F.when(c("doc_id") % 5 == 0, F.concat(F.lit("s"), (c("doc_id") % 3).cast("string"))).alias("section"), "is_numeric", "dense_lines")


def section_pages(spark, d):
    return filings.section_pages(_documents_as_pages(spark, d), ["file"]).select("file", "page", "dense_lines", "is_numeric", "in_section")


def _fact_rows(spark, d):
    """Facts with labels that the checks look for, a file a company."""
    from .common import facts

    named = {"cash_opening": "cash_and_equivalents_opening", "cash_closing": "cash_and_equivalents_closing", "capex": "dividends_paid", "investing_cash_flow": "retained_open", "financing_cash_flow": "retained_close"}
    metric = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in named.items() for x in p]), c("metric")), c("metric"))
    label = F.when(c("metric") == "net_cash_movement", "Net increase in cash and cash equivalents").when(c("metric") == "capex", "Dividends paid").when(c("metric") == "investing_cash_flow", "Opening retained earnings").when(c("metric") == "financing_cash_flow", "Closing retained earnings").when(c("metric") == "total_debt", "Total expenses").otherwise(c("metric"))
    return facts(spark, d).select(c("company").alias("file"), "period", metric.alias("metric"), label.alias("row_label"), F.lit("").alias("line"), "value", "conf", c("ord").alias("line_no"))


def integrity_index(spark, d):
    return filings.integrity(_fact_rows(spark, d))


def statement_rollup(spark, d):
    i = filings.integrity(_fact_rows(spark, d))
    rows = i.select(F.concat(F.lit("docs/"), "file", F.lit("/x.pdf")).alias("file"), F.substring("period", 1, 4).alias("period"), "balance_sheet", "cash_bridge", "integrity_score", "anomaly_level", c("period").alias("label"), c("evaluated").alias("conf"), F.lit(0.5).alias("confidence"), F.month(F.to_date("period")).alias("line_no"))
    return filings.statement_rollup(rows, ["balance_sheet", "cash_bridge"])


def integrity_enriched(spark, d):
    """Facts with the score of their statement; a quarter of the statements aren't in the index."""
    from .common import facts

    index = filings.integrity(_fact_rows(spark, d)).where("month(to_date(period)) % 4 <> 0")
    rows = facts(spark, d).select(c("company").alias("file"), "period", "metric", "ord", c("integrity").alias("integrity_score"), F.lit("UNKNOWN").alias("anomaly_level"))
    return filings.with_integrity(rows, index).groupBy("file", "metric", "anomaly_level").agg(F.count("*").alias("n_rows"), F.sum("integrity_score").cast("long").alias("total_score"))


def fallback_values(spark, d):
    """An order's value by (customer, year), else by customer: the first lookup has every other order only."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    exact = o.where("o_orderkey % 2 = 0").groupBy("o_custkey", "year").agg(F.max("o_totalprice").alias("best"))
    general = o.where("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    return filings.fallback_lookup(o.select("o_orderkey", "o_custkey", "year"), exact, general, ["o_custkey", "year"], ["o_custkey"], "best").select("o_orderkey", "best", "best_from")


def _class_rows(spark, d):
    from .common import facts

    named = {"cash_closing": "cash_and_equivalents_closing", "capex": "capex"}
    f = facts(spark, d).where("(k % 3 <> 0 or metric not in ('total_debt', 'total_equity', 'total_assets', 'total_liabilities', 'cash_closing')) and (k % 5 <> 0 or metric not in ('capex', 'operating_cash_flow')) and (k % 7 <> 0 or metric <> 'capex')")
    metric = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in named.items() for x in p]), c("metric")), c("metric"))
    return f.select(F.concat("company", F.lit("/"), "period").alias("period"), metric.alias("metric"), "conf")


def statement_class(spark, d):
    return filings.period_classes(_class_rows(spark, d)).select("period", "classification", "missing_balance", "debt_missing", "cash_missing", "n_metrics")


def forensic_summary(spark, d):
    return filings.forensic_summary(filings.period_classes(_class_rows(spark, d)))


def identity_guard(spark, d):
    """Facts in which every seventh statement's liabilities repeat its assets."""
    from .common import facts

    f = facts(spark, d)
    w = f.where("metric in ('total_assets', 'total_liabilities', 'total_equity')")
    value = F.when((c("metric") == "total_liabilities") & (c("k") % 7 == 0), F.max(F.when(c("metric") == "total_assets", c("value"))).over(_by_statement())).otherwise(c("value"))
    label = F.when(c("metric") == "total_liabilities", F.when(c("k") % 2 == 0, "Total liabilities").otherwise("Liabilities")).when(c("metric") == "total_assets", "Total assets").otherwise("Total equity")
    rows = w.withColumn("value", value).select(c("company").alias("file"), "period", "metric", label.alias("row_label"), "value", "conf", "ord")
    return filings.identity_guard(rows).groupBy("file", "metric", "demoted").agg(F.count("*").alias("n_rows"))


def _by_statement():
    from pyspark.sql import Window

    return Window.partitionBy("company", "period")


def row_ids(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ff.row_id(c("l_orderkey"), c("l_linenumber"), c("l_returnflag"), F.lit(None).cast("string")).alias("row_id"))


SLUGS = [("Annual Report (2024).pdf", "Annual_Report_2024_.pdf"), ("  a/b c  ", "a_b_c"), ("...", ""), (None, ""), ("ok-name_1", "ok-name_1")]


def slugs(spark, d):
    r = scenarios(spark, d, [{"name": t} for t, _ in SLUGS], "name string")
    return r.select("o_orderkey", ff.slug(c("name")).alias("expected"))


PHRASES = [
    ("", "Purchases of property, plant and equipment (5)", True, 1.0, "capital_expenditure", 3.0), ("cash_and_equivalents", "Net cash from operating activities", True, 4.0, "operating_cash_flow", 4.0), ("cash_and_equivalents", "Capex", True, 1.0, "capex", 3.0),
    ("cashflow_unmapped", "Net operating cash flow 7", True, None, "operating_cash_flow", 3.0), ("", "Impairment of property, plant and equipment", True, 1.0, "", 1.0), ("cash_and_equivalents_closing", "Total cash and cash equivalents", True, 2.0, "cash_and_equivalents_closing", 2.0),
    ("", "Capital expenditure", False, 1.0, "", 1.0), ("revenue", "Capital expenditure", True, 1.0, "revenue", 1.0),
]


def cash_phrases(spark, d):
    r = scenarios(spark, d, [dict(zip(("metric", "line", "number", "confidence"), v, strict=False)) for v in PHRASES], "metric string, line string, number boolean, confidence double")
    return r.select("o_orderkey", ff.coerced_metric(c("metric"), c("line"), c("number"), c("confidence")).alias("x")).select("o_orderkey", "x.metric", "x.confidence")


ENDS = [("2024-06-30", "FY23", "", "2024-06-30"), ("", "Year ended 30 June 2023", "FY22", "2023-06-30"), (" ", "", "Q1 24", "2024-03-31"), (None, None, None, "")]


def repaired_ends(spark, d):
    r = scenarios(spark, d, [dict(zip(("end", "a", "b"), v, strict=False)) for v in ENDS], "end string, a string, b string")
    return r.select("o_orderkey", ff.repaired_end(c("end"), c("a"), c("b")).alias("expected"))


SAID = [
    ("Underlying EBIT for FY24 was $5.2 million", "ebit", "underlying", "amount", 5200000.0, "FY24"), ("Gross margin of 35% against 12% before", "gross_margin_pct", "", "percent", 35.0, ""), ("Net assets 1,250 1,100", "total_equity", "", "amount", 1250.0, ""),
    ("We give no guidance", "guidance", "", "text", None, ""), ("Total assets at 30 June 2024 9,000", "total_assets", "", "amount", 9000.0, "30 June 2024"),
]


def parsed_lines(spark, d):
    r = extract.parsed_lines(scenarios(spark, d, [{"line": t[0]} for t in SAID], "line string"))
    return r.select("o_orderkey", "metric", "variant", "value_type", "value", "period")


PAGE = [
    ("Consolidated statement of financial position", None), ("As at 30 June 2024 $'000", None), ("Total assets 9,000 8,000", ("total_assets", 9000000.0, "2024-06-30", "consolidated_statement", 0.75)), ("Total liabilities 5,000 4,000", ("total_liabilities", 5000000.0, "2024-06-30", "consolidated_statement", 0.75)),
    ("Note 7 Receivables", None), ("Total assets of the joint venture 1,000", ("total_assets", 1000.0, "", "note_disclosure", 0.0)),
]


def block_metrics(spark, d):
    """Every twentieth order is a page of these lines."""
    o = table(spark, d, "orders").where("o_orderkey % 20 = 0").select("o_orderkey", F.posexplode(F.array(*[F.lit(t) for t, _ in PAGE])).alias("line_no", "line"))
    return extract.block_metrics(o, "o_orderkey").select("o_orderkey", "metric", "value", "period_end", "scope", "confidence")


def rebalanced_periods(spark, d):
    """Some columns of one row a file: dates repeat, and two are missing."""
    l = table(spark, d, "orders").select(c("o_orderkey").alias("file"), F.explode(F.sequence(F.lit(1), (c("o_orderkey") % 5 + 1).cast("int"))).alias("ordinal"))
    rows = l.select("file", F.lit(1).alias("page"), F.lit("capex").alias("metric"), F.lit("x").alias("label"), "ordinal", F.when(c("ordinal") == 3, "").otherwise("2024-06-30").alias("period_end"))
    missing = l.select("file").distinct().select("file", F.explode(F.array(F.lit("2023-06-30"), F.lit("2023-12-31"))).alias("period_end"))
    return extract.rebalanced_periods(rows, missing).select("file", "ordinal", "period_end")


def selected_debt(spark, d):
    from .common import facts

    return extract.selected(facts(spark, d), ["net_debt", "total_debt", "total_liabilities"], 2)


def supported_signals(spark, d):
    from ..operators import risk, warehouse
    from .common import facts
    from .warehouse import SPREAD, _ratios

    support = warehouse.presence(facts(spark, d), SPREAD).where("month(to_date(period)) <> 5").select("company", "period", c("completeness").alias("support"))
    s = extract.supported(risk.leverage_and_liquidity(_ratios(spark, d), "institutional"), support)
    return s.groupBy("signal_name", "risk_confidence").agg(F.count("*").alias("n"), F.round(F.sum("support"), 4).alias("support"))


def soft_recall(spark, d):
    """A customer's orders: the three dearest of the twelve newest."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    r = extract.soft_recall(o, "o_custkey", 3, 4, [F.desc("o_orderdate"), "o_orderkey"], [F.desc("o_totalprice"), "o_orderkey"])
    return r.select("o_custkey", "o_orderkey", c("rank").cast("long").alias("rank"))


SCORED = [("Widget Group Limited", 10, "WID", 53), ("WID", 10, "wid", -70), ("Results announcement", 5, "X", -7), ("Commonwealth Bank of Australia", 0, "CBA", 70)]


def name_scores(spark, d):
    r = scenarios(spark, d, [dict(zip(("name", "weight", "ticker"), v, strict=False)) for v in SCORED], "name string, weight int, ticker string")
    return r.select("o_orderkey", extract.name_score(c("name"), c("weight"), c("ticker")).cast("int").alias("expected"))


def best_names(spark, d):
    """Candidates of a nation's name: the nation's itself, often, and its region's with a company's form, once."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select(c("n_nationkey").cast("string").alias("ticker"), "n_name", "r_name")
    names = n.select("ticker", F.explode(F.array(F.struct(c("n_name").alias("name"), F.lit(10).alias("weight")), F.struct(F.lower("n_name").alias("name"), F.lit(12).alias("weight")), F.struct(F.concat("r_name", F.lit(" Limited")).alias("name"), F.lit(3).alias("weight")))).alias("x")).select("ticker", "x.*")
    return extract.best_names(names)


HEADLINES = [
    ("ASX: BHP lifts output", False, "BHP", True), ("CAT shares jump", True, "CAT", True), ("CAT shares jump", False, "CAT", False), ("Top CAT shares jump as cat show opens", True, "CAT", False), ("RIO dividend up", False, "RIO", True), ("XYZ shares up", True, None, None), ("(CAT.AX) on the move", True, "CAT", False),
]


def headline_tickers(spark, d):
    h = scenarios(spark, d, [dict(zip(("title", "source_is_au"), v, strict=False)) for v in HEADLINES], "title string, source_is_au boolean").withColumnRenamed("o_orderkey", "id")
    symbols = spark.range(1).select(F.explode(F.array(*map(F.lit, ("BHP", "CAT", "RIO", "KIT")))).alias("ticker"))
    collisions = spark.range(1).select(F.lit("CAT").alias("ticker"), F.lit("cat show").alias("phrase"))
    names = spark.range(1).select(F.explode(F.array(F.struct(F.lit("KIT").alias("ticker"), F.lit("Kit").alias("name")), F.struct(F.lit("RIO").alias("ticker"), F.lit("Rio Tinto Limited").alias("name")))).alias("n")).select("n.*")
    return extract.headline_tickers(h, symbols, extract.ambiguous_tickers(names, collisions), collisions, ["shares", "dividend"])


def _sql():
    from .common import FACTS_SQL
    from .texts import _LINES

    first = lambda rows, n=0: [tuple(r)[n] for r in rows]
    best = lambda name, test: f"arg_max(value, (conf, line_no)) filter (where {test} and value is not null) as {name}"
    m = lambda x: f"metric = '{x}'"
    rows = FACTS_SQL + """, fr as (select company as file, period, value, conf, ord as line_no, metric from facts),
it as (select file, period, """ + ", ".join([best("a", m("total_assets")), best("l", m("total_liabilities")), best("e", m("total_equity")), best("o", m("cash_opening")), best("cl", m("cash_closing")), best("mv", m("net_cash_movement")), best("ro", m("investing_cash_flow")), best("rc", m("financing_cash_flow")), best("dv", m("capex")), best("np", m("npat")), best("rv", m("revenue")), best("eb", m("ebit")), best("ex", m("total_debt"))]) + """ from fr group by 1, 2),
pr as (select *, case when abs(rc - (ro + np + dv)) <= abs(rc - (ro + np - abs(dv))) then ro + np + dv else ro + np - abs(dv) end as pred from it),
ck as (select file, period, coalesce((abs(a - (l + e)) <= greatest(1.0, 0.02 * greatest(abs(a), abs(l + e), 1.0)))::int, -1) as balance_sheet, coalesce((abs(cl - o - mv) <= greatest(1.0, 0.03 * greatest(abs(cl - o), abs(mv), 1.0)))::int, -1) as cash_bridge,
  coalesce(case when rc is null or ro is null or np is null or dv is null then null else (abs(rc - pred) <= greatest(1.0, 0.05 * greatest(abs(rc), abs(pred), 1.0)))::int end, -1) as retained_earnings, coalesce((abs(rv - ex - eb) <= greatest(1.0, 0.05 * greatest(abs(rv - ex), abs(eb), 1.0)))::int, -1) as income from pr),
cn as (select *, (balance_sheet = 1)::int + (cash_bridge = 1)::int + (retained_earnings = 1)::int + (income = 1)::int as passed, (balance_sheet = 0)::int + (cash_bridge = 0)::int + (retained_earnings = 0)::int + (income = 0)::int as failed from ck),
ix as (select *, passed + failed as evaluated, 4 - failed as integrity_score, case when passed + failed = 0 then 'UNKNOWN' when failed >= 2 then 'HIGH' when failed = 1 then 'MEDIUM' else 'LOW' end as anomaly_level from cn) """
    drop = "(k % 3 <> 0 or metric not in ('total_debt', 'total_equity', 'total_assets', 'total_liabilities', 'cash_closing')) and (k % 5 <> 0 or metric not in ('capex', 'operating_cash_flow')) and (k % 7 <> 0 or metric <> 'capex')"
    classes = FACTS_SQL + f""", cm as (select company || '/' || period as period, bool_or(metric = 'revenue') as r, bool_or(metric = 'ebit') as eb, bool_or(metric = 'npat') as np, bool_or(metric = 'total_assets') as ta, bool_or(metric = 'total_liabilities') as tl, bool_or(metric = 'total_equity') as te, bool_or(metric = 'cash_closing') as ca, bool_or(metric = 'total_debt') as td, bool_or(metric = 'operating_cash_flow') as oc, bool_or(metric = 'capex') as cx, bool_or(metric = 'free_cash_flow') as fc, count(distinct metric) as n_metrics from facts where {drop} group by 1),
cb as (select *, ta::int + tl::int + te::int + ca::int + td::int as nb from cm),
cf as (select *, r and eb and np as ic, nb = 5 as bc, (oc and cx) or fc as cc, nb between 1 and 4 as bp, oc <> cx or (fc and not (oc and cx)) as cp from cb),
cz as (select period, case when ic and bc and cc then 'FULL_STATEMENTS_PRESENT' when ic and nb = 0 and not cc and not cp then 'INCOME_ONLY' when bp and not cp then 'BALANCE_SHEET_PARTIAL' when cp and not bp then 'CASHFLOW_PARTIAL' else 'MULTI_SECTION_MISSING' end as classification,
  concat_ws(',', case when not ca then 'cash_and_equivalents' end, case when not ta then 'total_assets' end, case when not td then 'total_debt' end, case when not te then 'total_equity' end, case when not tl then 'total_liabilities' end) as missing_balance, not td and nb >= 2 as debt_missing, not ca and nb >= 2 as cash_missing, n_metrics, cp from cf) """
    lines = f"with {_LINES}, n as (select doc_id, line_no, case when length(line) % 3 = 0 then length(line) end as number from ln), "
    pages = f"with {_LINES}, k as (select doc_id, count(*) filter (where len(regexp_extract_all(regexp_replace(line, '[aeiou]', '1,000 ', 'g'), '\\d{{1,3}}(?:,\\d{{3}})+|\\d{{4,}}')) >= 2) as dense_lines from ln group by 1), p as (select doc_id // 20 as file, cast(doc_id % 20 as int) as page, case when doc_id % 5 = 0 then 's' || cast(doc_id % 3 as varchar) end as section, dense_lines, dense_lines >= 3 as is_numeric from k), g as (select *, page - lag(page) over (partition by file order by page) as step from p), s as (select *, sum((section is not null or not is_numeric or coalesce(step > 1, true))::int) over (partition by file order by page) as run from g) select file, page, dense_lines, is_numeric, first_value(section) over (partition by file, run order by page) as in_section from s"
    near = lambda n: f"case when {('lead' if n > 0 else 'lag')}(line_no, {abs(n)}) over w = line_no + {n} then {('lead' if n > 0 else 'lag')}(number, {abs(n)}) over w end"
    return {
        "metric_hits": expected_sql(first(HITS, 1)),
        "metric_variants": expected_sql([v[4:] for v in VARIANTS], names=("variant", "alias")),
        "statement_scope": expected_sql([v[3:] for v in SCOPES], names=("scope", "reason")),
        "statement_family": expected_sql(first(FAMILIES, 3)),
        "amount_rank": expected_sql([v[1:] for v in AMOUNTS], names=("raw", "value")),
        "field_confidence": expected_sql(first(CONFIDENCES, 7)).replace("expected from", "cast(expected as double) as expected from"),
        "canonical_confidence": expected_sql(first(CANONICAL, 8)),
        "period_ends": expected_sql(first(PERIODS, 1)),
        "line_periods": expected_sql(first(LABELS, 1)),
        "quarter_ends": "with q as (select o_orderkey, cast(o_orderdate as date) as d from orders), e as (select o_orderkey, d, case when d = last_day(d) and month(d) % 3 = 0 then d else cast(date_trunc('quarter', d) as date) - 1 end as this_end from q) select o_orderkey, this_end, last_day(this_end - interval 3 month) as previous_end, d = last_day(d) and month(d) % 3 = 0 as at_end, cast(strftime(d, '%Y%m%d') as int) as period_key from e",
        "unit_hints": expected_sql([v[1:] for v in UNITS], names=("multiplier", "currency")),
        "number_words": expected_sql([v[1:] for v in WORDS], names=("value_type", "value", "currency", "suffix", "minor")),
        "unit_applied": expected_sql(first(SCALED, 4)),
        "section_headings": expected_sql(first(HEADINGS, 1)),
        "path_parts": expected_sql([v[1:] for v in PATHS], names=("company", "doc_type", "doc_date")),
        "metric_names": expected_sql(first(NAMES, 1)),
        "scope_routes": _route_sql(),
        "route_rows": f"select reason, route, count(*) as n_rows from ({_route_sql()}) group by 1, 2",
        "row_issues": expected_sql(first(FAULTS, 1)),
        "issue_multilabel": "select issue, count(*) as n_rows from (select unnest(string_split(expected, ',')) as issue from (" + expected_sql(first(FAULTS, 1)) + ")) where issue <> '' group by 1",
        "column_period": expected_sql(first(CELLS, 1)),
        "header_columns": "with x as (select l_orderkey, l_linenumber, l_quantity * 9 as x from lineitem) select l_orderkey, l_linenumber, case when abs(x - 100) <= 36 then 0 when abs(x - 180) <= 36 then 1 when abs(x - 260) <= 36 then 2 when abs(x - 340) <= 36 then 3 end as column from x",
        "near_numbers": lines + "f as (select doc_id, coalesce(number, " + ", ".join(near(n) for n in (1, -1, 2, -2, 3, -3)) + ") as near_number from n window w as (partition by doc_id order by line_no)) select doc_id, count(near_number) as n_found, cast(sum(near_number) as bigint) as total from f group by 1",
        "section_pages": pages,
        "integrity_index": rows + "select file, period, balance_sheet, cash_bridge, retained_earnings, income, passed, failed, evaluated, integrity_score, anomaly_level from ix",
        "statement_rollup": rows + ", ru as (select 'docs/' || file || '/x.pdf' as file, file as company, substr(period, 1, 4) as year, * exclude (file) from ix), rk as (select *, case anomaly_level when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end as r from ru) select file, year as period, case when bool_or(balance_sheet = 0) then 0 when bool_or(balance_sheet = 1) then 1 else -1 end as balance_sheet, case when bool_or(cash_bridge = 0) then 0 when bool_or(cash_bridge = 1) then 1 else -1 end as cash_bridge, max(integrity_score) as integrity_score, arg_max(anomaly_level, r) as anomaly_level, arg_max(period, (evaluated, month(cast(period as date)))) as label, any_value(company) as company, count(*) as n_rows, coalesce(try_cast(year as int), 0) as period_sort_key from rk group by file, year",
        "integrity_enriched": rows + ", en as (select f.company as file, f.metric, coalesce(i.integrity_score, f.integrity) as s, coalesce(i.anomaly_level, 'UNKNOWN') as anomaly_level from facts f left join (select * from ix where month(cast(period as date)) % 4 <> 0) i on f.company = i.file and f.period = i.period) select file, metric, anomaly_level, count(*) as n_rows, cast(sum(s) as bigint) as total_score from en group by 1, 2, 3",
        "fallback_values": "with o as (select o_orderkey, o_custkey, year(o_orderdate) as y, o_totalprice as p from orders), e as (select o_custkey, y, max(p) as b from o where o_orderkey % 2 = 0 group by 1, 2), g as (select o_custkey, max(p) as b from o where o_orderkey % 3 = 0 group by 1) select o_orderkey, coalesce(e.b, g.b) as best, case when e.b is not null then 'exact' when g.b is not null then 'general' else 'none' end as best_from from o left join e on o.o_custkey = e.o_custkey and o.y = e.y left join g on o.o_custkey = g.o_custkey",
        "statement_class": classes + "select period, classification, missing_balance, debt_missing, cash_missing, n_metrics from cz",
        "forensic_summary": classes + ", s as (select count(*) as total_periods, count(*) filter (where classification = 'INCOME_ONLY') as income_only, count(*) filter (where classification = 'FULL_STATEMENTS_PRESENT') as full_statements, count(*) filter (where classification = 'MULTI_SECTION_MISSING') as multi_section_missing, count(*) filter (where classification = 'BALANCE_SHEET_PARTIAL' or debt_missing or cash_missing) as balance_gaps, count(*) filter (where classification = 'CASHFLOW_PARTIAL' or cp) as cash_gaps from cz) select *, (balance_gaps >= 2 and balance_gaps >= 0.3 * total_periods) or (cash_gaps >= 2 and cash_gaps >= 0.3 * total_periods) or income_only >= 2 or multi_section_missing >= 2 as structural_pattern from s",
        "identity_guard": FACTS_SQL + ", b as (select company as file, period, metric, k, conf, case when metric = 'total_liabilities' and k % 7 = 0 then max(case when metric = 'total_assets' then value end) over (partition by company, period) else value end as value from facts where metric in ('total_assets', 'total_liabilities', 'total_equity')), g as (select file, period, arg_max(value, conf) filter (where metric = 'total_assets' and value is not null) as a, max(abs(value)) filter (where metric = 'total_equity') as e, count(value) filter (where metric = 'total_liabilities') as n from b group by 1, 2) select b.file, metric, coalesce(metric = 'total_liabilities' and k % 2 = 0 and n > 0 and e > greatest(1.0, abs(a) * 0.0005) and abs(value - a) <= greatest(1.0, abs(a) * 0.0005), false) as demoted, count(*) as n_rows from b left join g on b.file = g.file and b.period = g.period group by 1, 2, 3",
        "row_ids": "select l_orderkey, l_linenumber, sha1(concat_ws('|', l_orderkey, l_linenumber, l_returnflag, '')) as row_id from lineitem",
        "slugs": expected_sql(first(SLUGS, 1)),
        "cash_phrases": expected_sql([v[4:] for v in PHRASES], names=("metric", "confidence")),
        "repaired_ends": expected_sql(first(ENDS, 3)),
        "parsed_lines": expected_sql([v[1:] for v in SAID], names=("metric", "variant", "value_type", "value", "period")),
        "block_metrics": "select o_orderkey, metric, value, period_end, scope, confidence from orders, (values " + ", ".join(f"('{x[0]}', {x[1]!r}, '{x[2]}', '{x[3]}', {x[4]!r}::double)" for _, x in PAGE if x) + ") as e(metric, value, period_end, scope, confidence) where o_orderkey % 20 = 0",
        "rebalanced_periods": "select o_orderkey as file, n as ordinal, case n when 2 then '2023-06-30' when 3 then '2023-12-31' else '2024-06-30' end as period_end from (select o_orderkey, unnest(range(1, o_orderkey % 5 + 2)) as n from orders)",
        "selected_debt": FACTS_SQL + " select company, period, value, metric as chosen from facts where metric in ('net_debt', 'total_debt', 'total_liabilities') and value is not null and conf >= 2 qualify row_number() over (partition by company, period order by case metric when 'net_debt' then 1 when 'total_debt' then 2 else 3 end, conf desc, ord) = 1",
        "soft_recall": "with w as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 12) select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from w qualify rank <= 3",
        "name_scores": expected_sql(first(SCORED, 3)),
        "best_names": "with n as (select cast(n_nationkey as varchar) as ticker, n_name, r_name from nation join region on n_regionkey = r_regionkey), s as (select ticker, n_name as name, 22 + 2 * least(20, length(n_name) // 6) as score, 2 as n from n union all select ticker, r_name || ' Limited', 43 + least(20, length(r_name || ' Limited') // 6), 1 from n) select ticker, name, score, n as n_sources from s qualify row_number() over (partition by ticker order by score desc, name) = 1",
        "headline_tickers": "select id, ticker, accepted from (" + expected_sql([v[2:] for v in HEADLINES], names=("ticker", "accepted")).replace("select o_orderkey,", "select o_orderkey as id,") + ") where ticker is not null",
    }


def _signals_sql():
    from .warehouse import _PRESENCE, _RATIOS, _SIGNALS

    complete = "0.45 * ((revenue + ebit + npat) / 3.0) + 0.45 * ((total_assets + total_debt + total_equity) / 3.0) + 0.10 * ((operating_cash_flow + free_cash_flow) / 2.0)"
    from .common import FACTS_SQL

    return {"supported_signals": FACTS_SQL + ", " + _RATIOS + ", " + _SIGNALS + ", " + _PRESENCE + f", su as (select company, period, round({complete}, 4) as support from pm where month(cast(period as date)) <> 5), j as (select signal_name, round(coalesce(support, 0.0), 6) as support from sig left join su on sig.company = su.company and sig.period = su.period where profile = 'institutional' and risk_level is not null) select signal_name, case when support < 0.6 then 'LOW_SUPPORT' else 'ADEQUATE_SUPPORT' end as risk_confidence, count(*) as n, round(sum(support), 4) as support from j group by 1, 2"}


SQL = _sql() | _signals_sql()
QUERIES = {k: globals()[k] for k in SQL}
