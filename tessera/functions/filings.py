"""Lines of filings as column functions: which metrics they name, what statement they stand in, how far a figure is to be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates, numeric, text

# The metrics that a line may name, in the order in which they are listed.
METRICS = {
    "revenue": r"\b(revenue|turnover|total income)\b",
    "segment_revenue": r"\b(segment revenue|division revenue|business unit revenue|media revenue)\b",
    "gross_profit": r"\b(gross profit|gross income)\b",
    "gross_margin_pct": r"\b(gross margin)\b",
    "ebitda": r"\b(?:(statutory|underlying|adjusted)\s+)?ebitda(?:\s+before\s+significant\s+items)?\b",
    "ebit": r"\b(?:(statutory|underlying|adjusted)\s+)?ebit(?:\s+before\s+significant\s+items)?\b|\boperating\s+(?:profit|income)\b|\bprofit\s+from\s+operations\b",
    "operating_margin_pct": r"\b(operating margin|ebit margin)\b",
    "net_income": r"\b(net income|net profit|profit after tax(?:ation)?|loss after tax(?:ation)?|pat|profit\s*/?\s*\(?loss\)?\s+after\s+income\s+tax(?:\s+expense)?|loss after income tax(?:\s+expense)?|profit or loss after tax|(?:profit|loss)(?:\s+after\s+tax(?:ation)?)?\s+attributable\s+to\s+(?:owners|members|shareholders|equity\s+holders))\b",
    "npat": r"\b(npat|net profit after tax)\b",
    "eps": r"\b(eps|earnings per share)\b",
    "free_cash_flow": r"\b(free cash flow|fcf)\b",
    "operating_cash_flow": r"\b(operating cash flow|cash from operations)\b",
    "cash_and_equivalents": r"\b(cash equivalents|cash (?:and equivalents|balance|position|on hand)|cash(?!\s*flow))\b",
    "net_debt": r"\bnet\s+debt\b",
    "total_debt": r"\b(total\s+debt|total\s+borrowings|total\s+interest[- ]bearing\s+liabilities|interest[- ]bearing\s+debt|borrowings?)\b",
    "current_assets": r"\bcurrent\s+assets?\b",
    "current_liabilities": r"\bcurrent\s+liabilities?\b",
    "total_assets": r"\btotal\s+assets?\b",
    "total_liabilities": r"\btotal\s+liabilities?\b",
    "total_equity": r"\b(total\s+equity|total\s+shareholders'?\s+equity|equity\s+attributable\s+to\s+(?:owners|equity\s+holders)|net\s+assets)\b",
    "shares_outstanding": r"\b(shares outstanding|shares on issue|issued shares|ordinary shares on issue|weighted average number of ordinary shares)\b",
    "roic_pct": r"\b(roic|return on invested capital)\b",
    "capex": r"\b(capex|capital expenditure)\b",
    "guidance": r"\b(guidance|outlook|forecast|expects?|targets?)\b",
    "growth_pct": r"\b(yoy|year[- ]over[- ]year|qoq|cagr)\b",
}
# Labels of table rows where they differ from the above.
ROW_LABELS = METRICS | {
    "revenue": r"\b(total\s+revenue|revenue|turnover|total\s+income)\b",
    "segment_revenue": r"\b(segment|division|business unit|media)\s+revenue\b",
    "cash_and_equivalents": r"\b(cash\s+and\s+cash\s+equivalents|cash\s+equivalents|cash\s+on\s+hand|cash\s+at\s+bank|cash\s+balance)\b",
}
# Families of metrics.
MONEY = ("revenue", "segment_revenue", "gross_profit", "ebitda", "ebit", "net_income", "npat", "free_cash_flow", "operating_cash_flow", "cash_and_equivalents", "net_debt", "total_debt", "current_assets", "current_liabilities", "total_assets", "total_liabilities", "total_equity", "capex")
INCOME = ("revenue", "segment_revenue", "gross_profit", "ebit", "ebitda", "net_income", "npat", "eps")
BALANCE = ("cash_and_equivalents", "total_debt", "net_debt", "total_assets", "total_liabilities", "total_equity", "current_assets", "current_liabilities")
CASH = ("cash_and_equivalents_opening", "cash_and_equivalents_closing", "free_cash_flow", "operating_cash_flow", "capex")
CANONICAL_SCOPES = ("consolidated_statement", "appendix_statement")
LEAST_CONFIDENCE = 2
# Words that tell statements, notes, forms and prose apart.
MARKS = {
    "appendix": r"(?:^|[^A-Za-z0-9])appendix[\s\-_]*(4c|4d|4e|5b)(?=$|[^A-Za-z0-9])|\bquarterly[\s\-_]*cash[\s\-_]*flow\b",
    "layout": r"\b(statement\s+of\s+(profit\s+or\s+loss|financial\s+position|cash\s+flows?|comprehensive\s+income)|income\s+statement|balance\s+sheet|financial\s+position)\b",
    "consolidated": r"\bconsolidated\b",
    "parent": r"\bparent\b|\bparent\s+entity\s+information\b",
    "form": r"\b(cash\s+and\s+cash\s+equivalents\s+at\s+end\s+of\s+(?:quarter|period)|consolidated\s+statement\s+of\s+cash\s+flows?|listing\s+rule\s+4\.7b|item\s+\d+(?:\.\d+)?)\b",
    "form_metric": r"\b(npat\s+to\s+ebitda|segment\s+ebitda|company\s+performance\s+metric|ebitda|npat|operating\s+profit|revenue|gross\s+profit|total\s+assets?|total\s+liabilities?|net\s+assets?)\b",
    "note": rf"(?m)^\s*note\s+(\d{{1,3}}[A-Za-z]?)\b(?!\s+{dates.MONTH}\b)",
    "note_inline": rf"\bnote\s+(\d{{1,3}}[A-Za-z]?)\s*[:\).\-](?!\s*{dates.MONTH}\b)",
    "notes_to": r"\bnotes?\s+to\s+the\b",
    "financial": r"\b(statement\s+of|financial\s+statements?|financial\s+report|financial\s+position|cash\s+flows?|profit\s+or\s+loss|comprehensive\s+income|balance\s+sheet|income\s+statement|notes?\s+to\s+the\s+financial\s+statements?|appendix[\s\-_]*(4c|4d|4e|5b)|consolidated\s+(statement|financial))\b",
    "presentational": r"\b(chairman|chairperson|ceo|managing\s+director|review\s+of\s+operations|operating\s+review|operations?\s+review|exploration|highlights|letter\s+to\s+shareholders|investor|presentation|strategy|business\s+review|corporate\s+overview|sustainability|financial\s+performance|low\s+gearing)\b",
    "equity_roll": r"\b(transactions?\s+with|movement[s]?\s+in|retained\s+earnings|reserves?|share\s+capital|attributable\s+to\s+owners|opening\s+balance|closing\s+balance|flow\s+through\s+shares?|dividends?\s+paid|other\s+comprehensive\s+income)\b",
    "reconciliation": r"\b(impact\s+on\s+consolidated\s+statement|previously\s+disclosed|transactions?\s+with\s+minority|flow\s+through\s+shares?|net\s+debt\s+waterfall|alternative\s+performance\s+measures?|non[-\s]?ifrs|net\s+operating\s+assets?|balance\s+sheet\s+movement|reconcile(?:s|d)?\s+net\s+operating\s+assets|discontinued\s+operations|net\s+assets?\s+disposed|assets?\s+disposed|assets?\s+held\s+for\s+sale|assets?\s+acquired|net\s+identifiable\s+assets?|business\s+combinations?|news\s+release|apms?\s+derived|debt\s+and\s+sources\s+of\s+liquidity|net\s+debt\s+management\s+related\s+instruments?|deed\s+of\s+cross\s+guarantee|party\s+to\s+the\s+deed|financial\s+impacts?\s+of)\b",
    "cash_reconciliation": r"\b(net\s+debt\s+waterfall|alternative\s+performance\s+measures?|non[-\s]?ifrs|net\s+operating\s+assets?|net\s+assets?|balance\s+sheet\s+movement|reconcile(?:s|d)?\s+net\s+operating\s+assets|discontinued\s+operations)\b",
    "cash_not_balance": r"\b(net\s+(?:increase|decrease|movement|change)\s+in\s+cash\s+and\s+cash\s+equivalents|cash\s+and\s+cash\s+equivalents\s+(?:acquired|disposed))\b",
    "cash_other": r"\bcash\s+award\b|\bremuneration\b|\bcdp\b",
    "liabilities_and_equity": r"\b(total\s+liabilities\s+and\s+(?:equity|net\s+assets?|net\s+assets?\s+attributable)|liabilities?\s+and\s+equity|liabilities?\s+and\s+net\s+assets?)\b",
    "acquisition": r"\bcontributed\s+(?:revenue|income|profit|ebit|ebitda|cash)\b|\bfrom\s+acquisition\s+date\b",
    "comprehensive": r"\b(total\s+comprehensive\s+income|other\s+comprehensive\s+income)\b",
    "prose": r"\b(received|sale|sold|disposal|divestment|proceeds|completion|compared|grew|grown|increased|decreased|improved|up by|down by|issued|stating|updating|was|were|amounted|represented|delivered|targeting|forecast|held|projection|projections|range|available|approximately|approx\.?|generated|underpinned|supports?|resulted|remains?)\b",
    "weak_title": r"^\(|\bshould\s+equal\s+item\b|\bnote:\b|\bmust\s+include\s+a\s+description\b|^consolidated$|^group$|^page\s+\d+\s+of\s+\d+$",
    "footer": r"^\s*page\s+\d+\s+of\s+\d+\s*$|\bfor\s+personal\s+use\s+only\b",
    "excluded_section": r"\b(liquidity\s+risk|credit\s+risk|market\s+risk|financial\s+risk|risk\s+management|interest\s+rate\s+risk|foreign\s+exchange\s+risk|currency\s+risk)\b",
}


def says(x: Column, mark: str) -> Column:
    return F.coalesce(x, F.lit("")).rlike("(?i)" + MARKS[mark])


def _one(*xs: Column) -> Column:
    return text.normalize_space(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in xs]))


def metric_hits(line: Column) -> Column:
    """Names of the metrics that a line mentions, in the order of the list."""
    return F.array_compact(F.array(*[F.when(line.rlike("(?i)" + p), F.lit(m)) for m, p in METRICS.items()]))


def metric_variant(metric: Column, label: Column, line: Column, header: Column) -> Column:
    """Statutory, underlying or adjusted, and whether significant items are left out, of the figures that come in variants; else empty."""
    t = F.lower(_one(label, line, header))
    kind = reduce(lambda out, w: F.when(F.contains(t, F.lit(w)), w).otherwise(out), ("adjusted", "underlying", "statutory"), F.lit(""))
    joined = lambda end: F.when(kind != "", F.concat(kind, F.lit("_" + end))).otherwise(F.lit(end))
    out = F.when(t.rlike(r"\bbefore\s+significant\s+items\b"), joined("before_significant_items"))
    out = out.when(t.rlike(r"\b(?:excluding|exclude|excl\.?)\s+(?:non[-\s]?recurring|one[-\s]?off|significant\s+items?)\b"), joined("ex_significant_items"))
    return F.when(metric.isin("revenue", "gross_profit", "ebitda", "ebit", "net_income", "npat"), out.otherwise(kind)).otherwise(F.lit(""))


def metric_alias(metric: Column, label: Column, line: Column) -> Column:
    """Under which of its names total equity stands; empty for other metrics."""
    t = F.lower(_one(label, line))
    names = ((r"\bnet\s+assets?\b", "net_assets"), (r"\bshareholders'?\s+funds?\b", "shareholders_funds"), (r"\bequity\s+attributable\s+to\s+owners\b", "equity_attributable_to_owners"), (r"\btotal\s+equity\b", "total_equity"))
    out = reduce(lambda rest, n: F.when(t.rlike(n[0]), n[1]).otherwise(rest), reversed(names), F.lit(""))
    return F.when(F.lower(F.trim(metric)) == "total_equity", out).otherwise(F.lit(""))


# Names of metrics that stand for another.
SAME_METRIC = {
    "npat": "net_income", "profit_after_tax": "net_income", "cash": "cash_and_equivalents", "cash_and_equivalents_opening": "cash_and_equivalents", "cash_and_equivalents_closing": "cash_and_equivalents",
    "total_borrowings": "total_debt", "capex": "capital_expenditure", "net_cash_from_operating_activities": "operating_cash_flow",
}


def metric_name(metric: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(metric, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in SAME_METRIC.items() for x in pair])
    return F.coalesce(F.try_element_at(known, m), m)


def section_mode(heading: Column) -> Column:
    return F.when(says(heading, "financial"), "financial").when(says(heading, "presentational"), "presentational").otherwise("unknown")


def section_heading(line: Column) -> Column:
    """The line in lower case, less its number, where it reads as a heading; else empty."""
    t = text.normalize_space(line)
    clean = F.trim(F.regexp_replace(t, r"^[\s\d.)(]+", ""))
    words = F.regexp_extract_all(clean, F.lit(r"[A-Za-z]+"), 0)
    upper_first = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    capitals = (clean == F.upper(clean)) & clean.rlike("[A-Za-z]")
    titled = capitals | (upper_first >= F.greatest(F.lit(1), F.size(words) - 1))
    sentence = clean.rlike(r"^\p{Lu}") & ~clean.rlike("[,;:]")
    figures = t.rlike(r"(?i)(?:[$€£]\s*)?\d[\d,]*(?:\.\d+)?") & ~t.rlike(r"^[\s\d.)(]+[^\d]*$")
    fits = (t != "") & (F.length(t) <= 96) & ~t.endswith(".") & ~figures & (clean != "") & F.size(words).between(1, 8)
    return F.when(fits & (titled | sentence), F.lower(clean)).otherwise(F.lit(""))


def statement_scope(block: Column, header: Column, source_kind: Column) -> Column:
    """struct(scope, reason): what a block of lines under a header belongs to; the first rule that applies."""
    t = _one(header, block)
    has = {m: says(t, m) for m in ("appendix", "layout", "consolidated", "form", "form_metric", "parent", "note_inline", "notes_to", "presentational", "financial")}
    note = says(header, "note") | has["note_inline"] | has["notes_to"]
    form_source, report_source = source_kind == "appendix_report", source_kind == "canonical_report"
    rules = (
        (t == "", "other", "empty_context"),
        (has["parent"], "parent_statement", "parent_marker"),
        (note, "note_disclosure", "note_marker"),
        (form_source & has["form"], "appendix_statement", "appendix_source_kind"),
        (has["appendix"] & has["form_metric"], "appendix_statement", "appendix_metric_table"),
        (form_source & has["layout"], "appendix_statement", "appendix_layout_source_kind"),
        (has["layout"] & has["consolidated"], "consolidated_statement", "consolidated_layout"),
        (report_source & has["layout"], "consolidated_statement", "canonical_layout_source_kind"),
        (has["layout"], "other", "layout_without_scope_marker"),
        (has["appendix"], "other", "appendix_marker_without_layout"),
        (~has["financial"] & has["presentational"], "narrative", "presentational_context"),
    )
    out = lambda scope, reason: F.struct(F.lit(scope).alias("scope"), F.lit(reason).alias("reason"))
    return reduce(lambda rest, r: F.when(r[0], out(r[1], r[2])).otherwise(rest), reversed(rules), out("other", "fallback_other"))


# What tells the families of statements.
IN_FORM_INCOME = r"\b(profit\s+or\s+loss|statement\s+of\s+comprehensive\s+income|income\s+statement|revenue|gross\s+profit|ebitda?|npat|operating\s+profit|(?:profit|loss)\s+after\s+income\s+tax)\b"
IN_FORM_BALANCE = r"\b(financial\s+position|balance\s+sheet|total\s+assets?|total\s+liabilities?|net\s+assets?|equity)\b"


def statement_family(title: Column, scope: Column, context: Column) -> Column:
    """cash_flow, income_statement, equity_statement, balance_sheet or other."""
    t = F.lower(_one(title, context))
    form = F.when(t.rlike(IN_FORM_INCOME), "income_statement").when(t.rlike(IN_FORM_BALANCE), "balance_sheet").otherwise("cash_flow")
    plain = (
        F.when(t == "", "other")
        .when(t.rlike(r"\b(cash\s+flows?|statement\s+of\s+cash\s+flows?)\b"), "cash_flow")
        .when(t.rlike(r"\b(profit\s+or\s+loss|statement\s+of\s+comprehensive\s+income|income\s+statement)\b"), "income_statement")
        .when(t.rlike(r"\bchanges?\s+in\s+equity\b"), "equity_statement")
        .when(says(t, "equity_roll") & ~t.rlike(r"\b(financial\s+position|balance\s+sheet|total\s+assets?|total\s+liabilities?)\b"), "equity_statement")
        .when(t.rlike(r"\b(financial\s+position|balance\s+sheet)\b"), "balance_sheet")
        .when(t.rlike(r"\bcomprehensive\s+income\b"), "income_statement")
        .otherwise("other")
    )
    return F.when(F.lower(F.trim(F.coalesce(scope, F.lit("")))) == "appendix_statement", form).otherwise(plain)


def expected_families(metric: Column) -> Column:
    """The families of statements in which a metric belongs; an empty array for metrics of none."""
    sets = ((INCOME, "income_statement"), (BALANCE, "balance_sheet"), ((*CASH, "cash_and_equivalents"), "cash_flow"))
    return F.array_compact(F.array(*[F.when(metric.isin(*names), F.lit(family)) for names, family in sets]))


def strong_label(metric: Column, label: Column) -> Column:
    """Whether a row's label names the metric outright."""
    t = text.normalize_space(label)
    return reduce(lambda out, m: F.when(metric == m[0], t.rlike("(?i)" + m[1])).otherwise(out), ROW_LABELS.items(), F.lit(False)) & (t != "")


def weak_layout(title: Column, header: Column) -> Column:
    """Neither title nor header to speak of, or a title that's a footer or an instruction."""
    t, h = text.normalize_space(title), text.normalize_space(header)
    return F.when(t != "", says(t, "weak_title") | says(t, "footer")).otherwise((h == "") | (F.size(F.split(h, " ")) < 2))


def period_from_header(period: Column, header: Column, title: Column) -> Column:
    """Whether a period with a date in it stands under a header that gives dates."""
    return (F.size(dates.explicit_dates(_one(header, title))) > 0) & (dates.named_date(period).isNotNull() | dates.quarter_label(F.coalesce(period, F.lit(""))).isNotNull())


def canonical_confidence(metric: Column, scope: Column, family: Column, period: Column, label: Column, line: Column, header: Column, title: Column) -> Column:
    """From -2 to 4: a point each for scope, family, dated period and outright label, one off each for a reconciliation and a weak layout."""
    points = [scope.isin(*CANONICAL_SCOPES), F.array_contains(expected_families(metric), family), period_from_header(period, header, title), strong_label(metric, label)]
    off = [says(_one(header, title, label, line), "reconciliation"), weak_layout(title, header)]
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return sum(map(one, points[1:]), one(points[0])) - one(off[0]) - one(off[1])


def field_confidence(value_type: Column, metric: Column, raw: Column, currency: Column, period: Column, scope: Column, inside: Column) -> Column:
    """From 0 to 1: by the kind of value, with more for a currency, a scale, decimals, guidance in words and a period; none outside of canonical statements."""
    s = F.lower(F.trim(F.coalesce(scope, F.lit(""))))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    amount = 0.7 + F.when(some(currency), 0.15).otherwise(0.0) + F.when(F.lower(raw).rlike("[mbkt]"), 0.1).otherwise(0.0) + F.when(raw.rlike(r"\d\.\d"), 0.05).otherwise(0.0)
    score = F.when(value_type == "percent", F.lit(0.85)).when(value_type == "amount", amount).otherwise(F.lit(0.35))
    score = score + F.when((metric == "guidance") & (value_type == "text"), 0.1).otherwise(0.0) + F.when(some(period), 0.05).otherwise(0.0)
    out = (s != "") & (~s.isin(*CANONICAL_SCOPES) | ~F.coalesce(inside, F.lit(False)))
    return F.when(out, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2))


def path_parts(path: Column) -> Column:
    """struct(company, doc_type, doc_date) of a file's path: what follows ``docs``, else the folder; the date is in the name or anywhere."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, "docs")
    get = lambda n: F.coalesce(F.get(parts, (at - 1 + n).cast("int")), F.lit(""))
    company = F.when((at > 0) & (get(1) != ""), get(1)).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    kind = F.when(at > 0, get(2)).otherwise(F.lit(""))
    day = lambda x: F.to_date(F.try_to_timestamp(F.regexp_replace(F.regexp_extract(x, r"\b20\d{2}[-_]\d{2}[-_]\d{2}\b", 0), "_", "-"), F.lit("yyyy-MM-dd"))).cast("string")
    when = F.coalesce(day(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))), day(path), F.lit(""))
    return F.struct(company.alias("company"), kind.alias("doc_type"), when.alias("doc_date"))


def row_id(*parts: Column) -> Column:
    """SHA-1 of the parts of a row's key, nulls as empty."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def slug(x: Column, most: int = 80) -> Column:
    """Letters, digits, dots, dashes and underscores; anything else becomes one underscore."""
    s = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    return F.substring(F.btrim(s, F.lit("._-")), 1, most)


# Phrases of cash flow statements' rows, and what they aren't.
CAPEX_WORDS = ("purchases of property, plant and equipment", "purchase of property, plant and equipment", "purchases of property plant and equipment", "additions to property, plant and equipment", "additions to property plant and equipment", "capital expenditure", "capital expenditures")
OPERATING_WORDS = ("cash generated from operations", "net operating cash flow", "net operating cash flows")
NOT_CAPEX = ("impairment", "revaluation", "notes")
OPERATING_HINTS, CAPEX_HINTS = ("net cash from operating activities", "cash generated from operations", "net operating cash flow"), ("capital expenditure", "capex")
CASH_NAMES = ("cash_and_equivalents", "cash_and_equivalents_opening", "cash_and_equivalents_closing")


def _any_of(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda out, w: out | F.contains(x, F.lit(w)), words, F.lit(False))


def phrase_metric(row: Column, has_number: Column) -> Column:
    """The cash flow metric that a row with a number names in words: capital expenditure or operating cash flow; totals of cash never; else empty."""
    t = F.lower(F.trim(F.coalesce(row, F.lit(""))))
    out = F.when(_any_of(t, CAPEX_WORDS) & ~_any_of(t, NOT_CAPEX), "capital_expenditure").when(_any_of(t, OPERATING_WORDS), "operating_cash_flow").otherwise("")
    guarded = F.contains(t, F.lit("total cash and cash equivalents")) | (F.contains(t, F.lit("property, plant and equipment")) & F.contains(t, F.lit("impairment")))
    return F.when(has_number & ~guarded, out).otherwise(F.lit(""))


def coerced_metric(metric: Column, row: Column, has_number: Column, confidence: Column) -> Column:
    """struct(metric, confidence) of a cash flow row: rows of cash or of no metric take that of their phrase or hints, which lifts confidence to three."""
    m, t = F.lower(F.trim(F.coalesce(metric, F.lit("")))), F.lower(F.coalesce(row, F.lit("")))
    phrase = phrase_metric(row, has_number)
    hinted = F.when(_any_of(t, OPERATING_HINTS), "operating_cash_flow").when(_any_of(t, CAPEX_HINTS), "capex")
    new = F.when((phrase != "") & m.isin("", "cashflow_unmapped", *CASH_NAMES), phrase).when(m.isin(*CASH_NAMES), hinted)
    return F.struct(F.coalesce(new, m).alias("metric"), F.when(new.isNotNull(), F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(3.0))).otherwise(confidence).alias("confidence"))


def repaired_end(period_end: Column, *hints: Column) -> Column:
    """The period's end, or that of the first label given where it's missing."""
    label = text.first_non_empty(*hints)
    return F.coalesce(text.missing(period_end), dates.period_end(label), F.lit(""))


# Where numbers are labels and not figures; an amount inside a line, and a percentage.
AMOUNT = r"(?i)(?<![A-Za-z0-9])((?:A|US|C|NZ)?[$€£])?\s*(\(?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?)\s*(bn|mn|mm|k|m|b|t|million|billion|thousand|trillion)?\b"
PERCENT = r"-?\d+(?:\.\d+)?\s*%"


def metric_pattern(metric: Column) -> Column:
    """The pattern of a metric, as a column."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in METRICS.items() for x in p]), metric)


def spans(x: Column, pattern: str | Column) -> Column:
    """array<struct<at, found>> of the matches of a pattern in order; at counts from 0.

    The text before each match is what is left once the pieces up to it are taken away, so
    equal matches keep their own places. The sign that marks them is a blank where a text has it itself.
    """
    x = F.translate(x, "\u0001", " ")
    inner = F.lit(pattern.removeprefix("(?i)")) if isinstance(pattern, str) else pattern
    marked = F.split(F.regexp_replace(x, F.concat(F.lit("(?i)("), inner, F.lit(")")), F.lit("\u0001$1\u0001")), "\u0001")
    sized = F.transform(marked, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    placed = F.transform(sized, lambda e: F.struct(F.aggregate(F.slice(marked, F.lit(1), e["i"]), F.lit(0), lambda t, y: t + F.length(y)).alias("at"), e["p"].alias("found"), e["i"].alias("i")))
    return F.transform(F.filter(placed, lambda e: e["i"] % 2 == 1), lambda e: F.struct(e["at"].alias("at"), e["found"].alias("found")))


def ranked_amounts(rows: DataFrame, line: str, metric: str, pattern: str | Column, name: str = "amounts") -> DataFrame:
    """rows with ``name``: array<struct<score, at, raw, value>> of the amounts of a line that may be a metric's figure, best first.

    ``pattern`` is the metric's. Left out are item codes at the
    start, digits of identifiers, ordinals, bare years, days near a month, numbers of notes,
    small bare numbers, percentages, and what follows a percentage where an earlier amount
    is substantial. Points are for currency, scale, size and decimals, less the distance
    to the nearest mention of the metric. The places of numbers are columns of their own on
    the way, so each is found once a row.
    """
    part = lambda raw, n: F.regexp_extract(raw, "^" + AMOUNT, n)
    text_of, kind = F.col(line), F.col(metric)

    def parsed(m: Column) -> Column:
        num = part(m["found"], 2)
        at = m["at"] + F.position(num, m["found"]) - 1
        end = at + F.length(num)
        closed = F.when(num.startswith("(") & ~num.endswith(")") & (F.substring(text_of, end + 1, F.lit(1)) == ")"), F.concat(num, F.lit(")"))).otherwise(num)
        return F.struct(at.alias("at"), end.alias("end"), closed.alias("num"), part(m["found"], 1).alias("currency"), part(m["found"], 3).alias("suffix"), numeric.scaled_number(closed, part(m["found"], 3)).alias("value"), F.trim(m["found"]).alias("raw"))

    found = rows.withColumns({"_spans": spans(text_of, AMOUNT), "_percent": F.try_element_at(spans(text_of, PERCENT), F.lit(1))["at"], "_anchors": F.transform(spans(text_of, pattern), lambda a: a["at"])})
    found = found.withColumn("_numbers", F.filter(F.transform("_spans", parsed), lambda m: m["value"].isNotNull()))
    return found.withColumn(name, _ranked(text_of, kind)).drop("_spans", "_percent", "_anchors", "_numbers")


def _ranked(line: Column, metric: Column) -> Column:
    low, known, first_percent, anchors = F.lower(line), F.col("_numbers"), F.col("_percent"), F.col("_anchors")
    money = metric.isin(*MONEY)

    def bare(m: Column) -> Column:
        return (m["currency"] == "") & (m["suffix"] == "")

    def label(m: Column) -> Column:
        """Codes, identifiers and years: no figure, whatever stands around."""
        before, two = F.substring(line, m["at"], F.lit(1)), F.substring(line, m["at"] - 1, F.lit(1))
        code = bare(m) & m["num"].rlike(r"^\d+\.\d+$") & (m["at"] <= 8)
        joined = (m["at"] > 0) & ((before.isin("-", "/") & two.rlike("[A-Za-z]") & (m["at"] > 1)) | before.rlike("[A-Za-z]"))
        year = bare(m) & (m["value"] == F.floor(m["value"])) & F.abs(m["value"]).between(1900, 2100)
        return code | joined | year

    def unfit(m: Column) -> Column:
        whole = m["value"] == F.floor(m["value"])
        tail, around = F.substring(low, m["end"] + 1, F.lit(2)), F.substring(line, F.greatest(m["at"] - 15, F.lit(1)), m["end"] - F.greatest(m["at"] - 16, F.lit(0)) + 16)
        prefix = F.substring(low, F.greatest(m["at"] - 15, F.lit(1)), F.least(m["at"], F.lit(16)))
        ordinal = tail.isin("st", "nd", "rd", "th") & (m["suffix"] == "")
        day = bare(m) & whole & F.abs(m["value"]).between(1, 31) & (around.rlike(rf"(?i)\b{dates.MONTH}\b") | line.rlike(r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b"))
        note = bare(m) & prefix.rlike(r"\bnote\s*$")
        small = bare(m) & whole & (F.abs(m["value"]) < 10) & (F.length(F.regexp_replace(m["num"], r"[,()-]", "")) <= 2)
        share = money & F.ltrim(F.substring(line, m["end"] + 1, F.lit(40))).startswith("%")
        return ordinal | day | note | small | share | ((metric == "guidance") & bare(m))

    def substantial(m: Column) -> Column:
        return ~label(m) & (~bare(m) | (F.abs(m["value"]) >= 100))

    early = money & F.exists(known, lambda m: (m["at"] < first_percent) & substantial(m))
    fit = F.filter(known, lambda m: ~label(m) & ~unfit(m) & ~F.coalesce((m["at"] > first_percent) & early, F.lit(False)))

    def scored(m: Column) -> Column:
        size = F.abs(m["value"])
        points = F.when(m["currency"] != "", 4.0).otherwise(0.0) + F.when(m["suffix"] != "", 3.0).otherwise(0.0) - F.when(bare(m) & (size < 10), 2.0).otherwise(0.0)
        points = points + F.when(size >= 1000, 2.0).when(size >= 100, 1.0).otherwise(0.0) + F.when(m["num"].contains("."), 1.0).otherwise(0.0) + F.when(F.length(F.regexp_replace(m["num"], "[,()]", "")) >= 4, 0.5).otherwise(0.0)
        far = F.array_min(F.transform(anchors, lambda a: F.abs(m["at"] - a)))
        points = points - F.coalesce(F.least(far / 200.0, F.lit(2.0)), F.lit(0.0))
        return F.struct((-points).alias("order"), m["at"].alias("at"), m["raw"].alias("raw"), m["value"].alias("value"))

    best = F.array_sort(F.transform(fit, scored))
    return F.transform(best, lambda m: F.struct((-m["order"]).alias("score"), m["at"].alias("at"), m["raw"].alias("raw"), m["value"].alias("value")))
