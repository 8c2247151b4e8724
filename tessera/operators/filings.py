"""Rows of filings: where each goes and why, integrity of statements and their issues, gaps of coverage, figures near labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions import filings as ff
from ..functions.numeric import once

c = F.col


def _said(name: str) -> Column:
    return F.coalesce(c(name), F.lit(""))


def recovered_family(rows: DataFrame) -> Column:
    """The family of a row's statement: given, else told by its title; a cash flow one gives way to what title and headers say outright."""
    given = F.lower(F.trim(_said("statement_family")))
    family = F.when(given != "", given).otherwise(ff.statement_family(c("statement_title"), c("statement_scope"), c("line")))
    around = F.lower(F.concat_ws(" ", "statement_title", "statement_scope_header", "table_header_text"))
    open_to = family.isin("cash_flow", "other", "")
    income = open_to & c("metric").isin(*ff.INCOME) & around.rlike(r"\b(income\s+statement|profit\s+or\s+loss|comprehensive\s+income)\b")
    balance = open_to & c("metric").isin(*ff.BALANCE) & around.rlike(r"\b(balance\s+sheet|financial\s+position)\b")
    return F.when(income, "income_statement").when(balance, "balance_sheet").otherwise(family)


def repaired_period(rows: DataFrame) -> Column:
    """statement_period_end, or for a money figure that ends within a month, the month's end in the headers: that of its year, else the first."""
    given = F.to_date(F.try_to_timestamp("statement_period_end", F.lit("yyyy-MM-dd")))
    ends = F.filter(dates.explicit_dates(F.concat_ws(" ", "table_header_text", "statement_title")), dates.is_month_end)
    same = F.filter(ends, lambda d: F.year(d) == F.year(given))
    found = F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(ends, F.lit(1)))
    broken = c("metric").isin(*ff.MONEY) & given.isNotNull() & ~dates.is_month_end(given)
    return F.when(broken & found.isNotNull(), found.cast("string")).otherwise(_said("statement_period_end"))


# Words of titles and headers that tell statements apart, and the titles that rows get which stand under another statement's.
OTHER_THAN_INCOME, CASH_TITLE = r"(?i)\b(financial\s+position|balance\s+sheet|cash\s+flows?)\b", r"(?i)\bcash\s+flows?\b"
SAYS_INCOME = r"(?i)\b(profit\s+or\s+loss|comprehensive\s+income|income\s+statement|loss\s+after\s+income\s+tax|profit\s+after\s+tax|\brevenue\b|\bgross\s+profit\b|\bebitda?\b|\bnpat\b|operating\s+profit)\b"
SAYS_BALANCE = r"(?i)\b(financial\s+position|balance\s+sheet|total\s+assets?|total\s+liabilities?|net\s+assets?|equity)\b"
INCOME_TITLE, BALANCE_TITLE = "Consolidated statement of comprehensive income", "Consolidated statement of financial position"


def rewritten_title(rows: DataFrame) -> Column:
    """The statement's title, or the one its family calls for where the title names another statement and the headers this one."""
    given = F.lower(F.trim(_said("statement_family")))
    title = F.coalesce(F.nullif(F.trim(_said("statement_title")), F.lit("")), _said("statement_scope_header"))
    family = F.when(given != "", given).otherwise(ff.statement_family(title, c("statement_scope"), _said("line")))
    around = F.concat_ws(" ", _said("table_header_text"), _said("statement_scope_header"))
    income = (family == "income_statement") & title.rlike(OTHER_THAN_INCOME) & around.rlike(SAYS_INCOME)
    balance = (family == "balance_sheet") & title.rlike(CASH_TITLE) & around.rlike(SAYS_BALANCE)
    return F.when(income, INCOME_TITLE).when(balance, BALANCE_TITLE).otherwise(c("statement_title"))


def route(rows: DataFrame) -> DataFrame:
    """rows with family, repaired period, confidence, the first reason that applies (``canonical`` where none does) and the route it gives.

    rows: metric, row_label, line, table_header_text, statement_title, statement_scope_header,
    statement_scope, statement_family, statement_period_end, period, inside_table,
    pro_forma, label_hits. One expression a row: no shuffle.
    """
    r = rows.withColumns({"metric": F.lower(F.trim(_said("metric"))), "statement_scope": F.lower(F.trim(_said("statement_scope")))})
    r = r.withColumn("statement_title", rewritten_title(r))
    r = r.withColumn("statement_family", recovered_family(r)).withColumn("statement_period_end", repaired_period(r))
    r = r.withColumn("canonical_confidence", ff.canonical_confidence(c("metric"), c("statement_scope"), c("statement_family"), c("period"), c("row_label"), c("line"), c("table_header_text"), c("statement_title")))
    label = F.lower(text.normalize_space(c("row_label")))
    around = F.concat_ws(" ", "table_header_text", "statement_title", "row_label", "line")
    money, flows = c("metric").isin(*ff.MONEY), c("metric").isin("free_cash_flow", "operating_cash_flow", "net_debt")
    cash = c("metric").isin("cash_and_equivalents", "cash_and_equivalents_opening", "cash_and_equivalents_closing")
    expected = ff.expected_families(c("metric"))
    narrative = money & (label != "") & (_said("row_label").rlike("[•▪◦]") | label.rlike(r"^(this|we|our|it)\b") | (flows & (label.endswith(" of") | F.contains(label, F.lit("annual report")))) | ((F.size(F.split(label, " ")) > 10) & ff.says(label, "prose")))
    rules = (
        ("not_inside_table", ~F.coalesce(c("inside_table"), F.lit(False))),
        ("pro_forma_context", F.coalesce(c("pro_forma"), F.lit(False))),
        ("reconciliation_context", ff.says(around, "reconciliation")),
        ("acquisition_contribution_context", c("metric").isin(*ff.INCOME) & ff.says(around, "acquisition")),
        ("metric_statement_mismatch", (F.size(expected) > 0) & ~c("statement_family").isin("", "other") & ~F.array_contains(expected, c("statement_family"))),
        ("narrative_row_label", narrative),
        ("non_current_row_label", ((c("metric") == "current_assets") & label.rlike(r"\bnon[-\s]?current\s+assets?\b")) | ((c("metric") == "current_liabilities") & label.rlike(r"\bnon[-\s]?current\s+liabilities?\b"))),
        ("ambiguous_row_label", money & (F.coalesce("label_hits", F.lit(0)) > 1) & ~ff.says(label, "liabilities_and_equity")),
        ("component_adjustment_row", (flows | (c("metric") == "total_debt")) & label.rlike(r"^(less|add)\s*[:\-]")),
        ("combined_liabilities_equity_row", c("metric").isin("total_liabilities", "total_equity") & ff.says(label, "liabilities_and_equity")),
        ("cash_reconciliation_context", cash & ff.says(around, "cash_reconciliation")),
        ("cash_keyword_false_positive", cash & ff.says(label, "cash_other")),
        ("cash_non_balance_context", (c("metric") == "cash_and_equivalents") & ff.says(label, "cash_not_balance")),
        ("comprehensive_income_context", c("metric").isin("net_income", "npat") & ff.says(label, "comprehensive")),
        ("missing_statement_period_end", _said("statement_period_end") == ""),
        ("non_canonical_scope", ~c("statement_scope").isin(*ff.CANONICAL_SCOPES)),
        ("low_canonical_confidence", c("canonical_confidence") < ff.LEAST_CONFIDENCE),
    )
    reason = reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules), F.lit("canonical"))
    out = r.withColumn("reason", reason)
    return out.withColumn("route", F.when(c("reason") == "canonical", "canonical").when(c("reason") == "not_inside_table", "rejected").otherwise("context"))


def identity_guard(rows: DataFrame) -> DataFrame:
    """rows (file, period, metric, row_label, value, conf) with ``demoted``: total liabilities that equal total assets although there's equity.

    The best row of assets counts, by confidence, then an outright label. One aggregation
    a (file, period), joined back.
    """
    strong = ff.strong_label(c("metric"), c("row_label")).cast("int")
    of = lambda m, x: F.when((c("metric") == m) & c("value").isNotNull(), x)
    g = rows.groupBy("file", "period").agg(
        F.max_by("value", of("total_assets", F.struct("conf", strong.alias("s"), F.lit(1).alias("one")))).alias("assets"), F.max(of("total_equity", F.abs("value"))).alias("equity"), F.max(of("total_liabilities", F.lit(1))).alias("has")
    )
    tolerance = F.greatest(F.lit(1.0), F.abs("assets") * 0.0005)
    g = g.where(c("has").isNotNull() & (c("equity") > tolerance)).withColumn("tolerance", tolerance).select("file", "period", "assets", "tolerance")
    hit = (c("metric") == "total_liabilities") & F.lower(text.normalize_space(c("row_label"))).startswith("total liabilities") & (F.abs(c("value") - c("assets")) <= c("tolerance"))
    return rows.join(g, ["file", "period"], "left").withColumn("demoted", F.coalesce(hit, F.lit(False))).drop("assets", "tolerance")


# Rows that checks of a statement are made of, told by their text.
NET_CASH = r"(?i)\b(?:net\s*(?:decrease|increase)\s*/?\s*\(?(?:decrease|increase)?\)?\s+in\s+cash(?:\s+and\s+cash\s+equivalents)?|net\s+cash\s+flows?\b)"
RETAINED_OPEN = r"(?i)\bretained\s+earnings\b.*\b(?:opening|at\s+beginning|beginning\s+of)\b|\bopening\s+retained\s+earnings\b"
RETAINED_CLOSE = r"(?i)\bretained\s+earnings\b.*\b(?:closing|at\s+end|end\s+of)\b|\bclosing\s+retained\s+earnings\b"
DIVIDENDS = r"(?i)\bdividends?\b"
EXPENSES = r"(?i)\b(?:total\s+expenses?|expenses?|cost\s+of\s+sales|operating\s+expenses?)\b"
TOLERANCE = {"balance": 0.02, "cash": 0.03, "retained": 0.05, "income": 0.05}


def integrity(rows: DataFrame) -> DataFrame:
    """Per (file, period): four checks (1 passed, 0 failed, -1 without the figures), their score, which credits what isn't known, and the anomaly level.

    rows: file, period, metric, row_label, line, value, conf, line_no. Of several rows for
    a figure the one of most confidence, then of the last line counts.
    """
    said = F.concat_ws(" ", "row_label", "line")
    best = lambda test: F.max_by("value", F.when(test & c("value").isNotNull(), F.struct("conf", "line_no")))
    name = lambda m: c("metric") == m
    g = rows.where((_said("file") != "") & (_said("period") != "")).groupBy("file", "period").agg(
        best(name("total_assets")).alias("assets"), best(name("total_liabilities")).alias("liabilities"), best(name("total_equity")).alias("equity"),
        best(name("cash_and_equivalents_opening")).alias("opening"), best(name("cash_and_equivalents_closing")).alias("closing"), best(said.rlike(NET_CASH)).alias("movement"),
        best(said.rlike(RETAINED_OPEN)).alias("re_open"), best(said.rlike(RETAINED_CLOSE)).alias("re_close"), best(said.rlike(DIVIDENDS)).alias("dividends"),
        F.coalesce(best(name("npat")), best(name("net_income"))).alias("profit"),
        best(name("revenue")).alias("revenue"), best(name("ebit")).alias("ebit"), best(said.rlike(EXPENSES) & ~c("metric").isin("revenue", "ebit", "ebitda")).alias("expenses"),
    )
    near = lambda a, b, kind: F.abs(a - b) <= F.greatest(F.lit(1.0), TOLERANCE[kind] * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
    signed, unsigned = c("re_open") + c("profit") + c("dividends"), c("re_open") + c("profit") - F.abs("dividends")
    predicted = F.when(F.abs(c("re_close") - signed) <= F.abs(c("re_close") - unsigned), signed).otherwise(unsigned)
    checks = {
        "balance_sheet": near(c("assets"), c("liabilities") + c("equity"), "balance"),
        "cash_bridge": near(c("closing") - c("opening"), c("movement"), "cash"),
        "retained_earnings": near(c("re_close"), predicted, "retained"),
        "income": near(c("revenue") - c("expenses"), c("ebit"), "income"),
    }
    out = g.select("file", "period", *[F.coalesce(v.cast("int"), F.lit(-1)).alias(k) for k, v in checks.items()])
    count = lambda v: reduce(lambda t, n: t + (c(n) == v).cast("int"), checks, F.lit(0))
    out = out.withColumns({"passed": count(1), "failed": count(0)}).withColumn("evaluated", c("passed") + c("failed"))
    level = F.when(c("evaluated") == 0, "UNKNOWN").when(c("failed") >= 2, "HIGH").when(c("failed") == 1, "MEDIUM").otherwise("LOW")
    return out.withColumns({"integrity_score": F.lit(4) - c("failed"), "anomaly_level": level})


def collapsed(flag: Column) -> Column:
    """Aggregate of tri-state flags: any failure fails, else any pass passes, else unknown."""
    return F.when(F.max((flag == 0).cast("int")) == 1, 0).when(F.max((flag == 1).cast("int")) == 1, 1).otherwise(-1)


def statement_rollup(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Per (file, period): collapsed flags, the greatest score, the worst anomaly by rank and the label of the most trusted row."""
    rank = F.when(c("anomaly_level") == "HIGH", 3).when(c("anomaly_level") == "MEDIUM", 2).when(c("anomaly_level") == "LOW", 1).when(c("anomaly_level") == "UNKNOWN", 0).otherwise(-1)
    g = rows.where((_said("file") != "") & (_said("period") != "")).groupBy("file", "period")
    return g.agg(
        *[collapsed(c(f)).alias(f) for f in flags], F.max(F.coalesce("integrity_score", F.lit(0))).alias("integrity_score"), F.max_by("anomaly_level", rank).alias("anomaly_level"),
        F.max_by("label", F.struct("conf", "confidence", "line_no")).alias("label"), F.first(ff.path_parts(c("file"))["company"]).alias("company"), F.count("*").alias("n_rows"),
    ).withColumn("period_sort_key", dates.period_key(c("period")))


def with_integrity(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows with score and anomaly of their statement where the index (one row a file and period) has it, else their own."""
    i = index.select("file", "period", c("integrity_score").alias("_score"), c("anomaly_level").alias("_level"))
    out = rows.join(i, ["file", "period"], "left")
    return out.withColumns({"integrity_score": F.coalesce("_score", "integrity_score"), "anomaly_level": F.coalesce("_level", "anomaly_level")}).drop("_score", "_level")


def fallback_lookup(rows: DataFrame, exact: DataFrame, general: DataFrame, exact_keys: list[str], general_keys: list[str], value: str) -> DataFrame:
    """rows with ``value`` by the exact keys, else by the general ones; each lookup has one row a key."""
    out = rows.join(exact.select(*exact_keys, c(value).alias("_exact")), exact_keys, "left").join(general.select(*general_keys, c(value).alias("_general")), general_keys, "left")
    return out.withColumns({value: F.coalesce("_exact", "_general"), f"{value}_from": F.when(c("_exact").isNotNull(), "exact").when(c("_general").isNotNull(), "general").otherwise("none")}).drop("_exact", "_general")


# Periods that only relate to the filing's date, and how rows of metrics other than cash are labelled.
RELATIVE_ONLY = ("current quarter", "previous quarter", "prior quarter", "current period", "previous period")
LABEL_HINTS = {
    "revenue": r"\brevenue\b|\bturnover\b|\btotal\s+income\b",
    "gross_profit": r"\bgross\s+profit\b|\bgross\s+income\b",
    "ebit": r"\bebit\b|\boperating\s+profit\b|\boperating\s+income\b|\bprofit\s+from\s+operations\b",
    "ebitda": r"\bebitda\b",
    "net_income": r"\bnet\s+income\b|\bnet\s+profit\b|\bprofit\s+after\s+tax\b|\bprofit\s+after\s+taxation\b|\bprofit\s+after\s+income\s+tax\b|\bloss\s+after\s+tax\b|\bloss\s+after\s+taxation\b|\bloss\s+after\s+income\s+tax\b|\bprofit\s+or\s+loss\b|\bprofit\s*/?\s*\(?loss\)?\b|\b(?:profit|loss)(?:\s+after\s+tax(?:ation)?)?\s+attributable\s+to\b",
    "npat": r"\bnpat\b|\bnet\s+profit\s+after\s+tax\b",
}


def row_issues(rows: DataFrame) -> Column:
    """Names of the eleven kinds of fault that a metric row shows."""
    metric, title, label = F.lower(F.trim(_said("metric"))), F.trim(_said("statement_title")), F.trim(_said("row_label"))
    period, line = F.trim(_said("period")), F.trim(_said("line"))
    end_of = lambda word: line.rlike(rf"(?i)cash\s+and\s+cash\s+equivalents\s+at\s+(?:the\s+)?{word}\s+of")
    hinted = reduce(lambda out, m: F.when(metric == m[0], label.rlike("(?i)" + m[1])).otherwise(out), LABEL_HINTS.items(), F.lit(True))
    tests = {
        "empty_period": period == "",
        "empty_statement_period_end": F.trim(_said("statement_period_end")) == "",
        "relative_only_period": F.lower(period).isin(*RELATIVE_ONLY),
        "split_missing_balance_date": (metric.endswith("_opening") | metric.endswith("_closing")) & (F.trim(_said("balance_date")) == ""),
        "numeric_only_statement_title": title.rlike(r"^\d{1,3}$"),
        "page_footer_statement_title": title.rlike(r"(?i)^page\s+\d+\s+of\s+\d+$"),
        "trailing_note_statement_title": title.rlike(r"(?i)should\s+be\s+read\s+in\s+conjunction"),
        "cash_unsplit_end_phrase": (metric == "cash_and_equivalents") & end_of("end"),
        "cash_unsplit_begin_phrase": (metric == "cash_and_equivalents") & end_of("beginning"),
        "non_cash_missing_row_label": metric.isin(*LABEL_HINTS) & (label == ""),
        "non_cash_label_metric_mismatch": metric.isin(*LABEL_HINTS) & (label != "") & ~hinted,
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


# The core metrics of the statements.
INCOME_CORE = ("revenue", "ebit", "net_income")
BALANCE_CORE = ("total_assets", "total_liabilities", "total_equity", "cash_and_equivalents", "total_debt")


def period_classes(rows: DataFrame, least_conf: int = 0) -> DataFrame:
    """Per period: which cores its set of metrics holds and one of five classes. rows: period, metric, conf."""
    kept = rows.where((_said("period") != "") & (_said("metric") != "") & (F.coalesce("conf", F.lit(0)) >= least_conf))
    s = kept.groupBy("period").agg(F.collect_set(ff.metric_name(c("metric"))).alias("have"))
    has = lambda m: F.array_contains("have", m)
    all_of = lambda names: reduce(lambda a, m: a & has(m), names, F.lit(True))
    balance_n = F.size(F.array_intersect("have", F.array(*map(F.lit, BALANCE_CORE))))
    ocf, capex, fcf = has("operating_cash_flow"), has("capital_expenditure"), has("free_cash_flow")
    s = s.withColumns({"income_core": all_of(INCOME_CORE), "balance_core": all_of(BALANCE_CORE), "cash_core": (ocf & capex) | fcf, "balance_partial": (balance_n > 0) & ~all_of(BALANCE_CORE), "cash_partial": (ocf != capex) | (fcf & ~(ocf & capex))})
    label = (
        F.when(c("income_core") & c("balance_core") & c("cash_core"), "FULL_STATEMENTS_PRESENT")
        .when(c("income_core") & (balance_n == 0) & ~c("cash_core") & ~c("cash_partial"), "INCOME_ONLY")
        .when(c("balance_partial") & ~c("cash_partial"), "BALANCE_SHEET_PARTIAL")
        .when(c("cash_partial") & ~c("balance_partial"), "CASHFLOW_PARTIAL")
        .otherwise("MULTI_SECTION_MISSING")
    )
    gone = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, BALANCE_CORE)), "have")), ",")
    other = lambda m: (balance_n - has(m).cast("int") >= 2) & ~has(m)
    return s.withColumns({"classification": label, "missing_balance": gone, "debt_missing": other("total_debt"), "cash_missing": other("cash_and_equivalents"), "n_metrics": F.size("have").cast("long")})


def forensic_summary(classes: DataFrame) -> DataFrame:
    """One row: periods of each class and whether gaps repeat (two periods at least and 30 % of all)."""
    n = lambda label: F.count_if(c("classification") == label)
    balance = F.count_if((c("classification") == "BALANCE_SHEET_PARTIAL") | c("debt_missing") | c("cash_missing"))
    cash = F.count_if((c("classification") == "CASHFLOW_PARTIAL") | c("cash_partial"))
    s = classes.agg(F.count("*").alias("total_periods"), n("INCOME_ONLY").alias("income_only"), n("FULL_STATEMENTS_PRESENT").alias("full_statements"), n("MULTI_SECTION_MISSING").alias("multi_section_missing"), balance.alias("balance_gaps"), cash.alias("cash_gaps"))
    repeated = lambda x: (c(x) >= 2) & (c(x) >= 0.3 * c("total_periods"))
    return s.withColumn("structural_pattern", repeated("balance_gaps") | repeated("cash_gaps") | (c("income_only") >= 2) | (c("multi_section_missing") >= 2))


def near_numbers(lines: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """lines (key, line_no, number) with the number of their own line, else of the nearest within reach; of two equally near that below.

    Offsets are lags and leads of one window, so there's no range join.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    order = [0, *[x for n in range(1, reach + 1) for x in (n, -n)]]
    at = lambda n: F.lead("number", n).over(w) if n > 0 else F.lag("number", -n).over(w) if n < 0 else c("number")
    step = lambda n: F.lead("line_no", n).over(w) if n > 0 else F.lag("line_no", -n).over(w) if n < 0 else c("line_no")
    # lines are numbered without gaps, so the nth row is the nth line
    tries = [F.when(F.abs(step(n) - c("line_no")) == abs(n), at(n)) for n in order]
    return lines.withColumn("near_number", F.coalesce(*tries))


def numeric_pages(lines: DataFrame, key: str, line: str = "line", least_lines: int = 3, least_numbers: int = 2) -> DataFrame:
    """(key, dense_lines, is_numeric) per page: whether at least three of its lines hold two or more larger numbers."""
    major = F.regexp_count(F.col(line), F.lit(r"\d{1,3}(?:,\d{3})+|\d{4,}"))
    g = lines.groupBy(key).agg(F.count_if(major >= least_numbers).alias("dense_lines"))
    return g.withColumn("is_numeric", F.col("dense_lines") >= least_lines)


def section_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """pages (by, page, section, is_numeric) with ``in_section``: pages with a heading of their own begin one, numeric pages right after go on with it."""
    w = Window.partitionBy(*by).orderBy("page")
    p = pages.withColumn("stop", (c("section").isNotNull() | ~c("is_numeric") | (c("page") - F.lag("page").over(w) > 1)).cast("int"))
    p = p.withColumn("run", F.sum(F.coalesce("stop", F.lit(1))).over(w))
    first = F.first("section").over(Window.partitionBy(*by, "run").orderBy("page"))
    return p.withColumn("in_section", first).drop("stop", "run")


def column_date(head: Column, context: Column, hints: Column, years: Column, column: Column, n_columns: Column) -> Column:
    """A column's date: of the header's (head) by its place, else the context's first, else a bare year's with the day of one of hints or its last day."""
    place = lambda found: (column - F.greatest(n_columns - F.size(found), F.lit(0))).cast("int")

    def of(year: Column) -> Column:
        last = F.try_element_at(hints, F.lit(1))
        of_year = F.try_element_at(F.filter(hints, lambda d: F.year(d) == year), F.lit(1))
        return F.coalesce(of_year, F.when(last.isNotNull() & year.isNotNull(), F.last_day(F.make_date(year, F.month(last), F.lit(1)))), F.make_date(year, F.lit(12), F.lit(31)))

    return F.coalesce(F.get(head, place(head)), F.try_element_at(context, F.lit(1)), once(F.get(years, place(years)).try_cast("int"), of))


def column_periods(cells: DataFrame) -> DataFrame:
    """cells (header, context, document_hint, label, column, n_columns) with ``period``: that of the column's date.

    A date in the row's own label ("at 30 June") takes the year of the column's; else the
    header's dates count in order, from the right where columns are more than dates; else
    the context's date, else a bare year's date in header, context or hint.
    """
    # dates are columns of their own while others are worked out of them, or each use would search the texts again
    n = cells.withColumns({"_head": dates.explicit_dates(c("header")), "_context": dates.explicit_dates(c("context")), "_hint": dates.explicit_dates(c("document_hint")), "_years": F.regexp_extract_all("header", F.lit(dates.YEAR), 0)})
    n = n.withColumn("_hints", F.concat("_head", "_context", "_hint"))
    n = n.withColumn("_found", column_date(c("_head"), c("_context"), c("_hints"), c("_years"), c("column"), c("n_columns")))
    found = c("_found")
    own = rf"(?i)\b(?:as\s+at|at)\s+(\d{{1,2}})\s+({dates.MONTH})\b"
    anchored = F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("label", own, 1), F.initcap(F.substring(F.regexp_extract("label", own, 2), 1, 3)), F.year(found).cast("string")), F.lit("d MMM yyyy")))
    n = n.withColumn("period", F.date_format(F.coalesce(F.when(c("label").rlike(own), anchored), found), "yyyy-MM-dd"))
    return n.drop("_head", "_context", "_hint", "_years", "_hints", "_found")
