"""Which pages of a file belong to which statement: headings, continuation pages and why they end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filings import forensic_summary, period_classes

c = F.col

# Headings of statements, what leaves a page out, what a cash flow statement goes on with, and headings of notes.
HEADINGS = {
    "income_statement": r"(?i)\bstatement\s+of\s+profit\s+or\s+loss\b|\bincome\s+statement\b|\bstatement\s+of\s+comprehensive\s+income\b",
    "balance_sheet": r"(?i)\bstatement\s+of\s+financial\s+position\b|\bbalance\s+sheet\b",
    "cash_flow": r"(?i)\bstatement\s+of\s+cash\s+flows?\b|\bcash\s+flow\s+statement\b",
}
EXCLUDED = r"(?i)\bnotes?\s+to\s+the\s+financial\s+statements?\b|\breconciliation\b|\bnon[-\s]?ifrs\b|\bunderlying\b|\badjusted\b"
CASH_CUES = r"(?i)\boperating\s+activities\b|\binvesting\s+activities\b|\bfinancing\s+activities\b|\bcash\s+generated\s+from\s+operations\b|\bnet\s+operating\s+cash\s+flow\b|\bnet\s+cash\b|\bcash\s+and\s+cash\s+equivalents\b"
NOTES = r"(?i)\bnotes?\s+to\s+the\s+financial\s+statements?\b|^\s*notes?\b"
#: How many pages a cash flow statement goes on for.
CASH_PAGES = 2


def _cash_stop(text: Column) -> Column:
    """Why a page doesn't go on with a cash flow statement; null if it does."""
    other = text.rlike(HEADINGS["income_statement"]) | text.rlike(HEADINGS["balance_sheet"])
    return F.when(other, "next_statement_heading").when(text.rlike(NOTES), "notes").when(text.rlike(EXCLUDED), "excluded_page").when(~text.rlike(CASH_CUES), "no_continuation_cue")


def marked_pages(pages: DataFrame) -> DataFrame:
    """pages (file, page, text, is_numeric) with the statements they head, whether they are left out, and the state of each statement: heading, continuation or null.

    Income statement and balance sheet go on over the numeric pages right after one that is
    in them, unless those are left out or head another statement. A cash flow statement
    goes on over the next ``CASH_PAGES`` pages there are while cues persist. All states
    are carried by windows over a file's pages in order.
    """
    left_out = c("text").rlike(EXCLUDED)
    p = pages.withColumns({"left_out": left_out, **{f"h_{s}": ~left_out & c("text").rlike(x) for s, x in HEADINGS.items()}, "cash_stop": _cash_stop(c("text"))})
    w = Window.partitionBy("file").orderBy("page")
    headed = F.lit(False)
    for s in HEADINGS:
        headed = headed | c(f"h_{s}")
    next_to = c("page") - F.lag("page").over(w) == 1
    for s in ("income_statement", "balance_sheet"):
        goes_on = next_to & ~c("left_out") & ~headed & c("is_numeric")
        p = p.withColumn("_run", F.sum((c(f"h_{s}") | ~F.coalesce(goes_on, F.lit(False))).cast("int")).over(w))
        begun = F.first(f"h_{s}").over(Window.partitionBy("file", "_run").orderBy("page"))
        p = p.withColumn(s, F.when(c(f"h_{s}"), "heading").when(begun, "continuation")).drop("_run")
    fits = c("cash_stop").isNull()
    reached = F.lit(False)
    chain = fits
    for k in range(1, CASH_PAGES + 1):
        reached = reached | (chain & F.coalesce(F.lag("h_cash_flow", k).over(w), F.lit(False)))
        chain = chain & F.coalesce(F.lag(fits, k).over(w), F.lit(False))
    return p.withColumn("cash_flow", F.when(c("h_cash_flow"), "heading").when(reached, "continuation"))


def section_index(marked: DataFrame) -> DataFrame:
    """(file, section, first_page, last_page, n_pages, n_continued) of each run of a statement's pages."""
    every = marked.select("file", "page", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), c(s).alias("state")) for s in HEADINGS])).alias("s")).select("file", "page", "s.*").where("state is not null")
    w = Window.partitionBy("file", "section").orderBy("page")
    runs = every.withColumn("run", c("page") - F.row_number().over(w))
    return runs.groupBy("file", "section", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_pages"), F.count_if(c("state") == "continuation").alias("n_continued")).drop("run")


def cash_stops(marked: DataFrame) -> DataFrame:
    """(file, page, reason) of each heading of a cash flow statement: why it goes no further."""
    w = Window.partitionBy("file").orderBy("page")
    there = [F.lead("page", k).over(w).isNotNull() for k in range(1, CASH_PAGES + 1)]
    stops = [F.lead("cash_stop", k).over(w) for k in range(1, CASH_PAGES + 1)]
    reason = F.lit("max_pages")
    for here, stop in reversed(list(zip(there, stops, strict=True))):
        reason = F.when(~here, "max_pages").when(stop.isNotNull(), stop).otherwise(reason)
    return marked.withColumn("reason", reason).where("h_cash_flow").select("file", "page", "reason")


def layer_comparison(before: DataFrame, more: DataFrame) -> DataFrame:
    """(name, before, after, delta) of the forensic counts of metric rows (period, metric, conf) without and with those that a section layer adds.

    Rows of a metric and period that are there already add nothing. A structural pattern counts as one.
    """
    new = more.join(before.select("period", "metric").distinct(), ["period", "metric"], "left_anti")

    def counts(rows: DataFrame, name: str) -> DataFrame:
        s = forensic_summary(period_classes(rows))
        every = F.array(*[F.struct(F.lit(k).alias("name"), c(k).cast("long").alias(name)) for k in s.columns])
        return s.select(F.explode(every).alias("x")).select("x.*")

    both = counts(before, "before").join(counts(before.unionByName(new), "after"), "name")
    return both.withColumn("delta", c("after") - c("before"))
