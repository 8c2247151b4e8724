"""Rows of cash flow pages: which may be capital expenditure, why others can't be looked for, and counters taken as rows pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import filings as ff

c = F.col

STATUTORY = ("statutory_annual", "half_year")
# Why a row of capital expenditure isn't looked for again.
BLOCKS = ("phrase_not_matched", "numeric_not_failed", "not_cashflow_page", "statutory_mismatch")


def cash_rows(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """rows (file, page, doc_type, row_text, metric, has_number, confidence) with their metric as cash rows have it, ``eligible`` and ``block_reason``.

    selected: (file, page) of cash flow pages. Eligible are rows of statutory reports on
    such pages that name capital expenditure and lack a number; the first reason against counts.
    """
    low = F.lower(F.coalesce("row_text", F.lit("")))
    capex = ff._any_of(low, ff.CAPEX_WORDS) & ~ff._any_of(low, ff.NOT_CAPEX)
    on = selected.select("file", "page").distinct().withColumn("on_page", F.lit(True))
    r = rows.join(on, ["file", "page"], "left").withColumns({"on_page": F.coalesce("on_page", F.lit(False)), "is_capex": capex, "now": ff.coerced_metric(c("metric"), c("row_text"), c("has_number"), c("confidence"))})
    reason = F.when(~c("is_capex"), BLOCKS[0]).when(c("has_number"), BLOCKS[1]).when(~c("on_page"), BLOCKS[2]).when(~c("doc_type").isin(*STATUTORY), BLOCKS[3]).otherwise("")
    out = r.withColumn("block_reason", reason).withColumn("eligible", c("block_reason") == "")
    return out.withColumns({"was": F.coalesce("metric", F.lit("")), "metric": c("now.metric"), "confidence": c("now.confidence")}).drop("now")


def counters() -> dict[str, Column]:
    """What is counted of ``cash_rows``, by name."""
    out = {
        "rows": F.lit(True), "rows_on_page": c("on_page"), "rows_off_page": ~c("on_page"), "numeric_rows": c("has_number"), "label_rows": ~c("has_number"),
        "capex_phrase_match": c("is_capex"), "capex_numeric_failed": c("is_capex") & ~c("has_number"), "capex_on_page": c("is_capex") & c("on_page"), "capex_off_page": c("is_capex") & ~c("on_page"), "capex_eligible": c("eligible"),
        "coerced": c("metric") != c("was"), "coerced_on_page": (c("metric") != c("was")) & c("on_page"), "unmapped": c("metric").isin("", "cashflow_unmapped"), "confident": c("confidence") >= 3, "without_confidence": c("confidence").isNull(),
    }
    for m in ("capital_expenditure", "operating_cash_flow", "capex", *ff.CASH_NAMES):
        out[f"metric_{m}"] = c("metric") == m
    for t in (*STATUTORY, "quarterly"):
        out |= {f"doc_{t}": c("doc_type") == t, f"capex_{t}": c("is_capex") & (c("doc_type") == t)}
    return out | {f"block_{b}": c("is_capex") & (c("block_reason") == b) if b != BLOCKS[0] else c("block_reason") == b for b in BLOCKS}


def counted(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows and the counters that are there once they have been read: taken in the same pass, no scan of their own."""
    seen = Observation()
    return rows.observe(seen, *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in counters().items()]), seen
