"""Long-format metric facts: gates, identities, quarantine, winners, ratios.

A fact is (company, period, metric, value, conf, integrity, ord); ord breaks ties that
would otherwise hang on the order of input. All shuffles are on (company, period) or a
prefix of it, and conditional aggregates pivot metrics in one partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("company", "period")
EPS = 1e-9


def gate(facts: DataFrame, min_conf: int = 2, min_integrity: int = 0) -> DataFrame:
    return facts.where((F.coalesce(F.trim("period"), F.lit("")) != "") & (F.coalesce("conf", F.lit(0)) >= min_conf) & (F.coalesce("integrity", F.lit(0)) >= min_integrity))


def pivot_last(facts: DataFrame, metrics: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """One row a key with a column per metric, the last writer (greatest ord) winning."""
    pick = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("ord"))).alias(m)
    return facts.where(F.col("metric").isin(*metrics)).groupBy(*key).agg(*[pick(m) for m in metrics])


def pivot_best(facts: DataFrame, metrics: list[str], key: tuple[str, ...] = KEY) -> DataFrame:
    """As pivot_last, by confidence, then least ord."""
    pick = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.struct("conf", -F.col("ord")))).alias(m)
    return facts.where(F.col("metric").isin(*metrics)).groupBy(*key).agg(*[pick(m) for m in metrics])


def balance_failures(facts: DataFrame, abs_tol: float = 2.0, rel_tol: float = 0.0001) -> DataFrame:
    """Keys whose assets differ from liabilities plus equity under either sign of the liabilities."""
    p = pivot_last(facts, ["total_assets", "total_liabilities", "total_equity"]).dropna()
    signed = F.col("total_assets") - (F.col("total_liabilities") + F.col("total_equity"))
    size = F.col("total_assets") - (F.abs("total_liabilities") + F.col("total_equity"))
    p = p.withColumns({"difference_signed": signed, "difference_magnitude": size, "tolerance": F.greatest(F.lit(abs_tol), F.abs("total_assets") * rel_tol)})
    near = F.abs("difference_signed") <= F.abs("difference_magnitude")
    out = p.withColumn("equation_mode", F.when(near, "signed_liabilities").otherwise("liability_magnitude")).withColumn("difference", F.when(near, F.col("difference_signed")).otherwise(F.col("difference_magnitude")))
    return out.where(F.least(F.abs("difference_signed"), F.abs("difference_magnitude")) > F.col("tolerance"))


CASH = ["cash_opening", "cash_closing", "operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "net_cash_movement"]


def cash_failures(facts: DataFrame, abs_tol: float = 2.0, rel_tol: float = 0.0001) -> DataFrame:
    """Keys whose closing cash isn't opening plus movement (reported, or the sum of the three flows)."""
    p = pivot_last(facts, CASH).where("cash_opening is not null and cash_closing is not null")
    flows = F.col("operating_cash_flow") + F.col("investing_cash_flow") + F.col("financing_cash_flow")
    p = p.withColumn("expected_closing", F.col("cash_opening") + F.coalesce("net_cash_movement", flows)).where("expected_closing is not null")
    p = p.withColumns({"difference": F.col("cash_closing") - F.col("expected_closing"), "tolerance": F.greatest(F.lit(abs_tol), F.abs("cash_closing") * rel_tol)})
    return p.where(F.abs("difference") > F.col("tolerance"))


# Metrics whose rows go with a failed identity.
BALANCE_METRICS = ("total_assets", "total_liabilities", "total_equity", "current_assets", "current_liabilities")
CASH_METRICS = ("operating_cash_flow", "capital_expenditure", "capex", "free_cash_flow", "cash_opening", "cash_closing")


def quarantine(facts: DataFrame, abs_tol: float = 2.0, rel_tol: float = 0.0001) -> DataFrame:
    """facts with ``quarantined``: the family's rows of each key that fails its identity."""
    bad_balance = balance_failures(facts, abs_tol, rel_tol).select(*KEY, F.lit(True).alias("_b"))
    bad_cash = cash_failures(facts, abs_tol, rel_tol).select(*KEY, F.lit(True).alias("_c"))
    out = facts.join(bad_balance, list(KEY), "left").join(bad_cash, list(KEY), "left")
    hit = (F.col("metric").isin(*BALANCE_METRICS) & F.coalesce("_b", F.lit(False))) | (F.col("metric").isin(*CASH_METRICS) & F.coalesce("_c", F.lit(False)))
    return out.withColumn("quarantined", hit).drop("_b", "_c")


def best_rows(facts: DataFrame) -> DataFrame:
    """The one row of each (company, period, metric): confidence, integrity, size, value, then first."""
    w = Window.partitionBy(*KEY, "metric").orderBy(F.desc("conf"), F.desc("integrity"), F.abs("value").desc(), F.desc("value"), "ord")
    return facts.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def resolve_conflicts(facts: DataFrame) -> DataFrame:
    """Every row with its role among rows of its key of different values: winner, demoted, duplicate or single."""
    by = Window.partitionBy(*KEY, "metric")
    ranked = by.orderBy(F.desc("conf"), F.desc("integrity"), "ord")
    out = facts.withColumns({"rn": F.row_number().over(ranked), "winner_ord": F.first("ord").over(ranked), "winner_value": F.first("value").over(ranked), "low": F.min("value").over(by), "high": F.max("value").over(by), "n": F.count("*").over(by)})
    role = F.when(F.col("n") == 1, "single").when(F.col("rn") == 1, "winner").when(F.col("value") == F.col("winner_value"), "duplicate").otherwise("demoted")
    return out.withColumn("role", role).withColumn("conflict", F.col("low") != F.col("high")).drop("rn", "low", "high", "n", "winner_value")


def collisions(facts: DataFrame) -> DataFrame:
    """Groups whose best rows tie: reconciled if they agree on value, decided by unit evidence if one leads, else quarantined."""
    rank = Window.partitionBy(*KEY, "metric").orderBy(F.desc("conf"), F.desc("integrity"))
    top = facts.withColumn("rk", F.rank().over(rank)).where("rk = 1")
    g = top.groupBy(*KEY, "metric").agg(F.count("*").alias("tied"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("unit_evidence").alias("evidence"))
    lead = top.join(g, [*KEY, "metric"]).where("unit_evidence = evidence").groupBy(*KEY, "metric").agg(F.count("*").alias("leaders"))
    out = g.where("tied > 1").join(lead, [*KEY, "metric"])
    return out.withColumn("outcome", F.when(F.col("low") == F.col("high"), "reconciled").when(F.col("leaders") == 1, "unit_evidence").otherwise("quarantined"))


RATIO_INPUTS = ["revenue", "ebit", "ebitda", "npat", "net_debt", "total_debt", "total_equity", "free_cash_flow", "operating_cash_flow", "cash_closing"]


def ratio_inputs(facts: DataFrame) -> DataFrame:
    p = pivot_best(facts, RATIO_INPUTS)
    net = F.coalesce("net_debt", F.col("total_debt") - F.col("cash_closing"))
    debt = F.coalesce("total_debt", F.col("net_debt") + F.col("cash_closing"))
    return p.withColumns({"net_debt": net, "total_debt": debt})


def derived_ratios(facts: DataFrame, tax_rate: float = 0.30) -> DataFrame:
    """(company, period, metric, value) of each ratio whose inputs are there and whose base isn't zero."""
    c = F.col
    over = lambda a, b: F.when(F.abs(b) > EPS, a / b)
    invested = c("total_debt") + c("total_equity") - c("cash_closing")
    base = F.when(F.abs("npat") > EPS, c("npat")).otherwise(c("ebit"))
    burn = F.when(c("free_cash_flow") < 0, c("free_cash_flow")).when(c("operating_cash_flow") < 0, c("operating_cash_flow"))
    made = {
        "ebitda_amount": c("ebitda"),
        "ebit_margin_pct": over(c("ebit"), c("revenue")) * 100.0,
        "net_debt_to_ebitda": over(c("net_debt"), c("ebitda")),
        "debt_to_equity": over(c("total_debt"), c("total_equity")),
        "roic_pct": over(c("ebit") * (1.0 - tax_rate), invested) * 100.0,
        "fcf_conversion_pct": over(c("free_cash_flow"), base) * 100.0,
        "cash_runway_periods": over(c("cash_closing"), F.abs(burn)),
    }
    p = ratio_inputs(facts)
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in made.items()])
    return p.select(*KEY, F.explode(pairs).alias("m")).select(*KEY, "m.metric", "m.value").where("value is not null")


def incremental_margin(facts: DataFrame) -> DataFrame:
    """Change of ebit over change of revenue between adjacent periods; none where either side lacks a figure."""
    p = pivot_best(facts, ["revenue", "ebit", "total_assets"])
    w = Window.partitionBy("company").orderBy("period")
    p = p.withColumns({"d_revenue": F.col("revenue") - F.lag("revenue").over(w), "d_ebit": F.col("ebit") - F.lag("ebit").over(w)})
    return p.where(F.abs("d_revenue") > EPS).where("d_ebit is not null").select(*KEY, (F.col("d_ebit") / F.col("d_revenue") * 100.0).alias("incremental_margin_pct"))


def revenue_cagr(facts: DataFrame) -> DataFrame:
    p = pivot_best(facts, ["revenue"]).where("revenue > 0")
    g = p.groupBy("company").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.min_by("revenue", "period").alias("first_revenue"), F.max_by("revenue", "period").alias("last_revenue"))
    g = g.withColumn("years", F.datediff(F.to_date("last_period"), F.to_date("first_period")) / 365.25)
    return g.where("years >= 1").withColumn("revenue_cagr_pct", (F.pow(F.col("last_revenue") / F.col("first_revenue"), 1.0 / F.col("years")) - 1.0) * 100.0)


def presence(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """0/1 per metric and key, what is missing, and the completeness score (0.45 income, 0.45 balance, 0.10 cash flow)."""
    has = facts.groupBy(*KEY).agg(*[F.max(F.when((F.col("metric") == m) & F.col("value").isNotNull(), 1).otherwise(0)).alias(m) for m in metrics])
    part = lambda ms: sum(F.col(m) for m in ms) / float(len(ms))
    income, balance, cash = ["revenue", "ebit", "npat"], ["total_assets", "total_debt", "total_equity"], ["operating_cash_flow", "free_cash_flow"]
    gone = F.array_join(F.array_compact(F.array(*[F.when(F.col(m) == 0, F.lit(m)) for m in metrics])), ",")
    return has.withColumn("missing", gone).withColumn("completeness", F.round(0.45 * part(income) + 0.45 * part(balance) + 0.10 * part(cash), 4))


def capital_structure(facts: DataFrame) -> DataFrame:
    """Net debt and free cash flow as reported, else derived, with the source and leverage flag."""
    p = pivot_best(facts, ["net_debt", "total_debt", "cash_closing", "free_cash_flow", "operating_cash_flow", "capex", "ebitda"])
    debt = F.coalesce("net_debt", F.col("total_debt") - F.col("cash_closing"))
    flow = F.coalesce("free_cash_flow", F.col("operating_cash_flow") - F.col("capex"))
    source = lambda raw, made: F.when(F.col(raw).isNotNull(), "canonical_existing").when(made.isNotNull(), "structural_derivation").otherwise("insufficient_inputs")
    ratio = F.when(F.abs("ebitda") > EPS, debt / F.col("ebitda"))
    flag = F.when(debt.isNull() | F.col("ebitda").isNull(), "UNKNOWN").when(F.col("ebitda") <= 0, "CRITICAL").when(ratio < 2.0, "LOW").when(ratio <= 3.5, "MEDIUM").otherwise("HIGH")
    return p.select(*KEY, debt.alias("net_debt"), source("net_debt", debt).alias("net_debt_source"), flow.alias("free_cash_flow"), source("free_cash_flow", flow).alias("free_cash_flow_source"), F.when(debt.isNull() | F.col("ebitda").isNull(), "insufficient_inputs").otherwise("sufficient_inputs").alias("support"), flag.alias("leverage_flag"))


def currency_cascade(rows: DataFrame, least_rows: int = 5, share: float = 0.9) -> DataFrame:
    """rows (file, ticker, currency) with the hint filled: own, the file's only one, else the ticker's dominant one."""
    by_file = rows.where("currency is not null").groupBy("file").agg(F.min("currency").alias("only"), F.max("currency").alias("_max")).where("only = _max").select("file", "only")
    per = rows.where("currency is not null").groupBy("ticker", "currency").agg(F.count("*").alias("n"))
    tops = per.groupBy("ticker").agg(F.sum("n").alias("total"), F.max("n").alias("best"), F.min_by("currency", F.struct(-F.col("n"), "currency")).alias("dominant")).where((F.col("total") >= least_rows) & (F.col("best") >= share * F.col("total"))).select("ticker", "dominant")
    out = rows.join(by_file, "file", "left").join(tops, "ticker", "left")
    source = F.when(F.col("currency").isNotNull(), "own").when(F.col("only").isNotNull(), "file").when(F.col("dominant").isNotNull(), "ticker").otherwise("none")
    return out.withColumn("filled", F.coalesce("currency", "only", "dominant")).withColumn("fill_source", source)
