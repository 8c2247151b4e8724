"""Risk signals and stability measures over ordered periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


@dataclass(frozen=True)
class Profile:
    leverage_low: float
    leverage_medium: float
    runway_high: float
    runway_critical: float
    drop_bps: float
    drops: int
    most_margin: float
    most_drop_bps: float


# Thresholds of the two profiles.
PROFILES = {
    "institutional": Profile(2.0, 3.5, 4.0, 2.0, 300.0, 2, 200.0, 5000.0),
    "aggressive": Profile(1.5, 3.0, 6.0, 3.0, 200.0, 2, 300.0, 10000.0),
}


def leverage_and_liquidity(derived: DataFrame, *profiles: str) -> DataFrame:
    """(company, period, signal_name, signal_value, risk_level, profile) per period and profile from derived (company, period, metric, value).

    The figures are gathered once; the profiles are literals that each row is held against.
    """
    one = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    p = derived.groupBy("company", "period").agg(one("ebitda_amount"), one("net_debt_to_ebitda"), one("cash_runway_periods"))
    bad, ratio, runway = F.col("ebitda_amount") <= 0, F.col("net_debt_to_ebitda"), F.col("cash_runway_periods")
    rows = []
    for name in profiles or ("institutional",):
        t = PROFILES[name]
        level = F.when(bad, "CRITICAL").when(ratio < t.leverage_low, "LOW").when(ratio <= t.leverage_medium, "MEDIUM").when(ratio.isNotNull(), "HIGH")
        liquid = F.when(runway < t.runway_critical, "CRITICAL").when(runway < t.runway_high, "HIGH").when(runway.isNotNull(), "LOW")
        rows += [
            F.struct(F.lit("net_debt_to_ebitda_risk").alias("signal_name"), F.when(bad, F.col("ebitda_amount")).otherwise(ratio).alias("signal_value"), level.alias("risk_level"), F.lit(name).alias("profile")),
            F.struct(F.lit("cash_runway_risk").alias("signal_name"), runway.alias("signal_value"), liquid.alias("risk_level"), F.lit(name).alias("profile")),
        ]
    return p.select("company", "period", F.explode(F.array(*rows)).alias("s")).select("company", "period", "s.*").where("risk_level is not null")


def margin_signals(derived: DataFrame, profile: str = "institutional") -> DataFrame:
    """Margin compression and runs of falling margins; implausible rows emit nothing and end a run, as any rise does."""
    t = PROFILES[profile]
    w = Window.partitionBy("company").orderBy("period")
    m = derived.where("metric = 'ebit_margin_pct'").select("company", "period", F.col("value").alias("cur"))
    m = m.withColumn("prev", F.lag("cur").over(w)).where("prev is not null").withColumn("drop_pp", F.col("prev") - F.col("cur")).withColumn("drop_bps", F.col("drop_pp") * 100.0)
    odd = (F.abs("prev") > t.most_margin) | (F.abs("cur") > t.most_margin) | (F.abs("drop_bps") > t.most_drop_bps)
    m = m.withColumn("falls", ~odd & (F.col("drop_pp") > 0)).withColumn("odd", odd)
    m = m.withColumn("island", F.sum(F.when(F.col("falls"), 0).otherwise(1)).over(w))
    m = m.withColumn("streak", F.sum(F.col("falls").cast("int")).over(Window.partitionBy("company", "island").orderBy("period")))
    rows = F.array(
        F.when(~F.col("odd") & (F.col("drop_bps") > t.drop_bps), F.struct(F.lit("ebit_margin_compression").alias("signal_name"), F.col("drop_bps").alias("signal_value"), F.when(F.col("drop_bps") > 2 * t.drop_bps, "CRITICAL").otherwise("HIGH").alias("risk_level"))),
        F.when(~F.col("odd") & (F.col("streak") >= t.drops), F.struct(F.lit("ebit_margin_structural_compression").alias("signal_name"), F.col("streak").cast("double").alias("signal_value"), F.lit("HIGH").alias("risk_level"))),
    )
    return m.select("company", "period", F.explode(F.array_compact(rows)).alias("s")).select("company", "period", "s.*")


def strongest(signals: DataFrame) -> DataFrame:
    """The worst signal of each (company, period, signal_name), the first of equals by ``ord``."""
    rank = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])[F.col("risk_level")]
    w = Window.partitionBy("company", "period", "signal_name").orderBy(rank.desc(), "ord")
    return signals.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def transitions(states: DataFrame) -> DataFrame:
    """Per company over ordered states (0/1): transitions, rate, flicker (> 0.5), longest steady run, isolated highs."""
    w = Window.partitionBy("company").orderBy("period")
    s = states.withColumns({"prev": F.lag("state").over(w), "next": F.lead("state").over(w)})
    s = s.withColumn("moved", F.when(F.col("prev").isNull(), 0).otherwise((F.col("prev") != F.col("state")).cast("int"))).withColumn("run", F.sum("moved").over(w))
    runs = s.groupBy("company", "run").agg(F.count("*").alias("n"), F.sum("moved").alias("moved"), F.sum(((F.col("state") == 1) & (F.coalesce("prev", F.lit(0)) == 0) & (F.coalesce("next", F.lit(0)) == 0)).cast("int")).alias("lone"))
    out = runs.groupBy("company").agg(F.sum("n").alias("n_periods"), F.sum("moved").alias("n_transitions"), F.max("n").alias("longest_run"), F.sum("lone").alias("isolated_high"))
    rate = F.when(F.col("n_periods") > 1, F.col("n_transitions") / (F.col("n_periods") - 1)).otherwise(F.lit(0.0))
    return out.withColumn("transition_rate", F.round(rate, 6)).withColumn("flicker", rate > 0.5)


def gaps_and_blinks(cells: DataFrame) -> DataFrame:
    """Per (company, metric) over ordered presence (0/1): longest run of absence and number of 1-0-1 blinks."""
    by = Window.partitionBy("company", "metric")
    w = by.orderBy("period")
    c = cells.withColumn("blink", ((F.lag("present").over(w) == 1) & (F.col("present") == 0) & (F.lead("present").over(w) == 1)).cast("int")).withColumn("run", F.sum("present").over(w))
    g = c.groupBy("company", "metric", "run").agg(F.sum(1 - F.col("present")).alias("zeros"), F.sum(F.coalesce("blink", F.lit(0))).alias("blinks"))
    return g.groupBy("company", "metric").agg(F.max("zeros").alias("longest_gap"), F.sum("blinks").alias("blinks"))


def economic_flags(wide: DataFrame) -> DataFrame:
    """Per company: direction mismatches of revenue and ebit, sign mismatches of npat and cash flow, leverage jumps over 3."""
    w = Window.partitionBy("company").orderBy("period")
    d = wide.withColumns({"dr": F.col("revenue") - F.lag("revenue").over(w), "de": F.col("ebit") - F.lag("ebit").over(w), "lev": F.when(F.abs("ebitda") > 1e-9, F.col("total_debt") / F.col("ebitda"))})
    d = d.withColumn("dl", F.abs(F.col("lev") - F.lag("lev").over(w)))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return d.groupBy("company").agg(count((F.col("dr") > 0) & (F.col("de") < 0) | (F.col("dr") < 0) & (F.col("de") > 0)).alias("direction_mismatch"), count((F.col("npat") > 0) & (F.col("operating_cash_flow") < 0) | (F.col("npat") < 0) & (F.col("operating_cash_flow") > 0)).alias("sign_mismatch"), count(F.col("dl") > 3).alias("leverage_jumps"))
