"""Price series: returns, averages, volatility, drawdown, alerts and reactions to announcements.

Series are (ticker, ts, close); windows partition by ticker, so work spreads over tickers.
Horizons count rows of the series, not days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_last(ticks: DataFrame) -> DataFrame:
    """One close for each (ticker, ts): the last by ``ord``."""
    return ticks.groupBy("ticker", "ts").agg(F.max_by("close", "ord").alias("close"))


def returns(prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 20, 63)) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ts")
    back = lambda n: F.lag("close", n).over(w)
    return prices.withColumns({f"ret_{n}": F.when(back(n) != 0, (F.col("close") / back(n) - 1.0) * 100.0) for n in horizons})


def averages(prices: DataFrame, short: int = 20, long: int = 50) -> DataFrame:
    """Moving averages (null until there are enough rows) and the trend they give."""
    w = Window.partitionBy("ticker").orderBy("ts")
    mean = lambda n: F.when(F.count("close").over(w.rowsBetween(1 - n, 0)) >= n, F.avg("close").over(w.rowsBetween(1 - n, 0)))
    out = prices.withColumns({"sma_short": mean(short), "sma_long": mean(long)})
    c, s, g = F.col("close"), F.col("sma_short"), F.col("sma_long")
    full = F.when((c > s) & (s > g), "bull").when((c < s) & (s < g), "bear").otherwise("neutral")
    part = F.when(c > s, "bull").when(c < s, "bear").otherwise("neutral")
    return out.withColumn("trend", F.when(g.isNotNull(), full).when(s.isNotNull(), part).otherwise("neutral"))


def volatility(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Annualised sample deviation of log returns over the last rows, in per cent; null before rows + 1 closes."""
    w = Window.partitionBy("ticker").orderBy("ts")
    p = prices.withColumn("log_ret", F.when((F.col("close") > 0) & (F.lag("close").over(w) > 0), F.log(F.col("close") / F.lag("close").over(w))))
    near = w.rowsBetween(1 - rows, 0)
    enough = (F.count("*").over(w) > rows) & (F.count("log_ret").over(near) >= 2)
    return p.withColumn("vol_pct", F.when(enough, F.stddev_samp("log_ret").over(near) * F.sqrt(F.lit(252.0)) * 100.0)).drop("log_ret")


def drawdown(prices: DataFrame, rows: int = 63) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("ts")
    near, ever = F.max("close").over(w.rowsBetween(1 - rows, 0)), F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return prices.withColumns({"drawdown_pct": F.when(near > 0, (F.col("close") / near - 1.0) * 100.0), "running_drawdown_pct": F.when(ever > 0, (F.col("close") / ever - 1.0) * 100.0)})


def latest_state(prices: DataFrame) -> DataFrame:
    """The last row of each ticker with all measures."""
    s = drawdown(volatility(averages(returns(prices))))
    w = Window.partitionBy("ticker")
    return s.withColumn("_last", F.max("ts").over(w)).where("ts = _last").drop("_last")


# Thresholds of alerts in per cent, and what the severities weigh.
ALERTS = {"ret_1d_abs": 3.0, "ret_20d_abs": 10.0, "vol_20d_ann": 45.0, "drawdown_63d": -12.0}
SEVERITY = {"info": 1.0, "warning": 2.0, "critical": 3.0}


def alerts(state: DataFrame, now, stale_hours: float = 96, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(ticker, ts, alerts, score) of each ticker's state: the worst severity, plus a hundredth of every value, two at most each.

    A row without a close is a failed look-up: it has the one alert price_error.
    """
    t = ALERTS | (thresholds or {})
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts")) / 3600.0
    one = lambda kind, severity, value: F.struct(F.lit(kind).alias("kind"), F.lit(SEVERITY[severity]).alias("weight"), value.cast("double").alias("value"))
    found = F.array_compact(F.array(
        F.when(F.abs("ret_1") >= t["ret_1d_abs"], one("ret_1d_move", "warning", F.col("ret_1"))),
        F.when(F.abs("ret_20") >= t["ret_20d_abs"], one("ret_20d_momentum", "warning", F.col("ret_20"))),
        F.when(F.col("vol_pct") >= t["vol_20d_ann"], one("high_volatility", "warning", F.col("vol_pct"))),
        F.when(F.col("drawdown_pct") <= t["drawdown_63d"], one("drawdown_63d", "warning", F.col("drawdown_pct"))),
        F.when(age > stale_hours, one("stale_data", "critical", age)),
    ))
    a = F.when(F.col("close").isNull(), F.array(one("price_error", "critical", F.lit(None)))).otherwise(found)
    # severities are counted as the alerts come: a later, worse one lifts the sum to its weight if that is more
    score = F.aggregate(a, F.lit(0.0), lambda total, x: F.greatest(total, x["weight"]) + F.when(x["value"].isNotNull(), F.least(F.abs(x["value"]) / 100.0, F.lit(2.0))).otherwise(0.0))
    return state.select("ticker", "ts", F.array_join(F.transform(a, lambda x: x["kind"]), ",").alias("alerts"), F.round(score, 3).alias("score"))


def asof_reaction(news: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """For each announcement (ticker, published_at, news_id) the last close at or before it and the returns that followed.

    Leads are taken on the price rows first; then both series are united and the last
    price row is carried forward within a ticker: one shuffle on ticker and no range join.
    """
    w = Window.partitionBy("ticker").orderBy("ts")
    ahead = {f"ret_{n}": F.when(F.col("close") != 0, (F.lead("close", n).over(w) / F.col("close") - 1.0) * 100.0) for n in horizons}
    p = prices.withColumns(ahead).select("ticker", "ts", F.struct(F.col("ts").alias("anchor_ts"), "close", *ahead).alias("p"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("news_id"))
    n = news.select("ticker", F.col("published_at").alias("ts"), F.lit(None).cast(p.schema["p"].dataType).alias("p"), F.lit(1).alias("kind"), F.col("news_id").cast("long"))
    both = p.unionByName(n).withColumn("p", F.last("p", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("ts", "kind", "news_id").rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("kind = 1 and p is not null").select("news_id", "ticker", F.col("ts").alias("published_at"), "p.*")


def reaction_summary(reactions: DataFrame, by: list[str], horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    cols = [F.count("*").alias("n")]
    for h in horizons:
        r = F.col(f"ret_{h}")
        cols += [F.avg(r).alias(f"avg_{h}"), F.avg(F.abs(r)).alias(f"avg_abs_{h}"), F.avg(F.when(r.isNotNull(), (r > 0).cast("int"))).alias(f"positive_{h}")]
    return reactions.groupBy(*by).agg(*cols)
