"""Registered queries over orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import backlog, prices
from .common import table

AS_OF = "1998-12-31"


def latest_order_per_customer(spark, d):
    o = backlog.latest_per_key(table(spark, d, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", "o_orderkey", "o_orderdate", "o_orderstatus")


def recent_customer_activity(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    return g.orderBy(F.desc("last_order"), F.desc("n_orders"), "o_custkey").limit(40)


def order_backlog_by_age(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", backlog.age_bucket(F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date"))).alias("age"))
    return o.cube("age", "o_orderstatus").agg(F.count("*").alias("n_orders"), F.grouping_id().alias("level"))


def order_period_gaps(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("period"))
    return backlog.period_gaps(rows, "A")


def new_since_snapshot(spark, d):
    o = table(spark, d, "orders")
    new = backlog.new_since(o, o.where("o_orderdate < timestamp'1996-01-01'"), "o_custkey")
    return new.groupBy("o_custkey").agg(F.count("*").alias("n_new"), F.min("o_orderdate").alias("first_new"))


def incremental_sync(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    stored = o.where("o_orderdate < timestamp'1997-01-01'").select("o_orderkey", F.round("o_totalprice").alias("mark"))
    current = o.where("o_orderdate >= timestamp'1993-01-01'").select("o_orderkey", (F.round("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("mark"))
    return backlog.sync_states(stored, current, "o_orderkey", "mark").groupBy("state").agg(F.count("*").alias("n_orders"))


def order_upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    out = backlog.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey", "year"], [F.desc("_new"), F.desc("o_orderkey")])
    return out.select("o_custkey", "year", "o_orderkey", "o_totalprice")


def regression_gate(spark, d):
    o = table(spark, d, "orders")
    base = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 6 + 1).alias("rank"))
    cur = o.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 8 + 1).alias("rank"))
    return backlog.regression_gate(base, cur).groupBy("verdict").agg(F.count("*").alias("n_cases"))


def _ticks(spark, d):
    e = table(spark, d, "events").where("value is not null")
    return e.select(F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")).alias("ticker"), F.date_trunc("hour", "ts").alias("ts"), (F.round("value", 2) + 10).alias("close"), F.col("event_id").alias("ord"))


def _closes(spark, d):
    return prices.keep_last(_ticks(spark, d))


def price_returns(spark, d):
    return prices.returns(_closes(spark, d)).select("ticker", "ts", "close", *[F.round(f"ret_{n}", 6).alias(f"ret_{n}") for n in (1, 5, 20, 63)])


def price_trend(spark, d):
    # closes have two decimals: in cents the sums are whole, so averages compare alike everywhere
    cents = _closes(spark, d).withColumn("close", F.round(F.col("close") * 100))
    a = prices.averages(cents)
    return a.select("ticker", "ts", "close", F.round("sma_short", 4).alias("sma_short"), F.round("sma_long", 4).alias("sma_long"), "trend")


def price_volatility(spark, d):
    return prices.volatility(_closes(spark, d)).select("ticker", "ts", F.round("vol_pct", 4).alias("vol_pct"))


def price_drawdown(spark, d):
    return prices.drawdown(_closes(spark, d)).select("ticker", "ts", F.round("drawdown_pct", 6).alias("drawdown_pct"), F.round("running_drawdown_pct", 6).alias("running_drawdown_pct"))


def price_alerts(spark, d):
    now = "2024-02-01 00:00:00"
    return prices.alerts(prices.latest_state(_closes(spark, d)), now)


def _news(spark, d):
    """Every event an announcement."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("news_id"), F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")).alias("ticker"), F.col("ts").alias("published_at"), F.col("event_type").alias("doc_class"))


def asof_reaction(spark, d):
    r = prices.asof_reaction(_news(spark, d), _closes(spark, d))
    return r.select("news_id", "ticker", "published_at", "anchor_ts", "close", *[F.round(f"ret_{n}", 6).alias(f"ret_{n}") for n in (1, 5, 20)])


def reaction_summary(spark, d):
    news = _news(spark, d)
    r = prices.asof_reaction(news, _closes(spark, d)).join(news.select("news_id", "doc_class"), "news_id")
    s = prices.reaction_summary(r, ["doc_class"])
    return s.select("doc_class", "n", *[F.round(c, 4).alias(c) for c in s.columns if c not in ("doc_class", "n")])


def top_movers(spark, d):
    r = prices.asof_reaction(_news(spark, d), _closes(spark, d)).where("ret_1 is not null")
    return r.orderBy(F.abs("ret_1").desc(), "news_id").limit(20).select("news_id", "ticker", F.round("ret_1", 6).alias("ret_1"))


MESSAGES = ["OCR failed on page 2", "request timed out", "JSONDecodeError: Expecting value", "connection refused", "EOF marker not found", "unexpected"]


def failure_taxonomy(spark, d):
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") * 7 % 6 + 1).cast("int")).alias("error"))
    return backlog.samples_per_class(e.withColumn("failure_class", backlog.failure_class(F.col("error"))), "failure_class", "event_id")


def daily_event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))


def health_snapshot(spark, d):
    e = table(spark, d, "events")
    s = e.agg(
        F.count("*").alias("n_events"), F.count_if(F.col("value").isNull()).alias("n_null_value"), F.countDistinct("user_id").alias("n_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("n_buyers"),
    )
    ratio = F.col("n_null_value") / F.col("n_events")
    return s.withColumn("status", F.when(F.col("n_events") == 0, "empty").when(ratio > 0.10, "degraded").otherwise("ok"))


def props_json(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_type", F.explode(F.map_keys(F.coalesce("m", F.create_map().cast("map<string,string>")))).alias("prop")).groupBy("event_type", "prop").agg(F.count("*").alias("n"))


def last_turns(spark, d, newest: int = 3):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = table(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= newest)
    return t.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def conversation_counts(spark, d):
    t = table(spark, d, "conversations")
    return t.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


_CLOSES = "ticks as (select 'T' || cast(user_id % 40 as varchar) as ticker, date_trunc('hour', ts) as ts, round(value, 2) + 10 as close, event_id as ord from events where value is not null), px as (select ticker, ts, arg_max(close, ord) as close from ticks group by 1, 2)"
_NEWS = "news as (select event_id as news_id, 'T' || cast(user_id % 40 as varchar) as ticker, ts as published_at, event_type as doc_class from events)"
_REACT = "lead_px as (select ticker, ts as anchor_ts, close, " + ", ".join(f"(lead(close, {n}) over w / nullif(close, 0) - 1.0) * 100.0 as ret_{n}" for n in (1, 5, 20)) + " from px window w as (partition by ticker order by ts)), re as (select n.news_id, n.ticker, n.published_at, n.doc_class, p.anchor_ts, p.close, p.ret_1, p.ret_5, p.ret_20 from news n asof join lead_px p on n.ticker = p.ticker and n.published_at >= p.anchor_ts)"
_STATE = "st as (select *, " + ", ".join(f"(close / nullif(lag(close, {n}) over w, 0) - 1.0) * 100.0 as ret_{n}" for n in (1, 20)) + ", case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as lr, max(close) over (partition by ticker order by ts rows between 62 preceding and current row) as near_max, count(*) over w as nn from px window w as (partition by ticker order by ts)), vo as (select *, case when nn > 20 and count(lr) over v >= 2 then stddev_samp(lr) over v * sqrt(252.0) * 100.0 end as vol_pct, case when near_max > 0 then (close / near_max - 1.0) * 100.0 end as drawdown_pct from st window v as (partition by ticker order by ts rows between 19 preceding and current row)), la as (select * from vo qualify ts = max(ts) over (partition by ticker))"

SQL = {
    "latest_order_per_customer": "select c_custkey, c_mktsegment, o_orderkey, o_orderdate, o_orderstatus from customer left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on c_custkey = o_custkey",
    "recent_customer_activity": "select o_custkey, count(*) as n_orders, max(o_orderdate) as last_order from orders group by 1 order by last_order desc, n_orders desc, o_custkey limit 40",
    "order_backlog_by_age": f"with o as (select o_orderstatus, date_diff('day', cast(o_orderdate as date), date '{AS_OF}') as n from orders), b as (select o_orderstatus, case when n is null then 'unknown' when n <= 7 then '0-7d' when n <= 30 then '8-30d' when n <= 90 then '31-90d' when n <= 365 then '91-365d' else '>365d' end as age from o) select age, o_orderstatus, count(*) as n_orders, grouping(age, o_orderstatus) as level from b group by cube (age, o_orderstatus)",
    "order_period_gaps": "with p as (select distinct o_custkey as key, cast(o_orderdate as date) as period from orders), g as (select *, lag(period) over (partition by key order by period) as previous from p) select key, period, previous, date_diff('day', previous, period) as gap_days from g where date_diff('day', previous, period) > 485",
    "new_since_snapshot": "select o_custkey, count(*) as n_new, min(o_orderdate) as first_new from orders where o_custkey not in (select o_custkey from orders where o_orderdate < timestamp '1996-01-01') group by 1",
    "incremental_sync": "with s as (select o_orderkey as k, round(o_totalprice) as m from orders where o_orderdate < timestamp '1997-01-01'), c as (select o_orderkey as k, round(o_totalprice) + case when o_orderkey % 7 = 0 then 1 else 0 end as m from orders where o_orderdate >= timestamp '1993-01-01') select case when s.k is null then 'added' when c.k is null then 'removed' when s.m is not distinct from c.m then 'unchanged' else 'changed' end as state, count(*) as n_orders from s full join c on s.k = c.k group by 1",
    "order_upsert": "select o_custkey, year(o_orderdate) as year, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderkey % 2 desc, o_orderkey desc) = 1",
    "regression_gate": "with b as (select o_orderkey as id, case when o_custkey % 9 <> 0 then o_custkey % 6 + 1 end as r from orders where o_orderkey % 5 <> 0), c as (select o_orderkey as id, case when o_custkey % 11 <> 0 then o_custkey % 8 + 1 end as r from orders where o_orderkey % 7 <> 0) select case when b.id is null then 'new' when c.id is null then 'gone' when b.r is not null and c.r is null then 'lost' when c.r > b.r + 1 then 'worse' when b.r is null and c.r is not null then 'gained' else 'kept' end as verdict, count(*) as n_cases from b full join c on b.id = c.id group by 1",
    "price_returns": f"with {_CLOSES} select ticker, ts, close, " + ", ".join(f"round((close / nullif(lag(close, {n}) over w, 0) - 1.0) * 100.0, 6) as ret_{n}" for n in (1, 5, 20, 63)) + " from px window w as (partition by ticker order by ts)",
    "price_trend": f"with {_CLOSES}, c as (select ticker, ts, round(close * 100) as close from px), a as (select *, case when count(close) over s >= 20 then avg(close) over s end as s20, case when count(close) over l >= 50 then avg(close) over l end as s50 from c window s as (partition by ticker order by ts rows between 19 preceding and current row), l as (partition by ticker order by ts rows between 49 preceding and current row)) select ticker, ts, close, round(s20, 4) as sma_short, round(s50, 4) as sma_long, case when s50 is not null then case when close > s20 and s20 > s50 then 'bull' when close < s20 and s20 < s50 then 'bear' else 'neutral' end when s20 is not null then case when close > s20 then 'bull' when close < s20 then 'bear' else 'neutral' end else 'neutral' end as trend from a",
    "price_volatility": f"with {_CLOSES}, l as (select *, case when close > 0 and lag(close) over w > 0 then ln(close / lag(close) over w) end as lr, count(*) over w as n from px window w as (partition by ticker order by ts)) select ticker, ts, round(case when n > 20 and count(lr) over v >= 2 then stddev_samp(lr) over v * sqrt(252.0) * 100.0 end, 4) as vol_pct from l window v as (partition by ticker order by ts rows between 19 preceding and current row)",
    "price_drawdown": f"with {_CLOSES}, m as (select *, max(close) over (partition by ticker order by ts rows between 62 preceding and current row) as a, max(close) over (partition by ticker order by ts rows unbounded preceding) as b from px) select ticker, ts, round(case when a > 0 then (close / a - 1.0) * 100.0 end, 6) as drawdown_pct, round(case when b > 0 then (close / b - 1.0) * 100.0 end, 6) as running_drawdown_pct from m",
    "price_alerts": f"with {_CLOSES}, {_STATE}, f as (select ticker, ts, case when abs(ret_1) >= 3 then ret_1 end as a, case when abs(ret_20) >= 10 then ret_20 end as b, case when vol_pct >= 45 then vol_pct end as c, case when drawdown_pct <= -12 then drawdown_pct end as d, case when epoch(timestamp '2024-02-01') - epoch(ts) > 345600 then (epoch(timestamp '2024-02-01') - epoch(ts)) / 3600.0 end as e from la), g as (select *, coalesce(greatest(0.0, case when a is not null then 2.0 end), 0.0) + coalesce(least(abs(a) / 100.0, 2.0), 0.0) as s1 from f), h as (select *, case when b is not null then greatest(s1, 2.0) + least(abs(b) / 100.0, 2.0) else s1 end as s2 from g), i as (select *, case when c is not null then greatest(s2, 2.0) + least(abs(c) / 100.0, 2.0) else s2 end as s3 from h), j as (select *, case when d is not null then greatest(s3, 2.0) + least(abs(d) / 100.0, 2.0) else s3 end as s4 from i) select ticker, ts, concat_ws(',', case when a is not null then 'ret_1d_move' end, case when b is not null then 'ret_20d_momentum' end, case when c is not null then 'high_volatility' end, case when d is not null then 'drawdown_63d' end, case when e is not null then 'stale_data' end) as alerts, round(case when e is not null then greatest(s4, 3.0) + least(abs(e) / 100.0, 2.0) else s4 end, 3) as score from j",
    "asof_reaction": f"with {_CLOSES}, {_NEWS}, {_REACT} select news_id, ticker, published_at, anchor_ts, close, round(ret_1, 6) as ret_1, round(ret_5, 6) as ret_5, round(ret_20, 6) as ret_20 from re",
    "reaction_summary": f"with {_CLOSES}, {_NEWS}, {_REACT} select doc_class, count(*) as n, " + ", ".join(f"round(avg(ret_{h}), 4) as avg_{h}, round(avg(abs(ret_{h})), 4) as avg_abs_{h}, round(avg(case when ret_{h} is not null then (ret_{h} > 0)::int end), 4) as positive_{h}" for h in (1, 5)) + " from re group by 1",
    "top_movers": f"with {_CLOSES}, {_NEWS}, {_REACT} select news_id, ticker, round(ret_1, 6) as ret_1 from re where ret_1 is not null order by abs(re.ret_1) desc, news_id limit 20",
    "failure_taxonomy": "with e as (select event_id, case event_id * 7 % 6 when 0 then 'ocr_or_text_unavailable' when 1 then 'parser_timeout' when 2 then 'llm_invalid_json' when 3 then 'provider_network' when 4 then 'corrupted_pdf' else 'unknown' end as failure_class from events), r as (select *, row_number() over (partition by failure_class order by event_id) as rn from e) select failure_class, count(*) as n, string_agg(case when rn <= 3 then cast(event_id as varchar) end, ',' order by event_id) as samples from r group by 1",
    "daily_event_windows": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n_events, count(distinct user_id) as n_users from events group by 1, 2",
    "health_snapshot": "select count(*) as n_events, count(*) filter (where value is null) as n_null_value, count(distinct user_id) as n_users, min(ts) as first_ts, max(ts) as last_ts, count(distinct case when event_type = 'purchase' then user_id end) as n_buyers, case when count(*) = 0 then 'empty' when count(*) filter (where value is null) / count(*) > 0.10 then 'degraded' else 'ok' end as status from events",
    "props_json": "select event_type, prop, count(*) as n from (select event_type, unnest(json_keys(props)) as prop from events) group by 1, 2",
    "last_turns": "select conv_id, turn, role, length(text) as n_chars from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3",
    "conversation_counts": "select conv_id, count(*) as n_turns, count(*) filter (where role = 'user') as n_user, max(turn) as last_turn, arg_max(role, turn) as last_role from conversations group by 1",
}
QUERIES = {k: globals()[k] for k in SQL}
