"""Registered queries over metric facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk, warehouse
from .common import BEST, FACTS_SQL, LAST, facts, pivot_sql, wide_facts

SPREAD = ["revenue", "ebit", "npat", "total_assets", "total_debt", "total_equity", "operating_cash_flow", "free_cash_flow"]


_BALANCE = f"""bp as ({pivot_sql(["total_assets", "total_liabilities", "total_equity"], LAST)}),
bd as (select *, total_assets - (total_liabilities + total_equity) as difference_signed, total_assets - (abs(total_liabilities) + total_equity) as difference_magnitude, greatest(2.0, abs(total_assets) * 0.0001) as tolerance from bp where total_assets is not null and total_liabilities is not null and total_equity is not null),
bf as (select *, case when abs(difference_signed) <= abs(difference_magnitude) then 'signed_liabilities' else 'liability_magnitude' end as equation_mode, case when abs(difference_signed) <= abs(difference_magnitude) then difference_signed else difference_magnitude end as difference from bd where least(abs(difference_signed), abs(difference_magnitude)) > tolerance)"""
_CASH = f"""cp as ({pivot_sql(warehouse.CASH, LAST)}),
ce as (select *, cash_opening + coalesce(net_cash_movement, operating_cash_flow + investing_cash_flow + financing_cash_flow) as expected_closing from cp where cash_opening is not null and cash_closing is not null),
cf as (select *, cash_closing - expected_closing as difference, greatest(2.0, abs(cash_closing) * 0.0001) as tolerance from ce where expected_closing is not null and abs(cash_closing - expected_closing) > greatest(2.0, abs(cash_closing) * 0.0001))"""
_INPUTS = ["revenue", "ebit", "ebitda", "npat", "net_debt", "total_debt", "total_equity", "free_cash_flow", "operating_cash_flow", "cash_closing"]
_RATIOS = f"""ri as (select * replace (coalesce(net_debt, total_debt - cash_closing) as net_debt, coalesce(total_debt, net_debt + cash_closing) as total_debt) from ({pivot_sql(_INPUTS, BEST)})),
rb as (select *, total_debt + total_equity - cash_closing as invested, case when free_cash_flow < 0 then free_cash_flow when operating_cash_flow < 0 then operating_cash_flow end as burn from ri),
derived as (select * from (
  select company, period, 'ebitda_amount' as metric, ebitda as value from rb
  union all select company, period, 'ebit_margin_pct', case when abs(revenue) > 1e-9 then ebit / revenue end * 100.0 from rb
  union all select company, period, 'net_debt_to_ebitda', case when abs(ebitda) > 1e-9 then net_debt / ebitda end from rb
  union all select company, period, 'debt_to_equity', case when abs(total_equity) > 1e-9 then total_debt / total_equity end from rb
  union all select company, period, 'roic_pct', case when abs(invested) > 1e-9 then ebit * (1.0 - 0.30) / invested end * 100.0 from rb
  union all select company, period, 'fcf_conversion_pct', case when abs(case when abs(npat) > 1e-9 then npat else ebit end) > 1e-9 then free_cash_flow / case when abs(npat) > 1e-9 then npat else ebit end end * 100.0 from rb
  union all select company, period, 'cash_runway_periods', case when abs(burn) > 1e-9 then cash_closing / abs(burn) end from rb) where value is not null)"""


def _ratios(spark, d):
    return warehouse.derived_ratios(facts(spark, d))


def _num(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def fact_long(spark, d):
    return facts(spark, d).select("company", "period", "metric", "value", "conf", "integrity", "ord")


def gate_rows(spark, d):
    return warehouse.gate(facts(spark, d), 2, 1).select("company", "period", "metric", "value", "conf", "integrity", "ord")


def best_fact_per_key(spark, d):
    return warehouse.best_rows(facts(spark, d)).select("company", "period", "metric", "value", "conf", "ord")


def conflict_resolution(spark, d):
    return warehouse.resolve_conflicts(facts(spark, d)).select("company", "period", "metric", "ord", "role", "conflict", "winner_ord")


def candidate_collision(spark, d):
    f = facts(spark, d).withColumn("conf", F.floor(F.col("conf") / 3)).withColumn("unit_evidence", ((F.col("ord") + F.col("k")) % 3).cast("int"))
    return warehouse.collisions(f).select("company", "period", "metric", "tied", "leaders", "outcome")


def balance_identity_gate(spark, d):
    return warehouse.balance_failures(facts(spark, d)).select("company", "period", "difference", "tolerance", "equation_mode")


def cash_reconciliation_gate(spark, d):
    return warehouse.cash_failures(facts(spark, d)).select("company", "period", "cash_opening", "cash_closing", "expected_closing", "difference", "tolerance")


def statement_quarantine(spark, d):
    return warehouse.quarantine(facts(spark, d)).groupBy("company", "metric").agg(F.count("*").alias("n_rows"), F.sum(F.col("quarantined").cast("int")).alias("n_quarantined"))


def derived_ratios(spark, d):
    return _num(_ratios(spark, d), "value")


def incremental_margin(spark, d):
    return _num(warehouse.incremental_margin(facts(spark, d)), "incremental_margin_pct")


def revenue_cagr(spark, d):
    return _num(warehouse.revenue_cagr(facts(spark, d)), "revenue_cagr_pct", "years")


def leverage_risk(spark, d):
    return _num(risk.leverage_and_liquidity(_ratios(spark, d), *risk.PROFILES), "signal_value")


def margin_streaks(spark, d):
    return _num(risk.margin_signals(_ratios(spark, d)), "signal_value")


def strongest_signals(spark, d):
    s = risk.leverage_and_liquidity(_ratios(spark, d), *risk.PROFILES)
    return _num(risk.strongest(s.withColumn("ord", F.when(F.col("profile") == "institutional", 0).otherwise(1)).drop("profile")), "signal_value")


def capital_structure(spark, d):
    return warehouse.capital_structure(facts(spark, d))


def presence_matrix(spark, d):
    return warehouse.presence(facts(spark, d), SPREAD)


def metric_gap_blinks(spark, d):
    p = warehouse.presence(facts(spark, d), SPREAD)
    cells = p.select("company", "period", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("present")) for m in SPREAD])).alias("c")).select("company", "period", "c.*")
    return risk.gaps_and_blinks(cells)


def risk_flicker(spark, d):
    s = _ratios(spark, d).where("metric = 'net_debt_to_ebitda'").select("company", "period", (F.col("value") > 3.5).cast("int").alias("state"))
    return risk.transitions(s)


def economic_flags(spark, d):
    return risk.economic_flags(wide_facts(spark, d))


def coverage_company(spark, d):
    p = warehouse.presence(facts(spark, d), SPREAD)
    hits = sum(F.col(m) for m in SPREAD)
    return p.groupBy("company").agg(F.count("*").alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.sum(hits).alias("present"), F.round(F.sum(hits) * 100.0 / (F.count("*") * len(SPREAD)), 4).alias("coverage_pct"))


def currency_cascade(spark, d):
    f = facts(spark, d)
    rows = f.select(F.concat("company", F.lit("/"), "period").alias("file"), F.col("company").alias("ticker"), "metric", "ord", F.when((F.col("k") + F.col("ord")) % 4 == 0, F.when((F.col("nation") % 5 == 0) & (F.col("ord") % 3 == 0), "USD").otherwise("AUD")).alias("currency"))
    return warehouse.currency_cascade(rows).groupBy("ticker", "filled", "fill_source").agg(F.count("*").alias("n_rows"))


_PRESENCE = "pm as (select company, period, " + ", ".join(f"max(case when metric = '{m}' and value is not null then 1 else 0 end) as {m}" for m in SPREAD) + " from facts group by company, period)"
_LEVELS = """select '{p}' as profile, company, period, 'net_debt_to_ebitda_risk' as signal_name, case when e <= 0 then e else n end as signal_value, case when e <= 0 then 'CRITICAL' when n < {low} then 'LOW' when n <= {mid} then 'MEDIUM' when n is not null then 'HIGH' end as risk_level from sp
  union all select '{p}', company, period, 'cash_runway_risk', c, case when c < {crit} then 'CRITICAL' when c < {high} then 'HIGH' when c is not null then 'LOW' end from sp"""
_SIGNALS = "sp as (select company, period, max(case when metric = 'ebitda_amount' then value end) as e, max(case when metric = 'net_debt_to_ebitda' then value end) as n, max(case when metric = 'cash_runway_periods' then value end) as c from derived group by 1, 2),\nsig as (" + "\n  union all ".join(_LEVELS.format(p=k, low=v.leverage_low, mid=v.leverage_medium, crit=v.runway_critical, high=v.runway_high) for k, v in risk.PROFILES.items()) + ")"

SQL = {
    "fact_long": FACTS_SQL + "select company, period, metric, value, conf, integrity, ord from facts",
    "gate_rows": FACTS_SQL + "select company, period, metric, value, conf, integrity, ord from facts where conf >= 2 and integrity >= 1",
    "best_fact_per_key": FACTS_SQL + "select company, period, metric, value, conf, ord from facts qualify row_number() over (partition by company, period, metric order by conf desc, integrity desc, abs(value) desc, value desc, ord) = 1",
    "conflict_resolution": FACTS_SQL + """select company, period, metric, ord, case when n = 1 then 'single' when rn = 1 then 'winner' when value = wv then 'duplicate' else 'demoted' end as role, low <> high as conflict, winner_ord from (
  select *, row_number() over w as rn, first_value(ord) over w as winner_ord, first_value(value) over w as wv, min(value) over p as low, max(value) over p as high, count(*) over p as n from facts
  window w as (partition by company, period, metric order by conf desc, integrity desc, ord), p as (partition by company, period, metric))""",
    "candidate_collision": FACTS_SQL + """, t as (select *, (ord + k) % 3 as ev from facts qualify rank() over (partition by company, period, metric order by conf // 3 desc, integrity desc) = 1), g as (select company, period, metric, count(*) as tied, min(value) as low, max(value) as high, max(ev) as evidence from t group by 1, 2, 3),
l as (select t.company, t.period, t.metric, count(*) as leaders from t join g using (company, period, metric) where ev = evidence group by 1, 2, 3)
select company, period, metric, tied, leaders, case when low = high then 'reconciled' when leaders = 1 then 'unit_evidence' else 'quarantined' end as outcome from g join l using (company, period, metric) where tied > 1""",
    "balance_identity_gate": FACTS_SQL + ", " + _BALANCE + " select company, period, difference, tolerance, equation_mode from bf",
    "cash_reconciliation_gate": FACTS_SQL + ", " + _CASH + " select company, period, cash_opening, cash_closing, expected_closing, difference, tolerance from cf",
    "statement_quarantine": FACTS_SQL + ", " + _BALANCE + ", " + _CASH + """ select company, metric, count(*) as n_rows, cast(sum(case when (metric in ('total_assets', 'total_liabilities', 'total_equity') and (company, period) in (select company, period from bf)) or (metric in ('operating_cash_flow', 'capex', 'free_cash_flow', 'cash_opening', 'cash_closing') and (company, period) in (select company, period from cf)) then 1 else 0 end) as bigint) as n_quarantined from facts group by 1, 2""",
    "derived_ratios": FACTS_SQL + ", " + _RATIOS + " select company, period, metric, round(value, 6) as value from derived",
    "incremental_margin": FACTS_SQL + f", p as ({pivot_sql(['revenue', 'ebit', 'total_assets'], BEST)}), l as (select company, period, revenue - lag(revenue) over w as dr, ebit - lag(ebit) over w as de from p window w as (partition by company order by period)) select company, period, round(de / dr * 100.0, 6) as incremental_margin_pct from l where abs(dr) > 1e-9 and de is not null",
    "revenue_cagr": FACTS_SQL + f", p as ({pivot_sql(['revenue'], BEST)}), g as (select company, min(period) as first_period, max(period) as last_period, arg_min(revenue, period) as first_revenue, arg_max(revenue, period) as last_revenue from p where revenue > 0 group by 1), y as (select *, date_diff('day', cast(first_period as date), cast(last_period as date)) / 365.25 as y0 from g) select company, first_period, last_period, first_revenue, last_revenue, round(y0, 6) as years, round((pow(last_revenue / first_revenue, 1.0 / y0) - 1.0) * 100.0, 6) as revenue_cagr_pct from y where y0 >= 1",
    "leverage_risk": FACTS_SQL + ", " + _RATIOS + ", " + _SIGNALS + " select company, period, signal_name, round(signal_value, 6) as signal_value, risk_level, profile from sig where risk_level is not null",
    "margin_streaks": FACTS_SQL + ", " + _RATIOS + """, m as (select company, period, value as cur, lag(value) over (partition by company order by period) as prev from derived where metric = 'ebit_margin_pct'),
a as (select *, prev - cur as drop_pp, (prev - cur) * 100.0 as drop_bps from m where prev is not null), b as (select *, abs(prev) > 200 or abs(cur) > 200 or abs(drop_bps) > 5000 as odd from a),
c as (select *, (not odd and drop_pp > 0) as falls from b), i as (select *, sum(case when falls then 0 else 1 end) over (partition by company order by period) as island from c), s as (select *, sum(falls::int) over (partition by company, island order by period) as streak from i)
select company, period, 'ebit_margin_compression' as signal_name, round(drop_bps, 6) as signal_value, case when drop_bps > 600 then 'CRITICAL' else 'HIGH' end as risk_level from s where not odd and drop_bps > 300
union all select company, period, 'ebit_margin_structural_compression', round(cast(streak as double), 6), 'HIGH' from s where not odd and streak >= 2""",
    "strongest_signals": FACTS_SQL + ", " + _RATIOS + ", " + _SIGNALS + """ select company, period, signal_name, round(signal_value, 6) as signal_value, risk_level, case profile when 'institutional' then 0 else 1 end as ord from sig where risk_level is not null
qualify row_number() over (partition by company, period, signal_name order by case risk_level when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 else 3 end desc, case profile when 'institutional' then 0 else 1 end) = 1""",
    "capital_structure": FACTS_SQL + f""", p as ({pivot_sql(["net_debt", "total_debt", "cash_closing", "free_cash_flow", "operating_cash_flow", "capex", "ebitda"], BEST)}), q as (select company, period, net_debt as nd, free_cash_flow as fr, coalesce(net_debt, total_debt - cash_closing) as net_debt, coalesce(free_cash_flow, operating_cash_flow - capex) as fcf, ebitda from p)
select company, period, net_debt, case when nd is not null then 'canonical_existing' when net_debt is not null then 'structural_derivation' else 'insufficient_inputs' end as net_debt_source, fcf as free_cash_flow, case when fr is not null then 'canonical_existing' when fcf is not null then 'structural_derivation' else 'insufficient_inputs' end as free_cash_flow_source,
case when net_debt is null or ebitda is null then 'insufficient_inputs' else 'sufficient_inputs' end as support,
case when net_debt is null or ebitda is null then 'UNKNOWN' when ebitda <= 0 then 'CRITICAL' when net_debt / ebitda < 2.0 then 'LOW' when net_debt / ebitda <= 3.5 then 'MEDIUM' else 'HIGH' end as leverage_flag from q""",
    "presence_matrix": FACTS_SQL + ", " + _PRESENCE + " select *, concat_ws(',', " + ", ".join(f"case when {m} = 0 then '{m}' end" for m in SPREAD) + ") as missing, round(0.45 * ((revenue + ebit + npat) / 3.0) + 0.45 * ((total_assets + total_debt + total_equity) / 3.0) + 0.10 * ((operating_cash_flow + free_cash_flow) / 2.0), 4) as completeness from pm",
    "metric_gap_blinks": FACTS_SQL + ", " + _PRESENCE + ", cells as (" + " union all ".join(f"select company, period, '{m}' as metric, {m} as present from pm" for m in SPREAD) + """), c as (select *, case when lag(present) over w = 1 and present = 0 and lead(present) over w = 1 then 1 else 0 end as blink, sum(present) over w as run from cells window w as (partition by company, metric order by period)),
g as (select company, metric, run, sum(1 - present) as zeros, sum(blink) as blinks from c group by 1, 2, 3) select company, metric, cast(max(zeros) as bigint) as longest_gap, cast(sum(blinks) as bigint) as blinks from g group by 1, 2""",
    "risk_flicker": FACTS_SQL + ", " + _RATIOS + """, s as (select company, period, (value > 3.5)::int as state from derived where metric = 'net_debt_to_ebitda'), l as (select *, lag(state) over w as prev, lead(state) over w as nxt from s window w as (partition by company order by period)),
m as (select *, case when prev is null then 0 else (prev <> state)::int end as moved from l), r as (select *, sum(moved) over (partition by company order by period) as run from m),
g as (select company, run, count(*) as n, sum(moved) as moved, sum((state = 1 and coalesce(prev, 0) = 0 and coalesce(nxt, 0) = 0)::int) as lone from r group by 1, 2),
t as (select company, cast(sum(n) as bigint) as n_periods, cast(sum(moved) as bigint) as n_transitions, max(n) as longest_run, cast(sum(lone) as bigint) as isolated_high from g group by 1)
select *, round(case when n_periods > 1 then n_transitions / (n_periods - 1) else 0.0 end, 6) as transition_rate, (case when n_periods > 1 then n_transitions / (n_periods - 1) else 0.0 end) > 0.5 as flicker from t""",
    "economic_flags": FACTS_SQL + """, d as (select company, npat, operating_cash_flow, revenue - lag(revenue) over w as dr, ebit - lag(ebit) over w as de, case when abs(ebitda) > 1e-9 then total_debt / ebitda end as lev, lag(case when abs(ebitda) > 1e-9 then total_debt / ebitda end) over w as pl from wide window w as (partition by company order by period))
select company, cast(sum(case when dr > 0 and de < 0 or dr < 0 and de > 0 then 1 else 0 end) as bigint) as direction_mismatch, cast(sum(case when npat > 0 and operating_cash_flow < 0 or npat < 0 and operating_cash_flow > 0 then 1 else 0 end) as bigint) as sign_mismatch, cast(sum(case when abs(lev - pl) > 3 then 1 else 0 end) as bigint) as leverage_jumps from d group by 1""",
    "coverage_company": FACTS_SQL + ", " + _PRESENCE + f" select company, count(*) as n_periods, min(period) as first_period, max(period) as last_period, cast(sum({' + '.join(SPREAD)}) as bigint) as present, round(sum({' + '.join(SPREAD)}) * 100.0 / (count(*) * {len(SPREAD)}), 4) as coverage_pct from pm group by 1",
    "currency_cascade": FACTS_SQL + """, r as (select company || '/' || period as file, company as ticker, case when (k + ord) % 4 = 0 then case when nation % 5 = 0 and ord % 3 = 0 then 'USD' else 'AUD' end end as currency from facts),
f as (select file, min(currency) as only_one from r where currency is not null group by 1 having min(currency) = max(currency)), p as (select ticker, currency, count(*) as n from r where currency is not null group by 1, 2),
t as (select ticker, arg_min(currency, (-n, currency)) as dominant from p group by 1 having sum(n) >= 5 and max(n) >= 0.9 * sum(n))
select r.ticker, coalesce(currency, only_one, dominant) as filled, case when currency is not null then 'own' when only_one is not null then 'file' when dominant is not null then 'ticker' else 'none' end as fill_source, count(*) as n_rows from r left join f on r.file = f.file left join t on r.ticker = t.ticker group by 1, 2, 3""",
}
QUERIES = {k: globals()[k] for k in SQL}
