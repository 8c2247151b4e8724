"""Tables, and a mapping of the star schema onto metric facts for the registered queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


METRICS = {
    "revenue": "r",
    "ebit": "case l_returnflag when 'A' then r / 2 when 'R' then -r / 4 else r / 4 end",
    "ebitda": "case l_returnflag when 'A' then r / 2 when 'R' then -r / 8 else r / 2 end",
    "npat": "case when l_linestatus = 'F' then r / 8 else -r / 16 end",
    "total_debt": "case when l_suppkey % 2 = 0 then r * 4 else 0 end",
    "total_equity": "case when l_suppkey % 3 = 0 then r * 4 else r / 2 end",
    "total_liabilities": "case when l_suppkey % 2 = 0 then r * 4 else 0 end",
    "cash_opening": "case when l_linenumber = 1 then r else 0 end",
    "operating_cash_flow": "case when l_returnflag = 'R' then -r / 2 else r / 4 end",
    "investing_cash_flow": "case when l_linenumber % 2 = 0 then -r / 4 else 0 end",
    "financing_cash_flow": "case when l_linenumber % 3 = 0 then r / 8 else 0 end",
    "capex": "case when l_linenumber % 2 = 0 then r / 8 else 0 end",
}


def wide_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures per (company, month): a company is a nation's customers; sums of whole numbers over powers of two, so exact."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", (F.round("l_extendedprice") * 1.0).alias("r"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.last_day("o_orderdate").cast("string").alias("period"))
    who = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    rows = item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    # the few (nation, month) groups are summed map-side before the only wide shuffle
    w = rows.groupBy("nation", "period").agg(*[F.sum(F.expr(f"cast({e} as double)")).alias(k) for k, e in METRICS.items()], F.count("*").alias("n_rows"))
    month = F.month(F.to_date("period"))
    shock = F.when((F.col("nation") + month) % 7 == 0, 1.25).otherwise(1.0)
    w = w.withColumns({"company": F.concat(F.lit("N"), F.lpad(F.col("nation").cast("string"), 2, "0")), "k": (F.col("nation") * 13 + month * 7 + F.year(F.to_date("period"))) % 20})
    w = w.withColumn("total_assets", (F.col("total_debt") + F.col("total_equity")) * shock)
    w = w.withColumn("net_cash_movement", F.col("operating_cash_flow") + F.col("investing_cash_flow") + F.col("financing_cash_flow"))
    w = w.withColumn("cash_closing", F.col("cash_opening") + F.col("net_cash_movement") * F.when(F.col("k") == 3, 2.0).otherwise(1.0))
    return w.withColumns({"net_debt": F.col("total_debt") - F.col("cash_closing") + 8.0, "free_cash_flow": F.col("operating_cash_flow") - F.col("capex")})


#: metric, and the values of k for which a company doesn't report it; k is a residue of company and month.
LONG = [
    ("revenue", "k = 19"), ("ebit", "k in (5, 6)"), ("ebitda", "k in (7)"), ("npat", "k in (8)"), ("total_debt", "k in (9)"), ("total_equity", "k in (10)"), ("total_liabilities", "k in (9)"),
    ("total_assets", "k in (11)"), ("cash_opening", "k in (12)"), ("cash_closing", "k in (13)"), ("operating_cash_flow", "k in (14)"), ("investing_cash_flow", "k in (15)"),
    ("financing_cash_flow", "k in (15)"), ("net_cash_movement", "k in (1, 2, 3, 4)"), ("capex", "k in (16)"), ("net_debt", "k not in (0, 9)"), ("free_cash_flow", "k not in (6, 16, 17)"),
]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts, two candidate rows of some; confidence and integrity are residues, ord the place in the list."""
    w = wide_facts(spark, sf_dir)
    made = []
    for n, (metric, gone) in enumerate(LONG):
        for twin in (0, 1):
            cond = f"not ({gone})" + (f" and (nation + {n}) % 3 = 0" if twin else "")
            value = F.col(metric) * (1.0 + 0.5 * twin)
            made.append(F.when(F.expr(cond), F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.expr(f"cast((nation + {n} + {twin} * 2) % 5 as int)").alias("conf"), F.expr(f"cast((k + {n}) % 5 as int)").alias("integrity"), F.lit(n * 2 + twin).alias("ord"))))
    return w.select("company", "period", "nation", "k", F.explode(F.array_compact(F.array(*made))).alias("f")).select("company", "period", "nation", "k", "f.*")


_wide = ",\n    ".join(f"sum(cast({e} as double)) as {k}" for k, e in METRICS.items())
_union = "\n  union all\n  ".join(
    f"select company, period, nation, k, '{m}' as metric, {m} * {1.0 + 0.5 * t} as value, cast((nation + {n} + {t} * 2) % 5 as int) as conf, cast((k + {n}) % 5 as int) as integrity, {n * 2 + t} as ord from wide where not ({g})" + (f" and (nation + {n}) % 3 = 0" if t else "")
    for n, (m, g) in enumerate(LONG)
    for t in (0, 1)
)
#: The same as SQL: common table expressions wide and facts.
FACTS_SQL = f"""with item as (select l_orderkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, round(l_extendedprice) * 1.0 as r from lineitem),
w0 as (select c_nationkey as nation, cast(last_day(o_orderdate) as varchar) as period,
    {_wide}, count(*) as n_rows
  from item join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
w1 as (select *, 'N' || lpad(cast(nation as varchar), 2, '0') as company, (nation * 13 + month(cast(period as date)) * 7 + year(cast(period as date))) % 20 as k,
    (total_debt + total_equity) * case when (nation + month(cast(period as date))) % 7 = 0 then 1.25 else 1.0 end as total_assets,
    operating_cash_flow + investing_cash_flow + financing_cash_flow as net_cash_movement from w0),
w2 as (select *, cash_opening + net_cash_movement * case when k = 3 then 2.0 else 1.0 end as cash_closing from w1),
wide as (select *, total_debt - cash_closing + 8.0 as net_debt, operating_cash_flow - capex as free_cash_flow from w2),
facts as (
  {_union})
"""


def pivot_sql(metrics: list[str], order: str, source: str = "facts") -> str:
    """A select with the value of each metric of the row that ``order`` puts first, per key."""
    cols = ", ".join(f"max(case when metric = '{m}' then value end) as {m}" for m in metrics)
    names = ", ".join(f"'{m}'" for m in metrics)
    return f"select company, period, {cols} from (select * from {source} where metric in ({names}) qualify row_number() over (partition by company, period, metric order by {order}) = 1) group by company, period"


LAST, BEST = "ord desc", "conf desc, ord"


def scenarios(spark: SparkSession, sf_dir: str, rows: list[dict], kinds: str, keep: tuple[str, ...] = (), source: str = "orders", key: str = "o_orderkey") -> DataFrame:
    """Every row of a table with the fields (a DDL string, ``kinds``) of the scenario that its key's residue names, as ``case``."""
    t = table(spark, sf_dir, source)
    every = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(k.replace(' ', ': ', 1) for k in kinds.split(', ')).replace(';', ',')}>>")
    return t.select(key, *keep, F.pmod(F.col(key), F.lit(len(rows))).cast("int").alias("case"), F.element_at(every, (F.pmod(F.col(key), F.lit(len(rows))) + 1).cast("int")).alias("s")).select(key, *keep, "case", "s.*")


def expected_sql(rows: list, source: str = "orders", key: str = "o_orderkey", names: tuple[str, ...] = ("expected",)) -> str:
    """SQL of (key, what each scenario is to give): literals, written by hand, dealt out by the same residue."""
    def lit(x) -> str:
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        return f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else repr(x)

    made = ", ".join("(" + ", ".join([str(n), *map(lit, r if isinstance(r, tuple) else (r,))]) + ")" for n, r in enumerate(rows))
    return f"select {key}, {', '.join(names)} from {source} join (values {made}) as e(i, {', '.join(names)}) on {key} % {len(rows)} = i"
