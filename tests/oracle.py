"""Compares a query's rows with those of its SQL run by DuckDB over the same tables."""

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    """Values as both engines give them: floats to 9 significant digits."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "tzinfo") and v.tzinfo:
        return str(v.replace(tzinfo=None))
    if hasattr(v, "year"):
        s = str(v)
        return s.removesuffix(" 00:00:00")
    return v


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in values)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows, else what differs first."""
    df = query(spark, sf_dir)
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if got == want:
        return "" if got else "both are empty"
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).elements())[:3]}; only SQL {list((want - got).elements())[:3]}"
