"""Every registered query of the library itself against its SQL."""

import pytest

from tests.oracle import differences

from __spark_entry__ import PLANS, entry

QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
SQL = {k: v for p in PLANS for k, v in p.SQL.items()}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, medium, name):
    assert differences(spark, QUERIES[name], SQL[name], medium) == ""


def test_whole_tables_are_covered(spark, small):
    orders, events = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "events"))
    assert QUERIES["number_extract"](spark, small).count() == orders.count()
    asked = QUERIES["embedding_topk_all"](spark, small).select("query_id").distinct().count()
    assert asked == spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert QUERIES["asof_reaction"](spark, small).count() > events.count() // 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    assert entry(spark).count() > 0
