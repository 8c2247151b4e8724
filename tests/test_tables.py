"""Tables on pages: whole pages written out with the rows they are to give, and pairs of rows against brute force."""

import re

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import tables


def words_of(sheet, rows):
    """Words of lines given as (y, [(x centre, text)])."""
    return [(sheet, n, t, x - 8.0, x + 8.0, float(y), y + 8.0) for n, (y, ws) in enumerate(rows) for x, t in ws]


KINDS = "sheet string, line_no int, text string, x0 double, x1 double, y0 double, y1 double"


def spread(text, x=20):
    return [(x + 40 * k, w) for k, w in enumerate(text.split())]


PAGE = [
    (0, spread("Consolidated income statement")),
    (10, [*spread("A$ million", 20), (300, "2024"), (400, "2023"), (500, "Change")]),
    (20, [*spread("Total revenue"), (301, "1,500"), (399, "1,250"), (500, "20.0%")]),
    (30, [*spread("EBITDA"), (300, "(300)"), (400, "410"), (501, "12%")]),
    (41, spread("Net debt")),
    (40, [(299, "777"), (401, "888")]),
    (50, spread("Free cash flow for the")),
    (60, [(300, "123"), (400, "456")]),
    (70, [*spread("Gross margin"), (300, "41.5%"), (400, "40.0%")]),
    (80, [*spread("The group had total assets"), (300, "5,000"), (400, "4,000")]),
]


def test_rows_of_a_page(spark):
    got = tables.table_metrics(spark.createDataFrame(words_of("a:1", PAGE), KINDS)).collect()
    rows = {(r.metric, r.col): (r.line_no, r.value, r.raw_value, r.currency, r.period_end, r.value_type) for r in got}
    million = 1_000_000.0
    assert rows == {
        ("revenue", 0): (2, 1500 * million, "1,500", "A$", "2024-12-31", "amount"), ("revenue", 1): (2, 1250 * million, "1,250", "A$", "2023-12-31", "amount"),
        ("ebitda", 0): (3, -300 * million, "(300)", "A$", "2024-12-31", "amount"), ("ebitda", 1): (3, 410 * million, "410", "A$", "2023-12-31", "amount"),
        ("net_debt", 0): (5, 777 * million, "777", "A$", "2024-12-31", "amount"), ("net_debt", 1): (5, 888 * million, "888", "A$", "2023-12-31", "amount"),
        ("free_cash_flow", 0): (7, 123 * million, "123", "A$", "2024-12-31", "amount"), ("free_cash_flow", 1): (7, 456 * million, "456", "A$", "2023-12-31", "amount"),
        ("gross_margin_pct", 0): (8, 41.5, "41.5%", "A$", "2024-12-31", "percent"), ("gross_margin_pct", 1): (8, 40.0, "40.0%", "A$", "2023-12-31", "percent"),
    }
    assert {r.row_label for r in got} == {"Total revenue", "EBITDA", "Net debt", "Net debt Free cash flow for the", "Gross margin"}


def test_two_tables_of_a_sheet_and_none(spark):
    far = [(200 + 10 * k, []) for k in range(9)]
    second = [(400, [*spread("Current quarter"), (300, "FY24"), (400, "FY23")]), (410, [*spread("Cash at bank at end of the year"), (330, "910"), (430, "1,020")]), (420, [*spread("Capex"), (330, "(77)"), (430, "(1,088)")])]
    lines = [*PAGE[:4], *far, *second]
    alone = [(0, [*spread("Total revenue"), (300, "1,500")]), (10, [*spread("EBITDA"), (300, "300")])]
    words = spark.createDataFrame(words_of("a:1", lines) + words_of("b:1", alone) + words_of("c:1", [(0, spread("no figures here"))]), KINDS)
    regions = {r.rid: r for r in tables.table_regions(tables.page_lines(words)).collect()}
    assert sorted(regions) == ["a:1:0", "a:1:1"]
    assert [(c.period, c.is_variance) for c in regions["a:1:0"].columns] == [("2024", False), ("2023", False), ("", True)]
    assert [round(c.x) for c in regions["a:1:1"].columns] == [330, 430]
    rows = {(r.metric, r.col): (r.value, r.period_end) for r in tables.table_metrics(words).where("rid = 'a:1:1'").collect()}
    assert rows == {("cash_and_equivalents_closing", 0): (910.0, "2024-12-31"), ("cash_and_equivalents_closing", 1): (1020.0, "2023-12-31"), ("capex", 1): (-1088.0, "2023-12-31")}
    assert tables.table_metrics(words.where("false")).count() == 0


def test_tables_of_a_long_sheet(spark):
    lines = []
    for k in range(40):  # a table every 60 lines, the last words of each too far from the next one's header
        lines += [(600 * k, [(300, f"30 June {2001 + k}"), (400, f"30 June {2000 + k}")]), (600 * k + 10, [*spread("Total revenue"), (300, "1,500"), (400, f"1,{k:03d}")]), (600 * k + 20, [(300, "300"), (400, "410")]), (600 * k + 30, [(20, "EBITDA"), (300, "-")])]
        lines += [(600 * k + 40 + 10 * n, [(20, "some"), (60, "other"), (100, "line")]) for n in range(56)]
    words = spark.createDataFrame(words_of("a:1", lines), KINDS)
    got = {(r.rid, r.metric, r.col): (r.line_no, r.value, r.period_end) for r in tables.table_metrics(words).collect()}
    want = {}
    for k in range(40):
        for col, value in enumerate((1500.0, 1000.0 + k)):
            want[(f"a:1:{k}", "revenue", col)] = (60 * k + 1, value, f"{2001 + k - col}-06-30")
    assert {x: v for x, v in got.items() if v[0] % 60 == 1} == want
    assert [r.first_line for r in tables.table_regions(tables.page_lines(words)).orderBy("first_line").collect()] == [60 * k + 1 for k in range(40)]


def test_centres_are_those_of_clusters(spark):
    from tessera.operators import layout

    rng = np.random.default_rng(5)
    rows = [(k, float(x)) for k in range(30) for x in rng.integers(0, 900, int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "page long, x double")
    want = {k: [round(x, 6) for x in xs] for k, xs in layout.position_clusters(df, "page", "x").groupBy("page").agg(F.sort_array(F.collect_list("centre"))).collect()}
    got = {k: [round(x, 6) for x in xs] for k, xs in df.groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("x")).select("page", layout.centres(F.col("x"))).collect()}
    assert got == want
    assert spark.range(1).select(layout.centres(F.array().cast("array<double>")).alias("x")).first().x == []


def _dealt_by(query, spark, small):
    """By what rows are dealt once the line items are read."""
    plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "lines-" not in plan and "regions-" not in plan and "rows-" not in plan  # nothing is written on the way
    return set(re.findall(r"[^t]Exchange hashpartitioning\((\w+)#", plan))


def test_table_columns_ships_items_once(spark, small):
    from tessera.plans.tables import table_columns

    assert _dealt_by(table_columns, spark, small) == {"l_orderkey"}


def test_table_metrics_ships_items_once(spark, small):
    from tessera.plans.tables import table_metrics

    assert _dealt_by(table_metrics, spark, small) == {"l_orderkey"}


def slow_pairs(rows, tolerance, share):
    out = set()
    for sheet in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == sheet]
        xs = sorted(r[3] for r in mine if r[5] and not r[4])
        if not xs:
            continue
        least = xs[round((len(xs) - 1) * share)]
        free = {r[1]: r for r in mine if r[5] and not r[4] and r[3] >= least}
        for r in sorted((r for r in mine if r[4] and not r[5]), key=lambda r: r[1]):
            near = min(((abs(f[2] - r[2]), -f[3], f[1]) for f in free.values() if abs(f[2] - r[2]) <= tolerance), default=None)
            if near:
                free.pop(near[2])
                out.add((sheet, r[1], near[2], near[0]))
    return out


def test_pairs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    for tolerance, height in ((3.0, 60), (0.0, 12), (8.0, 400)):
        rows = [(int(rng.integers(0, 12)), k, float(rng.integers(0, height)), float(rng.integers(250, 300)), bool(a := rng.random() < 0.4), bool(rng.random() < (0.1 if a else 0.9))) for k in range(500)]
        df = spark.createDataFrame(rows, "sheet long, idx long, y double, x0 double, is_label boolean, is_number boolean").repartition(5)
        assert {tuple(r) for r in tables.paired_rows(df, tolerance).collect()} == slow_pairs(rows, tolerance, 0.6)
    assert tables.paired_rows(df.where("false"), 1.0).count() == 0


def test_texts_are_searched_once(spark):
    from tessera.functions import dates, numeric

    words = spark.range(1).select(F.concat(F.lit("$"), F.col("id").cast("string")).alias("x"))
    plan = lambda column: words.select(column)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(numeric.numeric_word(F.col("x"))).count("regexp_extract(") <= 6
    assert plan(dates.period_end(F.col("x"))).count("regexp_extract_all(") <= 4
