"""Cases with known results, as literal rows."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, numeric, text
from tessera.operators import layout, linking, news, prices, risk, scoring, stores, warehouse


def facts(spark, rows):
    """(company, period, metric, value, conf, integrity, ord) of (period, metric, value)."""
    return spark.createDataFrame([("A", p, m, float(v), 3, 3, n) for n, (p, m, v) in enumerate(rows)], "company string, period string, metric string, value double, conf int, integrity int, ord int")


P = "2024-12-31"


@pytest.mark.parametrize(("rows", "kept"), [
    ([("total_assets", 1000), ("total_liabilities", 600), ("total_equity", 400)], {"total_assets", "total_liabilities", "total_equity"}),
    ([("total_assets", 1000), ("total_liabilities", -600), ("total_equity", 400)], {"total_assets", "total_liabilities", "total_equity"}),
    ([("total_assets", 1000), ("total_liabilities", 500), ("total_equity", 400), ("revenue", 300)], {"revenue"}),
    ([("cash_opening", 100), ("operating_cash_flow", 40), ("investing_cash_flow", -10), ("financing_cash_flow", 0), ("cash_closing", 200), ("revenue", 1000)], {"investing_cash_flow", "financing_cash_flow", "revenue"}),
])
def test_gates(spark, rows, kept):
    q = warehouse.quarantine(facts(spark, [(P, m, v) for m, v in rows]))
    assert {r.metric for r in q.where("not quarantined").collect()} == kept


def test_ratios_and_gate(spark):
    f = facts(spark, [(P, "net_debt", 200), (P, "ebitda", 100), (P, "free_cash_flow", 40), (P, "npat", 80)])
    got = {r.metric: r.value for r in warehouse.derived_ratios(f).collect()}
    assert got["net_debt_to_ebitda"] == 2.0 and got["fcf_conversion_pct"] == 50.0
    assert warehouse.gate(f.withColumn("conf", F.lit(1))).count() == 0
    only = facts(spark, [("2023-12-31", "revenue", 100), (P, "revenue", 120)])
    assert warehouse.incremental_margin(only).count() == 0


def derived(spark, metric, values):
    return spark.createDataFrame([("A", f"20{20 + n}-12-31", metric, float(v)) for n, v in enumerate(values)], "company string, period string, metric string, value double")


def test_risk_levels(spark):
    levels = lambda m, v: [r.risk_level for r in risk.leverage_and_liquidity(derived(spark, m, v), "institutional").orderBy("period").collect()]
    assert levels("net_debt_to_ebitda", [1.8, 2.4, 4.2]) == ["LOW", "MEDIUM", "HIGH"]
    assert levels("ebitda_amount", [-5]) == ["CRITICAL"]
    assert levels("cash_runway_periods", [1.5, 3.0, 5.5]) == ["CRITICAL", "HIGH", "LOW"]


def test_margin_signals(spark):
    got = lambda v: sorted((r.period[:4], r.signal_name) for r in risk.margin_signals(derived(spark, "ebit_margin_pct", v)).collect())
    assert got([30, 25, 21]) == [("2021", "ebit_margin_compression"), ("2022", "ebit_margin_compression"), ("2022", "ebit_margin_structural_compression")]
    assert got([25, -1000000]) == []


def test_capital_structure(spark):
    f = facts(spark, [(P, "total_debt", 100), (P, "cash_closing", 40), (P, "operating_cash_flow", 30), (P, "capex", 10), ("2023-12-31", "ebitda", 5)])
    got = {r.period: r for r in warehouse.capital_structure(f).collect()}
    assert (got[P].net_debt, got[P].net_debt_source, got[P].free_cash_flow, got[P].free_cash_flow_source) == (60.0, "structural_derivation", 20.0, "structural_derivation")
    assert (got["2023-12-31"].support, got["2023-12-31"].leverage_flag) == ("insufficient_inputs", "UNKNOWN")


def test_survivorship_and_stages(spark):
    items = spark.createDataFrame([(1, 7, "gdelt", 1, "body", 10, 100), (2, 7, "gdelt", 1, "body", 5, 200)], "item_id long, identity long, provider string, provider_rank int, body string, published long, fetched long")
    r = news.survivors(items).first()
    assert (r.winner_id, r.published, r.fetched) == (2, 5, 200)
    a = spark.createDataFrame([(1, "https://x/a", "T", "one two"), (2, "https://x/a", "U", "other"), (3, None, "T", "one two"), (4, "", "V", "z")], "ord long, url string, title string, body string")
    got = {r.ord: r.reason for r in news.staged_duplicates(a).collect()}
    assert got == {1: None, 2: "duplicate_url", 3: "duplicate_exact", 4: None}


def test_sentiment_windows(spark):
    a = spark.createDataFrame([("BHP", "2026-02-24", 0.8, 0.8, "a"), ("BHP", "2026-02-10", -0.7, 0.8, "b")], "ticker string, day string, score double, confidence double, source string").withColumn("day", F.to_date("day"))
    got = {r.window_days: r for r in news.sentiment_windows(a, "2026-02-24").collect()}
    assert (got[7].article_count, got[30].article_count) == (1, 2)
    assert got[7].weighted_sentiment > 0.6 and 0 < got[30].weighted_sentiment < got[7].weighted_sentiment


def ticks(spark, closes, start=datetime(2026, 1, 1)):
    rows = [("A", start + timedelta(days=n), float(v), n) for n, v in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, close double, ord long")


def test_price_state(spark):
    closes = [100 + 0.85 * n + (0.12 if n % 2 else -0.08) for n in range(70)]
    t = ticks(spark, closes)
    again = t.where("ord = 69").withColumn("ord", F.lit(70).cast("long"))
    kept = prices.keep_last(t.unionByName(again))
    assert kept.count() == 70
    assert prices.latest_state(kept).first().trend == "bull"
    few = prices.latest_state(prices.keep_last(ticks(spark, closes[:5]))).first()
    assert few.ret_5 is None and few.ret_20 is None and few.sma_short is None and few.sma_long is None and few.vol_pct is None and few.ret_1 is not None


def test_price_alerts(spark):
    kinds = "ticker string, ts timestamp, close double, ret_1 double, ret_20 double, vol_pct double, drawdown_pct double"
    at = datetime(2026, 2, 1)
    rows = [("A", at, 1.0, 3.0, -10.0, 45.0, -12.0), ("B", at, None, None, None, None, None), ("C", at, 1.0, 2.9, 9.9, 44.0, -11.0), ("D", at - timedelta(hours=120), 1.0, None, None, None, None)]
    got = {r.ticker: (r.alerts, r.score) for r in prices.alerts(spark.createDataFrame(rows, kinds), "2026-02-01 00:00:00").collect()}
    assert got["A"] == ("ret_1d_move,ret_20d_momentum,high_volatility,drawdown_63d", round(2 + 0.03 + 0.1 + 0.45 + 0.12, 3))
    assert got["B"] == ("price_error", 3.0) and got["C"] == ("", 0.0) and got["D"] == ("stale_data", 4.2)


def test_asof_reaction(spark):
    p = ticks(spark, [100, 102, 104, 101, 105, 107, 110], datetime(2026, 2, 1)).select("ticker", "ts", "close")
    n = spark.createDataFrame([(1, "A", datetime(2026, 2, 2, 12)), (2, "A", datetime(2026, 1, 1))], "news_id long, ticker string, published_at timestamp")
    r = prices.asof_reaction(n, p).collect()
    assert [x.news_id for x in r] == [1] and r[0].close == 102
    assert math.isclose(r[0].ret_1, (104 / 102 - 1) * 100) and math.isclose(r[0].ret_5, (110 / 102 - 1) * 100) and r[0].ret_20 is None


@pytest.mark.parametrize("held", [200_000, 2])
def test_links_by_method(spark, held):
    articles = spark.createDataFrame([(1, "BHP Group rose; ASX: BHP and (RIO.AX). Rio  Tinto fell. The Group said: shared name."), (2, None)], "article_id long, text string")
    aliases = spark.createDataFrame([("BHP", "BHP Group"), ("RIO", "Rio Tinto"), ("BHP", "shared name"), ("RIO", "Shared Name"), ("RIO", "Ab")], "ticker string, alias string")
    tickers = spark.createDataFrame([("BHP",), ("RIO",)], "ticker string")
    got = sorted((r.ticker, r.method, r.gram, r.span_start, r.span_end, r.precise, r.broad) for r in linking.links(articles, aliases, tickers, held).collect())
    text_of = articles.first().text
    assert {(t, m) for t, m, *_ in got} == {("BHP", "alias_strict"), ("BHP", "explicit_symbol"), ("BHP", "ticker_token"), ("BHP", "alias_ambiguous"), ("RIO", "alias_strict"), ("RIO", "explicit_symbol"), ("RIO", "ticker_token"), ("RIO", "alias_ambiguous")}
    assert got
    for _, method, gram, a, b, precise, broad in got:
        assert (precise, broad) == linking.CONFIDENCE[method]
        if method != "explicit_symbol":
            assert " ".join(text_of[a:b].lower().split()) == gram
    assert sorted(r.n_tickers for r in linking.tickers_of(linking.links(articles, aliases, tickers, held), articles, 0.7).collect()) == [0, 2]


def slow_chunks(words, most, overlap):
    out, first = [], 0
    while words:
        end = first + 1
        while end < len(words) and len(" ".join(words[first : end + 1])) <= most:
            end += 1
        out.append((first, end))
        if end == len(words):
            return out
        first = max(first + 1, end - overlap)
    return out


def test_chunks_are_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(300):
        words = ["x" * int(k) for k in rng.integers(1, 30, rng.integers(0, 60))]
        most, overlap = int(rng.integers(1, 80)), int(rng.integers(0, 6))
        assert layout.chunk_ends(words, most, overlap) == slow_chunks(words, most, overlap)


def test_position_clusters_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(x)) for k in range(8) for x in rng.integers(0, 400, 60)] + [(99, None)][:0]
    want = []
    for k in range(8):
        clusters = []
        for x in sorted(x for key, x in rows if key == k):
            if clusters and abs(x - sum(clusters[-1]) / len(clusters[-1])) <= 26:
                clusters[-1].append(x)
            else:
                clusters.append([x])
        want += [(k, n, round(sum(c) / len(c), 6), len(c)) for n, c in enumerate(clusters)]
    got = layout.position_clusters(spark.createDataFrame(rows, "page long, x double"), "page", "x").select("page", "cluster", F.round("centre", 6), "n").collect()
    assert sorted(map(tuple, got)) == want
    assert layout.position_clusters(spark.createDataFrame([], "page long, x double"), "page", "x").count() == 0


def test_numbers_and_quantiles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(numeric.nearest_quantile(F.array(F.lit(4.0), F.lit(1.0), F.lit(3.0), F.lit(2.0)), 0.5)) == 3.0
    assert one(numeric.nearest_quantile(F.array(F.lit(1.0), F.lit(2.0)), 0.5)) == 1.0  # halves to even
    assert one(numeric.safe_float(F.lit(" 1,200.5 "))) == 1200.5 and one(numeric.safe_float(F.lit("n/a"))) is None
    assert [one(numeric.bucketize_scale(F.lit(v))) for v in (1100.0, 1.0, 5e6, 1e9)] == [1000.0, 1.0, None, 1e9]
    assert one(text.first_non_empty(F.lit(" "), F.lit("b"))) == "b"
    assert one(dates.period_key(F.lit("x"))) == 0
    w = one(dates.day_windows(F.lit("2024-02-28"), F.lit("2024-03-01")))
    assert [(r.start, r.end) for r in w] == [(f"{d}T00:00:00Z", f"{d}T23:59:59Z") for d in ("2024-02-28", "2024-02-29", "2024-03-01")]


def test_gold_outcomes(spark):
    kinds = "key long, value double, period long, currency string"
    gold = spark.createDataFrame([(k, 100.0, 1, "AUD") for k in range(5)], kinds)
    pred = spark.createDataFrame([(0, 100.0, 1, "AUD"), (1, 100.0, 2, "AUD"), (2, 100.0, 1, "USD"), (3, 150.0, 1, "AUD")], kinds)
    got = {r.key: r.outcome for r in scoring.outcomes(gold, pred, ["key"]).collect()}
    assert got == {0: "tp", 1: "wrong_period", 2: "wrong_currency", 3: "wrong_value", 4: "missing"}


def test_windows_that_are_done(spark):
    w = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "start string, run string")
    done = spark.createDataFrame([("a", "completed"), ("b", "failed")], "start string, status string")
    assert sorted(r.start for r in stores.pending_windows(w, done, ["start"]).collect()) == ["b", "c"]


def test_links_by_automaton_are_those_of_equality(spark, small):
    from tessera.operators import linking

    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as article_id", "text")
    odd = spark.createDataFrame([(-1, "Acme\n\n  Corp and ACME corp; xacme corp, acme  corp9 acme-corp KKacme"), (-2, "acme"), (-3, None), (-4, "éacme corpé acme corp ASX: ACM"), (-5, "a b a b a b c")], "article_id long, text string")
    words = ["the", "of the", "and the on", "la", "de la", "der", "acme corp", "acme", "a b", "a b a", "b a b", "o'brien", "x y"]
    names = spark.createDataFrame([(f"T{k % 7}", w) for k, w in enumerate(words)], "ticker string, alias string")
    both = [linking.links(docs.unionByName(odd), names, names.select("ticker").distinct(), held=h) for h in (200_000, 1)]
    got, want = (sorted(map(tuple, r.collect()), key=str) for r in both)
    assert got == want and len([r for r in got if r[0] == -1]) > 4


@pytest.mark.parametrize("held", [200_000, 1])
def test_counted_links_are_those_of_single_mentions(spark, small, held):
    from tessera.operators import linking

    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as article_id", "text")
    odd = spark.createDataFrame([(-1, "the of the ASX: T1"), (-1, "the  of\n the der"), (-1, "the"), (None, "the (T2.AX)"), (None, "der"), (-2, None)], "article_id long, text string")
    words = ["the", "of the", "and the on", "la", "de la", "der", "o'brien"]
    names = spark.createDataFrame([(f"T{k % 3}", w) for k, w in enumerate([*words, *words[1:]])], "ticker string, alias string")
    given = docs.unionByName(odd), names, names.select("ticker").distinct()
    seen = [(r.ticker, r.method, r.article_id, r.span_start, r.span_end) for r in linking.links(*given).collect()]
    want = {g: (len(of := [x for x in seen if x[:2] == g]), len({x[2] for x in of} - {None}), sum(x[3] for x in of), sum(x[4] for x in of)) for g in {x[:2] for x in seen}}
    got = linking.counted_links(*given, held=held).collect()
    assert {(r.ticker, r.method): (r.n_hits, r.n_articles, r.starts, r.ends) for r in got} == want and len(got) == len(want) > 4
    assert {r.method: (r.precise, r.broad) for r in got}.items() <= linking.CONFIDENCE.items()


def test_names_of_many_characters_are_not_held(spark, monkeypatch):
    from tessera.operators import linking

    articles = spark.createDataFrame([(1, "acme  corp and t1"), (2, "none")], "article_id long, text string")
    names = spark.createDataFrame([("T1", "acme corp")], "ticker string, alias string")
    given = names, names.select("ticker")
    held = linking._sought(*given, 9, 0.0)[1]
    want = sorted(map(tuple, linking.links(articles, *given, held=9).collect()))
    monkeypatch.setattr(linking, "HELD_CHARS", 10)
    assert held and linking._sought(*given, 9, 0.0)[1] is None
    assert sorted(map(tuple, linking.links(articles, *given, held=9).collect())) == want and len(want) == 2


def test_symbols_and_blanks_however_written():
    from tessera.operators import linking

    assert list(linking.symbols_of("A\u017fx: Bhp, (Rio.aX) asx x")) == [("bhp", 0, 8), ("rio", 11, 17)] and not list(linking.symbols_of("no symbol"))
    names = linking.automaton({"acme corp": "1", "a k": "2"})
    assert list(linking.spoken("x y\n\n ACME \t Corp\u00e9\na K a \u212a", names)) == [("1", 6, 17), ("2", 19, 22)]


def test_only_links_sure_enough_are_looked_for(spark):
    from tessera.operators import linking

    articles = spark.createDataFrame([(1, "acme and shared of T1, ASX: T2")], "article_id long, text string")
    names = spark.createDataFrame([("T1", "acme"), ("T1", "shared"), ("T2", "shared")], "ticker string, alias string")
    for held in (200_000, 1):
        found = [linking.links(articles, names, names.select("ticker").distinct(), held, least=k) for k in (0.0, 0.7)]
        every, sure = (sorted(map(tuple, f.collect()), key=str) for f in found)
        assert sure == [r for r in every if r[-1] >= 0.7] and len(sure) == 2 < len(every)


def test_runs_of_one_time_and_id_give_one_answer(spark):
    from tessera.operators import reports

    docs = spark.createDataFrame([(1, "sha"), (2, "sha")], "document_id long, pdf_sha256 string")
    rows = [(1, 11, P, "ok"), (1, 11, P, "Failed"), (2, 21, P, "Failed"), (2, 21, P, "ok")]
    for order in (rows, rows[::-1]):
        runs = spark.createDataFrame(order, "document_id long, run_id long, created_at string, status string").coalesce(1)
        assert reports.structured_coverage(docs, runs).first()["latest_failed"] == 2


def test_templates_group_rows_of_the_newest_files_alone(spark, tmp_path):
    from tessera.operators import reports

    rows = [("A", 1, 5, "m", 9, 1.0), ("A", 1, 5, "m", 2, 2.0), ("A", 2, 5, "m", 1, 3.0), ("A", 3, 7, "m", 1, 4.0), ("A", 3, 4, "n", 1, 5.0), ("A", 4, 1, "m", 1, 6.0), ("B", 5, None, "m", 1, 7.0), ("B", 6, 2, "m", 1, 8.0)]
    r = spark.createDataFrame(rows, "ticker string, file long, day int, metric string, line_no long, value double").selectExpr("*", "2024 as period", "'s' as scope")
    t = reports.templates(r, 2)
    assert sorted((x.ticker, x.file, x.metric, x.value) for x in t.collect()) == [("A", 2, "m", 3.0), ("A", 3, "m", 4.0), ("A", 3, "n", 5.0), ("B", 5, "m", 7.0), ("B", 6, "m", 8.0)]
    assert "LeftSemi" in t._jdf.queryExecution().optimizedPlan().toString()


def test_texts_go_to_searches_in_short_batches(spark):
    from tessera.operators import retrieval

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "10000")
        docs = spark.createDataFrame([(k, f"w{k} x") for k in range(9)], "doc_id long, text string")
        asked = spark.createDataFrame([(1, "w3 x")], "item_id long, text string")
        assert retrieval.tfidf_top(docs, asked, "doc_id", "item_id", "text", 1).first().doc_id == 3
        assert int(spark.conf.get(size)) <= 1000
    finally:
        spark.conf.set(size, before)


def test_orders_of_line_rules_are_spread_over_the_cores(spark, small):
    from tessera.plans import columns

    assert columns._orders(spark, small).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_first_seen_stream_writes_no_texts(spark, small, monkeypatch):
    from tessera.plans import feeds

    made = []
    monkeypatch.setattr(feeds, "_streamed", lambda spark, rows, name, change, mode="append": made.append(change(spark.readStream.format("rate").load().selectExpr("cast(null as string) as url", "'t' as title", "'b' as body", "timestamp as published"))) or made[0])
    assert feeds.stream_first_seen(spark, small).columns == ["exact_key"] == made[0].columns
    assert made[0].isStreaming


def test_first_named_date_is_that_of_all_dates(spark):
    from pyspark.sql import functions as F

    from tessera.functions import dates

    said = ["Year ended 31 March 2024", "1 Ma rch 2024 and 2 April 2023", "31 March 31 December 2025 2024", "31 February 2024, 5 M a y 2021", "40 May 2020", "FY24", "", None]
    r = spark.createDataFrame([(x,) for x in said], "x string").select(dates.named_date(F.col("x")).alias("a"), F.try_element_at(dates.explicit_dates(F.col("x")), F.lit(1)).alias("b")).collect()
    assert [x.a for x in r] == [x.b for x in r] and sum(x.a is not None for x in r) == 4
