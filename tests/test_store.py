"""Stores that are changed at once, windows of news ingested once, and days counted again when late rows come."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources import store as st
from tessera.sources.store import Store, bucket
from tessera.streaming import ingest

c = F.col
METRIC = "metric_row_id string, company string, value double, created_at string, updated_at string"


def rows_of(store, table, *by):
    return sorted(tuple(r) for r in store.read(table).select(*by).collect())


def test_upsert_rewrites_touched_partitions_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    first = spark.createDataFrame([(f"r{k}", f"c{k % 9}", float(k), "t0", "t0") for k in range(90)], METRIC)
    assert st.upsert(store, "run 1", metrics=first)
    before = store.tables()["metrics"]["parts"]
    more = spark.createDataFrame([("r4", "c4", -1.0, "t1", "t1"), ("r4", "c4", -2.0, "t1", "t2"), ("x", "c4", 7.0, "t1", "t1")], METRIC)
    assert st.upsert(store, "run 2", metrics=more)
    after = store.tables()["metrics"]["parts"]
    assert sum(before[p] != after[p] for p in before) == 1
    got = {r.metric_row_id: (r.value, r.created_at, r.updated_at) for r in store.read("metrics").collect()}
    assert len(got) == 91 and got["r4"] == (-2.0, "t0", "t2") and got["x"] == (7.0, "t1", "t1") and got["r5"] == (5.0, "t0", "t0")
    assert not st.upsert(store, "run 2", metrics=first)  # done before
    assert len(store.read("metrics").collect()) == 91
    part = next(p for p in before if before[p] != after[p])
    plan = store.read("metrics", [part])
    assert {f.rpartition("/")[0].rpartition("/")[2] for f in plan.inputFiles()} == {f"_part={part}"}


def test_interrupted_commit_leaves_the_old_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    signal = "file string, statement_period_end string, signal_name string, level string, created_at string, updated_at string"
    rows = spark.createDataFrame([("f1", "2024", "leverage", "LOW", "a", "a")], signal)
    metric = spark.createDataFrame([("r", "c", 1.0, "a", "a")], METRIC)
    st.upsert(store, "one", risk_signals=rows, metrics=metric)
    commit = store.begin("two")
    commit.merge("risk_signals", rows.withColumn("level", F.lit("HIGH")), bucket("file"), ["file", "statement_period_end", "signal_name"], "updated_at")
    # the writer dies here: nothing of it is seen, and the same token can be tried again
    assert rows_of(store, "risk_signals", "level") == [("LOW",)]
    assert st.upsert(store, "two", risk_signals=rows.withColumn("level", F.lit("HIGH")), metrics=metric.withColumn("value", F.lit(2.0)))
    assert rows_of(store, "risk_signals", "level") == [("HIGH",)] and rows_of(store, "metrics", "value") == [(2.0,)]
    assert store.sweep() > 0
    assert rows_of(store, "risk_signals", "level") == [("HIGH",)] and rows_of(store, "metrics", "value") == [(2.0,)]


def test_partitions_with_odd_names_and_reports(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a/b c", 1), ("2024-01-01 00:00", 2), (None, 3), ("", 4)], "k string, v int")
    commit = store.begin("x")
    assert sorted(commit.append("t", rows, c("k"))) == ["", "2024-01-01 00:00", "a/b c"]
    commit.finish()
    assert rows_of(store, "t", "v") == [(1,), (2,), (3,), (4,)]
    assert [r.v for r in store.read("t", ["a/b c"]).collect()] == [1]
    assert store.read("none") is None
    st.json_report(rows.withColumnRenamed("k", "company"), f"file://{tmp_path}/r", generated="now")
    assert [tuple(r) for r in spark.read.json(f"file://{tmp_path}/r/report").select("company_count", "generated").collect()] == [(4, "now")]
    st.csv_report(rows, f"file://{tmp_path}/c", ["v", "absent", "k"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").columns == ["v", "absent", "k"]


BODY = "the market was up and the shares of {} rose in the session as it is with a rally that has been on for weeks to the end of {}"
ITEMS = "id string, title string, description string, body string, url string, published string, source string, fetched_at string"


def item(k, title, body, url, published="2024-01-01T10:00:00Z", fetched="2024-01-02T00:00:00Z"):
    return (k, title, "", body, url, published, "src", fetched)


def window(spark, second=False):
    rows = [
        item("1", "Acme up", BODY.format("acme", "it"), "https://x.com/a?utm_source=1"), item("2", "Acme up again", BODY.format("acme", "may") + " longer", "https://www.x.com/a", "2024-01-01T11:00:00Z"),
        item("3", "Acme up", BODY.format("acme", "it"), None, "2024-01-01T12:00:00Z"), item("4", "Other", BODY.format("others", "june"), "https://x.com/b"), item("5", "", "no name", ""), item("6", "No time", "x", "https://x.com/c", ""), item("7", "Bad time", "x", "https://x.com/d", "yesterday"),
    ]
    late = [item("9", "News", BODY.format("ASX: BHP", "july"), "https://x.com/b", "2024-01-02T10:00:00Z"), item("8", "Fresh", BODY.format("nobody", "august"), "https://x.com/e", "2024-01-02T10:00:00Z")]
    return spark.createDataFrame(late if second else rows, ITEMS)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("ACM", "acme"), ("BHP", "bhp group")], "ticker string, alias string"), spark.createDataFrame([("ACM",), ("BHP",)], "ticker string")


def state(store):
    return {t: sorted(map(str, store.read(t).drop("samples").collect())) for t in store.tables()}


def both_windows(spark, store, names):
    first = ingest.ingest_window(store, window(spark), "eodhd", ("2024-01-01", "2024-01-02"), "run", *names, precise=True, of=4)
    return first, ingest.ingest_window(store, window(spark, True), "eodhd", ("2024-01-02", "2024-01-03"), "run", *names, precise=True, of=4)


def test_texts_of_articles_alone_are_carried_along(spark, tmp_path, names, monkeypatch):
    """Of items that are one article only the best one's text is put aside and dealt; enriched texts may change, so all of theirs are."""
    seen, real = {}, ingest.Commit.change

    def counted(self, table, incoming, *more):
        if table == "articles":
            seen[self.store.folder] = incoming.count()
        return real(self, table, incoming, *more)

    monkeypatch.setattr(ingest.Commit, "change", counted)
    kept = []
    for name, enrich in (("a", None), ("b", lambda rows: rows)):
        store = Store(spark, f"file://{tmp_path}/{name}")
        same = window(spark).unionByName(window(spark).where("id = '2'").withColumn("body", F.lit("another text of one time, id and address")))
        ingest.ingest_window(store, same, "eodhd", ("2024-01-01", "2024-01-02"), "run", *names, enrich=enrich, of=4)
        kept.append(sorted((r.title, r.n_seen, r.first_published) for r in store.read("articles").collect()))
        for r in store.read("articles").collect():
            assert spark.range(1).select(text.exact_hash(F.lit(r.title), F.lit(r.body))).first()[0] == r.exact_key
    assert kept[0] == kept[1] and len(kept[0]) == 2
    assert list(seen.values()) == [2, 4]


def test_keys_of_normalised_texts(spark):
    rows = spark.createDataFrame([("A  b\n", "\u00c9t\u00e9 K\u212a \u0130 \U0001f600, x-Y\t"), ("", "!"), (None, None), (".", "one"), ("t", " ".join(f"w{k}" for k in range(100)))], "t string, b string")
    old = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))
    t, b = F.col("t"), F.col("b")
    first = F.array_join(F.slice(F.split(old(b), " "), 1, 80), " ")
    near = F.sha1(F.concat_ws("|", F.substring(old(t), 1, 220), F.substring(old(b), 1, 320), first))
    got = rows.select(text.exact_of(text.normalize_text(t), text.normalize_text(b)), text.near_key(t, b), F.sha2(old(F.concat_ws("\n", t, b)), 256), near).collect()
    assert [r[:2] for r in got] == [r[2:] for r in got]


def test_windows_are_ingested_once(spark, tmp_path, names, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/a")
    assert both_windows(spark, store, names) == (True, True)
    assert [tuple(r)[2:] for r in store.read("windows").orderBy("window_start").select("run_id", "provider", "fetched", "inserted", "deduped", "rejected").collect()] == [(7, 2, 2, 3), (2, 1, 1, 0)]
    assert rows_of(store, "runs", "fetched", "inserted", "deduped", "rejected") == [(9, 3, 3, 3)]
    assert rows_of(store, "rejects", "provider_item_id", "reason") == [("5", "missing_identity"), ("6", "missing_published_at"), ("7", "invalid_published_at")]
    kept = {r.title: r for r in store.read("articles").collect()}
    assert set(kept) == {"Acme up again", "News", "Fresh"} and kept["Acme up again"].n_seen == 3 and kept["Acme up again"].first_published == "2024-01-01T10:00:00Z"
    assert sorted(r.n for r in store.read("versions").groupBy("article_id").agg(F.count("*").alias("n")).collect()) == [1, 2, 3]
    assert sorted((r.ticker, r.method) for r in store.read("links").select("ticker", "method").distinct().collect()) == [("ACM", "alias_strict"), ("BHP", "explicit_symbol"), ("BHP", "ticker_token")]
    counts = {(r.window_start, r.reason): r.n for r in store.read("failures").collect()}
    assert counts["2024-01-01", "duplicate_url"] == 1 and counts["2024-01-01", "duplicate_exact"] == 1 and counts["2024-01-02", "duplicate_url"] == 1
    assert counts["2024-01-01", "entity_link_filtered"] == 1 and counts["2024-01-01", "provider_fetch_error"] == 0
    before = state(store)
    assert both_windows(spark, store, names) == (False, False)
    assert state(store) == before

    # a run that dies halfway through its second window and is tried again gives the same tables
    other = Store(spark, f"file://{tmp_path}/b")
    real = ingest.Commit.append

    def dies(self, table, *more):
        if table == "failures" and other._commits():
            raise KeyboardInterrupt
        return real(self, table, *more)

    monkeypatch.setattr(ingest.Commit, "append", dies)
    with pytest.raises(KeyboardInterrupt):
        both_windows(spark, other, names)
    monkeypatch.undo()
    assert both_windows(spark, other, names) == (False, True)
    assert state(other) == before


def test_stream_of_batches_is_ingested(spark, tmp_path, names):
    store, folder = Store(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/in"
    for k in (False, True):
        window(spark, k).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(folder)
    longer = lambda b: b.withColumn("n_chars", F.length("body"))
    for checkpoint in ("c1", "c1"):
        ingest.index_stream(store, stream, f"file://{tmp_path}/{checkpoint}", "eodhd", *names, enrich=longer).awaitTermination()
    assert sorted(r.title for r in store.read("articles").where("n_chars > 0").collect()) == ["Acme up again", "Fresh", "News"]
    assert store.read("windows").count() == 2


def test_three_keys_are_remembered_until_they_expire(spark, tmp_path):
    kinds = "ord string, at timestamp, url_key string, exact_key string, near_key string"
    folder, found = f"file://{tmp_path}/in", {}
    batches = [
        [("a", "2024-01-01", "u1", "x1", "n1"), ("b", "2024-01-01", "u1", "x2", "n2"), ("c", "2024-01-02", None, "x3", "n1")],
        [("d", "2024-01-03", "u9", "x2", "n9"), ("e", "2024-01-03", "u8", "x8", "n8"), ("f", "2024-01-03", None, "x8", "n7")],
        [("g", "2024-06-01", "u7", "x7", "n6")],
        [("h", "2024-06-02", "u1", "x9", "n5")],
    ]

    def take(batch, _):
        found.update({r.ord: (r.reason, r.first) for r in ingest.verdicts(batch).collect()})

    for b in batches:
        spark.createDataFrame(b, "ord string, at string, url_key string, exact_key string, near_key string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kinds).parquet(folder)
        ingest.seen_first(stream).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    assert found == {
        "a": (None, None), "b": ("duplicate_url", "a"), "c": ("duplicate_near", "a"), "d": ("duplicate_exact", "b"), "e": (None, None), "f": ("duplicate_exact", "e"), "g": (None, None), "h": (None, None),
    }


def test_late_rows_open_their_day_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    kinds = "ts timestamp, source string"

    def come(name, rows):
        spark.createDataFrame(rows, "ts string, source string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(kinds).parquet(f"file://{tmp_path}/in")
        ingest.flow_days(store, stream, f"file://{tmp_path}/c", "ts", ["source"]).awaitTermination()

    come("a", [("2024-01-01 10:00:00", "x"), ("2024-01-01 11:00:00", "x"), ("2024-01-02 10:00:00", "y"), ("2024-01-03 10:00:00", "y")])
    ingest.close_days(store, "2024-01-03")
    before = store.tables()["daily"]["parts"]
    come("b", [("2024-01-01 23:00:00", "z"), ("2024-01-01 23:30:00", "x"), ("2024-01-03 12:00:00", "y")])
    held = rows_of(store, "daily", F.col("day").cast("string"), "source", "n_rows")
    assert held == [("2024-01-01", "x", 2), ("2024-01-02", "y", 1), ("2024-01-03", "y", 2)]
    assert rows_of(store, "days", F.col("day").cast("string"), "status") == [("2024-01-01", "open"), ("2024-01-02", "closed"), ("2024-01-03", "running")]
    assert ingest.rerun_open(store, ["source"]) == ["2024-01-01"]
    after = store.tables()["daily"]["parts"]
    assert after["2024-01-02"] == before["2024-01-02"] and after["2024-01-01"] != before["2024-01-01"]
    assert rows_of(store, "daily", F.col("day").cast("string"), "source", "n_rows") == [("2024-01-01", "x", 3), ("2024-01-01", "z", 1), ("2024-01-02", "y", 1), ("2024-01-03", "y", 2)]
    assert ingest.rerun_open(store, ["source"]) == []


def test_window_of_odd_documents_is_as_its_sql(spark, small, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.plans import ingest as plan
    from tests.oracle import TABLES, differences

    for t in TABLES:
        if t != "documents":
            os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    odd = [None, "", "\n", " \nfoo foo", "foo foo", "\nfoo", "foo", "!!", "...\nfoo", "Alpha beta", "alpha-beta", "x" * 400, "x" * 400 + " y"]
    texts = odd * 3 + [f"text {k % 20}" for k in range(80)]
    ids = [3 * k + 1 for k in range(2 * len(odd))] + [10**13 + 7 * k for k in range(len(odd) + 40)] + [-7 * k - 1 for k in range(40)]
    schema = pq.read_schema(f"{small}/documents.parquet")
    rows = {"doc_id": ids, "text": texts, "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": [len(x or "") for x in texts]}
    pq.write_table(pa.table({k: rows[k] for k in schema.names}).cast(schema), tmp_path / "documents.parquet")
    assert differences(spark, plan.ingest_windows, plan.SQL["ingest_windows"], str(tmp_path)) == ""
