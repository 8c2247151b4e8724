"""Readers, writers and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import sources, streaming
from tessera.sources import files


@pytest.fixture()
def put(tmp_path):
    def write(name, body):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
        return f"file://{path}"

    return write


def test_json_rows_and_lines(spark, put, tmp_path):
    path = put("a.json", json.dumps([{"x": 1, "y": "a"}, {"x": 2}]))
    assert sorted(tuple(r) for r in sources.json_rows(spark, path, "x int, y string, z double").collect()) == [(1, "a", None), (2, None, None)]
    put("d/one.jsonl", '{"x": 1}\nnot json\n{"x": 2}\n')
    put("d/e/two.jsonl", '{"x": 3}\n')
    assert sorted(r.x for r in sources.json_lines(spark, f"file://{tmp_path}/d", "x int").collect()) == [1, 2, 3]


def test_csv_with_other_columns(spark, put, tmp_path):
    path = put("a.csv", 'B,c,A\n"x, ""y""",1,7\n,2,n/a\n')
    got = sources.csv_rows(spark, path, "a int, b string, d string", {"d": "none"})
    assert got.columns == ["a", "b", "d"] and [tuple(r) for r in got.collect()] == [(7, 'x, "y"', "none"), (None, None, "none")]
    assert sources.optional_csv(spark, f"file://{tmp_path}/no.csv", "a int").count() == 0
    assert sources.optional_csv(spark, path, "a int").count() == 2


def test_universe_identities_labels(spark, put, tmp_path):
    path = put("u.txt", "bhp # big\n# note\nRIO\n\n bhp\nA.B\n")
    assert [r.ticker for r in sources.ticker_universe(spark, path).orderBy("place").collect()] == ["BHP", "RIO", "AB"]
    path = put("i.json", '{"bhp": {"canonical_names": ["BHP Group", " "], "aliases": ["The Big"]}, "": {"aliases": ["x"]}}')
    assert sorted(tuple(r) for r in sources.identity_map(spark, path).collect()) == [("BHP", "aliases", "The Big"), ("BHP", "canonical_names", "BHP Group")]
    put("g/one.json", json.dumps({"doc_id": "d", "ticker": "BHP", "fields": [{"metric": "revenue", "value": "5"}, {"metric": "ebit"}]}))
    assert [(r.place, r.metric, r.value) for r in sources.labelled_fields(spark, f"file://{tmp_path}/g").orderBy("place").collect()] == [(0, "revenue", "5"), (1, "ebit", None)]


def test_files_and_lines(spark, put, tmp_path):
    put("docs/BHP/annual/2024-08-27 a.pdf", "%PDF one")
    put("docs/RIO/b.pdf", "%PDF")
    put("docs/RIO/c.txt", "The Net Debt rose\nnothing\nnet debt again\n")
    assert sorted(r.path.rpartition("/")[2].replace("%20", " ") for r in sources.report_files(spark, f"file://{tmp_path}/docs").collect()) == ["2024-08-27 a.pdf", "b.pdf"]
    assert [r.line for r in sources.matching_lines(spark, f"file://{tmp_path}/docs", "NET debt", 1, "*.txt").collect()] == ["The Net Debt rose"]


def test_stored_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/chunks"
    spark.createDataFrame([("1", "news", "t"), ("2", "filings", "u")], "chunk_id string, corpus string, text string").write.parquet(folder)
    got = sources.context_rows(spark, folder, corpus="news")
    assert [(r.chunk_id, r.text, r.url) for r in got.collect()] == [("1", "t", "")]
    assert "PushedFilters: [IsNotNull(corpus), EqualTo(corpus,news)]" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    folder = f"file://{tmp_path}/derived"
    spark.createDataFrame([("A", "p", "x", 1.0, 1), ("A", "p", "x", 2.0, 3), ("A", "p", "y", 3.0, 3)], "company string, period string, metric string, value double, conf int").write.parquet(folder)
    assert [r.value for r in sources.derived_rows(spark, folder, ["x"], 2).collect()] == [2.0]
    folder = f"file://{tmp_path}/index"
    spark.createDataFrame([("f", "p", 2, "HIGH"), ("f", "p", 4, "LOW")], "file string, period string, integrity_score int, anomaly_level string").write.parquet(folder)
    assert [tuple(r) for r in sources.integrity_index(spark, folder).collect()] == [("f", "p", 4, "LOW")]


def test_training_rows_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "x int, y string")
    sources.training_rows(rows, f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in sources.json_lines(spark, f"file://{tmp_path}/out", "x int, y string").collect()) == [(1, "a\nb"), (2, None)]
    assert files.as_declared(rows, "y string, z int", {"z": 5}).first().z == 5


ARTICLES = "url string, title string, body string, published timestamp, source string"
PROSE = "the market was up and the shares of miners rose in the session as it is with a rally that has been on for weeks to the end of it"


def article_rows(spark):
    rows = [("https://x.com/a?utm_id=1", "One", PROSE, "2024-01-01 10:00:00"), ("https://www.x.com/a", "Other", PROSE + " more", "2024-01-01 11:00:00"), (None, "One", PROSE, "2024-01-02 10:00:00"), (None, "Two", "short", "2024-01-02 12:00:00")]
    return spark.createDataFrame([(*r, "s") for r in rows], "url string, title string, body string, published string, source string").withColumn("published", F.to_timestamp("published"))


def test_stream_drops_what_was_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    for n in range(2):  # the second batch holds nothing new
        article_rows(spark).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = []
    q = streaming.first_seen(stream).writeStream.option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(r.title for r in b.collect())).start()
    q.awaitTermination()
    assert len(seen) == 2 and "Two" in seen


def test_index_batches_writes_once(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    article_rows(spark).coalesce(1).write.parquet(folder)
    for _ in range(2):
        streaming.index_batches(spark.readStream.schema(ARTICLES).parquet(folder), out, f"file://{tmp_path}/c2", lambda b: b.withColumn("n", F.length("body"))).awaitTermination()
    assert spark.read.parquet(f"{out}/articles").count() == 3
    assert [r.reason for r in spark.read.parquet(f"{out}/rejects").collect()] == ["short_text"]


def test_daily_counts_and_recent(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    article_rows(spark).write.parquet(folder)
    stream = spark.readStream.schema(ARTICLES).parquet(folder)
    rows = []
    q = streaming.daily_counts(stream).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend((str(r.day)[:10], r.n_articles) for r in b.collect())).start()
    q.awaitTermination()
    assert sorted(set(rows)) == [("2024-01-01", 2), ("2024-01-02", 2)]
    assert streaming.recent(article_rows(spark), "2024-01-02 12:00:00", 2).count() == 2


def test_captures_are_a_partition_a_day(spark, put, tmp_path):
    put("cap/eodhd_2024-01-01.json", json.dumps([{"id": 1, "headline": " One ", "link": "u"}, {"id": 1, "title": "one", "url": "u"}, "no object", {"news_id": "2", "published_at": 5}]))
    put("cap/day=2024-01-02/a.jsonl", '{"id": 3, "content": "x"}\nnot json\n[1]\n{"uid": "4"}\n')
    put("cap/day=2024-01-02/b.json", json.dumps({"items": [{"guid": "5"}]}))
    put("cap/day=2024-01-03/c.json", "")
    put("cap/day=2024-01-04/d.json", json.dumps({"id": "6"}))
    put("cap/day=2024-01-05/_temporary.json", json.dumps({"id": "7"}))
    put("cap/notes.json", json.dumps({"id": "8"}))
    folder = f"file://{tmp_path}/cap"
    every = sources.captured_items(spark, folder)
    assert sorted((r.day, r.id, r.title, r.url, r.published) for r in every.collect()) == [("2024-01-01", "1", "One", "u", None), ("2024-01-01", "2", None, None, "5"), ("2024-01-02", "3", None, None, None), ("2024-01-02", "4", None, None, None), ("2024-01-02", "5", None, None, None), ("2024-01-04", "6", None, None, None)]
    assert every.rdd.getNumPartitions() == 4
    some = every.where("day >= '2024-01-02' and day < '2024-01-04' and id <> '4'")
    assert sorted(r.id for r in some.collect()) == ["3", "5"] and some.rdd.getNumPartitions() == 2
    assert sources.captured_items(spark, folder, "2024-01-04", "2024-01-09").rdd.getNumPartitions() == 1
    assert sources.captured_items(spark, f"file://{tmp_path}/none").count() == 0
