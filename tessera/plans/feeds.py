"""Registered queries of sources and streams: feeds, charts, lists and tables of announcements made out of the graded tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import session, streaming
from ..sources import feeds, files
from .common import table

c = F.col


def feed_items(spark, d):
    """A feed a page, RSS and Atom by turns."""
    p = table(spark, d, "pages")
    n = c("page_id").cast("string")
    rss = F.concat(F.lit("<rss><channel><title>Feed</title><item>\n<title><![CDATA[Page &amp; "), n, F.lit("]]></title><guid>x</guid><link>http://www.x.com/p/"), n, F.lit("?utm_source=1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>&lt;b&gt;Bold&lt;/b&gt; text "), n, F.lit("</description></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="a"><entry><a:title type="text">Page &amp; '), n, F.lit("</a:title><link rel='alternate' href='http://x.com/p/"), n, F.lit("'/><updated>2024-01-02T03:04:05Z</updated><summary>Bold text "), n, F.lit("</summary></entry><entry><id>none</id></entry></feed>"))
    made = p.select(c("page_id").cast("string").alias("feed_url"), F.when(c("page_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return feeds.feed_items(made).select(c("feed_url").cast("long").alias("page_id"), "title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "summary")


def chart_prices(spark, d):
    """A chart a user and day of the events."""
    e = table(spark, d, "events").where("value is not null").groupBy("user_id", c("ts").cast("date").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"))
    part = lambda f: F.transform("x", f)
    quote = F.struct(part(lambda v: v["value"]).alias("open"), part(lambda v: v["value"]).alias("close"))
    chart = F.struct(F.struct(F.array(F.struct(F.struct(c("user_id").cast("string").alias("symbol"), F.lit("AUD").alias("currency")).alias("meta"), part(lambda v: F.unix_timestamp(v["ts"])).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    rows = feeds.chart_prices(e.select(F.to_json(chart).alias("body")))
    return rows.groupBy("symbol", "currency").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"), F.max("close").alias("high"), F.count("volume").alias("n_volume"))


def announcement_rows(spark, d):
    """A table of announcements a customer and year."""
    o = table(spark, d, "orders")
    row = F.concat(F.lit("<tr class='x'><td>ABC</td><td>"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit("</td><td><a href='/doc?asxCode=XYZ&amp;id="), c("o_orderkey").cast("string"), F.lit("'>Appendix 4E &amp; Report\n 12 pages 3KB</a></td></tr>"))
    pages = o.groupBy("o_custkey").agg(F.concat(F.lit("<table><tr><th>No link</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    r = feeds.announcement_rows(pages)
    return r.select(F.regexp_extract("url", r"id=(\d+)", 1).cast("long").alias("o_orderkey"), "ticker", "title", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "doc_class", "doc_subtype")


def market_announcements(spark, d):
    """Lists of a customer's orders, for the tickers of every other customer and one year."""
    o = table(spark, d, "orders")
    item = F.struct(F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("ticker"), F.lit(" A  title ").alias("title"), F.concat(F.lit("u"), c("o_orderkey").cast("string")).alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    lists = o.groupBy("o_custkey").agg(F.to_json(F.collect_list(item)).alias("body"))
    lists = lists.unionAll(lists.where("o_custkey % 5 = 0"))
    tickers = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), c("c_custkey").cast("string")).alias("ticker"))
    return feeds.market_announcements(lists, tickers, "1995-01-01", "1995-12-31").select("ticker", "title", "url", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


def universe_lines(spark, d):
    """Lines of symbols with comments and repeats."""
    n = table(spark, d, "customer").select(F.concat(F.lit(" c"), (c("c_custkey") % 700).cast("string"), F.lit("."), F.when(c("c_custkey") % 2 == 0, " # note").otherwise("")).alias("value"))
    return files.universe(n.unionAll(n.limit(1).select(F.lit("# only a note").alias("value")))).select("ticker")


def identity_rows(spark, d):
    n = table(spark, d, "nation").select(c("n_nationkey").cast("string").alias("k"), "n_name")
    body = F.concat(F.lit('{" n'), c("k"), F.lit('": {"canonical_names": ["'), c("n_name"), F.lit('", " "], "aliases": ["A'), c("k"), F.lit('"]}, "x'), c("k"), F.lit('": {}}'))
    return files.identities(n.select(body.alias("value")), "value")


def stream_dedupe_windows(spark, d):
    """The events as a stream: the first of each user, kind and day is kept, and days are counted from what was written."""
    folder = f"{session.scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    batch = table(spark, d, "events")
    rows = spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    seen = rows.select("event_type", "user_id", c("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])

    def write(part, number):
        part.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    seen.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    session.keep_until_exit(spark, folder)
    kept = spark.read.parquet(f"{folder}/rows")
    return kept.groupBy("day", "event_type").agg(F.count("*").alias("n_users"))


def _streamed(spark, rows, name, change, mode="append"):
    """What a stream of rows, changed, writes batch by batch; the rows are a file of the shared folder."""
    folder = f"{session.scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    session.keep_until_exit(spark, folder)
    out = change(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))

    def write(part, number):
        part.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def stream_first_seen(spark, d):
    """The documents as a stream of articles without addresses: the texts of those that are let through, each once."""
    t = table(spark, d, "documents")
    rows = t.select(F.lit(None).cast("string").alias("url"), c("lang").alias("title"), c("text").alias("body"), F.timestamp_seconds(F.lit(1_700_000_000) + c("doc_id") % 86_400).alias("published"))
    return _streamed(spark, rows, "seen", lambda stream: streaming.first_seen(stream).select("exact_key")).select("exact_key")  # texts stay behind where their keys are made


def stream_daily_counts(spark, d):
    """The events as a stream of articles, counted by day and kind as they come; the last count of each stands."""
    rows = table(spark, d, "events").select(c("ts").cast("timestamp").alias("published"), c("event_type").alias("source"))
    out = _streamed(spark, rows, "days", streaming.daily_counts, "update")
    return out.groupBy(c("day").cast("date").alias("day"), "source").agg(F.max("n_articles").alias("n_articles"))


SQL = {
    "feed_items": "select page_id, 'Page & ' || cast(page_id as varchar) as title, 'http://x.com/p/' || cast(page_id as varchar) as url, '2024-01-02 03:04:05' as published, 'Bold text ' || cast(page_id as varchar) as summary from pages",
    "chart_prices": "select cast(user_id as varchar) as symbol, 'AUD' as currency, count(*) as n, min(date_trunc('second', ts)) as first_ts, max(date_trunc('second', ts)) as last_ts, max(value) as high, 0 as n_volume from events where value is not null group by 1",
    "announcement_rows": "select o_orderkey, 'XYZ' as ticker, 'Appendix 4E & Report' as title, strftime(o_orderdate, '%Y-%m-%d') as day, 'annual' as doc_class, '4E' as doc_subtype from orders",
    "market_announcements": "select 'C' || cast(o_custkey as varchar) as ticker, 'A title' as title, 'u' || cast(o_orderkey as varchar) as url, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_custkey % 2 = 0 and o_custkey in (select c_custkey from customer) and year(o_orderdate) = 1995",
    "universe_lines": "select distinct 'C' || cast(c_custkey % 700 as varchar) as ticker from customer",
    "identity_rows": "select 'N' || cast(n_nationkey as varchar) as ticker, 'canonical_names' as kind, n_name as name from nation union all select 'N' || cast(n_nationkey as varchar), 'aliases', 'A' || cast(n_nationkey as varchar) from nation",
    "stream_first_seen": "select distinct sha256(trim(regexp_replace(regexp_replace(lower(concat_ws(chr(10), lang, text)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))) as exact_key from documents",
    "stream_daily_counts": "select cast(ts as date) as day, event_type as source, count(*) as n_articles from events group by 1, 2",
    "stream_dedupe_windows": "select cast(ts as date) as day, event_type, count(distinct user_id) as n_users from events group by 1, 2",
}
QUERIES = {k: globals()[k] for k in SQL}
