"""Items of feeds, price charts and announcement lists out of columns of their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import articles, dates, text, urls


def _tag(item, *names: str):
    """The text of the first of the tags that an item has, entities decoded."""
    found = [F.nullif(text.normalize_space(F.regexp_replace(F.regexp_extract(item, rf"(?is)<(?:[a-z]+:)?{n}(?:\s[^>]*)?>(.*?)</(?:[a-z]+:)?{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")) for n in names]
    out = F.coalesce(*found, F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def feed_items(feeds: DataFrame, xml: str = "xml", feed_url: str = "feed_url") -> DataFrame:
    """(feed_url, place, title, url, published_raw, published_at, summary) of RSS and Atom feeds; items without title and link are left out.

    An item's tags are looked for within its own text, so namespaces and order don't matter.
    """
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>.*?</\1>"), 0)
    i = feeds.select(F.col(feed_url).alias("feed_url"), F.posexplode(items).alias("place", "item"))
    item = F.col("item")
    href = F.regexp_extract("item", r"(?is)<link\s[^>]*href=[\"']([^\"']+)[\"']", 1)
    # tags are columns first, so that each is found once
    i = i.select("feed_url", "place", _tag(item, "title").alias("title"), href.alias("href"), _tag(item, "link").alias("link"), _tag(item, "guid", "id").alias("guid"), _tag(item, "pubDate", "published", "updated", "date").alias("published_raw"), _tag(item, "description", "summary", "content", "encoded").alias("summary"))
    link = F.coalesce(text.missing(F.col("href")), text.missing(F.col("link")), F.when(F.col("guid").rlike("^https?://"), F.col("guid")), F.lit(""))
    i = i.select("feed_url", "place", "title", "published_raw", "summary", link.alias("link"))
    out = i.select("feed_url", "place", "title", urls.canonical(F.col("link")).alias("url"), "published_raw", dates.parse_utc(F.col("published_raw")).alias("published_at"), text.strip_html(F.col("summary")).alias("summary"))
    return out.where("title <> '' or url <> ''")


CHART = "chart struct<error: string, result: array<struct<meta: struct<symbol: string, currency: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>>>>>"


def chart_prices(charts: DataFrame, body: str = "body") -> DataFrame:
    """(symbol, currency, ts, open, high, low, close, volume) of price charts in JSON; missing figures are null, charts without a result give none."""
    r = charts.select(F.get(F.from_json(body, CHART)["chart"]["result"], F.lit(0)).alias("r")).where("r is not null")
    q = F.get(F.col("r.indicators.quote"), F.lit(0))
    rows = r.select(F.col("r.meta.symbol").alias("symbol"), F.col("r.meta.currency").alias("currency"), q.alias("q"), F.posexplode(F.col("r.timestamp")).alias("n", "t"))
    at = lambda name: F.get(F.col(f"q.{name}"), F.col("n")).alias(name)
    return rows.select("symbol", "currency", F.timestamp_seconds("t").alias("ts"), *[at(n) for n in ("open", "high", "low", "close", "volume")])


def announcement_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(place, ticker, title, url, published_at, doc_class, doc_subtype) of the rows of announcement tables with a link to a document."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>.*?</tr>"), 0)
    r = pages.select(F.posexplode(rows).alias("place", "row"))
    href = F.replace(F.regexp_extract("row", r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit("&amp;"), F.lit("&"))
    title = text.normalize_space(F.regexp_replace(text.strip_html(F.regexp_extract("row", r"(?is)<a\s[^>]*>(.*?)</a>", 1)), r"(?i)\b\d+\s*pages?.*$", ""))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), text.strip_html)
    ticker = F.coalesce(text.missing(F.upper(F.regexp_extract(href, r"(?i)[?&](?:asxcode|ticker|code)=([A-Za-z]{2,5})(?:&|$)", 1))), F.filter(cells, lambda x: x.rlike("^[A-Z0-9]{3}$"))[0])
    day = F.regexp_extract("row", r"(\d{1,2}/\d{1,2}/\d{4})", 1)
    when = F.try_to_timestamp(day, F.lit("d/M/yyyy"))
    kind = articles.document_class(title)
    out = r.select("place", ticker.alias("ticker"), F.when(title == "", "ASX Announcement").otherwise(title).alias("title"), href.alias("url"), when.alias("published_at"), kind.alias("k")).where("url <> ''")
    return out.select("place", "ticker", "title", "url", "published_at", "k.doc_class", "k.doc_subtype")


ANNOUNCEMENTS = "array<struct<ticker: string, title: string, url: string, published_at: string>>"


def market_announcements(documents: DataFrame, tickers: DataFrame | None, first: str, last: str, body: str = "body") -> DataFrame:
    """(ticker, title, url, published_at) of lists in JSON between two days and of given tickers; the first of each address counts."""
    a = documents.select(F.explode(F.from_json(body, ANNOUNCEMENTS)).alias("a")).select(F.upper(F.trim("a.ticker")).alias("ticker"), text.normalize_space(F.col("a.title")).alias("title"), "a.url", dates.parse_utc(F.col("a.published_at")).alias("published_at"))
    a = a.where(F.to_date("published_at").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if tickers is not None:
        a = a.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    return a.groupBy("url").agg(F.min(F.struct("published_at", "ticker", "title")).alias("m")).select("m.ticker", "m.title", "url", "m.published_at")
