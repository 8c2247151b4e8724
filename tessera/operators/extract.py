"""From lines to metric rows: what a line says, the blocks lines stand in, repeated periods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from ..functions import filings as ff

c = F.col


def parsed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines, a row for each metric that a line names and has a figure for: metric, variant, alias, value_type, raw_value, value, period.

    Percentages belong to metrics of that kind, the one nearest to the metric's name;
    amounts to the others, the best ranked one. Metrics without a figure are text.
    """
    hit = lines.withColumn("metric", F.explode(ff.metric_hits(c(line)))).where(F.trim(line) != "")
    r = ff.ranked_amounts(hit, line, "metric", ff.metric_pattern(c("metric")), "_amounts")
    r = r.withColumns({"_percents": ff.spans(c(line), ff.PERCENT), "_names": ff.spans(c(line), ff.metric_pattern(c("metric")))})
    share = c("metric").endswith("_pct")
    near = F.array_sort(F.transform("_percents", lambda p: F.struct(F.array_min(F.transform("_names", lambda n: F.abs(p["at"] - n["at"]))).alias("d"), p["at"].alias("at"), p["found"].alias("found"))))
    r = r.withColumns({"_share": F.when(share, F.try_element_at(near, F.lit(1))), "_best": F.when(~share, F.try_element_at("_amounts", F.lit(1)))})
    kind = F.when(c("_share").isNotNull(), "percent").when(c("_best").isNotNull(), "amount").otherwise("text")
    value = F.coalesce(numeric.safe_float(F.regexp_replace(c("_share.found"), r"\s*%", "")), c("_best.value"))
    out = r.withColumns({
        "variant": ff.metric_variant(c("metric"), c(line), c(line), F.lit("")), "alias": ff.metric_alias(c("metric"), c(line), c(line)),
        "value_type": kind, "raw_value": F.coalesce("_share.found", "_best.raw", F.lit("")), "value": value, "period": F.coalesce(F.try_element_at(dates.period_labels(c(line)), F.lit(1)), F.lit("")),
    })
    return out.drop("_amounts", "_percents", "_names", "_share", "_best")


def statement_blocks(lines: DataFrame, key: str) -> DataFrame:
    """lines with block, header, scope and family: a block begins at a line that names a statement, a note or the parent; its unit and dates carry on with it."""
    starts = ff.says(c("line"), "layout") | ff.says(c("line"), "note") | ff.says(c("line"), "parent") | ff.says(c("line"), "appendix")
    w = Window.partitionBy(key).orderBy("line_no")
    b = lines.withColumn("_start", starts).withColumn("block", F.sum(c("_start").cast("int")).over(w))
    in_block = Window.partitionBy(key, "block").orderBy("line_no")
    b = b.withColumn("header", F.when(c("block") > 0, F.first("line").over(in_block)).otherwise(F.lit("")))
    b = b.withColumn("_dates", F.when(F.size(dates.explicit_dates(c("line"))) > 0, text.normalize_space(c("line"))))
    b = b.withColumns({"table_header": F.coalesce(F.last("_dates", ignorenulls=True).over(in_block.rowsBetween(-24, 0)), F.lit("")), "unit": F.coalesce(F.last(numeric.unit_multiplier(c("line")), ignorenulls=True).over(in_block.rowsBetween(-24, 0)), F.lit(1.0))})
    s = ff.statement_scope(F.lit(""), c("header"), F.lit("canonical_report"))
    return b.withColumns({"scope": F.when(c("block") > 0, s["scope"]).otherwise("other"), "family": ff.statement_family(c("header"), F.lit(""), F.lit(""))}).drop("_start", "_dates")


def block_metrics(lines: DataFrame, key: str) -> DataFrame:
    """Metric rows of all blocks: parsed lines with their block's scope, family and unit, the period of their own or the block's dates, and confidence."""
    r = parsed_lines(statement_blocks(lines, key))
    money = (c("value_type") == "amount") & c("metric").isin(*ff.MONEY)
    scaled = numeric.apply_multiplier(c("value"), c("unit"), c("raw_value"), money)
    currency = F.regexp_extract("raw_value", "(?i)^((?:A|US|C|NZ)?[$€£])", 1)
    period = F.coalesce(dates.period_end(c("period")), F.date_format(dates.named_date(c("table_header")), "yyyy-MM-dd"), F.lit(""))
    r = r.withColumns({"value": scaled, "currency": currency, "period_end": period})
    return r.withColumn("confidence", ff.field_confidence(c("value_type"), c("metric"), c("raw_value"), c("currency"), c("period_end"), c("scope"), F.lit(True)))


def rebalanced_periods(rows: DataFrame, missing: DataFrame) -> DataFrame:
    """rows (file, page, metric, label, ordinal, period_end): a period that a (page, metric, label) repeats or lacks becomes the latest of the file's missing ones that's still free, one of the same day of the year first.

    missing: file, period_end. Rows come to a task in order, and only the periods of the
    row of a table at hand are held.
    """
    gone = missing.groupBy("file").agg(F.array_sort(F.collect_set("period_end")).alias("_missing"))
    r = rows.join(gone, "file", "left").withColumn("_missing", F.coalesce("_missing", F.array().cast("array<string>")))
    key, names = ["file", "page", "metric", "label"], rows.columns

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, set()
        for part in parts:
            out = []
            for at, period, wanted in zip(zip(*[part[k] for k in key], strict=True), part["period_end"], part["_missing"], strict=True):
                if at != now:
                    now, used = at, set()
                if not period or period in used:
                    free = [x for x in wanted if x and x not in used]
                    same = [x for x in free if re.fullmatch(r"\d{4}-\d{2}-\d{2}", period or "") and x[5:] == period[5:]]
                    period = max(same or free, default=period)
                used.add(period)
                out.append(period)
            yield part.assign(period_end=out)[names]

    return r.repartition(*key).sortWithinPartitions(*key, "ordinal").mapInPandas(scan, rows.schema)


def selected(facts: DataFrame, names: list[str], least_conf: int, key: tuple[str, ...] = ("company", "period")) -> DataFrame:
    """(key, value, chosen): the first of the named metrics that has a value with enough confidence."""
    rank = F.array_position(F.array(*map(F.lit, names)), c("metric"))
    some = facts.where(c("metric").isin(*names) & c("value").isNotNull() & (c("conf") >= least_conf))
    order = F.struct(rank, -c("conf"), "ord")
    return some.groupBy(*key).agg(F.min_by("value", order).alias("value"), F.min_by("metric", order).alias("chosen"))


def supported(signals: DataFrame, support: DataFrame, key: tuple[str, ...] = ("company", "period"), least: float = 0.6) -> DataFrame:
    """signals with the support of their statement (none is zero) and what it's worth."""
    s = support.select(*key, c("support").alias("_s"))
    out = signals.join(s, list(key), "left").withColumn("support", F.round(F.coalesce("_s", F.lit(0.0)), 6)).drop("_s")
    return out.withColumn("risk_confidence", F.when(c("support") < least, "LOW_SUPPORT").otherwise("ADEQUATE_SUPPORT"))


def soft_recall(scored: DataFrame, by: str, k: int, more: int, first: list, then: list) -> DataFrame:
    """The k best of each query by ``then`` among the k times ``more`` best by ``first``."""
    wide = scored.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*first))).where(c("_n") <= k * more)
    return wide.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*then))).where(c("rank") <= k).drop("_n")


# What names of companies end in, and words of documents' titles.
COMPANY_ENDS = ("group limited", "limited", "ltd", "group", "holdings", "corporation", "bank", "resources", "mining")
DOCUMENT_WORDS = ("announcement", "appendix", "application", "conference", "cleansing", "distribution", "dividend", "guidance", "half year", "interim", "investor", "meeting", "notice", "notification", "presentation", "quarterly", "results", "update", "webinar")


def name_score(name, weight, ticker):
    """How likely a text is a company's name: its source's weight, more for company forms and length, less for symbols, many words and titles' words."""
    low = F.lower(name)
    points = weight + F.when(low.rlike("|".join(COMPANY_ENDS)), 40).otherwise(0) + F.when(F.contains(low, F.lit("bank of australia")), 25).otherwise(0)
    points = points - F.when(low == F.lower(ticker), 80).otherwise(0) - F.when(F.size(F.split(F.trim(name), r"\s+")) > 8, 20).otherwise(0) - F.when(low.rlike("|".join(DOCUMENT_WORDS)), 15).otherwise(0)
    return points + F.least(F.lit(20), F.floor(F.length(name) / 6)).cast("int")


def best_names(candidates: DataFrame) -> DataFrame:
    """(ticker, name, score, n_sources): the name of each ticker with the greatest sum of scores; of equals the first in order."""
    g = candidates.groupBy("ticker", F.lower(F.trim("name")).alias("_key")).agg(F.sum(name_score(c("name"), c("weight"), c("ticker"))).alias("score"), F.min(F.trim("name")).alias("name"), F.count("*").alias("n_sources"))
    order = F.struct(-c("score"), "name")
    return g.groupBy("ticker").agg(F.min_by("name", order).alias("name"), F.max("score").alias("score"), F.min_by("n_sources", order).alias("n_sources"))


def ambiguous_tickers(names: DataFrame, collisions: DataFrame) -> DataFrame:
    """Tickers with a phrase they are mistaken for, or whose short name in capitals another one shares."""
    short = names.withColumn("term", F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "")).where(c("term").rlike("^[A-Z][A-Z0-9]{1,5}$"))
    shared = short.select("term", "ticker").distinct().groupBy("term").agg(F.count("*").alias("n")).where("n > 1").join(short, "term").select("ticker")
    return collisions.select("ticker").union(shared).distinct()


def padded(x):
    """Lower case, signs as blanks, one blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def headline_tickers(headlines: DataFrame, tickers: DataFrame, ambiguous: DataFrame, collisions: DataFrame, keywords: list[str]) -> DataFrame:
    """(id, ticker, accepted) of symbols that stand in a headline as such or before one of the keywords.

    Ambiguous ones are accepted only of the home market's sources, with a keyword in the
    title and none of their collision phrases. headlines: id, title, source_is_au.
    """
    words = "|".join(re.escape(k).replace(r"\ ", r"\s+") for k in keywords)
    up = F.upper("title")
    found = F.concat(F.regexp_extract_all(up, F.lit(r"\bASX\s*[:\-]\s*([A-Z0-9]{2,6})\b"), 1), F.regexp_extract_all(up, F.lit(r"(?<![A-Z0-9])([A-Z0-9]{2,6})\.AX(?![A-Z0-9])"), 1), F.regexp_extract_all(up, F.lit(rf"(?i)(?<![A-Za-z0-9])([A-Z][A-Z0-9]{{1,5}})(?![A-Za-z0-9])\s+(?:{words})\b"), 1))
    h = headlines.select("id", "title", "source_is_au", F.explode(F.array_distinct(found)).alias("ticker")).join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    h = h.join(ambiguous.select("ticker").distinct().withColumn("_amb", F.lit(True)), "ticker", "left")
    said = F.array(*[F.contains(padded(c("title")), padded(F.lit(k))) for k in keywords])
    phrases = collisions.groupBy("ticker").agg(F.collect_set("phrase").alias("_phrases"))  # a few phrases a ticker
    h = h.join(phrases, "ticker", "left")
    hit = F.coalesce(F.exists("_phrases", lambda p: F.contains(padded(c("title")), padded(p))), F.lit(False))
    return h.select("id", "ticker", (c("_amb").isNull() | (c("source_is_au") & F.exists(said, lambda x: x) & ~hit)).alias("accepted"))
