"""Articles: duplicates in stages, survivorship, hashes, sentiment and windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import written

# Terms and weights of the lexicons.
POSITIVE = {
    "beat estimates": 1.8, "beats estimates": 1.8, "raises guidance": 1.9, "raised guidance": 1.9, "guidance raised": 1.8, "upgrade": 1.2, "upgraded": 1.2, "record revenue": 1.5,
    "strong demand": 1.2, "margin expansion": 1.4, "expanding margin": 1.4, "profit growth": 1.4, "cash flow improved": 1.3, "debt reduction": 1.3, "deleveraging": 1.2, "buyback": 1.0,
}
NEGATIVE = {
    "miss estimates": 1.8, "missed estimates": 1.8, "cuts guidance": 1.9, "cut guidance": 1.9, "guidance cut": 1.8, "downgrade": 1.2, "downgraded": 1.2, "profit warning": 1.8, "margin pressure": 1.4,
    "margin contraction": 1.5, "weak demand": 1.2, "liquidity concern": 1.6, "cash burn": 1.5, "debt maturity risk": 1.7, "covenant breach": 2.2, "default risk": 2.2, "bankruptcy": 2.5, "trading halt": 1.2,
}


def weighted_hits(x: Column, lexicon: dict[str, float]) -> tuple[Column, Column]:
    """(weight, count) of lexicon terms in lowered text: phrases as substrings, single words between boundaries."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(x, F.lit(""))), F.lit(" "))
    counts = [(w, F.regexp_count(low, F.lit(t if " " in t else rf"\b{t}\b"))) for t, w in lexicon.items()]
    return sum(w * n for w, n in counts), sum(n for _, n in counts)


def sentiment(x: Column, positive: dict | None = None, negative: dict | None = None) -> Column:
    """struct(score, confidence, positive_hits, negative_hits) of a whole text."""
    body = text.normalize_space(x)
    pw, pn = weighted_hits(body, positive or POSITIVE)
    nw, nn = weighted_hits(body, negative or NEGATIVE)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (pw - nw) / (pw + nw + 2.5)))
    conf = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.18 + 0.07 * F.least(F.lit(8), pn + nn) + 0.2 * F.least(F.lit(1.0), F.length(body) / 1600.0)))
    return F.struct(score.alias("score"), conf.alias("confidence"), pn.alias("positive_hits"), nn.alias("negative_hits"))


def sentiment_windows(articles: DataFrame, as_of, windows: tuple[int, ...] = (7, 30, 90), half_life: float = 7.0) -> DataFrame:
    """Per (ticker, window): articles no older than the window, weighted by confidence and recency.

    articles: ticker, day, score, confidence, source. Articles after as_of count as of that day.
    """
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), "day"))
    a = articles.where("day is not null").withColumn("age", age)
    a = a.withColumn("weight", F.greatest(F.lit(0.05), F.col("confidence")) * F.exp(F.lit(-0.6931471805599453 / max(0.1, half_life)) * F.col("age")))
    # each article goes to the windows that hold it, then one partial aggregation
    a = a.withColumn("window_days", F.explode(F.filter(F.array(*map(F.lit, windows)), lambda w: F.col("age") <= w)))
    g = a.groupBy("ticker", "window_days").agg(F.count("*").alias("article_count"), F.countDistinct("source").alias("source_count"), F.sum(F.col("score") * F.col("weight")).alias("ws"), F.sum("weight").alias("w"), F.avg("confidence").alias("avg_confidence"), F.avg("age").alias("avg_age"))
    mean = F.when(F.col("w") > 0, F.col("ws") / F.col("w")).otherwise(0.0)
    return g.select("ticker", "window_days", "article_count", "source_count", F.round(mean, 6).alias("weighted_sentiment"), F.round((mean + 1) * 50, 3).alias("score_0_100"), F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_age", 6).alias("avg_age"))


def staged_duplicates(articles: DataFrame) -> DataFrame:
    """articles (ord, url, title, body) with ``reason``: duplicate_url, else _exact, else _near, else null.

    A row that reaches a stage registers its key there even if a later stage drops it: at
    each stage the least ord of every key among the rows left is found by a partial
    aggregation and joined back. Rows without a url pass that stage by; texts don't travel,
    only their hashes, which are worked out once and written.
    """
    url = F.nullif(F.lower(F.coalesce("url", F.lit(""))), F.lit(""))
    keys = articles.select("ord", url.alias("url"), F.sha1(text.normalize_text(F.concat_ws("\n", "title", "body"))).alias("exact"), text.near_key(F.col("title"), F.col("body")).alias("near"))
    out = written(keys, "article-keys").withColumn("reason", F.lit(None).cast("string"))
    for key in ("url", "exact", "near"):
        first = out.where(F.col("reason").isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("first"))
        out = out.join(first, key, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("ord") > F.col("first"), f"duplicate_{key}"))).drop("first")
    return articles.join(out.select("ord", "reason"), "ord")


def survivors(items: DataFrame) -> DataFrame:
    """One row per identity: provider rank, then longer body, then later fetch wins; published is the least, fetched the latest."""
    order = F.struct("provider_rank", F.length(F.coalesce("body", F.lit(""))), "fetched", -F.col("item_id"))
    return items.groupBy("identity").agg(F.max_by("item_id", order).alias("winner_id"), F.max_by("provider", order).alias("provider_best"), F.min("published").alias("published"), F.max("fetched").alias("fetched"), F.count("*").alias("n_versions"))


def vote_hash(x: Column) -> Column:
    """Near hash of a text: a bit is set unless more tokens lack it than have it, over the first 64 bits of each token's SHA-256; zero without tokens. Votes are counted within the row, so nothing is shuffled."""
    return F.pandas_udf(_vote_hashes, "string")(x)


def _vote_hashes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, bytes] = {}
    for part in texts:
        out = []
        for t in part:
            tokens = re.findall("[a-z0-9]+", (t or "").lower()) if (t or "").isascii() else re.sub("[^a-z0-9 ]", " ", (t or "").lower()).split()
            digests = []
            for w in tokens:
                if (h := known.get(w)) is None:
                    h = hashlib.sha256(w.encode()).digest()[:8]
                    if len(known) < 500_000:
                        known[w] = h
                digests.append(h)
            votes = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out.append(np.packbits(2 * votes >= len(tokens)).tobytes().hex() if tokens else "0" * 16)
        yield pd.Series(out)
