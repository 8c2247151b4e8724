"""Names of companies from what filings say in several places: weighted, folded into the longest, conflicts dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import written
from .extract import name_score

c = F.col
#: Names of more words than this are looked at as a whole alone.
MOST_WORDS = 12


def weighed(evidence: DataFrame) -> DataFrame:
    """(ticker, key, name, score, n) of evidence (ticker, name, weight): what each name of a ticker is worth over all places that say it.

    Names are one if they differ in case, signs or blanks; the first in order stands for them.
    """
    e = evidence.withColumn("name", text.normalize_space(c("name"))).withColumn("key", text.normalize_text(c("name"))).where(c("key") != "")
    return e.groupBy("ticker", "key").agg(F.min("name").alias("name"), F.sum(name_score(c("name"), c("weight"), c("ticker"))).cast("long").alias("score"), F.count("*").alias("n"))


def folded(names: DataFrame) -> DataFrame:
    """names with ``root``: the key of the name that holds it as a run of words and is held by none, the best of several; its own if none does.

    Runs of the longer names meet the shorter by equality, so no ticker's names are compared in pairs.
    """
    words = F.split("key", " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.array_join(F.slice(words, i + 1, j - i), " "))))
    long = names.where(n.between(2, MOST_WORDS)).select("ticker", c("key").alias("root"), c("score").alias("_score"), F.explode(F.array_distinct(runs)).alias("key")).where(c("key") != c("root"))
    inside = long.join(names.select("ticker", "key"), ["ticker", "key"])
    tops = inside.join(inside.select("ticker", c("key").alias("root")).distinct(), ["ticker", "root"], "left_anti")
    best = tops.groupBy("ticker", "key").agg(F.max_by("root", F.struct("_score", F.length("root"), "root")).alias("root"))
    return names.join(best, ["ticker", "key"], "left").withColumn("root", F.coalesce("root", "key"))


def identity_map(evidence: DataFrame) -> DataFrame:
    """(ticker, kind, name, score): the canonical name of each ticker and its aliases.

    A name that others are folded into has their worth as well. Of a name that several
    tickers claim the one stays that it's worth most to, none where two are equal. The best
    that is left is canonical, of equals the first in order; the rest are aliases.
    """
    f = written(folded(weighed(evidence)), "names")
    worth = f.groupBy("ticker", c("root").alias("key")).agg(F.sum("score").alias("total"))
    f = f.join(worth, ["ticker", "key"], "left").withColumn("score", F.coalesce("total", "score")).drop("total")
    claims = f.groupBy("key").agg(F.max("score").alias("_most"), F.count("*").alias("_claims"))
    at_most = f.join(claims, "key").where((c("_claims") == 1) | (c("score") == c("_most")))
    alone = at_most.groupBy("key").agg(F.count("*").alias("_left")).where("_left = 1").select("key")
    kept = at_most.join(alone, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("ticker").orderBy((c("root") != c("key")).cast("int"), F.desc("score"), "key"))
    return kept.withColumn("_n", first).select("ticker", F.when(c("_n") == 1, "canonical").otherwise("alias").alias("kind"), "name", "score")
