"""Interaction of filters: what each removes, in every order and alone, counted over whole texts.

Words are exploded and aggregated by (document, word), then by document, for totals and
distinct words; the other flags and the labels are joined to that, and documents counted
by the set of filters that they fail, 32 conditional counts a part. Every order of the
filters is then worked out of these counts, never out of documents again.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, words, distinct) of every text that holds a word; h is the text's XXH64, so that rows which share a doc_id stay apart.

    Texts are shuffled once, whole, and both aggregations run where they land; rows that
    repeat a document are dealt by the task that read them as well, so many of them don't
    land in one place. Each text is split with one empty word before it, which counts its rows.
    """
    text = F.concat(F.lit(" "), F.rtrim("text", F.lit(BLANKS)))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    keys = ["doc_id", "h", "task"]
    dealt = known.select("doc_id", F.xxhash64("text").alias("h"), F.spark_partition_id().alias("task"), "text").repartition(*keys)
    words = dealt.select(*keys, F.explode(F.split(text, r"[\x20\x09-\x0D]+")).alias("word"))
    each = words.groupBy(*keys, "word").agg(F.count("*").alias("n"))
    rows = F.sum(F.when(F.col("word") == "", F.col("n")))
    found = each.groupBy(*keys).agg(F.expr("(sum(n) - {0}) div {0}".format("sum(case when word = '' then n end)")).alias("words"), (F.count("*") - 1).alias("distinct"), rows.alias("rows"))
    return found.groupBy("doc_id", "h").agg(F.max("words").alias("words"), F.max("distinct").alias("distinct"))


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, failed, n): documents by lang (null: empty), labels and the set of filters they fail, bit k for the k-th letter.

    A: under 200 words; B: under half of the words distinct; C: over 3 % of the code points
    in A-Z; D: one of ``#$%&*|``; E: the text of a smaller doc_id. Null texts are empty: they
    fail A, and E if a smaller doc_id's is null or empty. Rows are documents: repeated ones
    count as often as they stand and none is a copy of the other; a null doc_id has no label,
    fails no E and makes no other row fail it. Of several labels of a doc_id one is enough.
    """
    work = Workspace(docs.sparkSession, "audit")
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    plain = docs.select(
        "doc_id", F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce("lang", F.lit("")).alias("part"),
        (F.lit(100) * capitals > F.lit(3) * F.length(text)).alias("c"), text.rlike("[#$%&*|]").alias("d"),
    )
    rows = work.save(plain.groupBy(*plain.columns).agg(F.count("*").alias("n")), "rows")
    # written, so that the join below is of two plain tables and Spark splits a text that very many rows share
    first = work.save(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "first")
    words = word_totals(docs).select(F.col("doc_id").alias("doc"), F.col("h").alias("hash"), "words", "distinct")
    marked = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumnRenamed("doc_id", "labelled")
    late = rows.join(first, "digest", "left").select("doc_id", "h", "part", "c", "d", "n", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("e"))
    both = late.join(words, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("hash")), "left").join(marked, F.col("doc_id") == F.col("labelled"), "left")
    total, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct", F.lit(0))
    fails = (total < 200, F.lit(100) * distinct < F.lit(50) * total, F.col("c"), F.col("d"), F.col("e"))
    failed = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return both.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), failed.alias("failed"), "n")


def interactions(failed: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part and all orders; an empty table has no parts."""
    counts = [F.sum(F.when(F.col("failed") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(SETS)]
    sums = failed.groupBy("part", "good", "toxic").agg(*counts)
    orders = ["".join(p) for p in permutations(FILTERS)]
    every = sums.select("part", "good", "toxic", F.array(*[f"n{k}" for k in range(SETS)]).alias("counts"), F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    every = every.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {letter: F.instr("filter_order", letter) for letter in FILTERS}
    every = every.withColumn("before", sum((F.when(place[x] < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0)))
    every = every.withColumn("own", sum((F.when(place[x] == F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0)))

    def over(condition: str, weight: str = "1") -> F.Column:
        return F.expr(f"aggregate(transform(counts, (x, k) -> if({condition}, x * {weight}, 0L)), 0L, (a, x) -> a + x)")

    made = every.select(
        "part", "filter_order", "step", "good", "toxic",
        over("(k & (before | own)) = 0").alias("kept"),
        over("(k & own) <> 0 and (k & before) = 0").alias("removed"),
        over("(k & own) <> 0 and (k & before) <> 0").alias("redundant"),
        over("k = own").alias("unique_fails"),
        over("(k & own) <> 0", f"({len(orders)} div bit_count(k))").alias("shapley"),
    )
    lost = [F.sum(F.when(F.col(c), F.col("removed")).otherwise(0)).alias(name) for c, name in (("good", "good_lost"), ("toxic", "toxic_lost"))]
    plain = [F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")]
    return made.groupBy("part", "filter_order", "step").agg(*plain, *lost, F.sum("shapley").alias("shapley"))
