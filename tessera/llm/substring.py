"""Substring deduplication by hashing lines and the pieces between cuts inside them.

Where a text is cut depends on what is near alone, never on what was counted before. Hard
cuts are sentence ends, line breaks and both ends of the text; soft ones are winnowed: of
every ``window`` words in a row the one of the least hash is cut after, unless a hard cut
is among them. A unit runs from each cut to the first by which it has ``least_words``
words (between hard cuts) or ``long_words``; whole lines are units as well. So a line of ``least_words``
words has the same unit wherever it stands, and every shared passage of 51 words has common
units (of 4,500 simulated ones 18 words at least, 39 on average); its first and last few
words, before the first and after the last cut both texts share, are not removed. Units are normalised
(lower case, words only) and 96 bits of their digests grouped over the whole table; the
occurrence of the least (doc_id, start) stays. Others are removed where, with the repeated
units they overlap or follow on, they make up a run of ``least_run`` characters: a short
sentence or line that happens to be found elsewhere is no copied passage and stays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, spare

WORD = re.compile(r"\S+")
LINE_BREAK = re.compile(r"[\n\r]")


def units(text: str, least_words: int = 5, long_words: int = 8, window: int = 14) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a whole text, ascending; they may overlap. A text of fewer words than the least has none."""
    low = text.lower()
    if len(low) != len(text):  # some capitals lower to two characters; offsets must stay
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    spans = [m.span() for m in WORD.finditer(low)]
    n = len(spans)
    if n < least_words:
        return []
    words = [low[a:b] for a, b in spans]
    bare = [w.strip(".,;:!?\"'()[]") for w in words]
    breaks = [0, *(k for k in range(1, n) if LINE_BREAK.search(low, spans[k - 1][1], spans[k][0])), n]
    hard = {k for k, w in enumerate(words, 1) if w[-1] in ".!?"}.union(breaks)
    cuts = hard
    if n >= window:
        order = np.array([-1 if k in hard else zlib.crc32(w.encode("utf-8", "replace")) for k, w in enumerate(bare, 1)], dtype=np.int64)
        least = sliding_window_view(order[::-1], window).argmin(axis=1)  # of equal ones the last in the text
        cuts = hard.union((n - np.unique(least + np.arange(len(least)))).tolist())
    at = sorted(cuts)
    far = max(long_words, least_words)

    def reaches(i: int, j: int) -> bool:
        return j - i >= far or (j - i >= least_words and i in hard and j in hard)

    found = {(i, j) for i, j in pairwise(breaks) if j - i >= least_words}
    for x, i in enumerate(at):
        for j in islice(at, x + 1, None):
            if reaches(i, j):
                found.add((i, j))
                break
    return [(spans[i][0], spans[j - 1][1], xxhash.xxh3_128_digest(" ".join(bare[i:j]).encode("utf-8", "replace"))) for i, j in sorted(found)]


def all_units(docs: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, start, end, h1, h2) of every unit; a row that repeats another of its batch adds none."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 1000):
                ids, starts, ends, digests = [], [], [], []
                some = part.iloc[at : at + 1000].drop_duplicates()
                for doc, text in zip(some["doc_id"], some["text"], strict=True):
                    for a, b, d in units(text, least_words) if text else ():
                        ids.append(doc)
                        starts.append(a)
                        ends.append(b)
                        digests.append(d)
                halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "start": np.array(starts, dtype=np.int32), "end": np.array(ends, dtype=np.int32), "h1": halves[:, 0], "h2": (halves[:, 1] >> 32).astype(np.int32)})

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInPandas(scan, "doc_id long, start int, end int, h1 long, h2 int")


def repeats(docs: DataFrame, least_words: int = 5, least_run: int = 90, gap: int = 4) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start): every unit to remove, in code points of the source text.

    Units at most ``gap`` characters apart make up a run. Null and empty texts and rows
    without doc_id have no units. Rows that repeat a doc_id and text are one occurrence.
    A unit that very many documents share is counted before it is shuffled, and its
    occurrences are joined to the one row of its first; runs are made up within a document.
    """
    work = Workspace(docs.sparkSession, "substring")
    u = work.save(all_units(docs, least_words), "units")
    first = u.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = work.save(first, "first")  # so that the join below is of two plain tables, whose skewed keys Spark splits over tasks
    here = F.struct("doc_id", "start")
    later = u.join(first, ["h1", "h2"]).where(here > F.col("f")).select("doc_id", "start", "end", F.col("f.doc_id").alias("first_doc_id"), F.col("f.start").alias("first_start"))
    later = later.repartition("doc_id").distinct()  # what follows is by document as well
    in_text = Window.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    apart = later.withColumn("apart", F.coalesce(F.col("start") > reached + gap, F.lit(True)).cast("int"))
    run = Window.partitionBy("doc_id", "run")
    runs = apart.withColumn("run", F.sum("apart").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    long = runs.withColumn("length", F.max("end").over(run) - F.min("start").over(run)).where(F.col("length") >= least_run)
    return long.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "first_doc_id", F.col("first_start").cast("long").alias("first_start"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the spans; white space on both sides of a cut becomes that before it."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a])
        at = max(at, b)
        while at < len(text) and text[at].isspace() and (not out[-1] or out[-1][-1].isspace()):
            at += 1
    return "".join(out) + text[at:]


def deduplicated(docs: DataFrame, least_words: int = 5, least_run: int = 90) -> DataFrame:
    """docs with repeated units cut from ``text`` and ``removed`` array<struct<start, end>>, the cuts in source offsets (a column of that name is replaced); order of rows is free."""
    found = repeats(docs, least_words, least_run).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("removed"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None or not len(s) else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    key, cuts = spare(docs, "first"), spare(docs, "cuts")
    both = docs.join(found.select(F.col("doc_id").alias(key), F.col("removed").alias(cuts)), docs["doc_id"] == F.col(key), "left")
    both = both.withColumn("text", without("text", cuts))
    return both.select(*[c for c in docs.columns if c.lower() != "removed"], F.col(cuts).alias("removed"))
