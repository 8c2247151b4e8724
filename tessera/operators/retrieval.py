"""Lexical and vector retrieval, re-ranking and evaluation."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import short_batches

TOKEN = "[a-z0-9_]+"


def top_k(scores: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: So many queries are held by every task at a time; more are searched in further passes, however many there are.
BLOCK = 2048


def query_blocks(queries: DataFrame, query_key: str, *columns: str) -> Iterator[pd.DataFrame]:
    """The queries in blocks of about BLOCK rows by a hash of their key: only one block at a time is on the driver."""
    n = queries.count()
    blocks = -(-n // BLOCK)
    dealt = queries.select(F.col(query_key).cast("long").alias("query"), *columns)
    for k in range(blocks):
        mine = dealt.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k) if blocks > 1 else dealt
        yield mine.toPandas().sort_values("query", ignore_index=True)


def best_of_task(docs: DataFrame, key: str, ids: np.ndarray, scorer: Callable[[pd.DataFrame], np.ndarray], k: int, digits: int, group: str | None = None) -> DataFrame:
    """(query, key, group, score): of every task the k best rows for each query (and group), by rounded score, then key.

    ``scorer`` gives rows x queries of a part of docs, nan where the two have nothing in common.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                scores = np.floor(scorer(some) * 10.0**digits + 0.5) / 10.0**digits
                groups = some[group].to_numpy() if group else np.zeros(len(some), dtype=np.int64)
                for g in pd.unique(groups):
                    of = groups == g
                    s, i = scores[of], np.broadcast_to(some[key].to_numpy()[of, None], (int(of.sum()), len(ids)))
                    if g in best:
                        s, i = np.concatenate((best[g][0], s)), np.concatenate((best[g][1], i))
                    first = np.lexsort((i, -s), axis=0)[:k]  # nan last
                    best[g] = np.take_along_axis(s, first, 0), np.take_along_axis(i, first, 0)
        for g, (s, i) in best.items():
            row, query = np.nonzero(~np.isnan(s))
            yield pd.DataFrame({"query": ids[query], key: i[row, query], "group": str(g), "score": s[row, query]})

    return docs.mapInPandas(scan, f"query long, {key} long, group string, score double")


def in_blocks(docs: DataFrame, queries: DataFrame, key: str, query_key: str, columns: tuple[str, ...], make: Callable[[pd.DataFrame], Callable], k: int, digits: int, group: str | None = None) -> DataFrame:
    """(query_key, key, group, score, rank): the k best rows of docs for each query (and group), exactly; ties by key.

    Each block of queries is one pass over docs, from which a few rows a query and task are shuffled.
    """
    short_batches(docs.sparkSession)
    found = None
    for block in query_blocks(queries, query_key, *columns):
        one = best_of_task(docs, key, block["query"].to_numpy(), make(block), k, digits, group)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"query long, {key} long, group string, score double")
    w = Window.partitionBy("query", "group").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("query", query_key)


def tfidf_top(docs: DataFrame, queries: DataFrame, key: str, query_key: str, body: str, k: int, boost: str | None = None, group: str | None = None) -> DataFrame:
    """The k best of docs by the sum over shared tokens of both counts and the idf, plus a column of boosts if named.

    Document frequencies of the block's tokens come from one pass in which only those are shuffled.
    """
    n_docs = docs.count()
    words = re.compile(TOKEN)

    def make(block: pd.DataFrame) -> Callable:
        counts = [Counter(words.findall((t or "").lower())) for t in block[body]]
        terms = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
        wanted = docs.sparkSession.createDataFrame([(t,) for t in terms], "token string")
        seen = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(TOKEN), 0))).alias("token"))
        df = dict(seen.join(wanted, "token", "left_semi").groupBy("token").count().collect())  # a row for each token of the block
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        for q, c in enumerate(counts):
            for t, n in c.items():
                postings[terms[t]].append((q, n * (math.log((1 + n_docs) / (1 + df.get(t, 0))) + 1.0)))
        of = [(np.array([q for q, _ in p]), np.array([w for _, w in p])) for p in postings]

        def scorer(part: pd.DataFrame) -> np.ndarray:
            out = np.full((len(part), len(counts)), np.nan)
            for row, t in enumerate(part[body]):
                hits = [(terms[w], n) for w, n in Counter(words.findall((t or "").lower())).items() if w in terms]
                if hits:
                    at = np.concatenate([of[w][0] for w, _ in hits])
                    total = np.bincount(at, np.concatenate([of[w][1] * n for w, n in hits]), len(counts))
                    out[row] = np.where(np.bincount(at, minlength=len(counts)) > 0, total, np.nan)
            return out + part[boost].to_numpy(dtype=float)[:, None] if boost else out

        return scorer

    return in_blocks(docs, queries, key, query_key, (body,), make, k, 4, group)


def hashed_vectors(texts: list[str | None], dim: int, known: dict[str, int]) -> np.ndarray:
    """Unnormalised vectors: each token adds a signed one at a place its hash names; sign and place share the hash's low bit."""
    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        for t, n in Counter(re.findall(TOKEN, (text or "").lower())).items():
            if (h := known.get(t)) is None:
                h = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
                if len(known) < 500_000:
                    known[t] = h
            out[row, h % dim] += -n if h & 1 else n
    return out


def hash_top(docs: DataFrame, queries: DataFrame, key: str, query_key: str, body: str, k: int, dim: int = 384) -> DataFrame:
    """The k nearest of docs by the cosine of hashed token vectors; rows without a common place aren't compared."""

    def unit_rows(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)

    def make(block: pd.DataFrame) -> Callable:
        raw = hashed_vectors(block[body].to_list(), dim, {})
        q, used = unit_rows(raw), (raw != 0).astype(np.float32)
        known: dict[str, int] = {}

        def scorer(part: pd.DataFrame) -> np.ndarray:
            x = hashed_vectors(part[body].to_list(), dim, known)
            return np.where((x != 0).astype(np.float32) @ used.T > 0, unit_rows(x) @ q.T, np.nan)

        return scorer

    return in_blocks(docs, queries, key, query_key, (body,), make, k, 4)


def vector_top(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, column: str, k: int, same: str | None = None) -> DataFrame:
    """The k nearest of vectors by cosine to each query but itself; with ``same`` only rows of the query's value there."""

    def unit_rows(rows: list) -> np.ndarray:
        x = np.array(rows, dtype=float)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)

    def make(block: pd.DataFrame) -> Callable:
        q, ids = unit_rows(block[column].to_list()), block["query"].to_numpy()
        label = block[same].to_numpy() if same else None

        def scorer(part: pd.DataFrame) -> np.ndarray:
            s = unit_rows(part[column].to_list()) @ q.T
            s[part[key].to_numpy()[:, None] == ids] = np.nan
            if same:
                s[part[same].to_numpy()[:, None] != label] = np.nan
            return s

        return scorer

    return in_blocks(vectors, queries, key, query_key, (column, *([same] if same else [])), make, k, 5)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, -1 where their lengths differ."""
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def recency_boost(age_hours: Column, half_life: float, most: float) -> Column:
    return F.least(F.lit(most), most * F.exp(F.lit(-0.6931471805599453) * F.greatest(F.lit(0.0), age_hours) / max(1.0, half_life)))


def interleave(hits: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Ranked hits (corpus, rank) of several corpora, each up to its quota, taken in turn."""
    quota = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])[F.col("corpus")]
    return hits.where(F.col("rank") <= quota).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "corpus")))


def evaluate(ranks: DataFrame, k: int) -> DataFrame:
    """hit@k and mean reciprocal rank of (query_id, rank), rank null where nothing was found."""
    hit = (F.coalesce("rank", F.lit(1 << 30)) <= k).cast("int")
    return ranks.agg(F.count("*").alias("n_queries"), F.avg(hit).alias("hit_rate"), F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
