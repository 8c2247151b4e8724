"""Language identification by nearest centroid over TF-IDF byte n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import below, dice, spare

#: Each text is a vector of this many hashed counts: two- and three-byte n-grams of its lower-cased letters.
FEATURES = 1 << 13


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None if it has no letter.

    Runs of anything but letters become one blank, ASCII and other letters are lowered.
    """
    low = text.lower()
    raw = np.frombuffer(low.encode("utf-8", "replace"), dtype=np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    if not letter.any() or (not ((raw >= 97) & (raw <= 122)).any() and not any(map(str.isalpha, low))):
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, raw, 32)[keep].astype(np.uint32)
    codes = np.concatenate((np.array([32], dtype=np.uint32), codes, np.array([32], dtype=np.uint32)))
    two = codes[:-1] * np.uint32(257) + codes[1:]
    three = two[:-1] * np.uint32(263) + codes[2:]
    out = np.zeros(FEATURES)
    for grams, salt in ((two, 0x9E3779B1), (three, 0x85EBCA77)):
        for at in range(0, len(grams), 1 << 20):
            out += np.bincount((grams[at : at + (1 << 20)] * np.uint32(salt)) >> np.uint32(19), minlength=FEATURES)
    return out


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    matrix: np.ndarray  # centroid x feature, rows of length one
    floor: float  # cosine below which a text is rejected

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.sqrt(n) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """(language, score in 0..1, cosine); ``und`` with scores of zero for null or letterless texts."""
        n = counts(text) if text else None
        if n is None or not self.langs:
            return "und", 0.0, 0.0
        cos = self.matrix @ self.vector(n)
        at = int(cos.argmax())
        lang = self.langs[at]
        other = max((c for c, k in zip(cos, self.langs, strict=True) if k != lang), default=0.0)
        return lang, float(min(1.0, max(0.0, 0.5 + (cos[at] - other)))), float(cos[at])


def fit(labelled: DataFrame, per_language: int = 600, most_languages: int = 1000, clusters: int = 3, rounds: int = 12, seed: int = 7, reject: float = 0.2) -> Centroids:
    """Spherical k-means per language over at most ``per_language`` texts of each of the ``most_languages`` commonest (the bounds on what is learnt from).

    labelled: doc_id, text, lang; rows of null text or lang are passed over, as are texts
    without a letter. The sample of a language is the texts of the least hash of
    (doc_id, text), so it doesn't depend on the order of tasks. ``reject`` times the
    median cosine of the sample to its own centroid is the least cosine of an accepted
    text. An empty table gives no centroids.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", dice("doc_id", "text").alias("dice"))
    # texts are counted once however often they are repeated, so that a common one doesn't crowd its language out
    counted = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("dice").alias("n"))
    sizes = {r.lang: r.n for r in counted.orderBy(F.desc("rows"), "lang").limit(most_languages).collect()}

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (n := counts(t)) is None else zlib.compress(n.astype("<f4").tobytes(), 1) for t in texts], dtype=object)

    # rows that can't be among the least by far are left out before the ranking, and of rows that repeat another one stays
    least = F.lit(-1).cast("long")
    for lang, n in sizes.items():
        least = F.when(F.col("lang") == lang, F.lit(below(2 * per_language, n))).otherwise(least)
    some = rows.where(F.col("dice") <= least).distinct()
    first = Window.partitionBy("lang").orderBy("dice", "text")
    some = some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language)
    # or else Spark would work the vectors out twice, once for the condition, and a task take two Python workers
    found = some.select("lang", vectors.asNondeterministic()("text").alias("v")).where("v is not null").collect()
    if not found:
        return Centroids(np.ones(FEATURES), [], np.zeros((0, FEATURES)), 0.0)
    packed: dict[str, list[bytes]] = {}  # kept packed; one language at a time is laid out
    for r in found:
        packed.setdefault(r.lang, []).append(bytes(r.v))
    raw = lambda v: np.frombuffer(zlib.decompress(v), dtype="<f4")
    have = np.zeros(FEATURES)
    for r in found:
        have += raw(r.v) > 0
    idf = np.log((1 + len(found)) / (1 + have)) + 0.05
    langs, centres, own = [], [], []
    for lang, rows_of in sorted(packed.items()):
        mine = np.sqrt(np.array([raw(v) for v in sorted(rows_of)])) * idf
        mine /= np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-12)
        k = min(clusters, len(mine))
        c = mine[np.random.default_rng(seed).choice(len(mine), k, replace=False)]
        for _ in range(rounds):
            to = (mine @ c.T).argmax(axis=1)
            c = np.array([mine[to == j].sum(axis=0) if (to == j).any() else c[j] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        langs += [lang] * k
        centres.append(c)
        own.append((mine @ c.T).max(axis=1))
    return Centroids(idf, langs, np.concatenate(centres), reject * float(np.median(np.concatenate(own))))


def predict(docs: DataFrame, model: Centroids, name: str = "found") -> DataFrame:
    """docs with a column ``name`` (one of that name is replaced) of lang_pred, score, cosine and accepted. Whole texts are used; a null or letterless text is ``und`` and not accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x clusters x languages doubles

    @F.pandas_udf("lang_pred string, score double, cosine double, accepted boolean")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in parts:
            rows = [m.nearest(t) for t in texts]
            yield pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "cosine": [r[2] for r in rows], "accepted": [r[0] != "und" and r[2] >= m.floor for r in rows]})

    return docs.withColumn(name, of("text"))


def remainder(docs: DataFrame, by: int):
    """crc32 of doc_id as text, modulo ``by``; null for a null doc_id."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % by


def digest(docs: DataFrame) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 isn't 2 and predicts every row; ``accepted`` is the rejection by distance, which leaves lang_pred as it is."""
    model = fit(docs.where(F.coalesce(remainder(docs, 4) != 2, F.lit(False))))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "found.lang_pred", "found.score", "found.cosine", "found.accepted")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """Rows whose language is accepted, with the columns of docs."""
    model = fit(docs.where(F.coalesce(remainder(docs, 4) != 2, F.lit(False))))
    name = spare(docs, "found")
    return predict(docs, model, name).where(F.col(name)["accepted"]).select(*docs.columns)

