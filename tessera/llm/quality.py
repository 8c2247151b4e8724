"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe the line and its neighbours; the
chain's transition weights tie adjacent labels. Forward-backward marginals of the
good label, weighted by line length, average to the document's score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import below, dice
from .langid import remainder

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"#$%&*!|<>{}[]@^~=+\\/_"
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: Longer lines are cut into parts of so many words, each a link of the chain.
PART = 200
N_OWN = 11
N_FEATURES = 3 * N_OWN + 1


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(own features line by feature, lengths) of the lines of a whole text that have a word; none for an empty text."""
    rows, lengths = [], []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        every = line.split()
        for at in range(0, len(every), PART):
            words = every[at : at + PART]
            raw = line if len(every) <= PART else b" ".join(words)
            n, w = len(raw), len(words)
            kinds = set(words)
            letters = n - len(raw.translate(None, LETTERS))
            upper = n - len(raw.translate(None, UPPER))
            marks = n - len(raw.translate(None, MARKS))
            digits = n - len(raw.translate(None, DIGITS))
            same = sum(a == b for a, b in zip(words, words[1:], strict=False)) if len(kinds) < 0.8 * w else 0
            rows.append(
                (
                    upper / max(1, letters),
                    min(1.0, 3 * marks / n),
                    raw.count(b"|") / w,
                    raw.count(b"!!") / w,
                    digits / n,
                    1 - len(kinds) / w,
                    same / w,
                    min(2.0, n / w / 8),
                    min(1.0, w / 50),
                    1.0 if w < 4 else 0.0,
                    raw.count(b",") / w + raw.count(b".") / w,
                )
            )
            lengths.append(n)
    return np.array(rows, dtype=float).reshape(-1, N_OWN), np.array(lengths, dtype=float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of each line: its own, the previous line's, the next line's and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    return np.concatenate((own, before, after, np.ones((len(own), 1))), axis=1)


@dataclass
class Crf:
    weights: np.ndarray  # feature x 2 labels (bad, good)
    moves: np.ndarray  # 2 x 2
    default: float  # score of a text without words

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good label for each line."""
        return chain_marginals(x @ self.weights, self.moves)[0][:, 1]

    def score(self, text: str | None) -> float:
        own, lengths = line_features(text or "")
        if not len(own):
            return self.default
        good = self.marginals(with_neighbours(own))
        return float(min(1.0, max(0.0, (good * lengths).sum() / lengths.sum())))


def chain_marginals(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(label marginals, expected moves, log partition) by scaled forward-backward."""
    n = len(emit)
    top = emit.max(axis=1, keepdims=True)
    e = np.exp(emit - top)
    shift = moves.max()
    t = np.exp(moves - shift)
    fwd, scale = np.empty((n, 2)), np.empty(n)
    (t00, t01), (t10, t11) = t.tolist()
    a0, a1 = 1.0, 1.0
    rows = e.tolist()
    for i, (e0, e1) in enumerate(rows):
        if i:
            a0, a1 = (a0 * t00 + a1 * t10) * e0, (a0 * t01 + a1 * t11) * e1
        else:
            a0, a1 = e0, e1
        c = a0 + a1
        a0, a1 = a0 / c, a1 / c
        fwd[i] = a0, a1
        scale[i] = c
    back = np.empty((n, 2))
    b0 = b1 = 1.0
    for i in range(n - 1, -1, -1):
        back[i] = b0, b1
        e0, e1 = rows[i]
        x0, x1 = e0 * b0, e1 * b1
        b0, b1 = t00 * x0 + t01 * x1, t10 * x0 + t11 * x1
        c = b0 + b1
        b0, b1 = b0 / c, b1 / c
    both = fwd * back
    both /= both.sum(axis=1, keepdims=True)
    pair = np.zeros((2, 2))
    if n > 1:
        p = fwd[:-1, :, None] * t[None] * (e[1:] * back[1:])[:, None, :]
        pair = (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both, pair, float(np.log(scale).sum() + top.sum() + shift * (n - 1))


def stretch(lines: np.ndarray, most: int, key: int) -> np.ndarray:
    """At most ``most`` lines in a row, from a place that key settles."""
    spare = len(lines) - most
    return lines if spare <= 0 else lines[(at := zlib.crc32(str(key).encode()) % (spare + 1)) : at + most]


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, lines: int = 400, rounds: int = 60, rate: float = 0.15, decay: float = 1e-3, balance: float = 0.8) -> Crf:
    """Learns from at most ``most`` labelled documents, half of each label, and at most ``lines`` lines in a row of each (the bounds on what is learnt from).

    labels: doc_id, quality (0 or 1; of several the least); other rows are passed over,
    as are null and wordless texts. Those of the least hash of (doc_id, quality) are the
    sample; of rows that repeat a doc_id the one of the least text hash counts. Every line
    has its document's label, so the weights of moves are learnt from steps between like
    labels only: they say how far neighbours hold together. Documents count alike, however
    long. Labels are sampled first, so that only the sampled documents' lines move.
    """
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}

    @F.pandas_udf("array<double>")
    def flat(keys: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for k, t in zip(keys, texts, strict=True):
            own, lengths = line_features(t)
            out.append(stretch(np.concatenate((own, lengths[:, None]), axis=1), lines, k).ravel())
        return pd.Series(out)

    drawn = dice("doc_id", "quality")
    least = F.lit(-1).cast("long")
    for label, n in sizes.items():
        least = F.when(F.col("quality") == label, F.lit(below(most, n))).otherwise(least)
    first = Window.partitionBy("quality").orderBy(drawn, "doc_id")
    sample = rows.where(drawn <= least).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most // 2)
    sample = sample.select(F.col("doc_id").alias("_id"), "quality")  # at most ``most`` rows, so they may be broadcast
    texts = docs.where("text is not null").select("doc_id", "text")
    some = texts.join(F.broadcast(sample), texts["doc_id"] == sample["_id"])
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    some = some.withColumn("rank", F.row_number().over(again)).where("rank = 1")
    some = some.select("doc_id", "quality", flat("doc_id", "text").alias("x")).where(F.size("x") > 0).collect()
    docs = [(np.array(r.x).reshape(-1, N_OWN + 1)[:, :N_OWN], int(r.quality)) for r in sorted(some, key=lambda r: (r.doc_id, r.quality, r.x))]
    total = sum(sizes.values())
    default = sizes.get(1, 0) / total if total else 0.5
    w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if len({y for _, y in docs}) < 2:
        w[-1] = (-2, 2) if default >= 0.5 else (2, -2)
        return Crf(w, t, default)
    part = {y: sum(k == y for _, k in docs) for y in (0, 1)}
    data = [(with_neighbours(own), y, balance ** (1 - y) * len(docs) / 2 / part[y]) for own, y in docs]
    memory = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(rounds):
        gw, gt = decay * w * len(data), decay * t * len(data)
        for x, y, weight in data:
            p, pair, _ = chain_marginals(x @ w, t)
            k = weight / len(x)
            p[:, y] -= 1
            gw += k * (x.T @ p)
            pair[y, y] -= len(x) - 1
            gt += k * pair
        for param, grad, mem in ((w, gw / len(data), memory[0]), (t, gt / len(data), memory[1])):
            mem *= 0.9
            mem += 0.1 * grad**2
            param -= rate * (0.98**step) * grad / (np.sqrt(mem) + 1e-8)
    return Crf(w, t, default)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """docs with ``score`` (0 to 1); null, empty and wordless texts have the model's default."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in parts:
            yield pd.Series([m.score(t) for t in texts], dtype=float)

    return docs.withColumn("score", of("text"))


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 5 isn't 0 and scores every row, repeated ones alike; of an empty table none. Without labels all scores are a half or the labels' share."""
    model = fit(docs, labels.where(F.coalesce(remainder(labels, 5) != 0, F.lit(False))))
    scored = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(remainder(scored, 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
