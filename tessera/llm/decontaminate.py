"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all passages counts document frequencies of the benchmark's terms and
   sums a randomised sketch of the TF-IDF matrix; single-pass (Nystrom) eigenvectors of
   it are the right singular vectors. Only terms of the benchmark have columns, since
   no other term can add to a cosine with an item.
2. A second pass folds overlapping passages into the latent space, its axes evened by
   the roots of their singular values, and takes those near a part of an item by cosine.
3. The longest common subsequence of an item and the text about a candidate, and how
   much of the item's rarest terms ("the answer") occurs there, decide.

Items too short for a passage's direction to tell are looked for token by token besides:
those of fewer than ``Rules.brief`` tokens anywhere, those of fewer than ``Rules.least``
only as a whole line or text, for a word or two inside a sentence is no leak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, spare

TOKEN = re.compile(r"\w+")
MATCH = "array<struct<item_id: long, cosine: double, lcs: double, answer: double>>"
#: ASCII signs that part words, as blanks; and characters for which the faster way below isn't that of TOKEN.
PARTING = bytes(c if chr(c).isalnum() or c == 95 or c > 127 else 32 for c in range(256))
ODD = re.compile("[\x80-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]|[^\x00-ɏ]").search
#: Odd multipliers that spread (item, term) over the table of ``may_have``.
SPREAD = (0x9E3779B1, 0x85EBCA77)


@dataclass
class Rules:
    window: int = 32  # tokens of a passage
    stride: int = 8  # divides the window
    rank: int = 128
    cosine: float = 0.45  # of a candidate
    mass: float = 0.45  # share of the part's length that a candidate has in its direction
    lcs: float = 0.7  # share of an item in common order that decides alone
    paraphrase: float = 0.5  # share that decides together with the answer
    answer: float = 0.75  # share of the item's rarest terms
    least: int = 5  # fewer tokens than that: only whole lines or texts
    brief: int = 8  # fewer tokens than that: equal tokens in a row as well as the search
    seed: int = 11


def tokens(text: str | None) -> list[bytes]:
    """Runs of word characters of the lower-cased text, in UTF-8."""
    if not text:
        return []
    low = text.lower()
    if ODD(low):
        return [w.encode("utf-8", "replace") for w in TOKEN.findall(low)]
    return low.encode().translate(PARTING).split()


@dataclass
class Index:
    """Items, their terms and the latent space; its size follows the slice of the benchmark it holds."""

    rules: Rules
    ids: list[int]
    words: list[list[bytes]]
    vocabulary: dict[bytes, int]
    space: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), dtype=np.float32))  # term x rank, last row zero
    parts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), dtype=np.float32))  # unit vectors of parts of items
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.float32))  # of parts before they were made unit vectors
    item_of: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # of each part
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # first token of each part in its item
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # tokens of each item
    may_have: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=bool))  # by a hash of item and term; never false for a term of the item
    masks: list[dict[int, int]] = field(default_factory=list)
    answers: list[frozenset[int]] = field(default_factory=list)
    lines: dict[bytes, list[int]] = field(default_factory=dict)  # ids of the shortest items by their tokens
    rows: dict[int, list[tuple[np.ndarray, int]]] = field(default_factory=dict)  # brief items by first term: terms, id

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(len(self.vocabulary))), dtype=np.int32, count=len(words))

    def cell(self, items: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Where ``may_have`` keeps the pairs; both given as ``mixed`` gives them."""
        return (items + terms) >> np.uint32(32 - (len(self.may_have).bit_length() - 1))


def mixed(numbers: np.ndarray, which: int) -> np.ndarray:
    return numbers.astype(np.uint32) * np.uint32(SPREAD[which])


def lcs_length(masks: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits of an integer."""
    full = (1 << size) - 1
    row = full
    for w in words:
        if m := masks.get(w):
            both = row & m
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def start_index(items: list, rules: Rules) -> Index:
    """items: rows of item_id and text; those without id or token have nothing to find."""
    every = sorted((r.item_id, tokens(r.text)) for r in items if r.item_id is not None)
    kept = [(i, w) for i, w in every if len(w) >= rules.least]
    vocabulary: dict[bytes, int] = {}
    for _, words in kept:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    index = Index(rules, [i for i, _ in kept], [w for _, w in kept], vocabulary)
    for i, words in every:
        if 0 < len(words) < rules.least:
            index.lines.setdefault(b" ".join(words), []).append(i)
        elif words and len(words) < rules.brief:
            n = index.numbers(words)
            index.rows.setdefault(int(n[0]), []).append((n, i))
    return index


def batches(index: Index, texts: list, most: int = 60_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, terms, starts, ends): texts laid out one after another as term numbers.

    Each begins at a multiple of the window and ends in at least a window of blanks; starts and ends are its tokens'.
    """
    none, w = len(index.vocabulary), index.rules.window
    at, first = 0, 0
    parts, starts, ends = [], [], []
    for k, text in enumerate(texts):
        n = index.numbers(tokens(text))
        room = (len(n) + w - 1) // w * w + w
        part = np.full(room, none, dtype=np.int32)
        part[: len(n)] = n
        parts.append(part)
        starts.append(at)
        ends.append(at + len(n))
        at += room
        if at >= most or k == len(texts) - 1:
            yield first, np.concatenate(parts), np.array(starts), np.array(ends)
            at, first, parts, starts, ends = 0, k + 1, [], [], []


def sum_of(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each line of row numbers, the sum of those vectors."""
    out = vectors[rows[:, 0]]
    for j in range(1, rows.shape[1]):
        out += vectors[rows[:, j]]
    return out


class Sketch:
    """Running sums over passages: how many hold each term, and T'T times the test matrix; T counts terms of passages."""

    def __init__(self, index: Index, omega: np.ndarray):
        self.index, self.omega = index, np.concatenate((omega, np.zeros((1, omega.shape[1]), dtype=np.float32)))
        self.df, self.z, self.passages = np.zeros(len(omega), dtype=np.int64), np.zeros(omega.shape), 0

    def add(self, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        none, w = len(self.df), self.index.rules.window
        self.passages += int((-(-(ends - starts) // w)).sum())
        where = np.flatnonzero(terms < none)
        if not len(where):
            return
        sums = np.concatenate((sum_of(self.omega, terms.reshape(-1, w)), np.zeros((1, self.z.shape[1]), dtype=np.float32)))
        t = terms[where]
        order = np.argsort(t, kind="stable")
        ts, rows = t[order], where[order] // w
        new = np.concatenate(([True], ts[1:] != ts[:-1]))
        heads = np.flatnonzero(new)
        # the passages of each term, in lines of w, the last one filled up with the passage of zeros
        counts = np.diff(heads, append=len(ts))
        lines = -(-counts // w)
        first = np.cumsum(lines) - lines
        group = np.repeat(np.arange(len(heads)), counts)
        within = np.arange(len(ts)) - heads[group]
        dealt = np.full(int(lines.sum()) * w, len(sums) - 1)
        dealt[first[group] * w + within] = rows
        self.z[ts[heads]] += np.add.reduceat(sum_of(sums, dealt.reshape(-1, w)), first, axis=0)
        new[1:] |= rows[1:] != rows[:-1]
        self.df += np.bincount(ts[new], minlength=none)


def sketch(docs: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(document frequency, T'T Omega, passages, Omega) over all passages of all texts."""
    spark, size, rank = docs.sparkSession, len(index.vocabulary), index.rules.rank
    omega = np.random.default_rng(index.rules.seed).standard_normal((size, rank)).astype(np.float32)
    shared = spark.sparkContext.broadcast((index, omega))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = Sketch(*shared.value)
        for part in parts:
            for _, *batch in batches(sums.index, part["text"].to_list()):
                sums.add(*batch)
        out = pd.DataFrame({"term": np.arange(-1, len(sums.df)), "df": np.concatenate(([sums.passages], sums.df))})
        z = pd.DataFrame(np.concatenate((np.zeros((1, rank)), sums.z)), columns=[f"z{k}" for k in range(rank)])
        yield pd.concat((out, z), axis=1)[(out["df"] > 0) | (out["term"] < 0)]

    kinds = "term long, df long, " + ", ".join(f"z{k} double" for k in range(rank))
    rows = docs.select("text").mapInPandas(scan, kinds).groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(f"z{k}").alias(f"z{k}") for k in range(rank)]).toArrow()  # a row for each term of the index, as columns of numbers
    shared.destroy()
    term, count = rows.column("term").to_numpy(), rows.column("df").to_numpy()
    of_term = term >= 0
    df, z = np.zeros(size), np.zeros((size, rank))
    df[term[of_term]] = count[of_term]
    for k in range(rank):
        z[term[of_term], k] = rows.column(f"z{k}").to_numpy()[of_term]
    return df, z, int(count[~of_term].sum()), omega


def finish_index(index: Index, df: np.ndarray, z: np.ndarray, passages: int, omega: np.ndarray) -> Index:
    rules = index.rules
    idf = np.log((passages + 1) / (df + 1)) + 1e-3
    y = idf[:, None] * z  # A'A times the test matrix, of A = T idf
    test = omega / idf[:, None]
    core = test.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(initial=0) * 1e-10, 1e-12)
    half = y @ (vector[:, good] / np.sqrt(value[good]))
    if half.size:
        right, singular, _ = np.linalg.svd(half, full_matrices=False)
    else:  # no passage holds any term
        right, singular = np.eye(len(df), rules.rank), np.ones(min(len(df), rules.rank))
        right = right[:, : len(singular)]
    space = idf[:, None] * right / np.sqrt(singular + 1e-6 * singular.max(initial=1))
    index.space = np.concatenate((space, np.zeros((1, space.shape[1])))).astype(np.float32)
    parts, places = [], []
    pairs = sum(len(set(words)) for words in index.words)
    index.may_have = np.zeros(1 << max(10, (16 * pairs).bit_length()), dtype=bool)
    for k, words in enumerate(index.words):
        n = index.numbers(words)
        index.may_have[index.cell(mixed(np.array([k]), 0), mixed(np.unique(n), 1))] = True
        for at in range(0, max(1, len(n) - rules.window // 2), rules.window // 2):
            parts.append(index.space[n[at : at + rules.window]].sum(axis=0))
            places.append((k, at))
        masks: dict[int, int] = {}
        for p, w in enumerate(n.tolist()):
            masks[w] = masks.get(w, 0) | 1 << p
        index.masks.append(masks)
        rare = sorted(masks, key=lambda w: (-idf[w], w))
        index.answers.append(frozenset(rare[: max(2, len(rare) // 4)]))
    every = np.array(parts, dtype=np.float32).reshape(len(parts), index.space.shape[1])
    index.lengths = np.maximum(np.linalg.norm(every, axis=1), 1e-12).astype(np.float32)
    index.parts = every / index.lengths[:, None]
    index.item_of, index.offset = np.array(places, dtype=np.int64).reshape(-1, 2).T
    index.sizes = np.array([len(w) for w in index.words], dtype=np.int64)
    return index


def candidates(index: Index, terms: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start of the item if it stands there, cosine) of the passages near a part of an item; each pair once."""
    rules, none = index.rules, len(index.vocabulary)
    blocks = terms.reshape(-1, rules.stride)
    span = rules.window // rules.stride
    least = rules.mass * index.lengths.min()
    found = []
    for at in range(0, len(blocks) - span + 1, at_once):
        sums = sum_of(index.space, blocks[at : at + at_once + span - 1])
        v = sums[: len(sums) - span + 1].copy()
        for j in range(1, span):
            v += sums[j : len(sums) - span + 1 + j]
        size = np.sqrt(np.einsum("ij,ij->i", v, v))
        long = np.flatnonzero(size >= least)  # a passage shorter than that can't have the mass of any part
        if not len(long):
            continue
        cosine = (v[long] / size[long, None]) @ index.parts.T
        hit = np.flatnonzero(cosine >= rules.cosine)
        row, part = np.divmod(hit, len(index.parts))
        value = cosine.ravel()[hit]
        heavy = value * size[long][row] >= rules.mass * index.lengths[part]
        row, part = long[row[heavy]], part[heavy]
        found.append((index.item_of[part], (row + at) * rules.stride - index.offset[part], value[heavy]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    item, start, value = (np.concatenate(x) for x in zip(*found, strict=True))
    low = start.min(initial=0)
    key = item * (len(terms) - low + 1) + start - low
    order = np.lexsort((-value, key))
    first = order[np.concatenate(([True], np.diff(key[order]) != 0))] if len(order) else order
    return item[first], start[first], value[first]


def equal_rows(index: Index, terms: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
    """(text, item_id) of the brief items whose terms stand in a row."""
    out = set()
    heads = np.zeros(len(index.vocabulary) + 1, dtype=bool)
    heads[list(index.rows)] = True
    for at in np.flatnonzero(heads[terms]).tolist():
        for n, item in index.rows[int(terms[at])]:
            if np.array_equal(terms[at : at + len(n)], n):
                out.add((int(np.searchsorted(starts, at, "right")) - 1, item))
    return out


def search(index: Index, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
    """(item_id, cosine, lcs, answer) of each item in each whole text, the best place of each; items found token by token have three ones."""
    out = near_items(index, texts) if index.ids else [[] for _ in texts]
    exact: list[set[int]] = [set() for _ in texts]
    if index.rows:
        for base, terms, starts, _ in batches(index, texts):
            for k, item in equal_rows(index, terms, starts):
                exact[base + k].add(item)
    if index.lines:
        for k, text in enumerate(texts):
            for part in {text, *text.splitlines()} if text else ():
                exact[k].update(index.lines.get(b" ".join(tokens(part)), ()))
    for k, items in enumerate(exact):
        items.difference_update(m[0] for m in out[k])
        out[k] = sorted([*out[k], *((i, 1.0, 1.0, 1.0) for i in items)])
    return out


def near_items(index: Index, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
    """The items found by cosine, common subsequence and rarest terms."""
    out: list[list] = [[] for _ in texts]
    rules, none = index.rules, len(index.vocabulary)
    for base, terms, starts, ends in batches(index, texts):
        item, start, cosine = candidates(index, terms)
        if not len(item):
            continue
        size = index.sizes[item]
        doc = np.clip(np.searchsorted(starts, start + size // 2, "right") - 1, 0, len(starts) - 1)
        a = np.maximum(starts[doc], start - rules.stride)
        b = np.minimum(ends[doc], start + size + size // 4 + rules.stride)
        # no common subsequence is longer than the number of tokens there that the item has at all
        width = max(1, int((b - a).max(initial=0)))
        known = np.concatenate((terms < none, np.zeros(width, dtype=bool)))
        runs = np.lib.stride_tricks.sliding_window_view(np.concatenate((mixed(terms, 1), np.zeros(width, dtype=np.uint32))), width)
        knowns = np.lib.stride_tricks.sliding_window_view(known, width)
        within = (np.arange(width) < np.arange(width + 1)[:, None]).astype(bool)
        of_item = mixed(item, 0)
        fit = np.zeros(len(item), dtype=bool)
        for at in range(0, len(item), step := max(1, 100_000 // width)):
            s = slice(at, at + step)
            has = index.may_have[index.cell(of_item[s, None], runs[a[s]])]
            has &= knowns[a[s]]
            has &= within[np.maximum(b[s] - a[s], 0)]
            fit[s] = np.count_nonzero(has, axis=1) >= rules.paraphrase * size[s]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for n in np.flatnonzero(fit).tolist():
            k, d = int(item[n]), int(doc[n])
            masks, answers, count = index.masks[k], index.answers[k], int(size[n])
            some = [w for w in terms[a[n] : b[n]].tolist() if w in masks]
            if len(some) < rules.paraphrase * count:
                continue
            kinds = set(some)
            answer = len(answers & kinds) / len(answers)
            # nor longer than the places of the item that hold a token there
            if sum(map(int.bit_count, map(masks.__getitem__, kinds))) < (rules.paraphrase if answer >= rules.answer else rules.lcs) * count:
                continue
            share = lcs_length(masks, count, some) / count
            if (share >= rules.lcs or (share >= rules.paraphrase and answer >= rules.answer)) and ((d, k) not in best or best[d, k][1] < share):
                best[d, k] = (float(cosine[n]), share, answer)
        for (d, k), v in sorted(best.items()):
            out[base + d].append((index.ids[k], *v))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, rules: Rules | None = None, slice_chars: int = 2_000_000, name: str = "matches") -> DataFrame:
    """docs with a column ``name`` (one of that name is replaced): the items found in each text, an empty array where there are none.

    The benchmark is searched in slices of at most about ``slice_chars`` characters (by
    item_id), one after the other, which bounds what the driver gathers and what a task and
    its one Python worker hold; each slice adds two passes over the texts, so time grows with
    documents times benchmark. What is found in a slice is written by the texts' digests,
    and met by them again after the last; where one slice is all, nothing need be written.
    Null and empty texts match nothing, nor does anything match a null item or one without
    a word. Repeated rows are matched alike; items of equal text are all found, and rows
    that repeat an item_id give it once for each. Of places alike the first counts.
    """
    rules = rules or Rules()
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_chars))
    none = F.array().cast(MATCH)
    work, found = Workspace(spark, "decontamination"), []
    digests = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    for k in range(slices):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k) if slices > 1 else benchmark
        index = start_index(mine.select("item_id", "text").collect(), rules)
        if index.ids:
            index = finish_index(index, *sketch(docs, index))
        if not index.ids and not index.lines:
            continue
        shared = spark.sparkContext.broadcast(index)
        if slices == 1:
            return docs.withColumn(name, _search_udf(shared)("text"))
        seen = docs.where("text is not null").select(*[v.alias(c) for c, v in digests.items()], _search_udf(shared)("text").alias("m")).where(F.size("m") > 0)
        found.append(work.save(seen.groupBy("h1", "h2").agg(F.first("m").alias("m")), f"slice-{k}"))
        shared.destroy()
    if not found:
        return docs.withColumn(name, none)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = work.save(every.groupBy("h1", "h2").agg(F.sort_array(F.flatten(F.collect_list("m"))).alias("m")), "found")
    keys = {c: spare(docs, c) for c in (*digests, "m")}
    named = every.withColumnsRenamed(keys)
    both = docs.join(named, (F.xxhash64(docs["text"]) == named[keys["h1"]]) & (F.xxhash64(F.lit(1), docs["text"]) == named[keys["h2"]]), "left")
    return both.withColumn(name, F.coalesce(keys["m"], none)).select(*[c for c in docs.columns if c != name], name)


def _search_udf(shared):
    @F.pandas_udf(MATCH)
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for texts in parts:
            yield pd.Series([[dict(zip(("item_id", "cosine", "lcs", "answer"), m, strict=True)) for m in ms] for ms in search(index, texts.to_list())], dtype=object)

    return of.asNondeterministic()  # or else Spark would search once more for the condition that it infers from explode


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item found in it, with its cosine, share of common subsequence and of rarest terms."""
    found = matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", F.round("m.cosine", 4).alias("cosine"), F.round("m.lcs", 4).alias("lcs"), F.round("m.answer", 4).alias("answer"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs whose text holds no item, with the columns of docs."""
    name = spare(docs, "matches")
    return matches(docs, benchmark, name=name).where(F.size(name) == 0).select(*docs.columns)
