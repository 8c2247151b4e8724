"""Exact top-k search by inner product: term-at-a-time accumulation over all rows.

Vectors become sparse rows of integers. Candidates are dealt into slices, queries into
blocks, and each pair of the two is one task's work: it holds the block, takes the slice's
rows by the thousand, inverts them into postings, and for every term adds the products of
its postings and of the block's entries into an array of scores. The best of each slice
are chosen by partition and merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

NONE = np.iinfo(np.int64).max  # stands for a null vec_id, which comes after all others


def entries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the parts of the batch's vectors that aren't zero, by term, then row."""
    v = part.column("v")
    sizes = np.diff(v.offsets.to_numpy())
    row = np.repeat(np.arange(part.num_rows), sizes)
    term = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    weight = v.flatten().to_numpy().astype(np.int64)
    at = np.flatnonzero(weight)
    at = at[np.argsort(term[at], kind="stable")]
    return row[at], term[at], weight[at]


def postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """By term: the rows that have it and their weights; where most rows have it, None and a weight for every row."""
    terms, starts = np.unique(term, return_index=True)
    out: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
    for t, a, b in zip(terms, starts, [*starts[1:], len(term)], strict=True):
        if 2 * (b - a) > rows:
            every = np.zeros(rows, dtype=np.int64)
            every[row[a:b]] = weight[a:b]
            out[int(t)] = (None, every)
        else:
            out[int(t)] = (row[a:b], weight[a:b])
    return out


def scored(index: dict, rows: int, queries: dict, width: int) -> np.ndarray:
    """The scores of every (query, row): term by term, each query's weight times each posting's. Short integers where they can't overflow."""
    most = lambda x: np.abs(x.astype(np.float64)).max()
    peak = sum(most(index[t][1]) * most(queries[t][1]) for t in queries if t in index)
    kind = np.int32 if peak < 2**31 else np.int64
    score, products = np.zeros((width, rows), dtype=kind), np.empty((width, rows), dtype=kind)
    for t, (asked, w) in queries.items():
        if t not in index:
            continue
        held, x = index[t]
        w, x = w.astype(kind)[:, None], x.astype(kind)[None, :]
        if asked is None and held is None:
            np.multiply(w, x, out=products)
            score += products
        elif held is None:
            score[asked] += w * x
        elif asked is None:
            score[:, held] += w * x
        else:
            score[np.ix_(asked, held)] += w * x
    return score


class Best:
    """The best rows of each query of a block so far, with one more than asked, as its own row may be among them."""

    def __init__(self, block: pa.Table, k: int, together: int = 128):
        self.k, self.size = k, block.num_rows
        self.query = block.column("vec_id").to_numpy()
        self.block = block
        self.groups = []
        for at in range(0, self.size, together):
            part = block.slice(at, together).combine_chunks().to_batches()[0]
            self.groups.append((at, part.num_rows, postings(*entries(part), part.num_rows)))
        self.low = np.full(self.size, np.iinfo(np.int64).min)
        self.held = [np.empty(0, dtype=np.int64) for _ in range(4)]  # query, score, vec_id, copies

    def add(self, part: pa.RecordBatch) -> None:
        n = part.num_rows
        index = postings(*entries(part), n)
        ids, copies = part.column("vec_id").to_numpy(), part.column("n").to_numpy()
        found = []
        for at, width, queries in self.groups:
            score = scored(index, n, queries, width)
            low = self.low[at : at + width]
            above = score >= low[:, None]
            if n > self.k and np.count_nonzero(above) > 2 * self.k * width:
                above = score >= np.maximum(low, np.partition(score, n - self.k - 1)[:, n - self.k - 1])[:, None]
            q, hit = np.nonzero(above)
            found.append((q + at, score[q, hit].astype(np.int64), hit))
        q, s, hit = (np.concatenate(x) for x in zip(*found, strict=True))
        c = copies[hit].copy()
        for k in np.flatnonzero((self.query[q] == ids[hit]) & (ids[hit] != NONE)):  # a query's own row is left out once
            if part.column("v")[int(hit[k])].as_py() == self.block.column("v")[int(q[k])].as_py():
                c[k] -= 1
        there = c > 0
        self.held = [np.concatenate(x) for x in zip(self.held, (q[there], s[there], ids[hit][there], c[there]), strict=True)]
        self.cut()

    def cut(self) -> None:
        q, s, ids, c = self.held
        order = np.lexsort((c, ids, -s, q))
        q, s, ids, c = q[order], s[order], ids[order], c[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        stay = rank < self.k
        self.held = [x[stay] for x in (q, s, ids, c)]
        last = rank == self.k - 1
        self.low[q[last]] = s[last]

    def rows(self) -> pa.RecordBatch:
        q, s, ids, c = self.held
        made = [pa.array(self.query[q]), self.block.column("h").take(pa.array(q)).combine_chunks(), pa.array(ids, mask=ids == NONE), pa.array(s), pa.array(c)]
        return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in made], names=["query_id", "h", "vec_id", "score", "n"])


def search(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, block: int = 8192, slice_rows: int = 65_536, least_slices: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose vec_id is divisible by ``every``, the ``k`` rows of largest inner product, ties to the smaller vec_id.

    A part x counts as floor(scale * x), x as double. Vectors that are null or hold null or
    non-finite parts take no part; empty and zero ones score 0, and of vectors of different
    lengths the shorter counts as having zeros. Every row but the query's own is a candidate,
    also one that repeats its vec_id; equal rows of one vec_id are one query, and candidates as
    often as they stand. Rows without vec_id are candidates that come last among ties. Scores
    are 64-bit integers: floors beyond them are held at their ends, sums beyond them wrap.
    Equal rows are counted before anything is dealt; rows are dealt by hashes of id and vector,
    so slices are even, and a task holds a block of queries and a batch of a slice. Candidates
    are shipped once a block of queries, queries once a slice.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    usable = "v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable)
    ints = v.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NONE)).alias("vec_id"), F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = work.save(ints.groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("v")), "rows")
    asked = rows.where((F.col("vec_id") != NONE) & (F.col("vec_id") % every == 0))
    n, m = rows.count(), asked.count()
    blocks, slices = max(1, -(-m // block)), max(least_slices, -(-n // slice_rows))
    mine = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "h"), F.lit(parts)).cast("int")
    queries = asked.select("vec_id", "v", "n", "h", mine(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"))
    held = rows.select("vec_id", "v", "n", "h", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), mine(slices, 2).alias("slice"), F.lit(1).alias("kind"))
    where = ["block", "slice"]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by block and slice, queries before candidates
        now, waiting, best = None, [], None
        for part in parts:
            keys = np.stack([part.column(c).to_numpy() for c in (*where, "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key, kind = tuple(keys[:2, a].tolist()), keys[2, a]
                if key != now:
                    if best:
                        yield best.rows()
                    now, waiting, best = key, [], None
                if kind == 0:
                    waiting.append(part.slice(a, b - a))
                    continue
                if best is None and waiting:
                    best, waiting = Best(pa.Table.from_batches(waiting).combine_chunks(), k), []
                if best:
                    for at in range(a, b, 1024):
                        best.add(part.slice(at, min(1024, b - at)))
        if best:
            yield best.rows()

    dealt = queries.unionByName(held).repartition(*where).sortWithinPartitions(*where, "kind")
    found = work.save(dealt.mapInArrow(scan, "query_id long, h long, vec_id long, score long, n long"), "found")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "n")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = found.withColumn("before", before).where(F.col("before") < k)
    ranks = F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k)))
    out = ranked.select("query_id", F.explode(ranks).alias("rank"), "vec_id", "score")
    return out.withColumn("rank", F.col("rank").cast("int"))
