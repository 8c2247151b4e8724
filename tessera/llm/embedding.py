"""Embedding near-duplicates: sign hashing in several tables, exact cosine, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, connected_components, shuffled


def plan(rows: int, threshold: float, recall: float = 0.995, bucket: int = 1024) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` rows, and so many tables that a pair at the threshold shares one with probability ``recall``.

    Comparing within a bucket is one matrix product, so large buckets and few tables cost
    less than the reverse: every table ships every vector once.
    """
    bits = max(6, round(math.log2(max(2, rows) / bucket)))
    same = 1 - math.acos(threshold) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
    return bits, tables


def signs(x: np.ndarray, bits: int, tables: int, seed: int = 20) -> np.ndarray:
    """Whether each row lies above each random hyperplane: row x table x bit."""
    planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], bits * tables))
    return (x @ planes > 0).reshape(len(x), tables, bits)


def codes_of(above: np.ndarray) -> np.ndarray:
    """The signs of each row and table as one number."""
    return (above * (1 << np.arange(above.shape[2], dtype=np.int64))).sum(axis=2)


def links_within(x: np.ndarray, weights: np.ndarray, codes: np.ndarray, table: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one bucket: (row, n, root row), n the weight of the links first found in this table, root a spanning link's other end.

    A pair counts in the first table in which it shares a code, so it counts once.
    Rows of unit vectors x; with ``side`` only pairs of different sides count.
    """
    n = len(x)
    total = np.zeros(n, dtype=np.int64)
    root = np.arange(n)

    def top(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for at in range(0, n, 512):
        a, b = np.nonzero(x[at : at + 512] @ x[at:].T >= threshold)
        fits = a < b
        a, b = a[fits] + at, b[fits] + at
        if side is not None:
            fits = side[a] != side[b]
            a, b = a[fits], b[fits]
        if table and len(a):
            new = np.ones(len(a), dtype=bool)
            for part in range(0, len(a), 100_000):
                s = slice(part, part + 100_000)
                new[s] = ~(codes[a[s], :table] == codes[b[s], :table]).any(axis=1)
            a, b = a[new], b[new]
        np.add.at(total, a, weights[b])
        np.add.at(total, b, weights[a])
        if len(a):  # of the links between two trees one is enough
            tops = np.array([top(k) for k in range(n)])
            for k in np.unique(tops[a] * n + tops[b], return_index=True)[1].tolist():
                p, q = top(int(a[k])), top(int(b[k]))
                if p != q:
                    root[max(p, q)] = min(p, q)
    hit = np.flatnonzero(total)
    return hit, total[hit], np.array([top(int(k)) for k in hit], dtype=np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; of very large or small components only the direction matters."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, crowded: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id long, embedding array<float or double>).

    Equal vectors are one class, known by 128 bits of hashes. Classes meet in buckets of
    equal sign codes; a bucket of more than ``crowded`` classes is dealt out as pairs of
    parts of it, so no task holds a large group and pairs never leave the task that finds
    them, only counts and spanning links do. Vectors travel as they are stored, with their
    signs as single bits. Vectors that are null, empty, zero or hold null or non-finite
    parts link with nothing; nor do vectors of different lengths. Rows that repeat a
    vec_id are rows of their own; a null vec_id takes no part in ids of components.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "embedding")
    kept = vectors.schema["embedding"].dataType
    kept = kept if isinstance(kept, T.ArrayType) and isinstance(kept.elementType, (T.FloatType, T.DoubleType)) else T.ArrayType(T.DoubleType())
    e = vectors.select("vec_id", F.col("embedding").cast(kept).alias("v"))
    odd = F.expr("exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    usable = F.coalesce((F.size("v") > 0) & ~odd & F.expr("exists(v, x -> x <> 0)"), F.lit(False))
    v0 = F.expr("transform(v, x -> x + 0)")  # minus zero is zero
    e = e.select("vec_id", F.when(usable, v0.cast(kept)).alias("v")).select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), F.reverse("v"))).alias("k"))
    ids = e.where("h is not null").groupBy("h", "k").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # h alone names a class in what follows; where two classes share it, one of them is named by the other hash
    classes = work.save(ids, "classes")
    twice = classes.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("least")).where("n > 1")
    classes = classes.join(twice.select(F.col("h").alias("h2"), "least"), F.col("h") == F.col("h2"), "left")
    classes = classes.withColumn("id", F.when(F.col("h2").isNull() | (F.col("k") == F.col("least")), F.col("h")).otherwise(F.col("k"))).drop("h2", "least")
    bits, tables = plan(work.spark.read.parquet(f"{work.path}/classes").count(), threshold)

    @F.pandas_udf("codes array<long>, signs binary")
    def coded_as(vs: pd.Series) -> pd.DataFrame:
        codes, packed = [None] * len(vs), [None] * len(vs)
        sizes = vs.map(len)
        for size in sizes.unique():
            at = np.flatnonzero(sizes == size)
            above = signs(unit(np.stack(vs.iloc[at].to_list())), bits, tables)
            for k, c, p in zip(at, codes_of(above), np.packbits(above.reshape(len(at), -1), axis=1), strict=True):
                codes[k], packed[k] = c, p.tobytes()
        return pd.DataFrame({"codes": codes, "signs": packed})

    coded = work.save(classes.select("id", F.col("copies").alias("w"), "v", coded_as("v").alias("c")).select("id", "w", "v", "c.codes", "c.signs"), "coded")
    spots = coded.select("id", F.size("v").alias("size"), F.posexplode("codes").alias("table", "code"))
    full = spots.groupBy("size", "table", "code").agg(F.count("*").alias("m")).where("m > 1")
    held = spots.join(shuffled(full), ["size", "table", "code"]).select("id", "table", "code", "size", F.ceil(F.col("m") / crowded).cast("int").alias("g"))
    mine = F.pmod(F.col("id"), F.col("g").cast("long")).cast("int")
    dealt = held.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("id", "table", "code", "size", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    where = ["size", "table", "code", "i", "j"]
    rows = dealt.join(coded.select("id", "w", "v", "signs"), "id").select("id", "w", "v", "signs", "mine", *where)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by bucket; one bucket's pair of parts is held at a time
        held: list[pa.RecordBatch] = []
        now = None

        def solve() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: part.column(name).chunk(0)
            ids, size, table = column("id").to_numpy(), now[0], now[1]
            x = unit(column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size))
            packed = np.frombuffer(b"".join(column("signs").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            codes = codes_of(np.unpackbits(packed, axis=1)[:, : bits * table].reshape(len(ids), table, bits)) if table else None
            side = column("mine").to_numpy() if now[3] != now[4] else None
            at, n, root = links_within(x, column("w").to_numpy(), codes, table, side, threshold)
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n), pa.array(ids[root])], names=["id", "n", "root"])

        for part in parts:
            keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in where])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != now and held:
                    yield solve()
                    held = []
                now = key
                held.append(part.slice(a, b - a))
        if held:
            yield solve()

    found = rows.repartition(*where).sortWithinPartitions(*where).mapInArrow(scan, "id long, n long, root long")
    found = work.save(found, "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    linked = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    named = (
        classes.join(counts, "id", "left")
        .join(linked, "id", "left")
        .select("h", "k", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("root"))
    )
    named = work.save(named, "named")
    work.drop("coded")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    out = e.select("vec_id", "h", "k").join(named.join(least, "root").select("h", "k", "n_links", "component_id"), ["h", "k"], "left")
    component = F.when(F.col("h").isNotNull(), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
