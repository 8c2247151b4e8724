"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, connected_components, shuffled, spare

SEED = 42


def fingerprint(text: str | None, size: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included.

    Words are runs without ASCII white space, ASCII capitals lowered. A text of fewer
    words than a shingle is one shingle; null or wordless texts give zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - size])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_udf():
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.fromiter(map(fingerprint, part), dtype=np.int64, count=len(part)))

    return of.asNondeterministic()  # or else a join by it would work it out twice, and a task take two Python workers


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs."""
    return docs.select("doc_id", _fingerprint_udf()("text").alias("fp"))


def block_keys(blocks: int, distance: int) -> list[list[tuple[int, int]]]:
    """Which blocks, as (first bit, width), make up each key: two fingerprints within ``distance`` bits share at least one key."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(c) for c in combinations(parts, blocks - distance)]


def spanning(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Places (a, b) of verified links that connect exactly what all pairs within the distance connect, fewer than there are fingerprints.

    First every fingerprint within the distance of a chosen one is linked to it; then
    those of different clusters are compared, small clusters first, until one is left.
    Pairs inside a cluster need no look, so copies of one text cost little.
    """
    n = len(fps)
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view(np.uint64)[0]
    left = np.argsort(np.bitwise_count(fps ^ middle), kind="stable")
    label = np.zeros(n, dtype=np.int64)
    src, dst, count = [], [], 0
    while len(left):
        near = np.bitwise_count(fps[left] ^ fps[left[0]]) <= distance
        ball = left[near]
        label[ball] = count
        src += ball[1:].tolist()
        dst += [int(ball[0])] * (len(ball) - 1)
        left = left[~near]
        count += 1
    root = np.arange(count)
    order = np.argsort(np.bincount(label, minlength=count)[label], kind="stable")
    for at in range(0, n if count > 1 else 0, 256):
        while (root != root[root]).any():
            root = root[root]
        some, rest = order[at : at + 256], order[at:]
        mine, others = root[label[some]], root[label[rest]]
        if (others == others[0]).all():
            break
        a, b = np.nonzero((np.bitwise_count(fps[some][:, None] ^ fps[rest]) <= distance) & (mine[:, None] != others))
        for k in np.unique(mine[a] * count + others[b], return_index=True)[1].tolist():
            p, q = int(mine[a[k]]), int(others[b[k]])
            while root[p] != p:
                p = int(root[p])
            while root[q] != q:
                q = int(root[q])
            if p != q:
                root[max(p, q)] = min(p, q)
                src.append(int(some[a[k]]))
                dst.append(int(rest[b[k]]))
    return src, dst


def links_of(fps: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as places, of each group of fingerprints; groups stand one after another from ``starts``, which ends in the number of all."""
    size = np.diff(starts)
    first = starts[:-1]
    src, dst = [], []
    for k, a, b in ((2, 0, 1), (3, 0, 1), (3, 0, 2), (3, 1, 2)):
        at = first[size == k]
        near = at[np.bitwise_count(fps[at + a] ^ fps[at + b]) <= distance]
        src.append(near + a)
        dst.append(near + b)
    for k in np.flatnonzero(size > 3).tolist():
        a, b = spanning(fps[first[k] : first[k] + size[k]], distance)
        src.append(np.array(a, dtype=np.int64) + first[k])
        dst.append(np.array(b, dtype=np.int64) + first[k])
    return np.concatenate(src), np.concatenate(dst)


def block_count(prints: int, distance: int, together: int) -> int:
    """The fewest blocks with which evenly spread fingerprints leave at most ``together`` to a key: more as the table grows."""
    blocks = distance + 3
    while prints >> 64 * (blocks - distance) // blocks > together and blocks < 16:
        blocks += 1
    return blocks


def near_links(prints: DataFrame, distance: int = 4, blocks: int | None = None, together: int = 4096) -> DataFrame:
    """Verified links (src, dst) whose components are those of all pairs of distinct ``fp`` within ``distance`` bits.

    Two such fingerprints agree on blocks - distance of the blocks, so they meet in the
    group of that choice of blocks, where their Hamming distance is checked. A group of
    more than ``together`` is dealt out as pairs of parts of it, so every two of it still
    meet and no task holds more than two parts. Only links that connect something leave
    a task. Nothing is broadcast.
    """
    blocks = blocks or block_count(prints.count(), distance, 64)
    coded = []
    for n, parts in enumerate(block_keys(blocks, distance)):
        code = F.lit(0).cast("long")
        for first, width in parts:
            code = F.shiftleft(code, width).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1))
        coded.append(F.struct(F.lit(n).alias("n"), code.alias("code")))
    keyed = prints.select("fp", F.explode(F.array(*coded)).alias("k")).select("fp", "k.n", "k.code")
    shared = keyed.groupBy("n", "code").agg(F.count("*").alias("m")).where("m > 1")
    held = keyed.join(shuffled(shared), ["n", "code"]).withColumn("g", F.ceil(F.col("m") / together).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("g").cast("long")).cast("int")
    dealt = held.select("fp", "n", "code", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    dealt = dealt.select("fp", "n", "code", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    where = ["n", "code", "i", "j"]

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by group; the last group of a batch may go on in the next
        rest = np.zeros((5, 0), dtype=np.int64)

        def out(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            a, b = links_of(rows[0].view(np.uint64), starts, distance)
            return pa.RecordBatch.from_arrays([pa.array(rows[0][a]), pa.array(rows[0][b])], names=["src", "dst"])

        for part in parts:
            rows = np.concatenate((rest, np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("fp", *where)])), axis=1)
            new = np.flatnonzero((rows[1:, 1:] != rows[1:, :-1]).any(axis=0)) + 1
            if len(new):
                yield out(np.ascontiguousarray(rows[:, : new[-1]]), np.concatenate(([0], new)))
                rest = rows[:, new[-1] :].copy()
            else:
                rest = rows
        if rest.shape[1]:
            yield out(np.ascontiguousarray(rest), np.array([0, rest.shape[1]]))

    return dealt.repartition(*where).sortWithinPartitions(*where).mapInArrow(scan, "src long, dst long").distinct()


def components(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id, root): component_id is the smallest doc_id reachable over links, root the component's least fingerprint.

    Equal fingerprints are one class, whatever the number of copies; only classes
    are compared. Null and wordless texts have fingerprint zero and link like any
    other; repeated doc_ids are rows of their own; rows without doc_id are kept and
    have no part in a component's id unless all of its rows lack one (then null).
    """
    work = Workspace(docs.sparkSession, "simhash")
    prints = work.save(fingerprints(docs), "prints")
    classes = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = connected_components(near_links(classes.select("fp"), distance))
    roots = classes.join(shuffled(linked), classes.fp == linked.id, "left").select("fp", F.coalesce("component", "fp").alias("root"), "first")
    roots = work.save(roots, "roots")
    firsts = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(shuffled(firsts), "root").select("fp", "component_id", "root")
    return prints.join(shuffled(named), "fp").select("doc_id", "fp", "component_id", "root")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns, a row for each row of ``components``; a null doc_id stays null."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4) -> DataFrame:
    """Rows of docs less all but the first (least doc_id) of each component.

    Rows that repeat a doc_id and a component are one document, of which the row of the
    least (fingerprint, text) stays. Rows without a doc_id are dropped where another of
    their component has one, else one stays. An empty table gives none; other columns are kept.
    """
    work = Workspace(docs.sparkSession, "keep-one")
    found = work.save(components(docs, distance), "found")
    mine, first, rank, key = (spare(docs, c) for c in ("fp", "root", "rank", "key"))
    lone = found.where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias(key), F.col("fp").alias(mine), F.col("root").alias(first)).distinct()
    several = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.bool_or(F.expr("doc_id = component_id")).alias("stays")).where("stays")
    # documents with one fingerprint need no second look at it
    plain = docs.join(shuffled(several.where("low = high").select(key)), docs["doc_id"] == F.col(key))
    named = plain.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy("text"))).where(F.col(rank) == 1).select(*docs.columns)
    mixed = docs.join(shuffled(several.where("low < high").select(key)), docs["doc_id"] == F.col(key), "left_semi")
    mixed = mixed.unionByName(docs.where("doc_id is null")).withColumn(mine, _fingerprint_udf()("text"))
    mixed = mixed.join(shuffled(lone), [mixed[mine] == lone[mine], mixed["doc_id"].eqNullSafe(lone[key])]).drop(lone[mine])
    best = Window.partitionBy("doc_id", first).orderBy(mine, "text")
    return named.unionByName(mixed.withColumn(rank, F.row_number().over(best)).where(F.col(rank) == 1).select(*docs.columns))
