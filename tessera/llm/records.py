"""Token ids as length-delimited binary records with masked checksums, and their index.

A record is, little-endian: payload length (8 bytes), masked CRC-32 of those 8 bytes
(4), the payload, masked CRC-32 of the payload (4), and a line feed (1). A payload is
doc_id (8, signed), a flag byte (0: null doc_id, 1: known), width of an id in bytes (1: 2 or 4) and the ids. Spark's
own committer writes the shards, so a lost task leaves no partial file. The index, a
Parquet table, gives doc_id, shard file, position, byte offset, length, number and checksum of tokens, for shuffled reads.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bounded
from .common import Workspace

END_ID = 2
MASK_DELTA = 0xA282EAD8  # fixed value of the record format's checksum masking
HEAD, FOOT = 12, 5
INDEX = "doc_id long, file string, position long, offset long, bytes long, n_tokens long, local_start long, ids_crc32 long, shard long"
LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next begins; raises ValueError on any damage."""
    size = data[at : at + 8]
    if len(size) < 8 or struct.pack("<I", masked(size)) != data[at + 8 : at + 12]:
        raise ValueError(f"damaged record length at {at}")
    end = at + HEAD + struct.unpack("<Q", size)[0]
    payload = data[at + HEAD : end]
    if data[end : end + FOOT] != struct.pack("<I", masked(payload)) + b"\n":
        raise ValueError(f"damaged record at {at}")
    return payload, end + FOOT


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is not None, width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, known, width = struct.unpack("<qBB", payload[:10])
    return doc_id if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=10)


class WordEncoder:
    """Encodes texts through the tokenizers library, each distinct word once.

    Its word pattern crosses no white space and drops it, so a text's ids are those of
    the runs between. Words of letters alone are one word of the pattern each; they go
    to the library many in a line, as the last token of a word is marked in the vocabulary.
    """

    def __init__(self, path: str, remember: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.split = re.compile("[^ \t\n\r\f\v]+").findall
        self.odd = re.compile("[\x1c-\x1f]").search  # white space to Python but not to the library

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split(text)
        text = text.lower()  # as the library does; there's nothing for it to compose in such a text
        return self.split(text) if self.odd(text) else text.split()

    def learn(self, words: list[str], line: int = 64) -> None:
        """Adds the ids of distinct words to what is known."""
        kind, width = f"<u{self.width}", self.width
        single, other = [], []
        for w in words:
            (single if LATIN(w) else other).append(w)
        for some, step in ((single, line), (other, 1)):
            for at in range(0, len(some), 20_000):
                part = some[at : at + 20_000]
                made = [e.ids for e in self.library.encode_batch_fast([" ".join(part[k : k + step]) for k in range(0, len(part), step)] if step > 1 else part, add_special_tokens=False)]
                flat = np.fromiter(chain.from_iterable(made), dtype=kind)
                ends = np.flatnonzero(self.ends[flat]) + 1 if step > 1 else np.cumsum(np.fromiter(map(len, made), dtype=np.int64, count=len(made)))
                data, ends = flat.tobytes(), (ends * width).tolist()
                self.known.update(zip(part, [data[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.remember:
            self.known.clear()
        known = self.known
        parts = [self.words(text) for text in texts]
        new = set(chain.from_iterable(parts)).difference(known)
        # letters and one mark after them are two words of the pattern
        marked = [w for w in new if w[-1] in ",.!" and w[:-1].isalpha()]
        new.difference_update(marked)
        new.update(x for w in marked for x in (w[:-1], w[-1]) if x not in known)
        self.learn(list(new))
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in marked)
        for words in parts:
            yield b"".join(map(known.__getitem__, words))


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
        gc.freeze()
        gc.set_threshold(500_000, 20, 20)
    return _loaded[path]


def frames(docs: DataFrame, path: str, end_id: int, shard_chars: int) -> DataFrame:
    """(part, piece, at, record) of every row, in the order in which rows of a partition come.

    A new piece begins each time the partition's texts have filled ``shard_chars``
    characters. A null text is empty and gives the end id alone.
    """

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        tail = end_id.to_bytes(e.width, "little")
        chars, at = 0, 0
        for part in parts:
            keys, first = part.column(0).to_pylist(), 0
            for some in bounded(x or "" for x in part.column(1).to_pylist()):
                ids = e.encode_batch(some)
                rows = [frame(pack(k, x + tail, e.width)) for k, x in zip(keys[first : first + len(some)], ids, strict=True)]
                before = chars + np.cumsum([0, *map(len, some)])
                chars = int(before[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((before[:-1] // shard_chars).astype(np.int32)), pa.array(np.arange(at, at + len(some))), pa.array(rows, type=pa.binary())], names=["piece", "at", "record"]
                )
                first, at = first + len(some), at + len(some)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "piece int, at long, record binary")
    return made.select(F.spark_partition_id().alias("part"), "piece", "at", "record")


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_chars: int = 16_000_000) -> str:
    """Writes every row of docs in ascending doc_id order (nulls first, equal ones by a hash of the text, then the text) below folder.

    Rows are dealt by ranges of (doc_id, hash), so many ids or one very common one spread
    alike; a range is sorted and encoded by one task, which cuts its output into shards of
    about ``shard_chars`` characters of text, what one task reads back. Range, piece and
    position give the order. Nothing of the table passes through the driver but its number
    of bytes. An empty table gives an empty index; other columns are passed over.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // shard_chars))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    made = frames(dealt, path, end_id, shard_chars).sortWithinPartitions("part", "piece", "at")
    # the record's own line feed is the writer's line separator; no cast changes a byte, or the checksums would tell on reading back
    lines = made.select("part", "piece", F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value"))
    lines.write.partitionBy("part", "piece").option("compression", "none").option("lineSep", "\n").text(f"{folder}/shards")
    write_index(docs.sparkSession, folder)
    return folder


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for every record, read back from the files in order with all checksums verified."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, data in zip(part["path"], part["content"], strict=True):
                at, rows, start = 0, [], 0
                while at < len(data):
                    payload, after = unframe(data, at)
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, shard, len(rows), at, after - at, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    at = after
                out = pd.DataFrame(rows, columns=["doc_id", "file", "position", "offset", "bytes", "n_tokens", "local_start", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{folder}/shards")
    number = lambda name: F.regexp_extract("file", rf"/{name}=(\d+)", 1).cast("long")
    return files.select("path", "content").mapInPandas(scan, INDEX.removesuffix(", shard long")).withColumn("shard", F.shiftleft(number("part"), 32) + number("piece"))


def write_index(spark: SparkSession, folder: str) -> None:
    scan_files(spark, folder).write.parquet(f"{folder}/index")


def read_at(wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of rows of the index (file, offset, bytes): each record alone is read from its place and its checksums verified.

    A file's records are read by one task in order of place, so it's opened once; files may
    lie in any store that pyarrow's file systems reach. No rows give none.
    """

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, stream = None, None
        for part in parts:
            keys, rows = [], []
            for file, offset, size in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if file != name:
                    if stream:
                        stream.close()
                    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", file))
                    name, stream = file, system.open_input_file(path)
                doc_id, ids = unpack(unframe(stream.read_at(size, offset), 0)[0])
                keys.append(doc_id)
                rows.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(rows, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return wanted.select("file", "offset", "bytes").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(scan, "doc_id long, ids array<int>")


def starts(index: DataFrame, block: int = 4096) -> DataFrame:
    """(shard, base): tokens of all shards before each. Sums run within blocks of shards, then over the blocks, so no task sees all shards."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ranges = totals.groupBy(F.shiftright("shard", 32).alias("part")).agg(F.sum("n").alias("of_part"))
    ranges = ranges.withColumn("block", F.floor(F.col("part") / block))
    blocks = ranges.groupBy("block").agg(F.sum("of_part").alias("of_block"))
    before_block = blocks.select("block", (F.sum("of_block").over(Window.orderBy("block")) - F.col("of_block")).alias("x"))  # a row for each ``block`` ranges
    before_part = ranges.select("part", "block", (F.sum("of_part").over(Window.partitionBy("block").orderBy("part")) - F.col("of_part")).alias("y"))
    pieces = totals.select("shard", F.shiftright("shard", 32).alias("part"), "n")
    pieces = pieces.select("shard", "part", (F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("z"))
    return pieces.join(before_part, "part").join(before_block, "block").select("shard", (F.col("x") + F.col("y") + F.col("z")).alias("base"))


def digest(docs: DataFrame) -> DataFrame:
    """Writes the files and, from their index, which is made by reading them back, gives each document's global start."""
    work = Workspace(docs.sparkSession, "records")
    folder = write(docs, work.path)
    work.keep()
    index = docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")
    return index.join(starts(index), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
