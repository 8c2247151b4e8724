"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a prefix ends in one token; what stands before it is the encoding of
the shorter prefix. So a trie node needs only its last token: the one vocabulary
suffix of its bytes that forms, with the last token of the node where it begins, a
pair that BPE leaves apart. The trie of a batch's distinct words is kept as the
sorted words with the length each shares with the one before: visiting them in order
is the depth-first walk, and states of a shared prefix are computed once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class TrieBpe:
    def __init__(self, path: str, remember: int = 300_000, remember_chars: int = 3_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): (n, self.ids[raw(a + b)]) for n, (a, b) in enumerate(merges)}
        self.made_of = {whole: (n, *pair) for pair, (n, whole) in self.rank.items() if self.merge([self.ids[b] for b in map(bytes, zip(self.bytes_of[whole]))]) == [whole]}
        self.spines: tuple[dict, dict] = ({}, {})
        self.ends = {t[n:]: self.ids.get(t[n:], -1) for t in self.ids for n in range(len(t))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        # the same words by the faster module, for texts of Latin letters, where both know the same classes
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.odd = re.compile("[\x1c-\x1f\x85\xaa\xb2\xb3\xb9\xba\xbc-\xbe]|[^\x00-\u024f]").search
        self.apart: dict[int, bool] = {}  # by left << 32 | right: pairs of numbers would take twice the memory
        self.known: dict[str, bytes] = {}  # ids as int32, which take half the memory of a tuple
        self.chars = 0  # of the words known
        self.remember, self.remember_chars = remember, remember_chars

    @cached_property
    def text_of(self) -> dict[int, str]:
        return {i: str(i) for i in self.bytes_of}

    def forget(self) -> None:
        """Drops what was remembered of words and pairs; the vocabulary stays."""
        self.known, self.chars, self.apart, self.spines = {}, 0, {}, ({}, {})

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: apply the lowest-ranked merge, leftmost first, until none applies."""
        while len(ids) > 1:
            best = min(((self.rank[p][0], n) for n, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            n = best[1]
            ids = [*ids[:n], self.rank[ids[n], ids[n + 1]][1], *ids[n + 2 :]]
        return ids

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE encodes the bytes of the two tokens as just these two.

        Merges apply in order of rank. The token at the right end of ``left`` and the one
        at the left end of ``right`` grow at known ranks; the pair is broken if at some
        time the two that meet have a merge that comes before both grow on.
        """
        pair = left << 32 | right
        if (known := self.apart.get(pair)) is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            known, never = True, (1 << 60, -1)
            a, b, m, n = self.spine(left, 1), self.spine(right, 0), 0, 0
            while True:
                grow_a, grow_b = a[m][1], b[n][1]
                crossing = self.rank.get((a[m][0], b[n][0]), never)[0]
                if crossing < grow_a and crossing <= grow_b and crossing < never[0]:
                    known = False
                    break
                if grow_a == grow_b == never[0]:
                    break
                m, n = (m + 1, n) if grow_a <= grow_b else (m, n + 1)
            self.apart[pair] = known
        return known

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost byte up to the token: each part at that side (1: right end), with the rank at which it grows on."""
        if (found := self.spines[side].get(token)) is None:
            made = self.made_of.get(token)
            if made is None:
                found = [(token, 1 << 60)]
            else:
                rank, *parts = made
                below = self.spine(parts[side], side)
                found = [*below[:-1], (below[-1][0], rank), (token, 1 << 60)]
            self.spines[side][token] = found
        return found

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words."""
        return dict(self.walk(words))

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each of distinct words with its encoding, by one depth-first walk over their trie."""
        raws = sorted((w.encode("utf-8"), w) for w in words)
        apart, ends, known = self.stays_apart, self.ends, self.apart
        made_of = self.made_of
        last, before = [-1], b""  # last[n]: the last token of the first n bytes of the path
        for raw, word in raws:
            most = min(len(raw), len(before))
            shared = 0
            if raw[:most] == before[:most]:
                shared = most
            else:
                low, high = 0, most  # the shared length, by bisection
                while low < high:
                    mid = (low + high + 1) // 2
                    if raw[:mid] == before[:mid]:
                        low = mid
                    else:
                        high = mid - 1
                shared = low
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for start in range(end - 1, -1, -1):
                    tail = raw[start:end]
                    token = ends.get(tail)
                    if token is None:
                        raise ValueError("the vocabulary lacks a byte")
                    if token < 0:
                        continue
                    if start == 0:
                        fits = end == 1 or token in made_of
                    elif (fits := known.get(last[start] << 32 | token)) is None:
                        fits = apart(last[start], token)
                    if fits:
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            found, at = [], len(raw)
            while at:
                found.append(last[at])
                at -= len(self.bytes_of[last[at]])
            yield word, tuple(reversed(found))
            before = raw

    def pieces(self, text: str) -> list[str]:
        """The words of a text, with special strings on their own."""
        if self.special and any(s in text for s in self.special):
            return list(chain.from_iterable([p] if p in self.special else self.words(p) for p in self.split_special.split(text)))
        return self.words(text) if self.odd(text) else self.plain_words(text)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text, int32; special strings in a text are their own tokens.

        Words are remembered until there are too many or too long ones of them, then anew.
        """
        known = self.known
        parts, new = [], set()
        for text in texts:
            words = self.pieces(text)
            found = list(map(known.get, words))
            if None in found:
                new.update(w for w, f in zip(words, found, strict=True) if f is None)
                parts.append((words, found))
            else:
                parts.append((None, found))
        for s in new & self.special.keys():
            known[s] = array("i", (self.special[s],)).tobytes()
        known.update((w, array("i", ids).tobytes()) for w, ids in self.walk(new - self.special.keys()))
        self.chars += sum(map(len, new))
        for words, found in parts:
            yield np.frombuffer(b"".join(map(known.__getitem__, words) if words is not None else found), dtype=np.int32)
        if len(known) > self.remember or self.chars > self.remember_chars:
            self.known, self.chars = {}, 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, TrieBpe] = {}


def coder(path: str) -> TrieBpe:
    """One coder a worker; its memory of words is bounded and starts anew when full."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
        gc.freeze()
        gc.set_threshold(500_000, 20, 20)  # lists of numbers only, no cycles: collecting often costs a third of the time
    return _loaded[path]


def bounded(texts: Iterable[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Slices of texts of about so many characters, so that memory follows them and not the batch."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with ``ids`` array<int> last (a column of that name is replaced); a null text is empty.

    Rows go out in slices of about a million characters, so that memory follows these and not Arrow's batches of rows.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(*[c for c in docs.columns if c.lower() != "ids"])
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    names = [*rows.columns, "ids"]
    at = [c.lower() for c in names].index("text")

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for part in parts:
            first = 0
            for some in bounded((x.as_py() or "" for x in part.column(at))):
                made = list(c.encode_batch(some))
                offsets = np.concatenate(([0], np.cumsum([len(m) for m in made]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*part.slice(first, len(some)).columns, ids], names=names)
                first += len(some)
        c.forget()  # Spark keeps the worker for tasks of other stages

    return rows.mapInArrow(of, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with ``decoded``, the text of its ``ids``."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(path)
        for ids in parts:
            yield pd.Series([None if x is None else c.decode(x) for x in ids])

    return encoded.withColumn("decoded", of("ids"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes, then decodes the ids, and returns digests of both; one pass, as the ids needn't leave the task."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for texts in parts:
            rows = []
            for some in bounded([t or "" for t in texts]):
                for ids in map(np.ndarray.tolist, c.encode_batch(some)):
                    line = ",".join(map(c.text_of.__getitem__, ids)).encode()
                    back = c.decode(ids).encode("utf-8")
                    rows.append((len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", of("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
