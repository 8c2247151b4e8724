"""Personal data with offsets: plain identifiers and disguised ones.

Plain identifiers are matched in the source text. A transducer then rewrites homoglyphs,
spelled-out digits and at/dot disguises, keeping for every character it writes the
source span it came from; identifiers found in the rewritten text map back over that.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            out.append((start, free))
        at = text.find("@", free)
    return out


def plain(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.findall(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


# Letters of other scripts that look like a Latin one, in the order of the Latin ones.
LOOKALIKES = {
    "a": "аαɑᴀ", "b": "ьƄ", "c": "сϲᴄ", "d": "ԁᴅ", "e": "е℮ᴇ", "g": "ɡց", "h": "һʜ", "i": "іιıⅰ", "j": "јϳ", "k": "кκᴋ",
    "l": "ӏℓⅼ", "m": "мᴍ", "n": "ոռɴ", "o": "оοօᴏ", "p": "рρᴘ", "q": "ԛ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτᴛ", "u": "սυᴜ", "v": "νѵᴠ", "w": "ԝѡᴡ", "x": "хχ", "y": "уүγʏ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "L": "Ⅼ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "@": "＠﹫", ".": "．。․﹒·∙•", "+": "＋﹢", "-": "‐‑‒–—−－﹣", "_": "＿", "(": "（", ")": "）", " ": "    　",
}
# The words of the digits in the languages of the texts.
DIGIT_WORDS = {
    "0": ("zero", "oh", "null", "cero", "zéro"), "1": ("one", "eins", "uno", "un"), "2": ("two", "zwei", "zwo", "dos", "deux"), "3": ("three", "drei", "tres", "trois"), "4": ("four", "vier", "cuatro", "quatre"),
    "5": ("five", "fünf", "cinco", "cinq"), "6": ("six", "sechs", "seis"), "7": ("seven", "sieben", "siete", "sept"), "8": ("eight", "acht", "ocho", "huit"), "9": ("nine", "neun", "nueve", "neuf"),
}
INVISIBLE = "­​‌‍⁠﻿᠎"
GLYPH = {c: latin for latin, others in LOOKALIKES.items() for c in others}
# full-width, mathematical and circled forms and the decimal digits of other scripts, by rule
GLYPH |= {chr(c + 0xFEE0): chr(c) for c in range(33, 127) if chr(c + 0xFEE0) not in GLYPH}
GLYPH |= {chr(0x1D400 + 52 * n + k): chr((65 if k < 26 else 71) + k) for n in range(13) for k in range(52)}
GLYPH |= {chr(0x1D7CE + n): str(n % 10) for n in range(50)}
GLYPH |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x9E6) for d in range(10)}
GLYPH |= {chr(0x24D0 + n): chr(97 + n) for n in range(26)} | {chr(0x24B6 + n): chr(65 + n) for n in range(26)}
GLYPH |= {chr(0x2080 + n): str(n) for n in range(10)} | {c: str(n) for n, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")}
GLYPH |= {chr(0x245F + n): str(n) for n in range(1, 10)} | {"⓪": "0"}
SPELLED = {w: d for d, words in DIGIT_WORDS.items() for w in words}

_any = "|".join(sorted(SPELLED, key=len, reverse=True))
GLYPHS = re.compile("[" + re.escape("".join(GLYPH)) + INVISIBLE + "]")
NARROW_GLYPHS = [c for c in (*GLYPH, *INVISIBLE) if ord(c) < 256]
#: At least three spelled digits, or spelled ones beside figures; dashes, blanks or nothing between.
SPELLED_RUN = re.compile(rf"(?<![^\W\d_])(?:{_any})(?:[\x20\t,-]{{0,2}}(?:{_any}|[0-9])(?![^\W\d_]))+|[0-9](?:[\x20\t,-]{{0,2}}(?:{_any})(?![^\W\d_]))+", re.I)
ONE = re.compile(rf"{_any}", re.I)
AT_MARK = re.compile(r"[\x20\t]*[(\[{<|*_-]+[\x20\t]*(?:at|@|arroba|arobase|ät)[\x20\t]*[)\]}>|*_-]+[\x20\t]*", re.I)
DOT_MARK = re.compile(r"[\x20\t]*[(\[{<|*_-]+[\x20\t]*(?:dot|punto|point|punkt|\.)[\x20\t]*[)\]}>|*_-]+[\x20\t]*", re.I)
DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]+(?:dot|punkt|punto|point)[\x20\t]+(?=[A-Za-z0-9])", re.I)
AT_WORD = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]+(?:at|arroba|arobase)[\x20\t]+(?=[A-Za-z0-9-]+(?:[\x20\t]*\.[\x20\t]*[A-Za-z0-9-]+)+)", re.I)
#: The last label of a disguised address: letters of one case. Figures or a capital there are prose ("at 3.5", "at home.He").
TOP_LABEL = re.compile(r"\.(?:[a-z]{2,}|[A-Z]{2,})$")
AROUND_AT = re.compile(r"[\x20\t]+@[\x20\t]*|@[\x20\t]+")
#: What makes a second look worth its time.
HINT = re.compile(rf"[\(\[{{<|*_-][\x20\t]*(?:at|@|arroba|arobase|ät|dot|punkt|punto|point|\.)[\x20\t]*[\)\]}}>|*_-]|[\x20\t]dot[\x20\t]|[\x20\t](?:punkt|punto|point)[\x20\t]|[\x20\t]@|@[\x20\t]|[\x20\t](?:at|arroba|arobase)[\x20\t]+[A-Za-z0-9-]+[\x20\t]*\.[\x20\t]*[A-Za-z0-9]|(?:{_any})[\x20\t,-]{{0,2}}(?:{_any}|[0-9])|[0-9][\x20\t,-]{{0,2}}(?:{_any})", re.I)


class Tracked:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replaces matches by ``to(match)``; each written character stands for the whole match, or a list of (string, from, to) for its parts."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            made = to(m)
            if made is None:
                continue
            a, b = m.span()
            parts.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            for string, x, y in made if isinstance(made, list) else [(made, a, b)]:
                parts.append(string)
                start += [self.start[x]] * len(string)
                end += [self.end[y - 1]] * len(string)
            at = b
        if at:
            self.text = "".join(parts) + self.text[at:]
            self.start = start + self.start[at:]
            self.end = end + self.end[at:]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _digits(m: re.Match) -> list | None:
    out, at, stop = [], m.start(), m.end()
    text, words = m.string, 0
    while at < stop:
        one = ONE.match(text, at, stop)
        if one:
            out.append((SPELLED[one[0].lower()], at, one.end()))
            words += 1
            at = one.end()
        else:
            if text[at] in "0123456789":
                out.append((text[at], at, at + 1))
            at += 1
    return out if words and len(out) >= 2 else None


def deobfuscate(text: str) -> Tracked:
    t = Tracked(text)
    t.rewrite(GLYPHS, lambda m: GLYPH.get(m[0], ""))
    t.rewrite(SPELLED_RUN, _digits)
    t.rewrite(DOT_MARK, lambda m: ".")
    t.rewrite(AT_MARK, lambda m: "@")
    t.rewrite(DOT_WORD, lambda m: ".")
    t.rewrite(AT_WORD, lambda m: "@")
    t.rewrite(AROUND_AT, lambda m: "@")
    return t


#: HINT for texts in lower case, which is several times as fast.
LOW_HINT = re.compile(HINT.pattern)


def cued(text: str) -> bool:
    """Whether HINT finds anything: it is searched for in lower case, with the letters that only re.I takes for an i or s made such."""
    if not text.isascii():
        text = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")
    return LOW_HINT.search(text.lower()) is not None


#: A blank between two plain words, neither of them a word of a disguise, or a line break: nothing that is looked for crosses it.
_said = "|".join(sorted({w for w in SPELLED if w.isascii()} | {"at", "dot", "punkt", "punto", "point", "arroba", "arobase"}))
BOUNDARY = re.compile(rf"(?<=[\x20\n])(?!(?:{_said})\x20)[A-Za-z]+(?=\x20(?!(?:{_said})[\x20\n])[A-Za-z]+[\x20\n])|\n", re.I)


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text around hints of a disguise, each out to the next boundary that no identifier or disguise can cross; ascending and apart."""
    marks = [m.span() for m in HINT.finditer(text)] if cued(text) else []
    if not text.isascii():
        try:
            text.encode("latin-1")
            foreign = any(c in text for c in NARROW_GLYPHS)
        except UnicodeEncodeError:
            foreign = True
        if foreign:
            marks += [m.span() for m in GLYPHS.finditer(text)]
            marks.sort()
    out: list[list[int]] = []
    for a, b in marks:
        if out and b <= out[-1][1]:
            continue
        # the last boundary that ends by a, looked for ever further back
        start, reach = 0, 64
        while (low := max(0, a - reach)) or reach == 64:
            last = None
            for m in BOUNDARY.finditer(text, low, a):
                last = m
            if last:
                start = last.end()
                break
            if not low:
                break
            reach *= 4
        after = BOUNDARY.search(text, b)
        end = after.end() if after else len(text)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(plain spans, all spans) by kind, ascending; a disguised identifier is left out where a plain one of its kind is or holds the same span; one that only overlaps is added to it."""
    base = plain(text)
    every = {k: set(v) for k, v in base.items()}
    for a, b in windows(text):
        t = deobfuscate(text[a:b])
        if t.text == text[a:b]:
            continue
        for kind, spans in plain(t.text).items():
            for x, y in spans:
                s, e = t.span(x, y)
                span = (s + a, e + a)
                at = bisect_right(base[kind], (span[0], len(text)))  # plain spans don't overlap: only the last that begins by then may hold it
                if kind == "email" and not TOP_LABEL.search(t.text[x:y]):
                    continue
                if not at or base[kind][at - 1][1] < span[1]:
                    every[kind].add(span)
    return base, {k: sorted(v) for k, v in every.items()}


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Text with each span, or joined overlapping ones, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def annotate(docs: DataFrame) -> DataFrame:
    """docs with ``found`` (a column of that name is replaced): counts of plain spans by kind, base_sha256 and all spans.

    Null texts are empty. Every row is looked at on its own, so repeated rows and ids give
    repeated results; whole texts are read, whatever their length. An empty table gives none.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                base, every = find(text or "")
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.withColumn("found", of("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, a row for each row of docs."""
    return annotate(docs.select("doc_id", "text")).select("doc_id", "found.*")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every found span of ``text`` replaced by its kind; null texts stay null, n_chars is counted anew."""

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([t if not t else redact(t, find(t)[1]) for t in texts], dtype=object)

    out = docs.withColumn("text", of("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
