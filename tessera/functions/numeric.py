"""Amounts, units and currencies in text as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x worked out once however often body names it: branches of a condition share nothing otherwise."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def safe_float(x: Column) -> Column:
    """A number out of text with thousands separators; null for blanks and words."""
    return F.regexp_replace(F.trim(x), ",", "").try_cast("double")


def scaled_number(raw: Column, suffix: Column) -> Column:
    """Value of an amount and its scale word; brackets mean negative."""
    s = F.trim(raw)
    neg = s.startswith("(") & s.endswith(")")
    value = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "$1"), ",", "").try_cast("double")
    u = F.lower(F.coalesce(suffix, F.lit("")))
    scale = F.when(u.isin("k", "thousand"), 1e3).when(u.isin("m", "million", "mn", "mm"), 1e6).when(u.isin("b", "billion", "bn"), 1e9).when(u.isin("t", "trillion"), 1e12).otherwise(1.0)
    return F.when(neg, -value * scale).otherwise(value * scale)


# Unit and currency hints, in the order in which they are tried.
UNIT_HINTS = (
    (r"(?i)\$\s*[A-Z]?[’']?000\b|\b[A$]{0,2}\s*'000\b", 1e3),
    (r"(?i)\b(?:in\s+thousands|thousand\s+dollars|A\$'000)\b", 1e3),
    (r"(?i)\$\s*[A-Z]?\s*(?:bn|billion)\b|\b(?:in\s+billions)\b", 1e9),
    (r"(?i)\$\s*[A-Z]?\s*(?:m|million)\b|\b(?:in\s+millions)\b", 1e6),
)
CURRENCY_HINTS = (
    (r"(?i)\bCAD\b|C\$|\$C(?:AD)?|CA\$|CDN\$", "C$"),
    (r"(?i)\bAUD\b|A\$|\$A(?:UD)?", "A$"),
    (r"(?i)\bUSD\b|US\$|\$U(?:SD)?", "US$"),
    (r"(?i)\bNZD\b|NZ\$|\$NZD?", "NZ$"),
    (r"(?i)\bEUR\b|€", "€"),
    (r"(?i)\bGBP\b|£", "£"),
)
# The form of an amount that stands alone, and of a percentage.
AMOUNT_WORD = r"(?i)^((?:A|US|C|NZ)?[$€£])?\s*(\(?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?)\s*(bn|mn|mm|k|m|b|t|million|billion|thousand|trillion)?$"
PERCENT_WORD = r"^\(?-?\d[\d,]*(?:\.\d+)?\)?%$"


def unit_multiplier(line: Column) -> Column:
    """What figures near a line are to be multiplied by, if it says so."""
    out = F.lit(None).cast("double")
    for pattern, scale in reversed(UNIT_HINTS):
        out = F.when(line.rlike(pattern), scale).otherwise(out)
    return out


def apply_multiplier(value: Column, multiplier: Column, raw: Column, is_money_amount: Column) -> Column:
    """The value scaled, unless its own text names a scale or it's no amount of money."""
    own = F.lower(raw).rlike(r"\b(?:thousand|million|billion|trillion)\b|\d\s*[kmbt]\b")
    return F.when(is_money_amount & ~own, value * multiplier).otherwise(value)


def currency_hint(line: Column) -> Column:
    """The currency that a line names; a dollar sign alone is just that; else empty."""
    out = F.when(F.contains(line, F.lit("$")), F.lit("$")).otherwise(F.lit(""))
    for pattern, code in reversed(CURRENCY_HINTS):
        out = F.when(line.rlike(pattern), code).otherwise(out)
    return F.coalesce(out, F.lit(""))


def numeric_word(word: Column) -> Column:
    """struct(value_type, value, currency, suffix, minor) of a word that is an amount or a percentage, else null.

    Minor ones (years, one or two digits, small decimals, all without currency or scale) are rather labels than figures of a table.
    """
    t = F.trim(word)
    part = lambda n: F.regexp_extract(t, AMOUNT_WORD, n)

    def amount(p: Column, value: Column) -> Column:
        bare = (p["currency"] == "") & (p["suffix"] == "")
        whole = value == F.floor(value)
        digits = F.length(F.regexp_replace(p["raw"], "[,()-]", ""))
        minor = bare & ((whole & (F.abs(value).between(1900, 2100) | (digits <= 2))) | (p["raw"].contains(".") & (F.abs(value) < 10)))
        return F.when(value.isNotNull(), F.struct(F.lit("amount").alias("value_type"), value.alias("value"), p["currency"].alias("currency"), p["suffix"].alias("suffix"), minor.alias("minor")))

    parts = F.struct(part(1).alias("currency"), part(2).alias("raw"), part(3).alias("suffix"))
    share = once(scaled_number(F.regexp_replace(t, "%$", ""), F.lit("")), lambda v: F.struct(F.lit("percent").alias("value_type"), v.alias("value"), F.lit("").alias("currency"), F.lit("").alias("suffix"), F.lit(False).alias("minor")))
    return F.when(t.rlike(PERCENT_WORD), share).when(t.rlike(AMOUNT_WORD), once(parts, lambda p: once(scaled_number(p["raw"], p["suffix"]), lambda v: amount(p, v))))


def nearest(x: Column, centres: Column, tolerance: float) -> Column:
    """Index (from 0) of the nearest centre, the first of equally near ones; null where none is within the tolerance."""
    pairs = F.transform(centres, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i")))
    best = F.array_min(pairs)
    return F.when(best["d"] <= tolerance, best["i"])


def bucketize_scale(x: Column) -> Column:
    """The nearest of 1, 1e3, 1e6, 1e9 if within 15 %, else null."""
    pairs = F.array(*[F.struct((F.abs(x - b) / b).alias("d"), F.lit(b).alias("b")) for b in (1.0, 1e3, 1e6, 1e9)])
    best = F.array_min(pairs)
    return F.when(best["d"] <= 0.15, best["b"])


def nearest_quantile(values: Column, q: float) -> Column:
    """The element of a sorted array at index round((n - 1) q), halves to even."""
    s = F.array_sort(values)
    return F.element_at(s, (F.bround((F.size(s) - 1) * F.lit(q), 0) + 1).cast("int"))
