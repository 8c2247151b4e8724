"""Text normalisers and tests as column functions: all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words of the language heuristic.
EN_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "that", "the", "to", "was", "were", "will", "with")


def missing(x: Column) -> Column:
    """Empty and blank strings as null."""
    return F.nullif(F.trim(x), F.lit(""))


def first_non_empty(*xs: Column) -> Column:
    return F.coalesce(*[missing(x) for x in xs])


def normalize_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def normalize_text(x: Column) -> Column:
    """Lower case, letters a-z, digits and single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\P{Alnum}+", " "))  # several times as fast as [^a-z0-9]


def words(x: Column) -> Column:
    return F.filter(F.split(normalize_text(x), " "), lambda w: w != "")


def exact_hash(*parts: Column) -> Column:
    return F.sha2(normalize_text(F.concat_ws("\n", *parts)), 256)


def near_key(title: Column, body: Column) -> Column:
    """Near-duplicate key: openings of title and body and the first tokens."""
    return near_of(normalize_text(title), normalize_text(body))


def exact_of(title: Column, body: Column) -> Column:
    """``exact_hash`` of a title and a body that are normalised."""
    return F.sha2(F.trim(F.concat_ws(" ", title, body)), 256)


def near_of(title: Column, body: Column) -> Column:
    """``near_key`` of a title and a body that are normalised."""
    first = F.substring_index(body, " ", 80)
    return F.sha1(F.concat_ws("|", F.substring(title, 1, 220), F.substring(body, 1, 320), first))


def ascii_ratio(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\x00-\x7F]", "")) / F.greatest(F.length(x), F.lit(1))


def looks_english(x: Column) -> Column:
    """ASCII for 85 %, and of 25 words or more, five function words among the first 200."""
    w = F.filter(F.split(F.lower(x), "[^a-z]+"), lambda v: v != "")
    hits = F.size(F.filter(F.slice(w, 1, 200), lambda v: v.isin(*EN_STOPWORDS)))
    return (F.length(x) > 0) & (ascii_ratio(x) >= 0.85) & ((F.size(w) < 25) | (hits >= 5))


def strip_html(x: Column) -> Column:
    """Text of a page: scripts, styles and tags out, the five basic entities decoded."""
    out = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return normalize_space(out)


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]+)"'), 1))


def ticker_blob(x: Column) -> Column:
    """Sorted distinct tickers out of a pipe-delimited or free list."""
    parts = F.when(F.contains(x, F.lit("|")), F.split(x, r"\|")).otherwise(F.split(x, r"[,\s;/]+"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda p: F.regexp_replace(F.upper(p), "[^A-Z0-9]", "")), lambda p: p != "")))


def serialize_tickers(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("|"), F.array_join(a, "|"), F.lit("|"))).otherwise(F.lit(""))


def quality_score(title: Column, description: Column, body: Column) -> Column:
    n = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    return F.round(F.least(F.lit(1.0), n(body) / 2400.0 + n(description) / 1000.0 + n(title) / 400.0), 6)


# Headings wholly in capitals, whatever their length in words.
GENERIC_HEADING = r"^[A-Z][A-Z\s&/\-(),]{4,}$"


def heading(x: Column) -> Column:
    """A short line mostly of capitals or of capitalised words; marks at its ends don't count."""
    h = F.btrim(normalize_space(x), F.lit(":.-"))
    w = F.filter(F.split(h, " "), lambda v: v != "")
    capitalised = F.size(F.filter(w, lambda v: v.rlike(r"^\p{Lu}"))) / F.greatest(F.size(w), F.lit(1))
    letters, upper = F.length(F.regexp_replace(h, r"[^\p{L}]", "")), F.length(F.regexp_replace(h, r"[^\p{Lu}]", ""))
    shape = F.size(w).between(1, 12) & (letters >= 6) & ((upper / F.greatest(letters, F.lit(1)) > 0.7) | (capitalised >= 0.75))
    return (h != "") & (F.length(h) <= 110) & (h.rlike(GENERIC_HEADING) | shape)
