"""Dates and periods in text as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import once

# How months are written in filings.
MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
# Forms of period labels.
DATE = rf"(?i)\b\d{{1,2}}\s+{MONTH}\s+20\d{{2}}\b"
SPACED_MONTH = r"[A-Za-z](?:\s*[A-Za-z]){2,10}"
LOOSE_DATE = rf"\b\d{{1,2}}\s+{SPACED_MONTH}\s+20\d{{2}}\b"
TWO_DATES = rf"\b(\d{{1,2}})\s+({SPACED_MONTH})\s+(\d{{1,2}})\s+({SPACED_MONTH})\s+(20\d{{2}})\s+(20\d{{2}})\b"
PHRASE = rf"(?i)\b(?:for\s+the\s+)?(?:\d{{1,2}}\s+months?|quarter|half(?:[-\s]?year)?|year)\s+ended\s+\d{{1,2}}\s+{MONTH}\s+20\d{{2}}\b"
FISCAL = r"(?i)\b(?:FY|Q[1-4]|H[12])\s*[-/]?\s*(?:20)?\d{2}\b"
RELATIVE = r"(?i)\b(?:current|previous|prior)\s+(?:quarter|half(?:[-\s]?year)|year|period)\b"
YEAR = r"\b20\d{2}\b"
# Fixed value: what every label of period_labels holds, so that lines without it need no further look.
LABELLED = r"(?i)20\d{2}|\b(?:FY|Q[1-4]|H[12]|current|previous|prior)"
QUARTER = r"(?i)\bQ([1-4])\s*[-/]?\s*(\d{2,4})\b"
FY = r"(?i)\bFY\s*[-/]?\s*(\d{2,4})\b"


def parse_utc(x: Column) -> Column:
    """UTC timestamp of the forms that feeds use: 14 digits, compact T, unix seconds or milliseconds, dates, ISO, RFC 2822; else null."""
    s = F.trim(x)
    whole = lambda p: s.rlike("^" + p + "$")
    stamp = lambda v, f: F.try_to_timestamp(v, F.lit(f))
    number = s.try_cast("long")
    return (
        F.when(whole("[0-9]{14}"), stamp(s, "yyyyMMddHHmmss"))
        .when(whole("[0-9]{8}T[0-9]{6}Z"), stamp(F.regexp_replace(s, "[TZ]", ""), "yyyyMMddHHmmss"))
        .when(whole("-?[0-9]{1,18}"), F.timestamp_seconds(F.when(F.abs(number) >= 10**12, F.floor(number / 1000)).otherwise(number)))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}"), stamp(s, "yyyy-MM-dd"))
        .when(s.rlike("^[A-Za-z]{3}, "), stamp(F.regexp_replace(F.regexp_replace(s, "^[A-Za-z]{3}, ", ""), " (GMT|UTC|Z)$", " +0000"), "d MMM yyyy HH:mm:ss Z"))
        .otherwise(F.coalesce(F.replace(s, F.lit("/"), F.lit("-")).try_cast("timestamp"), stamp(s, "yyyy-MM-dd HH:mm")))
    )


def utc_text(x: Column) -> Column:
    """A timestamp as feeds' stores keep it: whole seconds, Z at the end."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _date(day: Column, month: Column, year: Column) -> Column:
    """A date of the words of its parts; blanks inside the month's name don't count. Null where there's no such day."""
    short = F.initcap(F.lower(F.substring(F.regexp_replace(month, "[^A-Za-z]", ""), 1, 3)))
    known = F.lower(F.regexp_replace(month, "[^A-Za-z]", "")).rlike(f"^{MONTH}$")
    return F.when(known, F.to_date(F.try_to_timestamp(F.concat_ws(" ", day, short, year), F.lit("d MMM yyyy"))))


def _parts(label: Column) -> Column:
    words = r"^(\d{1,2})\s+(.*?)\s+(20\d{2})$"
    return _date(F.regexp_extract(label, words, 1), F.regexp_extract(label, words, 2), F.regexp_extract(label, words, 3))


def _dates_by_form(s: Column) -> list[Column]:
    """Dates written out in a text as an array for each form, nulls where there's no such day."""
    part = lambda n: F.regexp_extract(s, TWO_DATES, n)
    pair = F.when(s.rlike(TWO_DATES), F.array(_date(part(1), part(2), part(5)), _date(part(3), part(4), part(6)))).otherwise(F.array().cast("array<date>"))
    return [F.transform(F.regexp_extract_all(s, F.lit(DATE), 0), _parts), F.transform(F.regexp_extract_all(s, F.lit(LOOSE_DATE), 0), _parts), pair]


def explicit_dates(text: Column) -> Column:
    """Distinct dates written out in a text: plain ones first, then those with blanks in the month, then the four of "31 March 31 December 2025 2024"."""
    s, none = F.coalesce(text, F.lit("")), F.array().cast("array<date>")
    return F.when(s.rlike("20[0-9]{2}"), F.array_distinct(F.array_compact(F.concat(*_dates_by_form(s))))).otherwise(none)


def named_date(text: Column) -> Column:
    """The first date written out in a text, or null; rarer forms are looked for only where the plain one isn't there."""
    s = F.coalesce(text, F.lit(""))
    return F.when(s.rlike("20[0-9]{2}"), F.coalesce(*[F.try_element_at(F.array_compact(d), F.lit(1)) for d in _dates_by_form(s)]))


def quarter_label(text: Column) -> Column:
    """End of the quarter that a label like Q3 FY or Q3-24 names."""
    quarter, year = F.regexp_extract(text, QUARTER, 1).try_cast("int"), F.regexp_extract(text, QUARTER, 2).try_cast("int")
    return F.when(year.isNotNull(), F.last_day(F.make_date(F.when(year >= 100, year).otherwise(year + 2000), quarter * 3, F.lit(1))))


def is_month_end(d: Column) -> Column:
    return d == F.last_day(d)


def is_quarter_end(d: Column) -> Column:
    return is_month_end(d) & (F.month(d) % 3 == 0)


def previous_quarter_end(d: Column) -> Column:
    """Last day of the month three before."""
    return F.last_day(F.add_months(d, -3))


def quarter_end_on_or_before(d: Column) -> Column:
    return F.when(is_quarter_end(d), d).otherwise(F.date_sub(F.to_date(F.date_trunc("quarter", d)), 1))


def period_end(label: Column) -> Column:
    """ISO end date of a period label, or null: a date or quarter in it, a fiscal or a bare year (both end in December).

    Labels of a current or past quarter, and quarters that ended on another day, go to a quarter's end.
    """
    december = lambda y: F.make_date(y, F.lit(12), F.lit(31))

    def end(s: Column, given: Column) -> Column:
        low = F.lower(s)
        said = lambda words: F.contains(low, F.lit(words))
        fy = F.regexp_extract(s, FY, 1)
        fy_year = F.when(F.length(fy) == 2, fy.try_cast("int") + 2000).otherwise(fy.try_cast("int"))
        return (
            F.when(given.isNotNull() & said("current quarter"), quarter_end_on_or_before(given))
            .when(given.isNotNull() & said("previous quarter") & ~is_quarter_end(given), previous_quarter_end(quarter_end_on_or_before(given)))
            .when(given.isNotNull() & said("quarter ended"), quarter_end_on_or_before(given))
            .when(given.isNotNull(), given)
            .when(fy_year.between(1900, 2100), december(fy_year))
            .when(s.rlike(YEAR), december(F.regexp_extract(s, YEAR, 0).try_cast("int")))
        )

    plain = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    return F.date_format(once(plain, lambda s: once(F.coalesce(named_date(s), quarter_label(s)), lambda given: end(s, given))), "yyyy-MM-dd")


def period_labels(line: Column) -> Column:
    """Period labels of a line, in order of place: phrases, dates outside of them, fiscal and relative ones; bare years only where there's none of these."""

    def found(pattern: str) -> Column:
        # (place, label): occurrences of equal text are told apart by what stands before them
        every = F.regexp_extract_all(line, F.lit(pattern), 0)
        return F.transform(F.array_distinct(every), lambda m: F.struct(F.position(m, line).alias("at"), F.regexp_replace(m, r"\s+", " ").alias("label")))

    phrases = found(PHRASE)
    loose = F.filter(found(DATE), lambda d: ~F.exists(phrases, lambda p: (p["at"] <= d["at"]) & (d["at"] < p["at"] + F.length(p["label"]))))
    named = F.concat(phrases, loose, found(FISCAL), found(RELATIVE))
    labels = F.transform(F.array_sort(F.when(F.size(named) > 0, named).otherwise(found(YEAR))), lambda m: m["label"])
    return F.when(line.isNull() | line.rlike(LABELLED), labels).otherwise(F.array().cast("array<string>"))


def label_rank(label: Column) -> Column:
    """How specific a period label is, 0 the most: phrase, fiscal with date, date, fiscal, relative, a word of periods, other, with a year, a year alone."""
    date, fiscal = label.rlike(DATE), label.rlike(FISCAL)
    word = F.lower(label).rlike("quarter|half|year")
    return (
        F.when(label.rlike(PHRASE), 0).when(label.rlike(RELATIVE), 4).when(date & fiscal, 1).when(date, 2).when(fiscal, 3)
        .when(label.rlike("^20[0-9]{2}$"), 8).when(label.rlike(YEAR), 7).when(word, 5).otherwise(6)
    )


def anchored(label: Column, end: Column) -> Column:
    """An ISO date, or the day and month that a label names ("at 30 June") in that date's year."""
    own = rf"(?i)\b(?:as\s+at|at)\s+(\d{{1,2}})\s+({MONTH})\b"
    said = F.concat_ws(" ", F.regexp_extract(label, own, 1), F.initcap(F.substring(F.regexp_extract(label, own, 2), 1, 3)), F.substring(end, 1, 4))
    return F.when(label.rlike(own), F.coalesce(F.date_format(F.to_date(F.try_to_timestamp(said, F.lit("d MMM yyyy"))), "yyyy-MM-dd"), end)).otherwise(end)


def year_of_hint(text: Column) -> Column:
    """The year of a period hint: of its date, quarter, fiscal year or bare year, in this order."""
    fy = F.regexp_extract(text, FY, 1)
    fy_year = F.when(F.length(fy) == 2, fy.try_cast("int") + 2000).otherwise(fy.try_cast("int"))
    return F.coalesce(F.year(named_date(text)), F.year(quarter_label(text)), F.when(fy_year.between(1900, 2100), fy_year), F.regexp_extract(text, YEAR, 0).try_cast("int"))


def day_windows(first: Column, last: Column) -> Column:
    """An array of (start, end) of every day from first to last, both included; ends are a second before midnight."""
    days = F.sequence(first.cast("date"), last.cast("date"))
    return F.transform(days, lambda d: F.struct(utc_text(d.cast("timestamp")).alias("start"), F.concat(d.cast("string"), F.lit("T23:59:59Z")).alias("end")))


def period_key(period: Column) -> Column:
    """A date as a number to sort by; zero where it's none."""
    return F.coalesce(F.replace(period, F.lit("-"), F.lit("")).try_cast("int"), F.lit(0))
