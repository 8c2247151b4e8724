"""News items as column functions: titles and bodies, tickers, domains, pages' descriptions, priorities of addresses, kinds of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, text, urls

# How symbols are written, and capitals that are none.
TICKER_FORMS = (r"\$([A-Z]{1,6})\b", r"\b(?:NYSE|NASDAQ|ASX|LSE|TSX|HKEX|TSE)\s*[:\-]\s*([A-Z]{1,6})\b", r"(?<![A-Za-z0-9])([A-Z]{1,6})\.AX(?![A-Za-z0-9])")
NOT_TICKERS = ("CEO", "CFO", "EPS", "USD", "GDP", "ETF", "IPO", "Q1", "Q2", "Q3", "Q4")


def _none() -> Column:
    return F.array().cast("array<string>")


def symbol(x: Column) -> Column:
    """A ticker in capitals, dots and dashes kept; empty if longer than twelve."""
    s = F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), r"[^A-Z0-9.\-]", "")
    return F.when(F.length(s) <= 12, s).otherwise(F.lit(""))


def listed_tickers(x: Column) -> Column:
    """Distinct tickers of a list in text, in its order: JSON, between bars, or by commas, semicolons, slashes and blanks."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    as_json = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    parts = F.coalesce(as_json, F.split(raw, r"[,\s;/|]+"))
    return F.array_distinct(F.filter(F.transform(parts, symbol), lambda s: (s != "") & ~s.isin(*NOT_TICKERS)))


def blob(tickers: Column) -> Column:
    """Tickers as one string between bars, in order; empty for none."""
    return text.serialize_tickers(F.array_sort(F.array_distinct(F.filter(F.transform(tickers, symbol), lambda s: s != ""))))


def inferred_tickers(title: Column, body: Column, existing: Column, allowed: Column | None = None) -> Column:
    """Existing tickers, those written as such in the title and the body's first 2000 characters and, of an allowed list, bare ones."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 2000))
    found = [F.regexp_extract_all(said, F.lit(p), 1) for p in TICKER_FORMS]
    if allowed is not None:
        bare = F.regexp_extract_all(F.upper(said), F.lit(r"(?<![A-Z0-9])([A-Z0-9]{2,6})(?![A-Z0-9])"), 1)
        found.append(F.array_intersect(bare, allowed))
    every = F.concat(F.coalesce(existing, _none()), *found)
    return F.array_distinct(F.filter(F.transform(every, symbol), lambda s: (s != "") & ~s.isin(*NOT_TICKERS)))


def title_and_body(raw: Column, explicit: Column) -> Column:
    """struct(title, body): the given title, else the first line, at most 220 characters of it; the body without the title where it begins with it."""
    t = F.trim(F.regexp_replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("\r"), F.lit("\n")), r"\n{3,}", "\n\n"))
    given = text.normalize_space(explicit)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    title = F.when((given != "") | (t == ""), given).otherwise(F.when(F.length(first).between(20, 220), first).otherwise(F.substring(first, 1, 220)))
    rest = F.when((given != "") | (t == ""), t).otherwise(F.trim(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")))
    plain_title = text.normalize_text(title)
    begins = (plain_title != "") & F.contains(text.normalize_text(F.substring(rest, F.lit(1), F.greatest(F.lit(500), F.length(title) * 2))), plain_title)
    at = F.position(title, rest)
    less = F.when(begins & (at > 0), F.trim(F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(title), F.length(rest))))).otherwise(rest)
    return F.struct(text.normalize_space(title).alias("title"), text.normalize_space(less).alias("body"))


def source_domain(domain: Column, source: Column, url: Column) -> Column:
    """The item's own domain, else its source if that reads as one, else the host of its address."""
    given, named = F.lower(F.trim(F.coalesce(domain, F.lit("")))), F.lower(F.trim(F.coalesce(source, F.lit(""))))
    netloc = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(given != "", given).when(F.contains(named, F.lit(".")) & ~F.contains(named, F.lit(" ")), F.regexp_replace(named, r"^(.*?)www\.", "$1")).otherwise(F.regexp_replace(netloc, r"^(.*?)www\.", "$1"))


def from_australia(countries: Column, addresses: Column) -> Column:
    """Whether any country is Australia or any address or domain ends in .au."""
    country = F.exists(F.transform(countries, lambda x: F.lower(text.normalize_space(x))), lambda x: x.isin("au", "aus") | F.contains(x, F.lit("australia")))
    return F.coalesce(country, F.lit(False)) | F.coalesce(F.exists(addresses, lambda x: urls.host(x).endswith(".au")), F.lit(False))


def names_company(title: Column, body: Column, names: Column) -> Column:
    """Whether title or the body's first 3000 characters hold one of the normalised names between blanks."""
    said = F.concat(F.lit(" "), text.normalize_text(F.concat_ws("\n", title, F.substring(body, 1, 3000))), F.lit(" "))
    return F.exists(names, lambda n: (n != "") & F.contains(said, F.concat(F.lit(" "), n, F.lit(" "))))


def drop_reason(body: Column, tickers: Column, allowed: Column | None = None, least_chars: int = 120) -> Column:
    """Why a news row is left out: short_text, non_english, ticker_not_allowlisted; ok if it stays."""
    out = F.when(F.length(body) < least_chars, "short_text").when(~text.looks_english(body), "non_english")
    if allowed is not None:
        out = out.when((F.size(tickers) > 0) & ~F.arrays_overlap(tickers, allowed), "ticker_not_allowlisted")
    return out.otherwise("ok")


def iso_day(x: Column) -> Column:
    """The day of a date or time as ISO text; empty if it's none."""
    return F.coalesce(F.to_date(dates.parse_utc(F.trim(x))).cast("string"), F.lit(""))


def candidate(provider: str, item: dict[str, Column], fetched: Column) -> Column:
    """struct(reject_reason, provider_item_id, canonical_url, title, body, published_at, source_name) of a provider's item.

    Rejected are items without title and address (missing_identity), without a time
    (missing_published_at; providers of scraped pages fall back on the fetch) or with one
    that can't be read (invalid_published_at), and scraped ones without text (missing_text).
    Ids that a provider lacks are made of address, title and time.
    """
    scraped = provider == "newspaper4k"
    title, url = text.normalize_space(item["title"]), urls.canonical(item["url"])
    body = text.normalize_space(text.first_non_empty(item["body"], item["description"]))
    raw = text.first_non_empty(item["published"])
    when = dates.parse_utc(raw)
    stamp = dates.utc_text(F.coalesce(when, dates.parse_utc(fetched)) if scraped else when)
    made = F.concat(F.lit({"newspaper4k": "n4k_"}.get(provider, f"{provider}_")), F.substring(F.sha1(F.concat_ws("|", url, title, stamp)), 1, 24))
    reason = F.when((title == "") & (url == ""), "missing_identity")
    reason = reason.when(F.coalesce(body, F.lit("")) == "", "missing_text").when(stamp.isNull(), "missing_published_at") if scraped else reason.when(raw.isNull(), "missing_published_at").when(when.isNull(), "invalid_published_at")
    item_id = made if scraped else F.coalesce(text.missing(item["id"]), made)
    source = text.first_non_empty(item["source"], urls.host(item["url"]), F.lit(provider))
    return F.struct(reason.alias("reject_reason"), F.when(reason.isNull(), item_id).alias("provider_item_id"), url.alias("canonical_url"), title.alias("title"), F.coalesce(body, F.lit("")).alias("body"), stamp.alias("published_at"), source.alias("source_name"))


def posture(snapshot: Column, fetched: Column) -> Column:
    """The same of a monitor's snapshot, a struct(posture struct, timestamp): missing_posture_payload, missing_identity, missing_published_at."""
    p = snapshot["posture"]
    name = text.first_non_empty(p["theaterName"], p["shortName"], p["theaterId"])
    headline = text.first_non_empty(p["headline"], p["summary"])
    title = F.concat_ws(" - ", F.concat(F.lit("WorldMonitor theater posture: "), name), headline)
    stamp = dates.utc_text(F.coalesce(dates.parse_utc(snapshot["timestamp"]), dates.parse_utc(fetched)))
    reason = F.when(p.isNull(), "missing_posture_payload").when(name.isNull(), "missing_identity").when(stamp.isNull(), "missing_published_at")
    return F.struct(reason.alias("reject_reason"), F.when(reason.isNull(), title).alias("title"), stamp.alias("published_at"))


# Preferred names of a page's description.
DESCRIPTIONS = ("description", "twitter:description", "og:description", "article:description")


def _longest(found: Column) -> Column:
    ranked = F.transform(F.filter(found, lambda x: x != ""), lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.coalesce(F.try_element_at(F.array_sort(ranked), F.lit(1))["x"], F.lit(""))


def _decoded(x: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return text.normalize_space(x)


def meta_description(html: Column) -> Column:
    """The longest of a page's descriptions: of the preferred names, else of any with description in it."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<meta\s+[^>]*>"), 0)

    def value(tag: Column, key: str) -> Column:
        return F.regexp_extract(tag, rf"(?i)(?:^|\s){key}\s*=\s*[\"']([^\"']*)[\"']", 1)

    rows = F.transform(tags, lambda t: F.struct(F.lower(F.trim(value(t, "name"))).alias("name"), F.lower(F.trim(value(t, "property"))).alias("prop"), _decoded(value(t, "content")).alias("text")))
    best = F.filter(rows, lambda r: r["name"].isin(*DESCRIPTIONS[:2]) | r["prop"].isin(*DESCRIPTIONS[2:]))
    some = F.filter(rows, lambda r: F.contains(r["name"], F.lit("description")) | F.contains(r["prop"], F.lit("description")))
    pick = lambda rs: _longest(F.transform(rs, lambda r: r["text"]))
    return F.when(pick(best) != "", pick(best)).otherwise(pick(some))


def jsonld_body(html: Column, name: str = "articleBody") -> Column:
    """The longest value of that name in a page's linked data, decoded; empty if there's none."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf'(?is)"{name}"\s*:\s*"((?:\\.|[^"\\])*)"'), 1)
    return _longest(F.transform(raw, lambda x: text.normalize_space(F.coalesce(F.get_json_object(F.concat(F.lit('{"x":"'), x, F.lit('"}')), "$.x"), F.lit("")))))


# Last parts of sections' addresses, parts of pages that are no articles, and parts that tell finance from the rest.
SECTION_TAILS = ("business", "markets", "market", "companies", "economy", "finance", "invest", "stocks", "shares", "wealth", "bank", "banks", "topic", "news", "opinion", "analysis", "live")
NO_ARTICLE = ("author", "authors", "topic", "topics", "tag", "tags", "profile", "profiles", "newsletter", "newsletters", "about", "contact", "events", "login", "account", "subscribe", "membership")
FINANCE = ("/business", "/markets", "/market", "/companies", "/economy", "/finance", "/invest", "/stocks", "/shares", "/wealth", "/bank", "/briefing")
OTHER_TOPICS = ("/sport", "/sports", "/weather", "/travel", "/entertainment", "/culture", "/lifestyle", "/food", "/video")
DATED = r"/\d{4}/\d{2}/\d{2}/"


def _path(url: Column) -> tuple[Column, Column, Column]:
    path = F.lower(F.regexp_extract(urls.canonical(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return path, parts, F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def is_no_article(url: Column) -> Column:
    _, parts, _ = _path(url)
    return (F.size(parts) == 0) | F.arrays_overlap(parts, F.array(*map(F.lit, NO_ARTICLE)))


def is_article(url: Column) -> Column:
    """An address with a date or a number in its last part, or deep and worded; sections aren't."""
    path, parts, last = _path(url)
    own_form = last.rlike(r"-\d{8}-p[a-z0-9]+$") | path.rlike(DATED)
    general = path.rlike(DATED) | path.rlike(r"\d{4}-\d{2}-\d{2}") | ((F.size(parts) >= 3) & last.rlike(r"\d")) | ((F.size(parts) >= 4) & last.contains("-") & (F.length(last) >= 24))
    host = urls.host(url)
    return (F.size(parts) > 0) & ~last.isin(*SECTION_TAILS) & F.when((host == "afr.com") | host.endswith(".afr.com"), own_form).otherwise(general)


def is_finance(url: Column) -> Column:
    path, _, _ = _path(url)
    said = lambda words: path.rlike("|".join(words))
    return ~said(OTHER_TOPICS) & said(FINANCE)


def article_priority(url: Column) -> Column:
    """How likely an address is an article: depth, numbers and worded ends speak for it, sections and other pages against it."""
    path, parts, last = _path(url)
    n = F.size(parts)
    points = [
        (is_no_article(url), -100), (last.isin(*SECTION_TAILS), -20), (n >= 4, 4), (n == 3, 2), (path.rlike("/live-coverage/"), 5), (last.rlike("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), 6), (last.rlike(r"\d"), 2), (last.contains("-") & (F.length(last) >= 24), 2),
    ]
    total = reduce(lambda t, p: t + F.when(p[0], p[1]).otherwise(0), points, F.lit(0))
    deep = F.when(n >= 3, 3).otherwise(-12)
    return total + F.when(urls.host(url) == "theaustralian.com.au", deep).otherwise(0)


# Query parameters that collectors leave out besides utm_ ones.
COLLECTOR_PARAMS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url")


def collector_url(url: Column) -> Column:
    """As ``urls.canonical``, but ports go and fewer parameters: those named and utm_."""
    return F.regexp_replace(urls.canonical(url, COLLECTOR_PARAMS, ("utm_",)), r"^([a-z][a-z0-9+.-]*://[^/?#:]+):\d+", "$1")


# Words of titles and names that tell kinds of documents.
HALF, ANNUAL, QUARTER = ("half year", "half-year", "interim"), ("annual", "full year", "year ended", "annual report"), ("quarterly", "quarter", "activities", "cashflow", "cash flow", "production")


def document_class(title: Column) -> Column:
    """struct(doc_class, doc_subtype) by a document's title."""
    t = F.lower(F.coalesce(title, F.lit("")))
    said = lambda words: t.rlike("|".join(words))
    rules = ((said(["appendix 4c"]), "quarterly", "4C"), (said(["appendix 4d"]), "half_year", "4D"), (said(["appendix 4e"]), "annual", "4E"), (said(HALF), "half_year", "report"), (said(ANNUAL), "annual", "report"), (said(QUARTER), "quarterly", "activities"))
    one = lambda a, b: F.struct(F.lit(a).alias("doc_class"), F.lit(b).alias("doc_subtype"))
    return reduce(lambda rest, r: F.when(r[0], one(r[1], r[2])).otherwise(rest), reversed(rules), one("quarterly", "other"))


# Kinds of announcements in the order that breaks ties, and the words of their titles and of results' texts.
ANNOUNCEMENTS = {
    "financial_performance": ("appendix 4c", "appendix 4d", "appendix 4e", "quarterly report", "quarterly activities", "annual report", "half year", "half-year", "interim report", "financial report", "results", "preliminary final report"),
    "operations_projects": ("activities report", "operational update", "production report", "resource update", "drilling update", "guidance", "project update", "trading update"),
    "ownership_and_holders": ("substantial holder", "substantial holding", "becoming a substantial holder", "ceasing to be a substantial holder", "change in substantial holding", "change in director's interest"),
    "management_and_governance": ("change of director", "appointment of director", "resignation of director", "executive", "leadership", "ceo", "cfo", "notice of meeting", "proxy", "agm", "annual general meeting", "corporate governance", "constitution"),
    "capital_structure_securities": ("appendix 2a", "appendix 2b", "appendix 3x", "appendix 3y", "appendix 3z", "application for quotation", "quotation of securities", "issue of securities", "unquoted securities", "cleansing notice"),
    "investor_communications": ("investor presentation", "presentation", "webinar", "conference", "investor day"),
    "regulatory_status": ("trading halt", "suspension", "reinstatement", "asx release"),
}
RESULT_WORDS = ("income statement", "balance sheet", "cash flow", "operating cash", "revenue", "ebitda", "earnings per share", "net profit")


def _count(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda t, w: t + F.contains(x, F.lit(w)).cast("int"), words, F.lit(0))


def announcement(title: Column, doc_class: Column, subtype: Column, excerpt: Column) -> Column:
    """struct(kind, score): by form or class, else by most words of the title, else by the text; three points a structural sign, two a title word, one a text word."""
    t, kind, sub, x = (F.lower(F.trim(F.coalesce(v, F.lit("")))) for v in (title, doc_class, subtype, excerpt))
    formal = sub.isin("4c", "4d", "4e") | t.rlike("appendix 4[cde]") | kind.isin("annual", "half_year")
    counts = F.array(*[F.struct((-_count(t, words)).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(ANNOUNCEMENTS.items())])
    best = F.array_min(counts)
    texts = _count(x, RESULT_WORDS)
    label = F.when(formal, "financial_performance").when(best["n"] < 0, best["name"]).when(texts > 0, "financial_performance").otherwise("other")
    score = F.when(formal, 3).otherwise(-2 * best["n"]) + texts
    return F.struct(label.alias("kind"), score.alias("score"))


def document_type(name: Column, body: Column) -> Column:
    """textbook, presentation, annual_report, research or announcement, by a file's name and the first 4000 characters of its text."""
    n, head = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4000))
    return (
        F.when(n.rlike("textbook|university edition|edition|playbook|ift-notes|notes") | head.rlike("research foundation|isbn|chapter |monograph"), "textbook")
        .when(n.rlike("presentation"), "presentation")
        .when(n.rlike("annual-report|financial-report|half-year|half year|appendix-4e|appendix-4d|appendix 4e|appendix 4d"), "annual_report")
        .when(n.rlike("research|journal|study|analysis"), "research")
        .otherwise("announcement")
    )


def is_type(actual: Column, target: Column, said: Column) -> Column:
    """Whether a chunk is of the wanted type: by its own, else for announcements and annual reports by what title and file say."""
    a, t, hay = F.lower(F.trim(F.coalesce(actual, F.lit("other")))), F.lower(F.trim(F.coalesce(target, F.lit("")))), F.replace(F.lower(said), F.lit("_"), F.lit("-"))
    annual = hay.rlike("annual[- ]report|financial[- ]report|appendix[- ]4[de]|half[- ]year[- ]accounts|half[- ]yearly[- ]report")
    return (t == "") | (a == t) | ((t == "announcement") & F.contains(hay, F.lit("announcement"))) | ((t == "annual_report") & annual)


def day_in_range(day: Column, first: Column, last: Column) -> Column:
    """Whether a day (text) is within bounds, empty ones open; an empty day only if neither is set."""
    d, a, b = (F.coalesce(x, F.lit("")) for x in (day, first, last))
    return F.when(d == "", (a == "") & (b == "")).otherwise(((a == "") | (d >= a)) & ((b == "") | (d <= b)))


# Weights of words in re-ranking, and words that don't count.
RERANK_WEIGHTS = {"results": 0.025, "announcement": 0.022, "presentation": 0.022, "report": 0.018, "appendix": 0.018, "annual": 0.016, "financial": 0.014, "dividend": 0.025, "buy": 0.012, "back": 0.012}
RERANK_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with", "fy", "hy", "h1", "q1", "q2", "q3", "q4")


def lexical_bonus(query: Column, said: Column) -> Column:
    """Points for the words a query shares with a chunk's title, file and kind, and for results and dividends asked for or not."""
    words = lambda x: F.array_distinct(F.filter(F.regexp_extract_all(F.replace(F.lower(x), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(*RERANK_STOPWORDS)))
    q, h = words(query), words(said)
    weight = lambda w: reduce(lambda rest, p: F.when(w == p[0], p[1]).otherwise(rest), RERANK_WEIGHTS.items(), F.lit(0.006))
    shared = F.aggregate(F.array_intersect(q, h), F.lit(0.0), lambda t, w: t + weight(w))
    asks, has = lambda w: F.array_contains(q, w), lambda w: F.array_contains(h, w)
    nudge = F.when(asks("results") & asks("announcement") & has("results"), 0.05).otherwise(0.0) - F.when(asks("results") & has("dividend") & ~has("results"), 0.08).otherwise(0.0)
    nudge = nudge + F.when(asks("dividend") & has("dividend"), 0.05).otherwise(0.0) - F.when(asks("dividend") & has("results") & ~has("dividend"), 0.03).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(h) == 0), 0.0).otherwise(shared + nudge)


# Words of sentences that state facts, and the forms of numbers and dates in them.
FACT_TERMS = ("revenue", "ebit", "ebitda", "npat", "profit", "loss", "cash", "cashflow", "cash flow", "liquidity", "debt", "refinanc", "maturity", "covenant", "dividend", "guidance", "margin", "capex", "facility", "borrow")
FACT_NUMBER = r"(?i)[$€£¥]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:bn|billion|m|million|k|%|bps|bp))?|\b\d[\d,]*(?:\.\d+)?\s?(?:%|bps|bp|bn|billion|m|million|k)?\b"
FACT_DATE = r"\b20\d{2}-\d{2}-\d{2}\b|\b\d{1,2}\s+[A-Za-z]{3,9}\s+20\d{2}\b|\b[A-Za-z]{3,9}\s+\d{1,2},\s*20\d{2}\b"


def fact_sentences(x: Column, most: int = 3) -> Column:
    """array<struct<claim, numbers, dates, terms>>: the first sentences of 40 characters or more with a finance word and a number or date."""
    sentences = F.transform(F.split(text.normalize_space(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s))

    def row(s: Column) -> Column:
        low = F.lower(s)
        terms = F.array_sort(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in FACT_TERMS])))
        return F.struct(F.substring(s, 1, 360).alias("claim"), F.slice(F.transform(F.regexp_extract_all(s, F.lit(FACT_NUMBER), 0), lambda n: F.trim(n)), 1, 4).alias("numbers"), F.slice(F.regexp_extract_all(s, F.lit(FACT_DATE), 0), 1, 3).alias("dates"), F.slice(terms, 1, 4).alias("terms"))

    rows = F.transform(F.filter(sentences, lambda s: F.length(s) >= 40), row)
    return F.slice(F.filter(rows, lambda r: (F.size(r["terms"]) > 0) & ((F.size(r["numbers"]) > 0) | (F.size(r["dates"]) > 0))), 1, most)


def ranked_urls(addresses: Column, preferred: list[str]) -> Column:
    """Addresses with those of preferred domains first, each in the order given."""
    liked = lambda u: reduce(lambda out, p: out | (urls.host(u) == p) | urls.host(u).endswith(f".{p}"), preferred, F.lit(False))
    return F.concat(F.filter(addresses, liked), F.filter(addresses, lambda u: ~liked(u)))


# Words that names of companies end in, and words that don't count in their initials.
SUFFIXES = ("limited", "ltd", "group", "holdings", "corporation")
NO_INITIAL = ("the", "and", "of", "for", "to", "in", "on", "at", "by", "a", "an", "limited", "ltd", "group")


def short_names(name: Column) -> Column:
    """Distinct shorter forms of a company's name: without article, brackets, geography, marks, and its suffixes; never short capitals."""
    base = text.normalize_space(name)
    clean = lambda x: F.btrim(text.normalize_space(x), F.lit(" .,:;/-_"))
    bare = lambda x, words: clean(F.regexp_replace(x, rf"(?i)(?:[\s.,]+(?:{'|'.join(words)})[.,]?)+$", ""))
    forms = F.array(
        clean(F.regexp_replace(base, r"(?i)^\s*the\s+", "")), clean(F.regexp_replace(base, r"\([^)]*\)", " ")), clean(F.regexp_replace(base, r"(?i)\b(?:australia|australian)\b", " ")),
        bare(base, SUFFIXES[:2]), bare(base, SUFFIXES[:3]), bare(base, (*SUFFIXES[:2], "holdings")), bare(base, (*SUFFIXES[:2], "corporation")), bare(base, SUFFIXES), clean(F.regexp_replace(base, "[.,;:()]+", " ")),
    )
    return F.array_distinct(F.filter(forms, lambda x: (x != "") & (F.lower(x) != F.lower(base)) & ~x.rlike("^[A-Z0-9]{1,3}$")))


def acronym(name: Column) -> Column:
    """Initials of a name's words, articles and company forms left out; empty unless four to eight."""
    words = F.filter(F.regexp_extract_all(name, F.lit("[A-Za-z]+"), 0), lambda w: ~F.lower(w).isin(*NO_INITIAL))
    made = F.array_join(F.transform(words, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.length(made).between(4, 8) & (F.size(F.regexp_extract_all(name, F.lit("[A-Za-z]+"), 0)) >= 2), made).otherwise(F.lit(""))
