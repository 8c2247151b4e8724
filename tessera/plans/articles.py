"""Registered queries of news items and documents: items whose right results are written out by hand, dealt over the orders, and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import articles as fa
from ..functions import dates, text
from ..operators import linking
from .common import expected_sql, scenarios, table

c = F.col


def _cases(spark, d, rows, names, kinds=None):
    return scenarios(spark, d, [dict(zip(names, r if isinstance(r, tuple) else (r,), strict=False)) for r in rows], kinds or ", ".join(f"{n} string" for n in names))


BLOBS = [("|BHP|rio|", "BHP,RIO", "|BHP|RIO|"), ("cba, WBC;anz", "CBA,WBC,ANZ", "|ANZ|CBA|WBC|"), ('["BHP", "CEO", "bhp"]', "BHP", "|BHP|"), ("BRK.B/XYZ-A", "BRK.B,XYZ-A", "|BRK.B|XYZ-A|"), ("TOOLONGSYMBOL1", "", ""), ("", "", ""), (None, "", "")]


def ticker_blobs(spark, d):
    r = _cases(spark, d, BLOBS, ("raw",))
    t = fa.listed_tickers(c("raw"))
    return r.select("o_orderkey", F.array_join(t, ",").alias("tickers"), fa.blob(t).alias("blob"))


PLAIN = [("|BHP|rio|", "BHP,RIO", "|BHP|RIO|"), ("cba, WBC;anz", "ANZ,CBA,WBC", "|ANZ|CBA|WBC|"), ("BRK.B", "BRKB", "|BRKB|"), ("", "", "")]


def ticker_sets(spark, d):
    r = _cases(spark, d, PLAIN, ("raw",))
    t = text.ticker_blob(c("raw"))
    return r.select("o_orderkey", F.array_join(t, ",").alias("tickers"), text.serialize_tickers(t).alias("blob"))


INFERRED = [
    ("BHP up", "Shares in ASX: BHP and $RIO rose", "", "RIO,BHP"), ("CEO on EPS", "The (CBA.AX) result; NYSE:CEO", "WBC", "WBC,CBA"), ("Miners FMG gain", "No symbols here", "", "FMG"), ("nothing", "at all", "", ""), ("NASDAQ-TSLA", "$GDP falls", "tsla", "TSLA"),
]


def ticker_inference(spark, d):
    r = _cases(spark, d, INFERRED, ("title", "body", "existing"))
    t = fa.inferred_tickers(c("title"), c("body"), fa.listed_tickers(c("existing")), F.array(F.lit("FMG"), F.lit("WDS")))
    return r.select("o_orderkey", F.array_join(t, ",").alias("expected"))


TITLES = [
    ("A first line that is a title\nThe body follows here.", "", "A first line that is a title", "The body follows here."), ("Short\nBody text", "", "Short", "Body text"), ("Given title and then the body text", "Given title", "Given title", "and then the body text"),
    ("Body only", "Another title", "Another title", "Body only"), ("", "Title alone", "Title alone", ""), ("One\r\n\r\n\r\n\r\nTwo", "", "One", "Two"), (None, None, "", ""),
]


def title_split(spark, d):
    r = _cases(spark, d, TITLES, ("raw", "given"))
    return r.select("o_orderkey", fa.title_and_body(c("raw"), c("given")).alias("t")).select("o_orderkey", "t.title", "t.body")


DOMAINS = [("abc.net.au", "x", "https://y.com", "abc.net.au"), ("", "www.Reuters.com", "", "reuters.com"), ("", "The Age", "https://www.theage.com.au:443/a", "theage.com.au:443"), (None, None, "no address", ""), ("", "a b.c", "http://x.org/p", "x.org")]


def source_domains(spark, d):
    r = _cases(spark, d, DOMAINS, ("domain", "source", "url"))
    return r.select("o_orderkey", fa.source_domain(c("domain"), c("source"), c("url")).alias("expected"))


STAMPS = [
    ("20240102030405", "2024-01-02T03:04:05Z"), ("20240102T030405Z", "2024-01-02T03:04:05Z"), ("1704164645", "2024-01-02T03:04:05Z"), ("1704164645000", "2024-01-02T03:04:05Z"), ("2024-01-02", "2024-01-02T00:00:00Z"), ("2024/01/02 03:04:05", "2024-01-02T03:04:05Z"),
    ("2024-01-02T03:04:05+10:00", "2024-01-01T17:04:05Z"), ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02T03:04:05Z"), ("Tue, 2 Jan 2024 03:04:05 +0100", "2024-01-02T02:04:05Z"), ("yesterday", None), ("", None),
]


def published_times(spark, d):
    r = _cases(spark, d, STAMPS, ("raw",))
    return r.select("o_orderkey", dates.utc_text(dates.parse_utc(c("raw"))).alias("stamp"), fa.iso_day(c("raw")).alias("day"))


HOME = [("Australia", "", True), ("US", "https://www.abc.net.au/x", True), ("au", "", True), ("", "smh.com.au", True), ("US", "https://bbc.com/au", False), (None, None, False)]


def home_rows(spark, d):
    r = _cases(spark, d, HOME, ("country", "address"))
    return r.select("o_orderkey", fa.from_australia(F.array("country"), F.array("address")).alias("expected"))


COMPANY = [("BHP Group lifts output", "", True), ("Miner", "shares of Rio-Tinto, the miner", True), ("BHP Groups", "", False), ("", "", False)]


def company_names(spark, d):
    r = _cases(spark, d, COMPANY, ("title", "body"))
    return r.select("o_orderkey", fa.names_company(c("title"), c("body"), F.array(F.lit("bhp group"), F.lit("rio tinto"))).alias("expected"))


_LONG = "the market was up and the shares of miners rose in the session as it is with a rally that has been on for weeks to the end of it"
DROPPED = [(_LONG, "BHP", "ok"), ("too short", "BHP", "short_text"), ("der markt war heute sehr stark gestiegen " * 5, "", "non_english"), (_LONG, "XYZ", "ticker_not_allowlisted"), (_LONG, "", "ok")]


def drop_reasons(spark, d):
    r = _cases(spark, d, DROPPED, ("body", "tickers"))
    return r.select("o_orderkey", fa.drop_reason(c("body"), fa.listed_tickers(c("tickers")), F.array(F.lit("BHP"))).alias("expected"))


ITEMS = [
    ("g1", "Title", "https://www.a.com/x?utm_source=1", "text", "", "2024-01-02", "a.com", None, "g1", "https://a.com/x"), ("", "", "", "text", "", "2024-01-02", "", "missing_identity", None, ""), ("", "Title", "", "", "desc", "", "", "missing_published_at", None, ""),
    ("", "Title", "b.com", "t", "", "soon", "", "invalid_published_at", None, "https://b.com/"), (None, "Title", "https://c.com/", "t", "", "20240102030405", "", None, "*", "https://c.com/"),
]


def feed_candidates(spark, d):
    """Ids made of address, title and time are given as a star."""
    names = ("id", "title", "url", "body", "description", "published", "source")
    r = _cases(spark, d, ITEMS, names)
    x = fa.candidate("gdelt", {n: c(n) for n in names}, F.lit("2024-01-03T00:00:00Z"))
    made = F.concat(F.lit("gdelt_"), F.substring(F.sha1(F.concat_ws("|", "x.canonical_url", "x.title", "x.published_at")), 1, 24))
    r = r.select("o_orderkey", x.alias("x"))
    return r.select("o_orderkey", "x.reject_reason", F.when(c("x.provider_item_id") == made, "*").otherwise(c("x.provider_item_id")).alias("item_id"), "x.canonical_url")


SCRAPED = [("Title", "https://a.com/x", "text", "", None, "2024-01-03T00:00:00Z"), ("", "", "text", "", "missing_identity", "2024-01-03T00:00:00Z"), ("Title", "", "", "2024-01-02", "missing_text", "2024-01-02T00:00:00Z"), ("Title", "", "text", "2024-01-02", None, "2024-01-02T00:00:00Z")]


def scraped_candidates(spark, d):
    r = _cases(spark, d, SCRAPED, ("title", "url", "body", "published"))
    item = {n: c(n) for n in ("title", "url", "body", "published")} | {n: F.lit("") for n in ("id", "description", "source")}
    x = fa.candidate("newspaper4k", item, F.lit("2024-01-03T00:00:00Z"))
    return r.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.reject_reason", "x.published_at")


POSTURES = [(None, "2024-01-02", "missing_posture_payload", None), ({"theaterName": "", "shortName": "", "theaterId": "", "headline": "", "summary": ""}, "2024-01-02", "missing_identity", None), ({"theaterName": "North", "shortName": "", "theaterId": "", "headline": "calm", "summary": ""}, "", None, "WorldMonitor theater posture: North - calm")]


def posture_candidates(spark, d):
    kinds = "posture struct<theaterName: string; shortName: string; theaterId: string; headline: string; summary: string>, timestamp string"
    r = scenarios(spark, d, [{"posture": p, "timestamp": t} for p, t, *_ in POSTURES], kinds)
    x = fa.posture(F.struct("posture", "timestamp"), F.lit("2024-01-03T00:00:00Z"))
    return r.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.reject_reason", "x.title")


PAGES = [
    ('<meta name="description" content="Short"><meta property="og:description" content="A longer one &amp; more">', "A longer one & more"), ("<META content='Only &quot;this&quot;' name='sailthru.description'>", 'Only "this"'), ('<meta name="keywords" content="a,b">', ""), ("", ""),
]


def page_descriptions(spark, d):
    r = _cases(spark, d, PAGES, ("html",))
    return r.select("o_orderkey", fa.meta_description(c("html")).alias("expected"))


def meta_description(spark, d):
    """Of the pages themselves."""
    p = table(spark, d, "pages")
    return p.select("page_id", fa.meta_description(c("html")).alias("description"))


LINKED = [('{"articleBody": "One \\"two\\" three"}', 'One "two" three'), ('{"articleBody":"a"} {"articleBody" : "a longer\\nbody"}', "a longer body"), ("none", "")]


def linked_bodies(spark, d):
    r = _cases(spark, d, LINKED, ("html",))
    return r.select("o_orderkey", fa.jsonld_body(c("html")).alias("expected"))


URLS = [
    ("https://x.com.au/markets/2024/01/02/miners-lead", True, False, True, 4), ("https://x.com.au/markets", False, False, True, -20), ("https://x.com.au/author/jane-doe-1", False, True, False, -98), ("https://www.afr.com/companies/miner-20240102-p5abc", True, False, True, 2),
    ("https://x.com.au/sport/markets/a-very-long-title-of-an-article", False, False, False, 4), ("https://x.com", False, True, False, -100), ("https://theaustralian.com.au/business/x", False, False, True, -12),
]


def url_tests(spark, d):
    r = _cases(spark, d, URLS, ("url",))
    return r.select("o_orderkey", fa.is_article(c("url")).alias("article"), fa.is_no_article(c("url")).alias("other"), fa.is_finance(c("url")).alias("finance"), fa.article_priority(c("url")).alias("priority"))


def link_candidates(spark, d):
    """Links of every page by priority, then length of address, the best ten."""
    from pyspark.sql import Window

    found = table(spark, d, "pages").select("page_id", F.posexplode(text.links(c("html"))).alias("place", "link"))
    full = F.when(c("link").contains("://"), c("link")).otherwise(F.concat(F.lit("https://site.example/"), F.regexp_replace("link", "^/+", "")))
    found = found.select("page_id", "place", "link", fa.article_priority(full).alias("priority"))
    w = Window.partitionBy("page_id").orderBy(F.desc("priority"), F.desc(F.length("link")), "place")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("page_id", "link", "priority", c("rank").cast("long").alias("rank"))


COLLECTED = [("HTTP://www.X.com:8080/a/?b=2&a=1&utm_id=3#f", "http://x.com/a?a=1&b=2"), ("x.com/?amp=1&ref=2", "https://x.com/?amp=1"), ("", ""), ("https://x.com/a?q=a%20b&q=A", "https://x.com/a?q=A&q=a+b")]


def collector_urls(spark, d):
    r = _cases(spark, d, COLLECTED, ("url",))
    return r.select("o_orderkey", fa.collector_url(c("url")).alias("expected"))


CLASSES = [
    ("Appendix 4C - quarterly", "quarterly", "4C"), ("Appendix 4E", "annual", "4E"), ("Half-Year Report", "half_year", "report"), ("Annual Report 2024", "annual", "report"), ("Quarterly Activities", "quarterly", "activities"), ("Notice of meeting", "quarterly", "other"), (None, "quarterly", "other"),
]


def document_classes(spark, d):
    r = _cases(spark, d, CLASSES, ("title",))
    return r.select("o_orderkey", fa.document_class(c("title")).alias("x")).select("o_orderkey", "x.doc_class", "x.doc_subtype")


NOTICES = [
    ("Appendix 4E", "", "", "revenue and ebitda", "financial_performance", 5), ("Anything", "annual", "", "", "financial_performance", 3), ("Investor Presentation and webinar", "", "", "", "investor_communications", 6), ("Change of director, appointment of director", "", "", "net profit", "management_and_governance", 5),
    ("Letter", "", "", "balance sheet", "financial_performance", 1), ("Letter", "", "", "", "other", 0), ("Results guidance", "", "", "", "financial_performance", 2),
]


def announcement_kinds(spark, d):
    names = ("title", "doc_class", "subtype", "excerpt")
    r = _cases(spark, d, NOTICES, names)
    return r.select("o_orderkey", fa.announcement(*[c(n) for n in names]).alias("x")).select("o_orderkey", "x.kind", "x.score")


TYPES = [("CFA-notes.pdf", "", "textbook"), ("x.pdf", "ISBN 1-2", "textbook"), ("investor-presentation.pdf", "", "presentation"), ("Half-Year accounts.pdf", "", "annual_report"), ("market study.pdf", "", "research"), ("asx.pdf", "", "announcement")]


def document_types(spark, d):
    r = _cases(spark, d, TYPES, ("name", "body"))
    return r.select("o_orderkey", fa.document_type(c("name"), c("body")).alias("expected"))


FILTERS = [("annual_report", "annual_report", "", "2024-05-01", True, True), ("annual_report", "announcement", "FY24 results-announcement.pdf", "2024-07-01", True, False), ("announcement", "annual_report", "Appendix_4E.pdf", "", True, False), ("other", "research", "x", "2024-01-01", False, True), (None, "", "x", "2023-12-31", True, False)]


def chunk_filters(spark, d):
    r = _cases(spark, d, FILTERS, ("actual", "target", "said", "day"))
    return r.select("o_orderkey", fa.is_type(c("actual"), c("target"), c("said")).alias("typed"), fa.day_in_range(c("day"), F.lit("2024-01-01"), F.lit("2024-06-30")).alias("dated"))


BONUSES = [("results announcement", "FY24 results announcement", 0.097), ("dividend", "dividend_notice.pdf", 0.075), ("results", "dividend", -0.08), ("dividend", "annual results", -0.03), ("mining output", "mining report", 0.006), ("", "x", 0.0)]


def lexical_bonuses(spark, d):
    r = _cases(spark, d, BONUSES, ("query", "said"))
    return r.select("o_orderkey", F.round(fa.lexical_bonus(c("query"), c("said")), 6).alias("expected"))


FACTS = [
    ("Revenue rose 12% to $5.2 billion in the year to 30 June 2024. It was fine. The company said that it would keep on looking for options.", 1, "Revenue rose 12% to $5.2 billion in the year to 30 June 2024.", "12|$5.2 billion|30|2024", "30 June 2024", "revenue"), ("No facts.", 0, None, None, None, None),
    ("The dividend of the group, paid out of cash, was cut by 10 bps on 2024-01-02.", 1, "The dividend of the group, paid out of cash, was cut by 10 bps on 2024-01-02.", "10 bps|2024|01|02", "2024-01-02", "cash|dividend"),
]


def fact_rows(spark, d):
    r = _cases(spark, d, FACTS, ("text",))
    f = fa.fact_sentences(c("text"))
    one = F.try_element_at(f, F.lit(1))
    return r.select("o_orderkey", F.size(f).alias("n"), one["claim"].alias("claim"), F.array_join(one["numbers"], "|").alias("numbers"), F.array_join(one["dates"], "|").alias("dates"), F.array_join(one["terms"], "|").alias("terms"))


def preferred_urls(spark, d):
    """Addresses of each hundred pages, those of two liked hosts first."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"])
    p = table(spark, d, "pages").groupBy(F.floor(c("page_id") / 100).alias("batch")).agg(every.alias("urls"))
    return p.select("batch", F.sha1(F.array_join(fa.ranked_urls(c("urls"), ["example.com"]), "\n")).alias("order_sha1"))


NAMES = [("The Widget Group Limited", "", "Widget Group Limited|The Widget Group|The Widget"), ("Bank of New South Wales Ltd.", "BNSW", "Bank of New South Wales Ltd|Bank of New South Wales"), ("Acme (Australia) Holdings Ltd", "", "Acme Holdings Ltd|Acme ( ) Holdings Ltd|Acme (Australia) Holdings|Acme (Australia)|Acme Australia Holdings Ltd"), ("BHP", "", "")]


def company_aliases(spark, d):
    r = _cases(spark, d, NAMES, ("name",))
    return r.select("o_orderkey", fa.acronym(c("name")).alias("acronym"), F.array_join(fa.short_names(c("name")), "|").alias("aliases"))


IDENTITY = [
    ("BHP", "Output up", "Shares of BHP Group rose", "BHP Group", False, "strong"), ("BHP", "BHP Group up", "short", "BHP Group", True, "medium"), ("BHP", "BHP Group up", "short", "BHP Group", False, "strong"), ("BHP", "x", "ASX: BHP rose", "", False, "medium"), ("BHP", "x", "(BHP.AX)", "Big Co", False, "medium"),
    ("BHP", "x", "BHP rose", "Big Co", False, "ambiguous"), ("BHP", "x", "BHP rose", "", False, "weak"), ("WXYZ", "x", "WXYZ rose", "", False, "ambiguous"), ("BHP", "x", "BHPX rose", "", False, "none"), ("", "x", "y", "", False, "none"),
]


def identity_strength(spark, d):
    r = _cases(spark, d, IDENTITY, ("symbol", "title", "body", "name", "home"), "symbol string, title string, body string, name string, home boolean")
    s = linking.identity_strength(c("symbol"), c("title"), c("body"), F.array("name"), c("home"))
    return r.select("o_orderkey", s.alias("expected"))


RANKS = [("|BHP|RIO|", "", "", "BHP", 1), ("BHP", "", "", "bhp", 1), ("|BHPX|", "ASX-BHP", "", "BHP", 2), ("", "", "bhp.ax", "BHP", 2), ("", "on BHP today", "", "BHP", 3), ("", "BHPX", "", "BHP", 0), (None, None, None, "", 0)]


def match_ranks(spark, d):
    r = _cases(spark, d, RANKS, ("blob", "title", "body", "symbol"))
    return r.select("o_orderkey", linking.match_rank(c("blob"), c("title"), c("body"), c("symbol")).alias("expected"))


HEADS = [("REVIEW OF OPERATIONS & OUTLOOK", True), ("Review of the Operations", False), ("Directors' Report:", True), ("we did this and that in the year", False), ("", False), ("Profit", True), ("x" * 120, False), ("A B", False)]


def headings(spark, d):
    r = _cases(spark, d, HEADS, ("line",))
    return r.select("o_orderkey", text.heading(c("line")).alias("expected"))


def near_hashes(spark, d):
    """Near hashes of title, description and the body's first 3000 characters."""
    from ..operators import news

    t = table(spark, d, "documents")
    return t.select("doc_id", news.vote_hash(F.concat_ws("\n", "source", "lang", F.substring("text", 1, 3000))).alias("near_hash"))


FIRSTS = [("", "  ", "c", "c"), ("a", "b", "c", "a"), (None, "b ", None, "b"), (None, None, None, None)]


def first_filled(spark, d):
    r = _cases(spark, d, FIRSTS, ("x", "y", "z"))
    return r.select("o_orderkey", text.first_non_empty(c("x"), c("y"), c("z")).alias("expected"))


def _sql():
    from .texts import _NORM

    e = lambda rows, *names: expected_sql([r[-len(names):] for r in rows], names=names)
    near = _NORM.format("concat_ws(chr(10), source, lang, substr(text, 1, 3000))")
    bits = ", ".join(f"case when sum(case when (h >> {b}) & 1 = 1 then n else -n end) >= 0 then {1 << b}::ubigint else 0::ubigint end as b{b}" for b in range(64))
    return {
        "ticker_blobs": e(BLOBS, "tickers", "blob"), "ticker_sets": e(PLAIN, "tickers", "blob"), "ticker_inference": e(INFERRED, "expected"), "title_split": e(TITLES, "title", "body"), "source_domains": e(DOMAINS, "expected"),
        "published_times": expected_sql([(s, (s or "")[:10]) for _, s in STAMPS], names=("stamp", "day")), "home_rows": e(HOME, "expected"), "company_names": e(COMPANY, "expected"), "drop_reasons": e(DROPPED, "expected"),
        "feed_candidates": e(ITEMS, "reject_reason", "item_id", "canonical_url"), "scraped_candidates": e(SCRAPED, "reject_reason", "published_at"), "posture_candidates": e(POSTURES, "reject_reason", "title"), "page_descriptions": e(PAGES, "expected"),
        "meta_description": """with m as (select page_id, unnest(regexp_extract_all(html, '(?is)<meta\\s+[^>]*>')) as tag from pages), a as (select page_id, lower(trim(regexp_extract(tag, '(?i)\\sname\\s*=\\s*["'']([^"'']*)["'']', 1))) as name, lower(trim(regexp_extract(tag, '(?i)\\sproperty\\s*=\\s*["'']([^"'']*)["'']', 1))) as prop, regexp_extract(tag, '(?i)\\scontent\\s*=\\s*["'']([^"'']*)["'']', 1) as content from m), p as (select page_id, arg_max(content, length(content)) as d from a where name in ('description', 'twitter:description') or prop in ('og:description', 'article:description') group by 1) select page_id, coalesce(d, '') as description from pages left join p using (page_id)""",
        "linked_bodies": e(LINKED, "expected"), "url_tests": e(URLS, "article", "other", "finance", "priority"), "collector_urls": e(COLLECTED, "expected"), "document_classes": e(CLASSES, "doc_class", "doc_subtype"), "announcement_kinds": e(NOTICES, "kind", "score"),
        "document_types": e(TYPES, "expected"), "chunk_filters": e(FILTERS, "typed", "dated"), "lexical_bonuses": e(BONUSES, "expected").replace("expected from", "cast(expected as double) as expected from"), "fact_rows": e(FACTS, "n", "claim", "numbers", "dates", "terms"),
        "preferred_urls": "with p as (select page_id // 100 as batch, page_id, url, regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^www\\.', '') as host from pages), r as (select *, (host = 'example.com' or host like '%.example.com') as liked from p) select batch, sha1(string_agg(url, chr(10) order by not liked, page_id)) as order_sha1 from r group by 1",
        "company_aliases": e(NAMES, "acronym", "aliases"), "identity_strength": e(IDENTITY, "expected"), "match_ranks": e(RANKS, "expected"), "headings": e(HEADS, "expected"), "first_filled": e(FIRSTS, "expected"),
        "near_hashes": f"with w as (select doc_id, token, count(*) as n from (select doc_id, unnest(string_split({near}, ' ')) as token from documents) where token <> '' group by 1, 2), h as (select doc_id, n, ('0x' || substr(sha256(token), 1, 16))::ubigint as h from w), v as (select doc_id, {bits} from h group by 1) select d.doc_id, case when v.doc_id is null then repeat('0', 16) else lpad(lower(printf('%x', " + " | ".join(f"b{b}" for b in range(64)) + ")), 16, '0') end as near_hash from documents d left join v on d.doc_id = v.doc_id",
    }


SQL = _sql()
ROWS_ONLY = ("link_candidates",)
QUERIES = {k: globals()[k] for k in (*SQL, *ROWS_ONLY)}
