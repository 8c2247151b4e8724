"""Registered queries of line-level rules over texts made of each row's own columns: dates, prices, names, addresses and whole documents.

The rules' hand-written cases (lists of ``plans.filings`` and ``plans.articles``) are run by the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import articles as fa
from ..functions import dates, numeric, text
from ..functions import filings as ff
from ..operators import extract, filings, linking
from ..session import spread
from .common import FACTS_SQL, facts, table
from .texts import SQL as TEXTS_SQL

c = F.col


def _orders(spark, d):
    """Orders with a day of this century, a whole price and the price with separators."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"), "o_orderkey")
    return o.select("o_orderkey", "o_custkey", c("o_orderpriority").alias("prio"), F.add_months("o_orderdate", 120).alias("day"), F.round("o_totalprice").cast("long").alias("price")).withColumns({"said": F.date_format("day", "d MMMM yyyy"), "figure": F.format_number("price", 0)})


_O = """with o as (select o_orderkey, o_custkey, o_orderpriority as prio, cast(o_orderdate + interval 10 year as date) as day, cast(round(o_totalprice) as bigint) as price from orders),
x as (select *, strftime(day, '%-d %B %Y') as said, format('{:,}', price) as figure from o) """


def _pick(key, *forms):
    """One of the forms by a key's residue."""
    out = F.lit(None)
    for n, form in reversed(list(enumerate(forms))):
        out = F.when(c(key) % len(forms) == n, form).otherwise(out)
    return out


def period_ends(spark, d):
    o = _orders(spark, d)
    label = _pick("o_orderkey", F.concat(F.lit("Year ended "), "said"), F.concat(F.lit("FY"), F.date_format("day", "yy")), F.concat(F.lit("Q"), F.quarter("day").cast("string"), F.lit(" "), F.year("day").cast("string")), F.year("day").cast("string"), F.concat(F.lit("Current quarter - "), "said"), F.concat(F.lit("Previous quarter - "), "said"))
    return o.select("o_orderkey", dates.period_end(label).alias("expected"))


def line_periods(spark, d):
    o = _orders(spark, d)
    year = F.year("day")
    before = F.date_format(F.last_day(F.add_months("day", -6)), "d MMMM yyyy")
    line = _pick("o_orderkey", F.concat(F.lit("For the year ended "), "said", F.lit(" and "), before), F.concat(F.lit("FY"), F.date_format("day", "yy"), F.lit(" against FY"), F.date_format(F.add_months("day", -12), "yy")), F.concat(year.cast("string"), F.lit(" "), (year - 1).cast("string")), F.concat(F.lit("Current quarter "), year.cast("string")))
    return o.select("o_orderkey", F.array_join(dates.period_labels(line), "|").alias("expected"))


def amount_rank(spark, d):
    o = _orders(spark, d)
    line = _pick("o_orderkey", F.concat(F.lit("2.1 Revenue from customers "), "figure", F.lit(" 11,200")), F.concat(F.lit("Revenue ("), "figure", F.lit(") 900")), F.concat(F.lit("Revenue US$"), "figure", F.lit("m in the half")), F.concat(F.lit("Revenue in "), F.year("day").cast("string")), F.concat(F.lit("Revenue for the Group of $"), F.format_string("%.3f", c("price") / 1000), F.lit(" million was up by 28%")))
    r = ff.ranked_amounts(o.withColumns({"line": line, "metric": F.lit("revenue")}), "line", "metric", ff.METRICS["revenue"])
    return r.select("o_orderkey", F.try_element_at("amounts", F.lit(1)).alias("b")).select("o_orderkey", "b.raw", F.round("b.value", 1).alias("value"))


def number_words(spark, d):
    o = _orders(spark, d)
    word = _pick("o_orderkey", c("figure"), F.concat(F.lit("("), "figure", F.lit(")")), F.concat(F.lit("US$"), "figure", F.lit("m")), F.concat((c("price") % 90 + 10).cast("string"), F.lit(".5%")), F.year("day").cast("string"), c("prio"))
    return o.select("o_orderkey", numeric.numeric_word(word).alias("w")).select("o_orderkey", "w.value_type", "w.value", "w.currency", "w.suffix", "w.minor")


def unit_hints(spark, d):
    o = _orders(spark, d)
    mark = _pick("o_custkey", F.lit("A$"), F.lit("US$"), F.lit("NZ$"), F.lit("$"))
    line = _pick("o_orderkey", F.concat(mark, F.lit("'000 "), "said"), F.concat(F.lit("in millions of "), mark, F.lit(" "), "figure"), F.concat(mark, F.lit(" "), "figure"), c("figure"))
    return o.select("o_orderkey", numeric.unit_multiplier(line).alias("multiplier"), numeric.currency_hint(line).alias("currency"))


def unit_applied(spark, d):
    o = _orders(spark, d)
    raw = _pick("o_orderkey", c("figure"), F.concat("figure", F.lit(" million")), F.concat("figure", F.lit("m")))
    metric, kind = _pick("o_custkey", F.lit("revenue"), F.lit("eps"), F.lit("ebit"), F.lit("revenue")), _pick("o_custkey", F.lit("amount"), F.lit("amount"), F.lit("amount"), F.lit("percent"))
    value = numeric.apply_multiplier(c("price").cast("double"), F.lit(1000.0), raw, (kind == "amount") & metric.isin(*ff.MONEY))
    return o.select("o_orderkey", value.alias("expected"))


def path_parts(spark, d):
    o = _orders(spark, d)
    kind = _pick("o_custkey", F.lit("annual"), F.lit("half"), F.lit("quarterly"))
    path = F.concat(F.lit("data/docs/C"), c("o_custkey").cast("string"), F.lit("/"), kind, F.lit("/"), c("day").cast("string"), F.lit(" "), c("o_orderkey").cast("string"), F.lit(".pdf"))
    return o.select("o_orderkey", ff.path_parts(path).alias("p")).select("o_orderkey", "p.company", "p.doc_type", "p.doc_date")


def published_times(spark, d):
    e = table(spark, d, "events").select("event_id", c("ts").cast("timestamp").alias("t"))
    seconds = F.unix_timestamp("t")
    raw = _pick("event_id", F.date_format("t", "yyyyMMddHHmmss"), F.date_format("t", "yyyyMMdd'T'HHmmss'Z'"), seconds.cast("string"), (seconds * 1000 + 7).cast("string"), F.date_format("t", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format("t", "yyyy/MM/dd HH:mm:ss"), F.lit("soon"))
    return e.select("event_id", dates.utc_text(dates.parse_utc(raw)).alias("stamp"), fa.iso_day(raw).alias("day"))


def drop_reasons(spark, d):
    t = table(spark, d, "documents")
    tickers = _pick("doc_id", F.array(F.lit("BHP")), F.array(F.lit("XYZ")), F.array().cast("array<string>"))
    return t.select("doc_id", fa.drop_reason(c("text"), tickers, F.array(F.lit("BHP"))).alias("expected"))


def source_domains(spark, d):
    p = table(spark, d, "pages")
    n = c("page_id").cast("string")
    domain = F.when(c("page_id") % 3 == 0, F.concat(F.lit(" D"), n, F.lit(".Com "))).otherwise("")
    source = F.when(c("page_id") % 3 == 1, F.concat(F.lit("www.S"), n, F.lit(".org"))).otherwise("The Source")
    return p.select("page_id", fa.source_domain(domain, source, c("url")).alias("expected"))


def home_rows(spark, d):
    p = table(spark, d, "pages")
    host = F.regexp_extract("url", r"//([^/?#:]+)", 1)
    address = F.concat(F.lit("https://"), host, F.when(c("page_id") % 5 == 0, ".au").otherwise(""), F.lit("/au"))
    country = _pick("page_id", F.lit("US"), F.lit(" australia "), F.lit("AU"), F.lit("NZ"), F.lit(None).cast("string"), F.lit("Austria"), F.lit(""))
    return p.select("page_id", fa.from_australia(F.array(country), F.array(address)).alias("expected"))


def _symbols(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("p"), c("p_partkey").cast("string")).alias("own"))
    bars, commas = F.concat(F.lit("|"), "own", F.lit("|"), "p_brand", F.lit("|")), F.concat("p_brand", F.lit(", "), "own", F.lit(";"), "p_brand")
    return p.withColumn("raw", _pick("p_partkey", bars, commas, F.concat(F.lit('["'), "own", F.lit('", "'), "p_brand", F.lit('", "CEO"]')), F.lit("")))


def ticker_blobs(spark, d):
    t = fa.listed_tickers(c("raw"))
    return _symbols(spark, d).select("p_partkey", F.array_join(t, ",").alias("tickers"), fa.blob(t).alias("blob"))


def ticker_sets(spark, d):
    r = _symbols(spark, d).withColumn("raw", F.when(c("raw").startswith("["), F.concat("own", F.lit("/"), "p_brand")).otherwise(c("raw")))
    t = text.ticker_blob(c("raw"))
    return r.select("p_partkey", F.array_join(t, ",").alias("tickers"), text.serialize_tickers(t).alias("blob"))


def ticker_inference(spark, d):
    o = _orders(spark, d)
    letters = lambda first, n: F.concat(F.lit(first), F.translate((n % 900 + 100).cast("string"), "0123456789", "KLMNPQRSTV"))
    a, b = letters("A", c("o_custkey")), letters("B", c("price"))
    title, body = F.concat(F.lit("Shares of ASX: "), a, F.lit(" fell")), F.concat(F.lit("while $"), b, F.lit(" rose, said the CEO on "), "said")
    t = fa.inferred_tickers(title, body, fa.listed_tickers(F.when(c("o_orderkey") % 2 == 0, a).otherwise("")))
    return o.select("o_orderkey", F.array_join(t, ",").alias("expected"))


def match_ranks(spark, d):
    o = _orders(spark, d)
    s = F.concat(F.lit("T"), c("o_custkey").cast("string"))
    blob = F.when(c("price") % 5 == 0, F.concat(F.lit("|X|"), s, F.lit("|"))).otherwise(F.concat(F.lit("|"), s, F.lit("9|")))
    title = F.when(c("price") % 5 == 1, F.concat(F.lit("asx - "), s)).otherwise(F.concat(s, F.lit("0 on "), "said"))
    body = F.when(c("price") % 5 == 2, F.concat(F.lit("("), F.lower(s), F.lit(".ax)"))).when(c("price") % 5 == 3, F.concat(F.lit("and "), s, F.lit(", too"))).otherwise("none")
    return o.select("o_orderkey", linking.match_rank(blob, title, body, s).alias("expected"))


def first_filled(spark, d):
    o = _orders(spark, d)
    x, y, z = F.when(c("price") % 3 == 0, c("said")).otherwise(" "), F.when(c("price") % 5 == 0, c("figure")), F.when(c("price") % 7 != 0, F.concat(c("prio"), F.lit(" "))).otherwise("")
    return o.select("o_orderkey", text.first_non_empty(x, y, z).alias("expected"))


def _identified(spark, d):
    """Whole documents that begin with what names a company, its symbol or neither."""
    s = F.concat(F.lit("Q"), (c("doc_id") % 50 + 10).cast("string"))
    begins = _pick("doc_id", F.lit("Quark Holdings "), F.concat(F.lit("ASX: "), s, F.lit(" ")), F.concat(F.lit("The "), s, F.lit(" share ")), F.concat(F.lit("("), s, F.lit(".AX) ")), F.lit(""))
    names = F.when(F.floor(c("doc_id") / 5) % 2 == 0, F.array(F.lit("Quark Holdings"))).otherwise(F.array().cast("array<string>"))
    r = table(spark, d, "documents").select("doc_id", s.alias("symbol"), c("source").alias("title"), F.concat(begins, F.coalesce("text", F.lit(""))).alias("body"), names.alias("names"))
    return r.select("doc_id", "symbol", linking.identity_strength(c("symbol"), c("title"), c("body"), c("names"), F.lit(False)).alias("expected"))


def identity_strength(spark, d):
    return _identified(spark, d).select("doc_id", "expected")


def identity_coverage(spark, d):
    """Articles of each symbol by how surely they are about it."""
    return _identified(spark, d).groupBy("symbol", c("expected").alias("strength")).agg(F.count("*").alias("n_articles"))


ROW_NAMES = {"revenue": ("Total revenue", "income_statement"), "ebitda": ("EBITDA", "income_statement"), "total_assets": ("Total assets", "balance_sheet"), "total_liabilities": ("Total liabilities", "balance_sheet")}


def _statement_rows(spark, d):
    """The facts as rows of statements; what is wrong with one follows from its company, period and confidence. Metrics without a label stand outside of tables."""
    f = facts(spark, d)
    named = lambda n: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, v in ROW_NAMES.items() for x in (m, v[n])]), c("metric")), F.lit(""))
    family = F.when(c("k") == 4, "cash_flow").otherwise(named(1))
    return f.select(
        "company", "metric", "ord", c("period"), F.when(c("k") == 1, "").otherwise(c("period")).alias("statement_period_end"), named(0).alias("row_label"), family.alias("statement_family"),
        F.when(c("k") == 2, "net assets disposed").otherwise("").alias("line"), F.concat("period", F.lit(" 30 June 2023 30 June 2022")).alias("table_header_text"), F.lit("Group").alias("statement_title"), F.lit("").alias("statement_scope_header"),
        F.when(c("k") == 3, "parent_statement").otherwise("consolidated_statement").alias("statement_scope"), (named(0) != "").alias("inside_table"), (c("k") == 5).alias("pro_forma"), F.when(c("conf") == 4, 2).otherwise(1).alias("label_hits"),
    )


def route_rows(spark, d):
    """How many facts go where and why."""
    return filings.route(_statement_rows(spark, d)).groupBy("metric", "reason", "route").agg(F.count("*").alias("n_rows"))


def scope_routes(spark, d):
    return filings.route(_statement_rows(spark, d)).select("company", "period", "ord", "reason", "route")


_ROUTED = FACTS_SQL + """, rt as (select company, period, ord, metric, case when metric not in ('revenue', 'ebitda', 'total_assets', 'total_liabilities') then 'not_inside_table' when k = 5 then 'pro_forma_context' when k = 2 then 'reconciliation_context' when k = 4 then 'metric_statement_mismatch'
  when conf = 4 then 'ambiguous_row_label' when k = 1 then 'missing_statement_period_end' when k = 3 then 'non_canonical_scope' else 'canonical' end as reason from facts),
rd as (select *, case reason when 'canonical' then 'canonical' when 'not_inside_table' then 'rejected' else 'context' end as route from rt) """


def _faults(spark, d):
    f = facts(spark, d).where(c("metric").isin("revenue", "ebit"))
    title = F.when(c("k") % 5 == 1, (c("k") + 1).cast("string")).when(c("k") % 5 == 2, F.concat(F.lit("Page "), c("k").cast("string"), F.lit(" of 30"))).otherwise("Income statement")
    label = F.when(c("conf") == 0, "").otherwise(F.lit("Revenue"))
    r = f.select("company", "ord", c("period").alias("at"), "metric", F.when(c("k") % 7 == 1, "").when(c("k") % 7 == 2, "Current quarter").otherwise(c("period")).alias("period"), F.when(c("k") % 4 == 1, F.lit(None)).otherwise(c("period")).alias("statement_period_end"), F.lit("").alias("balance_date"), title.alias("statement_title"), F.lit("").alias("line"), label.alias("row_label"))
    return r.withColumn("issues", filings.row_issues(r))


def row_issues(spark, d):
    """Issues of the facts of revenue and earnings as rows, of which some lack a period, an end, a label or a title."""
    return _faults(spark, d).select("company", "ord", c("at").alias("period"), F.array_join("issues", ",").alias("expected"))


def issue_multilabel(spark, d):
    return _faults(spark, d).select("metric", F.explode("issues").alias("issue")).groupBy("metric", "issue").agg(F.count("*").alias("n_rows"))


_ISSUES = FACTS_SQL + """, iq as (select company, ord, period, metric, array_to_string(list_filter([case when k % 7 = 1 then 'empty_period' end, case when k % 4 = 1 then 'empty_statement_period_end' end, case when k % 7 = 2 then 'relative_only_period' end,
  case when k % 5 = 1 then 'numeric_only_statement_title' end, case when k % 5 = 2 then 'page_footer_statement_title' end, case when conf = 0 then 'non_cash_missing_row_label' end, case when conf <> 0 and metric = 'ebit' then 'non_cash_label_metric_mismatch' end], lambda v: v is not null), ',') as expected
  from facts where metric in ('revenue', 'ebit')) """

_QE = "case when day = last_day(day) and month(day) % 3 = 0 then day else cast(date_trunc('quarter', day) as date) - 1 end"
_ENGLISH = TEXTS_SQL["english_heuristic"].replace("select lang, text, list_filter", "select doc_id, text, list_filter", 1)
_ENGLISH = _ENGLISH[: _ENGLISH.index(" select lang, english, count")].replace("e as (select lang,", "e as (select doc_id, text,", 1)


def _by(key: str, *forms: str) -> str:
    return f"case {key} % {len(forms)} " + " ".join(f"when {n} then {f}" for n, f in enumerate(forms)) + " end"


SQL = {
    "period_ends": _O + "select o_orderkey, cast(" + _by("o_orderkey", "day", "make_date(year(day), 12, 31)", "last_day(make_date(year(day), quarter(day) * 3, 1))", "make_date(year(day), 12, 31)", _QE, f"case when day = last_day(day) and month(day) % 3 = 0 then day else last_day(({_QE}) - interval 3 month) end") + " as varchar) as expected from x",
    "line_periods": _O + "select o_orderkey, " + _by("o_orderkey", "'For the year ended ' || said || '|' || strftime(last_day(day - interval 6 month), '%-d %B %Y')", "'FY' || strftime(day, '%y') || '|FY' || strftime(day - interval 1 year, '%y')", "cast(year(day) as varchar) || '|' || cast(year(day) - 1 as varchar)", "'Current quarter'") + " as expected from x",
    "amount_rank": _O + "select o_orderkey, " + _by("o_orderkey", "case when price between 1900 and 2100 then '11,200' else figure end", "case when price between 1900 and 2100 then '900' else '(' || figure || ')' end", "'US$' || figure || 'm'", "null", "'$' || format('{:.3f}', price / 1000.0) || ' million'") + " as raw, round(" + _by("o_orderkey", "case when price between 1900 and 2100 then 11200.0 else price end", "case when price between 1900 and 2100 then 900.0 else -price end", "price * 1000000.0", "null", "price * 1000.0") + ", 1) as value from x",
    "number_words": _O + "select o_orderkey, " + _by("o_orderkey", "'amount'", "'amount'", "'amount'", "'percent'", "'amount'", "null") + " as value_type, " + _by("o_orderkey", "cast(price as double)", "-cast(price as double)", "price * 1000000.0", "price % 90 + 10.5", "cast(year(day) as double)", "null") + " as value, " + _by("o_orderkey", "''", "''", "'US$'", "''", "''", "null") + " as currency, " + _by("o_orderkey", "''", "''", "'m'", "''", "''", "null") + " as suffix, " + _by("o_orderkey", "price between 1900 and 2100", "price between 1900 and 2100", "false", "false", "true", "null") + " as minor from x",
    "unit_hints": _O + "select o_orderkey, " + _by("o_orderkey", "1000.0", "1000000.0", "null", "null") + " as multiplier, case when o_orderkey % 4 = 3 then '' else " + _by("o_custkey", "'A$'", "'US$'", "'NZ$'", "'$'") + " end as currency from x",
    "unit_applied": _O + "select o_orderkey, price * case when o_orderkey % 3 = 0 and o_custkey % 4 in (0, 2) then 1000.0 else 1.0 end as expected from x",
    "path_parts": _O + "select o_orderkey, 'C' || cast(o_custkey as varchar) as company, " + _by("o_custkey", "'annual'", "'half'", "'quarterly'") + " as doc_type, cast(day as varchar) as doc_date from x",
    "published_times": "select event_id, case when event_id % 7 < 6 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as stamp, case when event_id % 7 < 6 then strftime(ts, '%Y-%m-%d') else '' end as day from events",
    "drop_reasons": _ENGLISH + " select doc_id, case when length(text) < 120 then 'short_text' when not english then 'non_english' when doc_id % 3 = 1 then 'ticker_not_allowlisted' else 'ok' end as expected from e",
    "source_domains": "select page_id, " + _by("page_id", "'d' || cast(page_id as varchar) || '.com'", "'s' || cast(page_id as varchar) || '.org'", "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^(.*?)www\\.', '\\1')") + " as expected from pages",
    "home_rows": "select page_id, page_id % 7 in (1, 2) or page_id % 5 = 0 or regexp_matches(lower(regexp_extract(url, '//([^/?#:]+)', 1)), '\\.au$') as expected from pages",
    "ticker_blobs": "with p as (select p_partkey, 'P' || cast(p_partkey as varchar) as own, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as brand from part) select p_partkey, " + _by("p_partkey", "own || ',' || brand", "brand || ',' || own", "own || ',' || brand", "''") + " as tickers, case when p_partkey % 4 = 3 then '' else '|' || least(own, brand) || '|' || greatest(own, brand) || '|' end as blob from p",
    "ticker_sets": "with p as (select p_partkey, 'P' || cast(p_partkey as varchar) as own, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as brand from part) select p_partkey, " + _by("p_partkey", "least(own, brand) || ',' || greatest(own, brand)", "least(own, brand) || ',' || greatest(own, brand)", "least(own, brand) || ',' || greatest(own, brand)", "''") + " as tickers, case when p_partkey % 4 = 3 then '' else '|' || least(own, brand) || '|' || greatest(own, brand) || '|' end as blob from p",
    "ticker_inference": _O + "select o_orderkey, case when o_orderkey % 2 = 0 then a || ',' || b else b || ',' || a end as expected from (select *, 'A' || translate(cast(o_custkey % 900 + 100 as varchar), '0123456789', 'KLMNPQRSTV') as a, 'B' || translate(cast(price % 900 + 100 as varchar), '0123456789', 'KLMNPQRSTV') as b from x)",
    "match_ranks": _O + "select o_orderkey, cast(" + _by("price", "1", "2", "2", "3", "0") + " as int) as expected from x",
    "first_filled": _O + "select o_orderkey, case when price % 3 = 0 then said when price % 5 = 0 then figure when price % 7 <> 0 then prio end as expected from x",
    "identity_strength": "select doc_id, " + _by("doc_id", "case when doc_id // 5 % 2 = 0 then 'strong' else 'none' end", "'medium'", "case when doc_id // 5 % 2 = 0 then 'ambiguous' else 'weak' end", "'medium'", "'none'") + " as expected from documents",
    "identity_coverage": "select 'Q' || cast(doc_id % 50 + 10 as varchar) as symbol, " + _by("doc_id", "case when doc_id // 5 % 2 = 0 then 'strong' else 'none' end", "'medium'", "case when doc_id // 5 % 2 = 0 then 'ambiguous' else 'weak' end", "'medium'", "'none'") + " as strength, count(*) as n_articles from documents group by 1, 2",
    "scope_routes": _ROUTED + "select company, period, ord, reason, route from rd",
    "route_rows": _ROUTED + "select metric, reason, route, count(*) as n_rows from rd group by 1, 2, 3",
    "row_issues": _ISSUES + "select company, ord, period, expected from iq",
    "issue_multilabel": _ISSUES + "select metric, issue, count(*) as n_rows from (select metric, unnest(string_split(expected, ',')) as issue from iq) where issue <> '' group by 1, 2",
}
QUERIES = {k: globals()[k] for k in SQL}


def column_period(spark, d):
    """The columns of two dates' header, every third row with a day of its own."""
    o = _orders(spark, d).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(1))))
    before = F.date_format(F.last_day(F.add_months("day", -12)), "d MMMM yyyy")
    cells = o.select("o_orderkey", "column", F.lit(2).alias("n_columns"), F.concat("said", F.lit(" "), before).alias("header"), F.lit("").alias("context"), F.lit("").alias("document_hint"), F.when(c("o_orderkey") % 3 == 0, "Cash at 30 June").otherwise("Cash").alias("label"))
    return filings.column_periods(cells).select("o_orderkey", "column", c("period").alias("expected"))


def repaired_ends(spark, d):
    o = _orders(spark, d)
    end = F.when(c("o_orderkey") % 3 == 0, c("day").cast("string")).otherwise(" ")
    a = F.when(c("o_orderkey") % 3 == 1, F.concat(F.lit("Year ended "), "said")).otherwise("")
    return o.select("o_orderkey", ff.repaired_end(end, a, F.concat(F.lit("FY"), F.date_format("day", "yy"))).alias("expected"))


def feed_candidates(spark, d):
    """The documents as items, some without address, title or time; ids made of address, title and time are given as a star."""
    n = c("doc_id").cast("string")
    url = F.when(c("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("https://www.x.com/p/"), n, F.lit("?utm_source=1")))
    title = F.when(c("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("T  "), n))
    published = _pick("doc_id", F.lit("2024-01-02"), F.lit(""), F.lit("soon"), F.lit("1704164645"), F.lit("20240102030405"), F.lit("2024/01/02 03:04:05"), F.lit("2024-01-02T03:04:05Z"))
    item = {"id": F.when(c("doc_id") % 2 == 0, n).otherwise(""), "title": title, "url": url, "body": c("text"), "description": c("lang"), "published": published, "source": c("source")}
    r = table(spark, d, "documents").select("doc_id", fa.candidate("gdelt", item, F.lit("2024-01-03T00:00:00Z")).alias("x"))
    made = F.concat(F.lit("gdelt_"), F.substring(F.sha1(F.concat_ws("|", "x.canonical_url", "x.title", "x.published_at")), 1, 24))
    return r.select("doc_id", "x.reject_reason", F.when(c("x.provider_item_id") == made, "*").otherwise(c("x.provider_item_id")).alias("item_id"), "x.canonical_url", "x.title", "x.published_at")


def linked_bodies(spark, d):
    p = table(spark, d, "pages")
    n = c("page_id").cast("string")
    html = F.concat(F.lit('<script>{"articleBody": "short"} {"@id": 1, "articleBody" : "Body '), n, F.lit(' says \\"'), F.regexp_extract("url", r"//([^/?#:]+)", 1), F.lit('\\"\\nand more"}</script>'), "html")
    return p.select("page_id", fa.jsonld_body(html).alias("expected"))


def page_descriptions(spark, d):
    p = table(spark, d, "pages")
    said = F.concat(F.lit("Page "), c("page_id").cast("string"), F.lit(" &amp; "), F.repeat(F.lit("more "), 60), F.lit("words"))
    return p.select("page_id", fa.meta_description(F.concat(F.lit('<META property="og:description" content="'), said, F.lit('">'), "html")).alias("expected"))


def parsed_lines(spark, d):
    o = _orders(spark, d)
    line = _pick("o_orderkey", F.concat(F.lit("Total revenue $"), "figure", F.lit(" in the year ended "), "said"), F.concat(F.lit("Statutory EBITDA of $"), "figure", F.lit(" for FY"), F.date_format("day", "yy")), F.concat(F.lit("Gross margin was "), (c("price") % 90 + 10).cast("string"), F.lit(".5% in "), F.year("day").cast("string")))
    return extract.parsed_lines(o.withColumn("line", line)).select("o_orderkey", "metric", "variant", "value_type", "value", "period")


def title_split(spark, d):
    """Whole documents behind a title that is given as well."""
    t = table(spark, d, "documents").where("text is not null")
    title = F.concat(F.lit("Heading of number "), c("doc_id").cast("string"))
    r = t.select("doc_id", fa.title_and_body(F.concat(title, F.lit(" "), "text"), title).alias("t"))
    return r.select("doc_id", "t.title", F.sha1("t.body").alias("body_sha1"))


_PREVIOUS = "last_day(day - interval 1 year)"
MORE = {
    "column_period": _O + f"select o_orderkey, cast(col as int) as \"column\", case when o_orderkey % 3 = 0 then cast(year(case col when 0 then day else {_PREVIOUS} end) as varchar) || '-06-30' else strftime(case col when 0 then day else {_PREVIOUS} end, '%Y-%m-%d') end as expected from x, (values (0), (1)) as v(col)",
    "repaired_ends": _O + "select o_orderkey, case when o_orderkey % 3 < 2 then cast(day as varchar) else cast(year(day) as varchar) || '-12-31' end as expected from x",
    "feed_candidates": """with i as (select doc_id, case when doc_id % 3 = 0 then '' else 'https://x.com/p/' || cast(doc_id as varchar) end as canonical_url, case when doc_id % 5 = 0 then '' else 'T ' || cast(doc_id as varchar) end as title,
  case doc_id % 7 when 0 then '2024-01-02T00:00:00Z' when 1 then null when 2 then null else '2024-01-02T03:04:05Z' end as published_at from documents),
r as (select *, case when canonical_url = '' and title = '' then 'missing_identity' when doc_id % 7 = 1 then 'missing_published_at' when doc_id % 7 = 2 then 'invalid_published_at' end as reject_reason from i)
select doc_id, reject_reason, case when reject_reason is null then case when doc_id % 2 = 0 then cast(doc_id as varchar) else '*' end end as item_id, canonical_url, title, published_at from r""",
    "linked_bodies": "select page_id, 'Body ' || cast(page_id as varchar) || ' says \"' || regexp_extract(url, '//([^/?#:]+)', 1) || '\" and more' as expected from pages",
    "page_descriptions": "select page_id, 'Page ' || cast(page_id as varchar) || ' & ' || repeat('more ', 60) || 'words' as expected from pages",
    "parsed_lines": _O + "select o_orderkey, " + _by("o_orderkey", "'revenue'", "'ebitda'", "'gross_margin_pct'") + " as metric, " + _by("o_orderkey", "''", "'statutory'", "''") + " as variant, " + _by("o_orderkey", "'amount'", "'amount'", "'percent'") + " as value_type, " + _by("o_orderkey", "cast(price as double)", "cast(price as double)", "price % 90 + 10.5") + " as value, " + _by("o_orderkey", "'year ended ' || said", "'FY' || strftime(day, '%y')", "cast(year(day) as varchar)") + " as period from x",
    "title_split": r"select doc_id, 'Heading of number ' || cast(doc_id as varchar) as title, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) as body_sha1 from documents where text is not null",
}
SQL |= MORE
QUERIES |= {k: globals()[k] for k in MORE}
