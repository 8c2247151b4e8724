"""Contracts of candidates, evidence and reports: what's wrong with each, as lists of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The passes of extraction, their order of trust and the confidence each needs.
PASS_PRIORITY = {"native_table": 0, "bbox_layout": 1, "stream_table": 2, "ocr": 3}
PASS_FLOOR = {"native_table": 1.5, "bbox_layout": 1.75, "stream_table": 2.0, "ocr": 3.0}
SOURCE_TYPES = ("financial_statement", "asx_announcement", "news")

c = F.col


def blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def depth(page: Column, bbox: Column, table_id: Column, row: Column, column: Column, snippet: Column, raw: Column) -> Column:
    """How much is known of where a candidate came from: two points for a box and a table, one each for page, row, column, snippet and raw text."""
    box = (F.size(bbox) == 4) & ~F.exists(bbox, lambda x: x.isNull())
    points = ((page > 0, 1), (box, 2), (~blank(table_id), 2), (row.isNotNull(), 1), (column.isNotNull(), 1), (~blank(snippet), 1), (~blank(raw), 1))
    return sum((F.when(test, n).otherwise(0) for test, n in points[1:]), F.when(points[0][0], 1).otherwise(0))


def candidate_issues(rows: DataFrame) -> Column:
    """Names of what a candidate lacks."""
    needed = ("doc_id", "pdf_path", "pass_name", "statement_type", "period_end", "scope")
    issues = [F.when(blank(c(n)), F.lit(f"missing_{n}")) for n in needed]
    issues.insert(2, F.when(F.coalesce(c("page"), F.lit(0)) <= 0, F.lit("missing_page")))
    issues += [F.when(blank(c("metric")) & blank(c("metric_candidate")), F.lit("missing_metric_name")), F.when(blank(c("source_type")), F.lit("missing_source_type"))]
    issues.append(F.when((c("source_type") == "camelot_table") & blank(c("table_id")), F.lit("camelot_missing_table_id")))
    return F.array_compact(F.array(*issues))


def promotion_issues(metric: Column, period_end: Column, currency: Column, pass_name: Column, confidence: Column) -> Column:
    """Why a candidate can't become canonical; each pass has its own least confidence."""
    name = F.when(blank(pass_name), "native_table").otherwise(F.lower(F.trim(pass_name)))
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PASS_FLOOR.items() for x in p]), name), F.lit(2.0))
    unknown = blank(currency) | (F.upper(F.trim(currency)) == "UNKNOWN")
    return F.array_compact(F.array(F.when(blank(metric), F.lit("missing_canonical_metric")), F.when(blank(period_end), F.lit("missing_period_end")), F.when(unknown, F.lit("unknown_currency")), F.when(F.coalesce(confidence, F.lit(0.0)) < floor, F.lit("low_confidence"))))


def unit_evidence(expected: Column, applied: Column) -> Column:
    """3 if the scale that's said is the one applied, less the further they are apart, 0 if either isn't known."""
    ratio = F.greatest(expected, applied) / F.least(expected, applied)
    return F.when(expected.isNull() | applied.isNull(), 0).when(expected == applied, 3).when(ratio >= 1000, -3).when(ratio >= 100, -2).otherwise(-1)


def pass_winners(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, winner, outcome) of each group of candidates: most confidence, then pass, depth, path and page; exact ties by unit evidence, else by agreement on value and currency, else the group is quarantined."""
    order = F.struct(-c("confidence"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PASS_PRIORITY.items() for x in p]), c("pass_name")), F.lit(99)), -c("depth"), "pdf_path", "page")
    r = rows.withColumn("_order", order)
    g = r.groupBy(*keys).agg(F.min("_order").alias("_best"))
    top = r.join(g, keys).where("_order = _best")
    lead = top.groupBy(*keys).agg(F.count("*").alias("tied"), F.max("unit_evidence").alias("_evidence"), F.countDistinct("value", "currency").alias("_values"), F.min("candidate_id").alias("_first"), F.max_by("candidate_id", F.struct("unit_evidence", -c("candidate_id"))).alias("_by_unit"))
    leaders = top.join(lead, keys).where("unit_evidence = _evidence").groupBy(*keys).agg(F.count("*").alias("_leaders"))
    out = lead.join(leaders, keys)
    outcome = F.when(c("tied") == 1, "single").when(c("_leaders") == 1, "unit_evidence").when(c("_values") == 1, "reconciled").otherwise("quarantined")
    return out.withColumn("outcome", outcome).select(*keys, "tied", "outcome", F.when(c("outcome") == "unit_evidence", c("_by_unit")).when(c("outcome") != "quarantined", c("_first")).alias("winner"))


def distinct_candidates(rows: DataFrame) -> DataFrame:
    """The first of candidates that agree on place, pass, metric, period, scope, currency, value and table."""
    return rows.groupBy("pdf_path", "page", "pass_name", "metric", "period_end", "scope", "currency", "value", "table_id").agg(F.min("candidate_id").alias("candidate_id"), F.count("*").alias("n_copies"))


def evidence_issues(rows: DataFrame) -> DataFrame:
    """(bundle, issue, n) of evidence rows (bundle, evidence_id, source_type, source_id, source_url, confidence, content), and of types a bundle lacks altogether."""
    counts = rows.where(~blank(c("evidence_id"))).groupBy("bundle", "evidence_id").agg((F.count("*") - 1).alias("again")).where("again > 0")
    repeated = counts.groupBy("bundle").agg(F.sum("again").alias("n")).select("bundle", F.lit("repeated_evidence_id").alias("issue"), "n")
    issues = F.array_compact(F.array(
        F.when(blank(c("evidence_id")), F.lit("missing_evidence_id")), F.when(~F.coalesce(c("source_type"), F.lit("")).isin(*SOURCE_TYPES), F.lit("unknown_source_type")), F.when(blank(c("source_id")) & blank(c("source_url")), F.lit("missing_source")),
        F.when(c("confidence").isNull() | ~c("confidence").between(0, 1), F.lit("confidence_out_of_range")), F.when(blank(c("content")), F.lit("missing_content")),
    ))
    found = rows.select("bundle", F.explode(issues).alias("issue")).groupBy("bundle", "issue").agg(F.count("*").alias("n"))
    have = rows.groupBy("bundle").agg(F.collect_set("source_type").alias("have"))
    absent = have.select("bundle", F.explode(F.array_except(F.array(*map(F.lit, SOURCE_TYPES)), "have")).alias("t")).select("bundle", F.concat(F.lit("no_"), "t").alias("issue"), F.lit(1).cast("long").alias("n"))
    return found.unionByName(repeated).unionByName(absent)


def citation_coverage(claims: DataFrame, citations: DataFrame, evidence: DataFrame, least: float = 0.95) -> DataFrame:
    """(report, n_claims, n_cited, unknown_ids, coverage, passed): cited claims over claims, and ids that no evidence has.

    claims: report, claim; citations: report, claim, evidence_ids; evidence: report, evidence_id.
    """
    n = claims.where(~blank(c("claim"))).groupBy("report").agg(F.count("*").alias("n_claims"))
    cited = citations.groupBy("report").agg(F.count_if(~blank(c("claim"))).alias("n_cited"))
    used = citations.select("report", F.explode("evidence_ids").alias("evidence_id")).distinct()
    unknown = used.join(evidence.select("report", "evidence_id").distinct(), ["report", "evidence_id"], "left_anti").groupBy("report").agg(F.count("*").alias("unknown_ids"))
    out = n.join(cited, "report", "left").join(unknown, "report", "left").select("report", "n_claims", F.coalesce("n_cited", F.lit(0)).alias("n_cited"), F.coalesce("unknown_ids", F.lit(0)).alias("unknown_ids"))
    return out.withColumn("coverage", F.round(c("n_cited") / c("n_claims"), 6)).withColumn("passed", (c("coverage") >= least) & (c("unknown_ids") == 0))


# Words that a diagnostic query may not hold, and its bounds.
FORBIDDEN = r"(?i)\b(insert|update|delete|drop|alter|create|replace|truncate|attach|detach|pragma|vacuum|grant|revoke|merge|copy|call)\b"
MOST_QUERY_CHARS, MOST_QUERY_ROWS = 4000, 500


def read_only(query: Column) -> Column:
    """Whether a query is a single select: short enough, no semicolon or comment anywhere, no word that changes anything."""
    q = F.trim(F.coalesce(query, F.lit("")))
    return (q != "") & (F.length(q) <= MOST_QUERY_CHARS) & F.lower(q).rlike(r"^(select|with)\b") & ~q.rlike(r";|--|/\*") & ~q.rlike(FORBIDDEN)


def bounded_rows(rows: DataFrame) -> DataFrame:
    """What a diagnostic query may show: ``MOST_QUERY_ROWS`` rows at most."""
    return rows.limit(MOST_QUERY_ROWS)
