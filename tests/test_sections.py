"""Sections of files page by page, rows of cash pages and names of companies, against walks in plain Python."""

import re

import numpy as np

from tessera.operators import cashflow, identity, sections

TEXTS = ["Balance sheet", "Income statement of the group", "Statement of cash flows", "operating activities", "net cash", "Notes\nNet cash", "Reconciliation net cash", "plain page", "Cash flow statement\nunderlying", "Statement of comprehensive income and balance sheet"]


def slow_states(pages):
    """(section, page): state, and (page): stop of one file's pages, walked as a reader would."""
    says = lambda p, t: re.search(p.replace("(?i)", ""), t, re.I)
    out, order = {}, sorted(pages)
    left = {p: bool(says(sections.EXCLUDED, pages[p][0])) for p in order}
    heads = {s: {p for p in order if not left[p] and says(x, pages[p][0])} for s, x in sections.HEADINGS.items()}
    every = set().union(*heads.values())
    for s in ("income_statement", "balance_sheet"):
        inside = set(heads[s])
        for p in order:
            if p not in inside and p - 1 in inside and not left[p] and p not in every and pages[p][1]:
                inside.add(p)
        out |= {(s, p): "heading" if p in heads[s] else "continuation" for p in inside}
    stops, inside = {}, set(heads["cash_flow"])
    for h in sorted(heads["cash_flow"]):
        at, reason = order.index(h), "max_pages"
        for p in order[at + 1 : at + 1 + sections.CASH_PAGES]:
            t = pages[p][0]
            stop = "next_statement_heading" if says(sections.HEADINGS["income_statement"], t) or says(sections.HEADINGS["balance_sheet"], t) else "notes" if says(sections.NOTES, t) else "excluded_page" if left[p] else None if says(sections.CASH_CUES, t) else "no_continuation_cue"
            if stop:
                reason = stop
                break
            inside.add(p)
        stops[h] = reason
    return out | {("cash_flow", p): "heading" if p in heads["cash_flow"] else "continuation" for p in inside}, stops


def test_sections_are_those_of_a_walk(spark):
    rng = np.random.default_rng(2)
    files = {f: {p: (TEXTS[rng.integers(len(TEXTS))], bool(rng.random() < 0.6)) for p in range(1, 20) if rng.random() < 0.9} for f in range(30)}
    rows = [(f, p, *x) for f, pages in files.items() for p, x in pages.items()]
    marked = sections.marked_pages(spark.createDataFrame(rows, "file long, page int, text string, is_numeric boolean").repartition(5))
    got = {(r.file, s, r.page): r[s] for r in marked.collect() for s in sections.HEADINGS if r[s]}
    stops = {(r.file, r.page): r.reason for r in sections.cash_stops(marked).collect()}
    want = {f: slow_states(pages) for f, pages in files.items()}
    assert got == {(f, *k): v for f, (states, _) in want.items() for k, v in states.items()}
    assert stops == {(f, p): v for f, (_, s) in want.items() for p, v in s.items()}
    assert sum(r.n_pages for r in sections.section_index(marked).collect()) == len(got)


def test_names_do_not_depend_on_order(spark):
    rows = [("ABC", "Acme  Big Mining Limited", 30), ("ABC", "acme big mining limited", 10), ("ABC", "Acme Big Mining", 20), ("ABC", "Big Mining", 5), ("ABC", "Zed", 3), ("XYZ", "Zed", 3), ("XYZ", "Other Holdings", 4), ("XYZ", "", 9), ("XYZ", None, 9), ("LOW", "Acme Big Mining", 1), ("LOW", "Low Bank", 9)]
    kinds = "ticker string, name string, weight int"
    found = [sorted(tuple(r) for r in identity.identity_map(spark.createDataFrame(x, kinds)).collect()) for x in (rows, rows[::-1])]
    assert found[0] == found[1]
    assert [(t, k, n) for t, k, n, _ in found[0]] == [("ABC", "alias", "Acme Big Mining"), ("ABC", "alias", "Big Mining"), ("ABC", "canonical", "Acme  Big Mining Limited".replace("  ", " ")), ("LOW", "canonical", "Low Bank"), ("XYZ", "canonical", "Other Holdings")]


def test_counters_come_with_the_rows(spark, tmp_path):
    rows = [("f", 1, "half_year", "Capital expenditure", "", False, 1.0), ("f", 1, "half_year", "Capital expenditure", "", True, None), ("f", 2, "half_year", "capital expenditure", "", False, 1.0), ("f", 1, "quarterly", "capital expenditure", "", False, 1.0), ("f", 1, "half_year", None, None, False, None)]
    made = cashflow.cash_rows(spark.createDataFrame(rows, "file string, page int, doc_type string, row_text string, metric string, has_number boolean, confidence double"), spark.createDataFrame([("f", 1)], "file string, page int"))
    seen_rows, seen = cashflow.counted(made)
    seen_rows.write.parquet(f"file://{tmp_path}/rows")
    kept = spark.read.parquet(f"file://{tmp_path}/rows").collect()
    for name, condition in cashflow.counters().items():
        assert seen.get[name] == sum(bool(x[0]) for x in spark.createDataFrame(kept, made.schema).select(condition).collect()), name
    assert len(cashflow.counters()) >= 30
    assert sorted(r.block_reason for r in kept) == ["", "not_cashflow_page", "numeric_not_failed", "phrase_not_matched", "statutory_mismatch"]
    plan = seen_rows._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan
