"""Repair of conversations, exact search and the audit of filters against brute force."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest

from tests.oracle import differences

from tessera.llm import audit, queries, repair, topk

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def slow_repair(rows):
    """Forward over all states with whole edit strings, none of the operator's passes."""
    best = {"": (0, "", ())}

    def better(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def inserted(at):
        for _ in range(4):
            for state, (cost, edits, said) in list(at.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in AFTER:
                        better(at, AFTER[state, role[0]], (cost + 3, edits + "I", (*said, f"{role}:")))
        return at

    best = inserted(best)
    for role, text, fault in rows:
        after = {}
        for state, (cost, edits, said) in best.items():
            better(after, state, (cost + 4, edits + "D", said))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in AFTER:
                    better(after, AFTER[state, role[:1]], (cost + more, edits + "K", (*said, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    if (state, other[0]) in AFTER:
                        better(after, AFTER[state, other[0]], (cost + more + 3, edits + "R", (*said, f"{other}:{text}")))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def slow_digest(turns):
    convs = {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        role, text = (" " if role is None else role), (" " if text is None else text)
        dice = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if dice:
            text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
            rows += [(turn, "user" if dice == 4 else role, text)] * (2 if dice == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = {t for t, _, _ in rows if t is not None}
        cost, edits, said = slow_repair([(role, text, f) for (_, role, text), f in zip(rows, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        out.append((conv, gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_repair_query_is_brute_force(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_repair(spark, medium)) == slow_digest(rows)


def some_turns(conversations, length, seed):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Assistant"], ["Yes.", "No!", "ok", "", " \t", None, "é?\x0b", "done", "Why? "]
    odds = [0.35, 0.35, 0.12, 0.06, 0.04, 0.04, 0.04]
    for conv in range(conversations):
        for turn in range(int(rng.integers(0, length))):
            text = rng.choice(texts) if rng.random() < 0.4 else f"{rng.integers(1000)} words{rng.choice(['.', '', '?'])}"
            yield (conv if conv else None), turn * int(rng.integers(1, 3)) * 100 + turn, roles[rng.choice(7, p=odds)], text


@pytest.mark.parametrize("longest", [1, 3, 10_000])
def test_repair_of_random_turns_in_pieces(spark, longest):
    rows = list(some_turns(150, 24, 5))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    said, totals = repair.repaired(repair.damaged(turns), longest)
    want = {w[0]: w for w in slow_digest(rows)}
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(said).collect()}
    got = totals.collect()
    assert len(got) == len({w for w in want if any(r[0] == w and zlib.crc32(f"{' ' if w is None else w}:{r[1]}".encode()) % 20 for r in rows)})
    for r in got:
        w = want[r.conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == w[1:8]
        assert hashes.get(r.conv_id, hashlib.sha256().hexdigest()) == w[8]


def test_repair_of_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string, part int, edits string, dice string"
    most, least = (1 << 63) - 1, -(1 << 63)
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, "assistant", "Yes."), (2, None, None, None), (3, most, "user", "x" * 300_000), (3, least, "assistant", "y."), (None, 1, "user", "a."), (None, 2, "user", "a.")]
    rows += [(4, 4, "user", "Same.")] * 50
    docs = spark.createDataFrame([(*r, 1, "e", "d") for r in rows], kinds)
    got = {r[0]: r for r in found(repair.digest(docs))}
    want = {r[0]: r for r in slow_digest(rows)}
    assert {k: v for k, v in got.items() if k != 3} == {k: v for k, v in want.items() if k != 3}
    assert got[3][2:] == want[3][2:]  # the gap wraps
    assert repair.digest(docs.where("false")).count() == 0


def slow_search(rows, every=20, k=20):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = set(), set()
    for at, (q, v) in enumerate(good):
        if q is None or q % every or (q, tuple(v)) in asked:
            continue
        asked.add((q, tuple(v)))
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0, i) for n, (i, w) in enumerate(good) if n != at]
        out |= {(q, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)}
    return out


def test_search_is_its_sql(spark, medium):
    assert differences(spark, queries.op12_topk, queries.OP12_SQL, medium) == ""


@pytest.mark.parametrize(("block", "slice_rows", "slices"), [(8192, 65_536, 16), (3, 40, 1)])
def test_search_of_odd_vectors(spark, block, slice_rows, slices):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, rng.choice([0, 2, 5, 8])) / 32]) for k in range(300)]
    rows += [(20, rows[20][1])] * 30 + [(40, [1.0, 2.0])] * 2 + [(None, [9.0] * 8), (None, [9.0] * 8), (1001, None), (1002, [None, 1.0]), (1003, [float("nan")]), (1020, [float("inf")]), (1040, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, h int")
    got = [tuple(r) for r in topk.search(df, block=block, slice_rows=slice_rows, least_slices=slices).select("query_id", "rank", "vec_id", "score").collect()]
    assert set(got) == slow_search(rows)
    assert topk.search(df.where("false")).count() == 0


def test_search_where_floors_are_large(spark):
    rows = [(0, [1e6, -1e6]), (1, [3e6, 1.0]), (2, [-3e6, 2e6]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.score) for r in topk.search(df).collect()}
    assert {g for g in got if g[0] != 3} == {(1, 64_000_000 * (192_000_000 - 64)), (2, 64_000_000 * -320_000_000)}
    assert {g[0] for g in got} == {1, 2, 3}


def slow_audit(docs, labels):
    marks = {}
    for doc, quality, toxic in labels:
        q, t = marks.get(doc, (False, False))
        marks[doc] = (q or quality == 1, t or toxic == 1)
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    table = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc is not None and doc > least[text]}
        table.append((lang or "", {k for k, v in fails.items() if v}, *(marks.get(doc, (False, False)) if doc is not None else (False, False))))
    out = set()
    for part in {t[0] for t in table}:
        mine = [t for t in table if t[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            for f in "ABCDE":
                total[f] += sum(f in t[1] and not t[1] & set(p[: p.index(f)]) for t in mine)
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                before = set(p[:k])
                here = [t for t in mine if f in t[1] and not t[1] & before]
                out.add((part, "".join(p), k + 1, sum(not t[1] & (before | {f}) for t in mine), len(here), sum(f in t[1] and bool(t[1] & before) for t in mine), sum(t[1] == {f} for t in mine), sum(t[2] for t in here), sum(t[3] for t in here), total[f]))
    return out


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_is_its_sql(spark, medium):
    assert differences(spark, queries.op13_audit, queries.OP13_SQL, medium) == ""


def test_audit_of_odd_documents(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", " \t\n", "One", "one two " * 150, " ".join(map(str, range(260))) + " \x0b", "A" * 40, "a # b", "x\x1cy z", "É" * 300, "w " * 30_000, "\x0d" + " ".join(f"w{k}" for k in range(200))]
    docs = [(int(rng.integers(0, 40)) if rng.random() < 0.9 else None, texts[rng.integers(len(texts))], [None, "", "en", "de"][rng.integers(4)]) for _ in range(200)]
    docs += [(7, "one two " * 150, "en")] * 300
    labels = [(int(k), [0, 1, None][rng.integers(3)], [0, 1, None][rng.integers(3)]) for k in rng.integers(0, 40, 30)] + [(None, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "t", 3) for r in docs], "doc_id long, text string, lang string, n long, task string, h int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in audit.interactions(audit.failing(d, marks)).select(*AUDIT).collect()} == slow_audit(docs, labels)
    assert audit.interactions(audit.failing(d.where("false"), marks)).count() == 0
    assert audit.interactions(audit.failing(d, marks.where("false"))).where("good_lost + toxic_lost > 0").count() == 0
