"""SimHash, embedding and substring duplicates against brute force."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, embedding, queries, simhash, substring


def union_find(n, pairs):
    root = list(range(n))

    def top(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    a = np.array(prints, dtype=np.uint64)
    pairs = [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if i < j]
    root = union_find(len(a), pairs)
    least = {}
    for (doc, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, doc), doc)
    return sorted((doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(rows, prints, root, strict=True))


def test_simhash_query_is_brute_force(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op2_simhash(spark, medium).select("doc_id", "fingerprint", "component_id").collect())
    assert got == slow_components(rows)


def test_simhash_odd_texts(spark):
    texts = [None, "", " \t\n", "One", "one", "a b c", "A B C d", "x\x0by\x0cz\x1cw", "Straße ÄÖ é", "  a b", "w " * 70_000, "w " * 70_001]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.digest(simhash.components(docs)).collect()) == slow_components(rows)


@pytest.mark.parametrize(("together", "blocks"), [(3, 7), (64, 7), (4096, 7), (50, 8)])
def test_links_of_crowded_blocks(spark, together, blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6, dtype=np.int64)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 9))) for b in base for _ in range(60)}
    prints = sorted(prints | {0, -1, 1, 3, 7, 15, 31, -(1 << 63)})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), together=together, blocks=blocks).collect()
    at = {p: n for n, p in enumerate(prints)}
    a = np.array(prints, dtype=np.int64).view(np.uint64)
    near = [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if i < j]
    assert all(bin((r.src ^ r.dst) & (1 << 64) - 1).count("1") <= 4 for r in links)
    assert union_find(len(a), [(at[r.src], at[r.dst]) for r in links]) == union_find(len(a), near)


def test_simhash_nulls_repeats_and_names(spark):
    kinds = "doc_id long, text string, fp long, _fp string, component string, root long"
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "k", "c", 1), (1, "a b c d e f", 7, "k", "c", 1), (2, "A b c d e f", 7, "k", "c", 2), (3, None, 7, "k", "c", 3), (None, None, 7, "k", "c", 4), (None, "q r s t u", 7, "k", "c", 5), (None, "q r s t u", 7, "k", "c", 6)], kinds)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp, r._fp) for r in kept.collect()) == [(-1, 7, "k"), (1, 7, "k"), (3, 7, "k")]
    assert simhash.keep_one(docs.where("false")).count() == 0
    assert simhash.components(docs.where("false")).count() == 0


def slow_vectors(rows, threshold=0.9):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links, pairs = len(rows), [0] * len(rows), []
    for i in good:
        x = np.array(rows[i][1], dtype=float)
        for j in good:
            if i < j and len(rows[j][1]) == len(x):
                y = np.array(rows[j][1], dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    pairs.append((i, j))
    root = union_find(n, pairs)
    least = {}
    for (vec, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, vec), vec)
    return sorted((vec, links[k], least[root[k]], vec == least[root[k]]) for k, (vec, _) in enumerate(rows))


def test_embedding_query_is_brute_force(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in queries.op9_embedding(spark, medium).collect())
    want = slow_vectors(rows)
    pairs = sum(w[1] for w in want)
    assert sum(w[1] for w in got) >= 0.98 * pairs
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_embedding_odd_vectors_and_blocks(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    group = [(100 + k, [float(x) for x in centre + 0.05 * rng.standard_normal(16)]) for k in range(60)]
    same = [(200 + k, group[0][1]) for k in range(30)]
    odd = [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None] + [0.0] * 14), (5, [float("nan")] * 16), (6, [float("inf")] + [1.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1e-30, 2e-30]), (10, [-1.0, -2.0])]
    rows = odd + group + same
    kinds = "vec_id long, embedding array<double>, id long, v string, codes string, first long, w int"
    frame = spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], kinds)
    for crowded in (8, 1024):
        assert sorted(tuple(r) for r in embedding.near_duplicates(frame, crowded=crowded).collect()) == slow_vectors(rows)
    assert embedding.near_duplicates(frame.where("false")).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 260)] + [(5000, k) for k in range(1000, 1400)] + [(9, 9), (7, 8), (8, 7), (None, 4)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 100 for k in range(100, 261)) and all(got[k] == 1000 for k in [*range(1000, 1400), 5000]) and got[8] == got[7] == 7
    assert len(got) == 161 + 401 + 2
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def slow_units(text, least=5, far=8, window=14):
    """Units by their definition, one cut against all others; the normalised words stand for their digest."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if len(text.lower()) != len(text) else text.lower()
    at = [(m.start(), m.end()) for m in re.finditer(r"\S+", low)]
    words = [low[a:b] for a, b in at]
    n = len(words)
    if n < least:
        return []
    bare = [w.strip(".,;:!?\"'()[]") for w in words]
    breaks = sorted({0, n} | {k for k in range(1, n) if re.search("[\n\r]", low[at[k - 1][1] : at[k][0]])})
    hard = set(breaks) | {k + 1 for k in range(n) if words[k][-1] in ".!?"}
    cuts = set(hard)
    for k in range(n - window + 1):
        some = range(k + 1, k + window + 1)
        if not hard & set(some):
            least_hash = min(zlib.crc32(bare[j - 1].encode()) for j in some)
            cuts.add(max(j for j in some if zlib.crc32(bare[j - 1].encode()) == least_hash))
    cuts = sorted(cuts)
    reaches = lambda i, j: j - i >= far or (j - i >= least and i in hard and j in hard)
    pairs = {(i, j) for i, j in zip(breaks, breaks[1:], strict=False) if j - i >= least}
    pairs |= {(i, min(to)) for i in cuts if (to := [j for j in cuts if reaches(i, j)])}
    return [(at[i][0], at[j - 1][1], " ".join(bare[i:j])) for i, j in sorted(pairs)]


def slow_repeats(rows, least_run=90, gap=4, cutter=slow_units):
    seen = {}
    for doc, text in rows:
        for a, b, d in cutter(text or ""):
            seen.setdefault(d, set()).add((doc, a, b))
    later = sorted({(*x, *min(v)[:2]) for v in seen.values() for x in v if x[:2] > min(v)[:2]})
    runs, reached = [], (None, 0)
    for x in later:
        if x[0] != reached[0] or x[1] > reached[1] + gap:
            runs.append([])
            reached = (x[0], x[2])
        runs[-1].append(x)
        reached = (x[0], max(reached[1], x[2]))
    return sorted(x for r in runs if max(y[2] for y in r) - r[0][1] >= least_run for x in r)


@pytest.mark.parametrize("seed", range(4))
def test_substring_units_are_the_definition(seed):
    rng = np.random.default_rng(seed)
    marks = ["", "", "", ".", ",", "!", "\n", "\n\n", "\r", '"']
    for _ in range(60):
        text = " ".join(f"{'W' * rng.integers(2)}w{rng.integers(9)}" + marks[rng.integers(len(marks))] for _ in range(rng.integers(70)))
        want = slow_units(text)
        got = substring.units(text)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert len({d for _, _, d in got}) == len({d for _, _, d in want})


def test_substring_query_is_brute_force(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op10_substring(spark, medium).collect()) == slow_repeats(rows)


def test_substring_cuts_a_shared_passage(spark):
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(words[:80])
    texts = [f"alpha beta gamma. {passage} omega one two three four.", f"Another beginning that differs entirely, {passage} and an end of its own kind.", "clean words stand here alone with nothing shared."]
    rows = [(10 + k, t, ["x"]) for k, t in enumerate(texts)] + [(None, passage, None), (40, None, None), (41, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed array<string>")
    out = {r.doc_id: r for r in substring.deduplicated(docs).collect()}
    assert out[10].text == texts[0] and out[12].text == texts[2] and out[40].text is None and out[41].text == ""
    left = out[11].text.split()
    assert sum(w in left for w in words[:80]) < 50 and left[-6:] == ["an", "end", "of", "its", "own", "kind."]
    assert substring.repeats(docs.where("false")).count() == 0


def test_substring_leaves_short_repeats_and_takes_long_ones(spark):
    line = "The same five words here."
    passage = " ".join(f"shared{k}" for k in range(51))
    rows = [(1, f"{line}\none two\n{passage} x"), (2, f"other start\n{line}\nand an end"), (3, f"y z\n{passage}"), (3, f"y z\n{passage}")]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {3} and all(r.first_doc_id == 1 for r in got)
    assert {r.doc_id for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), least_run=1).collect()} == {2, 3}


def test_substring_offsets_survive_odd_capitals():
    text = "İstanbul İİ one two three four. Next five words follow here."
    for a, b, _ in substring.units(text):
        assert text[a:b] == text[a:b].strip()
    assert text[substring.units(text)[0][0] : substring.units(text)[0][1]].endswith("four.") or len(substring.units(text)) >= 1


def lines_at(text):
    """(words, start, end) of the lines of a text."""
    for m in re.finditer(r"[^\n]+", text):
        words = m[0].split()
        if words:
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            yield " ".join(w.lower() for w in words), start, start + len(m[0].strip())


def test_substring_finds_every_repeated_line(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    gone = {(r.doc_id, r.start, r.end) for r in substring.repeats(docs, least_run=1).collect()}
    seen, later = set(), []
    for doc, text in sorted({(r.doc_id, r.text) for r in docs.collect() if r.text}):
        for line, a, b in lines_at(text):
            if len(line.split()) >= 8:
                later += [(doc, a, b)] if line in seen else []
                seen.add(line)
    assert len(later) > 500 and [x for x in later if x not in gone] == []


@pytest.mark.parametrize("ends", [0, 7])
def test_substring_units_of_a_passage_are_common(ends):
    """51 words between other words: units of both texts cover 15 of them at least, 36 on average; every seventh word may end a sentence."""
    rng = np.random.default_rng(5)

    def some(n):
        return [f"w{rng.integers(3000)}" + ("." if ends and rng.integers(ends) == 0 else "") for _ in range(n)]

    common = []
    for _ in range(300):
        passage = some(51)
        covered = []
        for _ in range(2):
            before, after = some(int(rng.integers(60))), some(int(rng.integers(60)))
            text = " ".join(before + passage + after)
            low = len(" ".join([*before, ""])) if before else 0
            high = low + len(" ".join(passage))
            covered.append({(a - low, b - low) for a, b, _ in substring.units(text) if low <= a and b <= high})
        held = set()
        for a, b in covered[0] & covered[1]:
            held |= set(range(len(" ".join(passage)[:a].split()), len(" ".join(passage)[:b].split())))
        common.append(len(held))
    assert min(common) >= 15 and np.mean(common) >= 36


def test_substring_short_lines_still_make_units():
    verse = "one two three\nfour five six\nseven eight nine\nten eleven twelve"
    first, second = (f"{head}\n{verse}\n{tail}" for head, tail in (("alpha beta", "gamma"), ("some other words of a different length", "delta epsilon zeta")))
    held = {d for _, _, d in substring.units(first)} & {d for _, _, d in substring.units(second)}
    covered = {k for a, b, d in substring.units(second) if d in held for k in range(a, b)}
    at = second.index(verse)
    assert set(range(at, at + len(verse))) <= covered


def test_fingerprint_is_stable_over_partitions(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    one = simhash.fingerprints(docs.coalesce(1)).agg(F.sum(F.col("fp").cast("decimal(38,0)"))).first()[0]
    assert one == simhash.fingerprints(docs.repartition(7)).agg(F.sum(F.col("fp").cast("decimal(38,0)"))).first()[0]


def test_groups_of_keys_are_not_broadcast(spark, tmp_path):
    # the table's size says little of its keys: each fingerprint has 35 of them or more
    spark.range(5000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    links = simhash.near_links(spark.read.parquet(str(tmp_path / "fps")))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
