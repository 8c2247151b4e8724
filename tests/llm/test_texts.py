"""Chat, personal data, encoders, records, classifiers and decontamination against plain versions."""

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, common, decontaminate, langid, pii, quality, queries, records, simhash
from tests.oracle import differences

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|>y <|endoftext|>", "I'm we'LL 'S don't  tabs\t\tend  ", "日本語のテキスト と emoji 👩‍👩‍👧 🏳️‍🌈", "a b c\x85d\x1ce", "ÀÉÎ ß ﬁ ½ ² ٣ x²³¹ ªº",
    "\x00\x01\x7f", "é vs é", "aaaa" * 500, "ab" * 3000, "word " * 5000, "No spaces!?...,,;;--__//", "<|startoftext|> hi", "İstanbul ŞĞ", "﻿BOM ​ zero", "1234567890 12,345.67 0x1F", "𝔘𝔫𝔦 𝟙𝟚", "퟿�",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "i", "s", "m") for k, t in enumerate(texts)], "doc_id long, text string, ids string, d string, matches string")


def all_texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# chat


def test_chat_query(spark, medium):
    assert differences(spark, queries.op1_chat, queries.OP1_SQL, medium) == ""


def test_chat_events_fold(spark):
    log = [
        (1, 1, 1, "message", "user", "hi"),
        (1, 2, 2, "delta", "assistant", "Hel"), (1, 2, 3, "delta", "assistant", "lo"),
        (1, 3, 4, "message", "user", "again"), (1, 3, 5, "edit", "user", "once more"),
        (1, 4, 6, "delta", "assistant", "bad"), (1, 4, 7, "regenerate", "assistant", ""), (1, 4, 8, "delta", "assistant", "go"), (1, 4, 9, "delta", "assistant", "od </s>"),
        (2, 1, None, None, None, None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.render(chat.fold_events(frame))).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "Hello"), ("user", "once more"), ("assistant", "good </s>")], 2: [("", "")]}
    assert chat.fold_events(frame.where("false")).count() == 0


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\e\\l\\b", "\\ls>", "<s", " [/INST] ", "<s>[INST] x [/INST] y</s>", "a\\\\</s>b", "[/INST][INST]\\b/INST]", "x" * 100_000 + "</s>"])
def test_chat_round_trip(spark, text):
    turns = spark.createDataFrame([(1, 0, text, "q"), (1, 1, "assistant", text), (1, 2, "assistant", None), (1, None, "user", text)], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.render(chat.fold_events(chat.from_turns(turns)))).first()
    want = [("user", text), (text, "q"), ("assistant", text), ("assistant", "")]
    assert (r.n_turns, r.turns_sha256) == (4, sha("".join(f"{a}\n{b}\n" for a, b in want)))
    assert (r.loss_chars, r.loss_sha256) == (len(text), sha(text))


# personal data

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def slow_luhn(digits):
    parts = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
    return sum(p - 9 if p > 9 else p for p in parts) % 10 == 0


def slow_plain(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(EMAIL, text)],
        "ip": [m.span() for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(CARD, text) if 13 <= len(only(m)) <= 19 and slow_luhn(only(m))],
        "phone": [m.span() for m in re.finditer(PHONE, text) if 9 <= len(only(m)) <= 15],
    }


PERSONAL = [
    "a@b@c.com x..y@d-e.co.uk. z@-.-.- @a.b a@b a@b..c", "a@b.com_x@y.com,%+-@1.2", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000000000000000", "+1 (555) 123-4567 +49.30.1234567 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 555 123 4567 +44 20 7946 0958", "7" * 5000, "@" * 3000 + "a" * 3000, "٣.٣.٣.٣ é@ü.com",
]


def test_pii_query_base_and_union(spark, medium):
    rows = {r.doc_id: r for r in queries.op4_pii(spark, medium).collect()}
    texts = all_texts(spark, medium)
    assert len(rows) == len(texts)
    for doc, text in texts:
        base, r = slow_plain(text or ""), rows[doc]
        line = pii.joined(base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        assert r.base_sha256 == sha(line)
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", PERSONAL)
def test_pii_plain_is_the_patterns(text):
    assert pii.plain(text) == slow_plain(text)


@pytest.mark.parametrize(
    ("kind", "text", "found"),
    [
        ("email", "write to jane (at) example (dot) org today", "jane (at) example (dot) org"),
        ("email", "write jane.roe [at] mail [dot] example [dot] com now", "jane.roe [at] mail [dot] example [dot] com"),
        ("email", "reach bob at example dot com please", "bob at example dot com"),
        ("email", "mail jоhn@exаmple.com twice", "jоhn@exаmple.com"),
        ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("phone", "call +one five five five one two three four five six seven", "+one five five five one two three four five six seven"),
        ("phone", "tel +४९ 30 123456 ok", "+४९ 30 123456"),
        ("card", "card four one one one 1111 1111 one one one one end", "four one one one 1111 1111 one one one one"),
        ("ip", "host 10 dot 0 dot 0 dot 1 up", "10 dot 0 dot 0 dot 1"),
    ],
)
def test_pii_disguises(kind, text, found):
    base, every = pii.find(text)
    assert found in [text[a:b] for a, b in every[kind]], every
    assert all(s in every[k] for k in pii.KINDS for s in base[k])


@pytest.mark.parametrize("text", ["At the corner he waited. Dot went home at ten.", "one of the two was at home", "He is at work. Then he left", "see you at noon (at least) - or at 3.5 km", "the seven of nine"])
def test_pii_leaves_prose_alone(text):
    assert pii.joined(pii.find(text)[1]) == ""


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Escriba a maria.lopez arroba ejemplo.com hoy", "maria.lopez arroba ejemplo.com"),
        ("envoyez jean.petit arobase exemple.fr merci", "jean.petit arobase exemple.fr"),
        ("write bob\tat\texample.com now", "bob\tat\texample.com"),
    ],
)
def test_pii_at_words_without_a_blank_at(text, found):
    assert found in [text[a:b] for a, b in pii.find(text)[1]["email"]]


def test_pii_first_look_misses_no_hint():
    rng = random.Random(3)
    ats, dots = ["at", "arroba", "arobase", "ät", "@", "AT", "Arroba"], ["dot", "punkt", "punto", "point", ".", "DOT"]
    blanks, marks = [" ", "\t", "  ", ""], [("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"), ("-", "-"), ("", "")]
    words = [w for some in pii.DIGIT_WORDS.values() for w in some] + ["ſix", "fıve", "Dİx", "FÜNF", "Zéro"]
    hints = 0
    for _ in range(20000):
        if rng.random() < 0.5:
            (o, c), (p, q) = rng.choice(marks), rng.choice(marks)
            text = "maria" + rng.choice(blanks) + o + rng.choice(ats) + c + rng.choice(blanks) + "ejemplo" + rng.choice(blanks) + p + rng.choice(dots) + q + rng.choice(blanks) + "com"
        else:
            text = rng.choice(["", "+49", "x", "4"]) + "".join(rng.choice([*words, "5", "15"]) + rng.choice(["", " ", ",", "-", "\t"]) for _ in range(rng.randint(1, 4)))
        if pii.HINT.search(text):
            hints += 1
            assert pii.cued(text), text
    assert hints > 10000


@pytest.mark.parametrize(
    ("kind", "found"),
    [("email", "jоhn.smith@example.com"), ("email", "john.smitоh@example.com"), ("email", "jоhn.smith@exаmple.com"), ("ip", "１92.168.1.1"), ("ip", "192.168.1.1１"), ("card", "４111 1111 1111 1111"), ("phone", "+49 30 123456７")],
)
def test_pii_disguise_around_a_plain_match(kind, found):
    text = f"write {found}, please"
    base, every = pii.find(text)
    assert found in [text[a:b] for a, b in every[kind]]
    assert all(s in every[k] for k in pii.KINDS for s in base[k])
    assert pii.redact(text, every) == f"write [{kind.upper()}], please"


def test_pii_plain_matches_beside_a_disguise_stay_single():
    text = "write jane@example.com or bob at example dot com"
    assert [text[a:b] for a, b in pii.find(text)[1]["email"]] == ["jane@example.com", "bob at example dot com"]


def whole_text_spans(text):
    """All spans by rewriting the whole text at once."""
    base = pii.plain(text)
    every = {k: set(v) for k, v in base.items()}
    t = pii.deobfuscate(text)
    for kind, spans in pii.plain(t.text).items() if t.text != text else ():
        for x, y in spans:
            s, e = t.span(x, y)
            if (kind != "email" or pii.TOP_LABEL.search(t.text[x:y])) and not any(p <= s and e <= q for p, q in base[kind]):
                every[kind].add((s, e))
    return base, {k: sorted(v) for k, v in every.items()}


def test_pii_windows_are_the_whole_text():
    rng = random.Random(4)
    parts = "foo bar The at dot (at) [dot] five four one nine oh a@b.co john.smith example.com com 4111 1111 +49 555 - jоhn é point arroba @ . , ( 1.2.3.4 \u200b — seven zwei".split() + ["\n", "  ", "\t"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 40)))
        assert pii.find(text) == whole_text_spans(text)


def test_pii_long_runs_beside_a_hint():
    assert pii.find("a" * 300 + " (at) example.org")[1]["email"] == [(0, 317)]
    text = "7" * 60 + "4111111111111111" + " " + "x" * 102 + "(at) b (dot) com"
    assert pii.find(text)[1]["card"] == []
    spelled = "+" + " ".join(["one"] * 12)
    assert pii.find("call " + spelled + " now")[1]["phone"] == whole_text_spans("call " + spelled + " now")[1]["phone"]


def test_pii_repeated_long_and_clashing(spark):
    long = "word " * 100_000 + "jоhn.smith@example.com"
    docs = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, None, None)], "doc_id long, text string, found string")
    got = pii.annotate(docs).collect()
    assert len(got) == 3 and got[0].found == got[1].found and f"email:500000:{500000 + 22}" in got[0].found.spans.split(",")
    assert pii.digest(docs.where("false")).count() == 0


def test_pii_masks(spark):
    docs = docs_of(spark, ["me@x.org and 10.0.0.1", None, "", "plain"])
    assert [r.text for r in pii.masked(docs).orderBy("doc_id").collect()] == ["[EMAIL] and [IP]", None, "", "plain"]
    assert pii.masked(docs).columns == docs.columns and pii.digest(docs.where("false")).count() == 0
    assert pii.digest(docs).where("doc_id = 1").first().base_sha256 == sha("")


# encoders


@pytest.fixture(scope="module")
def byte_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def want_bpe(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def test_bpe_query_is_the_library(spark, medium, byte_library):
    assert sorted(tuple(r) for r in queries.op5_bpe(spark, medium).collect()) == want_bpe(byte_library, all_texts(spark, medium))


def test_bpe_odd_texts(spark, byte_library):
    docs = docs_of(spark, ODD_TEXTS)
    assert sorted(tuple(r) for r in bpe.digest(docs).collect()) == want_bpe(byte_library, list(enumerate(ODD_TEXTS)))
    back = bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == [t or "" for t in ODD_TEXTS]
    assert bpe.digest(docs.where("false")).count() == 0


def test_trie_is_plain_bpe(byte_library):
    coder = bpe.TrieBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    words = {"".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 18))) for _ in range(1500)} | {"".join(rng.choice(list("éèçßñ日 '.-!0123")) for _ in range(rng.integers(1, 9))) for _ in range(500)}
    for word, ids in coder.encode_words(sorted(words)).items():
        assert list(ids) == coder.merge([coder.ids[bytes([b])] for b in word.encode()])


def test_coder_remembers_words_by_characters(byte_library):
    coder = bpe.TrieBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(40):
        list(coder.encode_batch([f"{chr(97 + k % 26) * (1 + k)}{'ab' * 50_000}"]))
        assert sum(map(len, coder.known)) <= 3_000_000
    coder.remember = 10  # so that words are forgotten again and again
    for text in [t or "" for t in ODD_TEXTS] * 2:
        (ids,) = coder.encode_batch([text])
        assert list(ids) == byte_library.encode(text, add_special_tokens=False).ids


def python_steps(spark, run):
    """How many steps of Python each query that ``run`` makes has in its last plan."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    each = store.executionsList(before, store.executionsCount() - before)
    graphs = [store.planGraph(each.apply(k).executionId()).allNodes() for k in range(each.size())]
    return [sum(any(x in nodes.apply(k).name() for x in ("EvalPython", "MapIn")) for k in range(nodes.size())) for nodes in graphs]


def test_texts_go_through_one_python_worker_a_task(spark, small):
    docs = common.table(spark, small, "documents")
    for keep in (langid.keep_accepted, simhash.keep_one):
        steps = python_steps(spark, lambda keep=keep: keep(docs).collect())
        assert max(steps) == 1, steps


def want_records(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    out, start = [], 0
    for doc, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_records_query_is_the_library(spark, medium):
    got = sorted(tuple(r) for r in queries.op7_records(spark, medium).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want_records(all_texts(spark, medium))


def test_records_odd_texts(spark, tmp_path):
    docs = docs_of(spark, ODD_TEXTS)
    got = sorted(tuple(r) for r in records.digest(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want_records(list(enumerate(ODD_TEXTS)))
    assert records.digest(docs.where("false")).count() == 0
    folder = records.write(docs, f"file://{tmp_path}/r", shard_chars=4000)
    index = spark.read.parquet(f"{folder}/index").collect()
    assert len({r.shard for r in index}) > 1
    for r in index:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            payload, end = records.unframe(f.read(r.bytes), 0)
        doc, ids = records.unpack(payload)
        assert (doc, len(ids), end) == (r.doc_id, r.n_tokens, r.bytes)


def test_records_reject_damage():
    data = bytearray(records.frame(records.pack(7, b"\x01\x00\x02\x00", 2)))
    assert records.unframe(bytes(data), 0)[1] == len(data)
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


# classifiers


def test_language_query_held_out(spark, medium):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = queries.op8_langid(spark, medium).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_odd_texts(spark, medium):
    train = spark.read.parquet(f"{medium}/documents.parquet")
    model = langid.fit(train)
    docs = spark.createDataFrame([(k, t, "f") for k, t in enumerate([None, "", "12 !! 34", "the and with of " * 60_000])], "doc_id long, text string, found string")
    got = {r.doc_id: r.found for r in langid.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in range(4)] == ["und", "und", "und", "en"]
    kept = langid.keep_accepted(train.select("*").withColumnRenamed("source", "found"))
    assert kept.columns == ["doc_id", "text", "lang", "found", "n_chars"] and kept.select("found").dtypes == [("found", "string")]
    empty = train.where("false")
    assert langid.digest(empty).count() == 0 and langid.keep_accepted(empty).count() == 0


def test_quality_query_held_out(spark, medium):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    rows = queries.op6_quality(spark, medium).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.85 * len(held)


def test_quality_odd_tables(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    docs = spark.createDataFrame([(1, None, 5.0), (None, "Some text here.", 5.0), (3, "", 5.0), (3, "x " * 200_000, 5.0)], "doc_id long, text string, score double")
    assert quality.digest(docs, labels).count() == 4
    assert quality.digest(docs.where("false"), labels).count() == 0
    assert quality.digest(docs, labels.where("false")).count() == 4


def test_chain_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    emit, moves = rng.standard_normal((5, 2)), rng.standard_normal((2, 2))
    total, single, pair = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        p = np.exp(sum(emit[k, y[k]] for k in range(5)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        for k in range(5):
            single[k, y[k]] += p
        for a, b in zip(y, y[1:], strict=False):
            pair[a, b] += p
    got = quality.chain_marginals(emit, moves)
    assert np.allclose(got[0], single / total) and np.allclose(got[1], pair / total) and np.isclose(got[2], np.log(total))


# decontamination


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for k, y in enumerate(b):
            now.append(row[k] + 1 if x == y else max(row[k + 1], now[k]))
        row = now
    return row[-1]


@pytest.mark.parametrize("text", [*ODD_TEXTS, "Größe «naïve» ¿qué? l’été — 3×4 ª º µ¼ x_y_ É", "tab\tand\x0bnew\nline\x1cfs"])
def test_fast_tokens_are_the_pattern(text):
    assert decontaminate.tokens(text) == [w.encode() for w in re.findall(r"\w+", (text or "").lower())]


def test_sketch_sums_are_the_matrix(spark, medium):
    items = spark.read.parquet(f"{medium}/benchmark.parquet").limit(9).collect()
    texts = [r[1] for r in all_texts(spark, medium)[:60] if r[1]]
    index = decontaminate.start_index(items, decontaminate.Rules(rank=5))
    omega = np.random.default_rng(0).standard_normal((len(index.vocabulary), 5)).astype(np.float32)
    sums = decontaminate.Sketch(index, omega)
    for _, *batch in decontaminate.batches(index, texts, most=2000):
        sums.add(*batch)
    rows = [n[a : a + 32] for n in (index.numbers(decontaminate.tokens(t)) for t in texts) for a in range(0, len(n), 32)]
    t = np.array([np.bincount(r, minlength=len(omega) + 1)[:-1] for r in rows], dtype=float)
    assert sums.passages == len(rows) and (sums.df == (t > 0).sum(axis=0)).all()
    assert np.allclose(sums.z, t.T @ (t @ omega), rtol=1e-3, atol=1e-2)


def test_lcs_is_the_table():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = [f"t{x}" for x in rng.integers(0, 9, 40)], [f"t{x}" for x in rng.integers(0, 9, rng.integers(0, 60))]
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontaminate.lcs_length(masks, len(a), b) == slow_lcs(a, b)


def test_decontamination_query_finds_every_copy(spark, medium):
    """Brute force: every pair whose item stands in the text token by token is found; found pairs pass a full-table check."""
    items = {r.item_id: decontaminate.tokens(r.text) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
    texts = {d: decontaminate.tokens(t) for d, t in all_texts(spark, medium)}
    exact = {(d, k) for d, w in texts.items() for k, item in items.items() if len(item) >= 5 and b" %s " % b" ".join(item) in b" %s " % b" ".join(w)}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, medium).collect()}
    assert exact and exact <= got
    for d, k in got:
        assert slow_lcs(items[k], texts[d]) >= 0.5 * len(items[k])


def test_decontamination_paraphrase_and_odd_tables(spark):
    item = "the quick zorblat fox of narnelli jumped over seventeen lazy wombats near quondam river while bards sang of glimmering autumn"
    words = item.split()
    near = " ".join(w if k % 6 else "other" for k, w in enumerate(words))
    filler = " ".join(f"f{k}" for k in range(300))
    texts = [f"{filler} {item} {filler}", f"{filler} {near} {filler}", filler, None, "", " ".join(sorted(words)), f"{filler} " * 200 + item]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, item)], "item_id long, text string")
    got = {r.doc_id: r.item_id for r in decontaminate.digest(docs, bench).collect()}
    assert got == {0: 1, 1: 1, 6: 1}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.matches) for r in kept.collect()) == [(2, "m"), (3, "m"), (4, "m"), (5, "m")]
    assert decontaminate.keep_clean(docs, bench.where("false")).count() == 7
    assert decontaminate.digest(docs.where("false"), bench).count() == 0


def test_decontamination_short_items(spark):
    bench = spark.createDataFrame([(1, "Yes, it is."), (2, "seven brown foxes ate quietly"), (3, "one two three four five six seven"), (4, "yes it is"), (5, "!!")], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(200))
    texts = ["yes it IS", f"{filler}\nYes: it is!\n{filler}", f"{filler} yes it is {filler}", f"{filler} seven brown foxes ate quietly {filler}", f"{filler} One two three four, five six seven. {filler}", "!!", None]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.digest(docs_of(spark, texts), bench).collect())
    assert got == [(0, 1), (0, 4), (1, 1), (1, 4), (3, 2), (4, 3)]
    some = bench.where("item_id in (1, 5)")
    assert {r.doc_id for r in decontaminate.digest(docs_of(spark, texts), some).collect()} == {0, 1}


def test_decontamination_recall_of_paraphrases(spark, medium):
    """Items with 8 to 15 % of their tokens changed, dropped or inserted, in other text."""
    rng = random.Random(8)
    items = [r.text for r in spark.read.parquet(f"{medium}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) >= 16]
    pool = [w for r in spark.read.parquet(f"{medium}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(50).collect() for w in (r.text or "").split()]
    texts = []
    for k, item in enumerate(items):
        words = item.split()
        for at in rng.sample(range(len(words)), round(len(words) * rng.uniform(0.08, 0.15))):
            words[at] = rng.choice(["", rng.choice(pool), f"{words[at]} {rng.choice(pool)}"])
        texts.append(" ".join([*rng.choices(pool, k=40), *words, *rng.choices(pool, k=40)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.digest(docs, bench).collect()}
    assert len(items) >= 10 and sum((k, k) in got for k in range(len(items))) >= 0.97 * len(items)


def test_language_query_is_brute_force(spark, medium):
    """Every text against every centroid, its n-grams counted one by one."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    got = {r.doc_id: r for r in queries.op8_langid(spark, medium).collect()}
    for doc, text in all_texts(spark, medium)[:300]:
        low = (text or "").lower()
        if not any(c.isalpha() for c in low):
            assert got[doc].lang_pred == "und" and not got[doc].accepted
            continue
        line = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", low.encode("utf-8", "replace")).lstrip() + b" "
        n = np.zeros(langid.FEATURES)
        for size, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for at in range(len(line) - size + 1):
                code = line[at] * 257 + line[at + 1]
                code = code if size == 2 else code * 263 + line[at + 2]
                n[(code * salt & 0xFFFFFFFF) >> 19] += 1
        v = np.sqrt(n) * model.idf
        cos = [float(c @ v / np.linalg.norm(v)) for c in model.matrix]
        at = max(range(len(cos)), key=lambda k: cos[k])
        other = max(c for c, k in zip(cos, model.langs, strict=True) if k != model.langs[at])
        assert got[doc].lang_pred == model.langs[at] and got[doc].cosine == pytest.approx(cos[at]) and got[doc].accepted == (cos[at] >= model.floor)
        assert got[doc].score == pytest.approx(min(1, max(0, 0.5 + cos[at] - other)))


def test_language_sample_is_bounded_and_stable(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    one, two = langid.fit(docs.coalesce(1), per_language=40), langid.fit(docs.repartition(13), per_language=40)
    assert one.langs == two.langs and np.array_equal(one.matrix, two.matrix)
    same = spark.createDataFrame([(1, "the same words", "en")] * 500 + [(2, "des mots", "fr")], "doc_id long, text string, lang string")
    assert sorted(set(langid.fit(same, per_language=20).langs)) == ["en", "fr"]
    assert set(langid.fit(same, most_languages=1).langs) == {"en"}


def test_quality_query_is_brute_force(spark, medium):
    """Marginals by products of whole matrices over the lines of each text."""
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, medium).collect()}
    step = np.exp(model.moves)
    for doc, text in all_texts(spark, medium)[:150]:
        own, lengths = quality.line_features(text or "")
        if not len(own):
            assert got[doc] == model.default
            continue
        none = np.zeros(quality.N_OWN)
        x = [np.concatenate((own[k], own[k - 1] if k else none, own[k + 1] if k + 1 < len(own) else none, [1.0])) for k in range(len(own))]
        emit = [np.exp((f @ model.weights) - (f @ model.weights).max()) for f in x]
        good = []
        for k in range(len(x)):
            left, right = np.ones(2), np.ones(2)
            for j in range(k):
                left = (left * emit[j]) @ step
                left /= left.sum()
            for j in range(len(x) - 1, k, -1):
                right = step @ (right * emit[j])
                right /= right.sum()
            both = left * emit[k] * right
            good.append(both[1] / both.sum())
            if len(x) > 60:
                break
        if len(good) == len(x):
            assert got[doc] == pytest.approx(float(np.dot(good, lengths) / lengths.sum()), abs=1e-9)


def test_quality_sample_is_bounded_and_stable(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    one, two = (quality.fit(d, labels, most=60, rounds=3) for d in (docs.coalesce(1), docs.union(docs).repartition(9)))
    assert np.allclose(one.weights, two.weights) and one.default == two.default
    long = quality.stretch(np.arange(1000), 400, 5)
    assert len(long) == 400 and (np.diff(long) == 1).all() and len(quality.stretch(np.arange(30), 400, 5)) == 30


def test_records_orders_nulls_and_repeats(spark, tmp_path):
    rows = [(5, "b words", "x"), (None, "no id", "y"), (5, "b words", "x"), (5, "a words", "z"), (-3, None, "m"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    folder = records.write(docs, f"file://{tmp_path}/n")
    got = spark.read.parquet(f"{folder}/index").orderBy("shard", "position").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5]
    out = records.digest(docs).collect()
    assert len(out) == 6 and min(r.start for r in out) == 0 and len({r.start for r in out}) == 6


def test_records_of_one_common_id_are_dealt(spark, tmp_path):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "repeat(concat('w', id, ' '), 20) as text")
    folder = records.write(docs, f"file://{tmp_path}/hot", shard_chars=30_000)
    index = spark.read.parquet(f"{folder}/index")
    assert index.where("doc_id = 7").select("shard").distinct().count() > 3
    assert max(r["count"] for r in index.groupBy("shard").count().collect()) < 1000


def test_chat_empty_and_clashing(spark):
    kinds = "conv_id long, message_id long, seq long, kind string, role string, text string, turns string, formatted string, m string"
    log = spark.createDataFrame([(1, 1, 0, "message", "user", "hi", "t", "f", "m"), (1, 2, 1, None, None, None, "t", "f", "m")], kinds)
    messages = chat.fold_events(log).withColumn("turns", F.lit("t")).withColumn("formatted", F.lit("f"))
    back = chat.read_back(chat.render(messages)).collect()
    assert [(t.role, t.text) for t in back[0].turns] == [("user", "hi"), ("", "")]
    none = log.where("false")
    assert chat.digest(chat.render(chat.fold_events(none))).count() == 0


def test_pipeline_odd_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    prose = "The quick brown fox jumps over the lazy dog and then it sleeps for a while near the river bank number"
    rows = [(k, f"{prose} {k} {k * 7}", "en", "s", k, "x", "y") for k in range(30)] + [(3, f"{prose} 3 21", "en", "s", 3, "x", "y")] * 3 + [(90, None, None, None, None, None, None), (None, "", "en", "s", 0, "x", "y"), (91, "12 34", None, "s", 5, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, found string, ids string")
    bench = spark.createDataFrame([(1, "some item of the benchmark with enough words to be found"), (None, None)], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    bench.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    kept = [r.doc_id for r in out.collect()]
    assert kept and len(kept) == len(set(kept)) and set(kept) <= set(range(30))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, f"{tmp_path}/a").columns == docs.columns
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    bench.where("false").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert corpus_pipeline.encoding(spark, docs.select("doc_id", "text"), "").columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline(spark, medium):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    kept = {n: f(spark, docs, medium) for n, f in corpus_pipeline.STAGES[:4]}
    assert all(k.columns == docs.columns for k in kept.values())
    out = corpus_pipeline.run(spark, medium)
    assert 0 < out.count() < docs.count() and out.select("doc_id").distinct().count() == out.count()


def test_no_tokenizer_file_in_the_repository():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, names in os.walk(top) if ".git" not in d for f in names if f.endswith((".tiktoken", ".model")) or "bpe_" in f and f.endswith(".json")]


def test_samples_of_very_many_rows():
    assert common.below(1200, 10**10) > 0
    assert abs(common.below(1200, 10**10) / common.DICE * 10**10 - 1200) < 1e-3
    assert common.below(1200, 10**40) == 1
    assert common.below(1200, 1200) == common.below(1200, 0) == common.DICE - 1


def test_langid_sample_holds_a_repeated_row_once(spark):
    texts = [(k, f"ein satz nummer {k} und mehr worte dazu", "de") for k in range(40)] + [(99, "immer gleich", "de")] * 3000 + [(k, f"one sentence {k} with other words", "en") for k in range(100, 140)]
    model = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"), per_language=30, reject=0.0)
    assert model.nearest("noch ein satz und worte")[0] == "de" and model.nearest("another sentence with words")[0] == "en"


def test_decontamination_in_slices(spark, medium):
    bench = spark.read.parquet(f"{medium}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(901, "Short row of six tokens here."), (902, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng = np.random.default_rng(3)
    filler = [" ".join(f"w{x}" for x in rng.integers(0, 300, 60)) for _ in range(40)]
    docs = [(k, f"{filler[k]} {items[k][1]} {filler[k + 1]}", "x") for k in range(30)] + [(100, None, "x"), (101, "", "x"), (102, "two words", "x"), (103, filler[0], "x"), (None, f"{filler[5]} {items[1][1]}", "x")]
    docs += [docs[3]] * 3
    d = spark.createDataFrame(docs, "doc_id long, text string, h1 string")
    whole = decontaminate.matches(d, bench)
    parts = decontaminate.matches(d, bench, slice_chars=600)
    found = lambda r: sorted(((x.doc_id, x.text, x.h1, tuple(sorted({m.item_id for m in x.matches}))) for x in r.collect()), key=str)
    assert found(parts) == found(whole)
    assert parts.columns == whole.columns == ["doc_id", "text", "h1", "matches"]
    assert parts._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 0


def test_records_are_read_at_their_places(spark, medium, tmp_path):
    docs = spark.read.parquet(f"{medium}/documents.parquet").where("doc_id % 3 = 0").withColumn("offset", F.lit("x"))
    folder = records.write(docs, f"file://{tmp_path}/r", shard_chars=100_000)
    index = spark.read.schema(records.INDEX).parquet(f"{folder}/index")
    some = index.where("doc_id % 7 = 0")
    got = {r.doc_id: zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in records.read_at(some).collect()}
    assert got == {r.doc_id: r.ids_crc32 for r in some.collect()} and len(got) > 40
    assert records.read_at(index.where("false")).count() == 0
