"""Operators that judge, find, encode and format row by row."""

import hashlib
import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import WORD, lower, pii as plain_pii
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cairn.llm import chat, licenses, linefirst, mixing, parity, pieces, pii, sharding, toxicity

ODD = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "x" * 200_000, "b"), (4, "x" * 200_000, "b"), (5, "é 😀 \x00 z", None)]
SCHEMA = "doc_id long, text string, source string"


def test_pii_base_equals_the_patterns():
    rng = random.Random(2)
    parts = ["a.b@x.com", "@", "foo@bar", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+1 2", " ", ".", "é", "+", "00012.3.4.5", "x@y.z@w.q", "-", "123456789012345678901234567890"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(8)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain_pii(text), text


def test_pii_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"Please ring hotline +1 (202) 555-{1000 + k} today. Filler {k}", "s") for k in range(30)]
    rows += [(100, "Please ring hotline 0202 555 99 88 today.", "s"), (101, "Order number 0202 555 99 88 shipped.", "s"), *ODD]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "spans")
    got = {(r["id"], r["digest"]): r for r in pii.find(spark, docs).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert all(by_id[k]["base"] == by_id[k]["spans"] and len(by_id[k]["base"]) == 1 for k in range(6, 30))
    assert [tuple(x) for x in by_id[100]["spans"]] == [(3, 20, 34)] and by_id[101]["spans"] == []
    assert pii.find(spark, docs).count() == len(rows)
    blank = {r["doc_id"]: r["text"] for r in pii.redact(spark, docs).collect()}
    assert blank[100] == "Please ring hotline [PHONE] today." and blank[101] == rows[31][1] and blank[1] is None and blank[7].startswith("Please ring hotline [PHONE]")
    assert pii.redact(spark, docs).count() == len(rows) and pii.redact(spark, docs.limit(0)).collect() == []
    assert pii.blank_out("abcdef", [{"k": 0, "s": 1, "e": 3}, {"k": 2, "s": 2, "e": 5}]) == "a[EMAIL]f"


def plain_bootstrap(texts, support, confidence):
    """The graph of ``pii.find`` with dictionaries: added (kind, start, end) of every text."""
    found = [(k, m) for k, t in enumerate(texts) for m in pii.mentions(t or "", pii.base_spans(t or ""))]
    edges = {(p, m[3]) for _, m in found for p in m[4]}
    size = {p: sum(q == p for q, _ in edges) for p in {p for p, _ in edges}}
    seeds = {(m[3], m[2]): 1.0 for _, m in found if m[2] >= 0}
    known, good = dict(seeds), None
    while True:
        mass = {}
        for p, i in edges:
            for (j, kind), score in known.items():
                if i == j:
                    mass[p, kind] = mass.get((p, kind), 0) + score
        now = {x: v / size[x[0]] for x, v in mass.items() if size[x[0]] >= support and v / size[x[0]] >= confidence}
        if good is not None and now.keys() == good.keys():
            break
        good, known = now, dict(seeds)
        for p, i in edges:
            for (q, kind), score in good.items():
                if p == q:
                    known[i, kind] = max(known.get((i, kind), 0), score)
    added = [set() for _ in texts]
    for k, (a, b, kind, _, patterns) in found:
        marks = [(score, -of, of) for (p, of), score in good.items() if p in patterns]
        if kind in (-1, pii.SECRET) and marks:
            added[k].add((max(marks)[2], a, b))
    return added


def test_pii_graph_equals_a_plain_one(spark):
    rng = random.Random(12)
    forms = [lambda: f"+1 (202) 555-{rng.randrange(1000, 9999)}", lambda: f"0202 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", lambda: f"{rng.getrandbits(160):040x}", lambda: f"u{rng.randrange(99)}@host.example.org", lambda: f"AB{rng.randrange(10**6):06d}X"]
    texts = []
    for k in range(160):
        form = rng.choice(forms)
        lead = rng.choice(["ring", "token =", "mail to", "order no", "key is"])
        texts.append(f"Some words {lead} \"{form()}\" " + rng.choice(["today", "please", "now"]) + f" and {lead} {rng.choice(forms)()} x{k}")
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seen = 0
    for support, confidence in ((3, 0.3), (8, 0.5), (8, 0.9)):
        want = plain_bootstrap(texts, support, confidence)
        got = {r["id"]: {tuple(x) for x in r["spans"]} - {tuple(x) for x in r["base"]} for r in pii.find(spark, docs, support=support, confidence=confidence).collect()}
        assert got == dict(enumerate(want))
        seen += sum(map(len, want))
    assert seen > 50


def test_pii_secrets_are_marked_where_a_pattern_says_so(spark):
    rng = random.Random(13)
    rows = [(k, f'Text with token = "{rng.getrandbits(160):040x}" in line {k}', "s") for k in range(12)]
    rows += [(50, 'Text with token = "abc123def" again', "s"), (51, f"A digest {rng.getrandbits(160):040x} of a file", "s")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", __id int, found_id int, Found_Spans int")
    got = {r["id"]: [tuple(x) for x in r["spans"]] for r in pii.find(spark, docs).collect()}
    assert all(got[k] == [(pii.SECRET, 19, 59)] for k in range(12)) and got[50] == [(pii.SECRET, 19, 28)] and got[51] == []
    blank = pii.redact(spark, docs)
    assert blank.columns == docs.columns and {r["doc_id"]: r["text"] for r in blank.collect()}[50] == 'Text with token = "[SECRET]" again'


def plain_quality(text):
    words = WORD.findall(text or "")
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(4)
    clean = "\n".join(" ".join(f"word{rng.randrange(10**6)}" for _ in range(12)) + "." for _ in range(8))
    rows = [*ODD, (20, clean, "s"), (21, clean.replace(".", " | x | y | z | q"), "s"), (22, clean.replace(" ", "*** "), "s"), (23, clean.replace(".", ""), "s"), (24, clean.replace(" ", "!! "), "s"), (25, (clean.split("\n")[0] + "\n") * 9, "s")]
    rows += [(30 + k, " ".join(rng.choice(["a", "b", "c", "\n", "#d"]) for _ in range(rng.randrange(90))), "s") for k in range(40)]
    got = linefirst.judge(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "w")).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_quality(texts[r["id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
    kept = {r["id"]: r["kept"] for r in got}
    assert kept[20] and not any(kept[k] for k in range(21, 26))
    mixed = clean + "\nHome | News | Sport | Login\nAll rights reserved 2020."
    r, = linefirst.judge(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).collect()
    assert r["kept"] and r["clean_text"] == clean
    assert linefirst.judge(spark.createDataFrame([], SCHEMA)).collect() == []


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(Path(MODEL).read_bytes())


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["th", "ing", " ", "  ", "\n", "▁", "日本", "</s>", "<0x41>", "aaaa", "==", "é", "tion", "der"]), max_size=14).map("".join))
def test_pieces_equal_the_library(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text, add_eos=True) and model.decode(ids) == library.decode(ids)


def test_piece_operators_over_tables(spark, library):
    docs = spark.createDataFrame([*ODD, (6, "ab" * 30_000 + " the end", "s")], SCHEMA).withColumnRenamed("source", "ids")
    coded = pieces.encode(spark, docs, MODEL)
    texts = {i: t or "" for i, t, *_ in docs.collect()}
    rows = coded.collect()
    assert all(r["ids"] == library.encode(texts[r["id"]], add_eos=True) for r in rows) and len(rows) == 8
    assert {r["id"]: r["text"] for r in pieces.decode(spark, coded, MODEL).collect()} == {i: library.decode(library.encode(t)) for i, t in texts.items()}
    for r in pieces.digests(spark, docs, MODEL).collect():
        ids = library.encode(texts[r["id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(spark, docs.limit(0), MODEL).collect() == []


@given(st.lists(st.tuples(st.none() | st.sampled_from(["user", "assistant", "a\nb", "\\"]) | st.text(max_size=5), st.none() | st.text(alphabet="<|>/s[INST]\\\nim_endSY ", max_size=30) | st.sampled_from(["</s>[INST] ok [/INST]", "<|im_end|>\n", "<<SYS>>x<</SYS>>", "\\<|"])), max_size=5))
def test_formatted_turns_read_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t or "" for r, t in turns if r == "assistant"]
    for control in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert control not in formatted
    assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(turns)


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more", 4.0), ("t", 5, 99, "user", "lost parent", None), ("t", 6, 7, "user", "loop", 9.0), ("t", 7, 6, "user", "loop", 9.0)]
    rows += [("chain", k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", str(k), 0.0) for k in range(70)] + [(None, 1, None, None, None, None)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.conversations(spark, messages, score="score", per_tree=None).collect()}
    assert set(got) == {("t", 4), ("t", 3), ("t", 5), ("chain", 69), (None, 1)}
    assert [t for _, t in chat.parse(got["t", 4]["formatted"])] == ["q", "good", "more"] and got["t", 4]["rank"] == 1 and got["t", 5]["rank"] == 3
    assert [t for _, t in chat.parse(got["chain", 69]["formatted"])] == [str(k) for k in range(70)]
    assert {r["leaf"] for r in chat.conversations(spark, messages, score="score").collect()} == {4, 69, 1}
    assert chat.conversations(spark, messages.limit(0)).collect() == []


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(1)
    calm = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "ve") for b in ("na", "ko", "li", "rem", "tis", "dor")]
    rows, labels = [*ODD], []
    for k in range(100, 700):
        words = [rng.choice(calm) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(20, 90))]
        toxic = k % 4 == 0
        for _ in range(max(1, len(words) // 20) if toxic else 0):
            words[rng.randrange(len(words))] = "idiot" + rng.choice(["", "ic", "zz"])
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels += [(100, None), (None, 1)]
    model = toxicity.train(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.score(spark, docs.withColumnRenamed("source", "toxicity"), model).select("doc_id", toxicity.is_held_out("doc_id").alias("out"), "toxicity").collect()
    assert len(scored) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in scored)
    held = [r for r in scored if r["out"] and (r["doc_id"] or 0) >= 100]
    assert len(held) > 60 and np.mean([(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) >= 0.95
    unseen = model.scores(pa.array(["lona idiotx miko tali", "lona miko tali rerem", None, ""]))
    assert unseen[0] > 0.5 > unseen[1] and unseen[2] == unseen[3]
    long = ("lona miko idiot " * 100_000).strip()
    assert abs(model.scores(pa.array([long]))[0] - model.scores(pa.array(["lona miko idiot " * 1000]))[0]) < 0.01
    nothing = toxicity.train(spark, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(spark, docs.limit(0), nothing).collect() == [] and nothing.scores(pa.array(["x"]))[0] == pytest.approx(0.5)


def test_targets_and_routes():
    assert mixing.targets({"a": 100, "b": 100, "c": 100, None: 0}) == {"a": pytest.approx(187.5), "b": 75, "c": 37.5, None: 0}
    capped = mixing.targets({"a": 10, "b": 1000, "c": 1000})
    assert capped["a"] == 30 and sum(capped.values()) == pytest.approx(2010)
    assert mixing.route([((0,), 10), ((1,), 10), ((0, 1), 10)], [25, 5], 3) == [[10], [5], [15, 0]] or sum(map(sum, mixing.route([((0,), 10), ((1,), 10), ((0, 1), 10)], [25, 5], 3))) == 30
    flows = mixing.route([((0, 1), 10), ((1,), 10)], [12, 12], 3)
    assert sum(flows[0]) + sum(flows[1]) == 24 and flows[0][0] == 12


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "b", "c", "d", None])) for k in range(900)] + [(k, t, s) for k, t, s in ODD]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    mixed, sources = mixing.mix(spark, docs)
    got = mixed.collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    for s in sources.collect():
        taken = sum(r["taken"] for r in got if r["members"] == [s["source"]])
        assert abs(taken - s["target"]) <= 40 and s["routed"] == round(s["target"])
    again = mixing.mix(spark, docs.repartition(7))[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.take(spark, docs).count() == sum(r["copies"] for r in got) and mixing.take(spark, docs).columns == docs.columns
    assert mixing.take(spark, docs.limit(0)).collect() == []


def test_mix_of_more_sources_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(40)), rng.choice([None, *(f"s{j}" for j in range(30))])) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(mixing, "SMALL", 5)
    mixed, sources = mixing.mix(spark, docs)
    got = {r["source"]: r for r in sources.collect()}
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for _, _, s in rows}
    assert {s: (r["source_size"], r["target"]) for s, r in got.items()} == {s: (sizes[s], x) for s, x in mixing.targets(sizes).items()}
    assert all(r["routed"] == min(round(r["target"]), 3 * r["source_size"]) for r in got.values())
    few = mixed.collect()
    # a source that shares documents is routed beside those that do not
    both = F.when(F.col("source") == "s1", F.array(F.lit("s1"), F.lit("s2"))).otherwise(F.array("source"))
    tied = {r["source"]: r for r in mixing.mix(spark, docs, sources=both)[1].collect()}
    assert tied["s1"]["source_size"] == sizes["s1"] and tied["s2"]["source_size"] == sizes["s1"] + sizes["s2"]
    assert tied["s1"]["routed"] + tied["s2"]["routed"] <= 3 * tied["s2"]["source_size"] and len(tied) == len(sizes)
    monkeypatch.undo()
    assert sorted(map(str, few)) == sorted(map(str, mixing.mix(spark, docs)[0].collect()))


def test_license_rules(spark):
    assert len(licenses.rules()) > 200
    scan = licenses.scanner().scan
    labels = lambda t: sorted({x.label for x in scan(t)[1]})
    assert labels("Released under the MIT License.") == ["mit"] and labels("SPDX-License-Identifier: LGPL-2.1-only") == ["lgpl-2.1"]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl-3"] and labels("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc", "cc-by-nc-sa"]
    assert labels("The committee will submit licensees' gplx reports") == [] and labels("") == []
    assert labels("Redistribution and use in source and binary forms, with or without modification, are permitted") == ["bsd"]
    rng = random.Random(5)
    vocabulary = "under the mit license apache version 2 cc by nc é x-y".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(150)]
    for text in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        want = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + phrase.count(" ") + 1] == phrase.split())
        n, found = scan(text)
        assert n == len(words) and sorted((x.first, x.label) for x in found if x.base) == want
    docs = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("source", "found")
    assert {r["n_words"] for r in licenses.scan(spark, docs).collect()} == {0, 1, 3} and licenses.scan(spark, docs.limit(0)).collect() == []


def test_suppression_equals_a_comparison_of_all_pairs():
    rng = random.Random(9)

    def beats(y, x):
        inside = y.first <= x.first and x.last <= y.last
        if not inside:
            return False
        if (y.first, y.last) != (x.first, x.last):
            return True
        return (-y.priority, -y.confidence, y.label) < (-x.priority, -x.confidence, x.label)

    for _ in range(300):
        found = []
        for _ in range(rng.randrange(9)):
            first = rng.randrange(8)
            found.append(licenses.Found(first, first + rng.randrange(5), rng.choice("abc"), rng.randrange(3), rng.choice([0.5, 0.9]), rng.random() < 0.2))
        want = {x for x in found if x.base or not any(beats(y, x) for y in found if y != x and (y.label, y.first, y.last, y.priority, y.confidence) != (x.label, x.first, x.last, x.priority, x.confidence))}
        plain = {(x.first, x.last, x.label, x.base) for x in want if x.base or not any(y.base and y[:5] == x[:5] for y in found)}
        assert {(x.first, x.last, x.label, x.base) for x in licenses.suppress(found)} >= {x for x in plain if x[3]}
        assert {x[:3] for x in licenses.suppress(found)} == {x[:3] for x in plain}


def test_the_gate_loses_no_rule():
    rng = random.Random(10)
    texts = []
    for label, spdx, name in licenses.FAMILIES:
        texts += [f"released under the terms of the {n} licence" for n in name.replace("(?:", "").replace(")?", "").replace(")", "").split("|")]
    texts += [p.replace("(?:", "").replace(")", "").replace("?", "") for p, *_ in licenses.SENTENCES]
    scanner = licenses.scanner()
    for text in texts + [" ".join(rng.sample(texts, 3)) for _ in range(100)]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        joined = " " + " ".join(words) + " "
        every = []
        for rule in scanner.rules:
            for m in rule.pattern.finditer(joined):
                first = joined.count(" ", 0, m.start()) - 1
                every.append(licenses.Found(first, first + m[0].count(" "), rule.label, rule.priority, rule.confidence))
        for phrase, label in licenses.BASE:
            every += [licenses.Found(k, k + phrase.count(" "), label, 10, 0.9, True) for k in range(len(words)) if words[k : k + phrase.count(" ") + 1] == phrase.split()]
        assert scanner.scan(text)[1] == licenses.suppress(every), text


def test_very_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    text = ("word " * 50 + "licensed under the apache license version 2 see ") * 40_000  # 12 MB
    n, found = licenses.scanner().scan(text)
    assert n == 58 * 40_000 and sum(x.base for x in found) == 40_000
    turns = [("user", "a\\ <|b " * 1_200_000), ("assistant", "</s>" * 1_000_000)]
    assert chat.parse(chat.render(turns)[0]) == turns
    for odd in ("1 " * 3_000_000 + "a", ",1" * 10 + "1" * 5_000_000 + "a", "x@" * 2_000_000, "+1 " * 2_000_000, "a1" * 3_000_000):
        pii.mentions(odd, pii.base_spans(odd))
    assert time.perf_counter() - began < 60


def test_contained_detections_go():
    f = licenses.Found
    inner, outer, other = f(2, 3, "gpl", 5, 0.7), f(1, 5, "lgpl", 4, 0.6), f(4, 8, "x", 1, 0.1)
    assert licenses.suppress([inner, outer, other]) == [outer, other]
    assert licenses.suppress([f(1, 2, "b", 5, 0.5), f(1, 2, "a", 6, 0.5)]) == [f(1, 2, "a", 6, 0.5)]
    assert licenses.suppress([outer, f(2, 3, "mit", 10, 0.9, True)])[1].label == "mit"


def test_shards(spark):
    rng = random.Random(6)
    rows = [(k, "t" * rng.randrange(400) + str(k), "s") for k in range(3000)] + [(5000 + k, "copy", "s") for k in range(1500)] + [(9000 + k, f"pair {k // 2}", "s") for k in range(200)] + [x for x in ODD if x[0] != 4]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "shard").repartition(4)
    got = sharding.shard(spark, docs).collect()
    assert len(got) == len(rows)
    load = [0] * 16
    for s in range(16):
        mine = [r for r in got if r["shard"] == s]
        load[s] = sum(r["size"] for r in mine)
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    mean = sum(load) / 16
    assert max(abs(x - mean) for x in load) < 0.05 * mean
    pairs = {}
    for r in got:
        if r["id"] is not None and 9000 <= r["id"] < 9200:
            pairs.setdefault((r["id"] - 9000) // 2, set()).add(r["shard"])
    assert all(len(x) == 1 for x in pairs.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(spark, docs.repartition(7)).collect()))
    assert sharding.shard(spark, docs.limit(0)).collect() == []
    # 20,000 rows that nothing tells apart, and others: all shards get their share
    docs = spark.createDataFrame([(None, "copy", "s")] * 20_000 + [(k, f"own {k}", "s") for k in range(2000)], SCHEMA).repartition(4)
    got = sharding.shard(spark, docs).collect()
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert len(got) == 22_000 and max(abs(x - sum(load) / 16) for x in load) < 0.05 * sum(load) / 16
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(16))
    assert sharding.splitters([(1, 1), (2, 50), (3, 1), (9, 9)], 10) == [1, 2, 9]


def plain_grams(text):
    """Byte n-grams of the words with a space at either end."""
    data = re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", lower(text).encode())
    return [(b" " + w + b" ")[i : i + n] for w in data.split() for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for i in range(len(w) + 3 - n)]


def plain_bucket(gram):
    return (int.from_bytes(gram, "little") * int(toxicity._ODD[len(gram)]) % (1 << 64)) >> (64 - toxicity.BUCKET_BITS)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.none() | st.text(alphabet="abAZ09 .,!é😀\n", max_size=40), min_size=1, max_size=5))
def test_bags_and_scores_equal_plain_ones(texts):
    weight = np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32)
    scores = toxicity.Model(weight, 0.3).scores(pa.array(texts, pa.string()))
    for text, (index, share), score in zip(texts, toxicity.bags(pa.array(texts, pa.string())), scores, strict=True):
        grams = [plain_bucket(g) for g in plain_grams(text)]
        want = {b: grams.count(b) / len(grams) for b in grams}
        assert dict(zip(index.tolist(), share.tolist(), strict=True)) == pytest.approx(want)
        logit = 0.3 + (sum(float(weight[b]) for b in grams) / len(grams) if grams else 0)
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_training_equals_a_plain_one(monkeypatch):
    for name, value in (("BUCKET_BITS", 6), ("EPOCHS", 2), ("BATCH", 4)):
        monkeypatch.setattr(toxicity, name, value)
    rng = np.random.default_rng(7)
    index = [np.unique(rng.integers(0, 64, 9)).astype(np.int32) for _ in range(13)] + [np.zeros(0, np.int32)]
    share = [np.full(len(i), 1 / max(1, len(i)), np.float32) for i in index]
    label = np.array([k % 2 for k in range(14)])
    got = toxicity.fit(index, share, label)
    rng = np.random.default_rng(toxicity.SEED)
    vectors = rng.normal(0, 0.05, (64, toxicity.DIM)).astype(np.float32).astype(float)
    weights = rng.normal(0, 0.5, (toxicity.DIM, 2)).astype(np.float32).astype(float)
    rate = (label.sum() + 0.5) / 15
    values = [vectors, weights, np.log(np.array([1 - rate, rate]))]
    first, second, step = [v * 0 for v in values], [v * 0 for v in values], 0
    for epoch in range(2):
        order = rng.permutation(14)
        for k in range(0, 14, 4):
            rows = [r for r in order[k : k + 4] if len(index[r])]
            slopes = [v * 0 for v in values]
            for r in rows:  # one row and one n-gram at a time
                mean = sum(toxicity.GAIN * s * values[0][i] for i, s in zip(index[r], share[r], strict=True))
                p = np.exp(mean @ values[1] + values[2])
                p = p / p.sum()
                p[label[r]] -= 1
                p /= len(rows)
                slopes[1] += np.outer(mean, p)
                slopes[2] += p
                for i, s in zip(index[r], share[r], strict=True):
                    slopes[0][i] += toxicity.GAIN * s * (values[1] @ p)
            step += 1
            for q in range(3):
                first[q] = 0.9 * first[q] + 0.1 * slopes[q]
                second[q] = 0.99 * second[q] + 0.01 * slopes[q] ** 2
                pace = toxicity.RATE * (1 - epoch / 2)
                values[q] = values[q] - pace * toxicity.DECAY * values[q] - pace * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(got.weight, values[0] @ (values[1][:, 1] - values[1][:, 0]) * toxicity.GAIN, atol=2e-3) and got.bias == pytest.approx(values[2][1] - values[2][0], abs=1e-4)


def best_flow(patterns, quotas, most):
    """(flow, cost) of the best of all whole flows, by enumeration."""
    arcs = [(p, s) for p, (members, _) in enumerate(patterns) for s in members]
    best = (0, 0)
    for amounts in itertools.product(*(range(most * patterns[p][1] + 1) for p, _ in arcs)):
        into, out = [0] * len(quotas), [0] * len(patterns)
        for (p, s), x in zip(arcs, amounts, strict=True):
            into[s] += x
            out[p] += x
        if all(a <= b for a, b in zip(into, quotas, strict=True)) and all(x <= most * patterns[p][1] for p, x in enumerate(out)):
            cost = sum(sum(max(0, x - again * patterns[p][1]) for again in range(1, most)) for p, x in enumerate(out))
            best = max(best, (sum(amounts), -cost))
    return best


def test_flows_are_the_best_of_all():
    rng = random.Random(14)
    for _ in range(40):
        patterns = [(tuple(sorted(rng.sample(range(3), rng.choice([1, 2])))), rng.randrange(1, 3)) for _ in range(3)]
        quotas = [rng.randrange(6) for _ in range(3)]
        flows = mixing.route(patterns, quotas, 2)
        sent = [sum(f) for f in flows]
        cost = sum(max(0, x - patterns[p][1]) for p, x in enumerate(sent))
        assert (sum(sent), -cost) == best_flow(patterns, quotas, 2)


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(15)
    kinds = [["a"], ["b"], ["a", "b"], ["b", None], ["x"], ["y", "z"], ["z"], ["lone"], []]
    rows = [(k, " ".join(["w"] * rng.randrange(1, 9)), rng.choice(kinds), 0, "m") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, origins array<string>, copies int, mix_of string").repartition(3)
    mixed, about = mixing.mix(spark, docs, sources=F.col("origins"))
    got, about = mixed.collect(), {r["source"]: r for r in about.collect()}
    tokens = {}
    for _, text, members, _, _ in rows:
        key = tuple(sorted(members, key=lambda x: (x is not None, x or "")))
        tokens[key] = tokens.get(key, 0) + len(text.split())
    names = sorted({x for key in tokens for x in key}, key=lambda x: (x is not None, x or ""))
    sizes = {x: sum(n for key, n in tokens.items() if x in key) for x in names}
    assert {x: (r["source_size"], r["target"]) for x, r in about.items()} == {x: (sizes[x], pytest.approx(t)) for x, t in mixing.targets(sizes).items()}
    patterns = [(tuple(names.index(x) for x in key), n) for key, n in tokens.items()]
    flows = mixing.route(patterns, [round(about[x]["target"]) for x in names], 3)
    # as much in all and at the same cost as one flow over everything
    taken = {}
    for r in got:
        key = tuple(sorted(r["members"], key=lambda x: (x is not None, x or "")))
        taken[key] = taken.get(key, 0) + r["taken"]
    assert abs(sum(taken.values()) - sum(map(sum, flows))) <= 8 * len(tokens) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["routed"] for r in about.values()) == sum(map(sum, flows))
    assert len(got) == len(rows) and not any(r["copies"] for r in got if not r["members"])
    again = mixing.mix(spark, docs.repartition(5), sources=F.col("origins"))[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_columns_of_clashing_names(spark):
    names = ["doc_id", "text", "source", "toxicity", "id", "scored", "found_id", "mix_of", "mix_rank", "gone_id", "Gone_H", "__id", "k", "key", "d"]
    rows = [(k, f"some words {k % 5} and more of them here mail{k}@x.org", "ab"[k % 2], *["v"] * 12) for k in range(20)]
    docs = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS, np.float32), 0.0)
    scored = toxicity.score(spark, docs, model)
    assert sorted(scored.columns) == sorted(names) and {r["toxicity"] for r in scored.collect()} == {0.5}
    assert mixing.take(spark, docs).columns == names and pii.redact(spark, docs).columns == names
    assert {r["text"].split()[-1] for r in pii.redact(spark, docs).collect()} == {"[EMAIL]"}
    kept = parity.representatives(spark, docs)
    assert kept.columns == names and kept.count() == 20


def test_decoding_of_ids_that_are_no_pieces(spark, model):
    rows = [(1, [*model.encode("hello there"), 10**6, -1]), (2, None), (3, []), (4, [None, *model.encode("x")])]
    tokens = spark.createDataFrame(rows, "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in pieces.decode(spark, tokens, MODEL).collect()} == {1: "hello there", 2: "", 3: "", 4: "x"}
