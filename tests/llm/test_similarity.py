import random

import numpy as np
import pytest
from brute import components, shingles, similar
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import e8, graph, parity
from cairn.llm.text import BLOCK, shingle_sets, words
from cairn.llm.workspace import Workspace

import pyarrow as pa


@settings(deadline=None)
@given(st.lists(st.none() | st.text(alphabet="abAB \t\n é.", max_size=30), max_size=6), st.integers(1, 4))
def test_shingle_sets_have_the_sizes_of_plain_ones(texts, size):
    got = [len(g) for g in shingle_sets(pa.array(texts, pa.string()), size)]
    assert got == [len(shingles(t, size)) for t in texts]


def test_long_texts_hash_as_their_parts():
    word = "x" * (BLOCK + 5)
    text = f"alpha beta {word} " + "gamma delta " * (BLOCK // 6) + "end"
    (_, _, got, _), = words(pa.array([text]))
    parts = text.split()
    assert len(got) == len(parts) and got[0] == next(words(pa.array(["ALPHA"])))[2][0] and got[3] == got[5] and got[-1] == next(words(pa.array(["end"])))[2][0]


def near(words_, rng, edits):
    words_ = list(words_)
    for _ in range(edits):
        words_[rng.randrange(len(words_))] = f"w{rng.randrange(10**6)}"
    return " ".join(words_)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n", 3: "one", 4: "ONE", 5: "one two", 6: "one two"}
    for base in range(12):
        vocabulary = [f"v{rng.randrange(60 if base % 3 else 4000)}" for _ in range(rng.choice([6, 12, 25, 60, 150, 400]))]
        for _ in range(9):
            texts[len(texts)] = near(vocabulary, rng, rng.choice([0, 0, 1, 1, 2, 3, 5]))
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(15):
        texts[len(texts)] = f"{passage} own{k} tail{k}" + " z" * (k % 4)
    rows = [(i, t, "n/a", -1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, d int").repartition(5)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in parity.similar_classes(spark, docs, size=size, percent=percent).collect()}
    assert got == similar(texts, size, percent)
    kept = {r["doc_id"] for r in parity.representatives(spark, docs, size=size, percent=percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


def test_join_of_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert parity.similar_classes(spark, spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)]
    got = sorted(parity.similar_classes(spark, spark.createDataFrame(rows, schema)).collect(), key=str)
    assert [(r[0], r[1], r[2]) for r in got if r[1]] == [(4, 2, 4), (4, 2, 4), (None, 2, 4)]
    assert parity.representatives(spark, spark.createDataFrame(rows, schema)).count() == 2


@pytest.mark.parametrize("block", [512, 7])
def test_links_of_dense_groups_are_all_counted(spark, monkeypatch, block):
    monkeypatch.setattr(parity, "BLOCK_CLASSES", block)
    rng = random.Random(11)
    texts: dict[int, str | None] = {0: None, 1: "", 2: "one", 3: "ONE"}
    for base in range(3):
        words_ = [f"v{base}x{k}" for k in range(120)]
        for _ in range(40):
            texts[len(texts)] = near(words_, rng, rng.choice([0, 1, 1, 2, 3]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["n_links"] for r in parity.similar_classes(spark, docs, size=3, percent=90).collect()}
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    want = {a: sum(a != b and bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    assert got == want and sum(want.values()) > 1000


def test_near_copies_without_ids_are_linked(spark):
    words_ = [f"v{k}" for k in range(100)]
    text = lambda *changed: " ".join(f"x{k}" if k in changed else w for k, w in enumerate(words_))
    # 7 and 9 are linked only through the row without an id; the last two have no id at all
    rows = [(7, text(0, 1)), (None, text()), (9, text(98, 99)), (None, "y " + text(*range(40, 100))), (None, text(*range(40, 100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = parity.similar_classes(spark, docs, size=3, percent=93).collect()
    assert sorted((str(r["id"]), str(r["component_id"]), r["n_links"]) for r in got) == [("7", "7", 1), ("9", "7", 1), ("None", "7", 2), ("None", "None", 1), ("None", "None", 1)]
    assert sorted(str(r["doc_id"]) for r in parity.representatives(spark, docs, size=3, percent=93).collect()) == ["7", "None"]


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 10**6), st.sampled_from([(3, 90), (5, 80), (2, 80), (5, 60)]), st.integers(8, 1200))
def test_similar_sets_always_share_a_key(seed, how, n):
    _, percent = how
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64))
    b = a[rng.random(len(a)) > rng.random() * (100 - percent) / 100]
    more = rng.integers(0, 1 << 63, int(rng.integers(0, n // 10 + 1)), dtype=np.uint64)
    b = np.unique(np.concatenate([b, more]))
    common = len(np.intersect1d(a, b))
    if 100 * common >= percent * (len(a) + len(b) - common) and common < max(len(a), len(b)):
        shared = np.intersect1d(parity.chunk_keys(a, percent), parity.chunk_keys(b, percent))
        assert np.where(shared & np.uint64(1), parity.SHARED, 1).sum() >= parity.SHARED
        apart = sum(int(x).bit_count() for x in (parity.sketch(a).view(np.uint64) ^ parity.sketch(b).view(np.uint64)))
        assert apart <= len(a) + len(b) - 2 * common
        if min(len(a), len(b)) >= parity.WIDE:
            assert parity.apart(parity.wide_sketch(a), parity.wide_sketch(b)) <= len(a) + len(b) - 2 * common


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = graph.components(Workspace(spark), spark.createDataFrame([*links, (None, 5)], "a long, b long")).collect()
    want = components({x for ab in links for x in ab if ab[0] != ab[1]}, links)
    assert {r["node"]: r["component"] for r in got} == want


def test_nearest_points_are_nearest():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    point = e8.nearest_e8(x)
    assert np.allclose((2 * point) % 1, 0) and np.allclose(point.sum(1) % 2, 0) and len(e8.MINIMAL) == 240
    near_ = ((x - point) ** 2).sum(1)
    assert (near_[:, None] <= ((x[:, None, :] - point[:, None, :] - e8.MINIMAL[None]) ** 2).sum(2) + 1e-9).all() and near_.max() <= 1 + 1e-9


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    rows = [(c + 0.28 * rng.normal(size=64)) for c in centres for _ in range(5)]
    rows += [rows[0].copy(), rows[0].copy(), rows[7] * 3]
    data = [(k, [float(x) for x in v], k) for k, v in enumerate(rows)]
    odd = [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] * 64, 0), (904, [1.0, 2.0], 0), (905, [], 0)]
    got = {r["id"]: r for r in e8.similar_vectors(spark, spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, n_links int")).collect()}
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    cosine = unit @ unit.T
    links = [(a, b) for a in range(len(rows)) for b in range(a) if cosine[a, b] >= 0.9]
    found = sum(got[k]["n_links"] for k in range(len(rows))) / 2
    assert links and found <= len(links) and found >= 0.99 * len(links)
    if found == len(links):
        assert {k: got[k]["component_id"] for k in range(len(rows))} == components(range(len(rows)), links)
    assert all((got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True) for k in range(900, 906))
    assert e8.similar_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
