"""The registered queries on the smallest tables: against DuckDB where SQL can express them, else against brute force."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from brute import WORD, lower
from brute import pii as plain_pii

from cairn.llm import licenses
from cairn.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("select doc_id, text from documents").fetchall()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_one_query_of_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted(map(str, found))
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())


def test_pii_query(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op1_bootstrapped_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        base, r = plain_pii(text), got[i]
        told = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(told)) and set(told) <= set(r["spans"].split(",")) | {""}
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]


def test_piece_query(spark, texts):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    for r in QUERIES["op5_piece_backtracking"](spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_toxicity_query(spark, texts):
    got = QUERIES["op7_subword_toxicity"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_license_query(spark, texts):
    for r in QUERIES["op9_signature_rules"](spark, SF).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + phrase.count(" ") + 1] == phrase.split()]
        starts = [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_shard_query(spark, texts):
    got = QUERIES["op10_splitter_shards"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(texts) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    widest = max(r["size"] for r in got)
    assert max(abs(x - sum(load) / 16) for x in load) <= widest + sum(load) / 16 / 64
    homes = {}
    for r in got:
        homes.setdefault(texts[r["doc_id"]], []).append(r)
    assert all(len({r["shard"] for r in rows}) == 1 for rows in homes.values() if sum(r["size"] for r in rows) <= sum(load) / 16 / 64)
    for shard in range(16):
        mine = [r["slot"] for r in got if r["shard"] == shard]
        assert sorted(mine) == list(range(len(mine)))


def test_words_of_the_mix(spark, texts):
    assert all(r["size"] == len(WORD.findall(texts[r["doc_id"]])) for r in QUERIES["op8_flow_mix"](spark, SF).collect())
