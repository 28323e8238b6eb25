"""The pipeline stage by stage against plain versions, on a small corpus."""

import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from brute import pii as plain_pii
from brute import similar

import corpus_pipeline
from cairn.llm import mixing, pii
from cairn.llm.workspace import scratch, shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(8), str(tmp_path_factory.mktemp("corpus"))
    calm = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "ve") for b in ("na", "ko", "li", "rem", "tis", "dor")]
    rows, labels = [(9000, None, None, None, None), (9001, "", "en", "a", 0)], []
    for k in range(400):
        words = [rng.choice(calm) + str(rng.choice(["", "s", "en"])) for _ in range(rng.randrange(20, 80))]
        toxic = k % 5 == 0
        for _ in range(len(words) // 12 if toxic else 0):
            words[rng.randrange(len(words))] = "idiot"
        if k % 7 == 0:
            words[3] = f"user{k}@mail.example.com"
        rows.append((k, " ".join(words), "en", rng.choice("abc"), 0))
        labels.append((k, int(toxic)))
    for k in range(1, 60, 2):  # copies and near copies
        words = rows[2 + k][1].split()
        rows.append((1000 + k, " ".join(words if k % 4 == 1 else [*words[:-1], "changed"]), "en", "c", 0))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "pii", "mixing", "encoding"]
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(str(tmp_path / name))
        made[name], docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert docs.schema.names == SCHEMA.replace("long", "").replace("string", "").replace(",", "").split()
    after = {name: made[follower].collect() for name, follower in zip(names, names[1:], strict=False)}
    before = made["toxicity"].collect()
    left = {r["doc_id"] for r in after["toxicity"]}
    toxic = {r["doc_id"] for r in before if "idiot" in (r["text"] or "")}
    assert len(toxic & left) <= 0.1 * len(toxic) and len({r["doc_id"] for r in before} - toxic - left) <= 0.03 * len(before)
    texts = {r["doc_id"]: r["text"] for r in after["toxicity"]}
    assert {r["doc_id"] for r in after["near_duplicates"]} == {i for i, (_, c) in similar(texts, 5, 80).items() if c == i}
    for r in after["pii"]:
        spans = [{"k": pii.KINDS.index(k), "s": a, "e": b} for k, a, b in plain_pii(texts[r["doc_id"]] or "")]
        assert r["text"] == (pii.blank_out(texts[r["doc_id"]], spans) if spans else texts[r["doc_id"]])
    kept = Counter(r["doc_id"] for r in after["mixing"])
    sizes = Counter()
    for r in after["pii"]:
        sizes[r["source"]] += len((r["text"] or "").split())
    words = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in after["pii"]}
    for source, target in mixing.targets(dict(sizes)).items():
        assert abs(sum(n * words[i][1] for i, n in kept.items() if words[i][0] == source) - target) <= 80
    assert max(kept.values()) <= 3
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    final = {r["doc_id"]: r["text"] for r in after["mixing"]}
    rows = docs.collect()
    assert Counter(r["doc_id"] for r in rows) == kept
    assert all(r["ids"] == library.encode(final[r["doc_id"]], add_eos=True) and r["n_tokens"] == len(r["ids"]) for r in rows)
    again = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_odd_corpora(spark, tmp_path):
    """Empty tables, repeated rows, rows without an id, empty and very long texts."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(300_000))
    ten = " ".join(f"t{k}" for k in range(40))
    rows = [(1, ten, "en", "a", 0), (1, ten, "en", "a", 0), (2, ten, "en", "b", 0), (None, ten, None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (4, long, "en", "a", 0), (5, long + " end", "en", "b", 0), (6, "other words of a lone text", "en", None, 0)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(1, 0), (6, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r["doc_id"] for r in found}
    assert ids <= {1, 4, 6} and {1, 6} <= ids | {4} and all(r["n_tokens"] == len(r["ids"]) for r in found)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("cairn-*"))
    with scratch(spark):
        assert pii.find(spark, spark.read.parquet(f"{tmp_path}/odd/documents.parquet")).count() == len(rows)
        assert set(folder.glob("cairn-*")) > before
    assert set(folder.glob("cairn-*")) == before
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "4", "6", "None"]
