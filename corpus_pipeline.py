"""A corpus pipeline of five stages, each reading what the one before has written.

Toxic documents go, one document of each group of near-duplicates stays, personal data is blanked out, sources are
mixed to their target weights, and the texts are encoded.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows and empty tables: null and empty
texts count as clean and are no one's copies, but the mix takes nothing without words; of repeated rows one stays; a null
source is a source of its own; extra columns stay up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import mixing, parity, pieces, pii, toxicity
from cairn.llm.workspace import Workspace, scratch


#: Cached units per task: the workers of all stages share the executors' memory.
CACHED = 125_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the model is learnt from the labelled documents among them."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(spark, docs, model).where("toxicity < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the one with the smallest id."""
    return parity.representatives(spark, docs, size=5, percent=80)


def blank_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.take(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids`` of every document that is left, with the end id."""
    found = pieces.encode(spark, docs.select(F.struct("doc_id", "source").alias("at"), "text"), public_tokenizers.path("piece_bpe_32k.model"), id_col="at", cached=CACHED)
    return found.select("id.doc_id", "id.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("pii", blank_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Stages that learn or sketch are beyond SQL; the tests hold the result against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            made = ws.cut(stage(spark, docs, sf_dir))
        if k:
            ws.drop(docs)
        docs = made
    return docs
