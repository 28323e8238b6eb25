"""The operators as queries over the driver's tables, with the columns that their contracts name."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, e8, licenses, linefirst, mixing, parity, pieces, pii, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(spark, _table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.BASE_KINDS)]
    told = F.sha2(pii.told("base").cast("binary"), 256).alias("base_sha256")
    return found.select(F.col("id").alias("doc_id"), *counts, told, pii.told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_e8_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e8.similar_vectors(spark, _table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = linefirst.judge(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return parity.similar_classes(spark, docs, size=3, percent=90).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.digests(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of formatted conversations, from the formatted text and the loss spans alone."""
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = chat.parse(formatted)
            loss = "".join(chat.unescape(formatted[a:b]) for a, b in spans)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], said.schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = said.unionByName(added).withColumn("node", F.row_number().over(order))
    nodes = nodes.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    told = chat.conversations(spark, nodes, tree="conv_id", per_tree=None)
    return told.select("tree", "formatted", "loss").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(spark, docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(spark, docs, model)
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = mixing.mix(spark, _table(spark, sf_dir, "documents"))
    sources = mixing.small(sources.select(F.col("source").alias("of"), "source_size", "target"))
    rows = rows.withColumn("source", F.element_at("members", 1)).join(sources, F.col("source").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(spark, _table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first"])

    def names(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"), best.alias("score"),
    )


def op10_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(spark, _table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op2_e8_cells": op2_e8_cells,
    "op3_line_quality": op3_line_quality,
    "op4_parity_join": op4_parity_join,
    "op5_piece_backtracking": op5_piece_backtracking,
    "op6_reply_trees": op6_reply_trees,
    "op7_subword_toxicity": op7_subword_toxicity,
    "op8_flow_mix": op8_flow_mix,
    "op9_signature_rules": op9_signature_rules,
    "op10_splitter_shards": op10_splitter_shards,
}

#: The SQL that the queries are held against lives in its own module.
from .oracles import ORACLE_SQL  # noqa: E402, F401
