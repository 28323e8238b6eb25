"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the 3- to 6-byte n-grams of its words, word ends included, lower-cased, with everything but
letters, digits and non-ASCII bytes taken as a gap. N-grams share vectors by hashing, so a misspelling or an unseen ending
has most of its vectors in common with the word that was learnt. The mean vector goes through a softmax of two
classes; vectors and weights are trained jointly in numpy. As the score is linear in the mean vector, scoring
reads one number per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import BLOCK, U, arrow_bytes, mix
from .workspace import give_back, text_runs, text_slices

#: Labelled rows to learn from, per class; chosen by a hash of the id. One task holds their n-gram counts.
SAMPLE = {0: 6000, 1: 2000}
BUCKET_BITS = 17
SHORTEST, LONGEST = 3, 6
DIM = 8
EPOCHS = 6
BATCH = 64
RATE = 0.03
#: Weight decay: n-grams that few texts hold must not decide alone.
DECAY = 1.0
#: The mean vector is multiplied by this before the softmax, which only changes the pace of learning.
GAIN = 64.0
SEED = 5

_KEEP = np.full(256, 32, np.uint8)
_KEEP[48:58] = np.arange(48, 58)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_ODD = mix(np.arange(1, 17, dtype=U)) | U(1)


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, valid, row start) of the n-grams of every length that begin at each byte of the padded rows.

    Rows are padded with a space in front, which also ends the row before.
    """
    buffer = np.append(np.insert(_KEEP[data], at[:-1], 32), np.full(LONGEST, 32, np.uint8))
    start = at[:-1] + np.arange(len(at) - 1)
    size = len(buffer) - LONGEST
    wide = buffer.astype(U)
    gap = buffer == 32
    packed = wide[:size] | wide[1 : size + 1] << U(8)
    valid = ~(gap[:size] & gap[1 : size + 1])
    for n in range(3, LONGEST + 1):
        valid = valid & ~gap[n - 2 : size + n - 2]
        packed = packed | wide[n - 1 : size + n - 1] << U(8 * (n - 1))
        if n >= SHORTEST:
            yield (packed * _ODD[n]) >> U(64 - BUCKET_BITS), valid, start


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of blocks of rows; a row longer than a block comes in parts cut at gaps."""
    data, at = arrow_bytes(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1, row + 1)
        if at[end] - at[row] <= BLOCK:
            yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        else:
            pos, stop = int(at[row]), int(at[row + 1])
            while pos < stop:
                cut = min(pos + BLOCK, stop)
                while cut < stop and _KEEP[data[cut]] != 32:
                    cut += 1
                yield row, data[pos:cut], np.array([0, cut - pos])
                pos = cut
        row = end


@dataclass
class Model:
    """What scoring needs: the logit of an n-gram and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for row, data, at in _pieces(column):
            rows = slice(row, row + len(at) - 1)
            each = seen = None
            for bucket, valid, start in grams(data, at):
                value = np.where(valid, self.weight[bucket], 0.0)
                each = value if each is None else each + value
                seen = valid.astype(np.int64) if seen is None else seen + valid
            total[rows] += np.add.reduceat(each, start)
            count[rows] += np.add.reduceat(seen, start)
        logit = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of every row's n-grams; shares add up to 1."""
    found: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for row, data, at in _pieces(column):
        for bucket, valid, start in grams(data, at):
            ends = np.append(start[1:], len(bucket))
            for k, (a, b) in enumerate(zip(start, ends, strict=True)):
                found[row + k].append(bucket[a:b][valid[a:b]].astype(np.int32))
    out = []
    for parts in found:
        index, times = np.unique(np.concatenate([*parts, np.zeros(0, np.int32)]), return_counts=True)
        out.append((index, (times / max(1, times.sum())).astype(np.float32)))
    return out


def fit(index: list[np.ndarray], share: list[np.ndarray], label: np.ndarray) -> Model:
    """Train vectors and softmax jointly by Adam on the cross entropy; a class without rows gives a constant."""
    size = 1 << BUCKET_BITS
    rate = (label.sum() + 0.5) / (len(label) + 1)
    if len(np.unique(label)) < 2:
        return Model(np.zeros(size, np.float32), float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    weights = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - rate, rate])).astype(np.float32)
    params = [vectors, weights, bias]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        pace = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            lengths = np.array([len(index[r]) for r in rows])
            rows, lengths = rows[lengths > 0], lengths[lengths > 0]
            if not len(rows):
                continue
            flat = np.concatenate([index[r] for r in rows])
            part = np.concatenate([share[r] for r in rows])[:, None] * np.float32(GAIN)
            at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            mean = np.add.reduceat(vectors[flat] * part, at)
            logit = mean @ weights + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            back = np.repeat(p @ weights.T, lengths, axis=0) * part
            slope = np.stack([np.bincount(flat, back[:, d], size) for d in range(DIM)], 1).astype(np.float32)
            step += 1
            for q, (value, grad) in enumerate(zip(params, (slope, mean.T @ p, p.sum(0)), strict=True)):
                first[q] += 0.1 * (grad - first[q])
                second[q] += 0.01 * (grad * grad - second[q])
                value -= pace * DECAY * value + pace * (first[q] / (1 - 0.9**step)) / (np.sqrt(second[q] / (1 - 0.99**step)) + 1e-8)
    return Model((vectors @ (weights[:, 1] - weights[:, 0]) * GAIN).astype(np.float32), float(bias[1] - bias[0]))


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 1):
        found = bags(batch.column(1))
        at = pa.array(np.concatenate(([0], np.cumsum([len(i) for i, _ in found]))).astype(np.int32))
        index = pa.array(np.concatenate([*(i for i, _ in found), np.zeros(0, np.int32)]))
        share = pa.array(np.concatenate([*(s for _, s in found), np.zeros(0, np.float32)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, index), pa.ListArray.from_arrays(at, share)], ["label", "index", "share"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all bags, as one row. They are ordered by content, not by arrival, so that reruns agree."""
    found: list[tuple[bytes, bytes, int]] = []
    for batch in batches:
        for k in range(batch.num_rows):
            index, share = (batch.column(c)[k].values.to_numpy() for c in (1, 2))
            found.append((index.tobytes(), share.tobytes(), batch.column(0)[k].as_py()))
    found.sort()
    model = fit([np.frombuffer(i, np.int32) for i, _, _ in found], [np.frombuffer(s, np.float32) for _, s, _ in found], np.array([y for _, _, y in found], np.int64))
    del found
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([model.bias])], ["weight", "bias"])


def is_held_out(id_col: str):
    """Rows that are never learnt from: crc32 of the id as text divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``SAMPLE`` rows a class that are not held out, first by a hash of the id.

    Labels that are null or neither 0 nor 1 and null ids are passed over; a label given twice counts once, an id with
    both labels is learnt as both, and of documents that share an id all are learnt. Null and empty texts are bags
    without n-grams. Without labels every score is one half. Texts are whole; a long one has one entry per distinct n-gram
    bucket, so no bag exceeds 131,072 entries.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~is_held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = None
    for label, most in SAMPLE.items():
        one = known.where(F.col("label") == label).distinct().orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(most)
        picked = one if picked is None else picked.unionAll(one)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("label", "text").mapInArrow(_bag_rows, "label int, index array<int>, share array<float>")
    # the bounded sample meets in one task of an executor; the driver gets the weights alone
    trained = rows.repartition(1).mapInArrow(_fit_rows, "weight binary, bias double").collect()
    if not trained:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0)
    return Model(np.frombuffer(bytes(trained[0]["weight"]), np.float32), trained[0]["bias"])


def score(spark: SparkSession, docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, the probability of label 1 (0 to 1).

    A null or empty text has no n-gram and gets the bias alone. Texts of any length are scored whole, a block at a time. Rows are scored one by one; a column of the name
    ``toxicity`` is replaced. An empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.scores(texts.slice(a, b - a)) for a, b in text_runs(texts)]
            yield pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())

    return docs.drop("toxicity").select("*", scored(docs[text_col]).alias("toxicity"))
