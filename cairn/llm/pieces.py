"""Exact SentencePiece (merge-type) encoding by backtracking, and decoding.

A token sequence is the merge encoding of a text if and only if every two adjacent tokens are what their joint text
merges into. So the encoder takes longest matches from an Aho-Corasick automaton and keeps a token if it is
compatible with the one before; else it tries the next shorter piece, and where none is left it goes back one token and
marks the position as failed in a bitfield, so that no position is tried twice. Compatibility is found by
re-merging the two pieces and remembered.

Merges never cross a boundary that no piece contains, so a text is cut before every run of spaces and around line
feeds; the encodings of these units are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import give_back, text_slices

SPACE = "▁"
#: Units a generation of the cache holds; two generations live at once.
CACHED = 250_000
#: Token pairs whose compatibility is remembered; the memory starts anew beyond it.
PAIRS = 300_000
#: The gain of two neighbours that no piece joins.
NO_PIECE = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) fields of a protocol buffer message; fixed-size values come as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
            yield key >> 3, value
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A merge model: vocabulary, encoder and decoder."""

    def __init__(self, model: bytes, cached: int = CACHED):
        self.text: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode("utf-8"))
                score.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kind.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only merge models with byte fallback are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models without text normalisation and with a leading space are supported")
        if any(k in (USER, UNUSED) for k in self.kind):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.end = next((i for i, t in enumerate(self.text) if t == "</s>" and self.kind[i] == CONTROL), None)
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == NORMAL}
        self.score = {t: score[i] for t, i in self.id.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", t, re.S) for t in self.id):
            raise ValueError("pieces that go on behind a word's end are not supported")
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == BYTE}
        self.alone = {t for t in self.id if len(t) == 1}
        if any(not self.alone.issuperset(t) for t in self.id):
            raise ValueError("pieces with characters that are no pieces are not supported")
        spelt = [t.replace(SPACE, " ").encode("utf-8") if k == NORMAL else bytes([int(t[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for t, k in zip(self.text, self.kind, strict=True)]
        self.bytes = {str(i): b for i, b in enumerate(spelt)}
        self.size = [len(t) for t in self.text]
        self.widest = max(map(len, self.id))
        self.shorter = {i: next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1) for t, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._unit = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self._units = _Cache(self.encode_unit, cached)
        # the words of a text without runs of spaces: a line feed starts a word of its own, without a space before it
        self._words = _Cache(lambda word: self.encode_unit(word if word[0] == "\n" else SPACE + word), cached)

    def merged(self, text: str) -> list[str]:
        """The pieces that repeated merging leaves, the best score first and the leftmost among equals."""
        parts, score = list(text), self.score.get
        gains = [score(a + b, NO_PIECE) for a, b in pairwise(parts)]
        while gains and (best := max(gains)) > NO_PIECE:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], NO_PIECE)
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], NO_PIECE)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joint text of two tokens merges into just these two."""
        known = self._pairs.get(a << 20 | b)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[a << 20 | b] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return known

    def forget(self) -> None:
        """Empty the caches."""
        self._pairs.clear()
        self._units.forget()
        self._words.forget()

    def encode_known(self, unit: str) -> list[int]:
        """Token ids of a unit whose characters are all in the vocabulary."""
        longest, size, shorter, pairs, widest = self.automaton.iter_long, self.size, self.shorter, self._pairs, self.widest
        tokens: list[int] = []
        last = -1
        greedy = [i for _, i in longest(unit)]
        for token in greedy:
            if last >= 0 and not (pairs.get(last << 20 | token) or self.compatible(last, token)):
                break
            tokens.append(token)
            last = token
        else:
            return tokens
        at, stop = sum(map(size.__getitem__, tokens)), len(unit)
        open_at = bytearray(b"\xff" * (stop // 8 + 1))  # one bit a position: not known to fail
        while at < stop:
            while token >= 0:
                end = at + size[token]
                if open_at[end >> 3] >> (end & 7) & 1 and (last < 0 or pairs.get(last << 20 | token) or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, last = end, token
                if at < stop:
                    token = next(longest(unit[at : at + widest]))[1]
            else:
                open_at[at >> 3] &= ~(1 << (at & 7))
                token = tokens.pop()
                last = tokens[-1] if tokens else -1
                at -= size[token]
        return tokens

    def encode_unit(self, unit: str) -> list[int]:
        if self.alone.issuperset(unit):
            return self.encode_known(unit)
        ids: list[int] = []
        known = ""
        for char in unit:
            if char in self.alone:
                known += char
            else:
                ids += self.encode_known(known) if known else []
                ids += [self.byte[b] for b in char.encode("utf-8")]
                known = ""
        return ids + (self.encode_known(known) if known else [])

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by spaces, with the end id."""
        if not text:
            return str(self.end)
        words = text.replace("\n", " \n").split(" ")
        if "" in words or SPACE in text:  # runs of spaces belong to one unit
            found = map(self._units.__getitem__, self._unit.findall(SPACE + text.replace(" ", SPACE)))
        else:
            found = map(self._words.__getitem__, words)
        return " ".join(found) + f" {self.end}"

    def encode(self, text: str) -> list[int]:
        """Ids of a text, with the end id."""
        return list(map(int, self.encode_text(text).split(" ")))

    def decode_text(self, ids: str) -> bytes:
        """UTF-8 of the text that decimal ids stand for: control ids vanish, as does one leading space of the first piece."""
        each = ids.split(" ") if ids else []
        try:
            out = b"".join(map(self.bytes.__getitem__, each))
        except KeyError:  # ids that are no pieces stand for nothing
            return self.decode_text(" ".join(i for i in each if i in self.bytes))
        first = next((i for i in each if self.kind[int(i)] != CONTROL), None)
        if first is not None and self.kind[int(first)] == NORMAL and out[:1] == b" ":
            out = out[1:]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return self.decode_text(" ".join(map(str, ids)))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Cache(dict):
    """Encodings as joined decimal ids: two generations, of which the older is given up."""

    def __init__(self, encode: Callable[[str], list[int]], cached: int):
        super().__init__()
        self._encode, self._cached, self._old = encode, cached, {}

    def __missing__(self, unit: str) -> str:
        value = self._old.get(unit)
        if value is None:
            value = " ".join(map(str, self._encode(unit)))
        if len(unit) <= 64:
            if len(self) >= self._cached:
                self._old = dict(self)
                self.clear()
            self[unit] = value
        return value

    def forget(self) -> None:
        self.clear()
        self._old = {}


@lru_cache(maxsize=2)
def _load(name: str, cached: int = CACHED) -> Pieces:
    with open(SparkFiles.get(name), "rb") as file:
        return Pieces(file.read(), cached)


def ship(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to all executors; the name to load it by."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _ids(name: str, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(name, cached)
        try:
            for batch in text_slices(batches, 1):
                found = [np.array(pieces.encode_text(x.as_py() or "").split(" "), np.int32) for x in batch.column(1)]
                at = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))], ["id", "ids"])
        finally:
            pieces.forget()
            give_back()

    return run


def encode(spark: SparkSession, docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """``id, ids``: the token ids of every whole text, with the end id.

    Null and empty texts have the end id alone. A very long text is encoded whole, in time that grows with its length. Rows are encoded one by one: ids may be null or repeated, other
    columns are ignored, an empty table gives an empty result. A generation of the cache holds ``cached`` units (some 200
    bytes each) and is emptied when a task ends; the result does not depend on it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_ids(ship(spark, model), cached), f"id {dict(rows.dtypes)['id']}, ids array<int>")


def _texts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["id", "text"])

    return run


def decode(spark: SparkSession, tokens: DataFrame, model: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text``: the texts that token ids stand for.

    A null array gives an empty text; null ids and ids outside the vocabulary stand for nothing, control ids vanish, bytes
    that are no UTF-8 become U+FFFD. Rows are decoded one by one, whole; an empty table gives an empty result.
    """
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(_texts(ship(spark, model)), f"id {dict(rows.dtypes)['id']}, text string")


def _digests(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(name)
        for batch in text_slices(batches, 1):
            rows = []
            for x in batch.column(1):
                ids = pieces.encode_text(x.as_py() or "")
                rows.append((ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(pieces.decode_text(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(spark: SparkSession, docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass, told by their digests."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(ship(spark, model)), f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
