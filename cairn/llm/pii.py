"""Personal data by bootstrapped contextual extraction.

Seeds are entities that their form gives away: emails, IP addresses, payment cards and phone numbers, which the base detectors
find, and secrets that cannot be anything else (long hexadecimal or mixed codes, keys with a known prefix). The words
around them are patterns, and every identifier-like mention is an instance. Spark scores the graph of patterns and
instances in rounds, until no pattern is added: a pattern is as good as the share of its instances that are known to be of
a kind, an instance as good as the best patterns it stands in. Patterns of high confidence and support then mark
mentions that no base detector knows: short or odd spellings, and secrets, which are only marked where a pattern
says so.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, text_slices, unused

#: The kinds of the base detectors, and all kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
#: Distinct instances a pattern needs, and the share of them that must be of its kind.
SUPPORT = 8
CONFIDENCE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its first digit fails from every other one, so matches start at the first
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may stand between a mention and the words beside it.
_OPENING, _CLOSING = " \t\n\"'([{<", " \t\n\"')]}>"
#: Identifier-like mentions, each to its end: numbers of seven digits or more, written apart or together, and words of six
#: characters or more with a digit or an @ in them.
_MENTION = re.compile(r"[+(]?[0-9](?:[().\x20/:-]{0,2}[0-9]){6,}+[^\s\"',;()=]*+|(?<![^\s\"'(=:\[{<])[^\s\"',;()=]{6,}+")
#: Codes that are secrets by their form: seeds of that kind.
_SEED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{40,}={0,2}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,})")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match needs an @ with local characters before it and a dotted domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and start; leftmost and non-overlapping within a kind."""
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def _name(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _shape(word: str) -> str:
    return _DIGIT.sub("0", word.strip(".,;:!?\"'()[]<>").lower())


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind that its form gives or -1, instance, patterns) of identifier-like mentions; base spans are all of them."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    spans = {(a, b): kind for kind, a, b in reversed(base)}
    starts, reach = [], []  # of the base spans by start, and the furthest end so far
    for a, b in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for m in _MENTION.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".,:;-/ ]}>":
            b -= 1
        if b - a >= 6 and (_DIGIT.search(text, a, b) or text.find("@", a, b) >= 0) and not ((k := bisect_left(starts, b)) and reach[k - 1] > a):
            spans[a, b] = SECRET if _SEED.fullmatch(text, a, b) else -1
    out = []
    for (a, b), kind in sorted(spans.items()):
        left = [_shape(w) for w in text[max(0, a - 80) : a].rstrip(_OPENING).split()[-2:]]
        right = [_shape(w) for w in text[b : b + 60].lstrip(_CLOSING).split()[:1]]
        patterns = [("l", *left[-1:]), ("ll", *left), ("r", *right), ("lr", *left[-1:], *right)]
        out.append((a, b, kind, _name(text[a:b].lower()), sorted({_name(*p) for p in patterns if all(p[1:]) and len(p) > 1})))
    return out


_SPAN = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
_MENTIONED = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.int32()), ("i", pa.int64()), ("p", pa.list_(pa.int64()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 2):
        base, found = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"k": k, "s": a, "e": b} for k, a, b in spans])
            found.append([{"s": a, "e": b, "k": k, "i": i, "p": p} for a, b, k, i, p in mentions(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, _SPAN), pa.array(found, _MENTIONED)], ["id", "digest", "base", "mentions"])


def find(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``id, digest, base, spans``: per input row the base spans and all spans, as arrays of (k, s, e).

    ``k`` numbers ``KINDS``; ``s`` and ``e`` are code points, the end exclusive; arrays are sorted. ``digest`` is
    ``xxhash64`` of the text. Base spans are always kept; added spans touch none of them. A mention that good patterns of
    several kinds mark takes the kind of the best score, of ties the first. Null and empty texts have no spans; texts
    are read whole, in time that grows with their length. Repeated rows stay, null ids are allowed, other columns are ignored,
    an empty table gives an empty result.
    """
    ws = Workspace(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    span = "array<struct<k:int,s:bigint,e:bigint>>"
    mention = "array<struct<s:bigint,e:bigint,k:int,i:bigint,p:array<bigint>>>"
    scanned = ws.cut(rows.mapInArrow(_scan, f"id {dict(rows.dtypes)['id']}, digest long, base {span}, mentions {mention}"))

    flat = scanned.where(F.size("mentions") > 0).select("id", "digest", F.explode("mentions").alias("m"))
    edges = ws.cut(flat.select(F.explode("m.p").alias("pattern"), F.col("m.i").alias("instance")).distinct())
    seeds = ws.cut(flat.where("m.k >= 0").select(F.col("m.i").alias("instance"), F.col("m.k").alias("kind"), F.lit(1.0).alias("score")).distinct())
    counts = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    known, good, before = seeds, None, -1
    while True:  # scores only rise, so the good patterns only grow, until they are all there are
        mass = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
        scored = mass.join(counts, "pattern").select("pattern", "kind", (F.col("mass") / F.col("n")).alias("score"))
        good = ws.cut(scored.where(F.col("score") >= confidence))
        if (now := good.count()) == before:
            break
        before = now
        told = edges.join(good, "pattern").groupBy("instance", "kind").agg(F.max("score").alias("score"))
        known = ws.cut(told.unionAll(seeds).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    found = F.col("m.k").isin(-1, SECRET)
    new = flat.where(found).select("id", "digest", F.col("m.s").alias("s"), F.col("m.e").alias("e"), F.explode("m.p").alias("pattern"))
    new = new.join(good, "pattern").groupBy("id", "digest", "s", "e").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("k"))
    added = new.groupBy("id", "digest").agg(F.collect_list(F.struct("k", "s", "e")).alias("added"))
    added = added.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), "added")
    joined = scanned.join(added, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return joined.select("id", "digest", "base", spans.cast(span).alias("spans"))


def told(spans: str) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets, e.g. ``[EMAIL]``.

    Where spans of two kinds overlap, the earlier and then longer one names the replacement, which covers both.
    Rows, their number and all other columns stay.
    """
    at, digest, spans = (unused(x, docs.columns) for x in ("found_id", "found_digest", "found_spans"))
    found = find(spark, docs, id_col=id_col, text_col=text_col).where(F.size("spans") > 0)
    found = found.select(F.col("id").alias(at), F.col("digest").alias(digest), F.col("spans").alias(spans)).dropDuplicates([at, digest])
    wide = docs.join(found, F.col(id_col).eqNullSafe(F.col(at)) & (F.xxhash64(text_col) == F.col(digest)), "left")

    @F.arrow_udf("string")
    def blanked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            yield pa.array([blank_out(t, s) if s else t for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(blanked(text_col, spans))
    return wide.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def blank_out(text: str, spans: list[dict]) -> str:
    parts, done = [], 0
    for x in sorted(spans, key=lambda x: (x["s"], -x["e"], x["k"])):
        if x["s"] >= done:
            parts += [text[done : x["s"]], f"[{KINDS[x['k']].upper()}]"]
        done = max(done, x["e"])
    return "".join([*parts, text[done:]])
