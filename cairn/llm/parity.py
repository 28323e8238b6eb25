"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. XOR-hashing the set into a bit sketch, one flipped bit a
shingle, makes the Hamming distance of two sketches a lower bound of the symmetric difference, so equal parts
of a sketch are a necessary condition. Two sets of at most ``u`` shingles with Jaccard similarity ``p`` % differ
in at most ``D = 2u(100 - p)/(100 + p)`` shingles. Documents are dealt into size bands whose bounds grow by
100/p, so that partners lie in one band or in neighbouring ones; a band's sketch has ``c > D`` chunks of 4,096
bits, of which at least ``c - D`` hold no differing shingle. Chunk values are the join keys.

Chunks with few shingles tell little, so only the ``D + k`` that hold most are keys. If every set takes them in one order of
all chunk values (falling number of shingles, then hash), two sets with ``c - D`` values in common have ``k`` of their
first ``D + k`` in common. One key may be shared by chance, three rarely are; so ``k`` is three, but for small sets, whose
chunks would be empty.

Documents with equal sets are one class throughout. A similar pair either meets in a bucket of more than three classes, or
``k`` times in buckets of up to three, where all pairs are counted. In the larger ones every class is first paired with the
hub, the class that stands in most of them; pairs that are left over are compared only where they still lie in different
components, by their sketches inside the join. Candidates are compared by parity sketches of a fixed width, then by
sketches that grow with the set, and those that both leave open are verified on the exact shingle sets.

Links are counted afterwards: both ends of a link lie in one component, so the members of a component are dealt
into blocks and every pair of blocks is one task that intersects all its sets exactly. No pair becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .text import U, mix, shingle_sets
from .workspace import Workspace, text_slices, unused

#: Bits of a sketch chunk.
CHUNK_BITS = 4096
#: Classes whose texts are fetched by a broadcast of their ids and text hashes (16 bytes each); beyond it by a shuffled join.
BROADCAST_IDS = 500_000
#: Keys that two similar sets have in common at least, but where they differ in fewer than ``FEW`` shingles.
SHARED, FEW = 3, 8
#: Set digests a task remembers, so as to send the keys of copies once; the set is emptied beyond it.
REMEMBERED = 200_000
#: 64-bit words of the parity sketch that every class has, for comparing the members of a bucket.
SKETCH_WORDS = 8
#: Sets from this size on have a second sketch, of one to two bits a shingle.
WIDE = 256
#: Classes and shingles of a component that a block holds at about most when its links are counted.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles that are intersected at once; so many ones add up exactly in float32.
BLOCK_COLUMNS = 2048
_SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]


@lru_cache(maxsize=16)
def bands(percent: int, upto: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands; a size and its partners (up to 100/percent times it) span two bands at most."""
    first = [1]
    while first[-1] < upto:
        first.append(max(first[-1] + 1, (first[-1] - 1) * 100 // percent + 1))
    return np.array(first)


def _poisson_tail(mean: float, least: int) -> float:
    term, below = math.exp(-mean), 0.0
    for k in range(least):
        below += term
        term *= mean / (k + 1)
    return 1 - below


@lru_cache(maxsize=4096)
def layout(band: int, percent: int) -> tuple[int, int, int]:
    """(D, k, number of chunks) for pairs whose larger set lies in the band.

    The more chunks, the more there are to choose the ``D + k`` fullest from, but the fewer shingles each has. So
    there are as many as leave most sets of the band ``D + k`` chunks with the largest least number of shingles.
    """
    first = bands(percent)
    largest, smallest = int(first[band + 1]) - 1, int(first[max(band - 1, 0)])
    most = 2 * largest * (100 - percent) // (100 + percent)
    again = SHARED if most >= FEW else 1
    wanted = most + again
    for least in (5, 4, 3, 2, 1):
        for chunks in range(wanted, wanted + 3 + wanted * 2 // 5, max(1, most // 64)):
            if chunks * _poisson_tail(smallest / chunks, least) >= wanted:
                return most, again, chunks
    return most, again, wanted


def chunk_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a sorted shingle set: those of its own band and of the next, where a larger partner may lie."""
    n = len(grams)
    own = int(np.searchsorted(bands(percent), n, "right")) - 1
    found = []
    for band in (own, own + 1):
        most, again, chunks = layout(band, percent)
        wanted = most + again
        if most == 0 or (band > own and n * 100 // percent < bands(percent)[band]):
            continue
        chunk = (grams >> U(32)) * U(chunks) >> U(32)
        start = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        count = np.diff(np.append(start, n))
        bit = mix(chunk * U(CHUNK_BITS) + (grams & U(CHUNK_BITS - 1)) + U(1))
        value = np.bitwise_xor.reduceat(bit, start) ^ mix(chunk[start] + U(band << 40))
        if len(start) < wanted:
            empty = np.setdiff1d(np.arange(chunks, dtype=U), chunk[start])
            value, count = np.concatenate([value, mix(empty + U(band << 40))]), np.append(count, np.zeros(len(empty), np.int64))
        # 16 bits of falling count, 47 of hash and one that tells k: the order and the key in one
        order = (U(0xFFFF) - np.minimum(count, 0xFFFF).astype(U)) << U(48) | mix(value) >> U(17) << U(1) | U(again == 1)
        found.append(np.partition(order, wanted - 1)[:wanted])
    return np.concatenate(found) if found else np.zeros(0, U)


def digest(grams: np.ndarray) -> int:
    """64 bits that stand for a set; two different sets agree with a chance of 2**-64."""
    both = np.array([np.bitwise_xor.reduce(grams), np.add.reduce(grams)])
    return int(mix(both * np.array([3, 5], U)).sum(dtype=U).astype(np.int64))


def _parity(grams: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((grams >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parity sketch of a set in ``SKETCH_WORDS`` words: a bit is on if an odd number of shingles fall on it."""
    return _parity(grams, 64 * SKETCH_WORDS).view(np.int64)


def wide_sketch(grams: np.ndarray) -> bytes | None:
    """A parity sketch whose bits are a power of two, from one to two a shingle; None for small sets."""
    return _parity(grams, 1 << len(grams).bit_length()).tobytes() if len(grams) >= WIDE else None


def apart(a: bytes, b: bytes) -> int:
    """Distance of two wide sketches; the longer one is folded, which leaves a parity sketch of the same set."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    both = np.bitwise_xor.reduce(x.reshape(-1, size), 0) ^ np.bitwise_xor.reduce(y.reshape(-1, size), 0)
    return int(np.bitwise_count(both.view(np.uint64)).sum())


def _narrowed(percent: int):
    """Pairs (a, b, na, nb, wa, wb) that their wide sketches, where both have one, do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            near = [a is None or b is None or (100 + percent) * apart(a, b) <= (100 - percent) * n for n, a, b in zip(sizes.tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return run


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            sets = [(len(g), digest(g) if len(g) else None, sketch(g), wide_sketch(g)) for g in shingle_sets(batch.column(2), size)]
            words = np.array([x[2] for x in sets], np.int64).reshape(len(sets), SKETCH_WORDS)
            columns = [pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(w)) for w in words.T), pa.array([x[3] for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "h", "n", "d", *_SKETCH, "wide"])

    return run


def _keys(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches, 0):
            keys, owners = [], []
            for grams in shingle_sets(batch.column(0), size):
                if len(grams) and (d := digest(grams)) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(d)
                    keys.append(chunk_keys(grams, percent))
                    owners.append(np.full(len(keys[-1]), d, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "d"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            found = {digest(g): g for g in shingle_sets(batch.column(0), size) if len(g)}
            sets = list(found.values())
            at = np.concatenate(([0], np.cumsum([len(g) for g in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["d", "grams"])

    return run


def _linked(percent: int):
    """Rows that the classes of two blocks of one component, or of one block, are linked with in each other."""

    def run(group: pa.Table) -> pa.Table:
        names, copies, block = (group[c].to_numpy() for c in ("d", "copies", "block"))
        grams = pa.concat_arrays(group["grams"].chunks)
        sizes = pc.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
        _, column, count = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = np.repeat(np.arange(len(sizes)), sizes)[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        alone = group["lo"][0].as_py() == group["hi"][0].as_py()
        left = np.flatnonzero(block == group["lo"][0].as_py())
        right = left if alone else np.flatnonzero(block != group["lo"][0].as_py())
        common = np.zeros((len(left), len(right)), np.int64)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
            a, b = np.searchsorted(column, [start, start + BLOCK_COLUMNS])
            held = np.zeros((len(sizes), BLOCK_COLUMNS), np.float32)
            held[row[a:b], column[a:b] - start] = 1
            common += (held[left] @ held[right].T).astype(np.int64)
        linked = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
        if alone:
            np.fill_diagonal(linked, False)
        found = np.zeros(len(sizes), np.int64)
        found[left] = linked @ copies[right]
        if not alone:
            found[right] = copies[left] @ linked
        return pa.table({"d": pa.array(names), "links": pa.array(found)})

    return run


def similar_classes(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` and ``n_links``.

    Two rows are linked when ``100 * |A and B| >= percent * |A or B|`` over their distinct word shingles (words
    ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); ``component_id`` is the smallest id reachable by links, its own
    included, and ``n_links`` counts the other rows linked directly, copies included. Null, empty and word-free
    texts have no shingle, link with nothing and keep their own id.
    Texts with fewer than ``size`` words have one shingle, the whole sequence. Repeated rows stay and are
    linked as copies; a null id never is a component's name unless all its ids are null. Other columns of
    ``docs`` are ignored, an empty table gives an empty result. Pairs just at ``percent`` are linked. Texts are whole,
    however long; a set takes eight bytes a shingle in the tasks that verify it.
    """
    return _similar(spark, docs, id_col, text_col, size, percent, True).drop("h", "least_h")


def _similar(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, counted: bool) -> DataFrame:
    """``similar_classes`` with ``h``, a hash of the text that tells rows of one id apart, and ``least_h``, the least
    of a component that has no id at all; ``n_links`` only if ``counted``."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100")
    ws = Workspace(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    rows = ws.cut(docs.mapInArrow(_signatures(size), "id long, h long, n long, d long, " + ", ".join(f"{w} long" for w in _SKETCH) + ", wide binary"))
    at = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h")).alias("at")
    classes = ws.cut(rows.where("n > 0").groupBy("d").agg(F.min("id").alias("rep"), at, F.max("n").alias("n"), F.count("*").alias("copies"), *(F.max(w).alias(w) for w in (*_SKETCH, "wide"))))

    keys = docs.select("text").where("text is not null").mapInArrow(_keys(size, percent), "key long, d long")
    order = Window.partitionBy("key").orderBy("d")
    met = keys.select("key", "d", F.lead("d").over(order).alias("next"), F.first("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    # one row of each class, the last, and none of a bucket that holds one class only
    met = met.where("next <> d or next is null and first <> d")
    buckets = ws.cut(met.select("key", "d", F.lag("d").over(order).alias("prev"), "first", F.count("*").over(Window.partitionBy("key")).alias("size")))

    def sets_of(ends: DataFrame) -> DataFrame:
        """The shingle sets (d, grams) of distinct classes, from one row of each (or its repetitions), with an id or without."""
        ids = ws.cut(ends.join(classes, "d").select(F.col("at.id").alias("at_id"), F.col("at.h").alias("at_h")))
        few = ids.count() <= BROADCAST_IDS
        same = (F.col("h") == F.col("at_h")) & F.col("id").eqNullSafe(F.col("at_id"))
        texts = docs.join(F.broadcast(ids) if few else ids, same, "left_semi").select("text")
        sets = ws.cut(texts.mapInArrow(_sets(size), "d long, grams array<long>"))
        ws.drop(ids)
        return sets.dropDuplicates(["d"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b, na, nb) of classes: by their wide sketches first, then by their sets."""
        wides = classes.where("wide is not null").select("d", "wide")
        small = F.expr(f"least(na, nb) < {WIDE}")
        both = pairs.where(~small).join(wides.toDF("a", "wa"), "a").join(wides.toDF("b", "wb"), "b").select("a", "b", "na", "nb", "wa", "wb")
        pairs = ws.cut(pairs.where(small).select("a", "b").unionAll(both.mapInArrow(_narrowed(percent), "a long, b long")))
        sets = sets_of(pairs.select(F.col("a").alias("d")).unionAll(pairs.select(F.col("b").alias("d"))).distinct())
        left = pairs.join(sets.select(F.col("d").alias("a"), F.col("grams").alias("ga")), "a")
        full = left.join(sets.select(F.col("d").alias("b"), F.col("grams").alias("gb")), "b")
        common = F.size(F.array_intersect("ga", "gb"))
        linked = F.expr(f"100 * i >= {percent} * (s - i)")
        return ws.cut(full.select("a", "b", common.alias("i"), (F.size("ga") + F.size("gb")).alias("s")).where(linked).select("a", "b"))

    def link_counts(parts: DataFrame) -> DataFrame:
        """(d, links): rows of other classes that a class is linked with."""
        nodes = ws.cut(parts.select(F.col("node").alias("d"), "component").join(classes.select("d", "n", "copies"), "d"))
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
        dealt = nodes.join(nodes.groupBy("component").agg(blocks.alias("blocks")), "component").withColumn("block", F.expr("pmod(xxhash64(d), blocks)"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0l, blocks - 1)")))
        dealt = dealt.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "d", "copies")
        pairs = dealt.join(sets_of(nodes.select("d")), "d").groupBy("component", "lo", "hi")
        return ws.cut(pairs.applyInArrow(_linked(percent), "d long, links long").groupBy("d").agg(F.sum("links").alias("links")))

    def described(rows: DataFrame, end: str) -> DataFrame:
        """Class rows as one end of a pair: its name, its size and its sketch."""
        return rows.select(F.col("d").alias(end), F.col("n").alias(f"n{end}"), *(F.col(w).alias(f"{end}{w}") for w in _SKETCH))

    # sizes and sketches that do not rule a link out; a bound, so no link is lost
    far = " + ".join(f"bit_count(a{w} ^ b{w})" for w in _SKETCH)
    open_ = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * ({far}) <= {100 - percent} * (na + nb)")

    # buckets of two and three: all pairs, as often as they meet
    few = buckets.where("size <= 3 and prev is not null")
    pair = F.explode(F.expr("if(prev = first, array(struct(first AS a, d AS b)), array(struct(first AS a, d AS b), struct(prev AS a, d AS b)))"))
    few = few.select("key", pair.alias("pair")).groupBy("pair.a", "pair.b").agg(F.sum(F.expr(f"if(key & 1 = 1, {SHARED}, 1)")).alias("times"))
    # larger ones: every class with the hub
    members = ws.cut(buckets.where("size > 3").select("key", "d"))
    ranked = members.join(members.groupBy("d").agg(F.count("*").alias("degree")), "d")
    hubs = ranked.groupBy("key").agg(F.max_by("d", F.struct("degree", "d")).alias("hub"))
    spokes = members.join(hubs, "key").where("d <> hub").select(F.least("hub", "d").alias("a"), F.greatest("hub", "d").alias("b"))
    tried = few.where(F.col("times") >= SHARED).select("a", "b").unionAll(spokes).distinct().join(described(classes, "a"), "a").join(described(classes, "b"), "b").where(open_)
    tried = ws.cut(tried.select("a", "b", "na", "nb"))
    ws.drop(buckets)
    links = verified(tried)
    parts = ws.cut(components(ws, links))

    placed = members.join(parts.select(F.col("node").alias("d"), "component"), "d", "left").select("key", "d", F.coalesce("component", "d").alias("part"))
    placed = ws.cut(placed)
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    left = ws.cut(placed.join(mixed, "key").join(classes.select("d", "n", *_SKETCH), "d"))
    ws.drop(members, placed)
    ends = [left.select("key", F.col("part").alias(f"p{end}"), F.col("d").alias(end), F.col("n").alias(f"n{end}"), *(F.col(w).alias(f"{end}{w}") for w in _SKETCH)) for end in "ab"]
    # all of this is the join's own condition: pairs that fail it are compared in place and never become rows
    rest = ends[0].join(ends[1], "key").where(F.expr("a < b and pa <> pb") & open_)
    rest = ws.cut(rest.select("a", "b", "na", "nb").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"))
    ws.drop(tried, left)
    more = verified(rest)
    if more.limit(1).count():
        parts = ws.cut(components(ws, links.unionAll(more)))

    named = classes.join(parts.select(F.col("node").alias("d"), "component"), "d", "left").select("d", "rep", "at.h", F.coalesce("component", "d").alias("part"))
    named = ws.cut(named)
    smallest = named.groupBy("part").agg(F.min("rep").alias("component_id"), F.min("h").alias("least_h"))
    of = named.join(smallest, "part").select("d", "component_id", F.when(F.col("component_id").isNull(), F.col("least_h")).alias("least_h"))
    out = rows.join(of, "d", "left").select("d", "id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "least_h")
    if counted:
        counts = classes.select("d", "copies").join(link_counts(parts), "d", "left").select("d", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        counts = ws.cut(counts)
        out = out.join(counts, "d", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    ws.drop(links, rest, more)
    return out.drop("d")


def representatives(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are linked, over any number of links, with a row of smaller id.

    Of linked rows that all have a null id, the text of the least hash stays. Of repeated rows, equal in id and
    text, one stays. Rows without words stay. All columns stay, whatever their names; an empty table gives an empty result.
    """
    ws = Workspace(spark)
    found = ws.cut(_similar(spark, docs, id_col, text_col, size, percent, False))
    gone_id, gone_h = unused("gone_id", docs.columns), unused("gone_h", docs.columns)
    gone = found.where("component_id is not null and not (id <=> component_id) or least_h <> h").select(F.col("id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    kept = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_h)), "left_anti")
    if found.where("n_shingles > 0").groupBy("id", "h").count().where("count > 1").limit(1).count():
        blank = F.coalesce(F.col(text_col), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
        kept = kept.where(~blank).dropDuplicates([id_col, text_col]).unionByName(kept.where(blank))
    return kept
