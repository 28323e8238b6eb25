"""Sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by the 64-bit hash of their text, so that equal texts are neighbours. A size-weighted sample of
keys gives the quantiles that split this order into many small ranges; a key that fills a range's share of the
sample gets a range of its own. All ranges are then measured exactly, overfull ones are subdivided by a hash
of the id (rows that are equal in it as well, by their place), and the pieces are packed into shards in order, by the running total of bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Ranges per shard before subdivision: the packing error is about half a range at either end of a shard.
RANGES_PER_SHARD = 256
#: Expected sampled keys per range. The driver holds 16 * 16 * 256 sampled keys at the default, whatever the input.
SAMPLES_PER_RANGE = 16
#: A range of up to so many mean ranges stays whole (1/64 of a shard), so only larger groups of equal texts are spread.
WHOLE = 4
#: Cells of the key space for finding a key's range by an equi-join.
CELL_BITS = 12

_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def splitters(sample: list[tuple[int, int]], per_range: int) -> list[int]:
    """Inclusive upper ends of the ranges but the last, from (key, times sampled) pairs."""
    ends: set[int] = set()
    got, last = 0, None
    for key, times in sorted(sample):
        if times >= per_range:
            if last is not None:
                ends.add(last)
            if key > _LOWEST:
                ends.add(key - 1)
            ends.add(key)
            got = 0
        else:
            got += times
            if got >= per_range:
                ends.add(key)
                got = 0
        last = key
    return sorted(x for x in ends if x < _HIGHEST)


def pack(pieces: list[tuple[int, int, int, int]], shards: int, whole_bytes: float) -> list[tuple[int, int, int, int]]:
    """(range, part, shard, rows before it in the shard) for (range, part, bytes, rows) pieces in order."""
    total = sum(p[2] for p in pieces)
    by_range: dict[int, int] = {}
    for r, _, size, _ in pieces:
        by_range[r] = by_range.get(r, 0) + size
    placed, before, filled, at, shard_of = [], 0, [0] * shards, None, 0
    for r, part, size, rows in sorted(pieces):
        if by_range[r] > whole_bytes:
            shard_of = min(shards - 1, (2 * before + size) * shards // (2 * total))
        elif r != at:
            shard_of = min(shards - 1, (2 * before + by_range[r]) * shards // (2 * total))
        at = r
        placed.append((r, part, shard_of, filled[shard_of]))
        filled[shard_of] += rows
        before += size
    return placed


def shard(spark: SparkSession, docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, size, text_crc32, shard, slot``.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` their unsigned CRC; a null text counts as empty.
    Shards get nearly equal bytes and ``slot`` runs gapless from 0 in each. Equal texts share a shard unless
    they hold more than 1/64 of a shard's bytes; then they are spread over neighbouring shards. A single text larger
    than that moves the balance by its own size at most. The result depends on rows only, not on their
    order or partitions, but for large groups of rows equal in id and text, which are interchangeable and are dealt
    out by their place in the table. Null and repeated ids are allowed, other columns are ignored, an empty table gives an
    empty result.
    """
    ws = Workspace(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = ws.cut(rows.withColumn("sub", F.xxhash64("id", "key", F.lit(7))).withColumn("place", F.monotonically_increasing_id()))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))

    ranges = shards * RANGES_PER_SHARD
    wanted = ranges * SAMPLES_PER_RANGE
    # half of the sample weighs bytes, half rows, so that ranges of many tiny texts are cut as well
    share = F.col("size") * (wanted / 2 / total) + wanted / 2 / count
    chance = F.shiftrightunsigned(F.xxhash64("sub", F.lit(11)), 11) / float(1 << 53)
    sample = rows.select("key", F.floor(share + chance).alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times"))
    ends = splitters([(r["key"], r["times"]) for r in sample.collect()], SAMPLES_PER_RANGE)

    # the range of a key: the ends below its cell, and those below it in the cell
    shift = 64 - CELL_BITS
    cells: dict[int, list[int]] = {c: [] for c in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1)}
    for end in ends:
        cells[end >> shift].append(end)
    table, below = [], 0
    for cell, inside in cells.items():
        table.append((cell, below, inside))
        below += len(inside)
    lookup = F.broadcast(spark.createDataFrame(table, "cell long, below int, ends array<long>"))
    in_cell = F.size(F.filter("ends", lambda end: end < F.col("key")))
    ranged = rows.withColumn("cell", F.shiftright("key", shift)).join(lookup, "cell").withColumn("range", F.col("below") + in_cell).drop("cell", "below", "ends")

    mean_bytes, mean_rows = total / ranges, count / ranges
    parts = []
    for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        over = max(r["bytes"] / mean_bytes, r["rows"] / mean_rows)
        parts.append((r["range"], min(r["rows"], -int(-over // 1)) if over > 2 else 1))
    parts = F.broadcast(spark.createDataFrame(parts, "range int, parts long"))
    pieces = ranged.join(parts, "range").withColumn("part", F.pmod("sub", "parts")).drop("parts")

    def measure(pieces: DataFrame) -> list[Row]:
        return pieces.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()

    # rows equal in id and text have one hash; where they alone overfill a part, they are dealt out by their place in the table
    measured = measure(pieces)
    over = F.greatest(F.col("bytes") / mean_bytes, F.col("rows") / mean_rows)
    full = [(r["range"], r["part"]) for r in measured if r["rows"] > 1 and max(r["bytes"] / mean_bytes, r["rows"] / mean_rows) > 2]
    if full:
        full = F.broadcast(spark.createDataFrame(full, "range int, part long"))
        equal = pieces.join(full, ["range", "part"]).groupBy("range", "part", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        # each fills a mean range, so there are no more of them than ranges
        equal = equal.where((F.col("rows") > 1) & (over > 1)).select("range", "part", "sub", F.least("rows", F.ceil(over)).alias("ways")).collect()
        if equal:
            equal = F.broadcast(spark.createDataFrame(equal, "range int, part long, sub long, ways long"))
            dealt = F.col("part") + F.coalesce(F.pmod(F.xxhash64("place"), "ways"), F.lit(0)) * (1 << 40)
            pieces = pieces.join(equal, ["range", "part", "sub"], "left").withColumn("part", dealt).drop("ways")
            measured = measure(pieces)
    placed = pack([(r["range"], r["part"], r["bytes"], r["rows"]) for r in measured], shards, WHOLE * mean_bytes)
    placed = F.broadcast(spark.createDataFrame(placed, "range int, part long, shard int, before long"))
    order = Window.partitionBy("range", "part").orderBy("key", "sub", "id", "place")
    numbered = pieces.withColumn("at", F.row_number().over(order)).join(placed, ["range", "part"])
    return numbered.select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
