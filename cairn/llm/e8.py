"""Embedding near-duplicates by E8 cells.

A table projects unit vectors on ``8 * blocks`` random orthonormal directions, scales and shifts them and decodes
every eight coordinates to the nearest point of E8; the points are the cell. A vector is kept in its home cell of every
table, and looks for others there and in the neighbouring cells that lie nearest: those one of the 240 minimal
vectors away in one block or more, by the growth of the squared distance. The scale follows the dimension and the
threshold, so that with the defaults a pair just at the threshold meets in a table with a chance of about 0.3, and 23
tables miss one in some 3,000; closer pairs are missed more rarely still.

Equal vectors are one class, whose copies are counted and never paired. Everything that is kept in a cell or looks there is
first paired with the cell's hub, its smallest name; pairs that are left over are compared only where they lie in different
components. Candidates whose signs do not rule them out are verified by their cosine in double precision. Links are
counted afterwards: the members of a component are dealt into blocks, and every pair of blocks is one task that takes
all its cosines. No link becomes a row but those that the hubs gave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .text import U, mix
from .workspace import Workspace

TABLES = 23
BLOCKS = 2
SCALE = 4.0
PROBES = 4
#: Signs of 64 random projections, compared before vectors are fetched; a pair at the threshold fails by five standard deviations.
SIGN_BITS = 64
#: Classes of a component that a block holds at about most when its links are counted.
BLOCK_CLASSES = 1024


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    short = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            short.append(v)
    short += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(short)


MINIMAL = _minimal()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: where the sum is odd, the worst rounding is turned."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(1) % 2)
    off = x[odd] - point[odd]
    worst = np.abs(off).argmax(1)
    point[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight: the better of the integer and the half-integer coset."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=64)
def _table(table: int, dim: int, blocks: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([table, dim, blocks])
    directions = rng.standard_normal((dim, 8 * blocks))
    if dim >= 8 * blocks:
        directions = np.linalg.qr(directions)[0] * np.sqrt(dim)
    # every coordinate of a random unit vector now has the same spread in any dimension
    return directions * (scale / 8), rng.random(8 * blocks)


def _cell(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit names of cells (..., 8 * blocks)."""
    doubled = (2 * points).astype(np.int64).view(U)
    name = np.full(points.shape[:-1], table * 1_000_003 + dim, U)
    for k in range(points.shape[-1]):
        name = mix(name * U(0x9E3779B97F4A7C15) + doubled[..., k])
    return name


def cells(unit: np.ndarray, table: int, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES) -> np.ndarray:
    """Names of the home cell and of the ``probes`` best neighbouring cells of every row."""
    n, dim = unit.shape
    directions, shift = _table(table, dim, blocks, scale)
    x = unit @ directions + shift
    home = np.concatenate([nearest_e8(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)], 1)
    keep = min(probes + 1, len(MINIMAL))
    cost, move = np.zeros((n, 1)), np.zeros((n, 1, 0))
    for b in range(blocks):
        growth = 2 - 2 * (x - home)[:, 8 * b : 8 * b + 8] @ MINIMAL.T
        best = np.argpartition(growth, keep - 1, axis=1)[:, :keep]
        growth = np.concatenate([np.zeros((n, 1)), np.take_along_axis(growth, best, 1)], 1)
        moves = np.concatenate([np.zeros((n, 1, 8)), MINIMAL[best]], 1)
        both = (cost[:, :, None] + growth[:, None, :]).reshape(n, -1)
        few = np.argsort(both, axis=1, kind="stable")[:, : probes + 1]
        i, j = few // growth.shape[1], few % growth.shape[1]
        row = np.arange(n)[:, None]
        cost, move = np.take_along_axis(both, few, 1), np.concatenate([move[row, i], moves[row, j]], 2)
    return _cell(home[:, None, :] + move, table, dim)


def _lists(column: pa.Array) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, vector in double precision); None where a vector is null, zero or has null or non-finite components."""
    for row, value in enumerate(column):
        values = value.values
        if values is None or not len(values) or values.null_count:
            yield row, None
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        yield row, x if np.isfinite(x).all() and x.any() else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [None if x is None else int.from_bytes(hashlib.blake2b((x + 0.0).tobytes(), digest_size=8).digest(), "big", signed=True) for _, x in _lists(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), batch.column(1)], ["id", "d", "v"])


def _keys(tables: int, blocks: int, scale: float, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
            for row, x in _lists(batch.column(1)):
                by_dim.setdefault(len(x), []).append((row, x))
            for dim, found in by_dim.items():
                unit = _unit(np.array([x for _, x in found]))
                d = names[[row for row, _ in found]]
                signs = unit @ np.random.default_rng([dim, 99]).standard_normal((dim, SIGN_BITS)) >= 0
                sign = (signs.astype(U) << np.arange(SIGN_BITS, dtype=U)).sum(1, dtype=U).view(np.int64)
                for table in range(tables):
                    named = cells(unit, table, blocks, scale, probes)
                    wide = named.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named.ravel().view(np.int64)), pa.array(np.tile(np.arange(wide) == 0, len(d))), pa.array(np.repeat(d, wide)), pa.array(np.repeat(sign, wide))], ["cell", "home", "d", "sign"]
                    )

    return run


def _cosines(threshold: float):
    """Pairs whose cosine is at least the threshold; vectors of different lengths have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (batch.column(2), batch.column(3)))
            at, bt = (np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy()))) for c in (batch.column(2), batch.column(3)))
            same = np.diff(at) == np.diff(bt)
            ok = np.zeros(batch.num_rows, bool)
            for dim in np.unique(np.diff(at)[same]):
                rows = np.flatnonzero(same & (np.diff(at) == dim))
                pick = np.arange(dim)[None, :]
                ok[rows] = (_unit(u[at[rows][:, None] + pick]) * _unit(v[bt[rows][:, None] + pick])).sum(1) >= threshold
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (batch.column(0), batch.column(1))], ["a", "b"])

    return run


def _linked(threshold: float):
    """Rows that the classes of two blocks of one component, or of one block, are linked with in each other."""

    def run(group: pa.Table) -> pa.Table:
        copies, block = group["copies"].to_numpy(), group["block"].to_numpy()
        flat = pa.concat_arrays(group["v"].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        unit = _unit(flat.reshape(len(copies), -1))
        low, alone = group["lo"][0].as_py(), group["lo"][0].as_py() == group["hi"][0].as_py()
        left = np.flatnonzero(block == low)
        right = left if alone else np.flatnonzero(block != low)
        product = unit[left] @ unit[right].T
        linked = product >= threshold
        # the order of additions may turn the last digit, so what lies at the threshold is added up as pairs are
        i, j = np.nonzero(np.abs(product - threshold) < 1e-9)
        linked[i, j] = (unit[left[i]] * unit[right[j]]).sum(1) >= threshold
        if alone:
            np.fill_diagonal(linked, False)
        found = np.zeros(len(copies), np.int64)
        found[left] = linked @ copies[right]
        if not alone:
            found[right] = copies[left] @ linked
        return pa.table({"d": group["d"], "links": pa.array(found)})

    return run


def similar_vectors(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, probes: int = PROBES) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Rows are linked when the cosine of their vectors is at least ``threshold``. ``n_links`` counts the other rows
    linked directly, copies included; ``component_id`` is the smallest id reachable, ``kept`` whether that is the
    row's own id. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
    do vectors of different lengths. Repeated rows count as copies; a null id is never kept. Ties at the threshold are links.
    Other columns are ignored; an empty table gives an empty result. Vectors of any length are whole in one task's memory.
    """
    ws = Workspace(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    kind = dict(rows.dtypes)["v"]
    rows = ws.cut(rows.mapInArrow(_classify, f"id long, d long, v {kind}"))
    classes = ws.cut(rows.where("d is not null").groupBy("d").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))

    scale *= np.sqrt(0.1 / max(1 - threshold, 1e-3))
    keys = ws.cut(classes.select("d", "v").mapInArrow(_keys(tables, blocks, float(scale), probes), "cell long, home boolean, d long, sign long"))
    hubs = keys.where("home").groupBy("cell").agg(F.min(F.struct("d", "sign")).alias("hub"), F.count("*").alias("homes"))
    met = keys.join(hubs, "cell").where("homes > 1 or d <> hub.d")
    met = ws.cut(met.select("cell", "home", "d", "sign", F.col("hub.d").alias("hub"), F.col("hub.sign").alias("hub_sign"), "homes"))
    ws.drop(keys)
    off = np.arccos(threshold) / np.pi
    most = int(SIGN_BITS * off + 5 * np.sqrt(SIGN_BITS * off * (1 - off)))

    def open_(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most

    def verified(pairs: DataFrame) -> DataFrame:
        full = pairs.join(classes.select(F.col("d").alias("a"), F.col("v").alias("u")), "a").join(classes.select(F.col("d").alias("b"), "v"), "b")
        return ws.cut(full.select("a", "b", "u", "v").mapInArrow(_cosines(threshold), "a long, b long"))

    tried = met.where((F.col("d") != F.col("hub")) & open_("sign", "hub_sign"))
    tried = ws.cut(tried.select(F.least("d", "hub").alias("a"), F.greatest("d", "hub").alias("b")).distinct())
    links = verified(tried)
    parts = ws.cut(components(ws, links))

    crowd = met.where("homes > 1").select("cell", "home", "d", "sign", "hub").join(parts.select(F.col("node").alias("d"), "component"), "d", "left")
    crowd = ws.cut(crowd.withColumn("part", F.coalesce("component", "d")).drop("component"))
    home = crowd.where("home and d <> hub").select("cell", F.col("d").alias("h"), F.col("sign").alias("h_sign"), F.col("part").alias("h_part"))
    rest = crowd.join(home, "cell").where((F.col("d") != F.col("h")) & (F.col("part") != F.col("h_part")) & open_("sign", "h_sign"))
    rest = rest.select(F.least("d", "h").alias("a"), F.greatest("d", "h").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(rest)
    ws.drop(met, crowd, tried)
    if more.limit(1).count():
        parts = ws.cut(components(ws, links.unionAll(more)))

    nodes = ws.cut(parts.select(F.col("node").alias("d"), "component").join(classes.select("d", "copies"), "d"))
    counts = nodes.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("long").alias("blocks"))
    dealt = nodes.join(counts, "component").withColumn("block", F.expr("pmod(xxhash64(d), blocks)")).withColumn("other", F.explode(F.expr("sequence(0l, blocks - 1)")))
    dealt = dealt.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "d", "copies").join(classes.select("d", "v"), "d")
    others = dealt.groupBy("component", "lo", "hi").applyInArrow(_linked(threshold), "d long, links long").groupBy("d").agg(F.sum("links").alias("others"))

    named = classes.select("d", "rep", "copies").join(others, "d", "left").join(parts.select(F.col("node").alias("d"), "component"), "d", "left")
    named = ws.cut(named.select("d", "rep", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "d").alias("part")))
    smallest = named.groupBy("part").agg(F.min("rep").alias("least"))
    of = named.join(smallest, "part").select("d", "n", "least")
    ws.drop(links, more, nodes)
    out = rows.select("id", "d").join(of, "d", "left")
    component = F.when(F.col("d").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
