"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; a flow routes token capacity
from patterns to source quotas. A pattern offers its tokens once at cost 0, a second time at cost 1, a third
time at cost 2 and so on, so repetition is spread before it deepens. The flow of a pattern then becomes
whole copies of all its documents plus one more copy of a seeded selection of them.

Sources fall into groups that share no document with each other, most often of one source each. The flow falls apart with
them, so that of every group is found by itself, and the groups are spread over the tasks, however many there are.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .workspace import Workspace, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Plans of up to so many rows are broadcast; larger ones are joined by a shuffle.
SMALL = 20_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Tokens wanted of every source.

    Sources by code point, the null source last, take ``weights`` in turn and share the sum of all sizes. No
    target exceeds ``most`` times its source's size; the excess is shared again by weight until none does.
    """
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {name: weights[k % len(weights)] for k, name in enumerate(names)}
    found: dict[str | None, float] = {}
    while len(found) < len(names):
        rest = [x for x in names if x not in found]
        left = sum(sizes.values()) - sum(most * sizes[x] for x in found)
        share = sum(weight[x] for x in rest)
        full = [x for x in rest if weight[x] * left > most * sizes[x] * share]
        if not full:
            return found | {x: weight[x] * left / share for x in rest}
        found |= {x: float(most * sizes[x]) for x in full}
    return found


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], most: int) -> list[list[int]]:
    """Tokens from every pattern to each of its sources: a min-cost maximum flow with convex repetition costs.

    ``patterns`` are (source numbers, tokens). Shortest augmenting paths by cost, found by label correction.
    """
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # [to, capacity, cost, index of the reverse]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, tokens) in enumerate(patterns):
        for again in range(most):
            arc(source, p, tokens, again)
        for s in members:
            arc(p, n + s, most * tokens, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, sink, quota, 0)
    while True:
        cost: list[float] = [float("inf")] * len(graph)
        via: list[tuple[int, int] | None] = [None] * len(graph)
        cost[source], queue, queued = 0, deque([source]), [False] * len(graph)
        while queue:
            a = queue.popleft()
            queued[a] = False
            for k, (b, capacity, price, _) in enumerate(graph[a]):
                if capacity > 0 and cost[a] + price < cost[b]:
                    cost[b], via[b] = cost[a] + price, (a, k)
                    if not queued[b]:
                        queued[b] = True
                        queue.append(b)
        if via[sink] is None:
            break
        path, b = [], sink
        while b != source:
            a, k = via[b]
            path.append(graph[a][k])
            b = a
        amount = min(x[1] for x in path)
        for x in path:
            x[1] -= amount
            graph[x[0]][x[3]][1] += amount
    flows = []
    for p, (members, tokens) in enumerate(patterns):
        sent = {x[0] - n: most * tokens - x[1] for x in graph[p] if n <= x[0] < n + m}
        flows.append([sent[s] for s in members])
    return flows


def _routes(most: int):
    """Flows of one group of sources: rows of patterns (members, tokens) and of sources (one member, quota)."""

    def run(group: pa.Table) -> pa.Table:
        def order(members: list[str | None]) -> list[tuple[bool, str]]:
            return [(x is not None, x or "") for x in members]

        rows = group.select(["members", "tokens", "quota"]).to_pylist()
        sources = sorted((r for r in rows if r["quota"] is not None), key=lambda r: order(r["members"]))
        patterns = sorted((r for r in rows if r["quota"] is None), key=lambda r: order(r["members"]))
        number = {r["members"][0]: k for k, r in enumerate(sources)}
        flows = route([(tuple(number[x] for x in r["members"]), r["tokens"]) for r in patterns], [r["quota"] for r in sources], most)
        got = [0] * len(sources)
        for r, sent in zip(patterns, flows, strict=True):
            for x, amount in zip(r["members"], sent, strict=True):
                got[number[x]] += amount
        told = [(r["members"], sum(sent), r["tokens"], None, None) for r, sent in zip(patterns, flows, strict=True)]
        told += [(None, None, None, r["members"][0], got[k]) for k, r in enumerate(sources)]
        kinds = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds, strict=True)], ["of", "sent", "tokens", "got_of", "got"])

    return run


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, sources): how often each membership pattern is taken, and each source's size, target and tokens.

    ``selection`` has ``of`` (the pattern), ``whole`` (copies of all its rows) and ``cut``: rows whose rank is at most
    ``cut`` are taken once more. Up to ``SMALL`` rows are broadcast and applied without a shuffle.
    """
    ws = Workspace(spark)
    rows = ws.cut(docs.select(pattern(sources).alias("members"), word_count(F.col(text_col)).alias("size"), rank(id_col, seed).alias("rank")))
    found = ws.cut(rows.groupBy("members").agg(F.sum("size").alias("tokens")))
    about = ws.cut(_targets(ws, found, weights, most))
    quota = F.rint("target").cast("long")

    # patterns and sources by groups that share no document with each other
    def name(source: str) -> Column:
        return F.xxhash64(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))

    several = found.where("size(members) > 1").select(F.get("members", F.lit(0)).alias("head"), F.explode("members").alias("source"))
    groups = None if several.isEmpty() else ws.cut(components(ws, several.select(name("head").alias("a"), name("source").alias("b"))))

    def grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
        named = rows.withColumn("node", name("source"))
        if groups is None:
            return named.select(F.col("node").alias("group"), *columns)
        return named.join(small(groups), "node", "left").select(F.coalesce("component", "node").alias("group"), *columns)

    offered = grouped(found.withColumn("source", F.get("members", F.lit(0))), ["members", "tokens"])
    wanted = grouped(about.withColumn("quota", quota), ["source", "quota"]).select("group", F.array("source").alias("members"), "quota")
    both = offered.unionByName(wanted, allowMissingColumns=True)
    flows = ws.cut(both.groupBy("group").applyInArrow(_routes(most), "of array<string>, sent long, tokens long, got_of string, got long"))
    got = small(flows.where("of is null").select("got_of", "got"))
    tokens = F.col("tokens") > 0
    copies = flows.where("of is not null").select("of", F.when(tokens, F.expr("sent div tokens")).otherwise(0).alias("whole"), F.when(tokens, F.expr("sent % tokens")).otherwise(0).alias("rest"))
    copies = small(ws.cut(copies))
    about = about.join(got, F.col("source").eqNullSafe(F.col("got_of"))).select("source", "source_size", "target", F.col("got").alias("routed"))
    same = F.col("members").eqNullSafe(F.col("of"))

    # the rank up to which the rest is filled, in two steps: over the 4,096 leading digits, and inside the one that overflows
    digits = F.substring("rank", 1, 3)
    sums = rows.groupBy("members", digits.alias("digits")).agg(F.sum("size").alias("tokens"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("members").orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ws.cut(sums.withColumn("before", before).join(copies, same).select("of", "digits", "before", "tokens", "rest"))
    full = sums.where("before + tokens <= rest").groupBy("of").agg(F.max(F.concat("digits", F.lit("g"))).alias("cut"))
    split = small(sums.where("before < rest and before + tokens > rest").select("of", F.col("digits").alias("at"), "before", "rest"))
    inside = rows.join(split, same & (digits == F.col("at"))).groupBy("of", "before", "rest", "rank").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("of").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = inside.withColumn("inside", upto).where("2 * (before + inside) + size <= 2 * rest").groupBy("of").agg(F.max("rank").alias("cut"))
    cuts = full.unionAll(part).groupBy("of").agg(F.max("cut").alias("cut")).withColumnRenamed("of", "cut_of")
    chosen = ws.cut(copies.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").select("of", "whole", F.coalesce("cut", F.lit("")).alias("cut")))
    return chosen, about


def _targets(ws: Workspace, found: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``targets`` as a table of ``source, source_size, target``, from the tokens of every pattern."""
    sizes = found.select(F.explode("members").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").cast("long").alias("source_size"))
    # numbers in the order of the sources: the task of a range, and the place in it
    sizes = ws.cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    task, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, first = 0, []
    for r in sizes.groupBy(task.alias("task")).count().orderBy("task").collect():
        first.append((r["task"], before))
        before += r["count"]
    first = F.broadcast(ws.spark.createDataFrame(first, "task long, first long"))
    numbered = sizes.withColumn("task", task).join(first, "task").withColumn("k", ((F.col("first") + within) % len(weights)).cast("int"))
    sizes = ws.cut(numbered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1).cast("long").alias("weight")))
    whole = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    total, share, level = int(whole[0] or 0), int(whole[1] or 0), None
    left, all_shares = total, share
    full = F.lit(False)
    # the level left / share only rises, so what was full stays full
    while share and (left, share) != level:
        level = left, share
        full = F.expr(f"cast(weight as decimal(19,0)) * cast({left} as decimal(19,0)) > cast(source_size as decimal(19,0)) * cast({most * share} as decimal(19,0))")
        held = sizes.where(full).agg(F.sum("source_size"), F.sum("weight")).first()
        left, share = total - most * int(held[0] or 0), all_shares - int(held[1] or 0)
    even = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(share or 1))
    return sizes.select("source", "source_size", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(even).alias("target"))


def small(plan: DataFrame) -> DataFrame:
    """The table as one to broadcast if it has at most ``SMALL`` rows."""
    return F.broadcast(plan) if plan.limit(SMALL + 1).count() <= SMALL else plan


def pattern(sources: Column | None) -> Column:
    members = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array(F.lit(None).cast("string")))
    return F.sort_array(F.array_distinct(members), asc=False)


def rank(id_col: str, seed: int) -> Column:
    """The seeded order of rows: hexadecimal digits that depend on the id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def copies_of(size: Column, most: int = 3) -> Column:
    """Copies of a row beside its pattern's ``whole`` and ``cut`` and its own ``rank``."""
    more = (F.col("rank") <= F.col("cut")).cast("long")
    return F.when(size == 0, 0).otherwise(F.least(F.col("whole") + more, F.lit(most))).cast("long")


def mix(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sources: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): what the mix takes of every row, and each source's size, target and routed tokens.

    ``sources`` is an array column of a row's sources (default: the ``source`` column alone; null is a source of its
    own, rows of an empty array have none and are never taken). ``rows`` has one row per input row: ``id, members, size`` (words, a null text has none), ``copies``
    (how often the mix takes the row whole) and ``taken = copies * size``; no row is taken more than ``most``
    times. The selection depends on ids and the seed, so reruns agree; repeated ids of one pattern go together.
    Rows without words are never taken. A target lying half-way between two ranks takes the earlier row (ties at half a row's
    size are taken). Texts are whole, however long; one larger than its source's remaining target moves the sum by half its
    size at most. An empty table gives empty results, other columns are ignored.
    """
    chosen, about = plan(spark, docs, id_col=id_col, text_col=text_col, sources=sources, weights=weights, most=most, seed=seed)
    rows = docs.select(F.col(id_col).alias("id"), pattern(sources).alias("members"), word_count(F.col(text_col)).alias("size"), rank(id_col, seed).alias("rank"))
    rows = rows.join(small(chosen), F.col("members").eqNullSafe(F.col("of")))
    out = rows.select("id", "members", "size", copies_of(F.col("size"), most).alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size")), about


def take(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0) -> DataFrame:
    """The mixed rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    chosen, _ = plan(spark, docs, id_col=id_col, text_col=text_col, weights=weights, most=most, seed=seed)
    of, whole, cut, members, place, copy = (unused(x, docs.columns) for x in ("mix_of", "mix_whole", "mix_cut", "mix_members", "mix_rank", "mix_copy"))
    wide = docs.withColumn(members, pattern(None)).withColumn(place, rank(id_col, seed))
    wide = wide.join(small(chosen.toDF(of, whole, cut)), F.col(members).eqNullSafe(F.col(of)))
    more = F.col(whole) + (F.col(place) <= F.col(cut)).cast("long")
    copies = F.when(word_count(F.col(text_col)) == 0, 0).otherwise(F.least(more, F.lit(most))).cast("int")
    return wide.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*(F.col(c) for c in docs.columns))
