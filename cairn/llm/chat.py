"""Chat formatting from reply trees.

Messages form trees by their parents. Iterative self-joins by pointer doubling give every message its root, its
depth and the score of its branch in a logarithmic number of rounds; leaves are ranked by branch score, and only
the paths of the chosen leaves are spelled out, by the same jump tables. Each path is formatted as one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import TEXT_BYTES, Workspace

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of others start so; texts never hold them unescaped.
_CONTROL = re.compile(r"<(?=\||/?s>|<SYS>>|</SYS>>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Doubles backslashes, then puts one after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans) of (role, text) turns; spans are code points of the assistant's escaped texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role or "").replace("\n", "\\\n") + "\n"
        body = escape(text or "")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation, in one pass: no escaped text holds a mark, so the next one ends it."""
    turns, at = [], 0
    while at < len(formatted):
        line = at
        while (line := formatted.find("\n", line)) >= 0:
            back = line
            while formatted[back - 1] == "\\":
                back -= 1
            if (line - back) % 2 == 0:
                break
            line += 1
        end = formatted.find(END + "\n", line)
        if not formatted.startswith(START, at) or line < 0 or end < 0:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations rendered in runs of about ``TEXT_BYTES`` of output."""

    def batch_of(batch: pa.RecordBatch, start: int, told: list) -> pa.RecordBatch:
        rows = [c.slice(start, len(told)) for c in batch.columns[:4]]
        return pa.RecordBatch.from_arrays([*rows, pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.list_(pa.list_(pa.int64())))], ["tree", "leaf", "rank", "score", "formatted", "loss"])

    for batch in batches:
        start, size, told = 0, 0, []
        for k in range(batch.num_rows):
            told.append(render([(x["role"], x["text"]) for x in batch.column(4)[k].as_py()]))
            size += len(told[-1][0])
            if size >= TEXT_BYTES:
                yield batch_of(batch, start, told)
                start, size, told = k + 1, 0, []
        if told:
            yield batch_of(batch, start, told)


def conversations(spark: SparkSession, messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, per_tree: int | None = 1) -> DataFrame:
    """One row per chosen root-to-leaf path: ``tree, leaf, rank, score, formatted, loss``.

    ``node`` is unique in its tree and not null; a null or unknown ``parent`` makes a root. ``score`` (null: 0)
    is summed along a branch; leaves of a tree rank by the mean, higher first, then by node, and the first ``per_tree``
    are formatted (None: all). A very long conversation must fit a task; its time grows with its length. A message below a cycle of parents belongs to no path. Messages repeated with
    one node keep the one of smallest role and text. Null trees are a tree, null texts and roles are empty, and
    ``loss`` has the spans of the assistant's texts in code points. Empty tables give empty results; other
    columns are ignored.
    """
    ws = Workspace(spark)
    value = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    said = messages.select(
        F.col(tree).alias("tree"),
        F.coalesce(F.concat(F.lit("v"), F.col(tree).cast("string")), F.lit("n")).alias("t"),
        F.col(node).alias("node"),
        F.col(parent).alias("parent"),
        F.struct(F.col(role).alias("role"), F.col(text).alias("text")).alias("turn"),
        value.alias("score"),
    )
    slim = said.groupBy("t", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    slim = ws.cut(slim)
    known = slim.select("t", F.col("node").alias("parent"), F.lit(True).alias("known"))
    # jump: the ancestor 2**r hops up; hops and total: of the part of the branch below it
    linked = slim.join(known, ["t", "parent"], "left")
    jump = ws.cut(linked.select("t", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("hops"), F.col("score").alias("total")))
    # only messages that have not reached their root take part in a round, so a few deep trees cost no more than themselves
    done, active, jumps, count = jump.where("up is null"), jump.where("up is not null"), [], jump.count()
    while active.limit(1).count() and (1 << len(jumps)) <= count:
        jumps.append(active)
        above = done.unionAll(active).select("t", F.col("node").alias("up"), F.col("up").alias("far"), F.col("hops").alias("h"), F.col("total").alias("s"))
        wide = active.join(above, ["t", "up"])
        step = ws.cut(wide.select("t", "node", F.col("far").alias("up"), (F.col("hops") + F.col("h")).alias("hops"), (F.col("total") + F.col("s")).alias("total")))
        done, active = done.unionAll(step.where("up is null")), step.where("up is not null")
    parents = slim.select("t", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = done.join(parents, ["t", "node"], "left_anti").withColumn("mean", F.col("total") / F.col("hops"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.col("mean").desc(), "node")))
    if per_tree is not None:
        ranked = ranked.where(F.col("rank") <= per_tree)
    chosen = ws.cut(ranked.select("t", F.col("node").alias("leaf"), "rank", F.col("mean").alias("score")))

    path = chosen.select("t", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for r, table in enumerate(jumps):
        far = path.join(table.select("t", "node", "up"), ["t", "node"])
        path = ws.cut(path.unionAll(far.select("t", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << r)).alias("above"))))
    one = said.groupBy("t", "node").agg(F.min("turn").alias("turn"), F.first("tree").alias("tree"))
    told = path.join(one, ["t", "node"]).groupBy("t", "leaf").agg(
        F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), F.col("turn.role").alias("role"), F.col("turn.text").alias("text")))).alias("turns")
    )
    out = told.join(chosen, ["t", "leaf"]).select("tree", "leaf", "rank", "score", "turns")
    types = dict(out.dtypes)
    return out.mapInArrow(_formatted, f"tree {types['tree']}, leaf {types['leaf']}, rank int, score double, formatted string, loss array<array<bigint>>")
