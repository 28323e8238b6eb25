"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(ws: Workspace, links: DataFrame) -> DataFrame:
    """Component of every linked node.

    ``links`` has long columns ``a`` and ``b``; order, repetition and self-links do not matter, rows with
    a null end are ignored. Returns ``(node, component)``, where ``component`` is the smallest node
    reachable. Nodes without links are absent. Every round first points the larger neighbours of a
    node at the smallest one (large star), then merges the stars below it (small star); both steps use a
    minimum that combines on the map side, and a join whose skewed keys can be split.
    """
    edges = ws.cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ws.cut(
            both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        merged = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        small = ws.cut(merged.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        ws.drop(edges, large)
        edges = small
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
