"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; ``root`` is the same over a component.

    Each round sends every node to the smallest of itself and its neighbours, follows
    those pointers once more, and replaces the ends of each edge by where they point.
    Edges inside one image vanish, so the table shrinks geometrically; all steps are
    aggregations and joins, and each round is cut by a written table. The smallest node of a
    component is never moved, hence ``root`` is the component's smallest node.
    Nulls at either end drop the edge; self loops yield the node alone.
    """
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    loops = live.where("u = v").select(F.col("u").alias("node"))
    live = written(_both_ways(live))
    found = None
    while not live.isEmpty():
        first = live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        first = written(first.select("node", F.least("node", "low").alias("up")))
        hop = first.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = written(first.join(hop, "up").select("node", F.col("top").alias("root")))
        old = [first, live] + ([step, found] if found is not None else [])
        found = step if found is None else written(_moved(found, step, "root").unionByName(step.join(found, "node", "left_anti")))
        live = written(_both_ways(_moved(_moved(live, step, "u"), step, "v")))
        for table in old:
            drop_written(table)
    if found is None:
        return loops.distinct().withColumn("root", F.col("node"))
    alone = loops.distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.withColumn("root", F.col("node")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    kept = pairs.where("u <> v")
    return kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _moved(table: DataFrame, step: DataFrame, name: str) -> DataFrame:
    """``table`` with column ``name`` replaced by where ``step`` sends it."""
    to = step.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    out: list[Column] = [F.coalesce("_to", name).alias(name) if c == name else F.col(c) for c in table.columns]
    return table.join(to, F.col(name) == F.col("_from"), "left").select(*out)
