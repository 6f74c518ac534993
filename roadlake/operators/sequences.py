"""Routes as sequences of edges: runs, transitions, differences, splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import written


def as_lists(route: DataFrame) -> DataFrame:
    """(route_id, edges) from (route_id, pos, edge_id)."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "edge_id")))
    return route.groupBy("route_id").agg(F.transform(steps, lambda s: s["edge_id"]).alias("edges"))


def as_rows(lists: DataFrame) -> DataFrame:
    return lists.select("route_id", F.posexplode("edges").alias("pos", "edge_id")).withColumn("pos", F.col("pos").cast("bigint"))


def longest_run(route: DataFrame, network: DataFrame) -> DataFrame:
    """(route_id, left, right): the longest run of positions whose edges are in the network.

    The first of equally long ones; (0, 0) for routes without such an edge. Runs are islands:
    positions less their rank among the positions inside.
    """
    inside = route.join(network.select("edge_id").distinct(), "edge_id", "left_semi")
    order = W.partitionBy("route_id").orderBy("pos")
    islands = inside.withColumn("island", F.col("pos") - F.row_number().over(order)).groupBy("route_id", "island").agg(F.min("pos").alias("left"), (F.max("pos") + 1).alias("right"))
    best = islands.groupBy("route_id").agg(F.max(F.struct((F.col("right") - F.col("left")).alias("n"), (-F.col("left")).alias("l"), "right")).alias("b"))
    found = best.select("route_id", (-F.col("b.l")).alias("left"), F.col("b.right").alias("right"))
    return route.select("route_id").distinct().join(found, "route_id", "left").fillna(0, ["left", "right"])


def clipped(route: DataFrame, network: DataFrame, least: int = 1) -> DataFrame:
    """Routes cut to their longest run in the network, renumbered from 0; shorter runs go."""
    runs = longest_run(route, network).where(F.col("right") - F.col("left") >= least)
    inside = route.join(runs, "route_id").where("pos >= left and pos < right")
    return inside.select("route_id", (F.col("pos") - F.col("left")).alias("pos"), "edge_id")


def transitions(route: DataFrame) -> DataFrame:
    """(route_id, pos, from_edge, to_edge) of neighbouring positions."""
    order = W.partitionBy("route_id").orderBy("pos")
    pairs = route.select("route_id", "pos", F.col("edge_id").alias("from_edge"), F.lead("edge_id").over(order).alias("to_edge"))
    return pairs.where("to_edge is not null")


def broken_joints(route: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, broken): neighbouring edges that don't meet at a junction."""
    ends = edges.select("edge_id", "fj", "tj")
    order = W.partitionBy("route_id").orderBy("pos")
    placed = route.join(ends, "edge_id").withColumn("next_fj", F.lead("fj").over(order))
    return placed.groupBy("route_id").agg(F.coalesce(F.sum((F.col("tj") != F.col("next_fj")).cast("bigint")), F.lit(0)).alias("broken"))


def forbidden_turns(route: DataFrame, connections: DataFrame) -> DataFrame:
    """(route_id, forbidden): transitions that no connection allows, for routes with any."""
    bad = transitions(route).join(connections, ["from_edge", "to_edge"], "left_anti")
    return bad.groupBy("route_id").agg(F.count(F.lit(1)).alias("forbidden"))


def reindexed(route: DataFrame) -> DataFrame:
    """(route_id, edges, new_id): equal edge texts share an id r0, r1, … in order of first route_id.

    Ids are ranks within ranges of the first route_id plus the sizes of the ranges before, so that
    no task numbers all routes.
    """
    texts = as_lists(route).select("route_id", F.array_join("edges", " ").alias("edges"))
    firsts = texts.groupBy("edges").agg(F.min("route_id").alias("first"))
    numbered = dense_ids(firsts, "first")
    return texts.join(numbered, "edges").select("route_id", "edges", F.concat(F.lit("r"), F.col("id").cast("string")).alias("new_id"))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` and place: from 0 on within each group, by ``order``, whose last column tells rows of a group apart.

    Rows are dealt in ranges of (group, order), numbered inside each range, and each range begins where
    the group's rows in those before end. So a group of any size is many tasks' work; only the counts
    of a group's ranges meet in one place. Null groups are a group; nulls come first.
    """
    dealt = written(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(W.partitionBy("_part", group).orderBy(*order)) - 1
    counts = dealt.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_group").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_group", "_of", before.alias("_before"))
    found = dealt.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_group", "_of", "_before", "_inside")


def dense_ids(rows: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """``rows`` with id: 0, 1, … in order of a distinct whole-number key."""
    cells = rows.withColumn("_b", F.floor(F.col(key) / block))
    sizes = cells.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    rank = F.row_number().over(W.partitionBy("_b").orderBy(key)) - 1
    return cells.join(before, "_b").withColumn("id", F.col("_s") + rank).drop("_b", "_s")


def changed_slice(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(left, old right, new right) of the part in which two arrays differ; equal arrays give equal ends."""
    n = F.least(F.size(old), F.size(new))
    same_at = lambda k: F.get(old, k).eqNullSafe(F.get(new, k))
    run = lambda test: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), n), lambda k: (k == n) | ~test(k))), n)
    left = run(same_at)
    tail = F.least(run(lambda k: F.get(old, F.size(old) - 1 - k).eqNullSafe(F.get(new, F.size(new) - 1 - k))), n - left)
    return left, F.size(old) - tail, F.size(new) - tail


def route_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """(route_id, left, old_right, new_right, old_part, new_part) of routes that differ."""
    both = as_lists(first).join(as_lists(second).withColumnRenamed("edges", "other"), "route_id").where(~F.col("edges").eqNullSafe(F.col("other")))
    left, old, new = changed_slice(F.col("edges"), F.col("other"))
    part = lambda a, right: F.array_join(F.slice(a, F.col("left") + 1, F.col(right) - F.col("left")), " ")
    cut = both.select("route_id", "edges", "other", left.alias("left"), old.alias("old_right"), new.alias("new_right"))
    return cut.select("route_id", "left", "old_right", "new_right", part("edges", "old_right").alias("old_part"), part("other", "new_right").alias("new_part"))


def spliced(edges: Column, left: Column, right: Column, middle: Column) -> Column:
    """The array with [left, right) replaced."""
    return F.concat(F.slice(edges, F.lit(1), left), middle, F.slice(edges, right + 1, F.greatest(F.size(edges) - right, F.lit(0))))
