"""Congestion of edges over measuring intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions.formulas import congestion_index
from roadlake.operators.sequences import placed


def per_interval(dump: DataFrame) -> DataFrame:
    """(begin, edge_id, traveltime, ci): mean travel time of an edge in an interval, and its index.

    ``dump`` has begin, edge_id, traveltime, free_flow. Means go through integer thousandths, so
    that they don't depend on the order of summation.
    """
    mean = F.sum((F.col("traveltime") * 1000).cast("bigint")) / F.count("traveltime") / 1000
    cells = dump.groupBy("begin", "edge_id").agg(mean.alias("traveltime"), F.max("free_flow").alias("free_flow"))
    return cells.select("begin", "edge_id", "traveltime", congestion_index(F.col("traveltime"), F.col("free_flow")).alias("ci"))


def within(dump: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """Intervals that lie inside [low, high]."""
    return dump.where((F.col("begin") >= low) & (F.col("begin") + width <= high))


def mean_over_all(cells: DataFrame, edges: DataFrame, multiplier: float = 10.0, offset: float = 0.001) -> DataFrame:
    """(edge_id, ci) of every edge: the sum over observed intervals by the number of all intervals.

    Unobserved edges have the offset alone.
    """
    n = cells.agg(F.count_distinct("begin").alias("n"))
    sums = cells.groupBy("edge_id").agg(F.sum((F.col("ci") * 1000).cast("decimal(18,0)")).alias("s"))
    mean = F.coalesce(F.col("s").cast("double"), F.lit(0.0)) / 1000 / F.greatest("n", F.lit(1))
    return edges.select("edge_id").join(sums, "edge_id", "left").crossJoin(F.broadcast(n)).select("edge_id", F.bround((mean + offset) * multiplier, 3).alias("ci"))


def mean_over_observed(cells: DataFrame) -> DataFrame:
    """(edge_id, n, ci_milli): the mean index over the intervals in which an edge was seen, in thousandths."""
    sums = F.sum((F.col("ci") * 1000).cast("bigint"))
    return cells.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.floor(sums / F.count(F.lit(1))).alias("ci_milli"))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """(edge_id, ci_a, ci_b, diff) of two tables of mean indexes; a missing side counts as 0."""
    a, b = first.select("edge_id", F.col("ci_milli").alias("ci_a")), second.select("edge_id", F.col("ci_milli").alias("ci_b"))
    both = a.join(b, "edge_id", "full").fillna(0, ["ci_a", "ci_b"])
    return both.withColumn("diff", F.col("ci_a") - F.col("ci_b"))


def attribute_sum(dump: DataFrame, name: str) -> DataFrame:
    """(edge_id, total, per_interval): an attribute summed over intervals; missing values are 0."""
    total = F.sum(F.coalesce((F.col(name) * 1000).cast("bigint"), F.lit(0)))
    return dump.groupBy("edge_id").agg(total.alias("total"), F.floor(total / F.count_distinct("begin")).alias("per_interval"))


def smoothed(dump: DataFrame, alpha: float = 0.5, block: int = 1024) -> DataFrame:
    """(edge_id, n, smooth): measurements folded in order of begin and event_id, newest with weight alpha.

    A run of measurements turns what was smoothed before it, t, into factor * t + sum; two runs make one.
    So blocks of measurements are folded by themselves, and an edge's blocks one after another: no
    array holds all values of an edge.
    """
    at = placed(dump.select("edge_id", "begin", "event_id", "traveltime"), "edge_id", ["begin", "event_id"])
    steps = F.array_sort(F.collect_list(F.struct("place", "traveltime")))
    blocks = at.groupBy("edge_id", F.floor(F.col("place") / block).alias("b")).agg(steps.alias("s"))
    first = lambda x: x["place"] == 0
    step = lambda t, x: F.struct(F.when(first(x), 0.0).otherwise(t["factor"] * (1 - alpha)).alias("factor"), F.when(first(x), x["traveltime"]).otherwise(t["sum"] * (1 - alpha) + x["traveltime"] * alpha).alias("sum"))
    folded = blocks.select("edge_id", "b", F.size("s").alias("n"), F.aggregate("s", F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("sum")), step).alias("f"))
    runs = folded.groupBy("edge_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("b", "f"))).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda t, x: t * x["f"]["factor"] + x["f"]["sum"])
    return runs.select("edge_id", "n", F.floor(total * 1000).alias("smooth_milli"))


def contribution(changed: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row: changed vehicles, and how many of them use an edge that improved by a bound or more.

    ``changed`` has vehicle_id and edge_id, ``diffs`` edge_id and diff in thousandths.
    """
    flags = [F.max((F.coalesce(F.col("diff"), F.lit(0)) < -bound).cast("bigint")).alias(f"below_{bound}") for bound in (250, 500, 750)]
    each = changed.join(diffs.select("edge_id", "diff"), "edge_id", "left").groupBy("vehicle_id").agg(*flags)
    return each.agg(F.count(F.lit(1)).alias("changed"), *[F.coalesce(F.sum(f"below_{b}"), F.lit(0)).alias(f"below_{b}") for b in (250, 500, 750)])
