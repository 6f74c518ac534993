"""Scenarios: vehicles with routes; splitting, merging, comparing, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_routes(vehicles: DataFrame, lists: DataFrame) -> DataFrame:
    """Vehicles with the edges of their route; those without one go."""
    return vehicles.join(lists.select("route_id", "edges"), "route_id")


def merged(scenarios: list[DataFrame]) -> DataFrame:
    """All vehicles of some scenarios, (scenario, vehicle_id) as the key, with depart and edges."""
    parts = [s.select(F.lit(k).cast("bigint").alias("scenario"), "vehicle_id", "depart", "edges") for k, s in enumerate(scenarios)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged_changes(original: DataFrame, planned: list[DataFrame]) -> DataFrame:
    """(route_id, edges): the original, replaced by the last planned scenario that changes it."""
    changes = None
    for k, p in enumerate(planned):
        own = p.select("route_id", F.struct(F.lit(k).alias("k"), F.col("edges").alias("e")).alias("c"))
        changes = own if changes is None else changes.unionByName(own)
    differing = changes.join(original.select("route_id", F.col("edges").alias("_old")), "route_id").where(~F.col("c.e").eqNullSafe(F.col("_old")))
    last = differing.groupBy("route_id").agg(F.max("c").alias("c")).select("route_id", F.col("c.e").alias("_new"))
    return original.join(last, "route_id", "left").select("route_id", F.coalesce("_new", "edges").alias("edges"))


def change_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: routes in both, changed ones, and those whose first or last edge changed."""
    both = first.select("route_id", F.col("edges").alias("a")).join(second.select("route_id", F.col("edges").alias("b")), "route_id")
    count = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    return both.agg(
        F.count(F.lit(1)).alias("routes"),
        count(F.col("a") != F.col("b")).alias("changed"),
        count(F.element_at("a", 1) != F.element_at("b", 1)).alias("first_changed"),
        count(F.element_at("a", -1) != F.element_at("b", -1)).alias("last_changed"),
    )


def occupancy(route: DataFrame) -> DataFrame:
    """(edge_id, routes): on how many routes each edge is."""
    return route.select("route_id", "edge_id").distinct().groupBy("edge_id").agg(F.count(F.lit(1)).alias("routes"))


def intensity(vehicles: DataFrame, period: int) -> DataFrame:
    """(vtype, periods, vehicles, mean_milli, variance_milli) of vehicles in tumbling periods that have any.

    The mean and the population variance are whole thousandths.
    """
    counts = vehicles.groupBy("vtype", F.floor(F.col("depart") / period).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    n, s, q = F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n"))
    sums = counts.groupBy("vtype").agg(n.alias("periods"), s.alias("vehicles"), q.alias("q"))
    variance = F.floor((F.col("q") * F.col("periods") - F.col("vehicles") * F.col("vehicles")) * 1000 / (F.col("periods") * F.col("periods")))
    return sums.select("vtype", "periods", "vehicles", F.floor(F.col("vehicles") * 1000 / F.col("periods")).alias("mean_milli"), variance.alias("variance_milli"))


def flows(vehicles: DataFrame, route: DataFrame, n: int) -> DataFrame:
    """The n pairs of first and last edge with most vehicles; ties by the edges."""
    ends = route.groupBy("route_id").agg(F.min_by("edge_id", "pos").alias("first_edge"), F.max_by("edge_id", "pos").alias("last_edge"))
    counts = vehicles.join(ends, "route_id").groupBy("first_edge", "last_edge").agg(F.count(F.lit(1)).alias("vehicles"))
    return counts.orderBy(F.desc("vehicles"), "first_edge", "last_edge").limit(n)


def eta(vehicles: DataFrame, route: DataFrame, edges: DataFrame, region: DataFrame) -> DataFrame:
    """(vehicle_id, eta, state): seconds until the first edge of a region, and what to do about it.

    Free-flow times of the edges before are summed in whole thousandths. Under 10 s a vehicle is
    missed, under 20 s scheduled, else it waits; vehicles that never enter are left out.
    """
    times = edges.select("edge_id", F.floor(F.col("length") / F.col("speed") * 1000).alias("ms"))
    flags = region.select("edge_id", F.lit(True).alias("inside"))
    order = W.partitionBy("route_id").orderBy("pos")
    placed = route.join(times, "edge_id").join(flags, "edge_id", "left")
    before = F.coalesce(F.sum("ms").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = placed.withColumn("before", before).where("inside").groupBy("route_id").agg(F.min_by("before", "pos").alias("eta"))
    state = F.when(F.col("eta") < 10_000, "missed").when(F.col("eta") < 20_000, "scheduled").otherwise("waiting")
    return vehicles.join(first, "route_id").select("vehicle_id", "eta", state.alias("state"))


def bottlenecks(route: DataFrame) -> DataFrame:
    """(route_id, score): sum over transitions of routes that share them times the fan-out of their start."""
    from roadlake.operators.sequences import transitions

    steps = transitions(route)
    pairs = steps.groupBy("from_edge", "to_edge").agg(F.count(F.lit(1)).alias("n"))
    fan = pairs.groupBy("from_edge").agg(F.count(F.lit(1)).alias("fan"))
    weight = pairs.join(fan, "from_edge").select("from_edge", "to_edge", (F.col("n") * F.col("fan")).alias("w"))
    return steps.join(weight, ["from_edge", "to_edge"]).groupBy("route_id").agg(F.sum("w").alias("score"))


def entry_keys(route: DataFrame, region: DataFrame) -> DataFrame:
    """(first_edge, last_edge, routes): the distinct ends of routes' runs in a region of three edges or more.

    Alternative routes are sought once for each key and joined back to its routes.
    """
    from roadlake.operators.sequences import clipped

    cut = clipped(route, region, 3)
    ends = cut.groupBy("route_id").agg(F.min_by("edge_id", "pos").alias("first_edge"), F.max_by("edge_id", "pos").alias("last_edge"))
    return ends.groupBy("first_edge", "last_edge").agg(F.count(F.lit(1)).alias("routes"))


def eta_errors(planned: DataFrame) -> DataFrame:
    """One row of counts by the size and the sign of ``arrived`` less ``eta``, in milliseconds."""
    error = F.col("arrived") - F.col("eta")
    count = lambda test: F.coalesce(F.sum(test.cast("bigint")), F.lit(0))
    size = F.abs(error)
    return planned.agg(
        F.count(F.lit(1)).alias("vehicles"),
        count(size < 10_000).alias("below_10"),
        count((size >= 10_000) & (size < 20_000)).alias("below_20"),
        count(size >= 20_000).alias("above"),
        count(error > 0).alias("late"),
        count(error < 0).alias("early"),
    )


def turn_penalties(route: DataFrame, edges: DataFrame, lights: DataFrame) -> DataFrame:
    """(route_id, penalty): tenths for each turn: 10 less 3 a step of speed class, 2 less at a traffic light, at least 1.

    ``edges`` has edge_id, tj, class; ``lights`` has junction.
    """
    from roadlake.operators.sequences import transitions

    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tj").alias("junction"), F.col("class").alias("c"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("class").alias("d"))
    turns = transitions(route).join(a, "from_edge").join(b, "to_edge").join(lights.select("junction", F.lit(2).alias("off")), "junction", "left")
    penalty = F.greatest(10 - 3 * F.abs(F.col("c") - F.col("d")) - F.coalesce("off", F.lit(0)), F.lit(1))
    return turns.groupBy("route_id").agg(F.sum(penalty).alias("penalty"))


def penalised_bottlenecks(route: DataFrame, edges: DataFrame, lights: DataFrame) -> DataFrame:
    """(route_id, score): ``bottlenecks`` with each transition's weight times its turn's penalty (see ``turn_penalties``)."""
    from roadlake.operators.sequences import transitions

    steps = transitions(route)
    pairs = steps.groupBy("from_edge", "to_edge").agg(F.count(F.lit(1)).alias("n"))
    fan = pairs.groupBy("from_edge").agg(F.count(F.lit(1)).alias("fan"))
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tj").alias("junction"), F.col("class").alias("c"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("class").alias("d"))
    turns = pairs.join(fan, "from_edge").join(a, "from_edge").join(b, "to_edge").join(lights.select("junction", F.lit(2).alias("off")), "junction", "left")
    penalty = F.greatest(10 - 3 * F.abs(F.col("c") - F.col("d")) - F.coalesce("off", F.lit(0)), F.lit(1))
    weight = turns.select("from_edge", "to_edge", (F.col("n") * F.col("fan") * penalty).alias("w"))
    return steps.join(weight, ["from_edge", "to_edge"]).groupBy("route_id").agg(F.sum("w").alias("score"))


def entering_runs(original: DataFrame, planned: DataFrame, region: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, left, right): the longest run of each planned route in a region that starts at the junction where the original's run does."""
    from roadlake.operators.sequences import longest_run

    ends = edges.select("edge_id", "fj")
    runs = longest_run(original, region).where("right > left").select("route_id", F.col("left").alias("pos"))
    entry = original.join(runs, ["route_id", "pos"]).join(ends, "edge_id").select("route_id", F.col("fj").alias("entry"))
    inside = planned.join(region.select("edge_id").distinct(), "edge_id", "left_semi")
    islands = inside.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("route_id").orderBy("pos")))
    found = islands.groupBy("route_id", "island").agg(F.min("pos").alias("left"), (F.max("pos") + 1).alias("right"), F.min_by("edge_id", "pos").alias("edge_id"))
    fit = found.join(ends, "edge_id").join(entry, "route_id").where("fj = entry")
    best = F.max(F.struct((F.col("right") - F.col("left")).alias("n"), (-F.col("left")).alias("l"), "right")).alias("b")
    return fit.groupBy("route_id").agg(best).select("route_id", (-F.col("b.l")).alias("left"), F.col("b.right").alias("right"))
