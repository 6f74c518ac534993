"""Records of vehicles, signals, flows, logs and reports."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the generator behind ``draw``.
FACTORS, MODULUS = (48271, 69621, 16807), 2147483647


def draw(seed: int, *keys: Column) -> Column:
    """A whole number from 0 to ``MODULUS`` - 1 that depends on the keys and the seed only, not on partitions."""
    value = F.lit(seed).cast("bigint")
    for factor, key in zip(FACTORS, keys, strict=False):
        value = (value * factor + key.cast("bigint") * 7919 + 12345) % MODULUS
    return (value * FACTORS[0]) % MODULUS


def appended(vehicles: DataFrame, rows: DataFrame) -> DataFrame:
    """Vehicles and further ones, all of them or none: each needs an id of its own, a route, a type and a depart from 0 on."""
    missing = F.col("vehicle_id").isNull() | F.col("route_id").isNull() | F.col("vtype").isNull() | F.coalesce(F.col("depart") < 0, F.lit(True))
    doubled = rows.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vehicle_id")
    known = rows.join(vehicles.select("vehicle_id"), "vehicle_id", "left_semi").select("vehicle_id")
    bad = rows.where(missing).select("vehicle_id").unionByName(doubled).unionByName(known).agg(F.count(F.lit(1)).alias("bad"))
    return vehicles.unionByName(rows.crossJoin(F.broadcast(bad)).where("bad = 0").drop("bad"))


def first_runs(lines: DataFrame) -> DataFrame:
    """(file, line, vehicle, value) of each vehicle's first contiguous run of lines; what comes when it appears again goes.

    Lines meet the one before by a join, so no task sees a whole file.
    """
    before = lines.select("file", (F.col("line") + 1).alias("line"), F.col("vehicle").alias("previous"))
    begins = lines.join(before, ["file", "line"], "left").where(~F.col("vehicle").eqNullSafe(F.col("previous")))
    second = begins.groupBy("file", "vehicle").agg(F.sort_array(F.collect_list("line")).alias("starts")).select("file", "vehicle", F.get("starts", F.lit(1)).alias("again"))
    return lines.join(second, ["file", "vehicle"]).where("again is null or line < again").select("file", "line", "vehicle", "value")


def ancestors(log: DataFrame) -> DataFrame:
    """(name, step, source): the names that each one was made from, step by step back through a log (name, source).

    Each round goes twice as far back: ways of s steps are joined with all ways of at most s.
    """
    from roadlake.functions.storage import written

    found, reach = written(log.select("name", F.lit(1).cast("bigint").alias("step"), "source")), 1
    while True:
        on = found.select(F.col("name").alias("source"), (F.col("step") + reach).alias("step"), F.col("source").alias("from"))
        grown = written(found.where(F.col("step") == reach).select("name", "source").join(on, "source").select("name", "step", F.col("from").alias("source")))
        if grown.isEmpty():
            return found
        found, reach = written(found.unionByName(grown)), 2 * reach


def phase_order(phases: DataFrame) -> DataFrame:
    """(junction, phases, wrong): in each signal program, greens that no yellow of the same lanes follows, and other breaks of the cycle.

    ``phases`` has junction, k (from 0) and state, a letter a lane: G or g, y, r. The phase after
    the last one is the first.
    """
    order = W.partitionBy("junction").orderBy("k")
    follow = F.coalesce(F.lead("state").over(order), F.first("state").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    green, yellow = F.lower("state").contains("g"), F.col("state").contains("y")
    calm = F.translate(F.lower("state"), "g", "y") == F.col("follow")
    wrong = (green & ~yellow & ~calm) | (yellow & F.col("follow").contains("y")) | (~green & ~yellow)
    placed = phases.withColumn("follow", follow).withColumn("wrong", wrong.cast("bigint"))
    return placed.groupBy("junction").agg(F.count(F.lit(1)).alias("phases"), F.sum("wrong").alias("wrong"))


#: Points of a group that a task takes in turn.
FRONT_BLOCK = 1 << 17


def fronts(rows: DataFrame, group: str, first: str, second: str, block: int = FRONT_BLOCK) -> DataFrame:
    """``rows`` (with id) and front: 1 for what nothing in its group dominates, 2 for what only those do, and so on.

    Of two objectives to minimise, in order of both, a point is dominated by those before it that aren't above it
    in the second. Its front is then one more than the last of theirs, and all that later points need is the least
    second objective of each front. Points of a group are taken in blocks of ``block`` different ones, a round
    for each; groups side by side.
    """
    from roadlake.functions.storage import drop_written, written
    from roadlake.operators.sequences import placed

    points = rows.select(F.col(group).alias("_g"), F.col(first).alias("_a"), F.col(second).alias("_b")).distinct()
    points = written(placed(points, "_g", ["_a", "_b"]).withColumn("_k", F.floor(F.col("place") / block)))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"_g {kind(group)}, _a {kind(first)}, _b {kind(second)}, _front bigint, _low boolean"
    rounds, steps = (points.agg(F.max("_k")).first()[0] or 0) + 1, []
    for k in range(rounds):
        own = points.where(F.col("_k") == k).select("_g", "_a", "_b", F.lit(None).cast("bigint").alias("_front"))
        if steps:
            own = own.unionByName(steps[-1].where("_low").select("_g", F.lit(0).cast(kind(first)).alias("_a"), "_b", "_front"))
        steps.append(written(own.groupBy("_g").applyInPandas(_front_block, schema)))
    found = written(reduce(DataFrame.unionByName, [step.where("not _low") for step in steps]))
    drop_written(points, *steps)
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col(first) == F.col("_a")) & (F.col(second) == F.col("_b"))
    return rows.join(found, same).select(*rows.columns, F.col("_front").alias("front"))


def _front_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Fronts of a block's points, and the least second objective of each front after it."""
    known = rows["_front"].notna()
    low = rows[known].sort_values("_front")["_b"].tolist()
    points = rows[~known].sort_values(["_a", "_b"])
    out = []
    for b in points["_b"].tolist():
        k = bisect_right(low, b)
        low[k : k + 1] = [b]
        out.append(k + 1)
    points = points.assign(_front=out, _low=False)
    ends = rows.iloc[[0] * len(low)].assign(_b=low, _front=range(1, len(low) + 1), _low=True)
    return pd.concat([points, ends], ignore_index=True)


def visits(route: DataFrame, region: DataFrame) -> DataFrame:
    """(route_id, visit, left, right): all runs of each route in a region, numbered from 0."""
    inside = route.join(region.select("edge_id").distinct(), "edge_id", "left_semi")
    islands = inside.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("route_id").orderBy("pos")))
    found = islands.groupBy("route_id", "island").agg(F.min("pos").alias("left"), (F.max("pos") + 1).alias("right"))
    number = F.row_number().over(W.partitionBy("route_id").orderBy("left")) - 1
    return found.select("route_id", number.cast("bigint").alias("visit"), "left", "right")


def replaced_section(lines: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """Lines (section, k, line) of a report with one section's lines replaced."""
    return lines.where(F.col("section") != name).unionByName(rows.select(F.lit(name).alias("section"), "k", "line"))


def chosen_k(k: Column, routes: Column) -> Column:
    """How many routes to take: all for null, a share for 0 to 1, else a number; at least 1 and at most all."""
    asked = F.when(k.isNull(), routes).when(k <= 1, F.floor(k * routes)).otherwise(F.floor(k))
    return F.least(F.greatest(asked, F.lit(1)), routes).cast("bigint")


def acceptance(current: Column, new: Column, temperature: float) -> Column:
    """The chance that annealing takes a new energy."""
    return F.when(new < current, F.lit(1.0)).otherwise(F.exp((current - new) / temperature))


def clipped_times(times: Column, low: float, high: float) -> Column:
    """Green times kept inside their range, two digits."""
    return F.transform(times, lambda t: F.bround(F.least(F.greatest(t, F.lit(low)), F.lit(high)), 2))


def shifted(points: DataFrame) -> DataFrame:
    """Points (id, x, y) of which coincident ones are moved apart by a tenth each along x, in order of id."""
    place = F.row_number().over(W.partitionBy("x", "y").orderBy("id")) - 1
    return points.withColumn("x", F.col("x") + F.lit(0.1) * place)


def kept_tags(tags: Column, condition) -> Column:
    """The tags of which ``condition`` (key, value) holds."""
    return F.map_filter(tags, condition)


def changed_tags(tags: Column, key: str, old: str | None, to: tuple[str, str] | None = None, add: tuple[str, str] | None = None) -> Column:
    """Tags with ``key`` = ``old`` (any value for None) turned into ``to``, or with ``add`` beside it."""
    value = F.try_element_at(tags, F.lit(key))
    hit = value.isNotNull() if old is None else F.coalesce(value == old, F.lit(False))
    new = to or add
    rest = F.map_filter(tags, lambda k, _: (k != new[0]) & ((k != key) if to else F.lit(True)))
    return F.when(hit, F.map_concat(rest, F.create_map(F.lit(new[0]), F.lit(new[1])))).otherwise(tags)


def needed_members(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): what the relations ``seeds`` (id) hold, and what the relations among those hold, until nothing new comes.

    ``relations`` has id and member.
    """
    from roadlake.functions.storage import written

    found = new = written(seeds.select("id").distinct())
    while not new.isEmpty():
        reached = relations.join(new, "id", "left_semi").select(F.col("member").alias("id")).distinct()
        new = written(reached.join(found, "id", "left_anti"))
        found = written(found.unionByName(new))
    return found
