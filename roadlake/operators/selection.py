"""Skylines, crowding, bins, generated flows, and filters over tags."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.operators.records import draw
from roadlake.operators.sequences import placed


def pareto_front(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows that no other dominates in two objectives to minimise.

    The least second objective of each value of the first, then a running minimum over blocks of
    values and within them: no pairs are compared.
    """
    least = rows.groupBy(first).agg(F.min(second).alias("_low"))
    cells = least.withColumn("_b", F.floor(F.col(first) / 4096))
    blocks = cells.groupBy("_b").agg(F.min("_low").alias("_m"))
    before = blocks.select("_b", F.min("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_p"))
    inside = F.min("_low").over(W.partitionBy("_b").orderBy(first).rowsBetween(W.unboundedPreceding, -1))
    placed = cells.join(before, "_b").withColumn("_i", inside)
    alive = placed.where((F.col("_p").isNull() | (F.col("_p") > F.col("_low"))) & (F.col("_i").isNull() | (F.col("_i") > F.col("_low"))))
    return rows.join(alive.select(first, F.col("_low").alias(second)), [first, second], "left_semi")


def crowding(rows: DataFrame, group: str, objectives: list[str]) -> DataFrame:
    """``rows`` (with id) and their crowding in whole millionths: for each objective the gap
    between neighbours by the range of the group; ends count as one range.

    Neighbours are those of the places before and after (``sequences.placed``), found by joins, so a group
    that a third of all rows are in isn't one task's work.
    """
    out, total = rows, F.lit(0)
    for name in objectives:
        at = written(placed(rows.select(F.col(group).alias("_g"), F.col(name).alias("_v"), F.col("id").alias("_id")), "_g", ["_v", "_id"]))
        beside = lambda by, value: at.select(F.col("_g").alias("_h"), (F.col("place") + by).alias("_at"), F.col("_v").alias(value))  # noqa: B023, E731
        spans = at.groupBy(F.col("_g").alias("_s")).agg((F.max("_v") - F.min("_v")).alias("_span"))
        found = at
        for by, value in ((1, "_low"), (-1, "_high")):
            found = found.join(beside(by, value), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("place") == F.col("_at")), "left").drop("_h", "_at")
        found = found.join(spans, F.col("_g").eqNullSafe(F.col("_s")))
        gap = F.when(F.col("_span") == 0, 0).otherwise(F.coalesce(F.floor((F.col("_high") - F.col("_low")) * 1_000_000 / F.col("_span")), F.lit(1_000_000)))
        out = out.join(found.select(F.col("_id").alias("id"), gap.alias(f"_{name}")), "id")
        total = total + F.col(f"_{name}")
    return out.withColumn("crowding", total).drop(*[f"_{n}" for n in objectives])


def bin_offsets(points: DataFrame, width: int, block: int = 4096) -> DataFrame:
    """(cell, n, offset): points by cells of the x axis, and how many lie in cells before.

    Sums run over blocks of ``block`` cells and within each, so no task sees all cells.
    """
    counts = points.groupBy(F.floor(F.col("x") / width).alias("cell")).agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.floor(F.col("cell") / block))
    up_to = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("_b").agg(F.sum("n").alias("n")).select("_b", up_to(W.orderBy("_b")).alias("_before"))
    return counts.withColumn("_in", up_to(W.partitionBy("_b").orderBy("cell"))).join(blocks, "_b").select("cell", "n", (F.col("_before") + F.col("_in")).alias("offset"))


def uniform_flow(spark: SparkSession, start: int, end: int, count: int) -> DataFrame:
    """(vehicle_id, depart): departs spread evenly over [start, end], in whole hundredths of a second."""
    step = F.floor(F.col("id") * ((end - start) * 100) / max(count - 1, 1))
    return spark.range(count).select(F.col("id").alias("vehicle_id"), (F.lit(start * 100) + step).alias("depart"))


def random_flow(spark: SparkSession, start: int, end: int, period: int, low: int, high: int, seed: int) -> DataFrame:
    """(vehicle_id, depart): in each period a random number of vehicles at random times, in whole hundredths of a second.

    Numbers are drawn from the seed, the period and the vehicle's place in it, so they are the same
    on any cluster.
    """
    periods = spark.range((end - start) // period).withColumn("n", low + draw(seed, F.col("id")) % (high - low + 1))
    rows = periods.where("n > 0").select("id", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k"))
    depart = (start + F.col("id") * period) * 100 + draw(seed + 1, F.col("id"), F.col("k")) % (period * 100)
    return rows.select(F.concat_ws("-", "id", "k").alias("vehicle_id"), depart.alias("depart"))


#: Traffic of each third of an exponential flow, by least and most vehicles a period.
LEVELS = {"light": (1, 4), "medium": (5, 9), "heavy": (10, 20), "congested": (25, 40)}


def exponential_flow(spark: SparkSession, start: int, end: int, period: int, seed: int) -> DataFrame:
    """(phase, vehicle_id, depart): thirds of light, medium and heavy traffic; a drawn tenth of the periods goes one level up."""
    third = (end - start) // 3
    names = list(LEVELS)
    out = None
    for k in range(3):
        flows = [random_flow(spark, start + k * third, start + (k + 1) * third, period, *LEVELS[names[k + up]], seed + 2 * k + up) for up in (0, 1)]
        rises = draw(seed, F.split("vehicle_id", "-")[0].cast("bigint"), F.lit(k)) % 10 == 0
        for up, flow in enumerate(flows):
            part = flow.where(rises if up else ~rises).select(F.lit(names[k + up]).alias("phase"), F.concat_ws("-", F.lit(str(k)), "vehicle_id").alias("vehicle_id"), "depart")
            out = part if out is None else out.unionByName(part)
    return out


def unpivoted(matrix: DataFrame, key: str) -> DataFrame:
    """(origin, destination, weight) of a matrix with a column for each origin."""
    names = [c for c in matrix.columns if c != key]
    return matrix.unpivot([key], names, "origin", "weight").withColumnRenamed(key, "destination")


def tag_condition(text: str, tags: str = "tags") -> Column:
    """A filter like ``highway=primary and ( lanes>2 or name=Main* )`` as a column over a map.

    ``and`` binds closer than ``or``; brackets stand between spaces. ``=`` and ``!=`` take *
    at either end, an empty value means any; order is numeric where both sides are numbers.
    Further values of one key may follow it without the key (``amenity=bar =pub``): one of them must
    hold. A key takes * at either end too, and the first key of the map that fits counts. ``@id``,
    ``@uid`` and ``@user`` are the columns of these names.
    """
    tokens = text.split()
    sign = r"(!=|<=|>=|=|<|>)(.*)"

    def any_of(at: int) -> tuple[Column, int]:
        parts, at = (lambda p: ([p[0]], p[1]))(all_of(at))
        while at < len(tokens) and tokens[at] == "or":
            part, at = all_of(at + 1)
            parts.append(part)
        return reduce(lambda a, b: a | b, parts), at

    def all_of(at: int) -> tuple[Column, int]:
        parts, at = (lambda p: ([p[0]], p[1]))(term(at))
        while at < len(tokens) and tokens[at] == "and":
            part, at = term(at + 1)
            parts.append(part)
        return reduce(lambda a, b: a & b, parts), at

    def term(at: int) -> tuple[Column, int]:
        if at >= len(tokens):
            raise ValueError(f"a condition is missing in {text!r}")
        if tokens[at] == "(":
            inner, at = any_of(at + 1)
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"a bracket is open in {text!r}")
            return inner, at + 1
        m = re.fullmatch(r"([^=!<>]+)" + sign, tokens[at])
        if not m:
            raise ValueError(f"{tokens[at]!r} is no condition")
        value, at = _value_of(m[1], tags), at + 1
        parts = [_compared(value, m[2], m[3])]
        while at < len(tokens) and (more := re.fullmatch(sign, tokens[at])):
            parts.append(_compared(value, more[1], more[2]))
            at += 1
        return reduce(lambda a, b: a | b, parts), at

    out, end = any_of(0)
    if end != len(tokens):
        raise ValueError(f"{tokens[end]!r} is left over in {text!r}")
    return F.coalesce(out, F.lit(False))


def _value_of(key: str, tags: str) -> Column:
    if key in ("@id", "@uid", "@user"):
        return F.col(key[1:]).cast("string")
    if "*" not in key[:1] + key[-1:]:
        return F.try_element_at(F.col(tags), F.lit(key))
    inner = key.strip("*")
    test = {(True, True): "contains", (True, False): "endswith", (False, True): "startswith"}[key[0] == "*", key[-1] == "*"]
    return F.get(F.filter(F.map_entries(tags), lambda e: getattr(e["key"], test)(inner)), F.lit(0))["value"]


def _compared(value: Column, sign: str, want: str) -> Column:
    if sign in ("=", "!="):
        if want in ("", "*"):
            same = value.isNotNull()
        elif want.startswith("*") and want.endswith("*"):
            same = value.contains(want[1:-1])
        elif want.startswith("*"):
            same = value.endswith(want[1:])
        elif want.endswith("*"):
            same = value.startswith(want[:-1])
        else:
            same = value == want
        return F.coalesce(same if sign == "=" else ~same, F.lit(sign == "!="))
    tests = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
    as_text = tests[sign](value, F.lit(want))
    try:
        number = float(want)
    except ValueError:
        return F.coalesce(as_text, F.lit(False))
    return F.coalesce(tests[sign](value.try_cast("double"), F.lit(number)), as_text, F.lit(False))


def tag_counts(objects: DataFrame) -> DataFrame:
    """(key, value, n) over all tags of all objects."""
    return objects.select(F.explode("tags").alias("key", "value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def needed_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that some way refers to; ``ways`` has refs."""
    refs = ways.select(F.explode("refs").alias("id")).distinct()
    return nodes.join(refs, "id", "left_semi")
