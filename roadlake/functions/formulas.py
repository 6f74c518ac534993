"""Column formulas of traffic measures; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def free_flow_time(length: Column, speed: Column) -> Column:
    """Seconds over an empty edge; null where the speed isn't positive."""
    return F.when(speed > 0, F.bround(length / speed, 3))


def congestion_index(measured: Column, free: Column) -> Column:
    """1 - free / measured, 0 where nothing or less than the free time was measured."""
    return F.when(measured > free, F.bround(1 - free / measured, 3)).otherwise(F.lit(0.0))


def route_capacity(length: Column, lanes: Column, car: float = 7.0) -> Column:
    """Cars that fit on a road."""
    return (F.greatest(F.floor(length / car), F.lit(1)) * F.greatest(lanes, F.lit(1))).cast("bigint")


def light_units(capacity: Column) -> Column:
    return F.greatest(F.bround(capacity * F.lit(0.35).cast("double")), F.lit(1.0)).cast("bigint")


def medium_units(capacity: Column) -> Column:
    return F.bround(capacity * F.lit(0.4).cast("double")).cast("bigint")


def penalised_cost(cost: Column, factor: int) -> Column:
    return (cost * factor).cast("bigint")


def distance(dx: Column, dy: Column) -> Column:
    return F.bround(F.sqrt(dx * dx + dy * dy), 3)


def parsed_shape(text: Column) -> Column:
    """array<struct(x, y)> of ``x1,y1 x2,y2``; empty for null."""
    point = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda p: p != ""), point)


def shape_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def fact(name: str, *parts: Column) -> Column:
    """``(name part part)``."""
    return F.concat(F.lit(f"({name} "), F.concat_ws(" ", *[p.cast("string") for p in parts]), F.lit(")"))
