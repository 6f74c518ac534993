"""Flows that meet against a plain choice, drawn trips, and the report of flows."""

import random

import pytest
from pyspark.sql import functions as F

from roadlake.operators import flows


def plain(candidates, passes, amount):
    covered, starts, out = set(), set(), []
    while len(out) < amount:
        able = [(-w * len(passes[i] - covered), i, s) for i, s, w in candidates if s not in starts and passes.get(i) and (not out or covered & passes[i])]
        if not able:
            break
        gain, name, start = min(able)
        out.append((len(out) + 1, name, -gain))
        covered |= passes[name]
        starts.add(start)
    return out


@pytest.mark.parametrize(("seed", "batch", "room"), [(1, 3, 40), (2, 256, 1_000_000), (3, 1, 1)])
def test_meeting_flows_are_those_of_a_plain_choice(spark, seed, batch, room):
    dice = random.Random(seed)
    candidates = [(i, dice.randrange(60), dice.randint(1, 4)) for i in range(200)]
    passes = {i: {dice.randrange(40) + 40 * (i % 3) for _ in range(dice.randint(1, 9))} for i in range(200) if i % 17}
    df = spark.createDataFrame(candidates, "id bigint, start bigint, weight bigint")
    through = spark.createDataFrame([(i, j) for i, js in passes.items() for j in js] * 2 + [(None, 1), (3, None)], "id bigint, junction bigint")
    got = flows.meeting_flows(df, through, 12, batch, room)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == plain(candidates, passes, 12)


def test_meeting_flows_end_where_nothing_meets(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 1), (3, 3, 9), (4, 4, 0), (5, None, 7)], "id bigint, start bigint, weight bigint")
    through = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 30), (5, 10), (4, 11)], "id bigint, junction bigint")
    assert [tuple(r) for r in flows.meeting_flows(df, through, 9).orderBy("rank").collect()] == [(1, 1, 10), (2, 2, 0)]
    assert flows.meeting_flows(df.where("id > 9"), through, 3).count() == 0


def test_trips_follow_the_length_of_the_network(spark):
    edges = spark.createDataFrame([(1, 1500.0, 2), (2, 500.5, 1)], "edge_id bigint, length double, lanes int")
    ways = spark.createDataFrame([(7,), (9,), (11,)], "id bigint")
    trips = flows.random_trips(ways, edges, 100, 200, 10, 4).orderBy("trip").collect()
    # 3.5 km of lanes: 100 s / 3.5 / 10 is a period of 2.857 s.
    assert [r["depart"] for r in trips] == [100_000 + 2857 * k for k in range(35)]
    assert {r["way"] for r in trips} == {7, 9, 11}
    same = flows.random_trips(ways.repartition(3), edges, 100, 200, 10, 4).orderBy("trip").collect()
    assert trips == same
    assert flows.random_trips(ways.where("id < 0"), edges, 100, 200, 10, 4).count() == 0
    assert flows.random_trips(ways, edges.where("lanes > 9"), 100, 200, 10, 4).count() == 0


def test_report_counts_the_first_route_of_two_ends(spark):
    ends = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "c", "d")], "route_id bigint, from_junction string, to_junction string")
    cars = spark.createDataFrame([(1,)] * 9 + [(2,)] * 50, "route_id bigint")
    commands = spark.createDataFrame([("f", "a", "b", 0, 90), ("g", "c", "d", 0, 60), ("h", "x", "y", 0, 60), ("i", "a", "b", 5, 5)], "flow_name string, from_junction string, to_junction string, start_time bigint, end_time bigint")
    got = {r["flow_name"]: (r["duration"], r["total"], r["per_minute_tenths"]) for r in flows.flow_report(commands, ends, cars).collect()}
    assert got == {"f": (90, 9, 60), "g": (60, 0, 0), "h": (60, None, None), "i": (0, 9, None)}


def test_drawn_arguments_fit_their_kind(spark):
    pairs = spark.range(400).select((F.col("id") % 20).alias("from_junction"), F.col("id").alias("to_junction"))
    found = flows.drawn_flows(pairs, 0, 3600, 3).collect()
    assert {r["flow_name"] for r in found} == set(flows.KINDS)
    for r in found:
        if r["flow_name"] == "random_flow":
            assert 0 <= r["least"] <= r["most"] < 15 and r["period"] == 20 and r["vehicles"] is None
        elif r["flow_name"] == "uniform_flow":
            assert 720 <= r["vehicles"] < 1200 and r["rise"] is None
        else:
            assert 75 <= r["rise"] <= 145 and r["least"] is None


def test_flows_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(flows, "BLOCK", 4)
    table = spark.createDataFrame([(1, 0, 10, 5), (2, 100, 100, 1), (3, 0, 5, 0), (4, 0, 9, None), (5, 0, 100, 11)], "flow_id bigint, start bigint, end bigint, amount bigint")
    got = {}
    for r in flows.uniform_flows(table).orderBy("flow_id", "vehicle").collect():
        got.setdefault(r["flow_id"], []).append(r["depart"])
    assert got == {1: [0, 250, 500, 750, 1000], 2: [10000], 5: [1000 * k for k in range(11)]}
    fixed = flows.fixed_flows(table.select("flow_id", F.col("start").alias("depart"), "amount"))
    assert [tuple(r) for r in fixed.where("flow_id = 1").orderBy("vehicle").collect()] == [(1, k, 0) for k in range(5)]
    assert fixed.count() == 17 and flows.fixed_flows(table.where("flow_id > 9").withColumn("depart", F.lit(0))).count() == 0


def test_random_and_exponential_flows_of_a_table(spark):
    table = spark.createDataFrame([(k, 0, 3000, 300, k % 3, 4 + k % 3) for k in range(30)], "flow_id bigint, start bigint, end bigint, period bigint, low bigint, high bigint")
    sizes = flows.random_flows(table, 5).groupBy("flow_id", F.floor(F.col("depart") / 30000).alias("p")).count().collect()
    assert all(max(r["flow_id"] % 3, 1) <= r["count"] <= 4 + r["flow_id"] % 3 and 0 <= r["p"] < 10 for r in sizes) and len(sizes) > 250
    phases = flows.exponential_flows(table, 5).groupBy("flow_id", "phase", F.floor(F.col("depart") / 30000).alias("p")).count().collect()
    assert len(phases) == 300 and {r["phase"] for r in phases} == set(flows.LEVELS)
    order = list(flows.LEVELS)
    for r in phases:
        low, high = flows.LEVELS[r["phase"]]
        assert low <= r["count"] <= high and order.index(r["phase"]) - min(r["p"] * 3 // 10, 2) in (0, 1)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(flows.exponential_flows(table, 5)) == same(flows.exponential_flows(table.repartition(5), 5))
