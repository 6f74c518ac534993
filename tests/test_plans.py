"""What queries must not do over again or through the driver, seen in their plans."""

import pytest

from roadlake.operators import flows
from roadlake.plans.queries import QUERIES
from roadlake.sources import network, sinks

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_are_not_dealt_anew_for_what_a_round_covers(spark, monkeypatch):
    plans, real = [], flows.written
    monkeypatch.setattr(flows, "written", lambda df: plans.append(plan(df)) or real(df))
    candidates = spark.createDataFrame([(i, i, 9 - i) for i in range(6)], "id bigint, start bigint, weight bigint")
    passes = spark.createDataFrame([(i, j) for i in range(6) for j in (i, i + 1)], "id bigint, junction bigint")
    assert flows.meeting_flows(candidates, passes, 4, batch=1).count() == 4
    joins = [line for text in plans for line in text.splitlines() if "LeftSemi" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


@pytest.mark.parametrize("name", ["planning_problem", "planning_totals"])
def test_runs_of_vehicles_are_found_once_for_all_facts(spark, name):
    assert plan(QUERIES[name](spark, SMALL)).count("lineitem.parquet") == 1


def test_elements_lie_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ELEMENTS", 10, raising=False)
    rows = spark.range(95, numPartitions=1).selectExpr("cast(id as string) as _id", "'a' as _from", "'b' as _to")
    sinks.write_elements(rows, f"{tmp_path}/edges", "net", "edge")
    assert len(list((tmp_path / "edges").glob("part-*"))) == 10
    found = network.in_file_order(network.elements(spark, f"{tmp_path}/edges", "edge", network.EDGE))
    assert [r["_id"] for r in found.orderBy("position").collect()] == [str(k) for k in range(95)]
