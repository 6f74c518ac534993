"""The vehicle queue over streams: the same changes in any order of files, and those of a plain event loop."""

import datetime as dt
import random

import pandas as pd
import pytest

from roadlake.streaming import online, queue

from .test_operators import rows

START = 1_704_067_200


def plain(events, visits, until):
    """One loop over seconds, for all vehicles together."""
    state, out = {}, []
    by_second = {}
    for v, number, at, kind in events:
        by_second.setdefault(at, []).append((number, v, kind))
    for at in range(START, until + 1):
        for v in sorted(state):
            s = state[v]
            if s["on"] == "running" and not s["looked"] and at >= max(s["eta"] - 20, s["since"]):
                s["looked"] = True
                if s["eta"] - at >= 10:
                    s["on"] = "scheduled"
                    out.append((v, at, "scheduled", visits[v][s["k"]][0], s["k"]))
        for _, v, kind in sorted(by_second.get(at, [])):
            todo = visits.get(v, [])
            s = state.get(v)
            if kind == "departed" and s is None and todo:
                state[v] = s = {"on": "running", "k": 0, "eta": at + todo[0][1], "since": at, "looked": False}
                out.append((v, at, "running", todo[0][0], 0))
            elif s is None or s["on"] == "gone":
                continue
            elif kind == "planned" and s["on"] == "scheduled":
                s["on"] = "planned"
                out.append((v, at, "planned", todo[s["k"]][0], s["k"]))
            elif kind == "arrived":
                s["on"] = "gone"
                out.append((v, at, "arrived", todo[s["k"]][0], s["k"]))
            elif kind == "entered":
                out.append((v, at, "visited" if s["on"] == "planned" else "missed", todo[s["k"]][0], s["k"]))
                s["k"] += 1
                if s["k"] < len(todo):
                    s |= {"on": "running", "eta": at + todo[s["k"]][1], "since": at, "looked": False}
                    out.append((v, at, "running", todo[s["k"]][0], s["k"]))
                else:
                    s["on"] = "gone"
                    out.append((v, at, "discarded", None, s["k"]))
            # a way of no time to speak of is looked at in the same second
            if s and s["on"] == "running" and not s["looked"] and at >= max(s["eta"] - 20, s["since"]):
                s["looked"] = True
                if s["eta"] - at >= 10:
                    s["on"] = "scheduled"
                    out.append((v, at, "scheduled", todo[s["k"]][0], s["k"]))
    return sorted(out, key=repr)


def history(seed):
    rnd = random.Random(seed)
    visits = {v: [(rnd.randint(1, 3), rnd.choice([5, 12, 18, 40, 90])) for _ in range(rnd.randint(0, 3))] for v in range(12)}
    events, number = [], 0
    for v in range(14):
        at = START + rnd.randint(0, 60)
        for kind in ["departed", *rnd.choices(["planned", "entered", "departed"], [4, 4, 1], k=8), "arrived"]:
            events.append((v, number, at, kind))
            number, at = number + 1, at + rnd.choice([0, 5, 15, 30, 60])
    return events, visits


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_of_files(spark, tmp_path, seed):
    events, visits = history(seed)
    last = max(e[2] for e in events)
    table = spark.createDataFrame([(v, [{"region": r, "seconds": s} for r, s in x]) for v, x in visits.items() if x], "vehicle_id bigint, visits array<struct<region bigint, seconds bigint>>")
    want = plain(events, visits, last)
    assert {w[2] for w in want} >= {"running", "scheduled", "planned", "missed", "visited", "discarded"}
    rnd, schema = random.Random(seed), "vehicle_id bigint, event_id bigint, ts timestamp, kind string"
    when = lambda at: dt.datetime.fromtimestamp(at, dt.UTC)
    shuffled = rnd.sample(events, len(events))
    for name, parts in (("one", [events]), ("four", [shuffled[k::4] for k in range(4)])):
        for part in [*parts, [(-1, -1, last + 3600, "none")]]:
            spark.createDataFrame([(v, n, when(at), kind) for v, n, at, kind in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        got = online.drained(queue.queue_changes(stream, table, "1 hour"), "append")
        assert rows(got, "vehicle_id", "at", "state", "region", "visit") == want


def test_problems_of_windows(spark):
    changes = spark.createDataFrame([(1, 25, "scheduled", 7, 0), (2, 29, "scheduled", 7, 1), (1, 31, "scheduled", 8, 1), (3, 26, "missed", 7, 0)], queue.CHANGE)
    routes = spark.createDataFrame([(1, [10, 11, 12, 13, 14], [2, 4]), (2, [20, 21, 22], [1, 2])], "vehicle_id bigint, edges array<bigint>, indexes array<int>")
    assert rows(queue.problems(changes, routes)) == [(20, 1, 7, 0, [10, 11, 12]), (20, 2, 7, 1, [21, 22]), (30, 1, 8, 1, [12, 13, 14])]


def test_assigned_routes(spark):
    running = spark.createDataFrame([(1, [1, 2, 3, 4], 1), (2, [1, 2, 3], -1), (3, [1, 2, 3], 1), (4, [1, 9, 3], 0), (5, [1, 2, 3], 0)], "vehicle_id bigint, edges array<bigint>, index int")
    plans = spark.createDataFrame([(1, [1, 2, 3, 4], [1, 2, 7, 4]), (2, [1, 2, 3], [1, 5, 3]), (3, [1, 2, 3], [1, 5, 3]), (4, [1, 2, 3], [1, 3]), (5, [1, 2, 3], [1, 4]), (6, [1], [1]), (5, [1, 2, 3], [])], "vehicle_id bigint, original array<bigint>, edges array<bigint>")
    assert rows(queue.assigned(running, plans)) == [(1, "assigned", [2, 7, 4]), (2, "assigned", [1, 5, 3]), (3, "missing", None), (4, "changed", None), (5, "ends", None), (5, "ends", None), (6, "unknown", None)]


def test_one_timer_for_the_events_of_a_batch():
    """A hundred events that wait are one list and one timer, not a call each."""
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            return lambda *args: calls.append((self.name, what, args))

        def exists(self):
            return self.name == "queue"

    class Handle:
        def __getattr__(self, what):
            return (lambda name, *args: State(name)) if what.startswith("get") else (lambda *args: calls.append(("handle", what, args)))

    vehicle = queue.VehicleQueue()
    vehicle.init(Handle())
    frame = pd.DataFrame({"at": range(50, 150), "event_id": range(100), "kind": ["entered"] * 100, "visits": [None] * 100})
    assert list(vehicle.handleInputRows((1,), iter([frame]), None)) == []
    assert [c for c in calls if c[1] == "registerTimer"] == [("handle", "registerTimer", (50000,))]
    assert [len(c[2][0]) for c in calls if c[1] == "appendList"] == [100]
