"""The queue of vehicles that drive towards regions: scheduled before they arrive, planned, missed, done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds before the expected arrival in which a vehicle is scheduled, and within which it would come too soon.
SCHEDULE, TOO_LATE = 20, 10
#: Of the state store that keeps maps and timers; without a setting of its own a session's is this.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "vehicle_id bigint, at bigint, state string, region bigint, visit int"


def advance(queue: dict, kind: str, at: int) -> list[tuple[int, str, int | None, int]]:
    """What an event, or the clock, makes of a vehicle: (at, state, region, visit) of each change; ``queue`` is changed.

    ``queue`` has state, visit (the one that it drives to), eta, and visits: (region, seconds from the one
    before, or from the start). A vehicle departs as ``running`` if it visits a region; the clock makes it
    ``scheduled`` 20 seconds before it is expected, unless that is less than 10 seconds away when it is
    looked at; ``planned`` takes scheduled ones only; ``entered`` is the end of the visit, which was
    ``missed`` unless it was planned; then it runs to the next one, or is ``discarded`` if there is none.
    ``arrived`` ends it whatever it was.
    """
    out = []

    def now(state: str) -> None:
        region = queue["visits"][queue["visit"]][0] if queue["visit"] < len(queue["visits"]) else None
        out.append((at, state, region, queue["visit"]))

    def drive() -> None:
        queue["eta"] = at + queue["visits"][queue["visit"]][1]
        queue["state"] = "running"

    state = queue["state"]
    if kind == "departed" and state == "new" and queue["visits"]:
        queue["visit"] = 0
        drive()
        now("running")
    elif kind == "clock" and state == "running" and queue["eta"] - at >= TOO_LATE:
        queue["state"] = "scheduled"
        now("scheduled")
    elif kind == "planned" and state == "scheduled":
        queue["state"] = "planned"
        now("planned")
    elif kind == "entered" and state in ("running", "scheduled", "planned"):
        now("visited" if state == "planned" else "missed")
        queue["visit"] += 1
        if queue["visit"] < len(queue["visits"]):
            drive()
            now("running")
        else:
            queue["state"] = "gone"
            now("discarded")
    elif kind == "arrived" and state in ("running", "scheduled", "planned"):
        queue["state"] = "gone"
        now("arrived")
    return out


def due(queue: dict) -> int | None:
    """When the clock schedules the vehicle; a shorter way is scheduled at once."""
    if queue["state"] != "running":
        return None
    since = queue["eta"] - queue["visits"][queue["visit"]][1]
    return max(queue["eta"] - SCHEDULE, since)


def played(queue: dict, events: list[tuple[int, int, str]], until: int) -> list[tuple[int, str, int | None, int]]:
    """All changes up to ``until``, from events (at, id, kind) and the clock in order of time; the clock goes first.

    The clock looks once a visit: a vehicle that it finds too near isn't scheduled later.
    """
    out, left = [], sorted(events)
    while True:
        clock = due(queue) if not queue.get("looked") == queue["visit"] else None
        at = min([t for t in (clock, left[0][0] if left else None) if t is not None], default=None)
        if at is None or at > until:
            return out
        if at == clock:
            queue["looked"] = queue["visit"]
            out += advance(queue, "clock", at)
        else:
            out += advance(queue, left.pop(0)[2], at)


class VehicleQueue(StatefulProcessor):
    """State of a vehicle: where it is in the queue, its visits, and the events that the watermark hasn't passed.

    Events wait until the watermark passes them, and are then taken in order of time and id with the
    clock's own steps; so changes don't depend on how events are dealt over files, as long as none is
    later than the watermark's delay. A vehicle's events of a batch are one list and have one timer, at the first of
    them, which takes all that the watermark has passed and sets the next: no event is a call of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", "state string, visit int, eta bigint, looked int")
        self.visits = handle.getListState("visits", "region bigint, seconds bigint")
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if not self.queue.exists():
                self.queue.update(("new", 0, 0, -1))
                visits = frame["visits"].iloc[0]
                if visits is not None and len(visits):
                    self.visits.put([(int(v["region"]), int(v["seconds"])) for v in visits])
            self.waiting.appendList([(int(at), int(number), kind) for at, number, kind in zip(frame["at"], frame["event_id"], frame["kind"], strict=True)])
            self.handle.registerTimer(int(frame["at"].min()) * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // 1000
        state, visit, eta, looked = self.queue.get() or ("gone", 0, 0, -1)
        visits = [(v[0], v[1]) for v in self.visits.get()] if self.visits.exists() else []
        queue = {"state": state, "visit": visit, "eta": eta, "looked": looked, "visits": visits}
        events = {(at, number): kind for at, number, kind in self.waiting.get()} if self.waiting.exists() else {}
        ready = [(*k, kind) for k, kind in events.items() if k[0] <= until]
        left = [(*k, kind) for k, kind in events.items() if k[0] > until]
        changes = played(queue, ready, until)
        if ready and left:
            self.waiting.put(left)
        elif ready:
            self.waiting.clear()
        self.queue.update((queue["state"], queue["visit"], queue["eta"], queue["looked"]))
        clock = due(queue) if queue["looked"] != queue["visit"] else None
        later = min([at for at in (clock, *[e[0] for e in left]) if at is not None and at > until], default=None)
        if later is not None:
            self.handle.registerTimer(later * 1000)
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def queue_changes(events: DataFrame, visits: DataFrame, delay: str) -> DataFrame:
    """``CHANGE`` rows of a stream of events (vehicle_id, event_id, ts, kind), in append mode.

    ``visits`` is a table of vehicle_id and visits, array<struct<region bigint, seconds bigint>>, see ``advance``;
    vehicles without a row have none. Events are taken once the watermark, ``delay`` behind the latest
    one, has passed them; later ones are lost.
    """
    spark = events.sparkSession
    if "RocksDB" not in (spark.conf.get(STORE, None) or ""):
        spark.conf.set(STORE, ROCKS)
    known = events.join(visits.select("vehicle_id", "visits"), "vehicle_id", "left").withColumn("at", F.unix_timestamp("ts")).withWatermark("ts", delay)
    return known.groupBy("vehicle_id").transformWithStateInPandas(VehicleQueue(), CHANGE, "Append", "EventTime")


def problems(changes: DataFrame, routes: DataFrame, window: int = 10) -> DataFrame:
    """(problem, vehicle_id, region, visit, edges): the vehicles scheduled in each planning window, with their way to the region.

    ``routes`` has vehicle_id, edges, and indexes, those of its visits in order; the way goes from the
    visit before (or the start) up to the region's first edge. A window with vehicles is a problem.
    """
    asked = changes.where("state = 'scheduled'").join(routes, "vehicle_id")
    first = F.when(F.col("visit") == 0, F.lit(0)).otherwise(F.get("indexes", F.col("visit") - 1))
    part = F.slice("edges", first + 1, F.get("indexes", F.col("visit")) - first + 1)
    return asked.select((F.floor(F.col("at") / window) * window).alias("problem"), "vehicle_id", "region", "visit", part.alias("edges"))


def assigned(running: DataFrame, plans: DataFrame) -> DataFrame:
    """(vehicle_id, result, edges): new routes for vehicles on their way, from the edge on which they are.

    ``running`` has vehicle_id, edges and index, -1 before the start; ``plans`` vehicle_id, original and edges.
    result is ``unknown`` for a vehicle that isn't running, ``changed`` if its route isn't the one that was
    planned from, ``ends`` if the new one begins or ends elsewhere, ``missing`` if its edge isn't on the new
    one, else ``assigned``; edges is then the rest of the new route, the whole of it before the start.
    """
    now = running.select("vehicle_id", F.col("edges").alias("old"), "index")
    both = plans.join(now, "vehicle_id", "left")
    here = F.array_position("edges", F.get("old", F.col("index")))
    ends = (F.get("edges", F.lit(0)) == F.get("old", F.lit(0))) & (F.element_at("edges", -1) == F.element_at("old", -1))
    result = (
        F.when(F.col("old").isNull(), "unknown")
        .when(F.col("old") != F.col("original"), "changed")
        .when((F.size("edges") == 0) | ~F.coalesce(ends, F.lit(False)), "ends")
        .when((F.col("index") >= 0) & (F.coalesce(here, F.lit(0)) == 0), "missing")
        .otherwise("assigned")
    )
    rest = F.when(F.col("index") < 0, F.col("edges")).otherwise(F.slice("edges", here.cast("int"), F.size("edges")))
    marked = both.withColumn("result", result)
    return marked.select("vehicle_id", "result", F.when(F.col("result") == "assigned", rest).alias("edges"))
