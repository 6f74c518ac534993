"""Flows of vehicles over a network: trips between drawn ends, flows that meet, and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written
from roadlake.operators.records import draw
from roadlake.operators.selection import LEVELS
from roadlake.operators.sequences import dense_ids

#: Candidates that one round of ``meeting_flows`` looks at, and how many of their junctions in all.
BATCH, ROOM = 256, 1_000_000
#: Numbers that one row counts out.
BLOCK = 65536
#: Kinds of flows that ``drawn_flows`` deals.
KINDS = ["exponential_flow", "random_flow", "uniform_flow"]


def route_ends(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route_id, from_junction, to_junction) of (route_id, pos, edge_id): where the first edge starts and the last one ends."""
    at = routes.join(edges.select("edge_id", "fj", "tj"), "edge_id")
    ends = at.groupBy("route_id").agg(F.min_by("fj", "pos").alias("from_junction"), F.max_by("tj", "pos").alias("to_junction"))
    return ends


def counted(rows: DataFrame, n: Column, into: str) -> DataFrame:
    """Each row once for each ``into`` from 0 to ``n`` - 1; none where ``n`` is null or below 1.

    Rows are dealt anew by blocks of numbers, so one row of a great ``n`` is many tasks' work.
    """
    blocks = rows.withColumn("_n", n.cast("bigint")).where("_n > 0").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / BLOCK))))
    dealt = blocks.repartition(F.xxhash64(*[F.col(c) for c in rows.columns], "_b"))
    last = F.least((F.col("_b") + 1) * BLOCK, F.col("_n")) - 1
    return dealt.select(*rows.columns, F.explode(F.sequence(F.col("_b") * BLOCK, last)).alias(into))


def fixed_flows(flows: DataFrame) -> DataFrame:
    """(flow_id, vehicle, depart): ``amount`` vehicles at ``depart`` (whole hundredths of a second) of each flow."""
    return counted(flows.select("flow_id", "depart", "amount"), F.col("amount"), "vehicle").select("flow_id", "vehicle", "depart")


def uniform_flows(flows: DataFrame) -> DataFrame:
    """(flow_id, vehicle, depart): ``amount`` vehicles of each flow, spread evenly over [start, end], in whole hundredths of a second."""
    rows = counted(flows.select("flow_id", "start", "end", "amount"), F.col("amount"), "vehicle")
    step = F.floor(F.col("vehicle") * ((F.col("end") - F.col("start")) * 100) / F.greatest(F.col("amount") - 1, F.lit(1)))
    return rows.select("flow_id", "vehicle", (F.col("start") * 100 + step).alias("depart"))


def _in_periods(periods: DataFrame, seed: int, *more: str) -> DataFrame:
    """(flow_id, more, vehicle, depart): from ``low`` to ``high`` vehicles of each period, at drawn times in it."""
    n = F.col("low") + draw(seed, F.col("flow_id"), F.col("p")) % (F.col("high") - F.col("low") + 1)
    rows = counted(periods, n, "k")
    depart = (F.col("start") + F.col("p") * F.col("period")) * 100 + draw(seed + 1, F.col("flow_id"), F.col("p"), F.col("k")) % (F.col("period") * 100)
    return rows.select("flow_id", *more, F.concat_ws("-", "p", "k").alias("vehicle"), depart.alias("depart"))


def random_flows(flows: DataFrame, seed: int) -> DataFrame:
    """(flow_id, vehicle, depart): in each ``period`` of [start, end) of a flow ``low`` to ``high`` vehicles at drawn times.

    A last period that isn't whole has none. Draws depend on the flow, the period and the vehicle's
    place in it, so they are the same on any cluster.
    """
    periods = counted(flows.select("flow_id", "start", "end", "period", "low", "high"), F.floor((F.col("end") - F.col("start")) / F.col("period")), "p")
    return _in_periods(periods, seed)


def exponential_flows(flows: DataFrame, seed: int) -> DataFrame:
    """(flow_id, phase, vehicle, depart): light traffic in the first third of a flow's periods, then medium, then heavy.

    A drawn tenth of the periods goes one level up; ``LEVELS`` says how many vehicles each has.
    """
    whole = F.floor((F.col("end") - F.col("start")) / F.col("period"))
    periods = counted(flows.select("flow_id", "start", "end", "period"), whole, "p")
    third = F.least(F.floor(F.col("p") * 3 / whole), F.lit(2))
    level = third + (draw(seed, F.col("flow_id"), F.col("p")) % 10 == 0).cast("bigint")
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("_level") + 1).cast("int"))
    leveled = periods.withColumn("_level", level).withColumns({"phase": pick(LEVELS), "low": pick(x for x, _ in LEVELS.values()), "high": pick(x for _, x in LEVELS.values())}).drop("_level")
    return _in_periods(leveled, seed + 1, "phase")


def random_trips(ways: DataFrame, edges: DataFrame, start: int, end: int, amount: int, seed: int) -> DataFrame:
    """(trip, depart, way): trips at even times, each over a drawn row of ``ways`` (id).

    The period is the duration by the kilometres of lanes and by ``amount``, in whole thousandths of
    a second; departs are in them too. ``ways`` holds one row for each pair of ends that a way joins:
    to draw from it is to draw any two ends until a way joins them. No ways, or no lanes: no trips.
    """
    metres = F.floor(F.coalesce(F.sum(F.floor(F.col("length") * 1000) * F.col("lanes")), F.lit(0)) / 1000)
    period = F.bround(F.lit(end - start) / (F.col("metres") / 1000) / amount, 3)
    millis = edges.agg(metres.alias("metres")).where("metres > 0").select(F.greatest(F.bround(period * 1000).cast("bigint"), F.lit(1)).alias("period"))
    numbered = written(dense_ids(ways.select(F.col("id").alias("way")), "way"))
    count = numbered.agg(F.count(F.lit(1)).alias("ways")).where("ways > 0")
    total = F.floor(F.lit((end - start) * 1000) / F.col("period"))
    trips = counted(millis.crossJoin(F.broadcast(count)), total, "trip")
    drawn = trips.select("trip", (F.lit(start * 1000) + F.col("trip") * F.col("period")).alias("depart"), (draw(seed, F.col("trip")) % F.col("ways")).alias("id"))
    return drawn.join(numbered, "id").select("trip", "depart", "way")


def meeting_flows(candidates: DataFrame, passes: DataFrame, amount: int, batch: int = BATCH, room: int = ROOM) -> DataFrame:
    """(rank, id, gain): ``amount`` flows of which each meets one before, as a plain greedy choice takes them.

    ``candidates`` is (id, start, weight), ``passes`` (id, junction). The gain of a candidate is its
    weight by the junctions of it that no chosen flow passes yet, so it falls where chosen ones
    already pass. The first choice is that of most gain; each further one has a junction in common
    with those before it and a start of its own, the most gain and of those the least id. Fewer
    rows come back if no candidate is left that meets another. Candidates without junctions are
    never chosen; rows without an id, a start or a weight above 0 go, and of rows of one id all but one.

    A round takes the best candidates that meet and the best that don't, with the next best of either
    as thresholds, and chooses among them while what it chooses beats the thresholds: since gains
    only fall, so would the plain choice over all. Only the batch (at most 2 * ``batch`` candidates,
    of ``room`` junctions but for the first) and what is chosen leave for the driver; what a round newly
    covers goes to all tasks and is subtracted from all candidates by a pass over ``passes``, whose table
    is written once and never dealt anew.
    """
    spark = candidates.sparkSession
    passed = written(passes.where("id is not null and junction is not null").distinct())
    sizes = passed.groupBy("id").agg(F.count(F.lit(1)).alias("left"))
    known = candidates.dropna(subset=["id", "start"]).where("weight > 0").groupBy("id").agg(F.min(F.struct("start", "weight")).alias("c"))
    state = written(known.join(sizes, "id").select("id", "c.start", "c.weight", "left", F.lit(False).alias("meets")))
    chosen: list = []
    covered: set = set()
    starts: set = set()
    while len(chosen) < amount:
        ranked = state.select("id", "start", "weight", "left", "meets", (F.col("weight") * F.col("left")).alias("gain"))
        best = [ranked.where(F.col("meets") == side).orderBy(F.desc("gain"), "id").limit(batch + 1).collect() for side in (True, False)]
        if not best[0] and (chosen or not best[1]):
            break
        bounds, members, held = [], [], 0
        for rows in best:
            n = 0
            while n < min(len(rows), batch) and (n == 0 or held + rows[n]["left"] <= room):
                held += rows[n]["left"]
                n += 1
            members += rows[:n]
            bounds.append((-rows[n]["gain"], rows[n]["id"]) if n < len(rows) else None)
        names = spark.createDataFrame([(r["id"],) for r in members], passed.select("id").schema)
        open_: dict = {r["id"]: set() for r in members}
        for row in passed.join(F.broadcast(names), "id").collect():
            if row["junction"] not in covered:
                open_[row["id"]].add(row["junction"])
        picked, new = _picked(members, bounds, open_, starts, amount - len(chosen), first=not chosen)
        chosen += picked
        covered |= new
        starts |= {start for *_, start in picked}
        if len(chosen) < amount:
            state = _without(state, passed, new, [start for *_, start in picked])
    rows = [(k + 1, name, gain) for k, (name, gain, _) in enumerate(chosen)]
    kind = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    drop_written(state, passed)
    return spark.createDataFrame(rows, f"rank int, id {kind['id']}, gain bigint")


def _picked(members: list, bounds: list, open_: dict, starts: set, amount: int, first: bool) -> tuple[list, set]:
    """((id, gain, start) of the choices that beat the thresholds, the junctions that they cover)."""
    live = {r["id"]: r for r in members}
    meets = {r["id"] for r in members if r["meets"]}
    picked: list = []
    new: set = set()
    starts = set(starts)
    while live and len(picked) < amount:
        able = live if first and not picked else meets & live.keys()
        if not able:
            break
        key, name = min(((-live[i]["weight"] * len(open_[i]), i), i) for i in able)
        # The round's first choice is the best there is; a later one might be beaten from outside.
        if picked and any(bound is not None and key > bound for bound in bounds):
            break
        row, fresh = live[name], open_[name]
        picked.append((name, -key[0], row["start"]))
        starts.add(row["start"])
        gone = set(fresh)
        new |= gone
        live = {i: r for i, r in live.items() if r["start"] not in starts}
        for i in live:
            if not gone.isdisjoint(open_[i]):
                meets.add(i)
                open_[i] = open_[i] - gone
    return picked, new


def _without(state: DataFrame, passed: DataFrame, new: set, starts: list) -> DataFrame:
    """The candidates that are left after a round: fewer open junctions, more that meet, no start twice."""
    spark = state.sparkSession
    junctions = spark.createDataFrame([(j,) for j in new], passed.select("junction").schema)
    taken = passed.join(F.broadcast(junctions), "junction", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    used = spark.createDataFrame([(s,) for s in starts], state.select("start").schema)
    rest = state.join(F.broadcast(used), "start", "left_anti").join(taken, "id", "left")
    after = written(rest.select("id", "start", "weight", (F.col("left") - F.coalesce("_n", F.lit(0))).alias("left"), (F.col("meets") | F.col("_n").isNotNull()).alias("meets")))
    drop_written(state)
    return after


def end_faults(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs`` (from_junction, to_junction) whose ends don't fit the network, with (starts, ends).

    A flow starts at a junction that edges leave and none enters, and ends at one that edges enter
    and none leaves. Pairs of which both hold are left out, so a valid table gives no rows.
    """
    leave, enter = edges.select(F.col("fj").alias("j")).distinct(), edges.select(F.col("tj").alias("j")).distinct()
    first = leave.join(enter, "j", "left_anti").select(F.col("j").alias("from_junction"), F.lit(True).alias("starts"))
    last = enter.join(leave, "j", "left_anti").select(F.col("j").alias("to_junction"), F.lit(True).alias("ends"))
    found = pairs.join(first, "from_junction", "left").join(last, "to_junction", "left")
    judged = found.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("starts", "ends")})
    return judged.where(~(F.col("starts") & F.col("ends")))


def drawn_flows(pairs: DataFrame, start: int, end: int, seed: int) -> DataFrame:
    """``pairs`` (from_junction, to_junction) with a drawn kind of flow and the arguments of that kind.

    A random flow has least and most vehicles of a period of 20 s, a uniform one the number of its
    vehicles (a fifth to a third of the seconds), an exponential one its rise in hundredths; what a
    kind has no use for is null. Draws depend on the junctions and the seed only.
    """
    at = lambda k: draw(seed + k, F.col("from_junction"), F.col("to_junction"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (at(0) % len(KINDS)).cast("int") + 1)
    span = end - start
    two = F.array_sort(F.array(at(1) % 15, at(2) % 15))
    of = lambda name, value: F.when(F.col("flow_name") == name, value)
    return pairs.select("from_junction", "to_junction", kind.alias("flow_name"), F.lit(start).cast("bigint").alias("start_time"), F.lit(end).cast("bigint").alias("end_time")).select(
        "*",
        of("random_flow", two[0]).alias("least"),
        of("random_flow", two[1]).alias("most"),
        of("random_flow", F.lit(20).cast("bigint")).alias("period"),
        of("uniform_flow", span // 5 + at(3) % max(span // 3 - span // 5, 1)).alias("vehicles"),
        of("exponential_flow", 75 + 10 * (at(4) % 8)).alias("rise"),
    )


def flow_report(commands: DataFrame, ends: DataFrame, vehicles: DataFrame) -> DataFrame:
    """``commands`` with (duration, total, per_minute_tenths): the vehicles of the route that joins a command's two ends.

    Of several such routes the one of the least id counts. A command whose ends no route joins has
    null totals; one without any duration has no rate. Vehicles are counted by route before they meet
    the commands, so a route of many vehicles is one row.
    """
    n = vehicles.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    of_pair = ends.groupBy("from_junction", "to_junction").agg(F.min("route_id").alias("route_id"))
    total = of_pair.join(n, "route_id", "left").select("from_junction", "to_junction", F.coalesce("n", F.lit(0).cast("bigint")).alias("total"))
    duration = F.col("end_time") - F.col("start_time")
    minutes = F.bround(duration / 60, 2)
    rate = F.when(minutes > 0, F.bround(F.col("total") / minutes * 10).cast("bigint"))
    return commands.join(total, ["from_junction", "to_junction"], "left").withColumns({"duration": duration, "per_minute_tenths": rate})
