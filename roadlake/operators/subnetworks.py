"""Sub-networks of batches of vehicles: allowed ends, ways between them, their clusters, and a memo that outlives a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.operators import paths

#: Fewer edges inside the region are only counted.
LEAST_EDGES = 3
ENDS = ["firsts", "lasts"]


def _merging(df: DataFrame) -> DataFrame:
    """``df``, which grows with the vehicles, is joined by merging, so that no batch's rows pass the driver in a broadcast."""
    return df.hint("merge")


def allowed_ends(route: DataFrame, region: DataFrame, connections: DataFrame) -> DataFrame:
    """(route_id, status, left, right, firsts, lasts): where a route is in the region, and the edges it may begin and end on there.

    status is ``invalid`` for a route without an edge in the region, ``short`` if its longest run has
    fewer than three, else ``open``. A run may begin on any region edge out of the same junction
    that the edge before it may turn to, and end on any region edge into the same junction from which
    the edge after it can be reached; it begins or ends on its own edge where the route does (or
    where only one edge comes before). firsts and lasts are ascending arrays, null unless open.
    """
    runs = _runs(route, region)
    n = F.col("right") - F.col("left")
    marked = written(runs.withColumn("status", F.when(n == 0, "invalid").when(n < LEAST_EDGES, "short").otherwise("open")).withColumn("before", F.when(F.col("left") > 1, F.col("before"))))
    inside = region.select("edge_id", "fj", "tj").distinct()

    def side(own: DataFrame, end: str, outer: str, junction: str, turn: tuple[str, str], name: str) -> DataFrame:
        place = inside.select(F.col("edge_id").alias(end), F.col(junction).alias("j"))
        turns = connections.select(F.col(turn[0]).alias(outer), F.col(turn[1]).alias("edge_id")).join(_merging(inside.select("edge_id", F.col(junction).alias("j"))), "edge_id")
        free = turns.groupBy(outer, "j").agg(F.array_sort(F.collect_set("edge_id")).alias(name))
        near = own.join(_merging(place), end, "left").join(_merging(free), [outer, "j"], "left").drop("j")
        return near.withColumn(name, F.when(F.col(outer).isNull(), F.array(end)).otherwise(F.col(name)))

    own = side(marked.where("status = 'open'"), "first", "before", "fj", ("from_edge", "to_edge"), "firsts")
    own = side(own, "last", "after", "tj", ("to_edge", "from_edge"), "lasts")
    both = F.col("firsts").isNotNull() & F.col("lasts").isNotNull()
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ENDS]
    found = own.select("route_id", "status", "left", "right", *[F.when(both, F.col(c)).alias(c) for c in ENDS])
    return found.unionByName(marked.where("status <> 'open'").select("route_id", "status", "left", "right", *none))


def _runs(route: DataFrame, region: DataFrame) -> DataFrame:
    """(route_id, left, right, first, last, before, after): ``sequences.longest_run``, its edges at both ends and those next to it.

    All is found where a route's positions are, so that positions are dealt by route only once.
    """
    known = region.select("edge_id").distinct().withColumn("in", F.lit(True))
    order = W.partitionBy("route_id").orderBy("pos")
    beside = lambda at, by: F.when(at("pos").over(order) == F.col("pos") + by, at("edge_id").over(order))
    rank = F.sum(F.col("in").cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    steps = route.join(_merging(known), "edge_id", "left").withColumns({"before": beside(F.lag, -1), "after": beside(F.lead, 1), "island": F.when(F.col("in"), F.col("pos") - rank)})
    ends = [at(name, "pos").alias(of) for at, name, of in ((F.min_by, "edge_id", "first"), (F.max_by, "edge_id", "last"), (F.min_by, "before", "before"), (F.max_by, "after", "after"))]
    islands = steps.groupBy("route_id", "island").agg(F.min("pos").alias("left"), (F.max("pos") + 1).alias("right"), *ends)
    run = F.when(F.col("island").isNotNull(), F.struct((F.col("right") - F.col("left")).alias("n"), (-F.col("left")).alias("l"), "right", "first", "last", "before", "after"))
    best = islands.groupBy("route_id").agg(F.max(run).alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return best.select("route_id", zero(-F.col("b.l")).alias("left"), zero(F.col("b.right")).alias("right"), "b.first", "b.last", "b.before", "b.after")


def ways_of_ends(keys: DataFrame, region: DataFrame, connections: DataFrame, k: int, stretch: float) -> DataFrame:
    """(firsts, lasts, rank, milli, path): the ``k`` shortest ways inside the region from any of the firsts to any of the lasts.

    Pairs of edges that several keys share are sought once. None is longer than ``stretch`` times the key's shortest.
    """
    pairs = written(keys.select(*ENDS, F.explode("firsts").alias("first_edge")).select(*ENDS, "first_edge", F.explode("lasts").alias("last_edge")))
    within = lambda name: _merging(region.select(F.col("edge_id").alias(name)))
    inside = connections.join(within("from_edge"), "from_edge", "left_semi").join(within("to_edge"), "to_edge", "left_semi")
    found = paths.best_ways(pairs, region, inside, k, stretch)
    by_key = W.partitionBy(*ENDS)
    order = by_key.orderBy("milli", F.transform(F.split("path", " "), lambda e: e.cast("bigint")))
    joined = pairs.join(_merging(found.drop("rank")), list(paths.PAIR)).withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("low", F.min("milli").over(by_key))
    return joined.where((F.col("rank") <= k) & (F.col("milli") <= F.col("low") * stretch)).select(*ENDS, "rank", "milli", "path")


def _taken(ways: list[str], eps: float, min_samples: int, picks: int) -> list[int]:
    """Which of a key's ways, in order of their length, ``picked`` takes: places from 0 on."""
    sets, every = [set(w.split(" ")) for w in ways], range(len(ways))
    near = [[b for b in every if len(sets[a] & sets[b]) >= (1 - eps) * len(sets[a] | sets[b]) - 1e-9] for a in every]
    name = lambda k: str(k + 1)
    label = {a: a for a in every if len(near[a]) >= min_samples}
    cores, moved = list(label), True
    while moved:
        low = {a: min((label[b] for b in near[a] if b in label), key=name) for a in cores}
        moved, label = low != label, low
    placed = label | {a: min((label[b] for b in near[a] if b in label), key=name) for a in every if a not in label and any(b in label for b in near[a])}
    turn, before = [], dict.fromkeys(placed.values(), 0)
    for k in sorted(placed):
        turn.append((before[placed[k]], k))
        before[placed[k]] += 1
    return [k for _, k in sorted(turn)[:picks]] or list(every)


def picked(ways: DataFrame, eps: float, min_samples: int, least: int, picks: int) -> DataFrame:
    """``ways`` of each key that stay, and n_ways: of ``least`` ways or more only the ``picks`` best, in turn from each density cluster.

    Two ways are close if the Jaccard similarity of their edges is at least 1 - ``eps``. The best of a
    cluster are its shortest; ways outside all clusters go, unless there is no cluster. Clusters
    lie within a key, which has no more ways than were sought, so they are found where its ways are.
    """
    taken = F.udf(lambda paths: _taken(paths, eps, min_samples, picks), "array<int>")
    listed = ways.groupBy(*ENDS).agg(F.array_sort(F.collect_list(F.struct("rank", "milli", "path"))).alias("ways"))
    # ways of fewer give no rows to the function
    many = F.when(F.size("ways") >= least, taken(F.when(F.size("ways") >= least, F.col("ways.path")).otherwise(F.array().cast("array<string>"))))
    kept = F.coalesce(F.transform(many, lambda k: F.get("ways", k)), F.col("ways"))
    return listed.select(*ENDS, F.size("ways").alias("n_ways"), F.explode(kept).alias("way")).select(*ENDS, "n_ways", "way.*")


class Memo:
    """What is known of keys (firsts, lasts): (firsts, lasts, edges), edges null for a key without two ways.

    It lives as long as the object: each batch's new keys are those that no table before has, and are
    appended as a table in the shared folder, so that no key is sought twice.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def known(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.tables) if self.tables else None

    def new(self, keys: DataFrame) -> DataFrame:
        """The distinct keys that aren't known, written."""
        known = self.known()
        keys = keys.select(*ENDS).distinct()
        return written(keys if known is None else keys.join(_merging(known.select(*ENDS)), ENDS, "left_anti"))

    def add(self, keys: DataFrame, ways: DataFrame) -> None:
        """Append new ``keys`` with the edges of their ``ways``; a key with fewer than two is invalid."""
        edges = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.split("path", " "), lambda e: e.cast("bigint"))))))
        found = ways.groupBy(*ENDS).agg(F.max("n_ways").alias("n_ways"), edges.alias("edges"))
        self.tables.append(written(keys.join(_merging(found), ENDS, "left").select(*ENDS, F.when(F.col("n_ways") > 1, F.col("edges")).alias("edges"))))


def batch_subnetworks(route: DataFrame, region: DataFrame, connections: DataFrame, memo: Memo, k: int = 10, stretch: float = 1.5, eps: float = 0.26, min_samples: int = 2, least: int = 10, picks: int = 5) -> DataFrame:
    """(route_id, status, firsts, lasts, edges) of a batch's routes, as a written table; the memo learns its new keys.

    edges is the sub-network that the route may use: those of the ways that stay (``picked``); status is
    then ``found``, and ``invalid`` also where fewer than two ways exist. The sub-network of the batch
    is the union of edges.
    """
    ends = written(allowed_ends(route, region, connections))
    keys = memo.new(ends.where("status = 'open' and firsts is not null and lasts is not null"))
    if not keys.isEmpty():
        ways = written(ways_of_ends(keys, region, connections, k, stretch))
        memo.add(keys, picked(ways, eps, min_samples, least, picks))
    known = memo.known()
    if known is None:
        known = ends.select(*ENDS, F.col("firsts").alias("edges")).where("false")
    status = F.when(F.col("status") != "open", F.col("status")).when(F.col("edges").isNull(), "invalid").otherwise("found")
    return written(ends.join(_merging(known), ENDS, "left").select("route_id", status.alias("status"), *ENDS, "edges"))


def subnetworks(vehicle: DataFrame, route: DataFrame, region: DataFrame, connections: DataFrame, length: int, episode: Column | None = None, memo: Memo | None = None, **options) -> DataFrame:
    """(episode, vehicle_id, status, edges): the sub-network of each vehicle, with the episode that it departs in.

    An episode has all departures of ``length`` seconds from the first one on, or is given; each is a
    batch. What is found of a key doesn't depend on its batch, so the batches of a table are taken at
    once, each key of theirs is sought once, and the jobs don't grow in number with the episodes. A
    ``memo`` has what earlier tables taught, and learns from this one.
    """
    start = vehicle.agg(F.min("depart").alias("s")).first()["s"] or 0
    placed = written(vehicle.select("vehicle_id", "route_id", (F.floor((F.col("depart") - start) / length) if episode is None else episode).cast("bigint").alias("episode")))
    used = route.join(_merging(placed.where("episode is not null").select("route_id").distinct()), "route_id", "left_semi")
    batch = batch_subnetworks(used, written(region), written(connections), Memo() if memo is None else memo, **options)
    return placed.where("episode is not null").join(_merging(batch), "route_id").select("episode", "vehicle_id", "status", "edges")
