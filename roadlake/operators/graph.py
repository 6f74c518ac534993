"""Operators on the road graph: junctions are vertices, edges carry turn permissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.operators import chains


def connections(edges: DataFrame) -> DataFrame:
    """(from_edge, to_edge) where every turn at a junction is allowed."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tj").alias("at"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("fj").alias("at"))
    return a.join(b, "at").where("from_edge <> to_edge").select("from_edge", "to_edge")


def incoming(connections_: DataFrame) -> DataFrame:
    """(edge_id, n, sources): distinct edges that lead into each edge."""
    grouped = connections_.groupBy(F.col("to_edge").alias("edge_id"))
    return grouped.agg(F.count_distinct("from_edge").alias("n"), F.array_join(F.array_sort(F.collect_set("from_edge")), " ").alias("sources"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(junction, n_in, n_out, sources, targets) of junctions with any edge."""
    near = edges.select(F.col("fj").alias("junction"), F.col("tj").alias("target"), F.lit(None).cast("bigint").alias("source"))
    near = near.unionByName(edges.select(F.col("tj").alias("junction"), F.lit(None).cast("bigint").alias("target"), F.col("fj").alias("source")))
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), " ")
    return near.groupBy("junction").agg(F.count_distinct("source").alias("n_in"), F.count_distinct("target").alias("n_out"), text("source").alias("sources"), text("target").alias("targets"))


def junctions(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("fj").alias("junction")).unionByName(edges.select(F.col("tj").alias("junction"))).distinct()


def fringe(edges: DataFrame, connections_: DataFrame) -> DataFrame:
    """(junction, kind): start where an edge begins that nothing leads into, end where one ends that leads nowhere."""
    lone = edges.join(connections_.select(F.col("to_edge").alias("edge_id")), "edge_id", "left_anti").select(F.col("fj").alias("junction"), F.lit("start").alias("kind"))
    dead = edges.join(connections_.select(F.col("from_edge").alias("edge_id")), "edge_id", "left_anti").select(F.col("tj").alias("junction"), F.lit("end").alias("kind"))
    return lone.unionByName(dead).distinct()


def inner_junctions(edges: DataFrame, connections_: DataFrame) -> DataFrame:
    return junctions(edges).join(fringe(edges, connections_), "junction", "left_anti")


def junction_classes(edges: DataFrame, connections_: DataFrame) -> DataFrame:
    """(junction, kind): entry, exit, both or inner."""
    kinds = fringe(edges, connections_).groupBy("junction").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("k"))
    name = F.when(F.col("k") == "start", "entry").when(F.col("k") == "end", "exit").when(F.col("k").isNull(), "inner").otherwise("both")
    return junctions(edges).join(kinds, "junction", "left").select("junction", name.alias("kind"))


def reversals(edges: DataFrame, connections_: DataFrame) -> DataFrame:
    """Connections between edges that are exact reversals of each other."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("fj").alias("a"), F.col("tj").alias("b"))
    c = edges.select(F.col("edge_id").alias("to_edge"), F.col("fj").alias("c"), F.col("tj").alias("d"))
    return connections_.join(a, "from_edge").join(c, "to_edge").where("a = d and b = c").select("from_edge", "to_edge")


def without_lone_reversals(edges: DataFrame, connections_: DataFrame) -> DataFrame:
    """Connections, an edge's only one dropped if it is a reversal: such edges are entries."""
    single = connections_.groupBy("to_edge").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("to_edge")
    lone = reversals(edges, connections_).join(single, "to_edge", "left_semi")
    return connections_.join(lone, ["from_edge", "to_edge"], "left_anti")


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges whose id is in ``keep`` (edge_id)."""
    return edges.join(keep.select("edge_id").distinct(), "edge_id", "left_semi")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges both of whose ends are in ``keep`` (junction)."""
    ids = keep.select("junction").distinct()
    return edges.join(ids, edges["fj"] == ids["junction"], "left_semi").join(ids, edges["tj"] == ids["junction"], "left_semi")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of ``a`` between junctions that both graphs have."""
    return induced(a, junctions(a).join(junctions(b), "junction", "left_semi"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["edge_id"])


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "edge_id", "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return minus(a, b).unionByName(minus(b, a))


def equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: edges, junctions and connections in one graph only, and whether there are none."""
    parts = {"edges": lambda g: g.select("edge_id"), "junctions": junctions, "connections": connections}
    counts = []
    for name, of in parts.items():
        x, y = of(a).distinct(), of(b).distinct()
        odd = x.exceptAll(y).unionByName(y.exceptAll(x))
        counts.append(odd.agg(F.count(F.lit(1)).alias(f"odd_{name}")))
    return reduce(lambda p, q: p.crossJoin(q), counts).withColumn("equal", (F.col("odd_edges") + F.col("odd_junctions") + F.col("odd_connections")) == 0)


def boundary(edges: DataFrame, region: DataFrame) -> DataFrame:
    """(edge_id, side) of edges outside a region that touch it: in, out or both."""
    ids = junctions(region)
    outside = minus(edges, region)
    starts = ids.select(F.col("junction").alias("fj"), F.lit(True).alias("leaves"))
    ends = ids.select(F.col("junction").alias("tj"), F.lit(True).alias("enters"))
    touched = outside.join(starts, "fj", "left").join(ends, "tj", "left").where("leaves or enters")
    side = F.when(F.col("leaves").isNull(), "in").when(F.col("enters").isNull(), "out").otherwise("both")
    return touched.select("edge_id", side.alias("side"))


def degrees(edges: DataFrame) -> DataFrame:
    """(junction, n_in, n_out, sources, targets) with sorted arrays of neighbours, loops included."""
    out = edges.groupBy(F.col("fj").alias("junction")).agg(F.count(F.lit(1)).alias("n_out"), F.array_sort(F.collect_set("tj")).alias("targets"))
    into = edges.groupBy(F.col("tj").alias("junction")).agg(F.count(F.lit(1)).alias("n_in"), F.array_sort(F.collect_set("fj")).alias("sources"))
    return into.join(out, "junction")


def removable(edges: DataFrame) -> DataFrame:
    """Junctions that only pass traffic on: one in and one out to different neighbours, or two of each to the same two."""
    one = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("sources") != F.col("targets"))
    two = (F.col("n_in") == 2) & (F.col("n_out") == 2) & (F.size("sources") == 2) & (F.col("sources") == F.col("targets"))
    itself = F.array_contains("sources", F.col("junction"))
    return degrees(edges).where((one | two) & ~itself).select("junction")


def contracted(edges: DataFrame, through: DataFrame) -> DataFrame:
    """(path, fj, tj, n_edges, length, closed): chains of edges through junctions of ``through``.

    A junction of ``through`` sends each edge that comes in on to the one that doesn't turn back, so
    edges form chains, which are ranked by pointer doubling (``chains.positions``). Rings of nothing
    but such junctions begin at their least edge and are ``closed``.
    """
    base = written(edges.select("edge_id", "fj", "tj", "length"))
    passed = through.select(F.col("junction").alias("fj"))
    into = base.join(through.select(F.col("junction").alias("tj")), "tj", "left_semi").select(F.col("edge_id").alias("before"), F.col("fj").alias("back"), F.col("tj").alias("fj"))
    led = base.join(passed, "fj", "left_semi").join(into, "fj").where("tj <> back").select(F.col("edge_id").alias("node"), "before")
    free = base.join(passed, "fj", "left_anti").select(F.col("edge_id").alias("node"), F.lit(None).cast(base.schema["edge_id"].dataType).alias("before"))
    placed, _ = chains.positions(written(led.unionByName(free)))
    step = F.struct("rank", F.col("edge_id").cast("string").alias("e"), "fj", "tj")
    whole = placed.join(base.withColumnRenamed("edge_id", "node"), "node").withColumn("edge_id", F.col("node")).groupBy("start", "closed").agg(F.array_sort(F.collect_list(step)).alias("s"), F.sum("length").alias("length"))
    path = F.array_join(F.transform("s", lambda x: x["e"]), " ")
    return whole.select(path.alias("path"), F.get("s", F.lit(0))["fj"].alias("fj"), F.element_at("s", -1)["tj"].alias("tj"), F.size("s").cast("bigint").alias("n_edges"), "length", "closed")


def simplified(edges: DataFrame, rings: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((edge_id, fj, tj, length), passes): chains and roundabouts drawn together until nothing changes.

    edge_id lists the edges of the original in order, by spaces; junctions are strings. Chains end at
    the junctions of ``rings`` (ring: ids of its edges, see ``edits.contracted_rings``) in the first pass;
    then each ring becomes one node, which may let further chains through. A pass that finds no
    junction to remove ends it. Closed rings of removable junctions stay, as one edge from
    their first junction to itself.
    """
    from roadlake.operators import edits

    now = written(edges.select(F.col("edge_id").cast("string").alias("edge_id"), F.col("fj").cast("string").alias("fj"), F.col("tj").cast("string").alias("tj"), "length"))
    inside, passes = None, 0
    if rings is not None:
        inside = rings.select(F.explode(F.split("ring", " ")).alias("edge_id")).join(now, "edge_id").select(F.col("fj").alias("junction")).distinct()
    while True:
        gone = removable(now) if inside is None else removable(now).join(inside, "junction", "left_anti")
        gone = written(gone)
        passes += 1
        if not gone.isEmpty():
            now = written(contracted(now, gone).select(F.col("path").alias("edge_id"), "fj", "tj", "length"))
        elif inside is None:
            return now, passes
        if inside is not None:
            drawn = edits.contracted_rings(now, rings, "string")
            now, inside = written(drawn.join(now.select("edge_id", "length"), "edge_id")), None


def bounded_paths(edges: DataFrame, start: Column, hops: int) -> DataFrame:
    """(start, target, n_edges, milli, path): all loop-free paths of at most ``hops`` edges.

    ``start`` selects the junctions that paths begin at. Lengths are whole thousandths, so that
    sums agree in any order. Each hop is a join on the junction that the path has reached.
    """
    step = edges.select(F.col("edge_id"), F.col("fj"), F.col("tj"), F.floor(F.col("length") * 1000).alias("m"))
    first = step.where(start).where("fj <> tj")
    level = first.select(F.col("fj").alias("start"), F.col("tj").alias("target"), F.lit(1).cast("bigint").alias("n_edges"), F.col("m").alias("milli"), F.col("edge_id").cast("string").alias("path"), F.array("fj", "tj").alias("seen"))
    levels = [level]
    for _ in range(hops - 1):
        grown = level.join(step, level["target"] == step["fj"]).where(~F.array_contains("seen", F.col("tj")))
        level = grown.select("start", F.col("tj").alias("target"), (F.col("n_edges") + 1).alias("n_edges"), (F.col("milli") + F.col("m")).alias("milli"), F.concat_ws(" ", "path", F.col("edge_id").cast("string")).alias("path"), F.concat("seen", F.array("tj")).alias("seen"))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("seen")


def top_paths(paths: DataFrame, k: int, stretch: float, by: tuple[str, ...] = ("start", "target")) -> DataFrame:
    """The k shortest paths of each start and target (or of each ``by``) that are at most ``stretch`` times the shortest."""
    best = W.partitionBy(*by)
    ranked = paths.withColumn("low", F.min("milli").over(best)).withColumn("rank", F.row_number().over(best.orderBy("milli", "path")).cast("bigint"))
    return ranked.where((F.col("rank") <= k) & (F.col("milli") <= F.col("low") * stretch)).select(*by, "rank", "n_edges", "milli", "path")


def consistency(edges: DataFrame, connections_: DataFrame, junction_ids: DataFrame) -> DataFrame:
    """(check, violations): ends that aren't junctions, connections of unknown edges or that don't meet."""
    ends = junctions(edges).join(junction_ids, "junction", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("missing_junction").alias("check"), "violations")
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tj").alias("x"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("fj").alias("y"))
    placed = connections_.join(a, "from_edge", "left").join(b, "to_edge", "left")
    bad = placed.agg(F.coalesce(F.sum((F.col("x").isNull() | F.col("y").isNull()).cast("bigint")), F.lit(0)).alias("unknown_edge"), F.coalesce(F.sum((F.col("x") != F.col("y")).cast("bigint")), F.lit(0)).alias("no_meeting"))
    unused = junction_ids.join(junctions(edges), "junction", "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("unused_junction").alias("check"), "violations")
    return ends.unionByName(unused).unionByName(bad.unpivot([], ["unknown_edge", "no_meeting"], "check", "violations"))


def network_summary(edges: DataFrame, name: str) -> DataFrame:
    """(name, junctions, edges, milli)."""
    n = junctions(edges).agg(F.count(F.lit(1)).alias("junctions"))
    sizes = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.floor(F.col("length") * 1000)), F.lit(0)).alias("milli"))
    return n.crossJoin(sizes).select(F.lit(name).alias("name"), "junctions", "edges", "milli")


def adjacency(edges: DataFrame) -> DataFrame:
    """(junction, targets): ``target:edge`` of all edges that leave a junction, sorted; parallel edges stay."""
    pairs = F.array_sort(F.collect_list(F.struct("tj", "edge_id")))
    text = F.transform(pairs, lambda p: F.concat_ws(":", p["tj"].cast("string"), p["edge_id"].cast("string")))
    return edges.groupBy(F.col("fj").alias("junction")).agg(F.array_join(text, " ").alias("targets"))


def edges_of_walk(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """(walk, path, complete): the edges between consecutive junctions of walks (walk, pos, junction).

    The least edge id of parallel ones; ``path`` ends before the first step without an edge.
    """
    order = W.partitionBy("walk").orderBy("pos")
    steps = walks.withColumn("next", F.lead("junction").over(order)).where("next is not null")
    least = edges.groupBy("fj", "tj").agg(F.min("edge_id").alias("edge_id"))
    placed = steps.join(least, (F.col("junction") == F.col("fj")) & (F.col("next") == F.col("tj")), "left")
    gap = placed.withColumn("broken", F.max(F.col("edge_id").isNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    kept = F.array_sort(F.collect_list(F.when(F.col("broken") == 0, F.struct("pos", "edge_id"))))
    return gap.groupBy("walk").agg(F.array_join(F.transform(kept, lambda s: s["edge_id"].cast("string")), " ").alias("path"), (F.max("broken") == 0).alias("complete"))


def rings(edges: DataFrame, size: int) -> DataFrame:
    """(ring): cycles of ``size`` different junctions, as edge ids from the cycle's least junction on."""
    step = edges.select("edge_id", "fj", "tj")
    walk = step.where("fj <> tj").select(F.col("fj").alias("start"), F.col("tj").alias("at"), F.array("fj").alias("seen"), F.col("edge_id").cast("string").alias("ring"))
    for k in range(1, size):
        grown = walk.join(step, walk["at"] == step["fj"])
        inside = (F.col("tj") > F.col("start")) & ~F.array_contains("seen", F.col("tj")) & (F.col("at") != F.col("tj"))
        fits = (F.col("tj") == F.col("start")) if k == size - 1 else inside
        grown = grown.where((F.col("at") > F.col("start")) & fits)
        walk = grown.select("start", F.col("tj").alias("at"), F.concat("seen", F.array("fj")).alias("seen"), F.concat_ws(" ", "ring", F.col("edge_id").cast("string")).alias("ring"))
    return walk.select("ring")


def valid_ring(ring: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, valid): whether the edges of each named ring form one closed walk through all of its junctions.

    ``ring`` has name, edge_id. Every junction of the ring has one successor in it, and following
    them from the least junction comes back after as many steps as there are edges: the successor
    table is one component and a permutation.
    """
    from roadlake.operators.components import connected_components

    inside = written(ring.join(edges.select("edge_id", "fj", "tj"), "edge_id"))
    counts = inside.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fj").alias("a"), F.count_distinct("tj").alias("b"))
    key = lambda c: F.concat_ws("|", "name", F.col(c).cast("string"))
    roots = connected_components(inside.select(key("fj").alias("a"), key("tj").alias("b")))
    parts = roots.groupBy(F.substring_index("root", "|", 1).alias("name")).agg(F.count_distinct("root").alias("parts"), F.count(F.lit(1)).alias("nodes"))
    ok = (F.col("n") == F.col("a")) & (F.col("n") == F.col("b")) & (F.col("n") == F.col("nodes")) & (F.col("parts") == 1)
    return counts.withColumn("name", F.col("name").cast("string")).join(parts, "name").select("name", ok.alias("valid"))


def alternative_routes(keys: DataFrame, edges: DataFrame, connections_: DataFrame, hops: int, k: int, stretch: float) -> DataFrame:
    """(first_edge, last_edge, rank, milli, path): the k shortest allowed ways between pairs of edges.

    Ways follow turn permissions, use no edge twice, and have at most ``hops`` turns and
    ``stretch`` times the shortest length. Each distinct key is sought once; callers join the
    answers back to the routes that share it. A way that has reached its last edge isn't grown.
    """
    sized = edges.select("edge_id", F.floor(F.col("length") * 1000).alias("m"))
    turns = connections_.select("from_edge", F.col("to_edge").alias("next"))
    start = keys.select("first_edge", "last_edge").distinct().join(sized, F.col("first_edge") == F.col("edge_id"))
    level = start.select("first_edge", "last_edge", F.col("edge_id").alias("at"), F.col("m").alias("milli"), F.array("edge_id").alias("seen"))
    found = [level.where("at = last_edge")]
    for _ in range(hops):
        grown = level.where("at <> last_edge").join(turns, F.col("at") == F.col("from_edge")).where(~F.array_contains("seen", F.col("next")))
        grown = grown.join(sized, F.col("next") == F.col("edge_id"))
        level = grown.select("first_edge", "last_edge", F.col("next").alias("at"), (F.col("milli") + F.col("m")).alias("milli"), F.concat("seen", F.array("next")).alias("seen"))
        found.append(level.where("at = last_edge"))
    ways = reduce(DataFrame.unionByName, found).withColumn("path", F.array_join(F.transform("seen", lambda e: e.cast("string")), " "))
    best = W.partitionBy("first_edge", "last_edge")
    ranked = ways.withColumn("low", F.min("milli").over(best)).withColumn("rank", F.row_number().over(best.orderBy("milli", "path")).cast("bigint"))
    return ranked.where((F.col("rank") <= k) & (F.col("milli") <= F.col("low") * stretch)).select("first_edge", "last_edge", "rank", "milli", "path")
