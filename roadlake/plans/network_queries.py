"""Queries over ways, changes to the graph, planning problems and scenarios, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.operators import bitmaps, edits, graph, paths, planning, scenario, sequences, subnetworks
from roadlake.plans import views as v
from roadlake.plans.queries import LISTS, PAIRS, RING, ROADS, RUNS, query

#: From every edge to the one that leads on to the next block, three blocks ahead.
AHEAD = ", keys as (select edge_id as first_edge, (edge_id // 9 + 3) * 9 + 5 as last_edge from v_edge) "

#: Least lengths by the number of turns; no pair's shortest way has 30.
WALKS = """, walks(first_edge, last_edge, at_, milli, n) as (select first_edge, last_edge, first_edge, floor(length * 1000)::bigint, 0 from keys join v_edge on edge_id = first_edge
union all select w.first_edge, w.last_edge, c.to_edge, min(w.milli + floor(e.length * 1000)::bigint), w.n + 1 from walks w join v_connection c on c.from_edge = w.at_ join v_edge e on e.edge_id = c.to_edge
where w.n < 30 and w.at_ <> w.last_edge group by w.first_edge, w.last_edge, c.to_edge, w.n)"""


def _ahead(edges):
    return edges.select(F.col("edge_id").alias("first_edge"), ((F.floor(F.col("edge_id") / 9) + 3) * 9 + 5).alias("last_edge"))


@query(AHEAD + WALKS + """ select first_edge, last_edge, min(milli) as milli from walks where at_ = last_edge group by all""")
def shortest_paths(spark, sf):
    edges = v.edge(spark, sf)
    return paths.least_lengths(_ahead(edges), edges, graph.connections(edges))


@query(AHEAD + WALKS + """, low as (select first_edge, last_edge, min(milli) as low from walks where at_ = last_edge group by all),
ways(first_edge, last_edge, at_, milli, path, low) as (select first_edge, last_edge, first_edge, floor(length * 1000)::bigint, [first_edge], low from low join v_edge on edge_id = first_edge
union all select w.first_edge, w.last_edge, c.to_edge, w.milli + floor(e.length * 1000)::bigint, list_append(path, c.to_edge), low from ways w join v_connection c on c.from_edge = w.at_ join v_edge e on e.edge_id = c.to_edge
where w.at_ <> w.last_edge and not list_contains(path, c.to_edge) and w.milli + floor(e.length * 1000)::bigint <= 1.5 * low)
select first_edge, last_edge, row_number() over (partition by first_edge, last_edge order by milli, path) as rank, milli, array_to_string(path, ' ') as path from ways where at_ = last_edge qualify rank <= 3""")
def topk_shortest_paths(spark, sf):
    edges = v.edge(spark, sf)
    return paths.best_ways(_ahead(edges), edges, graph.connections(edges), 3, 1.5)


ROWS = "select 'edge' as kind, edge_id as a, fj as b from e union all select 'turn', from_edge, to_edge from c union all select 'route', route_id, pos from r"


def _rows(edges, turns, route):
    return edges.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("a"), F.col("fj").alias("b")).unionByName(turns.select(F.lit("turn").alias("kind"), F.col("from_edge").alias("a"), F.col("to_edge").alias("b"))).unionByName(route.select(F.lit("route").alias("kind"), F.col("route_id").alias("a"), F.col("pos").alias("b")))


WITHOUT = """, e as (select * from v_edge where edge_id not in (select edge_id from x)), c as (select * from v_connection where from_edge not in (select edge_id from x) and to_edge not in (select edge_id from x)),
r as (select * from v_route where route_id not in (select route_id from v_route where edge_id in (select edge_id from x))) """


@query(", x as (select edge_id from v_edge where speed > 50 and lanes = 1)" + WITHOUT + ROWS)
def remove_edges(spark, sf):
    edges = v.edge(spark, sf)
    return _rows(*edits.without_edges(edges, graph.connections(edges), v.route(spark, sf), edges.where("speed > 50 and lanes = 1")))


@query(", d as (select fj as j from v_edge group by 1 having min(speed) > 45), x as (select edge_id from v_edge where fj in (from d) or tj in (from d))" + WITHOUT + ROWS)
def remove_junctions(spark, sf):
    edges = v.edge(spark, sf)
    gone = edges.groupBy(F.col("fj").alias("junction")).agg(F.min("speed").alias("s")).where("s > 45")
    return _rows(*edits.without_junctions(edges, graph.connections(edges), v.route(spark, sf), gone))


@query(""", g as (select distinct route_id from v_route where mark < 9), r as (select * from v_route where route_id not in (from g)),
e as (select * from v_edge where edge_id in (select edge_id from r) or edge_id not in (select edge_id from v_route)) select 'edge' as kind, edge_id as a, fj as b from e union all select 'route', route_id, pos from r""")
def remove_routes(spark, sf):
    edges, route = v.edge(spark, sf), v.route(spark, sf)
    left, rest = edits.without_routes(edges, route, route.where("mark < 9"))
    return _rows(left, graph.connections(edges), rest).where("kind <> 'turn'")


ADDED = """, more as (select edge_id + 5 as edge_id, fj, tj + 1 as tj, lanes from v_edge where lanes = 2), j as (select fj as j from v_edge union select tj from v_edge),
fit as (select * from more where fj in (from j) and tj in (from j)) """


@query(ADDED + ", old as (select edge_id, fj, tj, lanes from v_edge) select 'keep' as way, * from old union all select 'keep', * from fit where edge_id not in (select edge_id from old) union all select 'replace', * from fit union all select 'replace', * from old where edge_id not in (select edge_id from fit)")
def add_edges(spark, sf):
    edges = v.edge(spark, sf).select("edge_id", "fj", "tj", "lanes")
    more = edges.where("lanes = 2").select((F.col("edge_id") + 5).alias("edge_id"), "fj", (F.col("tj") + 1).alias("tj"), "lanes")
    kept, new = (edits.with_edges(edges, more, graph.junctions(edges), r) for r in (False, True))
    return kept.select(F.lit("keep").alias("way"), "*").unionByName(new.select(F.lit("replace").alias("way"), "*"))


@query(", more as (select route_id + 100000000 as route_id, pos, edge_id * 2 as edge_id from v_route), bad as (select route_id from more where edge_id not in (select edge_id from v_edge)) select route_id, pos, edge_id from v_route union all select * from more where route_id not in (from bad)")
def add_routes(spark, sf):
    route = v.route(spark, sf).select("route_id", "pos", "edge_id")
    more = route.select((F.col("route_id") + 100000000).alias("route_id"), "pos", (F.col("edge_id") * 2).alias("edge_id"))
    return edits.with_routes(route, more, v.edge(spark, sf))


@query(""", old as (select from_edge, to_edge from v_connection), more as (select edge_id as from_edge, edge_id + 2 as to_edge from v_edge),
fit as (select m.* from more m join v_edge a on a.edge_id = m.from_edge join v_edge b on b.edge_id = m.to_edge where a.tj = b.fj), lanes1 as (select c.* from old c join v_edge e on e.edge_id = c.from_edge where lanes = 1),
ch as (select edge_id as o, case when lanes < 3 then edge_id + 9 end as n from v_edge where lanes > 1)
select 'added' as way, * from (select * from (select * from old except select * from lanes1) union select * from fit) union all select 'removed', * from (select * from old except select * from lanes1)
union all select 'out replaced', * from (select distinct from_edge, coalesce(n, to_edge) as to_edge from old left join ch on o = to_edge where o is null or n is not null)
union all select 'in replaced', * from (select distinct coalesce(n, from_edge) as from_edge, to_edge from old left join ch on o = from_edge where o is null or n is not null)
union all select 'merged', * from (select * from lanes1 union select * from fit)""")
def connection_edits(spark, sf):
    edges = v.edge(spark, sf)
    old = graph.connections(edges)
    more = edges.select(F.col("edge_id").alias("from_edge"), (F.col("edge_id") + 2).alias("to_edge"))
    lanes1 = old.join(edges.where("lanes = 1").select(F.col("edge_id").alias("from_edge")), "from_edge", "left_semi")
    changes = edges.where("lanes > 1").select(F.col("edge_id").alias("old"), F.when(F.col("lanes") < 3, F.col("edge_id") + 9).alias("new"))
    removed = edits.without_connections(old, lanes1)
    fit = edits.with_connections(old.where("false"), more, edges)
    parts = {"added": edits.with_connections(removed, more, edges), "removed": removed, "out replaced": edits.replaced_end(old, "to_edge", changes), "in replaced": edits.replaced_end(old, "from_edge", changes), "merged": edits.merged_junctions(lanes1, fit)}
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("way"), "from_edge", "to_edge")
        out = rows if out is None else out.unionByName(rows)
    return out


RINGED = RING + """, member as (select 'r' || least(x, y, z) as node, unnest([x, y, z]) as edge_id from ring3), place as (select distinct fj as j, node from member join v_edge using (edge_id)) """


@query(RINGED + "select edge_id, coalesce(p.node, fj::varchar) as fj, coalesce(q.node, tj::varchar) as tj from v_edge e left join place p on p.j = fj left join place q on q.j = tj where edge_id not in (select edge_id from member)")
def roundabout_contraction(spark, sf):
    edges = v.edge(spark, sf)
    return edits.contracted_rings(edges, graph.rings(edges, 3))


@query(RINGED + ", o as (select 'r' || least(x, y, z) as node, [x, y, z] as a from ring3), s as (select node, a, unnest([0, 1, 2]) as i from o), w as (select *, unnest([1, 2]) as d from s) select node, ea.fj as enters, eb.fj as leaves, array_to_string(list_transform(range(d), lambda k: a[(i + k) % 3 + 1]), ' ') as path from w join v_edge ea on ea.edge_id = a[i + 1] join v_edge eb on eb.edge_id = a[(i + d) % 3 + 1]")
def roundabout_ways(spark, sf):
    edges = v.edge(spark, sf)
    return edits.ring_ways(edges, graph.rings(edges, 3))


def _places(edges):
    return graph.junctions(edges).select("junction", (F.col("junction") * 37 % 101).alias("x"), (F.col("junction") * 53 % 97).alias("y"))


@query(RINGED + "select node, count(*) as junctions, floor(sum(j * 37 % 101) * 1000.0 / count(*))::bigint as x, floor(sum(j * 53 % 97) * 1000.0 / count(*))::bigint as y from place group by node")
def roundabout_places(spark, sf):
    edges = v.edge(spark, sf)
    return edits.ring_places(edges, graph.rings(edges, 3), _places(edges))


@query(""", broken_e as (select edge_id, fj, case when lanes = 3 then tj + 1000000000 else tj end as tj from v_edge), broken_c as (select from_edge, case when to_edge % 5 = 0 then to_edge + 1 else to_edge end as to_edge from v_connection),
placed as (select c.*, a.tj as x, b.fj as y from broken_c c left join broken_e a on a.edge_id = from_edge left join broken_e b on b.edge_id = to_edge), j as (select fj as j from v_edge union select tj from v_edge)
select 'missing_junction' as "check", count(*) as violations from (select fj as k from broken_e union select tj from broken_e) where k not in (from j)
union all select 'unused_junction', count(*) from j where j not in (select fj from broken_e union select tj from broken_e)
union all select 'unknown_edge', count(*) filter (where x is null or y is null) from placed union all select 'no_meeting', coalesce(sum((x <> y)::int), 0)::bigint from placed""")
def broken_network_check(spark, sf):
    """The checks of a network with planted faults: ends that aren't junctions, turns that don't meet."""
    edges = v.edge(spark, sf)
    turns = graph.connections(edges).withColumn("to_edge", F.when(F.col("to_edge") % 5 == 0, F.col("to_edge") + 1).otherwise(F.col("to_edge")))
    broken = edges.withColumn("tj", F.when(F.col("lanes") == 3, F.col("tj") + 1000000000).otherwise(F.col("tj")))
    return graph.consistency(broken, turns, graph.junctions(edges))


@query(", g as (select * from v_edge where lanes < 3), gc as (select c.* from v_connection c where from_edge in (select edge_id from g) and to_edge in (select edge_id from g) and from_edge in (select edge_id from g where speed > 10)), full_c as (select * from v_connection where from_edge in (select edge_id from g) and to_edge in (select edge_id from g)) select 'missing' as side, * from (select from_edge, to_edge from full_c except select from_edge, to_edge from gc) union all select 'unexpected', * from (select from_edge, to_edge from gc except select from_edge, to_edge from full_c)")
def connections_against_original(spark, sf):
    """Turns of a part of the graph that differ from the original's between the edges that both have."""
    original, edges = v.edge(spark, sf), v.edge(spark, sf).where("lanes < 3")
    own = graph.connections(edges).join(edges.where("speed > 10").select(F.col("edge_id").alias("from_edge")), "from_edge", "left_semi")
    ids = edges.select("edge_id")
    shared = graph.connections(original).join(ids.toDF("from_edge"), "from_edge", "left_semi").join(ids.toDF("to_edge"), "to_edge", "left_semi").select("from_edge", "to_edge")
    return shared.exceptAll(own).select(F.lit("missing").alias("side"), "*").unionByName(own.exceptAll(shared).select(F.lit("unexpected").alias("side"), "*"))


WEEK = 604800
NAMED = RUNS + f""", numbered as (select *, (depart - s) // {WEEK} as episode, 'v' || (row_number() over (partition by (depart - s) // {WEEK} order by depart, vehicle_id) - 1) as name from v_vehicle, (select min(depart) as s from v_vehicle)),
cut as (select route_id, arg_min(edge_id, pos) as first_edge, arg_max(edge_id, pos) as last_edge from v_route join runs using (route_id) where pos >= "left" and pos < "right" and "right" - "left" >= 3 group by 1),
planned as (select episode, name, vehicle_id, first_edge, last_edge from numbered join cut using (route_id)) """


def _planned(spark, sf):
    cut = sequences.clipped(v.route(spark, sf), v.region(spark, sf), 3)
    ends = cut.groupBy("route_id").agg(F.min_by("edge_id", "pos").alias("first_edge"), F.max_by("edge_id", "pos").alias("last_edge"))
    return planning.numbered(v.vehicle(spark, sf), WEEK).join(ends, "route_id").select("episode", "name", "vehicle_id", "first_edge", "last_edge")


@query(NAMED + "select * from planned")
def planning_ids(spark, sf):
    return _planned(spark, sf)


PROBLEM = NAMED + """, f as (select distinct episode, first_edge as r, fj, tj from planned join v_edge on edge_id = first_edge), l as (select distinct episode, last_edge as r, fj, tj from planned join v_edge on edge_id = last_edge),
allowed as (select episode, '(allowed ' || name || ' r' || edge_id || ')' as fact from planned p join (select distinct route_id, edge_id from v_route) q on q.route_id = p.vehicle_id),
facts as (select episode, 'objects' as section, name || ' - vehicle' as fact from planned union all select episode, 'objects', 's' || r || ' - junction' from f union all select episode, 'objects', 't' || r || ' - junction' from l
union all select episode, 'init', '(connected s' || r || ' r' || r || ' j' || tj || ')' from f union all select episode, 'init', '(connected j' || fj || ' r' || r || ' t' || r || ')' from l
union all select f.episode, 'init', '(connected s' || f.r || ' r' || f.r || ' t' || f.r || ')' from f join l on f.episode = l.episode and f.r = l.r
union all select episode, 'init', '(at ' || name || ' s' || first_edge || ')' from planned union all select episode, 'init', '(togo ' || name || ' t' || last_edge || ')' from planned
union all select distinct episode, 'init', '(= (total-cost) 0)' from planned union all select episode, 'init', fact from allowed union all select episode, 'goal', '(at ' || name || ' t' || last_edge || ')' from planned) """


def _problem(spark, sf):
    planned = written(_planned(spark, sf))
    pairs = v.route(spark, sf).select(F.col("route_id").alias("vehicle_id"), "edge_id").distinct()
    allowed = planned.join(pairs, "vehicle_id").select("episode", F.format_string("(allowed %s r%d)", "name", "edge_id").alias("fact"))
    return planning.problem(planned, v.edge(spark, sf), allowed)


@query(PROBLEM + "select * from facts")
def planning_problem(spark, sf):
    return _problem(spark, sf)


@query(PROBLEM + "select episode, section, '(:' || section || chr(10) || string_agg(fact, chr(10) order by fact) || chr(10) || ')' as text from facts group by episode, section")
def planning_sections(spark, sf):
    return planning.sections(_problem(spark, sf))


@query(PROBLEM + "select episode, count(*) filter (where section = 'objects')::bigint as objects, count(*) filter (where section = 'init')::bigint as init, count(*) filter (where section = 'goal')::bigint as goals from facts group by 1")
def planning_totals(spark, sf):
    count = lambda s: F.coalesce(F.sum((F.col("section") == s).cast("bigint")), F.lit(0))
    return _problem(spark, sf).groupBy("episode").agg(count("objects").alias("objects"), count("init").alias("init"), count("goal").alias("goals"))


@query(", s as (select case when mark < 5 then 'a.pddl.1' else 'b.pddl' end as file, route_id as vehicle, pos as step, edge_id as road from v_route), m as (select vehicle, max(file) as file from s group by 1) select vehicle, step, road, file from s join m using (vehicle, file)")
def plan_override(spark, sf):
    steps = v.route(spark, sf).select(F.when(F.col("mark") < 5, "a.pddl.1").otherwise("b.pddl").alias("file"), F.col("route_id").alias("vehicle"), F.col("pos").alias("step"), F.col("edge_id").alias("road"))
    return planning.overridden(steps)


#: A plan for every route: its run in the region, or for odd routes the run and the edges after it in the ring.
CHAIN = """, w as (select edge_id as route_id, unnest([0, 1, 2, 3]) as pos from v_edge where edge_id % 9 < 3), c3 as (select route_id, pos, route_id // 9 * 9 + (route_id % 9 + pos) % 3 as edge_id from w where route_id // 9 * 9 + (route_id % 9 + pos) % 3 in (select edge_id from v_edge)),
o as (select route_id, list(edge_id order by pos) as edges from c3 group by 1), p as (select route_id, case when route_id % 2 = 0 then edges[2:3] else [edges[1] + 3] end as new from o),
whole as (select route_id, edges, list_concat(list_concat(edges[1:1], new), edges[4:]) as w from o join p using (route_id)),
t as (select route_id, w[k] as from_edge, w[k + 1] as to_edge from (select *, unnest(range(1, len(w))) as k from whole)), bad as (select distinct route_id from t where not exists (select 1 from v_connection c where c.from_edge = t.from_edge and c.to_edge = t.to_edge)) """


@query(CHAIN + "select route_id, array_to_string(case when route_id in (from bad) then edges else w end, ' ') as edges, route_id not in (from bad) as planned from whole")
def decode_checked(spark, sf):
    edges = v.edge(spark, sf)
    ring = edges.where("edge_id % 9 < 3").select(F.col("edge_id").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    ring = ring.withColumn("edge_id", F.floor(F.col("route_id") / 9) * 9 + (F.col("route_id") % 9 + F.col("pos")) % 3).join(edges.select("edge_id"), "edge_id", "left_semi")
    lists = sequences.as_lists(ring)
    plan = lists.select("route_id", F.when(F.col("route_id") % 2 == 0, F.slice("edges", 2, 2)).otherwise(F.array(F.get("edges", F.lit(0)) + 3)).alias("edges"))
    run = lists.select("route_id", F.lit(1).alias("left"), F.least(F.lit(3), F.size("edges")).alias("right"))
    return planning.checked(lists, plan, graph.connections(edges), run).select("route_id", F.array_join("edges", " ").alias("edges"), "planned")


@query(RUNS + LISTS + """, three as (select l.route_id, l.edges, r."left" as a, r."right" as b, list_reverse(l.edges[r."left" + 1:r."right"]) as new from lists l join runs r using (route_id) where r."right" - r."left" >= 3)
select l.route_id, array_to_string(case when t.route_id is null then l.edges else list_concat(list_concat(l.edges[1:a], new), l.edges[b + 1:]) end, ' ') as edges from lists l left join three t using (route_id)""")
def scenario_merge_runs(spark, sf):
    """Original, cut and planned scenario in one: the planned part replaces the cut one inside each original route."""
    route = v.route(spark, sf)
    runs = sequences.longest_run(route, v.region(spark, sf)).where("right - left >= 3")
    planned = sequences.as_lists(sequences.clipped(route, v.region(spark, sf), 3)).select("route_id", F.reverse("edges").alias("new"))
    joined = sequences.as_lists(route).join(runs, "route_id", "left").join(planned, "route_id", "left")
    left, right = F.col("left").cast("int"), F.col("right").cast("int")
    merged = F.when(F.col("new").isNull(), F.col("edges")).otherwise(sequences.spliced(F.col("edges"), left, right, F.col("new")))
    return joined.select("route_id", F.array_join(merged, " ").alias("edges"))


@query(LISTS + """, m as (select 0 as scenario, route_id, array_to_string(edges, ' ') as edges from lists union all select 1, route_id, array_to_string(edges, ' ') from plans),
f as (select edges, min(scenario * 1099511627776 + route_id) as k from m group by 1), n as (select edges, 'r' || (row_number() over (order by k) - 1) as new_id from f) select scenario::bigint as scenario, route_id, new_id from m join n using (edges)""")
def scenario_merge_reindexed(spark, sf):
    parts = [sequences.as_lists(r).select(F.lit(k).cast("bigint").alias("scenario"), "route_id", F.array_join("edges", " ").alias("edges")) for k, r in enumerate((v.route(spark, sf), v.planned(spark, sf)))]
    both = parts[0].unionByName(parts[1])
    firsts = both.groupBy("edges").agg(F.min(F.col("scenario") * 1099511627776 + F.col("route_id")).alias("first"))
    ids = sequences.dense_ids(firsts, "first").select("edges", F.concat(F.lit("r"), F.col("id").cast("string")).alias("new_id"))
    return both.join(ids, "edges").select("scenario", "route_id", "new_id")


@query(RUNS + """, pins as (select r.* from v_planned r semi join v_region g using (edge_id)), pisl as (select route_id, pos, edge_id, pos - row_number() over (partition by route_id order by pos) as island from pins),
plen as (select route_id, min(pos) as l, max(pos) + 1 as r, arg_min(edge_id, pos) as first_edge from pisl group by route_id, island),
entry as (select q.route_id, e.fj as entry from runs q join v_route t on t.route_id = q.route_id and t.pos = q."left" join v_edge e using (edge_id) where q."right" > q."left"),
fit as (select p.*, row_number() over (partition by p.route_id order by r - l desc, l) as k from plen p join v_edge e on e.edge_id = p.first_edge join entry n on n.route_id = p.route_id and n.entry = e.fj)
select route_id, l as "left", r as "right" from fit where k = 1""")
def filter_planned(spark, sf):
    """The longest run of a planned route that enters the region where the original does."""
    return scenario.entering_runs(v.route(spark, sf), v.planned(spark, sf), v.region(spark, sf), v.edge(spark, sf))


@query(LISTS + ', d as (select vehicle_id, depart, route_id from v_vehicle) select vehicle_id, depart, row_number() over (order by depart, vehicle_id) - 1 as place from d')
def vehicles_by_depart(spark, sf):
    """Vehicles numbered by depart, in ranges of it, so that no task sorts all of them."""
    cars = v.vehicle(spark, sf).select("vehicle_id", "depart")
    keyed = cars.withColumn("key", F.col("depart") * 100000000 + F.col("vehicle_id"))
    return sequences.dense_ids(keyed, "key", 100000000 * 86400).select("vehicle_id", "depart", F.col("id").alias("place"))


@query(PAIRS + """, n as (select from_edge, to_edge, count(*) as n from pairs group by all), f as (select from_edge, count(*) as fan from n group by 1), e as (select edge_id, tj, floor(speed / 15)::bigint as class from v_edge),
w as (select from_edge, to_edge, n * fan * greatest(10 - 3 * abs(a.class - b.class) - case when a.tj % 5 = 0 then 2 else 0 end, 1) as w from n join f using (from_edge) join e a on a.edge_id = from_edge join e b on b.edge_id = to_edge)
select route_id, sum(w)::bigint as score from pairs join w using (from_edge, to_edge) group by 1""")
def bottleneck_penalised(spark, sf):
    edges = v.edge(spark, sf).select("edge_id", "tj", F.floor(F.col("speed") / 15).alias("class"))
    lights = edges.where("tj % 5 = 0").select(F.col("tj").alias("junction")).distinct()
    return scenario.penalised_bottlenecks(v.route(spark, sf), edges, lights)


@query()
def batch_subnetworks(spark, sf):
    """The edges that vehicles of each two years may use inside the region; batches that share ends share what was found."""
    edges = v.edge(spark, sf)
    found = subnetworks.subnetworks(v.vehicle(spark, sf), v.route(spark, sf), v.region(spark, sf), graph.connections(edges), 2 * 365 * 86400)
    return found.select("episode", "vehicle_id", "status", F.array_join(F.transform("edges", lambda e: e.cast("string")), " ").alias("edges"))


USED = """, a as (select distinct vtype, edge_id from v_vehicle join v_route using (route_id)), b as (select distinct vtype, edge_id from v_vehicle join v_planned using (route_id)), known as (select edge_id from v_edge) """


def _used(spark, sf):
    """Edges that vehicles of each type use, before and after planning, as bitmaps; and the ids of the bits."""
    ids = sequences.dense_ids(v.edge(spark, sf).select("edge_id", F.col("edge_id").alias("key")), "key")
    types = v.vehicle(spark, sf).select("route_id", "vtype")
    return *[bitmaps.edge_bitmaps(r(spark, sf).join(types, "route_id"), ["vtype"], ids) for r in (v.route, v.planned)], ids


@query(USED + """select vtype, (count(a.edge_id))::bigint as "first", (count(b.edge_id))::bigint as "second", count(case when a.edge_id is not null and b.edge_id is not null then 1 end) as "both", count(case when b.edge_id is null then 1 end) as only_first, count(case when a.edge_id is null then 1 end) as only_second
from (select * from a semi join known using (edge_id)) a full join (select * from b semi join known using (edge_id)) b using (vtype, edge_id) group by vtype""")
def subgraph_comparison(spark, sf):
    first, second, _ = _used(spark, sf)
    return bitmaps.compared(first, second, ["vtype"])


@query(USED + "select distinct edge_id from (select * from a union all select * from b) semi join known using (edge_id)")
def subgraph_union(spark, sf):
    """The edges that any sub-graph has, from the union of all bitmaps."""
    first, second, ids = _used(spark, sf)
    return bitmaps.edges_of(bitmaps.merged(first.unionByName(second), []), [], ids)


ASSEMBLED = ROADS + NAMED + """, q as (select distinct episode, name, edge_id from planned p join v_route r on r.route_id = p.vehicle_id semi join v_edge using (edge_id)), net as (select distinct episode, edge_id, fj, tj from q join v_edge using (edge_id)),
turn as (select c.* from v_connection c join v_edge a on a.edge_id = from_edge join v_edge b on b.edge_id = to_edge where not (a.lanes = 1 and b.lanes = 3)),
tn as (select a.episode, from_edge, to_edge from net a join turn on from_edge = a.edge_id join net b on b.episode = a.episode and b.edge_id = to_edge),
outs as (select episode, fj as j, count(*) as n_out from net group by all), ins as (select n.episode, n.edge_id, n.tj as j, count(tn.to_edge) as n from net n left join tn on tn.episode = n.episode and tn.from_edge = n.edge_id group by all),
judged as (select i.*, n > 0 and n < coalesce(n_out, 0) as lacks from ins i left join outs using (episode, j)), ranked as (select *, bool_or(n > 0 and not lacks) over (partition by episode, j) as any_full, row_number() over (partition by episode, j, lacks order by edge_id) - 1 as r from judged),
part as (select episode, edge_id, j, 'j' || j || case when not lacks then '' when any_full then 's' || r when r = 0 then '' else 's' || (r - 1) end as p from ranked),
starts as (select distinct tn.episode, tn.to_edge as edge_id, p from tn join part on part.episode = tn.episode and part.edge_id = tn.from_edge union select episode, edge_id, 'j' || fj from net n where not exists (select 1 from ins i where i.episode = n.episode and i.j = n.fj)),
sized as (select net.episode, roads.* from net join roads using (edge_id)), top as (select episode, max(capacity) as c from sized group by 1),
init as (select s.episode, '(connected ' || s.p || ' r' || s.edge_id || ' ' || e.p || ')' as fact from starts s join part e using (episode, edge_id) union all select planned.episode, '(connected js' || name || ' r' || edge_id || ' ' || p || ')' from planned join part on part.episode = planned.episode and edge_id = first_edge
union all select pl.episode, '(connected ' || s.p || ' r' || edge_id || ' je' || name || ')' from planned pl join starts s on s.episode = pl.episode and edge_id = last_edge
union all select episode, '(= (length-light r' || edge_id || ') ' || cost_light || ')' from sized union all select episode, '(= (length-medium r' || edge_id || ') ' || cost_medium || ')' from sized union all select episode, '(= (length-heavy r' || edge_id || ') ' || cost_heavy || ')' from sized
union all select episode, '(cap r' || edge_id || ' use' || capacity || ')' from sized union all select s.episode, '(using r' || edge_id || ' use' || least(capacity, coalesce(n, 0)) || ')' from sized s left join (select episode, edge_id, count(*) as n from planned p join v_route r on r.route_id = p.vehicle_id where pos = 0 group by all) o using (episode, edge_id)
union all select episode, '(' || case when k <= light then 'light' when k <= light + medium then 'medium' else 'heavy' end || ' r' || edge_id || ' use' || k || ')' from (select *, unnest(range(capacity + 1)) as k from sized)
union all select episode, '(next use' || k || ' use' || (k + 1) || ')' from (select episode, unnest(range(c)) as k from top) union all select episode, '(allowed ' || name || ' r' || edge_id || ')' from q
union all select episode, '(at ' || name || ' js' || name || ')' from planned union all select episode, '(togo ' || name || ' je' || name || ')' from planned union all select distinct episode, '(= (total-cost) 0)' from planned),
objects as (select episode, p || ' - junction' as fact from (select episode, p from part union select episode, p from starts) union all select episode, 'js' || name || ' - junction' from planned union all select episode, 'je' || name || ' - junction' from planned
union all select episode, 'r' || edge_id || ' - road' from net union all select episode, name || ' - car' from planned union all select episode, 'use' || k || ' - use' from (select episode, unnest(range(c + 1)) as k from top)),
facts as (select episode, 'init' as section, fact from init union all select episode, 'objects', fact from objects union all select episode, 'goal', '(at ' || name || ' je' || name || ')' from planned union all select distinct episode, 'metric', 'minimize (total-cost)' from planned) """


def _assembled(spark, sf):
    """Problems of each week whose vehicles may use their routes, with vehicles on the first edges of routes, and turns that narrow roads lack."""
    edges, planned = v.edge(spark, sf), written(_planned(spark, sf))
    lists = planned.join(v.route(spark, sf).withColumnRenamed("route_id", "vehicle_id"), "vehicle_id")
    allowed = lists.groupBy("episode", "name").agg(F.collect_set("edge_id").alias("allowed"))
    cars = planned.select("episode", "name", F.array("first_edge").alias("firsts"), F.array("last_edge").alias("lasts")).join(allowed, ["episode", "name"])
    lanes = edges.select("edge_id", "lanes")
    turns = graph.connections(edges).join(lanes.toDF("from_edge", "a"), "from_edge").join(lanes.toDF("to_edge", "b"), "to_edge").where("not (a = 1 and b = 3)")
    return planning.packed_problems(cars, edges, turns, lists.where("pos = 0").groupBy("episode", "edge_id").agg(F.count(F.lit(1)).alias("n")))


@query(ASSEMBLED + "select episode, section, count(*) as facts, sha256(string_agg(fact, chr(10) order by fact)) as digest from facts group by episode, section")
def assembled_problems(spark, sf):
    """How many facts each section of each problem has, and the digest of its text."""
    return planning.digests(_assembled(spark, sf))


@query(ASSEMBLED + """, kinds as (select episode, string_split(fact, ' - ')[2] as kind, string_agg(string_split(fact, ' - ')[1], ' ' order by string_split(fact, ' - ')[1]) as names from objects group by 1, 2)
select episode, string_agg(names || ' - ' || kind, chr(10) order by kind) as text from kinds group by 1""")
def problem_objects(spark, sf):
    return planning.grouped_objects(_assembled(spark, sf))
