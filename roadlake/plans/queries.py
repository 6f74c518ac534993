"""All traffic queries, each with the SQL that it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.functions import formulas as fm
from roadlake.functions.storage import written
from roadlake.operators import congestion, flows, graph, gravity, planning, scenario, selection, sequences, similarity
from roadlake.operators.components import connected_components
from roadlake.plans import views as v
from roadlake.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Density clusters of routes: distance and samples.
EPS, MIN_SAMPLES = 0.5, 2
#: Routes of fewer distinct edges aren't compared.
LEAST_EDGES = 3
HALF = 1705276800  # seconds; intervals before and from here on are compared


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (v.SQL + sql).strip()
        return f

    return add


CELLS = """, cells as (select begin, edge_id, sum(trunc(traveltime * 1000)::bigint)::double / count(traveltime) / 1000 as traveltime, max(free_flow) as free_flow from v_dump group by all),
ci as (select begin, edge_id, traveltime, case when traveltime > free_flow then round_even(1 - free_flow / traveltime, 3)::double else 0.0::double end as ci from cells)
"""


@query(CELLS + "select begin, edge_id, floor(traveltime * 1000)::bigint as milli, (round_even(ci * 1000, 0))::bigint as ci_milli from ci")
def ci_per_interval(spark, sf):
    cells = congestion.per_interval(v.dump(spark, sf))
    return cells.select("begin", "edge_id", F.floor(F.col("traveltime") * 1000).alias("milli"), F.bround(F.col("ci") * 1000).cast("bigint").alias("ci_milli"))


@query(CELLS + """select e.edge_id, round_even((coalesce(s.s, 0) / 1000 / n.n + 0.001) * 10.0, 3)::double as ci from v_edge e
left join (select edge_id, sum((ci * 1000)::decimal(18,0))::double as s from ci group by 1) s using (edge_id), (select greatest(count(distinct begin), 1) as n from ci) n""")
def ci_mean_all_intervals(spark, sf):
    return congestion.mean_over_all(congestion.per_interval(v.dump(spark, sf)), v.edge(spark, sf))


OBSERVED = "select edge_id, count(*) as n, floor(sum(trunc(ci * 1000)::bigint)::double / count(*))::bigint as ci_milli from ci"


@query(CELLS + OBSERVED + " group by 1")
def ci_mean_observed(spark, sf):
    return congestion.mean_over_observed(congestion.per_interval(v.dump(spark, sf)))


DIFF = f""", a as ({OBSERVED} where begin < {HALF} group by 1), b as ({OBSERVED} where begin >= {HALF} group by 1),
diffs as (select edge_id, coalesce(a.ci_milli, 0) as ci_a, coalesce(b.ci_milli, 0) as ci_b, coalesce(a.ci_milli, 0) - coalesce(b.ci_milli, 0) as diff from a full join b using (edge_id))
"""


def _diffs(spark, sf):
    cells = congestion.per_interval(v.dump(spark, sf))
    half = lambda test: congestion.mean_over_observed(cells.where(test))
    return congestion.difference(half(F.col("begin") < HALF), half(F.col("begin") >= HALF))


@query(CELLS + DIFF + "select * from diffs")
def ci_difference(spark, sf):
    return _diffs(spark, sf)


@query("select edge_id, sum(trunc(traveltime * 1000)::bigint)::bigint as total, floor(sum(trunc(traveltime * 1000)::bigint)::double / count(distinct begin))::bigint as per_interval from v_dump where begin >= 1704585600 and begin + 900 <= 1705881600 group by 1")
def dump_attribute_sum(spark, sf):
    return congestion.attribute_sum(congestion.within(v.dump(spark, sf), 1704585600, 1705881600, v.INTERVAL), "traveltime")


@query("select edge_id, round_even(length / speed, 3)::double as seconds from v_edge")
def edge_free_flow_time(spark, sf):
    return v.edge(spark, sf).select("edge_id", fm.free_flow_time(F.col("length"), F.col("speed")).alias("seconds"))


@query("select id, x || ',' || y || ' ' || (x + w) || ',' || (y + w) as shape, 2::bigint as n, (2 * x + w)::bigint as sx, (2 * y + w)::bigint as sy from v_point")
def shape_parse(spark, sf):
    p = v.point(spark, sf)
    text = F.concat_ws(" ", F.concat_ws(",", "x", "y"), F.concat_ws(",", F.col("x") + F.col("w"), F.col("y") + F.col("w")))
    shaped = p.select("id", text.alias("shape")).withColumn("s", fm.parsed_shape(F.col("shape")))
    total = lambda k: F.aggregate("s", F.lit(0.0), lambda a, q: a + q[k]).cast("bigint")
    return shaped.select("id", "shape", F.size("s").cast("bigint").alias("n"), total("x").alias("sx"), total("y").alias("sy"))


@query("select vec_id as id, floor(list_sum(list_transform(embedding, lambda e: floor(e::double * 1000)::bigint))::double / len(embedding))::bigint as centre from embeddings")
def edge_centroid(spark, sf):
    points = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.explode("embedding").alias("e"))
    return points.groupBy("id").agg(F.floor(F.sum(F.floor(F.col("e").cast("double") * 1000)) / F.count("e")).alias("centre"))


@query("select edge_id::varchar as id, length::varchar as length, lanes::integer as lanes from v_edge")
def attribute_whitelist(spark, sf):
    return v.edge(spark, sf).select(F.col("edge_id").cast("string").alias("id"), F.col("length").cast("string").alias("length"), F.col("lanes").cast("int").alias("lanes"))


LENGTHS = ", placed as (select r.route_id, r.pos, e.* from v_route r join v_edge e using (edge_id)) "


@query(LENGTHS + """select route_id, sum(floor(length * 1000)::bigint)::bigint as milli, arg_max(tj, pos) as destination,
(greatest(floor(sum(floor(length * 1000)::bigint)::bigint / 7000.0), 1) * greatest(min(lanes), 1))::bigint as capacity,
floor(greatest(sum(floor(length * 1000)::bigint)::bigint::double * count(*) / sum(speed), 1000))::bigint as travel_milli from placed group by 1""")
def route_length_capacity(spark, sf):
    placed = v.route(spark, sf).join(v.edge(spark, sf), "edge_id")
    milli = F.sum(F.floor(F.col("length") * 1000))
    sums = placed.groupBy("route_id").agg(milli.alias("milli"), F.max_by("tj", "pos").alias("destination"), F.min("lanes").alias("lanes"), F.count(F.lit(1)).alias("n"), F.sum("speed").alias("speed"))
    travel = F.floor(F.greatest(F.col("milli").cast("double") * F.col("n") / F.col("speed"), F.lit(1000.0)))
    return sums.select("route_id", "milli", "destination", fm.route_capacity(F.col("milli") / 1000, F.col("lanes")).alias("capacity"), travel.alias("travel_milli"))


@query(LENGTHS + "select route_id, arg_min(fj, pos)::varchar || ' ' || string_agg(tj::varchar, ' ' order by pos) as junctions from placed group by 1")
def route_junction_sequence(spark, sf):
    placed = v.route(spark, sf).join(v.edge(spark, sf).select("edge_id", "fj", "tj"), "edge_id")
    steps = F.array_sort(F.collect_list(F.struct("pos", "fj", "tj")))
    lists = placed.groupBy("route_id").agg(steps.alias("s"))
    return lists.select("route_id", F.concat_ws(" ", F.col("s")[0]["fj"].cast("string"), F.array_join(F.transform("s", lambda s: s["tj"].cast("string")), " ")).alias("junctions"))


@query(LENGTHS + ", l as (select route_id, tj, lead(fj) over (partition by route_id order by pos) as n from placed) select route_id, (count(*) filter (where tj <> n))::bigint as broken from l group by 1")
def route_validity(spark, sf):
    return sequences.broken_joints(v.route(spark, sf), v.edge(spark, sf))


PAIRS = ", pairs as (select * from (select route_id, pos, edge_id as from_edge, lead(edge_id) over (partition by route_id order by pos) as to_edge from v_route) where to_edge is not null) "


@query(PAIRS + "select route_id, count(*) as forbidden from pairs p where not exists (select 1 from v_connection c where c.from_edge = p.from_edge and c.to_edge = p.to_edge) group by 1")
def turn_check(spark, sf):
    return sequences.forbidden_turns(v.route(spark, sf), graph.connections(v.edge(spark, sf)))


@query(PAIRS + "select from_edge, to_edge, count(*) as n from pairs group by all")
def edge_transitions(spark, sf):
    return sequences.transitions(v.route(spark, sf)).groupBy("from_edge", "to_edge").agg(F.count(F.lit(1)).alias("n"))


RUNS = """, inside as (select r.* from v_route r semi join v_region g using (edge_id)),
islands as (select route_id, pos - row_number() over (partition by route_id order by pos) as island, pos from inside),
lengths as (select route_id, min(pos) as l, max(pos) + 1 as r from islands group by route_id, island),
best as (select route_id, l, r from lengths qualify row_number() over (partition by route_id order by r - l desc, l) = 1),
runs as (select route_id, coalesce(l, 0)::bigint as "left", coalesce(r, 0)::bigint as "right" from (select distinct route_id from v_route) left join best using (route_id)) """


@query(RUNS + "select * from runs")
def longest_in_region_run(spark, sf):
    return sequences.longest_run(v.route(spark, sf), v.region(spark, sf))


@query(RUNS + """select route_id, string_agg(edge_id::varchar, ' ' order by pos) as edges from v_route join runs using (route_id) where pos >= "left" and pos < "right" and "right" - "left" >= 3 group by 1""")
def clip_routes_to_region(spark, sf):
    cut = sequences.clipped(v.route(spark, sf), v.region(spark, sf), least=3)
    return sequences.as_lists(cut).select("route_id", F.array_join("edges", " ").alias("edges"))


LISTS = """, lists as (select route_id, list(edge_id order by pos) as edges from v_route group by 1),
plans as (select route_id, list(edge_id order by pos) as edges from v_planned group by 1) """


@query(LISTS + ", t as (select route_id, array_to_string(edges, ' ') as edges from lists), f as (select edges, min(route_id) as m from t group by 1), n as (select edges, row_number() over (order by m) - 1 as k from f) select route_id, t.edges, 'r' || k as new_id from t join n using (edges)")
def route_reindex(spark, sf):
    return sequences.reindexed(v.route(spark, sf))


DIFFS = LISTS + """, d as (select route_id, a.edges as a, b.edges as b,
  list_position(list_transform(range(1, len(a.edges) + 1), lambda k: a.edges[k] <> b.edges[k]), true) as f,
  list_position(list_transform(range(1, len(a.edges) + 1), lambda k: a.edges[len(a.edges) + 1 - k] <> b.edges[len(a.edges) + 1 - k]), true) as g
  from lists a join plans b using (route_id) where a.edges <> b.edges) """


@query(DIFFS + """select route_id, (f - 1)::integer as "left", (len(a) - g + 1)::integer as old_right, (len(a) - g + 1)::integer as new_right,
array_to_string(a[f:len(a) - g + 1], ' ') as old_part, array_to_string(b[f:len(a) - g + 1], ' ') as new_part from d""")
def route_diff(spark, sf):
    return sequences.route_diff(v.route(spark, sf), v.planned(spark, sf))


@query(RUNS + LISTS + """select route_id, array_to_string(list_concat(list_concat(edges[1:"left"], list_reverse(edges["left" + 1:"right"])), edges["right" + 1:]), ' ') as edges from lists join runs using (route_id)""")
def route_splice(spark, sf):
    runs = sequences.longest_run(v.route(spark, sf), v.region(spark, sf))
    joined = sequences.as_lists(v.route(spark, sf)).join(runs, "route_id")
    left, right = F.col("left").cast("int"), F.col("right").cast("int")
    middle = F.reverse(F.slice("edges", left + 1, right - left))
    return joined.select("route_id", F.array_join(sequences.spliced(F.col("edges"), left, right, middle), " ").alias("edges"))


@query(LISTS + """select count(*) as routes, (count(*) filter (where a.edges <> b.edges))::bigint as changed, (count(*) filter (where a.edges[1] <> b.edges[1]))::bigint as first_changed,
(count(*) filter (where a.edges[-1] <> b.edges[-1]))::bigint as last_changed from lists a join plans b using (route_id)""")
def changed_vehicle_report(spark, sf):
    return scenario.change_report(sequences.as_lists(v.route(spark, sf)), sequences.as_lists(v.planned(spark, sf)))


@query(CELLS + DIFF + """, c as (select distinct route_id as vehicle_id, p.edge_id from v_planned p where route_id in (select route_id from v_route r join v_planned q using (route_id, pos) where r.edge_id <> q.edge_id)),
f as (select vehicle_id, max((coalesce(diff, 0) < -250)::bigint) as x, max((coalesce(diff, 0) < -500)::bigint) as y, max((coalesce(diff, 0) < -750)::bigint) as z from c left join diffs using (edge_id) group by 1)
select count(*) as changed, coalesce(sum(x), 0)::bigint as below_250, coalesce(sum(y), 0)::bigint as below_500, coalesce(sum(z), 0)::bigint as below_750 from f""")
def contribution_buckets(spark, sf):
    ids = sequences.route_diff(v.route(spark, sf), v.planned(spark, sf)).select("route_id")
    changed = v.planned(spark, sf).join(ids, "route_id", "left_semi").select(F.col("route_id").alias("vehicle_id"), "edge_id").distinct()
    return scenario_contribution(changed, _diffs(spark, sf))


def scenario_contribution(changed, diffs):
    return congestion.contribution(changed, diffs)


LOW, HIGH = 830000000, 860000000


@query(f", l as (select route_id, count(*) as n from v_route group by 1) select vehicle_id, depart, n from v_vehicle join l using (route_id) where depart >= {LOW} and depart < {HIGH}")
def vehicles_in_window(spark, sf):
    sizes = v.route(spark, sf).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return planning.departing(v.vehicle(spark, sf), LOW, HIGH).join(sizes, "route_id").select("vehicle_id", "depart", "n")


@query('select (depart - s) // 86400 as episode, count(*) as vehicles, min(depart) as "first", max(depart) as "last" from v_vehicle, (select min(depart) as s from v_vehicle) group by 1')
def episode_windows(spark, sf):
    return planning.episodes(v.vehicle(spark, sf), 86400)


@query("""select vtype, count(*) as periods, sum(n)::bigint as vehicles, floor(sum(n)::double * 1000 / count(*))::bigint as mean_milli,
floor((sum(n * n)::bigint * count(*) - sum(n)::bigint * sum(n)::bigint)::double * 1000 / (count(*) * count(*)))::bigint as variance_milli
from (select vtype, depart // 604800 as p, count(*) as n from v_vehicle group by all) group by 1""")
def traffic_intensity(spark, sf):
    return scenario.intensity(v.vehicle(spark, sf), 604800)


@query("select vtype, count(*) as vehicles, count(distinct depart // 86400) as episodes, floor(count(*)::double * 100 / count(distinct depart // 86400))::bigint as mean_hundredths from v_vehicle group by 1")
def episode_totals(spark, sf):
    days = F.count_distinct(F.floor(F.col("depart") / 86400))
    n = F.count(F.lit(1))
    return v.vehicle(spark, sf).groupBy("vtype").agg(n.alias("vehicles"), days.alias("episodes"), F.floor(n * 100 / days).alias("mean_hundredths"))


@query(""", ends as (select route_id, arg_min(edge_id, pos) as first_edge, arg_max(edge_id, pos) as last_edge from v_route group by 1)
select first_edge, last_edge, count(*) as vehicles from v_vehicle join ends using (route_id) group by 1, 2 order by 3 desc, 1, 2 limit 20""")
def flow_topn(spark, sf):
    return scenario.flows(v.vehicle(spark, sf), v.route(spark, sf), 20)


@query(""", o as (select fj as junction, count(distinct tj) as n_out, array_to_string(list_sort(list_distinct(list(tj))), ' ') as targets from v_edge group by 1),
i as (select tj as junction, count(distinct fj) as n_in, array_to_string(list_sort(list_distinct(list(fj))), ' ') as sources from v_edge group by 1)
select junction, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(sources, '') as sources, coalesce(targets, '') as targets from o full join i using (junction)""")
def neighbours_in_out(spark, sf):
    return graph.neighbours(v.edge(spark, sf))


@query("select to_edge as edge_id, count(distinct from_edge) as n, array_to_string(list_sort(list_distinct(list(from_edge))), ' ') as sources from v_connection group by 1")
def edge_connections(spark, sf):
    return graph.incoming(graph.connections(v.edge(spark, sf)))


REGION = """, g as (select e.* from v_edge e semi join v_region r using (edge_id)), gc as (select c.* from v_connection c where from_edge in (select edge_id from g) and to_edge in (select edge_id from g)),
gj as (select fj as junction from g union select tj from g),
fr as (select fj as junction, 'start' as kind from g where edge_id not in (select to_edge from gc) union select tj, 'end' from g where edge_id not in (select from_edge from gc)) """


def _region_graph(spark, sf):
    edges = graph.subgraph(v.edge(spark, sf), v.region(spark, sf))
    return edges, graph.connections(edges)


@query(REGION + "select * from fr")
def fringe_junctions(spark, sf):
    return graph.fringe(*_region_graph(spark, sf))


@query(REGION + "select junction from gj where junction not in (select junction from fr)")
def inner_junctions(spark, sf):
    return graph.inner_junctions(*_region_graph(spark, sf))


@query(REGION + ", k as (select junction, string_agg(kind, '+' order by kind) as k from fr group by 1) select junction, case when k = 'start' then 'entry' when k = 'end' then 'exit' when k is null then 'inner' else 'both' end as kind from gj left join k using (junction)")
def junction_classes(spark, sf):
    return graph.junction_classes(*_region_graph(spark, sf))


REVERSE = ", rev as (select c.from_edge, c.to_edge from v_connection c join v_edge a on a.edge_id = c.from_edge join v_edge b on b.edge_id = c.to_edge where a.fj = b.tj and a.tj = b.fj) "


@query(REVERSE + "select * from rev")
def self_loop_connections(spark, sf):
    edges = v.edge(spark, sf)
    return graph.reversals(edges, graph.connections(edges))


@query(REVERSE + "select * from v_connection c where not exists (select 1 from rev r where r.from_edge = c.from_edge and r.to_edge = c.to_edge and r.to_edge in (select to_edge from v_connection group by 1 having count(*) = 1))")
def turn_connections(spark, sf):
    edges = v.edge(spark, sf)
    return graph.without_lone_reversals(edges, graph.connections(edges))


@query(REGION + "select edge_id, case when fj in (select junction from gj) and tj in (select junction from gj) then 'both' when fj in (select junction from gj) then 'out' else 'in' end as side from v_edge where edge_id not in (select edge_id from g) and (fj in (select junction from gj) or tj in (select junction from gj))")
def boundary_connections(spark, sf):
    return graph.boundary(v.edge(spark, sf), _region_graph(spark, sf)[0])


REMOVABLE = REGION + """, d as (select * from (select tj as junction, count(*) as n_in, list_sort(list_distinct(list(fj))) as s from g group by 1) join (select fj as junction, count(*) as n_out, list_sort(list_distinct(list(tj))) as t from g group by 1) using (junction)),
rm as (select junction from d where ((n_in = 1 and n_out = 1 and s <> t) or (n_in = 2 and n_out = 2 and len(s) = 2 and s = t)) and not list_contains(s, junction)) """


@query(REMOVABLE + "select * from rm")
def removable_junctions(spark, sf):
    return graph.removable(_region_graph(spark, sf)[0])


CHASE = REMOVABLE + """, chase(path, fj, back, tj, n_edges, milli) as (
select edge_id::varchar, fj, fj, tj, 1::bigint, floor(length * 1000)::bigint from g where fj not in (select junction from rm)
union all select path || ' ' || g.edge_id, c.fj, g.fj, g.tj, n_edges + 1, milli + floor(g.length * 1000)::bigint from chase c join g on c.tj = g.fj and g.tj <> c.back where c.tj in (select junction from rm)),
ring(first_, path, fj, back, tj, n_edges, milli) as (select edge_id, edge_id::varchar, fj, fj, tj, 1::bigint, floor(length * 1000)::bigint from g where fj in (select junction from rm)
union all select first_, path || ' ' || g.edge_id, r.fj, g.fj, g.tj, n_edges + 1, milli + floor(g.length * 1000)::bigint from ring r join g on r.tj = g.fj and g.tj <> r.back where r.tj in (select junction from rm) and g.edge_id > first_),
drawn as (select path, fj, tj, n_edges, milli, false as closed from chase where tj not in (select junction from rm)
union all select r.path, r.fj, r.tj, n_edges, milli, true from ring r join g on g.edge_id = first_ where r.tj = g.fj and g.tj <> r.back) """


@query(CHASE + "select * from drawn")
def contract_chains(spark, sf):
    edges = _region_graph(spark, sf)[0].withColumn("length", F.floor(F.col("length") * 1000))
    return graph.contracted(edges, graph.removable(edges)).withColumnRenamed("length", "milli")


@query()
def simplify_network(spark, sf):
    """The whole network with its chains and roundabouts drawn together until nothing changes."""
    edges = v.edge(spark, sf).withColumn("length", F.floor(F.col("length") * 1000))
    return graph.simplified(edges, graph.rings(edges, 3))[0].withColumnRenamed("length", "milli")


@query(", k as (select distinct edge_id from v_route where mark = 0) select edge_id, fj, tj from v_edge semi join k using (edge_id)")
def subgraph_by_edges(spark, sf):
    return graph.subgraph(v.edge(spark, sf), v.route(spark, sf).where("mark = 0")).select("edge_id", "fj", "tj")


@query(", k as (select fj as j from v_region union select tj from v_region) select edge_id, fj, tj from v_edge where fj in (from k) and tj in (from k)")
def subgraph_by_junctions(spark, sf):
    return graph.induced(v.edge(spark, sf), graph.junctions(v.region(spark, sf))).select("edge_id", "fj", "tj")


TWO = ", ga as (select edge_id, fj, tj from v_edge where speed >= 12), gb as (select edge_id, fj, tj from v_edge where speed <= 40) "


def _two(spark, sf):
    """The graphs of the roads that aren't slow and of those that aren't fast."""
    edges, own = v.edge(spark, sf), ["edge_id", "fj", "tj"]
    return edges.where("speed >= 12").select(own), edges.where("speed <= 40").select(own)


@query(TWO + ", j as (select junction from (select fj as junction from ga union select tj from ga) where junction in (select fj from gb union select tj from gb)) select * from ga where fj in (select junction from j) and tj in (select junction from j)")
def graph_intersection(spark, sf):
    return graph.intersection(*_two(spark, sf))


@query(TWO + "select * from ga union select * from gb")
def graph_union(spark, sf):
    return graph.union(*_two(spark, sf))


@query(TWO + "select * from ga where edge_id not in (select edge_id from gb)")
def graph_minus(spark, sf):
    return graph.minus(*_two(spark, sf))


@query(TWO + "select * from ga where edge_id not in (select edge_id from gb) union all select * from gb where edge_id not in (select edge_id from ga)")
def graph_symdiff(spark, sf):
    return graph.symmetric_difference(*_two(spark, sf))


@query(TWO + """, ja as (select fj as j from ga union select tj from ga), jb as (select fj as j from gb union select tj from gb),
ca as (select x.edge_id as p, y.edge_id as q from ga x join ga y on x.tj = y.fj and x.edge_id <> y.edge_id), cb as (select x.edge_id as p, y.edge_id as q from gb x join gb y on x.tj = y.fj and x.edge_id <> y.edge_id),
n as (select (select count(*) from ((select edge_id from ga except select edge_id from gb) union all (select edge_id from gb except select edge_id from ga))) as odd_edges,
(select count(*) from ((select j from ja except select j from jb) union all (select j from jb except select j from ja))) as odd_junctions,
(select count(*) from ((select * from ca except select * from cb) union all (select * from cb except select * from ca))) as odd_connections)
select *, odd_edges + odd_junctions + odd_connections = 0 as equal from n""")
def graph_equality(spark, sf):
    return graph.equality(*_two(spark, sf))


@query("""select 'missing_junction' as "check", count(*) as violations from (select fj as j from v_edge union select tj from v_edge) where j not in (select fj from v_edge)
union all select 'unused_junction', 0
union all select 'unknown_edge', 0 union all select 'no_meeting', 0""")
def graph_consistency(spark, sf):
    edges = v.edge(spark, sf)
    return graph.consistency(edges, graph.connections(edges), edges.select(F.col("fj").alias("junction")).distinct())


@query(", j as (select fj as junction from v_edge union select tj from v_edge) select 'all' as name, (select count(*) from j) as junctions, count(*) as edges, sum(floor(length * 1000)::bigint)::bigint as milli from v_edge")
def network_summary(spark, sf):
    return graph.network_summary(v.edge(spark, sf), "all")


PATHS = """, paths(target, n_edges, milli, path, seen) as (
select tj, 1::bigint, floor(length * 1000)::bigint, edge_id::varchar, ',' || fj || ',' || tj || ',' from v_edge where fj <> tj
union all select e.tj, n_edges + 1, milli + floor(e.length * 1000)::bigint, path || ' ' || e.edge_id, seen || e.tj || ',' from paths p join v_edge e on p.target = e.fj where n_edges < 4 and not contains(seen, ',' || e.tj || ',')) """


@query(PATHS + "select target, n_edges, milli, path from paths")
def bounded_paths(spark, sf):
    return graph.bounded_paths(v.edge(spark, sf), F.lit(True), 4).drop("start")


@query(PATHS + """select target, rank, n_edges, milli, path from (select *, min(milli) over (partition by target) as low, row_number() over (partition by target order by milli, path) as rank from paths)
where rank <= 3 and milli <= low * 1.3""")
def topk_paths(spark, sf):
    return graph.top_paths(graph.bounded_paths(v.edge(spark, sf), F.lit(True), 4), 3, 1.3, ("target",))


@query(""", paths(start, target, n_edges, milli, path, seen) as (
select fj, tj, 1::bigint, floor(length * 1000)::bigint, edge_id::varchar, ',' || fj || ',' || tj || ',' from v_edge where fj <> tj
union all select start, e.tj, n_edges + 1, milli + floor(e.length * 1000)::bigint, path || ' ' || e.edge_id, seen || e.tj || ',' from paths p join v_edge e on p.target = e.fj where n_edges < 4 and not contains(seen, ',' || e.tj || ','))
select start, target, rank, n_edges, milli, path from (select *, min(milli) over (partition by start, target) as low, row_number() over (partition by start, target order by milli, path) as rank from paths)
where rank <= 3 and milli <= low * 1.3""")
def topk_paths_of_pairs(spark, sf):
    return graph.top_paths(graph.bounded_paths(v.edge(spark, sf), F.lit(True), 4), 3, 1.3)


SETS = f""", sets as (select route_id, list_distinct(list(edge_id)) as s from v_route group by 1 having count(distinct edge_id) >= {LEAST_EDGES}),
items as (select route_id, unnest(s) as e, len(s) as n from sets),
shared as (select a.route_id as a, b.route_id as b, a.n as na, b.n as nb, count(*) as shared from items a join items b on a.e = b.e and a.route_id < b.route_id group by all)"""
CLOSE = SETS + f""", close as (select a, b, shared, na + nb - shared as total from shared where shared >= (na + nb - shared) * {1 - EPS}) """


def _long_routes(spark, sf):
    r = v.route(spark, sf)
    enough = r.groupBy("route_id").agg(F.count_distinct("edge_id").alias("n")).where(F.col("n") >= LEAST_EDGES)
    return r.join(enough, "route_id", "left_semi")


def _equal(spark, sf):
    """Long routes with their set's lowest route, the routes that are such, and the number of copies of each."""
    long = _long_routes(spark, sf)
    equal = written(similarity.equal_sets(long))
    return equal, long.join(equal.where("id = root").select(F.col("id").alias("route_id")), "route_id", "left_semi"), similarity.copies(equal)


EQUAL = SETS + ", equal as (select route_id as id, min(route_id) over (partition by list_sort(s)) as root from sets), copies as (select root as id, count(*) as n from equal group by 1)"


@query(EQUAL + "select id, root from equal")
def equal_routes(spark, sf):
    return similarity.equal_sets(_long_routes(spark, sf))


@query(EQUAL + ", c as (select a, b, shared, na + nb - shared as total from shared) select a, b, x.n as copies_a, y.n as copies_b, shared, total from c join copies x on x.id = a join copies y on y.id = b where shared >= total * 0.25 - 1e-9")
def route_jaccard(spark, sf):
    _, roots, copies = _equal(spark, sf)
    of = lambda side: copies.select(F.col("id").alias(side), F.col("n").alias(f"copies_{side}"))
    return similarity.jaccard_at_least(roots, 0.25).join(of("a"), "a").join(of("b"), "b")


@query(CLOSE + ", twofold as (select a, b from close union all select b, a from close) select a as id, count(*) + 1 as n from twofold group by 1 having count(*) + 1 >= 2")
def dbscan_core_points(spark, sf):
    equal, roots, copies = _equal(spark, sf)
    pairs = written(similarity.jaccard_at_least(roots, 1 - EPS))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("root")).agg(F.sum("n").alias("near"))
    all_ = copies.withColumnRenamed("id", "root").join(near, "root", "left").select("root", (F.col("n") + F.coalesce("near", F.lit(0))).alias("n"))
    return equal.join(all_.where(F.col("n") >= MIN_SAMPLES), "root").select("id", "n")


LABELS = CLOSE + """, twofold as (select a, b from close union select b, a from close), reach(a, b) as (select a, b from twofold union select r.a, t.b from reach r join twofold t on r.b = t.a),
labels as (select s.route_id as id, coalesce(least(s.route_id, min(r.b)), -1)::bigint as label from sets s left join reach r on r.a = s.route_id group by s.route_id),
lab as (select id, case when id in (select a from twofold) then label else -1 end as label from labels) """


def _labels(spark, sf):
    """Labels of all long routes; labels and copies of those that stand for equal ones; their close pairs; who is equal to whom."""
    equal, roots, copies = _equal(spark, sf)
    pairs = written(similarity.jaccard_at_least(roots, 1 - EPS))
    of_roots = written(similarity.density_clusters(copies, pairs, MIN_SAMPLES).join(copies, "id"))
    return _of_all(equal, of_roots.select("id", "label")), of_roots, pairs, equal


def _of_all(equal, of_roots):
    """``of_roots`` for each of the routes that have the same set."""
    return equal.join(of_roots.withColumnRenamed("id", "root"), "root").drop("root")


@query(LABELS + "select * from lab")
def dbscan_labels(spark, sf):
    return _labels(spark, sf)[0]


@query(LABELS + ", m as (select label, count(*) as size from lab where label >= 0 group by 1) select label, size from m where size > 1")
def cluster_size_filter(spark, sf):
    return gravity.cluster_sizes(_labels(spark, sf)[0].where("label >= 0").withColumnRenamed("label", "leader"), 1).withColumnRenamed("leader", "label")


@query(LABELS + """, x as (select id, label, len(s) as score from lab join sets on route_id = id where label >= 0), r as (select *, row_number() over (partition by label order by score, id) as rank from x)
select id, label, score, rank from r order by rank, label limit 15""")
def pick_best_routes(spark, sf):
    labels = _labels(spark, sf)[0]
    sizes = v.route(spark, sf).groupBy(F.col("route_id").alias("id")).agg(F.count_distinct("edge_id").alias("score"))
    return similarity.round_robin(labels.where("label >= 0").join(sizes, "id").select("id", "label", "score"), 15)


AVERAGE = LABELS + """, w as (select a, b, floor(shared * 1000000.0 / total)::bigint as s from close union all select b, a, floor(shared * 1000000.0 / total)::bigint from close),
sums as (select a as id, (sum(case when x.label = y.label then s else 0 end))::bigint as inside, (sum(case when x.label <> y.label then s else 0 end))::bigint as outside from w join lab x on x.id = a join lab y on y.id = b group by 1)
select id, label, coalesce(inside, 0) as inside, coalesce(outside, 0) as outside from lab left join sums using (id)"""


@query(LABELS + """, equal as (select route_id as id, min(route_id) over (partition by list_sort(s)) as root from sets), copies as (select root as id, count(*) as n from equal group by 1),
own as (select id, label, n from copies join lab using (id)), w as (select a, b, shared * 1000000 // (na + nb - shared) as s from shared union all select b, a, shared * 1000000 // (na + nb - shared) from shared),
sums as (select o.id, o.label, any_value(o.n) as n, 1000000 * any_value(o.n) + coalesce(sum(w.s * p.n), 0) as everything, 1000000 * any_value(o.n) + coalesce(sum(case when p.label = o.label then w.s * p.n end), 0) as inside
  from own o left join w on w.a = o.id left join own p on p.id = w.b group by o.id, o.label),
sizes as (select label, sum(n) as size from own group by 1), whole as (select sum(n) as total from own),
scored as (select 'average_similarity' as metric, id, label, n, case when size > 1 then (inside - 1000000) // (size - 1) else 0 end as score from sums join sizes using (label) union all select 'maximal_similarity', id, label, n, (everything - inside) // total from sums, whole),
means as (select metric, label, case when metric = 'average_similarity' then sum(score * n) // sum(n) else 0 end as mean from scored group by metric, label),
places as (select metric, label, row_number() over (partition by metric order by mean desc, label) as cluster_rank from means)
select metric, id, label, score::bigint as score, cluster_rank, row_number() over (partition by metric, label order by score desc, id) as rank from scored join places using (metric, label)""")
def similarity_ranking(spark, sf):
    """Routes in their clusters and clusters by two metrics, from one product of all routes with all."""
    _, of_roots, _, _ = _labels(spark, sf)
    sets = _equal(spark, sf)[1].groupBy(F.col("route_id").alias("id")).agg(F.collect_set("edge_id").alias("edges")).join(of_roots, "id")
    sums = written(similarity.similarity_sums(sets))
    first, second = (similarity.ranked_by(sums, m).select(F.lit(m).alias("metric"), "*") for m in ("average_similarity", "maximal_similarity"))
    return first.unionByName(second)


@query(AVERAGE)
def cluster_avg_similarity(spark, sf):
    _, of_roots, pairs, equal = _labels(spark, sf)
    return _of_all(equal, similarity.average_similarity(of_roots, pairs))


@query("""select p.id, sum(case when q.x >= p.x then 1 else -1 end * (abs(q.x - p.x) * q.w * 1000 // greatest((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), 1)))::bigint as dx,
sum(case when q.y >= p.y then 1 else -1 end * (abs(q.y - p.y) * q.w * 1000 // greatest((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y), 1)))::bigint as dy
from v_point p, (select x, y, sum(w)::bigint as w from v_point group by all) q group by p.id""")
def gravity_move(spark, sf):
    return gravity.moved(v.point(spark, sf))


NEAREST = """, pairs as (select p.id as a, q.id as b, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) as d2 from v_point p join v_point q on p.id <> q.id),
nn as (select * from pairs where d2 <= 400 qualify row_number() over (partition by a order by d2, b) = 1) """


@query(NEAREST + "select n.a, n.b, n.d2 from nn n join nn m on n.a = m.b and n.b = m.a where n.a < n.b")
def gravity_grid_nn(spark, sf):
    return gravity.mutual_neighbours(v.point(spark, sf), 20)


@query()
def gravity_grid_clusters(spark, sf):
    return gravity.grid_clusters(v.point(spark, sf), 20)


@query()
def gravity_clusters(spark, sf):
    return gravity.ordered_clusters(v.point(spark, sf), 25.0, 200)


BORDERS = """, lab as (select edge_id, edge_id % 12 as leader from v_edge), x as (select c.*, a.leader as la, b.leader as lb from v_connection c join lab a on a.edge_id = from_edge join lab b on b.edge_id = to_edge where a.leader <> b.leader) """


def _zones(spark, sf):
    return v.edge(spark, sf).select("edge_id", (F.col("edge_id") % 12).alias("leader"))


@query(BORDERS + "select leader, coalesce(i, 0) as in_edges, coalesce(o, 0) as out_edges from (select lb as leader, count(distinct to_edge) as i from x group by 1) full join (select la as leader, count(distinct from_edge) as o from x group by 1) using (leader)")
def cluster_borders(spark, sf):
    return gravity.cluster_borders(v.edge(spark, sf), _zones(spark, sf))


@query(""", z as (select fj // 6 as a, tj // 6 as b from v_region), e as (select a, b from z union select b, a from z), reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
select a as node, least(a, min(b))::bigint as root from reach group by a""")
def touching_clusters(spark, sf):
    zone = lambda c: F.floor(F.col(c) / 6)
    return connected_components(v.region(spark, sf).select(zone("fj").alias("a"), zone("tj").alias("b")))


OCCUPIED = ", occ as (select edge_id, count(distinct route_id) as routes from v_route group by 1) "


@query(OCCUPIED + 'select rank, leader, edge_id, "left" from (select edge_id % 12 as leader, edge_id, routes as "left", row_number() over (partition by edge_id % 12 order by routes desc, edge_id) as rank from occ) where rank <= 3')
def border_topn(spark, sf):
    rows = scenario.occupancy(v.route(spark, sf)).join(_zones(spark, sf), "edge_id").withColumnRenamed("routes", "left")
    return gravity.best_borders(rows, 3)


@query(OCCUPIED + "select * from occ")
def occupied_edges(spark, sf):
    return scenario.occupancy(v.route(spark, sf))


ROADS = """, c as (select edge_id, length, (greatest(floor(length / 7.0), 1) * greatest(lanes, 1))::bigint as capacity from v_edge),
t as (select *, greatest(round_even(capacity * 0.35::double, 0), 1)::bigint as light, round_even(capacity * 0.4::double, 0)::bigint as medium from c),
roads as (select edge_id, capacity, light, medium, greatest(capacity - light - medium, 0) as heavy, trunc(length * 1)::bigint as cost_light, trunc(length * 10)::bigint as cost_medium, trunc(length * 100)::bigint as cost_heavy from t) """


@query(ROADS + "select edge_id, capacity, light, medium, heavy from roads")
def capacity_thresholds(spark, sf):
    return planning.roads(v.edge(spark, sf)).select("edge_id", "capacity", "light", "medium", "heavy")


@query(ROADS + "select edge_id, cost_light, cost_medium, cost_heavy from roads")
def penalized_costs(spark, sf):
    return planning.roads(v.edge(spark, sf)).select("edge_id", "cost_light", "cost_medium", "cost_heavy")


@query(", o as (select fj as junction, count(*) as n from v_edge group by 1), c as (select from_edge, to_edge from v_connection join v_edge a on a.edge_id = from_edge join v_edge b on b.edge_id = to_edge where abs(a.speed - b.speed) < 30), r as (select from_edge as edge_id, count(distinct to_edge) as k from c group by 1) select edge_id, e.tj as junction, row_number() over (partition by e.tj order by edge_id) - 1 as part from v_edge e join o on o.junction = e.tj left join r using (edge_id) where coalesce(k, 0) < n")
def split_junctions(spark, sf):
    """Junctions by the turns between roads of like speed."""
    edges = v.edge(spark, sf)
    speeds = [edges.select(F.col("edge_id").alias(f"{side}_edge"), F.col("speed").alias(f"_{side}")) for side in ("from", "to")]
    turns = graph.connections(edges).join(speeds[0], "from_edge").join(speeds[1], "to_edge").where(F.abs(F.col("_from") - F.col("_to")) < 30)
    return planning.split_junctions(edges, turns.select("from_edge", "to_edge"))


@query(ROADS + """, p as (select 'r' || edge_id as r, fj, tj, roads.* from roads join v_edge using (edge_id))
select '(connected j' || fj || ' ' || r || ' j' || tj || ')' as fact from p union all select '(= (length-light ' || r || ') ' || cost_light || ')' from p union all select '(= (length-medium ' || r || ') ' || cost_medium || ')' from p
union all select '(= (length-heavy ' || r || ') ' || cost_heavy || ')' from p union all select '(cap ' || r || ' use' || capacity || ')' from p union all select '(using ' || r || ' use0)' from p
union all select '(' || case when k <= light then 'light' when k <= light + medium then 'medium' else 'heavy' end || ' ' || r || ' use' || k || ')' from (select *, unnest(range(capacity + 1)) as k from p)""")
def planning_facts(spark, sf):
    edges = v.edge(spark, sf)
    return planning.road_facts(edges, planning.roads(edges))


@query(ROADS + "select '(next use' || k || ' use' || (k + 1) || ')' as fact from (select unnest(range(max(capacity) + 1)) as k from roads)")
def use_chain(spark, sf):
    return planning.use_chain(planning.roads(v.edge(spark, sf)))


@query(", e as (select distinct route_id, edge_id from v_route) select '(allowed v' || route_id || ' r' || edge_id || ')' as fact from e")
def allowed_facts(spark, sf):
    return planning.allowed_facts(v.route(spark, sf))


@query(LENGTHS + "select 'drive-to-light' as verb, route_id as vehicle, 'j' || fj as from_j, edge_id as road, 'j' || tj as to_j from placed")
def plan_line_parse(spark, sf):
    placed = v.route(spark, sf).join(v.edge(spark, sf).select("edge_id", "fj", "tj"), "edge_id")
    value = F.format_string("(drive-to-light v%d j%d r%d j%d use0 use1)", "route_id", "fj", "edge_id", "tj")
    return planning.parsed_plan(placed.select(value.alias("value")))


@query()
def plan_replay(spark, sf):
    block = lambda c: F.floor(F.col(c) / 6).cast("string")
    edges = v.edge(spark, sf).where(block("fj") == block("tj")).withColumn("problem", block("fj"))
    facts = planning.road_facts(edges, planning.roads(edges), ("problem",))
    paths = graph.bounded_paths(edges, F.lit(True), 3).where("n_edges = 3").withColumn("v", F.split("path", " "))
    first = paths.withColumn("e", F.get("v", F.lit(0)).cast("bigint")).join(edges.select(F.col("edge_id").alias("e"), F.col("fj").alias("first")), "e")
    cars = first.groupBy("first").agg(F.min(F.struct("milli", "path", "target")).alias("b")).select(block("first").alias("problem"), F.concat(F.lit("v"), "first").alias("car"), F.col("first"), "b.path", "b.target")
    steps = cars.select("problem", "car", F.posexplode(F.split("path", " ")).alias("step", "edge")).withColumn("edge_id", F.col("edge").cast("bigint")).join(edges.select("edge_id", "fj", "tj"), "edge_id")
    plans = steps.select("problem", "step", F.format_string("(drive-to-light %s j%d r%d j%d use0 use1)", "car", "fj", "edge_id", "tj").alias("value"))
    own = cars.select("problem", F.explode(F.array(F.format_string("(at %s j%d)", "car", "first"), F.format_string("(togo %s j%d)", "car", "target"))).alias("fact"))
    return planning.replayed(facts.unionByName(own), plans)


def _of_kind(lists, spark, sf, *kinds):
    """The routes of vehicles of some kinds."""
    return lists.join(v.vehicle(spark, sf).where(F.col("vtype").isin(*kinds)).select("route_id"), "route_id", "left_semi")


@query(LISTS + ", d as (select * from plans where route_id in (select route_id from v_vehicle where vtype = '1-URGENT')) select route_id, array_to_string(coalesce(d.edges, lists.edges), ' ') as edges, d.edges is not null as planned from lists left join d using (route_id)")
def decode_with_fallback(spark, sf):
    plan = _of_kind(sequences.as_lists(v.planned(spark, sf)), spark, sf, "1-URGENT")
    found = planning.decoded(sequences.as_lists(v.route(spark, sf)), plan)
    return found.select("route_id", F.array_join("edges", " ").alias("edges"), "planned")


@query(LISTS + f"select vehicle_id, depart, array_to_string(edges, ' ') as edges from v_vehicle join lists using (route_id) where depart >= {LOW} and depart < {HIGH}")
def scenario_split(spark, sf):
    part = planning.departing(v.vehicle(spark, sf), LOW, HIGH)
    return scenario.with_routes(part, sequences.as_lists(v.route(spark, sf))).select("vehicle_id", "depart", F.array_join("edges", " ").alias("edges"))


@query(LISTS + ", m as (select 0::bigint as scenario, vehicle_id, edges from v_vehicle join lists using (route_id) union all select 1::bigint, vehicle_id, edges from v_vehicle join plans using (route_id)) select scenario, vehicle_id, array_to_string(edges, ' ') as edges from m")
def scenario_merge(spark, sf):
    cars = v.vehicle(spark, sf)
    parts = [scenario.with_routes(cars, sequences.as_lists(r)) for r in (v.route(spark, sf), v.planned(spark, sf))]
    return scenario.merged(parts).select("scenario", "vehicle_id", F.array_join("edges", " ").alias("edges"))


@query(LISTS + ", a as (select * from plans where route_id in (select route_id from v_vehicle where vtype in ('1-URGENT', '2-HIGH'))), b as (select route_id, list_reverse(edges) as edges from lists where route_id in (select route_id from v_vehicle where vtype in ('2-HIGH', '5-LOW')) and edges <> list_reverse(edges)) select l.route_id, array_to_string(case when b.edges is not null then b.edges when a.edges is not null and a.edges <> l.edges then a.edges else l.edges end, ' ') as edges from lists l left join a using (route_id) left join b using (route_id)")
def scenario_merge_planned(spark, sf):
    original = sequences.as_lists(v.route(spark, sf))
    one = _of_kind(sequences.as_lists(v.planned(spark, sf)), spark, sf, "1-URGENT", "2-HIGH")
    two = _of_kind(original, spark, sf, "2-HIGH", "5-LOW").withColumn("edges", F.reverse("edges"))
    return scenario.merged_changes(original, [one, two]).select("route_id", F.array_join("edges", " ").alias("edges"))


@query(PAIRS + ", n as (select from_edge, to_edge, count(*) as n from pairs group by all), f as (select from_edge, count(*) as fan from n group by 1) select route_id, sum(n * fan)::bigint as score from pairs join n using (from_edge, to_edge) join f using (from_edge) group by 1")
def bottleneck_rank(spark, sf):
    return scenario.bottlenecks(v.route(spark, sf))


PRICE = ", p as (select p_partkey as id, p_size::bigint as a, (round_even(p_retailprice * 100, 0)::bigint * 7919) % 100003 as b, p_brand as g from part) "


def _priced(spark, sf):
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("a"), (F.bround(F.col("p_retailprice") * 100).cast("bigint") * 7919 % 100003).alias("b"), F.col("p_brand").alias("g"))


@query(PRICE + "select id, a, b from p where not exists (select 1 from p q where q.a <= p.a and q.b <= p.b and (q.a < p.a or q.b < p.b))")
def pareto_front(spark, sf):
    return selection.pareto_front(_priced(spark, sf).drop("g"), "a", "b").select("id", "a", "b")


@query(PRICE + """select id, g, (case when ra = 0 then 0 else coalesce(floor((na - pa) * 1000000.0 / ra), 1000000) end + case when rb = 0 then 0 else coalesce(floor((nb - pb) * 1000000.0 / rb), 1000000) end)::bigint as crowding from (
select id, g, max(a) over w - min(a) over w as ra, max(b) over w - min(b) over w as rb, lead(a) over x as na, lag(a) over x as pa, lead(b) over y as nb, lag(b) over y as pb from p
window w as (partition by g), x as (partition by g order by a, id), y as (partition by g order by b, id))""")
def crowding_distance(spark, sf):
    return selection.crowding(_priced(spark, sf), "g", ["a", "b"]).select("id", "g", F.col("crowding").cast("bigint").alias("crowding"))


@query(", m as (select etype, lanes, count(*) as n from v_edge group by all) select x.etype as destination, 'lanes' || x.l as origin, coalesce(n, 0)::bigint as weight from (select distinct e.etype, l.l from v_edge e, (select unnest([1, 2, 3]) as l) l) x left join m on m.etype = x.etype and m.lanes = x.l")
def weighted_matrix_unpivot(spark, sf):
    matrix = v.edge(spark, sf).groupBy("etype").pivot("lanes", [1, 2, 3]).agg(F.count(F.lit(1))).fillna(0)
    return selection.unpivoted(matrix.toDF("etype", "lanes1", "lanes2", "lanes3"), "etype").select("destination", "origin", "weight")


def _flows(spark, sf, **columns):
    """A flow for each edge."""
    return v.edge(spark, sf).select(F.col("edge_id").alias("flow_id"), *[F.lit(c).cast("bigint").alias(n) if isinstance(c, int) else c.cast("bigint").alias(n) for n, c in columns.items()])


@query("select edge_id as flow_id, k as vehicle, (floor(k * 360000.0 / greatest(n - 1, 1)) + 2520000)::bigint as depart from (select edge_id, 10 * lanes as n, unnest(range(10 * lanes)) as k from v_edge)")
def uniform_flow(spark, sf):
    """Ten vehicles a lane of each edge, evenly over an hour."""
    return flows.uniform_flows(_flows(spark, sf, start=25200, end=28800, amount=10 * F.col("lanes")))


@query("select route_id as flow_id, unnest(range(count(*) % 4)) as vehicle, any_value(depart) * 100 as depart from v_route join v_vehicle using (route_id) group by 1")
def fixed_flow(spark, sf):
    """Vehicles on each route at one time, as many as its length says; some have none."""
    amounts = v.route(spark, sf).groupBy("route_id").agg((F.count(F.lit(1)) % 4).alias("amount")).join(v.vehicle(spark, sf), "route_id")
    return flows.fixed_flows(amounts.select(F.col("route_id").alias("flow_id"), (F.col("depart") * 100).alias("depart"), "amount"))


def drawn(seed: str, *keys: str) -> str:
    """``records.draw`` in SQL."""
    value = seed
    for factor, key in zip((48271, 69621, 16807), keys, strict=False):
        value = f"(({value}) * {factor} + ({key}) * 7919 + 12345) % 2147483647"
    return f"(({value}) * 48271) % 2147483647"


def flow_sql(levels: str, start: int, period: int, seed: int, more: str = "") -> str:
    """Vehicles of ``levels`` (f, p, low, high): so many of each period, at drawn times in it."""
    n, second = drawn(str(seed), "f", "p"), drawn(str(seed + 1), "f", "p", "k")
    return f"select f as flow_id, {more} p || '-' || k as vehicle, (({start} + p * {period}) * 100 + {second} % {period * 100})::bigint as depart from (select *, unnest(range(low + {n} % (high - low + 1))) as k from ({levels}))"


@query(flow_sql("select edge_id as f, p, lanes as low, lanes * 5 as high from v_edge, range(4) t(p)", 25200, 1800, 11))
def random_flow(spark, sf):
    """One to five vehicles a lane of each edge in each half of an hour, at drawn times."""
    lanes = F.col("lanes")
    return flows.random_flows(_flows(spark, sf, start=25200, end=32400, period=1800, low=lanes, high=lanes * 5), 11)


@query('select floor(x / 20.0)::bigint as cell, count(*) as n, coalesce(sum(count(*)) over (order by floor(x / 20.0) rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from v_point group by 1, floor(x / 20.0)')
def prefix_scan_bins(spark, sf):
    return selection.bin_offsets(v.point(spark, sf), 20)


def _objects(spark, sf):
    tags = F.create_map(F.lit("highway"), "event_type", F.lit("lanes"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"))
    return v.table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", tags.alias("tags"))


TAGS = ", o as (select event_id as id, user_id, event_type as highway, json_extract_string(props, '$.k') as lanes from events) "


@query(TAGS + "select id from o where (highway like 'c%' and lanes::bigint > 3) or (highway <> 'view' and user_id::varchar like '%7')")
def tag_filter(spark, sf):
    return _objects(spark, sf).where(selection.tag_condition("( highway=c* and lanes>3 ) or highway!=view and user=*7")).select("id")


@query(TAGS + "select 'highway' as key, highway as value, count(*) as n from o group by all union all select 'lanes', lanes, count(*) from o group by all union all select 'user', user_id::varchar, count(*) from o group by all")
def tag_count(spark, sf):
    return selection.tag_counts(_objects(spark, sf))


@query("select edge_id as id, fj from v_edge where edge_id in (select edge_id from v_route where route_id in (select route_id from v_route group by 1 having count(*) >= 6))")
def dependency_closure(spark, sf):
    ways = sequences.as_lists(v.route(spark, sf)).where("size(edges) >= 6").withColumnRenamed("edges", "refs")
    return selection.needed_nodes(ways, v.edge(spark, sf).select(F.col("edge_id").alias("id"), "fj"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def props_json(spark, sf):
    return v.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(""", p as (select r.route_id, r.pos, floor(e.length / e.speed * 1000)::bigint as ms, e.speed <= 26 as inside from v_route r join v_edge e using (edge_id)),
b as (select *, coalesce(sum(ms) over (partition by route_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as before from p),
f as (select route_id, arg_min(before, pos) as eta from b where inside group by 1)
select vehicle_id, eta, case when eta < 10000 then 'missed' when eta < 20000 then 'scheduled' else 'waiting' end as state from v_vehicle join f using (route_id)""")
def eta_classification(spark, sf):
    return scenario.eta(v.vehicle(spark, sf), v.route(spark, sf), v.edge(spark, sf), v.region(spark, sf))


@query("select edge_id, count(*) as n, floor(list_reduce(list(traveltime order by begin, event_id), lambda t, x: t * 0.5 + x * 0.5) * 1000)::bigint as smooth_milli from v_dump group by 1")
def ema_travel_time(spark, sf):
    return congestion.smoothed(v.dump(spark, sf))


@query("select (floor(epoch(ts))::bigint // 900 * 900)::bigint as begin, user_id as edge_id, count(*) as n, sum(trunc(value * 1000)::bigint)::bigint as milli from events group by all")
def stream_congestion(spark, sf):
    stream = online.congestion_windows(online.event_stream(spark, f"{sf}/event[s].parquet"), None)
    last = online.drained(stream, "update").groupBy("begin", "edge_id").agg(F.max_by(F.struct("n", "milli"), "batch").alias("v"))
    return last.select("begin", "edge_id", "v.n", "v.milli")


@query()
def stream_vehicle_state(spark, sf):
    return online.drained(online.vehicle_states(online.event_stream(spark, f"{sf}/event[s].parquet")), "append").drop("batch")


@query("select user_id as edge_id, count(*) as n, floor(list_reduce(list(value order by ts, event_id), lambda t, x: (t + x) / 2) * 1000)::bigint as smooth_milli from events group by 1")
def stream_smoothed(spark, sf):
    rows = online.drained(online.smoothed_times(online.event_stream(spark, f"{sf}/event[s].parquet")), "update")
    last = rows.groupBy("edge_id").agg(F.max_by(F.struct("n", "smooth"), "batch").alias("v"))
    return last.select("edge_id", "v.n", F.floor(F.col("v.smooth") * 1000).alias("smooth_milli"))


@query(", p as (select fj as junction, string_agg(tj || ':' || edge_id, ' ' order by tj, edge_id) as targets from v_edge group by 1) select * from p")
def adjacency_map(spark, sf):
    return graph.adjacency(v.edge(spark, sf))


@query("""select edge_id, (select count(distinct from_edge) from v_connection c where c.to_edge = e.edge_id) as n_in, (select count(distinct to_edge) from v_connection c where c.from_edge = e.edge_id) as n_out from v_edge e""")
def edge_neighbours(spark, sf):
    edges = v.edge(spark, sf)
    con = graph.connections(edges)
    into = con.groupBy(F.col("to_edge").alias("edge_id")).agg(F.count_distinct("from_edge").alias("n_in"))
    out = con.groupBy(F.col("from_edge").alias("edge_id")).agg(F.count_distinct("to_edge").alias("n_out"))
    return edges.select("edge_id").join(into, "edge_id", "left").join(out, "edge_id", "left").fillna(0, ["n_in", "n_out"])


@query(""", walks as (select route_id as walk, pos, fj as junction from v_route r join v_edge e using (edge_id)),
s as (select walk, pos, junction, lead(junction) over (partition by walk order by pos) as nxt from walks), least_ as (select fj, tj, min(edge_id) as e from v_edge group by all),
p as (select s.*, e, max((e is null)::int) over (partition by walk order by pos) as broken from s left join least_ on junction = fj and nxt = tj where nxt is not null)
select walk, coalesce(string_agg(e::varchar, ' ' order by pos) filter (where broken = 0), '') as path, max(broken) = 0 as complete from p group by walk""")
def path_from_junctions(spark, sf):
    edges = v.edge(spark, sf)
    walks = v.route(spark, sf).join(edges.select("edge_id", "fj"), "edge_id").select(F.col("route_id").alias("walk"), "pos", F.col("fj").alias("junction"))
    return graph.edges_of_walk(walks, edges)


RING = """, ring3 as (select a.edge_id || ' ' || b.edge_id || ' ' || c.edge_id as ring, a.edge_id as x, b.edge_id as y, c.edge_id as z from v_edge a join v_edge b on a.tj = b.fj join v_edge c on b.tj = c.fj and c.tj = a.fj
where a.fj < b.fj and a.fj < c.fj and b.fj <> c.fj) """


@query(RING + "select ring from ring3")
def rings(spark, sf):
    return graph.rings(v.edge(spark, sf), 3)


@query(RING + """, rows as (select ring as name, unnest([x, y, z]) as edge_id from ring3 union all select 'broken ' || ring, unnest([x, y]) from ring3)
select name, count(distinct fj) = count(*) and count(distinct tj) = count(*) and list_sort(list(fj)) = list_sort(list(tj)) as valid from rows join v_edge using (edge_id) group by 1""")
def ring_validity(spark, sf):
    edges = v.edge(spark, sf)
    found = written(graph.rings(edges, 3))
    rows = lambda part, name: found.select(name.alias("name"), F.explode(part).alias("e")).select("name", F.col("e").cast("bigint").alias("edge_id"))
    parts = F.split("ring", " ")
    return graph.valid_ring(rows(parts, F.col("ring")).unionByName(rows(F.slice(parts, 1, 2), F.concat(F.lit("broken "), "ring"))), edges)


@query(RUNS + """, cut as (select route_id, arg_min(edge_id, pos) as first_edge, arg_max(edge_id, pos) as last_edge from v_route join runs using (route_id) where pos >= "left" and pos < "right" and "right" - "left" >= 3 group by 1)
select first_edge, last_edge, count(*) as routes from cut group by all""")
def entry_keys(spark, sf):
    return scenario.entry_keys(v.route(spark, sf), v.region(spark, sf))


ETA = """, p as (select r.route_id, r.pos, floor(e.length / e.speed * 1000)::bigint as ms, e.speed <= 26 as inside from v_route r join v_edge e using (edge_id)),
b as (select *, coalesce(sum(ms) over (partition by route_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as before from p),
f as (select route_id, arg_min(before, pos) as eta from b where inside group by 1) """


@query(ETA + """, x as (select vehicle_id, eta, eta + (vehicle_id * 7919) % 50001 - 25000 as arrived from v_vehicle join f using (route_id))
select count(*) as vehicles, (count(*) filter (where abs(arrived - eta) < 10000))::bigint as below_10, (count(*) filter (where abs(arrived - eta) >= 10000 and abs(arrived - eta) < 20000))::bigint as below_20,
(count(*) filter (where abs(arrived - eta) >= 20000))::bigint as above, (count(*) filter (where arrived > eta))::bigint as late, (count(*) filter (where arrived < eta))::bigint as early from x""")
def eta_errors(spark, sf):
    found = scenario.eta(v.vehicle(spark, sf), v.route(spark, sf), v.edge(spark, sf), v.region(spark, sf))
    return scenario.eta_errors(found.withColumn("arrived", F.col("eta") + F.col("vehicle_id") * 7919 % 50001 - 25000))


@query(PAIRS + """, e as (select edge_id, tj, floor(speed / 15)::bigint as class from v_edge)
select route_id, sum(greatest(10 - 3 * abs(a.class - b.class) - case when a.tj % 5 = 0 then 2 else 0 end, 1))::bigint as penalty from pairs p join e a on a.edge_id = p.from_edge join e b on b.edge_id = p.to_edge group by 1""")
def turn_penalties(spark, sf):
    edges = v.edge(spark, sf).select("edge_id", "tj", F.floor(F.col("speed") / 15).alias("class"))
    lights = edges.where("tj % 5 = 0").select(F.col("tj").alias("junction")).distinct()
    return scenario.turn_penalties(v.route(spark, sf), edges, lights)


@query('select vtype, arg_min(vehicle_id, depart * 1000000 + vehicle_id) as "first", arg_max(vehicle_id, depart * 1000000 + vehicle_id) as "last" from v_vehicle group by 1')
def first_and_last_departs(spark, sf):
    at = F.struct("depart", "vehicle_id")
    return v.vehicle(spark, sf).groupBy("vtype").agg(F.min(at).alias("a"), F.max(at).alias("b")).select("vtype", F.col("a.vehicle_id").alias("first"), F.col("b.vehicle_id").alias("last"))


@query(LENGTHS + "select route_id, arg_min(fj, pos) as start, arg_max(tj, pos) as destination, arg_min(edge_id, pos) as first_edge, arg_max(edge_id, pos) as last_edge, (max(pos) + 1)::bigint as n_edges from placed group by 1")
def route_endpoints(spark, sf):
    placed = v.route(spark, sf).join(v.edge(spark, sf).select("edge_id", "fj", "tj"), "edge_id")
    low, high = lambda c: F.min_by(c, "pos"), lambda c: F.max_by(c, "pos")
    return placed.groupBy("route_id").agg(low("fj").alias("start"), high("tj").alias("destination"), low("edge_id").alias("first_edge"), high("edge_id").alias("last_edge"), (F.max("pos") + 1).alias("n_edges"))


@query(", asked as (select edge_id as pos, edge_id * 3 as edge_id from v_edge) select pos, a.edge_id, coalesce(e.fj, -1) as fj, coalesce(e.tj, -1) as tj from asked a left join v_edge e using (edge_id)")
def ordered_lookup(spark, sf):
    asked = v.edge(spark, sf).select(F.col("edge_id").alias("pos"), (F.col("edge_id") * 3).alias("edge_id"))
    return asked.join(v.edge(spark, sf).select("edge_id", "fj", "tj"), "edge_id", "left").select("pos", "edge_id", "fj", "tj").fillna(-1)


LEVEL = f"select *, {list(selection.LEVELS)}[level + 1] as phase, {[a for a, _ in selection.LEVELS.values()]}[level + 1] as low, {[b for _, b in selection.LEVELS.values()]}[level + 1] as high from (select edge_id as f, p, p * 3 // 6 + ({drawn('20', 'edge_id', 'p')} % 10 = 0)::int as level from v_edge, range(6) t(p))"


@query(flow_sql(LEVEL, 0, 1800, 21, "phase,"))
def exponential_flow(spark, sf):
    """Traffic of each edge that grows over three hours."""
    return flows.exponential_flows(_flows(spark, sf, start=0, end=10800, period=1800), 20)


@query(""", keys as (select edge_id as first_edge, edge_id + 9 as last_edge from v_edge),
ways(first_edge, last_edge, at_, milli, path, seen, n) as (select first_edge, last_edge, first_edge, floor(length * 1000)::bigint, first_edge::varchar, ',' || first_edge || ',', 0 from keys join v_edge on edge_id = first_edge
union all select w.first_edge, w.last_edge, c.to_edge, milli + floor(e.length * 1000)::bigint, path || ' ' || c.to_edge, seen || c.to_edge || ',', n + 1 from ways w join v_connection c on c.from_edge = w.at_ join v_edge e on e.edge_id = c.to_edge
where n < 4 and w.at_ <> w.last_edge and not contains(seen, ',' || c.to_edge || ',')),
r as (select *, min(milli) over (partition by first_edge, last_edge) as low, row_number() over (partition by first_edge, last_edge order by milli, path) as rank from ways where at_ = last_edge)
select first_edge, last_edge, rank, milli, path from r where rank <= 4 and milli <= low * 1.5""")
def alternative_routes(spark, sf):
    edges = v.edge(spark, sf)
    keys = edges.select(F.col("edge_id").alias("first_edge"), (F.col("edge_id") + 9).alias("last_edge"))
    return graph.alternative_routes(keys, edges, graph.connections(edges), 4, 4, 1.5)


def top_congested(spark: SparkSession, sf: str, n: int = 20) -> DataFrame:
    """The flagship query: the edges of highest mean congestion."""
    return ci_mean_all_intervals(spark, sf).orderBy(F.desc("ci"), "edge_id").limit(n)


from roadlake.plans import network_queries, table_queries  # noqa: E402, F401
