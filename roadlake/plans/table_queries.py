"""Queries over files, records, signals, flows, tags and region visits, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions import formulas as fm
from roadlake.functions.storage import new_folder, written
from roadlake.operators import congestion, flows, graph, records, scenario, selection, sequences
from roadlake.plans import views as v
from roadlake.plans.queries import CELLS, ETA, HALF, LISTS, LOW, RUNS, drawn, query
from roadlake.sources import changes, network, sinks
from roadlake.streaming import online, queue

#: Positions of routes that one task sorts or sums up, about.
TASK_ROWS = 1_000_000


def _saved_network(spark, sf):
    edges, path = v.edge(spark, sf), new_folder(spark)
    places = graph.junctions(edges).select("junction", F.when(F.col("junction") % 2 == 0, "priority").otherwise("traffic_light").alias("kind"), (F.col("junction") * 37 % 101).alias("x"), (F.col("junction") * 53 % 97).alias("y"))
    sinks.write_network(edges, graph.connections(edges), places, path)
    return path


@query("select edge_id::varchar as edge_id, fj::varchar as fj, tj::varchar as tj, floor(length * 1000)::bigint as milli, lanes::bigint as lanes, etype from v_edge")
def network_file_edges(spark, sf):
    found = network.edges(spark, f"{_saved_network(spark, sf)}/edges")
    return found.select("edge_id", "fj", "tj", F.floor(F.col("length") * 1000).alias("milli"), "lanes", "etype")


@query("select from_edge::varchar as from_edge, to_edge::varchar as to_edge from v_connection")
def network_file_connections(spark, sf):
    return network.connections(spark, f"{_saved_network(spark, sf)}/connections")


@query(", j as (select fj as j from v_edge union select tj from v_edge) select j::varchar as junction, (j * 37 % 101)::bigint as x, (j * 53 % 97)::bigint as y, j % 2 = 1 as light from j")
def network_file_junctions(spark, sf):
    found = network.junctions(spark, f"{_saved_network(spark, sf)}/junctions")
    return found.select("junction", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), (F.col("kind") == "traffic_light").alias("light"))


@query(", k as (select distinct edge_id from v_route where mark = 3) select e.edge_id::varchar as edge_id, lanes::bigint as lanes from v_edge e semi join k using (edge_id)")
def elements_of_ids(spark, sf):
    ids = v.route(spark, sf).where("mark = 3").select(F.col("edge_id").cast("string").alias("id"))
    return network.of_ids(network.edges(spark, f"{_saved_network(spark, sf)}/edges"), "edge_id", ids).select("edge_id", "lanes")


@query(LISTS + "select 'route' as kind, route_id::varchar as id, len(edges)::bigint as n, 0::bigint as depart from lists union all select 'vehicle', vehicle_id::varchar, 0, depart from v_vehicle semi join lists using (route_id) union all select 'configuration', 'net.net.xml', 2, min(depart) from v_vehicle")
def scenario_files(spark, sf):
    path, lists, cars = new_folder(spark), sequences.as_lists(v.route(spark, sf)), v.vehicle(spark, sf)
    setup = cars.agg(F.min("depart").alias("begin"), F.max("depart").alias("end")).select(F.lit("net.net.xml").alias("network"), F.lit("a.rou.xml, b.add.xml").alias("additional"), "begin", "end")
    sinks.write_scenario(cars.join(lists.select("route_id"), "route_id", "left_semi"), lists, setup, path)
    routes = network.routes(spark, f"{path}/routes").select(F.lit("route").alias("kind"), F.col("route_id").alias("id"), F.size("edges").cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("depart"))
    vehicles = network.vehicles(spark, f"{path}/vehicles").select(F.lit("vehicle").alias("kind"), F.col("vehicle_id").alias("id"), F.lit(0).cast("bigint").alias("n"), F.col("depart").cast("bigint").alias("depart"))
    config = network.configurations(spark, f"{path}/configuration").select(F.lit("configuration").alias("kind"), F.col("network").alias("id"), F.size("additional").cast("bigint").alias("n"), F.col("begin").cast("bigint").alias("depart"))
    return routes.unionByName(vehicles).unionByName(config)


@query("select vtype || '.net.xml' as network, vtype || '.rou.xml' as routes, min(depart)::double as begin, max(depart)::double as \"end\", 1.0::double as step from v_vehicle group by vtype")
def configuration_files(spark, sf):
    path = new_folder(spark)
    kinds = v.vehicle(spark, sf).groupBy("vtype").agg(F.min("depart").alias("begin"), F.max("depart").alias("end"))
    sinks.write_configuration(kinds.select(F.concat("vtype", F.lit(".net.xml")).alias("network"), F.concat(F.lit("x.add.xml,"), "vtype", F.lit(".rou.xml")).alias("additional"), "begin", "end"), path)
    return network.configurations(spark, path).select("network", "routes", "begin", "end", "step")


EPISODES = ", e as (select (depart - s) // 604800 as episode, count(*) as vehicles, count(*) filter (where vtype < '3')::bigint as planned, count(distinct vtype) as kinds from v_vehicle, (select min(depart) as s from v_vehicle) group by 1) "


def _episodes(spark, sf):
    cars = v.vehicle(spark, sf)
    start = cars.agg(F.min("depart").alias("s"))
    placed = cars.crossJoin(F.broadcast(start)).withColumn("episode", F.floor((F.col("depart") - F.col("s")) / 604800))
    return placed.groupBy("episode").agg(F.count(F.lit(1)).alias("vehicles"), F.sum((F.col("vtype") < "3").cast("bigint")).alias("planned"), F.count_distinct("vtype").alias("kinds"))


@query(EPISODES + "select 'e' || episode as id, vehicles, planned, kinds from e")
def episode_documents(spark, sf):
    path = new_folder(spark)
    nested = _episodes(spark, sf).select(F.concat(F.lit("e"), F.col("episode").cast("string")).alias("id"), F.struct("vehicles", "planned").alias("vehicle_info"), F.struct("kinds").alias("problem_info"))
    sinks.write_documents(nested, path)
    found = network.documents(spark, path, "id string, vehicle_info struct<vehicles:bigint,planned:bigint>, problem_info struct<kinds:bigint>")
    return found.select("id", "vehicle_info.vehicles", "vehicle_info.planned", "problem_info.kinds")


@query(EPISODES + "select count(*) as episodes, sum(vehicles)::bigint as vehicles, sum(planned)::bigint as planned, (count(*) filter (where planned > 0))::bigint as with_plans, floor(sum(vehicles) * 100.0 / count(*))::bigint as mean_vehicles, floor(sum(planned) * 100.0 / count(*))::bigint as mean_planned from e")
def episode_report(spark, sf):
    n, mean = F.count(F.lit(1)), lambda c: F.floor(F.sum(c) * 100 / F.count(F.lit(1)))
    return _episodes(spark, sf).agg(n.alias("episodes"), F.sum("vehicles").alias("vehicles"), F.sum("planned").alias("planned"), F.coalesce(F.sum((F.col("planned") > 0).cast("bigint")), F.lit(0)).alias("with_plans"), mean("vehicles").alias("mean_vehicles"), mean("planned").alias("mean_planned"))


@query("select p_partkey as id, p_size::varchar as size, p_brand as brand from part")
def argument_pairs(spark, sf):
    text = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.format_string('size="%d" brand="%s"', "p_size", "p_brand").alias("t"))
    return text.withColumn("m", network.argument_map(F.col("t"))).select("id", F.col("m")["size"].alias("size"), F.col("m")["brand"].alias("brand"))


@query("select event_type as name, count(*) as n, min('u' || user_id || ' k') as first_arguments from events group by 1")
def command_log(spark, sf):
    path = new_folder(spark)
    sinks.write_lines(v.table(spark, sf, "events").select(F.format_string("%s u%d k", "event_type", "user_id").alias("value")), path)
    return network.commands(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("arguments").alias("first_arguments"))


@query(", log as (select edge_id as name, edge_id // 2 as source from v_edge where edge_id > 0), a(name, step, source) as (select name, 1::bigint, source from log union all select a.name, step + 1, l.source from a join log l on l.name = a.source) select * from a")
def graph_provenance(spark, sf):
    return records.ancestors(v.edge(spark, sf).where("edge_id > 0").select(F.col("edge_id").alias("name"), F.floor(F.col("edge_id") / 2).alias("source")))


@query(", lines as (select vtype as file, row_number() over (partition by vtype order by vehicle_id) as line, depart % 7 as vehicle, vehicle_id as value from v_vehicle), b as (select *, lag(vehicle) over (partition by file order by line) as p from lines), s as (select file, vehicle, line, row_number() over (partition by file, vehicle order by line) as k from b where p is distinct from vehicle), again as (select file, vehicle, line as again from s where k = 2) select file, line, vehicle, value from lines left join again using (file, vehicle) where again is null or line < again")
def first_plan_runs(spark, sf):
    placed = sequences.placed(v.vehicle(spark, sf), "vtype", ["vehicle_id"])
    lines = written(placed.select(F.col("vtype").alias("file"), (F.col("place") + 1).alias("line"), (F.col("depart") % 7).alias("vehicle"), F.col("vehicle_id").alias("value")))
    return records.first_runs(lines)


@query("select vehicle_id, vtype from v_vehicle where vtype < '4'")
def append_vehicles(spark, sf):
    """A batch that is valid is appended as a whole, one with a bad row not at all."""
    cars = v.vehicle(spark, sf)
    good = records.appended(cars.where("vtype < '3'"), cars.where("vtype like '3%'"))
    bad = cars.where("vtype like '5%'").withColumn("route_id", F.when(F.col("vehicle_id") % 100 > 0, F.col("route_id")))
    return records.appended(good, bad).select("vehicle_id", "vtype")


@query(", s as (select vtype as section, row_number() over (partition by vtype order by vehicle_id) as k, vehicle_id::varchar as line from v_vehicle) select * from s where section <> '5-LOW' union all select '5-LOW', edge_id, etype from v_edge")
def report_sections(spark, sf):
    placed = sequences.placed(v.vehicle(spark, sf), "vtype", ["vehicle_id"])
    lines = placed.select(F.col("vtype").alias("section"), (F.col("place") + 1).alias("k"), F.col("vehicle_id").cast("string").alias("line"))
    return records.replaced_section(lines, "5-LOW", v.edge(spark, sf).select(F.col("edge_id").alias("k"), F.col("etype").alias("line")))


@query("select vehicle_id, case when depart - 800000000 < 0 then '' else printf('%.2f', round_even((depart - 800000000)::double / 8, 2)) end as depart from v_vehicle")
def depart_texts(spark, sf):
    at = F.col("depart") - 800000000
    return v.vehicle(spark, sf).select("vehicle_id", F.when(at < 0, "").otherwise(F.format_string("%.2f", F.bround(at.cast("double") / 8, 2))).alias("depart"))


@query(RUNS + LISTS + """, g as (select route_id, list(edge_id order by pos) as cut from v_planned join runs using (route_id) where pos >= "left" and pos < "right" and "right" - "left" >= 3 group by 1)
select route_id, g.cut is not null as planned, coalesce(l.edges["left" + 1:"right"] = g.cut, true) as consistent from lists l join runs using (route_id) left join g using (route_id)""")
def vehicle_slices(spark, sf):
    """Whether a vehicle has a part of a graph route, and whether that is the slice of its own route."""
    runs = sequences.longest_run(v.route(spark, sf), v.region(spark, sf))
    cut = v.planned(spark, sf).join(runs, "route_id").where("pos >= left and pos < right and right - left >= 3").select("route_id", "pos", "edge_id")
    joined = sequences.as_lists(v.route(spark, sf)).join(runs, "route_id").join(sequences.as_lists(cut).withColumnRenamed("edges", "cut"), "route_id", "left")
    own = F.slice("edges", (F.col("left") + 1).cast("int"), (F.col("right") - F.col("left")).cast("int"))
    return joined.select("route_id", F.col("cut").isNotNull().alias("planned"), F.coalesce(own == F.col("cut"), F.lit(True)).alias("consistent"))


@query(", n as (select vehicle_id, 'v' || (row_number() over (partition by vtype order by vehicle_id) - 1) || vtype as name from v_vehicle), asked as (select vehicle_id::varchar as key from v_vehicle union all select name from n union all select 'nobody') select key, coalesce(a.vehicle_id, b.vehicle_id, -1) as vehicle_id from asked left join n a on a.vehicle_id::varchar = key left join n b on b.name = key")
def vehicle_lookup(spark, sf):
    """Vehicles by their own id or by the name that a planning problem gave them."""
    placed = sequences.placed(v.vehicle(spark, sf).select("vtype", "vehicle_id"), "vtype", ["vehicle_id"])
    named = written(placed.select("vehicle_id", F.concat(F.lit("v"), F.col("place").cast("string"), "vtype").alias("name")))
    asked = named.select(F.col("vehicle_id").cast("string").alias("key")).unionByName(named.select(F.col("name").alias("key"))).unionByName(spark.range(1).select(F.lit("nobody").alias("key")))
    by_id, by_name = named.select(F.col("vehicle_id").cast("string").alias("key"), F.col("vehicle_id").alias("a")), named.select(F.col("name").alias("key"), F.col("vehicle_id").alias("b"))
    return asked.join(by_id, "key", "left").join(by_name, "key", "left").select("key", F.coalesce("a", "b", F.lit(-1)).alias("vehicle_id"))


@query(", j as (select fj as j from v_edge union select tj from v_edge), r as (select route_id, count(*) as n from v_route group by 1) select 'junction' as kind, e.edge_id as asked, coalesce(j.j, -1) as found from v_edge e left join j on j.j = e.edge_id union all select 'route', v.vehicle_id, coalesce(r.n, -1) from v_vehicle v left join r on r.route_id = v.vehicle_id")
def bulk_lookups(spark, sf):
    edges, route = v.edge(spark, sf), v.route(spark, sf).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    places = graph.junctions(edges)
    one = edges.join(places, edges["edge_id"] == places["junction"], "left").select(F.lit("junction").alias("kind"), F.col("edge_id").alias("asked"), F.coalesce("junction", F.lit(-1)).alias("found"))
    two = v.vehicle(spark, sf).select("vehicle_id").join(route, F.col("vehicle_id") == F.col("route_id"), "left").select(F.lit("route").alias("kind"), F.col("vehicle_id").alias("asked"), F.coalesce("n", F.lit(-1)).alias("found"))
    return one.unionByName(two)


@query(CELLS + "select count(*) as n, min(ci) >= 0 and max(ci) <= 1 as in_range, count(distinct edge_id) = (select count(distinct edge_id) from v_dump) as complete from ci")
def index_range_check(spark, sf):
    edges = v.dump(spark, sf).agg(F.count_distinct("edge_id").alias("all"))
    found = congestion.per_interval(v.dump(spark, sf)).agg(F.count(F.lit(1)).alias("n"), ((F.min("ci") >= 0) & (F.max("ci") <= 1)).alias("in_range"), F.count_distinct("edge_id").alias("own"))
    return found.crossJoin(edges).select("n", "in_range", (F.col("own") == F.col("all")).alias("complete"))


@query(CELLS + """select e.edge_id, round_even(coalesce(s.s, 0) / 1000 / n.n, 3)::double as ci from v_edge e
left join (select edge_id, sum((ci * 1000)::decimal(18,0))::double as s from ci group by 1) s using (edge_id), (select greatest(count(distinct begin), 1) as n from ci) n""")
def ci_mean_plain(spark, sf):
    return congestion.mean_over_all(congestion.per_interval(v.dump(spark, sf)), v.edge(spark, sf), 1.0, 0.0)


@query(", t as (select edge_id, sum(trunc(traveltime * 1000)::bigint)::bigint // count(*) as ms from v_dump group by 1) select route_id, sum(coalesce(ms, 0))::bigint as observed from v_route left join t using (edge_id) group by 1")
def route_observed_time(spark, sf):
    times = v.dump(spark, sf).groupBy("edge_id").agg(F.expr("sum(cast(traveltime * 1000 as bigint)) div count(1)").alias("ms"))
    route = v.route(spark, sf).select("route_id", "edge_id")
    # dealt to tasks of so many rows each, whatever the size of the table; a partial sum by edge would hold nearly all routes
    tasks = max(1, -(-v.table(spark, sf, "lineitem").count() // TASK_ROWS))
    timed = route.repartition(tasks, "edge_id").join(times.repartition(tasks, "edge_id"), "edge_id", "left")
    return timed.repartition(tasks, "route_id").groupBy("route_id").agg(F.sum(F.coalesce("ms", F.lit(0))).alias("observed"))


STARTS = ", c as (select vec_id as id, (label + 1)::bigint as w, floor(list_sum(list_transform(range(1, len(embedding), 2), lambda k: floor(embedding[k]::double * 1000)::bigint))::double / (len(embedding) // 2) / 20)::bigint as x, floor(list_sum(list_transform(range(2, len(embedding) + 1, 2), lambda k: floor(embedding[k]::double * 1000)::bigint))::double / (len(embedding) // 2) / 20)::bigint as y from embeddings) "


@query(STARTS + "select id, id as cluster, w, (x * 10 + row_number() over (partition by x, y order by id) - 1)::bigint as x_tenths, y from c")
def gravity_start(spark, sf):
    """Weights, centres of mass of the shape points with coincident ones apart, and clusters of one."""
    points = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).cast("bigint").alias("w"), F.posexplode("embedding").alias("k", "e"))
    mean = lambda odd: F.floor(F.sum(F.when(F.col("k") % 2 == odd, F.floor(F.col("e").cast("double") * 1000))) / F.sum((F.col("k") % 2 == 1).cast("bigint")) / 20)
    centres = points.groupBy("id", "w").agg(mean(0).alias("x"), mean(1).alias("y"))
    return records.shifted(centres).select("id", F.col("id").alias("cluster"), "w", F.bround(F.col("x") * 10).cast("bigint").alias("x_tenths"), "y")


@query(", p as (select edge_id, fj * 37 % 101 - tj * 37 % 101 as dx, fj * 53 % 97 - tj * 53 % 97 as dy from v_edge) select edge_id, round_even(sqrt((dx * dx + dy * dy)::double), 3)::double as d from p")
def edge_distances(spark, sf):
    at = lambda a, m: F.col("fj") * a % m - F.col("tj") * a % m
    return v.edge(spark, sf).select("edge_id", fm.distance(at(37, 101).cast("double"), at(53, 97).cast("double")).alias("d"))


@query(", c as (select edge_id, (greatest(floor(length / 7.0), 1) * greatest(lanes, 1))::bigint as n from v_edge) select edge_id, floor(n * 0.35)::bigint as light, floor(n * 0.4)::bigint as medium, n - floor(n * 0.35)::bigint - floor(n * 0.4)::bigint as heavy from c")
def thresholds_truncated(spark, sf):
    n = fm.route_capacity(F.col("length"), F.col("lanes"))
    part = lambda share: F.floor(F.col("n") * F.expr(f"{share}BD")).cast("bigint")
    return v.edge(spark, sf).select("edge_id", n.alias("n")).select("edge_id", part(0.35).alias("light"), part(0.4).alias("medium"), (F.col("n") - part(0.35) - part(0.4)).alias("heavy"))


@query(f"select (round_even((least(max(depart), 900000000) - greatest(min(depart), {LOW}))::double / 86400, 0) + 1)::bigint as episodes from v_vehicle")
def episode_count(spark, sf):
    span = F.least(F.max("depart"), F.lit(900000000)) - F.greatest(F.min("depart"), F.lit(LOW))
    return v.vehicle(spark, sf).agg((F.bround(span.cast("double") / 86400) + 1).cast("bigint").alias("episodes"))


@query("select edge_id, case when speed < lanes * 10 then 1000000 else floor(exp((lanes * 10 - speed) / 8.0) * 1000000)::bigint end as chance, array_to_string(list_transform([speed, length / 20, lanes], lambda t: (round_even(least(greatest(t, 5.0), 45.0), 2) * 100)::bigint), ' ') as greens, least(greatest(case when lanes = 1 then speed::bigint when lanes = 2 then floor(0.5 * speed) else 12 end, 1), speed)::bigint as k from v_edge")
def annealing_formulas(spark, sf):
    current, new = F.col("lanes") * 10, F.col("speed")
    chance = F.floor(records.acceptance(current, new, 8.0) * 1000000).cast("bigint")
    greens = F.transform(records.clipped_times(F.array(F.col("speed").cast("double"), F.col("length").cast("double") / 20, F.col("lanes").cast("double")), 5.0, 45.0), lambda t: F.bround(t * 100).cast("bigint").cast("string"))
    k = F.when(F.col("lanes") == 2, F.lit(0.5)).when(F.col("lanes") == 3, F.lit(12.0))
    return v.edge(spark, sf).select("edge_id", chance.alias("chance"), F.array_join(greens, " ").alias("greens"), records.chosen_k(k, F.col("speed").cast("bigint")).alias("k"))


FRONT = ", p as (select p_partkey as id, p_size::bigint as a, (round_even(p_retailprice * 100, 0)::bigint * 7919) % 100003 as b, p_brand as g from part), d as (select x.id as i, y.id as o from p x join p y on x.g = y.g and x.a <= y.a and x.b <= y.b and (x.a < y.a or x.b < y.b)), r(id, level) as (select id, 1::bigint from p union select o, level + 1 from r join d on i = id) "


@query(FRONT + "select id, max(level) as front from r group by 1")
def domination_fronts(spark, sf):
    rows = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("a"), (F.bround(F.col("p_retailprice") * 100).cast("bigint") * 7919 % 100003).alias("b"), F.col("p_brand").alias("g"))
    return records.fronts(rows, "g", "a", "b").select("id", "front")


@query("select p_brand as g, arg_min(p_partkey, p_size * 1000000 + p_partkey) as best from part group by 1")
def best_individuals(spark, sf):
    """The individual of each population that is least by fitness, part by part."""
    return v.table(spark, sf, "part").groupBy(F.col("p_brand").alias("g")).agg(F.min(F.struct("p_size", "p_partkey")).alias("m")).select("g", F.col("m.p_partkey").alias("best"))


@query(", b as (select min(x) as x0, min(y) as y0 from v_point), c as (select id, (x - x0) // 50 as col, (y - y0) // 50 as row, w from v_point, b) select id, col, row, row_number() over (partition by col, row order by id) - 1 as rank, case when w > 2 then sum((w > 2)::int) over (order by id) - 1 else -1 end::bigint as place from c")
def grid_cells(spark, sf):
    """Cells of a grid over the bounding box, ranks within a cell, and places among the points that are left."""
    points = v.point(spark, sf)
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    cells = points.crossJoin(F.broadcast(box)).select("id", F.floor((F.col("x") - F.col("x0")) / 50).alias("col"), F.floor((F.col("y") - F.col("y0")) / 50).alias("row"))
    rank = (F.row_number().over(W.partitionBy("col", "row").orderBy("id")) - 1).cast("bigint")
    alive = sequences.dense_ids(points.where("w > 2").select(F.col("id").alias("key")), "key").select(F.col("key").alias("id"), F.col("id").alias("place"))
    return cells.withColumn("rank", rank).join(alive, "id", "left").fillna(-1, ["place"])


@query("select vehicle_id, r.left_ as \"left\", visit from (select route_id as vehicle_id, min(pos)::bigint as left_, row_number() over (partition by route_id order by min(pos)) - 1 as visit from (select r.route_id, pos, pos - row_number() over (partition by route_id order by pos) as island from v_route r semi join v_region g using (edge_id)) group by route_id, island) r")
def region_visits(spark, sf):
    return records.visits(v.route(spark, sf), v.region(spark, sf)).select(F.col("route_id").alias("vehicle_id"), "left", "visit")


@query(RUNS + LISTS + "select route_id, array_to_string(edges[\"left\" + 1:], ' ') as rest from lists join runs using (route_id) where \"right\" > \"left\"")
def remaining_routes(spark, sf):
    """What is left of each route from the edge where its vehicle enters the region."""
    runs = sequences.longest_run(v.route(spark, sf), v.region(spark, sf)).where("right > left")
    joined = sequences.as_lists(v.route(spark, sf)).join(runs, "route_id")
    return joined.select("route_id", F.array_join(F.slice("edges", (F.col("left") + 1).cast("int"), F.size("edges")), " ").alias("rest"))


@query(ETA + "select vehicle_id, depart * 1000 + eta as expected, vehicle_id % 50001 < eta as dropped from v_vehicle join f using (route_id)")
def expected_arrivals(spark, sf):
    """When vehicles should enter the region, and which are dropped since they came before their time."""
    found = scenario.eta(v.vehicle(spark, sf), v.route(spark, sf), v.edge(spark, sf), v.region(spark, sf))
    return found.join(v.vehicle(spark, sf).select("vehicle_id", "depart"), "vehicle_id").select("vehicle_id", (F.col("depart") * 1000 + F.col("eta")).alias("expected"), (F.col("vehicle_id") % 50001 < F.col("eta")).alias("dropped"))


PHASES = ", ph as (select edge_id // 3 as junction, edge_id % 3 as k, case when (edge_id // 3) % 4 = 3 and edge_id % 3 = 1 then 'rr' when edge_id % 3 = 0 then 'Gr' when edge_id % 3 = 1 then 'yr' else 'rg' end as state from v_edge), f as (select *, coalesce(lead(state) over (partition by junction order by k), first(state) over (partition by junction order by k)) as follow from ph) "


def _phases(spark, sf):
    state = F.when((F.floor(F.col("edge_id") / 3) % 4 == 3) & (F.col("edge_id") % 3 == 1), "rr").when(F.col("edge_id") % 3 == 0, "Gr").when(F.col("edge_id") % 3 == 1, "yr").otherwise("rg")
    return v.edge(spark, sf).select(F.floor(F.col("edge_id") / 3).alias("junction"), (F.col("edge_id") % 3).alias("k"), state.alias("state"))


@query(PHASES + "select junction, count(*) as phases, sum(((lower(state) like '%g%' and state not like '%y%' and translate(lower(state), 'g', 'y') <> follow) or (state like '%y%' and follow like '%y%') or (lower(state) not like '%g%' and state not like '%y%'))::int)::bigint as wrong from f group by 1")
def signal_order(spark, sf):
    return records.phase_order(_phases(spark, sf))


@query(PHASES + "select junction, k, state from ph where lower(state) like '%g%' and state not like '%y%'")
def signal_phases(spark, sf):
    """The green phases of the signal programs, read back from a file of them."""
    path = new_folder(spark)
    sinks.write_elements(_phases(spark, sf).select(F.col("junction").alias("_id"), F.col("k").alias("_k"), F.col("state").alias("_state")), path, "additional", "phase")
    found = network.elements(spark, path, "phase", "_id bigint, _k bigint, _state string")
    return found.where(F.lower("_state").contains("g") & ~F.col("_state").contains("y")).select(F.col("_id").alias("junction"), F.col("_k").alias("k"), F.col("_state").alias("state"))


DRAW = "(((({seed} * 48271 + ({a}) * 7919 + 12345) % 2147483647) * 69621 + ({b}) * 7919 + 12345) % 2147483647 * 48271) % 2147483647"


@query(f", f as (select edge_id, k, {DRAW.format(seed=5, a='edge_id', b='k')} as d from (select p_partkey as edge_id, unnest(range(1 + p_partkey % 3)) as k from part)) select edge_id, k, 25200 + (k * 3600 + d % 3600)::bigint as depart from f")
def fluctuating_flow(spark, sf):
    """As many vehicles of each edge as it has lanes, one in each hour, at a drawn second of it."""
    cars = v.edge(spark, sf).select("edge_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lanes") - 1)).alias("k"))
    return cars.select("edge_id", "k", (25200 + F.col("k") * 3600 + records.draw(5, F.col("edge_id"), F.col("k")) % 3600).alias("depart"))


@query(f", w as (select edge_id, lanes, floor(-ln(({DRAW.format(seed=9, a='edge_id', b='lanes')} + 1) / 2147483648.0) / lanes * 1000000)::bigint as key from v_edge) select edge_id, key from w order by key, edge_id limit 25")
def weighted_choice(spark, sf):
    """25 edges drawn without replacement, wide ones more likely."""
    u = (records.draw(9, F.col("edge_id"), F.col("lanes")) + 1) / F.lit(2147483648.0)
    return v.edge(spark, sf).select("edge_id", F.floor(-F.log(u) / F.col("lanes") * 1000000).cast("bigint").alias("key")).orderBy("key", "edge_id").limit(25)


OBJ = ", o as (select event_id as id, user_id, event_type as highway, json_extract_string(props, '$.k') as lanes from events) "


def _tagged(spark, sf):
    tags = F.create_map(F.lit("highway"), "event_type", F.lit("lanes"), F.get_json_object("props", "$.k"), F.lit("user"), F.col("user_id").cast("string"))
    return v.table(spark, sf, "events").select(F.col("event_id").alias("id"), tags.alias("tags"))


@query(OBJ + "select id, case when lanes::bigint > 3 then 'highway lanes' else 'highway' end as kept, case when highway = 'click' then 'road' else highway end as highway, case when lanes = '2' then 'two' else '' end as note from o")
def tag_changes(spark, sf):
    """Tags that are kept by a condition, one turned into another, one added."""
    kept = records.kept_tags(F.col("tags"), lambda k, x: (k == "highway") | ((k == "lanes") & (x.cast("bigint") > 3)))
    new = records.changed_tags(records.changed_tags(F.col("tags"), "highway", "click", to=("highway", "road")), "lanes", "2", add=("note", "two"))
    return _tagged(spark, sf).select("id", F.array_join(F.array_sort(F.map_keys(kept)), " ").alias("kept"), new["highway"].alias("highway"), F.coalesce(F.try_element_at(new, F.lit("note")), F.lit("")).alias("note"))


@query(", m as (select fj as id, tj as member from v_edge where lanes < 3), s as (select distinct fj as id from v_edge where speed > 50), r(id) as (select id from s union select member from m join r using (id)) select id from r")
def relation_members(spark, sf):
    edges = v.edge(spark, sf)
    return records.needed_members(edges.where("lanes < 3").select(F.col("fj").alias("id"), F.col("tj").alias("member")), edges.where("speed > 50").select(F.col("fj").alias("id")))


@query(OBJ + "select id, highway, lanes from o where highway <> 'view'")
def map_file(spark, sf):
    """Map objects as a file without their authors, read back; those of one kind are left out."""
    path = new_folder(spark)
    tag = lambda k: F.struct(F.lit(k).alias("_k"), F.col("tags")[k].alias("_v"))
    rows = _tagged(spark, sf).where(selection.tag_condition("highway!=view")).select(F.col("id").alias("_id"), F.lit(1.5).alias("_lat"), F.lit(2.5).alias("_lon"), F.array(tag("highway"), tag("lanes")).alias("tag"))
    sinks.write_elements(rows, path, "osm", "node")
    return network.tagged(spark, path, "node").select("id", F.col("tags")["highway"].alias("highway"), F.col("tags")["lanes"].alias("lanes"))


@query(""", net as (select edge_id, round_even(length / speed, 3)::double as free from v_edge), cells as (select begin, edge_id, sum(trunc(traveltime * 1000)::bigint)::double / count(traveltime) / 1000 as t from v_dump group by all)
select begin, edge_id, case when t > free then round_even((1 - free / t) * 1000, 0)::bigint else 0 end as ci_milli from cells join net using (edge_id)""")
def congestion_from_network(spark, sf):
    """Measurements joined with the network that they were taken on; those of unknown edges are left out."""
    edges = v.edge(spark, sf).select("edge_id", fm.free_flow_time(F.col("length"), F.col("speed")).alias("free_flow"))
    cells = congestion.per_interval(v.dump(spark, sf).drop("free_flow").join(edges, "edge_id"))
    index = F.when(F.col("traveltime") > F.col("free_flow"), F.bround((1 - F.col("free_flow") / F.col("traveltime")) * 1000).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return cells.join(edges, "edge_id").select("begin", "edge_id", index.alias("ci_milli"))


def _queue_changes(spark, sf):
    """Vehicles are users whose number is a route's; they visit the runs of their route in the region."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "departed"), ("click", "entered"), ("purchase", "planned"), ("signup", "arrived")) for x in pair]), F.col("event_type"))
    stream = online.event_stream(spark, f"{sf}/event[s].parquet").select(F.col("user_id").alias("vehicle_id"), "event_id", "ts", F.coalesce(kind, F.lit("none")).alias("kind"))
    route = v.route(spark, sf).join(v.table(spark, sf, "events").select(F.col("user_id").alias("route_id")).distinct(), "route_id", "left_semi")
    seconds = route.join(v.edge(spark, sf).select("edge_id", (F.col("length") / F.col("speed")).alias("s"), (F.col("speed") <= 26).alias("inside")), "edge_id")
    runs = records.visits(route, v.region(spark, sf))
    before = W.partitionBy("route_id").orderBy("visit")
    spans = runs.select("route_id", "visit", "left", F.coalesce(F.lag("left").over(before), F.lit(0)).alias("since"))
    timed = spans.join(seconds.select("route_id", "pos", "s", "edge_id"), "route_id").groupBy("route_id", "visit", "left").agg(F.floor(F.sum(F.when((F.col("pos") >= F.col("since")) & (F.col("pos") < F.col("left")), F.col("s")).otherwise(0.0))).cast("bigint").alias("seconds"), F.max(F.when(F.col("pos") == F.col("left"), F.col("edge_id"))).alias("region"))
    listed = written(timed.groupBy(F.col("route_id").alias("vehicle_id")).agg(F.array_sort(F.collect_list(F.struct("visit", "region", "seconds", "left"))).alias("v")))
    visits = listed.select("vehicle_id", F.transform("v", lambda x: F.struct(x["region"].alias("region"), x["seconds"].alias("seconds"))).alias("visits"))
    changes = online.drained(queue.queue_changes(stream, visits, "0 seconds"), "append").drop("batch")
    ways = sequences.as_lists(route).withColumnRenamed("route_id", "vehicle_id").join(listed, "vehicle_id")
    return changes, ways.select("vehicle_id", "edges", F.transform("v", lambda x: x["left"].cast("int")).alias("indexes"))


@query()
def stream_queue(spark, sf):
    """Every change of the queue that the stream's watermark has passed."""
    return _queue_changes(spark, sf)[0]


@query()
def queue_problems(spark, sf):
    """The vehicles of each planning window, with their ways to the region."""
    found = queue.problems(*_queue_changes(spark, sf))
    return found.withColumn("edges", F.array_join(F.transform("edges", lambda e: e.cast("string")), " "))


@query(""", old as (select route_id, list(edge_id order by pos) as o from v_route group by 1), new as (select route_id, list(edge_id order by pos) as n from v_planned group by 1), place as (select route_id, min(pos) as i from v_route where mark = 5 group by 1),
plan as (select route_id, o, n, coalesce(i, -1) as i from old join new using (route_id) left join place using (route_id)),
judged as (select *, case when o[1] <> n[1] or o[len(o)] <> n[len(n)] then 'ends' when i >= 0 and coalesce(list_position(n, o[i + 1]), 0) = 0 then 'missing' else 'assigned' end as result from plan)
select route_id as vehicle_id, result, case when result = 'assigned' then array_to_string(case when i < 0 then n else n[list_position(n, o[i + 1]):] end, ' ') end as edges from judged""")
def route_assignment(spark, sf):
    """New routes for vehicles on their way: the rest from the edge that they are on, or why not."""
    old, new = sequences.as_lists(v.route(spark, sf)), sequences.as_lists(v.planned(spark, sf))
    place = v.route(spark, sf).where("mark = 5").groupBy("route_id").agg(F.min("pos").alias("i"))
    running = old.join(place, "route_id", "left").select(F.col("route_id").alias("vehicle_id"), "edges", F.coalesce("i", F.lit(-1)).cast("int").alias("index"))
    plans = old.withColumnRenamed("edges", "original").join(new, "route_id").withColumnRenamed("route_id", "vehicle_id")
    found = queue.assigned(running, plans)
    return found.withColumn("edges", F.array_join(F.transform("edges", lambda e: e.cast("string")), " "))


@query(""", e as (select edge_id, fj, case when lanes = 3 and speed > 26 then tj + 1000000000 else tj end as tj, case when etype = 'Brand#11' then 0 else length end as length from v_edge), j as (select fj as j from v_edge union select tj from v_edge),
good as (select * from e where tj in (from j) and length > 0),
c as (select distinct from_edge, case b.etype when 'Brand#22' then to_edge + 1000000000 when 'Brand#33' then to_edge + 1 else to_edge end as to_edge from v_connection join v_edge b on b.edge_id = to_edge),
p as (select c.*, a.tj as x, b.fj as y from c left join good a on a.edge_id = from_edge left join good b on b.edge_id = to_edge), turns as (select * from p where x = y),
used as (select fj as j from good union select tj from good)
select 'edge' as kind, edge_id::varchar as key, row_number() over (order by edge_id) - 1 as id from good union all select 'junction', j::varchar, row_number() over (order by j) - 1 from j union all select 'turn', from_edge || '>' || to_edge, -1 from turns
union all select 'junction_twin', j::varchar, -1 from j where j * 37 % 101 > 90 union all select 'edge_end', edge_id::varchar, -1 from e where tj not in (from j) union all select 'edge_measure', edge_id::varchar, -1 from e where length = 0
union all select 'connection_edge', from_edge || '>' || to_edge, -1 from p where x is null or y is null union all select 'connection_meet', from_edge || '>' || to_edge, -1 from p where x <> y
union all select 'junction_unused', j::varchar, -1 from j where j not in (from used) union all select 'junction_closed', j::varchar, -1 from j where j in (select fj from good) and j in (select tj from good) and j not in (select x from turns)""")
def load_and_verify(spark, sf):
    """A network file with planted faults of every kind: what is loaded, numbered in file order, and the quarantine."""
    edges, path = v.edge(spark, sf), new_folder(spark)
    places = graph.junctions(edges).select("junction", F.lit("priority").alias("kind"), (F.col("junction") * 37 % 101).alias("x"), (F.col("junction") * 53 % 97).alias("y"))
    broken = edges.withColumn("tj", F.when((F.col("lanes") == 3) & (F.col("speed") > 26), F.col("tj") + 1000000000).otherwise(F.col("tj"))).withColumn("length", F.when(F.col("etype") == "Brand#11", 0.0).otherwise(F.col("length")))
    to = graph.connections(edges).join(edges.select(F.col("edge_id").alias("to_edge"), F.col("etype").alias("t")), "to_edge")
    turns = to.select("from_edge", F.when(F.col("t") == "Brand#22", F.col("to_edge") + 1000000000).when(F.col("t") == "Brand#33", F.col("to_edge") + 1).otherwise(F.col("to_edge")).alias("to_edge"))
    sinks.write_network(broken.orderBy("edge_id"), turns, places.unionByName(places.where("x > 90")).orderBy("junction"), path)
    net = network.load_network(spark, path)
    rows = lambda kind, df, key, id_: df.select(F.lit(kind).alias("kind"), key.alias("key"), id_.cast("bigint").alias("id"))
    parts = [rows("edge", net.tables["edges"], F.col("edge_id"), F.col("id")), rows("junction", net.tables["junctions"], F.col("junction"), F.col("id")), rows("turn", net.tables["connections"], F.concat_ws(">", "from_edge", "to_edge"), F.lit(-1))]
    return reduce(DataFrame.unionByName, [*parts, net.faults.select(F.col("check").alias("kind"), "key", F.lit(-1).cast("bigint").alias("id"))])


ENDS = """, ends as (select route_id, arg_min(fj, pos) as a, arg_max(tj, pos) as b from v_route join v_edge using (edge_id) group by 1),
pairs as (select a, b, min(route_id) as id, count(*)::bigint as w from ends group by 1, 2)
"""


def _pairs(spark, sf):
    """(from_junction, to_junction, id, weight): each two ends with their first route and how many have them."""
    ends = flows.route_ends(v.route(spark, sf), v.edge(spark, sf))
    return ends.groupBy("from_junction", "to_junction").agg(F.min("route_id").alias("id"), F.count(F.lit(1)).alias("weight"))


@query(ENDS + f""", net as (select sum(floor(length * 1000)::bigint * lanes) // 1000 as metres from v_edge), clock as (select greatest(round_even(round_even(3600 / (metres / 1000.0) / 1, 3) * 1000, 0)::bigint, 1) as period from net where metres > 0),
ways as (select id, row_number() over (order by id) - 1 as dense, count(*) over () as n from pairs),
trips as (select period, unnest(range(3600000 // period)) as trip from clock)
select trip, 25200000 + trip * period as depart, id as way from (select *, {drawn('23', 'trip')} as d from trips) join ways on d % n = dense""")
def random_trips(spark, sf):
    """Trips of an hour over drawn pairs of ends, as many as the network's kilometres of lanes ask for."""
    return flows.random_trips(_pairs(spark, sf), v.edge(spark, sf), 25200, 28800, 1, 23)


@query(ENDS + """, js as (select id, list(distinct j) as js from (select id, unnest([fj, tj]) as j from pairs join v_route on route_id = id join v_edge using (edge_id)) group by 1),
cand as materialized (select id, a, w, js from pairs join js using (id)),
pick(n, chosen, most, covered, starts) as (select 1, id, gain, js, [a] from (select *, w * len(js) as gain from cand order by gain desc, id limit 1)
union all select n + 1, id, gain, list_distinct(covered || js), list_append(starts, a) from (select n, covered, starts, id, a, js, w * (len(js) - len(list_intersect(js, covered))) as gain, row_number() over (order by w * (len(js) - len(list_intersect(js, covered))) desc, id) as k
from pick, cand where n < 12 and not list_contains(starts, a) and list_has_any(js, covered)) where k = 1)
select n as rank, chosen as id, most::bigint as gain from pick""")
def meeting_flows(spark, sf):
    """Twelve flows that each meet one before, the most vehicles by junctions that none passes yet."""
    pairs, edges = written(_pairs(spark, sf)), v.edge(spark, sf)
    way = v.route(spark, sf).withColumnRenamed("route_id", "id").join(pairs.select("id"), "id", "left_semi").join(edges.select("edge_id", "fj", "tj"), "edge_id")
    passes = way.select("id", F.explode(F.array("fj", "tj")).alias("junction"))
    return flows.meeting_flows(pairs.select("id", F.col("from_junction").alias("start"), "weight"), passes, 12)


@query(ENDS + f""", d as (select *, {", ".join(f"{drawn(str(31 + k), 'a', 'b')} as d{k}" for k in range(5))} from pairs),
cmd as (select a, b, id, ['exponential_flow', 'random_flow', 'uniform_flow'][d0 % 3 + 1] as flow_name, d1 % 15 as x, d2 % 15 as y, d3, d4 from d), n as (select user_id as id, count(*) as n from events group by 1)
select a as from_junction, b as to_junction, flow_name, 25200::bigint as start_time, 28800::bigint as end_time, 3600::bigint as duration, case flow_name when 'random_flow' then least(x, y) || ' ' || greatest(x, y) || ' 20' when 'uniform_flow' then (720 + d3 % 480)::varchar else (75 + 10 * (d4 % 8))::varchar end as arguments,
coalesce(n, 0)::bigint as total, round_even(coalesce(n, 0) / 60.0::double * 10, 0)::bigint as per_minute_tenths from cmd left join n using (id)""")
def flow_report(spark, sf):
    """A command of a drawn kind for each two ends, with the vehicles that drove their route, in all and a minute."""
    edges, routes = v.edge(spark, sf), v.route(spark, sf)
    ends = flows.route_ends(routes, edges)
    commands = flows.drawn_flows(ends.select("from_junction", "to_junction").distinct(), 25200, 28800, 31)
    found = flows.flow_report(commands, ends, v.table(spark, sf, "events").select(F.col("user_id").alias("route_id")))
    own = ["least", "most", "period", "vehicles", "rise"]
    return found.withColumn("arguments", F.concat_ws(" ", *[F.col(c).cast("string") for c in own])).drop(*own)


def _map_objects(rows, **own):
    """``rows`` in the form of ``changes.OBJECT``; columns that aren't given are null."""
    types = dict(c.split(" ", 1) for c in changes.OBJECT.split(", "))
    return rows.select(*[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()], *[c.alias(n) for n, c in own.items() if n not in types])


def _snapshot(spark, sf):
    """Edges as ways of a map with their ends and tags; versions are microseconds."""
    tags = F.create_map(F.lit("highway"), F.col("etype"), F.lit("lanes"), F.col("lanes").cast("string"))
    version = (HALF + F.col("lanes") * 100000) * F.lit(1000000)
    return _map_objects(v.edge(spark, sf), kind=F.lit("way"), id=F.col("edge_id"), version=version, tags=tags, refs=F.array("fj", "tj"), visible=F.lit(True))


def _map_changes(spark, sf):
    """Events as changes to the way of the user's number; of one microsecond the event's number decides."""
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "delete").otherwise("modify")
    tags = F.create_map(F.lit("highway"), F.col("event_type"), F.lit("lanes"), F.get_json_object("props", "$.k"))
    number = F.lpad(F.col("event_id").cast("string"), 20, "0")
    events = v.table(spark, sf, "events")
    return _map_objects(events, kind=F.lit("way"), id=F.col("user_id"), version=F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"), timestamp=number, uid=F.col("user_id"), user=F.col("event_type"), tags=tags, refs=F.array("user_id", "event_id"), action=action)


MAP = f""", c as (select user_id as id, epoch_us(ts) as version, event_type as highway, json_extract_string(props, '$.k') as lanes, user_id || ' ' || event_id as refs, event_type <> 'purchase' as visible, row_number() over (partition by user_id order by epoch_us(ts) desc, event_type = 'purchase' desc, event_id desc) as k from events),
s as (select edge_id as id, ({HALF} + lanes * 100000) * 1000000 as version, etype as highway, lanes::varchar as lanes, fj || ' ' || tj as refs, true as visible from v_edge),
m as (select s.* from s left join (select * from c where k = 1) c using (id) where c.id is null or s.version > c.version union all
select c.id, c.version, c.highway, c.lanes, c.refs, c.visible from c left join s using (id) where k = 1 and (s.id is null or s.version <= c.version))
"""


def _merged_map(spark, sf):
    """The snapshot after the changes, both read from files of theirs."""
    base, path = new_folder(spark), new_folder(spark)
    changes.write_objects(_snapshot(spark, sf).drop("visible"), base, ["way"])
    changes.write_changes(_map_changes(spark, sf), path)
    kinds = {changes.map_format(spark, f"{base}/way"): changes.objects(spark, f"{base}/way", ["way"]), changes.map_format(spark, f"{path}/*"): changes.changes(spark, f"{path}/*")}
    return changes.merged(kinds["osm"].withColumn("visible", F.lit(True)), kinds["osc"])


def _shown(rows, *more):
    refs = F.array_join(F.transform("refs", lambda r: r.cast("string")), " ")
    return rows.select(*more, "id", "version", F.col("tags")["highway"].alias("highway"), F.col("tags")["lanes"].alias("lanes"), refs.alias("refs"))


@query(MAP + "select visible, id, version, highway, lanes, refs from m")
def map_changes(spark, sf):
    """A map after a file of changes: the highest version of each way, deleted ones as tombstones."""
    return _shown(_merged_map(spark, sf), "visible")


@query(MAP + """select case when s.id is null then 'create' else 'modify' end as action, m.id, m.version, m.highway, m.lanes, m.refs from m left join s using (id) where m.visible and (s.id is null or m.version > s.version)
union all select 'delete', s.id, s.version + 1, s.highway, s.lanes, s.refs from s join m using (id) where not m.visible""")
def map_difference(spark, sf):
    """The changes between a map before and after, as a file of them says."""
    path = new_folder(spark)
    changes.write_changes(changes.changes_between(_snapshot(spark, sf), written(_merged_map(spark, sf))), path)
    return _shown(changes.changes(spark, f"{path}/*"), "action")


@query(""", o as (select event_id, user_id, event_type, json_extract_string(props, '$.k') as k from events) select event_id as id from o
where (event_type in ('click', 'view') and k::bigint > 2) or (user_id < 100 and event_type <> 'view') or (event_type like '%up' and event_id::varchar like '%1')""")
def object_filter(spark, sf):
    """Changes by a filter with several values of a key, a key that takes any beginning, and the object's own id and author."""
    rows = _map_changes(spark, sf).withColumns({"event_id": F.col("refs")[1], "id": F.col("refs")[1]})
    return rows.where(selection.tag_condition("( highway=click =view and *anes>2 ) or ( @uid<100 and @user!=view ) or ( high*=*up and @id=*1 )")).select("id")


@query(ENDS + ", f as (select fj as j from v_edge where fj not in (select tj from v_edge)), l as (select tj as j from v_edge where tj not in (select fj from v_edge)), x as (select a as from_junction, b as to_junction, a in (select j from f) as starts, b in (select j from l) as ends from pairs) select * from x where not (starts and ends)")
def flow_end_faults(spark, sf):
    """Pairs of ends at which no flow could start or end."""
    return flows.end_faults(_pairs(spark, sf).select("from_junction", "to_junction"), v.edge(spark, sf))


@query(", m as (select etype, lanes, count(*) as n from v_edge group by all) select x.etype as destination, 'lanes' || x.l as origin, coalesce(n, 0)::bigint as weight from (select distinct e.etype, l.l from v_edge e, (select unnest([1, 2, 3]) as l) l) x left join m on m.etype = x.etype and m.lanes = x.l")
def weight_matrix_file(spark, sf):
    """Edges by kind and lanes as a matrix in a text, read back."""
    path = new_folder(spark)
    counts = v.edge(spark, sf).groupBy("etype", "lanes").agg(F.count(F.lit(1)).alias("weight"))
    sinks.write_weight_matrix(counts.select(F.concat(F.lit("lanes"), F.col("lanes").cast("string")).alias("origin"), F.col("etype").alias("destination"), "weight"), path)
    return network.weight_matrix(spark, path).select("destination", "origin", "weight")


@query(LISTS + "select 'v' || route_id as vehicle, array_to_string(edges, ' ') as edges from lists")
def plan_lists(spark, sf):
    """Plans as texts of bracketed steps, read back as the list of each vehicle, wherever its steps stand."""
    path = new_folder(spark)
    rows = v.route(spark, sf).repartition("route_id").sortWithinPartitions("pos", "route_id")
    sinks.write_lines(rows.select(F.format_string("(v%d drive r%d)", "route_id", "edge_id").alias("value")), path)
    steps = network.plan_steps(network.plans(spark, path), prefixed=True)
    ordered = F.array_sort(F.collect_list(F.struct("line", "route")))
    return steps.groupBy("vehicle").agg(F.array_join(F.transform(ordered, lambda s: s["route"]), " ").alias("edges"))


@query("select distinct '/maps/' || vtype || '.net.xml' as network, 'x.add.xml ' || vtype || '.rou.xml' as additional, 'd/' || vtype || '.rou.xml' as routes_file, vtype || '.rou.xml' as routes from v_vehicle")
def configuration_paths(spark, sf):
    """Files of configurations as whole paths, seen from the configuration's own folder."""
    path = new_folder(spark)
    kinds = v.vehicle(spark, sf).groupBy("vtype").agg(F.min("depart").alias("begin"), F.max("depart").alias("end"))
    named = {"network": F.concat(F.lit("/maps/a/../"), "vtype", F.lit(".net.xml")), "additional": F.concat(F.lit("../x.add.xml, .././"), "vtype", F.lit(".rou.xml")), "routes_file": F.concat(F.lit("../b/c/../../d/"), "vtype", F.lit(".rou.xml"))}
    sinks.write_configuration(kinds.select(*[c.alias(n) for n, c in named.items()], "begin", "end"), f"{path}/configurations")
    found = network.configuration_paths(spark, f"{path}/configurations")
    short = lambda c: F.regexp_replace(F.url_decode(c), "^.*/tables/[^/]+/", "")
    return found.select(F.col("network"), F.array_join(F.transform("additional", short), " ").alias("additional"), short(F.col("routes_file")).alias("routes_file"), short(F.col("routes")).alias("routes"))
