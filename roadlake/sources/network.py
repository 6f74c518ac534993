"""Road networks, routes, vehicles, measurements and statistics in XML, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.operators.sequences import dense_ids

JUNCTION = "_id string, _type string, _x double, _y double"
EDGE = "_id string, _from string, _to string, _type string, _function string, _shape string, lane array<struct<_id:string,_length:double,_speed:double,_shape:string>>"
CONNECTION = "_from string, _to string"
ROUNDABOUT = "_nodes string, _edges string"
ROUTE = "_id string, _edges string"
VEHICLE = "_id string, _depart double, _route string, _type string"
INTERVAL = "_begin double, _end double, edge array<struct<_id:string,_traveltime:double,_left:double,_congestionIndex:double>>"
NODE = "_id bigint, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"
WAY = "_id bigint, nd array<struct<_ref:bigint>>, tag array<struct<_k:string,_v:string>>"
RELATION = "_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, tag array<struct<_k:string,_v:string>>"
#: Attributes of a statistics file by element, in the order of the report; numbers stay as text.
STATISTICS = {
    "vehicles": ["loaded", "inserted", "running", "waiting"],
    "teleports": ["total", "jam", "yield", "wrongLane"],
    "safety": ["collisions", "emergencyStops", "emergencyBraking"],
    "vehicleTripStatistics": ["count", "routeLength", "speed", "duration", "waitingTime", "timeLoss", "departDelay", "totalTravelTime", "totalDepartDelay"],
}


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Every element of a tag; malformed ones are errors."""
    return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)


def junctions(spark: SparkSession, path: str) -> DataFrame:
    """(junction, kind, x, y) without internal junctions."""
    found = elements(spark, path, "junction", JUNCTION).where("_type is not null and _type <> 'internal'")
    return found.select(F.col("_id").alias("junction"), F.col("_type").alias("kind"), F.bround("_x", 2).alias("x"), F.bround("_y", 2).alias("y"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(edge_id, fj, tj, length, speed, lanes, etype, shape): edges without a function; the first lane measures."""
    found = elements(spark, path, "edge", EDGE).where("_function is null")
    first = F.col("lane")[0]
    return found.select(
        F.col("_id").alias("edge_id"),
        F.col("_from").alias("fj"),
        F.col("_to").alias("tj"),
        F.bround(first["_length"], 3).alias("length"),
        first["_speed"].alias("speed"),
        F.size("lane").cast("bigint").alias("lanes"),
        F.col("_type").alias("etype"),
        F.coalesce(F.col("_shape"), first["_shape"]).alias("shape"),
    )


def lanes(spark: SparkSession, path: str) -> DataFrame:
    found = elements(spark, path, "edge", EDGE).where("_function is null")
    return found.select(F.col("_id").alias("edge_id"), F.explode("lane").alias("l")).select("edge_id", F.col("l._id").alias("lane_id"), F.col("l._length").alias("length"), F.col("l._speed").alias("speed"), F.col("l._shape").alias("shape"))


def connections(spark: SparkSession, path: str) -> DataFrame:
    """(from_edge, to_edge), without those from internal edges."""
    found = elements(spark, path, "connection", CONNECTION).where(~F.col("_from").startswith(":"))
    return found.select(F.col("_from").alias("from_edge"), F.col("_to").alias("to_edge")).distinct()


def roundabouts(spark: SparkSession, path: str) -> DataFrame:
    return elements(spark, path, "roundabout", ROUNDABOUT).select(F.split("_nodes", " ").alias("nodes"), F.split("_edges", " ").alias("edges"))


def routes(spark: SparkSession, path: str) -> DataFrame:
    return elements(spark, path, "route", ROUTE).select(F.col("_id").alias("route_id"), F.split("_edges", " ").alias("edges"))


def vehicles(spark: SparkSession, path: str) -> DataFrame:
    """(vehicle_id, route_id, depart, vtype); all are required."""
    found = elements(spark, path, "vehicle", VEHICLE)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"a vehicle has no {c[1:]}: "), F.coalesce("_id", F.lit("?"))))).otherwise(F.col(c))
    return found.select(need("_id").alias("vehicle_id"), need("_route").alias("route_id"), F.bround("_depart", 2).alias("depart"), need("_type").alias("vtype"))


def measurements(spark: SparkSession, path: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(begin, end, edge_id, traveltime, left, ci) of intervals inside [low, high] hours."""
    found = elements(spark, path, "interval", INTERVAL)
    if low is not None:
        found = found.where(F.col("_begin") >= low * 3600)
    if high is not None:
        found = found.where(F.col("_end") <= high * 3600)
    flat = found.select(F.col("_begin").alias("begin"), F.col("_end").alias("end"), F.explode("edge").alias("e"))
    return flat.select("begin", "end", F.col("e._id").alias("edge_id"), F.col("e._traveltime").alias("traveltime"), F.col("e._left").alias("left"), F.col("e._congestionIndex").alias("ci"))


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its name, then the attributes of ``STATISTICS`` as text, in order of name."""
    schema = ", ".join(f"{tag} struct<{','.join(f'_{a}:string' for a in names)}>" for tag, names in STATISTICS.items())
    found = elements(spark, path, "statistics", schema)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1).alias("name")
    return found.select(name, *[F.col(f"{tag}._{a}").alias(f"{tag}_{a}") for tag, names in STATISTICS.items() for a in names]).orderBy("name")


def tagged(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(id, tags, refs) of map objects: node, way or relation; nodes have lat and lon instead of refs."""
    schema = {"node": NODE, "way": WAY, "relation": RELATION}[kind]
    found = elements(spark, path, kind, schema)
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>"))).alias("tags")
    if kind == "node":
        return found.select(F.col("_id").alias("id"), tags, F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    refs = F.transform("nd", lambda n: n["_ref"]) if kind == "way" else F.transform("member", lambda m: m["_ref"])
    return found.select(F.col("_id").alias("id"), tags, refs.alias("refs"))


def plans(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines of plan files that are in brackets."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return text.where(F.col("value").startswith("(") & F.col("value").endswith(")"))


def plan_steps(lines: DataFrame, prefixed: bool = False) -> DataFrame:
    """(file, line, vehicle, route) of plan lines (file, line, value): the first and the third token in the brackets.

    ``prefixed`` names have one character before the number, which goes. Lines of fewer tokens are errors.
    """
    tokens = F.split(F.trim(F.expr("substring(value, 2, length(value) - 2)")), r"\s+")
    route = F.when(F.size(tokens) < 3, F.raise_error(F.concat(F.lit("no step of a plan: "), "value"))).otherwise(F.get(tokens, F.lit(2)))
    return lines.select("file", "line", F.get(tokens, F.lit(0)).alias("vehicle"), F.substring(route, 2 if prefixed else 1, 1 << 30).alias("route"))


def weight_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(origin, destination, weight) of a text matrix: a header of origins, then a destination and weights a line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("line", "value"))
    parts = lines.select("line", F.split(F.trim("value"), r"\s+").alias("p"))
    header = parts.where("line = 0").select(F.posexplode("p").alias("k", "origin"))
    rows = parts.where("line > 0").select(F.get("p", F.lit(0)).alias("destination"), F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("k", "weight"))
    return rows.join(header, "k").select("origin", "destination", F.col("weight").cast("bigint").alias("weight"))


CONFIGURATION = "input struct<`net-file`:struct<_value:string>,`additional-files`:struct<_value:string>,`route-files`:struct<_value:string>>, time struct<begin:struct<_value:double>,end:struct<_value:double>,`step-length`:struct<_value:double>>"


def resolved_path(folder: Column, name: Column) -> Column:
    """``name`` as seen from ``folder``, without ``.`` and ``..``; names that begin with / or a scheme stay."""
    whole = F.when(name.rlike("^(/|[a-z]+:)"), name).otherwise(F.concat(folder, F.lit("/"), name))
    head = F.regexp_extract(whole, "^([a-z]+:/*|/)", 1)
    parts = F.split(F.substring(whole, F.length(head) + 1, F.length(whole)), "/")
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(head, F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def configuration_paths(spark: SparkSession, path: str) -> DataFrame:
    """(network, additional, routes_file, routes) of each configuration as whole paths, seen from its own folder."""
    found = elements(spark, path, "configuration", CONFIGURATION)
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    files = F.filter(F.transform(F.split(F.coalesce("input.additional-files._value", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    seen = found.select(
        resolved_path(folder, F.col("input.net-file._value")).alias("network"),
        F.transform(files, lambda x: resolved_path(folder, x)).alias("additional"),
        resolved_path(folder, F.col("input.route-files._value")).alias("routes_file"),
    )
    return seen.withColumn("routes", F.get(F.filter("additional", lambda x: x.endswith(".rou.xml")), F.lit(0)))


def configurations(spark: SparkSession, path: str) -> DataFrame:
    """(network, additional, routes_file, routes, begin, end, step) of each simulation configuration.

    additional is the list of further files; routes is the first of them that holds routes; the
    step is 1 where none is given.
    """
    found = elements(spark, path, "configuration", CONFIGURATION)
    files = F.transform(F.filter(F.split(F.coalesce("input.additional-files._value", F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    listed = found.select(
        F.col("input.net-file._value").alias("network"),
        files.alias("additional"),
        F.col("input.route-files._value").alias("routes_file"),
        F.col("time.begin._value").alias("begin"),
        F.col("time.end._value").alias("end"),
        F.coalesce("time.step-length._value", F.lit(1.0)).alias("step"),
    )
    return listed.withColumn("routes", F.get(F.filter("additional", lambda x: x.endswith(".rou.xml")), F.lit(0)))


def commands(spark: SparkSession, path: str) -> DataFrame:
    """(name, arguments) of the lines of a command log."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", " ", 2)
    return lines.select(F.get(parts, F.lit(0)).alias("name"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("arguments"))


def argument_map(text: Column) -> Column:
    """The map of ``key="value" key="value"``."""
    return F.str_to_map(F.regexp_replace(text, '"', ""), F.lit(" "), F.lit("="))


def documents(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON documents, one a line or one a file; malformed ones are errors."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def of_ids(found: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The elements whose id is in a set (id)."""
    return found.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def in_file_order(found: DataFrame) -> DataFrame:
    """``found``, rows read from files, with position: 0, 1, … in the order in which they lie in the files.

    A row's place is its file, the offset of its block there, and its rank in the block; ranks are
    numbered inside each block and begin after all rows of the blocks before, so that positions are the
    same however files are cut into partitions, and no task sees more than a block. Files go by name.
    """
    rows = written(found.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_rank")))
    sizes = rows.groupBy(F.col("_file").alias("_f"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_f", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_f", "_b", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy("_file", "_block").orderBy("_rank")) - 1
    placed = rows.withColumn("_inside", inside).join(starts, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.withColumn("position", F.col("_before") + F.col("_inside")).drop("_file", "_block", "_rank", "_f", "_b", "_before", "_inside")


def extent(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(tag, first, last): positions, among all elements of the tag, of the first and the last that isn't internal.

    tag is ``edge`` or ``junction``. Nulls where there is none.
    """
    outer = {"edge": F.col("_function").isNull(), "junction": F.col("_type").isNotNull() & (F.col("_type") != "internal")}
    found = in_file_order(elements(spark, path, tag, {"edge": EDGE, "junction": JUNCTION}[tag])).where(outer[tag])
    return found.agg(F.min("position").alias("first"), F.max("position").alias("last")).select(F.lit(tag).alias("tag"), "first", "last")


def numbered(found: DataFrame) -> DataFrame:
    """``found``, rows with position, with id: 0, 1, … among those that are left, in file order."""
    return dense_ids(found, "position").drop("position")


class Loaded:
    """A network as it was loaded: tables of junctions, edges, connections, roundabouts; ``faults``, and ``counts`` of the pass.

    faults (check, key) is the quarantine: rows that are out of the tables, with why, and what is wrong
    with the whole. counts has, for each table, its rows and those with a fault, as observed while
    it was written.
    """

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}
        self.counts: dict[str, tuple[int, int]] = {}
        self.faults: DataFrame | None = None

    def keep(self, name: str, rows: DataFrame, key: Column, checks: dict[str, Column]) -> DataFrame:
        """Write the rows with their faults in one pass, and count them on the way; those without are the table."""
        wrong = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), check) for check, bad in checks.items()]), lambda x: x.isNotNull())
        seen = Observation(name)
        marked = rows.select("*", key.cast("string").alias("_key"), wrong.alias("_wrong"))
        whole = written(marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_wrong") > 0).alias("faulty")))
        self.counts[name] = (seen.get["rows"], seen.get["faulty"])
        self.add(whole.where(F.size("_wrong") > 0).select(F.explode("_wrong").alias("check"), F.col("_key").alias("key")))
        self.tables[name] = whole.where(F.size("_wrong") == 0).drop("_key", "_wrong")
        return self.tables[name]

    def add(self, faults: DataFrame) -> None:
        self.faults = faults if self.faults is None else self.faults.unionByName(faults)


def load_network(spark: SparkSession, path: str) -> Loaded:
    """A network from the folders (or files) junctions, edges and connections under ``path``, numbered in file order and verified.

    Junctions and edges without an id, or with one that came before, edges whose ends aren't loaded
    junctions, without a positive length, speed or lane, and connections of edges that aren't loaded, or
    that don't meet, go to quarantine; so does what hangs on them. Loaded edges carry their route r0, r1, …;
    then junctions without an edge, and inner junctions without a connection, are named, which stay.
    """
    net = Loaded()
    first = lambda rows, column: rows.withColumn("_twin", F.row_number().over(W.partitionBy(column).orderBy("position")))
    found = in_file_order(elements(spark, f"{path}/junctions", "junction", JUNCTION)).where("_type is null or _type <> 'internal'")
    named = found.select(F.col("_id").alias("junction"), F.col("_type").alias("kind"), F.bround("_x", 2).alias("x"), F.bround("_y", 2).alias("y"), "position")
    doubled = lambda c: F.col(c).isNotNull() & (F.col("_twin") > 1)
    places = net.keep("junctions", first(named, "junction"), F.coalesce("junction", F.concat(F.lit("#"), F.col("position").cast("string"))), {"junction_id": F.col("junction").isNull(), "junction_twin": doubled("junction")})
    places = net.tables["junctions"] = written(numbered(places.drop("_twin")))

    found = in_file_order(elements(spark, f"{path}/edges", "edge", EDGE)).where("_function is null")
    lane = F.get("lane", F.lit(0))
    named = found.select(F.col("_id").alias("edge_id"), F.col("_from").alias("fj"), F.col("_to").alias("tj"), F.bround(lane["_length"], 3).alias("length"), lane["_speed"].alias("speed"), F.size("lane").cast("bigint").alias("lanes"), "position")
    end = lambda c: places.select(F.col("junction").alias(c), F.lit(True).alias(f"has_{c}"))
    known = first(named, "edge_id").join(end("fj"), "fj", "left").join(end("tj"), "tj", "left")
    checks = {
        "edge_id": F.col("edge_id").isNull(),
        "edge_twin": doubled("edge_id"),
        "edge_end": F.col("has_fj").isNull() | F.col("has_tj").isNull(),
        "edge_measure": ~F.coalesce((F.col("length") > 0) & (F.col("speed") > 0) & (F.col("lanes") > 0), F.lit(False)),
    }
    roads = net.keep("edges", known, F.coalesce("edge_id", F.concat(F.lit("#"), F.col("position").cast("string"))), checks)
    roads = written(numbered(roads.drop("_twin", "has_fj", "has_tj")).withColumn("route_id", F.concat(F.lit("r"), F.col("id").cast("string"))))
    net.tables["edges"] = roads.select("id", "edge_id", "route_id", "fj", "tj", "length", "speed", "lanes")

    pairs = connections(spark, f"{path}/connections")
    a = roads.select(F.col("edge_id").alias("from_edge"), F.col("tj").alias("x"))
    b = roads.select(F.col("edge_id").alias("to_edge"), F.col("fj").alias("y"))
    joined = pairs.join(a, "from_edge", "left").join(b, "to_edge", "left")
    turns = net.keep("connections", joined, F.concat_ws(">", "from_edge", "to_edge"), {"connection_edge": F.col("x").isNull() | F.col("y").isNull(), "connection_meet": F.col("x") != F.col("y")})
    net.tables["connections"] = turns.select("from_edge", "to_edge")

    out, into = roads.select(F.col("fj").alias("junction")).distinct(), roads.select(F.col("tj").alias("junction")).distinct()
    used = out.unionByName(into).distinct()
    net.add(places.join(used, "junction", "left_anti").select(F.lit("junction_unused").alias("check"), F.col("junction").alias("key")))
    inner = out.join(into, "junction").join(turns.select(F.col("x").alias("junction")).distinct(), "junction", "left_anti")
    net.add(inner.select(F.lit("junction_closed").alias("check"), F.col("junction").alias("key")))
    return net
