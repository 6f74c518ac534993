"""Routes, vehicles, problems and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a file; XML files are read whole, each by one task.
FILE_ELEMENTS = 50_000


def write_routes(lists: DataFrame, path: str) -> None:
    """(route_id, edges) as <route id= edges=> elements; edges are joined by spaces."""
    rows = lists.select(F.col("route_id").alias("_id"), F.concat_ws(" ", F.transform("edges", lambda e: e.cast("string"))).alias("_edges"))
    rows.write.format("xml").option("maxRecordsPerFile", FILE_ELEMENTS).option("rootTag", "routes").option("rowTag", "route").mode("errorifexists").save(path)


def write_vehicles(vehicles: DataFrame, path: str) -> None:
    """Vehicles by depart; departs have two digits, negative ones are left out, and one without a type is an error."""
    depart = F.when(F.col("depart") >= 0, F.bround("depart", 2))
    rows = vehicles.orderBy("depart", "vehicle_id").select(F.col("vehicle_id").alias("_id"), depart.alias("_depart"), F.col("route_id").alias("_route"), F.coalesce("vtype", F.raise_error(F.concat(F.lit("no type: vehicle "), F.col("vehicle_id").cast("string")))).alias("_type"))
    rows.write.format("xml").option("maxRecordsPerFile", FILE_ELEMENTS).option("rootTag", "additional").option("rowTag", "vehicle").mode("errorifexists").save(path)


def write_problems(facts: DataFrame, path: str) -> None:
    """(problem, section, fact) as one text a problem, its sections in order and facts sorted."""
    lines = F.array_sort(F.collect_list("fact"))
    sections = facts.groupBy("problem", "section").agg(F.concat(F.lit("(:"), "section", F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n)")).alias("body"))
    texts = sections.groupBy("problem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "body"))), lambda s: s["body"]), "\n").alias("value"))
    texts.write.partitionBy("problem").mode("errorifexists").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header, in order of its first column."""
    rows.orderBy(rows.columns[0]).write.option("header", True).mode("errorifexists").csv(path)


def write_weight_matrix(weights: DataFrame, path: str) -> None:
    """(origin, destination, weight) as one text: a line of all origins, then each destination with its weights; 0 where there is none.

    The form is one file with all origins in its first line, so one task writes it; the lines are made by all.
    """
    origins = weights.select("origin").distinct().agg(F.array_sort(F.collect_list("origin")).alias("origins"))
    cells = weights.groupBy("origin", "destination").agg(F.sum("weight").alias("weight"))
    rows = cells.groupBy("destination").agg(F.map_from_entries(F.collect_list(F.struct("origin", "weight"))).alias("w")).crossJoin(F.broadcast(origins))
    line = F.array_join(F.transform("origins", lambda o: F.coalesce(F.try_element_at("w", o), F.lit(0)).cast("string")), " ")
    body = rows.select(F.lit(1).alias("k"), "destination", F.concat_ws(" ", "destination", line).alias("value"))
    head = origins.select(F.lit(0).alias("k"), F.lit("").alias("destination"), F.concat(F.lit("  "), F.array_join("origins", " ")).alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("k", "destination").select("value").write.mode("errorifexists").text(path)


def write_elements(rows: DataFrame, path: str, root: str, tag: str) -> None:
    """Rows as elements of a tag; columns that start with _ are attributes, structs and arrays of them elements within."""
    rows.write.format("xml").option("maxRecordsPerFile", FILE_ELEMENTS).option("rootTag", root).option("rowTag", tag).option("declaration", 'version="1.0" encoding="UTF-8"').mode("errorifexists").save(path)


def write_network(edges: DataFrame, connections: DataFrame, junctions: DataFrame, path: str) -> None:
    """edges, connections and junctions as elements in folders of ``path``; all lanes of an edge have its length and speed."""
    lane = lambda k: F.struct(F.concat_ws("_", "edge_id", k.cast("string")).alias("_id"), F.col("length").alias("_length"), F.col("speed").alias("_speed"), F.lit("0,0 1,1").alias("_shape"))
    lanes = F.transform(F.sequence(F.lit(0), F.col("lanes").cast("int") - 1), lane)
    write_elements(edges.select(F.col("edge_id").alias("_id"), F.col("fj").alias("_from"), F.col("tj").alias("_to"), F.col("etype").alias("_type"), lanes.alias("lane")), f"{path}/edges", "net", "edge")
    write_elements(connections.select(F.col("from_edge").alias("_from"), F.col("to_edge").alias("_to")), f"{path}/connections", "net", "connection")
    write_elements(junctions.select(F.col("junction").alias("_id"), F.col("kind").alias("_type"), F.col("x").alias("_x"), F.col("y").alias("_y")), f"{path}/junctions", "net", "junction")


def write_configuration(rows: DataFrame, path: str) -> None:
    """(network, additional, begin, end, and routes_file if it is there) as simulation configurations."""
    value = lambda c: F.struct(F.col(c).cast("string").alias("_value"))
    inside = rows.select(F.struct(value("network").alias("net-file"), value("additional").alias("additional-files"), *[value(c).alias("route-files") for c in rows.columns if c == "routes_file"]).alias("input"), F.struct(value("begin").alias("begin"), value("end").alias("end")).alias("time"))
    write_elements(inside, path, "configurations", "configuration")


def write_scenario(vehicles: DataFrame, lists: DataFrame, configuration: DataFrame, path: str) -> None:
    """Routes, vehicles and the configuration of a scenario in folders of ``path``."""
    write_routes(lists, f"{path}/routes")
    write_vehicles(vehicles, f"{path}/vehicles")
    write_configuration(configuration, f"{path}/configuration")


def write_documents(rows: DataFrame, path: str) -> None:
    """Rows as JSON documents, one a line."""
    rows.write.mode("errorifexists").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """A column of text as lines."""
    rows.write.mode("errorifexists").text(path)
