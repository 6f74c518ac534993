"""Changes to a road graph as tables: what is taken out takes along what depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_edges(edges: DataFrame, connections: DataFrame, route: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, connections, route) without some edges (edge_id), the turns over them, and the routes that use them."""
    ids = gone.select("edge_id").distinct()
    left = connections.join(ids, connections["from_edge"] == ids["edge_id"], "left_anti").join(ids, connections["to_edge"] == ids["edge_id"], "left_anti")
    lost = route.join(ids, "edge_id", "left_semi").select("route_id").distinct()
    return edges.join(ids, "edge_id", "left_anti"), left, route.join(lost, "route_id", "left_anti")


def without_junctions(edges: DataFrame, connections: DataFrame, route: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same without some junctions (junction), and the edges that start or end there."""
    ids = gone.select("junction").distinct()
    touching = edges.join(ids, edges["fj"] == ids["junction"], "left_semi").unionByName(edges.join(ids, edges["tj"] == ids["junction"], "left_semi"))
    return without_edges(edges, connections, route, touching)


def without_routes(edges: DataFrame, route: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, route) without some routes (route_id), and without the edges that only they used."""
    left = route.join(gone.select("route_id").distinct(), "route_id", "left_anti")
    used, still = route.select("edge_id").distinct(), left.select("edge_id").distinct()
    return edges.join(used.join(still, "edge_id", "left_anti"), "edge_id", "left_anti"), left


def with_rows(table: DataFrame, rows: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """``table`` and further rows; of a key in both, the new row counts if ``replace``, else the old one."""
    if replace:
        return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)
    return table.unionByName(rows.join(table.select(key).distinct(), key, "left_anti"))


def with_edges(edges: DataFrame, rows: DataFrame, junctions: DataFrame, replace: bool = False) -> DataFrame:
    """Edges and further ones whose ends are junctions (junction); others aren't taken."""
    ids = junctions.select("junction").distinct()
    known = rows.join(ids, rows["fj"] == ids["junction"], "left_semi").join(ids, rows["tj"] == ids["junction"], "left_semi")
    return with_rows(edges, known, "edge_id", replace)


def with_routes(route: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes and further ones all of whose edges exist."""
    bad = rows.join(edges.select("edge_id"), "edge_id", "left_anti").select("route_id").distinct()
    return route.unionByName(rows.join(bad, "route_id", "left_anti"))


def with_connections(connections: DataFrame, rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Connections and further ones between edges that exist and meet, without doubles."""
    a = edges.select(F.col("edge_id").alias("from_edge"), F.col("tj").alias("x"))
    b = edges.select(F.col("edge_id").alias("to_edge"), F.col("fj").alias("y"))
    fit = rows.join(a, "from_edge").join(b, "to_edge").where("x = y").select("from_edge", "to_edge")
    return connections.select("from_edge", "to_edge").unionByName(fit).distinct()


def without_connections(connections: DataFrame, gone: DataFrame) -> DataFrame:
    return connections.join(gone.select("from_edge", "to_edge").distinct(), ["from_edge", "to_edge"], "left_anti")


def replaced_end(connections: DataFrame, side: str, changes: DataFrame) -> DataFrame:
    """Connections whose edge on one side (from_edge or to_edge) is replaced; a null replacement takes the connection out.

    ``changes`` has old and new, one row for each old edge.
    """
    moved = connections.join(changes.select(F.col("old").alias(side), F.col("new"), F.lit(True).alias("hit")), side, "left")
    other = "to_edge" if side == "from_edge" else "from_edge"
    return moved.where("hit is null or new is not null").select(F.coalesce("new", side).alias(side), other).select("from_edge", "to_edge").distinct()


def merged_junctions(first: DataFrame, second: DataFrame) -> DataFrame:
    """The connections of both, each once."""
    return first.select("from_edge", "to_edge").unionByName(second.select("from_edge", "to_edge")).distinct()


def contracted_rings(edges: DataFrame, rings: DataFrame, kind: str = "bigint") -> DataFrame:
    """(edge_id, fj, tj): the graph with each ring of edges drawn together to one node ``r`` and its least edge.

    ``rings`` has ring (the ids of its edges, joined by spaces). Edges of rings vanish, the ends
    of others move to the node; rings don't share junctions. ``kind`` is the type of edge ids.
    """
    parts = F.transform(F.split("ring", " "), lambda e: e.cast("bigint"))
    inside = rings.select(F.concat(F.lit("r"), F.array_min(parts).cast("string")).alias("node"), F.explode(parts).alias("edge_id")).withColumn("edge_id", F.col("edge_id").cast(kind))
    places = edges.join(inside, "edge_id").select(F.col("fj").alias("junction"), "node").distinct()
    rest = edges.join(inside.select("edge_id"), "edge_id", "left_anti").select("edge_id", "fj", "tj")
    end = lambda c: places.select(F.col("junction").alias(c), F.col("node").alias(f"n_{c}"))
    moved = rest.join(end("fj"), "fj", "left").join(end("tj"), "tj", "left")
    return moved.select("edge_id", F.coalesce("n_fj", F.col("fj").cast("string")).alias("fj"), F.coalesce("n_tj", F.col("tj").cast("string")).alias("tj"))


def ring_ways(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """(node, enters, leaves, path): for junctions of a ring, the ring's edges from the one to the other."""
    parts = F.transform(F.split("ring", " "), lambda e: e.cast("bigint"))
    listed = rings.select(F.concat(F.lit("r"), F.array_min(parts).cast("string")).alias("node"), F.posexplode(parts).alias("k", "edge_id"), parts.alias("all"))
    placed = listed.join(edges.select("edge_id", "fj"), "edge_id")
    a, b = placed.select("node", "all", F.col("k").alias("i"), F.col("fj").alias("enters")), placed.select("node", F.col("k").alias("j"), F.col("fj").alias("leaves"))
    both = a.join(b, "node").where("i <> j")
    n = F.size("all")
    steps = F.transform(F.sequence(F.lit(0), F.pmod(F.col("j") - F.col("i"), n) - 1), lambda s: F.get("all", F.pmod(F.col("i") + s, n)).cast("string"))
    return both.select("node", "enters", "leaves", F.array_join(steps, " ").alias("path"))


def ring_places(edges: DataFrame, rings: DataFrame, junctions: DataFrame) -> DataFrame:
    """(node, junctions, x, y): the centre of mass of each ring's junctions (junction, x, y), in whole thousandths."""
    parts = F.transform(F.split("ring", " "), lambda e: e.cast("bigint"))
    inside = rings.select(F.concat(F.lit("r"), F.array_min(parts).cast("string")).alias("node"), F.explode(parts).alias("edge_id"))
    placed = edges.join(inside, "edge_id").select("node", F.col("fj").alias("junction")).distinct().join(junctions, "junction")
    mean = lambda c: F.floor(F.sum(c) * 1000 / F.count(F.lit(1))).alias(c)
    return placed.groupBy("node").agg(F.count(F.lit(1)).alias("junctions"), mean("x"), mean("y"))
