"""Road-traffic frames over the star-schema tables, and the same as SQL for the oracle.

Parts are edges, line items are route positions, orders are vehicles, events are measured
travel times, embeddings are points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a measuring interval.
INTERVAL = 900


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Nine edges between six junctions make a block, and so many steps from its first junction an edge
#: starts and ends: a ring of three, a road there and back, the ways to the next block and to the
#: one before, an entry, an exit.
STARTS, ENDS = [0, 1, 2, 0, 3, 0, 0, 4, 0], [1, 2, 0, 3, 0, 6, -6, 0, 5]


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    block, place = F.floor(k / 9) * 6, (k % 9 + 1).cast("int")
    at = lambda steps: F.abs(block + F.element_at(F.array(*[F.lit(s) for s in steps]), place))
    return table(spark, sf_dir, "part").select(
        k.alias("edge_id"),
        at(STARTS).alias("fj"),
        at(ENDS).alias("tj"),
        F.col("p_retailprice").alias("length"),
        (F.col("p_size") + F.lit(1.0)).alias("speed"),
        (1 + k % 3).alias("lanes"),
        F.col("p_brand").alias("etype"),
    )


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge(spark, sf_dir).where("speed <= 26")


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return items.select(
        F.col("l_orderkey").alias("route_id"),
        (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
        F.col("l_partkey").alias("edge_id"),
        (F.col("l_suppkey") % 10).alias("mark"),
    )


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of a second scenario, in which every tenth position has another edge of the same block."""
    other = F.when(F.col("mark") == 0, F.floor(F.col("edge_id") / 9) * 9 + (F.col("edge_id") + 4) % 9).otherwise(F.col("edge_id"))
    return route(spark, sf_dir).withColumn("edge_id", other)


def vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("vehicle_id"),
        F.col("o_orderkey").alias("route_id"),
        F.unix_timestamp("o_orderdate").alias("depart"),
        F.col("o_orderpriority").alias("vtype"),
    )


def dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (second - second % INTERVAL).alias("begin"),
        F.col("user_id").alias("edge_id"),
        F.col("value").alias("traveltime"),
        (5 + F.col("user_id") % 7).cast("double").alias("free_flow"),
    )


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.floor(e[0].cast("double") * 1000).alias("x"),
        F.floor(e[1].cast("double") * 1000).alias("y"),
        (F.col("label") + 1).cast("bigint").alias("w"),
    )


SQL = f"""with recursive v_edge as (
  select p_partkey as edge_id, p_partkey // 9 * 6 + ({STARTS})[p_partkey % 9 + 1] as fj, abs(p_partkey // 9 * 6 + ({ENDS})[p_partkey % 9 + 1]) as tj,
    p_retailprice as length, p_size + 1.0::double as speed, 1 + p_partkey % 3 as lanes, p_brand as etype from part),
v_region as (select * from v_edge where speed <= 26),
v_connection as (select e1.edge_id as from_edge, e2.edge_id as to_edge from v_edge e1 join v_edge e2 on e1.tj = e2.fj and e1.edge_id <> e2.edge_id),
v_route as (
  select l_orderkey as route_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as pos,
    l_partkey as edge_id, l_suppkey % 10 as mark from lineitem),
v_planned as (select route_id, pos, case when mark = 0 then edge_id // 9 * 9 + (edge_id + 4) % 9 else edge_id end as edge_id, mark from v_route),
v_vehicle as (select o_orderkey as vehicle_id, o_orderkey as route_id, epoch(o_orderdate)::bigint as depart, o_orderpriority as vtype from orders),
v_dump as (
  select event_id, (floor(epoch(ts))::bigint // 900 * 900) as begin, user_id as edge_id, value as traveltime, (5 + user_id % 7)::double as free_flow from events),
v_point as (select vec_id as id, floor(embedding[1]::double * 1000)::bigint as x, floor(embedding[2]::double * 1000)::bigint as y, (label + 1)::bigint as w from embeddings)
"""
