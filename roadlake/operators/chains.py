"""Positions in chains and closed rings by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written


def _doubled(state: DataFrame) -> tuple[DataFrame, int]:
    """Each node that hasn't found its start looks as far again as it has seen: (state, nodes that have)."""
    look = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("start").alias("first"), F.col("rank").alias("more"), F.col("low").alias("lower"))
    open_ = state.where("start is null").drop("start").join(look, "ptr")
    stepped = open_.select("node", F.col("next").alias("ptr"), F.col("first").alias("start"), (F.col("rank") + F.col("more")).alias("rank"), F.least("low", "lower").alias("low"))
    now = written(state.where("start is not null").unionByName(stepped))
    drop_written(state)
    return now, now.where("start is not null").count()


def positions(links: DataFrame) -> tuple[DataFrame, int]:
    """((node, start, rank, closed), rounds): where each node lies in its chain, from 0 on, or in its ring.

    ``links`` has node and before, the one that leads to it, null at a start; no two nodes have the
    same one before. Each round doubles how far a node looks back, so a chain of n nodes takes
    log2(n) rounds of one join. A round in which no node finds a start leaves rings alone: these go on
    until the least node that each has seen stays the same, are cut before it, and are ranked as chains.
    Nodes whose chain begins with one that isn't in ``links`` are dropped.
    """
    known = links.select(F.col("node").alias("before"))
    held = links.where("before is null").unionByName(links.join(known, "before", "left_semi").select(*links.columns))
    first = F.when(F.col("before").isNull(), F.col("node")).alias("start")
    state = written(held.select("node", F.col("before").alias("ptr"), first, F.col("before").isNotNull().cast("bigint").alias("rank"), F.col("node").alias("low")))
    done, rounds = state.where("start is not null").count(), 0
    while True:
        state, found = _doubled(state)
        rounds += 1
        if found == done:
            break
        done = found
    chains = state.where("start is not null").select("node", "start", "rank", F.lit(False).alias("closed"))
    rings = written(state.where("start is null").select("node", "ptr", "start", "rank", "low"))
    if rings.isEmpty():
        return chains, rounds
    while True:
        changed = rings.join(rings.select(F.col("node").alias("ptr"), F.col("low").alias("lower")), "ptr").where("lower < low").limit(1).count()
        if not changed:
            break
        rings, _ = _doubled(rings)
        rounds += 1
    cut = rings.select("node", "low").join(links, "node").select("node", F.when(F.col("node") != F.col("low"), F.col("before")).alias("before"))
    ranked, more = positions(written(cut))
    return written(chains.unionByName(ranked.withColumn("closed", F.lit(True)))), rounds + more
