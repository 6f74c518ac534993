"""Similar routes: set similarity by shared edges, density clusters, choice of routes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.operators.components import connected_components
from roadlake.operators.sequences import placed


def rarest_first(route: DataFrame) -> DataFrame:
    """(id, edges): distinct edges of each route, those first that the fewest routes have."""
    sets = written(route.groupBy(F.col("route_id").alias("id")).agg(F.collect_set("edge_id").alias("edges")))
    items = sets.select("id", F.explode("edges").alias("edge"))
    df = items.groupBy("edge").agg(F.count(F.lit(1)).alias("df"))
    ordered = items.join(df, "edge").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "edge"))).alias("e"))
    return ordered.select("id", F.col("e.edge").alias("edges"))


def equal_sets(route: DataFrame) -> DataFrame:
    """(id, root): each route, and the lowest of the routes of the same set of edges."""
    sets = route.groupBy(F.col("route_id").alias("id")).agg(F.array_sort(F.collect_set("edge_id")).alias("edges"))
    roots = sets.groupBy("edges").agg(F.min("id").alias("root"))
    return sets.join(roots, "edges").select("id", "root")


def copies(equal: DataFrame) -> DataFrame:
    """(id, n): each root, and how many routes have its set."""
    return equal.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("n"))


#: Sets of one edge that are held against each other at once, and elements of pairs that a task counts at once.
BLOCK_SETS, BLOCK_ELEMENTS = 1024, 1 << 20


def of_sharing(sets: DataFrame, listed: Column, found: Callable, schema: str, least: float = 0.0, block: int = BLOCK_SETS) -> DataFrame:
    """What ``found`` makes of all pairs of sets that share one of their first ``listed`` edges, each pair once.

    ``sets`` has id, edges (distinct, in an order that all sets keep), and columns of its own. A set goes with all
    its edges to each edge that it is listed under; there pairs are made and counted inside a task, and only
    at the first edge that both have, so neither pairs nor their edges are shuffled. An edge of more than ``block``
    sets is dealt into blocks, and pairs of blocks are tasks' work. Of a batch of rows ``found`` gets the
    batch, and chunks (i, j, shared, total): numbers of rows whose similarity is ``least`` or more, id of i below that of j.
    """
    rows = sets.select("*", F.posexplode(F.slice("edges", F.lit(1), listed.cast("int"))).alias("at", "edge"))
    great = rows.groupBy("edge").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).where("blocks > 1")
    dealt = rows.join(F.broadcast(great), "edge", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")
    # a number of its own, since few bytes are much work here
    salts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(salts, "edge", "low", "high").sortWithinPartitions("edge", "low", "high", "id").drop("edge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in chain(batches, [None]):
            rows = [pa.Table.from_batches([b]) for b in (kept, batch) if b is not None and b.num_rows]
            if not rows:
                continue
            whole = pa.concat_tables(rows).combine_chunks().to_batches()[0]
            starts, codes = _groups(whole)
            done = whole.num_rows if batch is None else starts[-1]
            kept = None if batch is None else whole.slice(starts[-1])
            if done:
                ends = starts[1:] if done < whole.num_rows else np.append(starts[1:], done)
                yield from found(whole, _counted(whole, codes, ends, least))

    return met.mapInArrow(run, schema)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows with which groups of an edge and two blocks begin, and the edges of all rows as numbers."""
    lists = batch.column("edges")
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    keys = np.stack([codes[offsets[:-1] + _numbers(batch, "at")], _numbers(batch, "low"), _numbers(batch, "high")])
    return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))), codes


def _counted(batch: pa.RecordBatch, codes: np.ndarray, ends: np.ndarray, least: float) -> Iterator[tuple]:
    """(i, j, shared, total) of pairs within the groups that end at ``ends``, in chunks of bounded size."""
    offsets = batch.column("edges").offsets.to_numpy().astype(np.int64)
    offsets, width = offsets - offsets[0], np.diff(offsets)
    at, own, cross = _numbers(batch, "at"), _numbers(batch, "own"), _numbers(batch, "low") != _numbers(batch, "high")
    base = codes.max(initial=0) + 1
    known = np.sort(np.repeat(np.arange(len(width)), width) * base + codes)
    row = np.arange(ends[-1])
    after = np.repeat(ends, np.diff(ends, prepend=0)) - row - 1
    work = np.cumsum(after * width[row])
    cuts = np.unique(np.searchsorted(work, np.arange(0, work[-1] + BLOCK_ELEMENTS, BLOCK_ELEMENTS), side="right").clip(0, len(row)))
    for first, last in zip(np.append(0, cuts), np.append(cuts, len(row)), strict=True):
        n = after[first:last]
        i = np.repeat(row[first:last], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        fit = (~cross[i] | (own[i] != own[j])) & (width[i] >= width[j] * least - 1e-9) & (width[j] >= width[i] * least - 1e-9)
        i, j = i[fit], j[fit]
        if not len(i):
            continue
        n = width[i]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        asked = np.repeat(j * base, n) + codes[np.repeat(offsets[i], n) + place]
        hit = known[np.searchsorted(known, asked).clip(0, len(known) - 1)] == asked
        shared = np.add.reduceat(hit.astype(np.int64), begin)
        total = width[i] + width[j] - shared
        here = ~np.logical_or.reduceat(hit & (place < np.repeat(at[i], n)), begin) & (shared >= total * least - 1e-9)
        yield i[here], j[here], shared[here], total[here]


def jaccard_at_least(route: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, total) of all route pairs a < b of Jaccard similarity ``least`` or more.

    Two such routes share one of the rarest edges of each: a route of n edges is listed only
    under its n - ceil(least * n) + 1 rarest. So an edge that every route uses lists no pairs,
    unless routes have no other. Candidates are counted over whole sets, where they meet (``of_sharing``), and
    only pairs that are alike become rows. Routes of equal sets are
    each other's pairs, so give one route of each set (``equal_sets``) where copies are many.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    n = F.size("edges")

    def pairs(batch: pa.RecordBatch, chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ids = batch.column("id")
        for i, j, shared, total in chunks:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(shared), pa.array(total)], ["a", "b", "shared", "total"])

    kind = route.schema["route_id"].dataType.simpleString()
    return of_sharing(rarest_first(route), n - F.ceil(n * least - 1e-9) + 1, pairs, f"a {kind}, b {kind}, shared bigint, total bigint", least)


def density_clusters(ids: DataFrame, close: DataFrame, min_samples: int) -> DataFrame:
    """(id, label): density clusters over a table of close pairs (a, b); label is the least core id, -1 noise.

    A core has ``min_samples`` close points, itself included. Clusters are components of
    cores; another point goes to the lowest label of its close cores. Where ``ids`` has a column
    n, a point stands for so many at the same place.
    """
    ids = ids.select("id", F.col("n") if "n" in ids.columns else F.lit(1).alias("n"))
    both = close.select("a", "b").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    counts = both.join(ids.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("near"))
    cores = written(ids.join(counts, "id", "left").where(F.col("n") + F.coalesce("near", F.lit(0)) >= min_samples).select("id"))
    among = both.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")
    roots = connected_components(among).withColumnRenamed("node", "id")
    labels = cores.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("label"))
    borders = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
    found = ids.select("id").join(labels, "id", "left").join(borders, "id", "left")
    return found.select("id", F.coalesce("label", "near", F.lit(-1).cast(ids.schema["id"].dataType)).alias("label"))


def round_robin(clustered: DataFrame, k: int) -> DataFrame:
    """The k best routes: the best of each cluster by score, then the second best, and so on.

    ``clustered`` has id, label, score (lower is better).
    """
    rank = F.row_number().over(W.partitionBy("label").orderBy("score", "id")).cast("bigint")
    return clustered.withColumn("rank", rank).orderBy("rank", "label").limit(k)


def average_similarity(clustered: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, label, inside, outside): sums of similarities, in millionths, to routes of the own and of other clusters.

    ``clustered`` has id, label and n, the number of routes of that set; its copies count as inside.
    """
    sim = F.floor(F.col("shared") * 1_000_000 / F.col("total"))
    both = pairs.select("a", "b", sim.alias("s")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), sim.alias("s")))
    a = clustered.select(F.col("id").alias("a"), F.col("label").alias("la"))
    b = clustered.select(F.col("id").alias("b"), F.col("label").alias("lb"), "n")
    part = lambda own: F.sum(F.when(own, F.col("s") * F.col("n")).otherwise(0))
    sums = both.join(a, "a").join(b, "b").groupBy(F.col("a").alias("id")).agg(part(F.col("la") == F.col("lb")).alias("inside"), part(F.col("la") != F.col("lb")).alias("outside"))
    found = clustered.join(sums, "id", "left").fillna(0, ["inside", "outside"])
    return found.select("id", "label", (F.col("inside") + (F.col("n") - 1) * 1_000_000).alias("inside"), "outside")


def similarity_sums(sets: DataFrame, block: int = BLOCK_SETS) -> DataFrame:
    """(id, label, n, size, everything, inside): sums of a set's similarities to all sets, and to those of its label.

    ``sets`` has id, edges (distinct, in an array), label, and n, how many stand for the same set. A
    similarity counts in whole millionths, one's own and one's copies' a million each; size is the
    number of routes of the label. Sets that share no edge add nothing, so all others meet at their edges
    (``of_sharing``), where no pair becomes a row and all pairs count, however little they share.
    """
    sets = written(sets.select("id", "label", "n", F.sort_array("edges").alias("edges")))

    def sums(batch: pa.RecordBatch, chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        n, label = _numbers(batch, "n"), _numbers(batch, "label")
        out = np.zeros((2, batch.num_rows), np.int64)
        for i, j, shared, total in chunks:
            alike, same = shared * 1_000_000 // total, label[i] == label[j]
            for own, other in ((i, j), (j, i)):
                np.add.at(out[0], own, alike * n[other])
                np.add.at(out[1], own[same], (alike * n[other])[same])
        some = np.flatnonzero(out[0])
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some)), pa.array(out[0][some]), pa.array(out[1][some])], ["id", "everything", "inside"])

    kind = sets.schema["id"].dataType.simpleString()
    met = of_sharing(sets, F.size("edges"), sums, f"id {kind}, everything bigint, inside bigint", block=block)
    found = met.groupBy("id").agg(F.sum("everything").alias("everything"), F.sum("inside").alias("inside"))
    sizes = sets.groupBy(F.col("label").alias("of")).agg(F.sum("n").alias("size"))
    own = F.when(F.size("edges") > 0, F.col("n") * 1_000_000).otherwise(0)
    with_own = lambda c: (F.coalesce(c, F.lit(0)) + own).alias(c)
    return sets.join(found, "id", "left").join(sizes, F.col("label") == F.col("of")).select("id", "label", "n", "size", with_own("everything"), with_own("inside"))


def ranked_by(sums: DataFrame, metric: str) -> DataFrame:
    """(id, label, score, cluster_rank, rank): the routes of each cluster in order, and the clusters, by one metric.

    ``average_similarity`` (and ``average_dissimilarity``, the other way round) is the mean similarity to the
    other routes of the cluster, 0 alone, and clusters go by the mean of their routes' scores;
    ``maximal_similarity`` (``minimal_similarity``) is the sum over the routes of other clusters by the number
    of all routes, and clusters go by label. Scores are whole millionths, rounded down; ties go by id and
    label. Copies have the score of their set, and count in the mean of their cluster.
    """
    score = {
        "average": F.when(F.col("size") > 1, F.floor((F.col("inside") - 1_000_000) / (F.col("size") - 1))).otherwise(0),
        "outer": F.floor((F.col("everything") - F.col("inside")) / F.col("total")),
    }
    kinds = {"average_similarity": ("average", True), "average_dissimilarity": ("average", False), "maximal_similarity": ("outer", True), "minimal_similarity": ("outer", False)}
    if metric not in kinds:
        raise ValueError(f"unknown metric {metric}")
    kind, down = kinds[metric]
    total = sums.agg(F.sum("n").alias("total"))
    scored = written(sums.crossJoin(F.broadcast(total)).withColumn("score", score[kind].cast("bigint")))
    means = scored.groupBy("label").agg(F.floor(F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"))
    by = lambda c: F.desc(c) if down else F.asc(c)
    place = W.orderBy(by("mean"), "label") if kind == "average" else W.orderBy("label")
    clusters = means.select(F.col("label").alias("of"), F.row_number().over(place).cast("bigint").alias("cluster_rank"))
    key = F.col("score") if not down else -F.col("score")
    inside = placed(scored.withColumn("_key", key), "label", ["_key", "id"])
    return inside.join(clusters, F.col("label") == F.col("of")).select("id", "label", "score", "cluster_rank", (F.col("place") + 1).cast("bigint").alias("rank"))
