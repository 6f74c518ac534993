"""Shortest ways over the turn permissions of a road graph, of any length."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written

PAIR = ("first_edge", "last_edge")
#: What a task gets of a pair, or of a turn near a last edge; so many pairs share the turns at most, and so many ways leave at once.
WAY_ROW = ["last_edge", "part", "at", "next", "m", "rest"]
PAIRS_TOGETHER, WAYS_AT_ONCE = 256, 4096
#: Turns that searches take in one job; fewer jobs, but what the first of them reach goes on even where it is no nearer.
TURNS_A_ROUND = 2


def distances(pairs: DataFrame, turns: DataFrame, stretch: float = 1.0) -> DataFrame:
    """(last_edge, at, left, m): the least length from the end of ``at`` to the end of ``last_edge``, as a written table.

    One search a last edge, whatever the number of pairs that share it, backwards from it by ``TURNS_A_ROUND``
    turns a round. It goes on as far as ``stretch`` times the longest of its pairs' shortest ways, once
    all of these are found. After 8 turns, 16, 32 and so on, pairs still without a way are also sought
    forwards by as many turns: those whose first edge leads no farther have none and are given
    up, so that the search ends with the smaller of what leads to the last edge and what the first
    one leads to. Only the least length of each (last_edge, at) is kept. m is the length of ``at`` where
    it begins a pair, else null; such rows stay without ``left`` until they are reached.
    """
    none, wide = F.lit(None).cast("bigint"), W.partitionBy("last_edge")
    begin = pairs.select("last_edge", F.col("first_edge").alias("at"), none.alias("left"), "m").distinct()
    ends = pairs.select("last_edge", F.col("last_edge").alias("at"), F.lit(0).cast("bigint").alias("left"), none.alias("m")).distinct()
    best, front, done, due = None, begin.unionByName(ends).withColumn("gone_on", F.lit(False)), 0, 8
    while True:
        old = [] if best is None else [best.select("last_edge", "at", "left", "m", F.lit(True).alias("gone_on"), F.col("left").alias("old"))]
        both = reduce(DataFrame.unionByName, old, front.withColumn("old", none))
        # searches are dealt whole, so that the bounds need no exchange of their own; of equal lengths one that has gone on already counts
        kept = F.min(F.when(F.col("left").isNotNull(), F.struct("left", (~F.col("gone_on")).alias("open"))))
        least = both.repartition("last_edge").groupBy("last_edge", "at").agg(kept.alias("k"), F.max("m").alias("m"), F.min("old").alias("old")).select("last_edge", "at", "k.left", "k.open", "m", "old")
        lacking = F.max(F.col("m").isNotNull() & F.col("left").isNull()).over(wide)
        bound = F.when(~lacking, F.max(F.col("m") + F.col("left")).over(wide) * stretch)
        better = F.col("open") & (F.col("old").isNull() | (F.col("left") < F.col("old")))
        marked = least.withColumn("most", bound).select("last_edge", "at", "left", "m", F.coalesce(better & (F.col("most").isNull() | (F.col("left") <= F.col("most"))), F.lit(False)).alias("new"))
        now = written(marked)
        if best is not None:
            drop_written(best)
        best = now
        if best.where("new").isEmpty():
            return best.drop("new")
        if done >= due:
            due *= 2
            lacking = best.where("m is not null and left is null")
            if not lacking.isEmpty():
                shut = _exhausted(lacking.select(F.col("at").alias("first")).distinct(), turns, done)
                best = best.join(shut, (F.col("at") == F.col("first")) & F.col("m").isNotNull() & F.col("left").isNull(), "left_anti")
        steps = [best.where("new").select("last_edge", "at", "left")]
        for _ in range(TURNS_A_ROUND):
            grown = steps[-1].select("last_edge", F.col("at").alias("next"), "left").join(turns.withColumnRenamed("m", "length").hint("merge"), "next")
            steps.append(grown.groupBy("last_edge", "at").agg(F.min(F.col("left") + F.col("length")).alias("left")))
        done += TURNS_A_ROUND
        front = reduce(DataFrame.unionByName, [step.withColumn("m", none).withColumn("gone_on", F.lit(step is not steps[-1])) for step in steps[1:]])


def _exhausted(firsts: DataFrame, turns: DataFrame, most: int) -> DataFrame:
    """Those first edges from which no further edge can be reached after so many turns."""
    front = firsts.select("first", F.col("first").alias("at"))
    reach = written(front.withColumn("new", F.lit(True)))
    for _ in range(-(-most // TURNS_A_ROUND)):
        steps = [reach.where("new").select("first", "at")]
        for _ in range(TURNS_A_ROUND):
            steps.append(steps[-1].join(turns.hint("merge"), "at").select("first", F.col("next").alias("at")).distinct())
        grown = [step.withColumn("new", F.lit(step is steps[-1])) for step in steps[1:]]
        # what the turns before the last reach has gone on already
        now = written(reduce(DataFrame.unionByName, grown, reach.withColumn("new", F.lit(False))).groupBy("first", "at").agg(F.min("new").alias("new")))
        drop_written(reach)
        reach = now
    return reach.groupBy("first").agg(F.max("new").alias("open")).where("not open").select("first")


def _parts(keys: DataFrame, edges: DataFrame, connections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with the first edge's length m, turns with the next edge's), as written tables."""
    ids = edges.select(F.col("edge_id").cast("bigint").alias("next"), F.floor(F.col("length") * 1000).alias("m"))
    turns = written(connections.select(F.col("from_edge").cast("bigint").alias("at"), F.col("to_edge").cast("bigint").alias("next")).distinct().join(ids, "next"))
    asked = keys.select(*[F.col(c).cast("bigint").alias(c) for c in PAIR]).distinct()
    known = ids.select(F.col("next").alias("last_edge"))
    return written(asked.join(ids.withColumnRenamed("next", "first_edge"), "first_edge").join(known, "last_edge", "left_semi").select(*PAIR, "m")), turns


def least_lengths(keys: DataFrame, edges: DataFrame, connections: DataFrame) -> DataFrame:
    """(first_edge, last_edge, milli): the length of the shortest way of each pair that has one."""
    found = distances(*_parts(keys, edges, connections)).where("m is not null and left is not null")
    return found.select(F.col("at").alias("first_edge"), "last_edge", (F.col("m") + F.col("left")).alias("milli"))


def _least_from(path: tuple, milli: int, barred: set, last: int, steps: dict, most: float) -> tuple[int, tuple] | None:
    """The least (milli, path) to ``last`` that begins with ``path``, goes on by none of ``barred`` and is at most ``most``.

    ``steps`` has (next, m, rest) of each edge; rest is the exact least length after next, so that
    what is popped goes towards the end, and each edge is left once at most.
    """
    heap, shut = [(milli, path, milli)], set(path[:-1])
    while heap:
        _, way, milli = heappop(heap)
        at = way[-1]
        if at == last:
            return milli, way
        if at in shut:
            continue
        shut.add(at)
        for edge, m, rest in steps.get(at, ()):
            if edge not in shut and milli + m + rest <= most and not (edge in barred and len(way) == len(path)):
                heappush(heap, (milli + m + rest, (*way, edge), milli + m))
    return None


def _least_ways(first: int, m: int, low: int, last: int, steps: dict, k: int, stretch: float) -> Iterator[tuple[int, tuple]]:
    """The ``k`` least (milli, path) from ``first`` to ``last``, in order.

    What is left to find is in classes (root, barred): ways that begin with the root and go on by none of the
    barred edges. A way that is taken splits its class by the place where others leave it, so each way is in
    just one. A class is searched only once no other can have a lesser way.
    """
    most, heap, n = low * stretch, [(low, (first,), False, 1, m, frozenset())], 0
    while heap and n < k:
        milli, path, whole, spur, own, barred = heappop(heap)
        if not whole:
            found = _least_from(path, own, barred, last, steps, most)
            if found:
                heappush(heap, (*found, True, spur, own, barred))
            continue
        yield milli, path
        n += 1
        for at in range(spur, len(path)):
            shut, root = barred | {path[at]}, path[:at]
            least = min((own + m + rest for edge, m, rest in steps[path[at - 1]] if edge not in shut and edge not in root), default=most + 1)
            if least <= most:
                heappush(heap, (least, root, False, at, own, shut))
            own, barred = own + next(m for edge, m, _ in steps[path[at - 1]] if edge == path[at]), frozenset()


def _ways_in_task(k: int, stretch: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by (last_edge, part), the ways of each part's pairs; rows of pairs have no next."""
    schema = pa.schema([("first_edge", pa.int64()), ("last_edge", pa.int64()), ("rank", pa.int64()), ("milli", pa.int64()), ("path", pa.string())])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in WAY_ROW], strict=True))
        for (last, _), group in groupby(rows, itemgetter(0, 1)):
            pairs, steps = [], defaultdict(list)
            for _, _, at, edge, m, rest in group:
                if edge is None:
                    pairs.append((at, m, m + rest))
                else:
                    steps[at].append((edge, m, rest))
            for first, m, low in pairs:
                for rank, (milli, path) in enumerate(_least_ways(first, m, low, last, steps, k, stretch), 1):
                    yield first, last, rank, milli, " ".join(map(str, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ways(batches)
        while some := list(islice(found, WAYS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    return run


def best_ways(keys: DataFrame, edges: DataFrame, connections: DataFrame, k: int = 1, stretch: float = 1.0, together: int = PAIRS_TOGETHER) -> DataFrame:
    """(first_edge, last_edge, rank, milli, path): the ``k`` shortest loop-free ways of each pair of edges.

    Ways longer than ``stretch`` times the shortest are left out; ties go by the edges' ids in order.
    A way has no edge twice. Least lengths to the last edges are sought for all pairs at once (``distances``). The
    turns that lie within ``stretch`` of a last edge go to a task once for each ``together`` of its pairs, and there
    each way after the shortest is the least that deviates from those before it (``_least_ways``), so that
    no partial way is a row. Each distinct pair is sought once; pairs
    without a way, or with unknown edges, have no row. Edges have lengths of a thousandth at least.
    """
    pairs, turns = _parts(keys, edges, connections)
    found = distances(pairs, turns, stretch if k > 1 else 1.0)
    asked = found.where("m is not null and left is not null").select("last_edge", "at", F.lit(None).cast("bigint").alias("next"), "m", F.col("left").alias("rest"))
    bound = asked.groupBy("last_edge").agg((F.max(F.col("m") + F.col("rest")) * stretch).alias("most"), F.ceil(F.count(F.lit(1)) / together).alias("parts"))
    near = found.where("left is not null").select("last_edge", F.col("at").alias("next"), F.col("left").alias("rest")).join(bound.hint("merge"), "last_edge").where("rest <= most")
    steps = near.join(turns.hint("merge"), "next").where("m + rest <= most").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = asked.join(bound.hint("merge"), "last_edge").withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")))
    # a number of its own, since few bytes are much work here
    salts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select(*WAY_ROW).unionByName(steps.select(*WAY_ROW)).repartition(salts, "last_edge", "part").sortWithinPartitions("last_edge", "part")
    return rows.mapInArrow(_ways_in_task(k, stretch), "first_edge bigint, last_edge bigint, rank bigint, milli bigint, path string")
