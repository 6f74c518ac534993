"""Operators on small frames whose results are worked out by hand."""

import random
from pathlib import Path

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlake.functions import formulas as fm
from roadlake.functions.storage import drop_written, written
from roadlake.operators import congestion, graph, gravity, planning, records, scenario, selection, sequences, similarity
from roadlake.operators.components import connected_components


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def routes(spark, **lists):
    return spark.createDataFrame([(k, p, e) for k, es in lists.items() for p, e in enumerate(es)], "route_id string, pos bigint, edge_id bigint")


@pytest.fixture(scope="module")
def tiny(spark):
    """1 -> 2 -> 3 -> 4 -> 1 with a pair of reversals between 2 and 5, and a dead end 4 -> 6."""
    data = [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 1), (5, 2, 5), (6, 5, 2), (7, 4, 6)]
    return spark.createDataFrame([(*d, 10.0 * d[0], 5.0, 1 + d[0] % 2) for d in data], "edge_id bigint, fj bigint, tj bigint, length double, speed double, lanes bigint").cache()


def test_congestion_index(spark):
    df = spark.createDataFrame([(20.0, 10.0), (10.0, 10.0), (5.0, 10.0), (0.0, 10.0), (None, 10.0), (30.0, 10.0)], "t double, f double")
    assert [r[0] for r in df.select(fm.congestion_index(F.col("t"), F.col("f"))).collect()] == [0.5, 0.0, 0.0, 0.0, 0.0, 0.667]


def test_units_round_half_to_even(spark):
    df = spark.createDataFrame([(1,), (10,), (30,), (5,)], "c bigint")
    assert [tuple(r) for r in df.select(fm.light_units(F.col("c")), fm.medium_units(F.col("c"))).collect()] == [(1, 0), (4, 4), (10, 12), (2, 2)]


def test_shapes(spark):
    df = spark.createDataFrame([("1,2 3,4.5",), ("",), (None,)], "s string").select(fm.parsed_shape(F.col("s")).alias("p"))
    assert [[tuple(p) for p in r["p"]] for r in df.collect()] == [[(1.0, 2.0), (3.0, 4.5)], [], []]
    assert [r[0] for r in df.select(fm.shape_text(F.col("p"))).collect()] == ["1.0,2.0 3.0,4.5", "", ""]


def test_means_of_observed_and_of_all_intervals(spark):
    dump = spark.createDataFrame([(1, 0, "a", 20.0, 10.0), (2, 900, "a", 10.0, 10.0), (3, 900, "b", 40.0, 10.0), (4, 900, "b", None, 10.0)], "event_id int, begin bigint, edge_id string, traveltime double, free_flow double")
    cells = congestion.per_interval(dump)
    edges = spark.createDataFrame([("a",), ("b",), ("c",)], "edge_id string")
    assert rows(congestion.mean_over_observed(cells)) == [("a", 2, 250), ("b", 1, 750)]
    assert rows(congestion.mean_over_all(cells, edges)) == [("a", 2.51), ("b", 3.76), ("c", 0.01)]
    assert rows(congestion.difference(congestion.mean_over_observed(cells), congestion.mean_over_observed(cells.where("edge_id = 'a'"))), "edge_id", "diff") == [("a", 0), ("b", 750)]
    assert rows(congestion.mean_over_all(cells.where("false"), edges)) == [("a", 0.01), ("b", 0.01), ("c", 0.01)]


def test_longest_run_takes_the_first_of_equals(spark):
    r = routes(spark, a=[9, 1, 2, 9, 2, 1], b=[9, 9], c=[1], d=[1, 9, 2, 2, 2])
    net = spark.createDataFrame([(1,), (2,), (2,)], "edge_id bigint")
    assert rows(sequences.longest_run(r, net)) == [("a", 1, 3), ("b", 0, 0), ("c", 0, 1), ("d", 2, 5)]
    assert rows(sequences.clipped(r, net, 2)) == [("a", 0, 1), ("a", 1, 2), ("d", 0, 2), ("d", 1, 2), ("d", 2, 2)]


def test_diffs_of_any_lengths(spark):
    rnd = random.Random(4)
    pairs = [([rnd.randint(1, 3) for _ in range(rnd.randint(0, 6))], [rnd.randint(1, 3) for _ in range(rnd.randint(0, 6))]) for _ in range(200)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<int>, b array<int>")
    left, old, new = sequences.changed_slice(F.col("a"), F.col("b"))
    found = df.select("k", "a", "b", left.alias("l"), old.alias("o"), new.alias("n"))
    back = sequences.spliced(F.col("a"), F.col("l"), F.col("o"), F.slice("b", F.col("l") + 1, F.col("n") - F.col("l")))
    for r in found.withColumn("back", back).collect():
        assert r["back"] == r["b"]
        assert r["a"][: r["l"]] == r["b"][: r["l"]] and r["a"][r["o"] :] == r["b"][r["n"] :]
        assert r["a"] != r["b"] or r["l"] == r["o"] == r["n"] == len(r["a"])


def test_equal_routes_share_an_id(spark):
    data = [(k, p, e) for k, es in {30: [1, 2], 10: [3], 20: [1, 2], 5000: [3], 9000: [4]}.items() for p, e in enumerate(es)]
    df = spark.createDataFrame(data, "route_id bigint, pos bigint, edge_id bigint")
    assert rows(sequences.reindexed(df), "route_id", "new_id") == [(10, "r0"), (20, "r1"), (30, "r1"), (5000, "r0"), (9000, "r2")]


def test_graph_parts(spark, tiny):
    con = graph.connections(tiny)
    assert rows(con) == [(1, 2), (1, 5), (2, 3), (3, 4), (3, 7), (4, 1), (5, 6), (6, 2), (6, 5)]
    assert rows(graph.reversals(tiny, con)) == [(5, 6), (6, 5)]
    assert rows(graph.without_lone_reversals(tiny, con)) == [(1, 2), (1, 5), (2, 3), (3, 4), (3, 7), (4, 1), (6, 2), (6, 5)]
    assert rows(graph.fringe(tiny, con)) == [(6, "end")]
    assert rows(graph.inner_junctions(tiny, con)) == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(graph.removable(tiny)) == [(1,), (3,)]
    chains = graph.contracted(tiny, graph.removable(tiny))
    assert rows(chains) == [("2 3", 2, 4, 2, 50.0, False), ("4 1", 4, 2, 2, 50.0, False), ("5", 2, 5, 1, 50.0, False), ("6", 5, 2, 1, 60.0, False), ("7", 4, 6, 1, 70.0, False)]


def test_set_operations_on_graphs(spark, tiny):
    a, b = tiny.where("edge_id <= 5"), tiny.where("edge_id >= 4")
    ids = lambda df: [r[0] for r in rows(df, "edge_id")]
    assert ids(graph.union(a, b)) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(graph.minus(a, b)) == [1, 2, 3]
    assert ids(graph.symmetric_difference(a, b)) == [1, 2, 3, 6, 7]
    assert ids(graph.intersection(a, b)) == [1, 4, 5]
    assert graph.equality(a, a).first()["equal"] and not graph.equality(a, b).first()["equal"]


def test_paths_are_loop_free_and_complete(spark, tiny):
    got = rows(graph.bounded_paths(tiny, F.col("fj") == 1, 3), "path")
    assert set(got) == {("1",), ("1 2",), ("1 2 3",), ("1 5",)}
    double = tiny.select("edge_id", "fj", "tj", "length").unionByName(spark.createDataFrame([(8, 1, 3, 100.0)], "edge_id bigint, fj bigint, tj bigint, length double"))
    top = graph.top_paths(graph.bounded_paths(double, F.col("fj") == 1, 3), 2, 4.0)
    assert rows(top.where("target = 3"), "rank", "path") == [(1, "1 2"), (2, "8")]


def test_top_paths_of_each_start_and_target(spark, tiny):
    top = graph.top_paths(graph.bounded_paths(tiny, F.col("fj").isin(1, 2), 3), 1, 1.3)
    assert rows(top.where("target = 3"), "start", "rank", "path") == [(1, 1, "1 2"), (2, 1, "2")]


def test_jaccard_same_as_all_pairs(spark):
    rnd = random.Random(2)
    sets = {f"r{k:02}": sorted(rnd.sample(range(12), rnd.randint(1, 6))) + [100] for k in range(40)}
    for least in (0.3, 0.5, 0.8, 1.0):
        want = sorted((a, b, len({*x} & {*y}), len({*x} | {*y})) for a, x in sets.items() for b, y in sets.items() if a < b and len({*x} & {*y}) >= least * len({*x} | {*y}) - 1e-9)
        assert rows(similarity.jaccard_at_least(routes(spark, **sets), least)) == want


def test_similar_routes_meet_at_edges(spark):
    """Pairs are counted inside tasks, at the first edge that both have, in blocks of any size; no candidate is a row."""
    rnd = random.Random(5)
    sets = {k: sorted(rnd.sample(range(30), rnd.randint(1, 5))) + [100] for k in range(60)}
    frame = similarity.rarest_first(routes(spark, **{f"r{k:02}": s for k, s in sets.items()}))

    def emit(batch, chunks):
        for i, j, shared, total in chunks:
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), batch.column("id").take(pa.array(j)), pa.array(shared), pa.array(total)], ["a", "b", "shared", "total"])

    want = sorted((f"r{a:02}", f"r{b:02}", len({*x} & {*y}), len({*x} | {*y})) for a, x in sets.items() for b, y in sets.items() if a < b)
    for block in (7, 1024):
        assert rows(similarity.of_sharing(frame, F.size("edges"), emit, "a string, b string, shared bigint, total bigint", block=block)) == want
    plan = similarity.jaccard_at_least(routes(spark, a=[1, 2], b=[1, 2, 3]), 0.5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Aggregate [a#" not in plan, "candidates are rows"


def test_equal_sets_stand_for_their_copies(spark):
    rnd = random.Random(3)
    sets = {k: sorted(rnd.sample(range(8), 4)) for k in range(60)}
    long = spark.createDataFrame([(r, p, e) for r, s in sets.items() for p, e in enumerate(s + s[:1])], "route_id bigint, pos bigint, edge_id bigint")
    equal = similarity.equal_sets(long)
    root = {r: min(o for o, t in sets.items() if t == s) for r, s in sets.items()}
    assert dict(rows(equal, "id", "root")) == root
    ids = spark.createDataFrame([(r,) for r in sets], "id bigint")
    for least, samples in ((0.6, 2), (0.6, 9), (1.0, 3)):
        every = similarity.density_clusters(ids, similarity.jaccard_at_least(long, least), samples)
        close = similarity.jaccard_at_least(long.join(equal.where("id = root").select(F.col("id").alias("route_id")), "route_id", "left_semi"), least)
        few = dict(rows(similarity.density_clusters(similarity.copies(equal), close, samples), "id", "label"))
        assert {r: few[o] for r, o in root.items()} == dict(rows(every, "id", "label"))


def test_average_similarity_counts_copies(spark):
    sets = {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 4], 4: [1, 2, 3], 5: [1, 2, 4]}
    label = {1: 1, 2: 1, 3: -1, 4: 1, 5: -1}
    roots = spark.createDataFrame([(1, 1, 3), (3, -1, 2)], "id bigint, label bigint, n bigint")
    pairs = spark.createDataFrame([(1, 3, 2, 4)], "a bigint, b bigint, shared bigint, total bigint")
    alike = lambda x, y: len({*sets[x]} & {*sets[y]}) * 1_000_000 // len({*sets[x]} | {*sets[y]})
    want = [(k, label[k], *(sum(alike(k, o) for o in sets if o != k and (label[o] == label[k]) == same) for same in (True, False))) for k in (1, 3)]
    assert rows(similarity.average_similarity(roots, pairs), "id", "label", "inside", "outside") == want


def test_rankings_by_all_similarities(spark):
    """Every pair counts, whatever it shares, in blocks of any size; copies stand for themselves."""
    rnd = random.Random(8)
    sets = [(k, rnd.choice([-1, 1, 2, 3]), rnd.randint(1, 3), sorted(rnd.sample(range(12), rnd.randint(1, 6)))) for k in range(50)] + [(90, 9, 1, [3, 4])]
    frame = spark.createDataFrame(sets, "id bigint, label bigint, n bigint, edges array<bigint>")
    sim = lambda a, b: len({*a} & {*b}) * 1_000_000 // len({*a} | {*b})
    want = []
    for i, label, n, e in sets:
        size = sum(x[2] for x in sets if x[1] == label)
        want.append((i, label, n, size, sum(sim(e, x[3]) * x[2] for x in sets), sum(sim(e, x[3]) * x[2] for x in sets if x[1] == label)))
    for block in (7, 2048):
        sums = similarity.similarity_sums(frame, block)
        assert rows(sums) == sorted(want, key=repr)
    total = sum(x[2] for x in sets)
    for metric, down in (("average_similarity", True), ("average_dissimilarity", False), ("maximal_similarity", True), ("minimal_similarity", False)):
        score = {w[0]: ((w[5] - 10**6) // (w[3] - 1) if w[3] > 1 else 0) if "average" in metric else (w[4] - w[5]) // total for w in want}
        members = {}
        for w in want:
            members.setdefault(w[1], []).append(w)
        mean = {c: sum(score[w[0]] * w[2] for w in m) // sum(w[2] for w in m) for c, m in members.items()}
        sign = -1 if down else 1
        order = sorted(members, key=lambda c: (sign * mean[c] if "average" in metric else 0, c))
        out = [(w[0], c, score[w[0]], order.index(c) + 1, k) for c, m in members.items() for k, w in enumerate(sorted(m, key=lambda w: (sign * score[w[0]], w[0])), 1)]
        assert rows(similarity.ranked_by(sums, metric)) == sorted(out, key=repr)


def test_density_clusters(spark):
    ids = spark.range(10).withColumn("id", F.col("id"))
    close = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (6, 7), (5, 7)], "a bigint, b bigint")
    got = dict(rows(similarity.density_clusters(ids, close, 3)))
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 4: -1, 8: -1, 9: -1}
    picks = similarity.round_robin(spark.createDataFrame([(1, 7, 3), (2, 7, 1), (3, 8, 9)], "id int, label int, score int"), 2)
    assert rows(picks, "id", "rank") == [(2, 1), (3, 1)]


def plain_merge(points, radius):
    """Each point in turn takes in all that are near; (points left, leader of each)."""
    now = {i: [x, y, w] for i, x, y, w in points}
    lead = {i: i for i in now}
    for i in sorted(now):
        if i not in now:
            continue
        near = [j for j in now if (now[j][0] - now[i][0]) ** 2 + (now[j][1] - now[i][1]) ** 2 < radius * radius]
        if len(near) > 1:
            top = min((j for j in near), key=lambda j: (-now[j][2], j))
            top = i if now[i][2] >= now[top][2] else top
            n = len(near)
            new = [sum(now[j][0] for j in near) // n, sum(now[j][1] for j in near) // n, sum(now[j][2] for j in near)]
            for j in near:
                if j != top:
                    del now[j]
                    lead = {k: top if v == j else v for k, v in lead.items()}
            now[top] = new
    return sorted((i, *p) for i, p in now.items()), lead


def plain_clusters(points, radius, iterations):
    now = [(r["id"], r["x"] * 1000, r["y"] * 1000, r["w"]) for r in points.collect()]
    lead = {p[0]: p[0] for p in now}
    for _ in range(iterations):
        pull = lambda p, k: sum((1 if o[k] >= p[k] else -1) * (abs(o[k] - p[k]) * o[3] * 10**6 // max(1, (o[1] - p[1]) ** 2 + (o[2] - p[2]) ** 2)) for o in now)  # noqa: B023, E731
        now, to = plain_merge([(p[0], p[1] + pull(p, 1), p[2] + pull(p, 2), p[3]) for p in now] if len(now) > 1 else now, round(radius * 1000))
        lead = {i: to[j] for i, j in lead.items()}
    return sorted(lead.items(), key=repr)


@pytest.mark.parametrize("seed, n, size, radius, order", [(1, 2000, 3000, 20, "random"), (2, 1200, 700, 15, "random"), (3, 400, 3000, 30, "line"), (4, 600, 60, 3, "line")])
def test_merge_in_order_is_that_of_a_loop(spark, seed, n, size, radius, order):
    """Points over many tiles, dense ones, ids along a line, equal places and weights."""
    rnd = random.Random(seed)
    place = sorted((rnd.randint(-size, size), rnd.randint(-size, size) if order == "random" else rnd.randint(0, 9)) for _ in range(n))
    if order == "random":
        rnd.shuffle(place)
    points = [(3 * k, *p, rnd.randint(1, 4)) for k, p in enumerate(place)] + [(3 * k + 1, 5, 5, 2) for k in range(20)]
    left, to = gravity.merged_in_order(spark.createDataFrame(points, "id bigint, x bigint, y bigint, w bigint").repartition(3), radius)
    want, lead = plain_merge(points, radius)
    assert rows(left, "id", "x", "y", "w") == sorted(want, key=repr)
    assert dict(rows(to, "id", "leader")) == lead


def test_a_pass_that_was_out_of_order_is_repeated(spark, monkeypatch):
    """With a reach below two radii acts do get out of order; the check sees it."""
    rnd = random.Random(11)
    points = [(k, rnd.randint(0, 900), rnd.randint(0, 900), rnd.randint(1, 9)) for k in range(900)]
    table = spark.createDataFrame(points, "id bigint, x bigint, y bigint, w bigint")
    tried = []
    real = gravity._in_order

    def first_too_short(slots, radius, reach):
        out = real(slots, radius, 30 if not tried else reach)
        tried.append(out[2])
        return out

    monkeypatch.setattr(gravity, "_in_order", first_too_short)
    left, _ = gravity.merged_in_order(table, 30)
    assert tried[0] is False and tried[-1] is True
    assert rows(left, "id", "x", "y", "w") == sorted(plain_merge(points, 30)[0], key=repr)


def test_tiles_are_as_wide_as_their_slots_are_few(spark, monkeypatch):
    """Slots far apart share tiles instead of having one each; clustered ones don't fill a tile; the merge is that of a loop."""
    monkeypatch.setattr(gravity, "TILE_SLOTS", 100)
    monkeypatch.setattr(gravity, "MOST_SLOTS", 300)
    rnd = random.Random(13)
    far = [(k, rnd.randint(0, 30_000), rnd.randint(0, 30_000), rnd.randint(1, 9)) for k in range(600)]
    near = far + [(1000 + k, 9_000 + rnd.randint(0, 2_000), rnd.randint(0, 2_000), rnd.randint(1, 9)) for k in range(600)]
    for points in (far, near):
        table = spark.createDataFrame(points, "id bigint, x bigint, y bigint, w bigint")
        side, n = gravity._side(table, 160)
        tiles = [r["count"] for r in table.groupBy((F.col("x") / side).cast("int"), (F.col("y") / side).cast("int")).count().collect()]
        assert n == len(points) and side > 160 and max(tiles) <= 300 and (points is near or len(tiles) <= 32)
        left, to = gravity.merged_in_order(table, 5)
        want, lead = plain_merge(points, 5)
        assert rows(left, "id", "x", "y", "w") == sorted(want, key=repr) and dict(rows(to, "id", "leader")) == lead
    assert gravity._side(table.where("false"), 160) == (160, 0)


def test_ordered_clusters_in_tiles_and_in_one_task(spark):
    rnd = random.Random(12)
    points = spark.createDataFrame([(k, rnd.randint(0, 120), rnd.randint(0, 120), rnd.randint(1, 3)) for k in range(150)], "id bigint, x bigint, y bigint, w bigint")
    want = plain_clusters(points, 4.0, 3)
    assert rows(gravity.ordered_clusters(points, 4.0, 3), "id", "leader") == want
    assert rows(gravity.ordered_clusters(points, 4.0, 3, few=20), "id", "leader") == want


def test_gravity(spark):
    points = spark.createDataFrame([(1, 0, 0, 1), (2, 3, 4, 5), (3, 100, 100, 1), (4, 104, 100, 2), (5, 108, 100, 2)], "id bigint, x bigint, y bigint, w bigint")
    assert rows(gravity.mutual_neighbours(points, 10)) == [(1, 2, 25), (3, 4, 16)]
    near = rows(gravity.moved(points.where("id < 3")))
    assert near == [(1, 600, 800), (2, -120, -160)]
    assert rows(gravity.grid_clusters(points, 10, 5)) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]
    assert rows(gravity.ordered_clusters(points, 6.0, 5), "id", "leader") == plain_clusters(points, 6.0, 5)


def test_mutual_neighbours_of_dense_points_without_pair_rows(spark, monkeypatch):
    drawn = random.Random(8)
    table = [(i, drawn.randint(-wide, wide), drawn.randint(-wide, wide)) for i, wide in enumerate([30] * 700 + [900] * 200)]

    def closest(i, x, y):
        return min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in table if j != i)

    near = {i: closest(i, x, y) for i, x, y in table}
    want = sorted(((i, j, d) for i, (d, j) in near.items() if i < j and d <= 20 * 20 and near[j][1] == i), key=repr)
    monkeypatch.setattr(gravity, "BLOCK_PLACES", 100)
    monkeypatch.setattr(gravity, "CANDIDATES", 50)
    found = gravity.mutual_neighbours(spark.createDataFrame(table, "id bigint, x bigint, y bigint").repartition(5), 20)
    assert rows(found) == want
    assert "Join" not in found._jdf.queryExecution().toString()


def test_grid_clusters_merge_all_there_is(spark):
    same = [(k, 5, 5, 1) for k in range(100)]
    row = [(100 + k, 1000 + 3 * k, 0, 1) for k in range(40)]
    points = spark.createDataFrame(same + row + [(200, 9000, 0, 1)], "id bigint, x bigint, y bigint, w bigint")
    assert gravity.mutual_neighbours(points.where("id < 100"), 200).collect() == [(0, 1, 0)]
    got = sorted(map(tuple, gravity.grid_clusters(points, 200).collect()))
    assert got == [(k, 0) for k in range(100)] + [(k, 100) for k in range(100, 140)] + [(200, 200)]


def test_plans_replay_with_costs(spark, tiny):
    facts = [("p", f) for f in ["(connected j1 r1 j2)", "(connected j2 r2 j3)", "(= (length-light r1) 7)", "(= (length-medium r1) 70)", "(= (length-light r2) 5)", "(cap r1 use2)", "(cap r2 use1)", "(using r1 use0)", "(using r2 use0)", "(light r1 use0)", "(medium r1 use1)", "(light r2 use0)", "(at v1 j1)", "(at v2 j1)", "(togo v1 j3)", "(togo v2 j3)"]]
    steps = ["(drive-to-light v1 j1 r1 j2 use0 use1)", "(drive-to-medium v2 j1 r1 j2 use1 use2)", "(drive-to-light v1 j2 r2 j3 use0 use1)", "(drive-to-congested v2 j2 r2 j3 use1)"]
    problems = spark.createDataFrame(facts + [("q", f) for _, f in facts], "problem string, fact string")
    plans = spark.createDataFrame([("p", k, s) for k, s in enumerate(steps)] + [("q", 0, steps[3])], "problem string, step int, value string")
    assert rows(planning.replayed(problems, plans)) == [("p", 4, 7 + 70 + 5 + 100_000, 2, True), ("q", 1, 5, 1, False)]


def test_scenarios(spark):
    first = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d"])], "route_id int, edges array<string>")
    one = spark.createDataFrame([(1, ["a", "x"]), (2, ["c"])], "route_id int, edges array<string>")
    two = spark.createDataFrame([(1, ["a", "b"]), (2, ["y"])], "route_id int, edges array<string>")
    assert rows(scenario.merged_changes(first, [one, two])) == [(1, ["a", "x"]), (2, ["y"]), (3, ["d"])]
    assert tuple(scenario.change_report(first, two).first()) == (2, 1, 1, 1)


def test_skyline_and_crowding(spark):
    rnd = random.Random(7)
    data = [(k, rnd.randint(0, 9000), rnd.randint(0, 9000)) for k in range(300)] + [(1000, 0, 0)] * 2 + [(1001, 0, 5)]
    df = spark.createDataFrame(data, "id int, a bigint, b bigint")
    best = lambda d: sorted({x for x in d if not any(y[1] <= x[1] and y[2] <= x[2] and y[1:] != x[1:] for y in d)})
    assert sorted({tuple(r) for r in selection.pareto_front(df, "a", "b").select("id", "a", "b").collect()}) == best(data)
    assert sorted({tuple(r) for r in selection.pareto_front(df.where("id < 300"), "a", "b").select("id", "a", "b").collect()}) == best(data[:300])


def test_tag_conditions(spark):
    df = spark.createDataFrame([(1, {"highway": "primary", "lanes": "3"}), (2, {"highway": "path"}), (3, {"name": "Main Street", "lanes": "x"}), (4, {})], "id int, tags map<string,string>")
    pick = lambda text: [r["id"] for r in df.where(selection.tag_condition(text)).collect()]
    assert pick("highway=primary") == [1]
    assert pick("highway=") == [1, 2]
    assert pick("highway!=path") == [1, 3, 4]
    assert pick("highway=p*") == [1, 2] and pick("name=*Street") == [3] and pick("name=*in*") == [3]
    assert pick("lanes>2") == [1, 3] and pick("lanes<=3") == [1]
    assert pick("name=Main* or highway=path and lanes>1") == [3]
    assert pick("( name=Main* or highway=p* ) and lanes=*") == [1, 3]
    for bad in ("( a=1", "a=1 b=2", "a", "a=1 and"):
        with pytest.raises(ValueError):
            selection.tag_condition(bad)


def test_flows(spark):
    assert [r["depart"] for r in selection.uniform_flow(spark, 0, 10, 5).orderBy("vehicle_id").collect()] == [0, 250, 500, 750, 1000]
    got = selection.random_flow(spark, 0, 3000, 300, 2, 4, 1)
    sizes = got.groupBy(F.floor(F.col("depart") / 30000)).count().collect()
    assert len(sizes) == 10 and all(2 <= r["count"] <= 4 for r in sizes)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 99), (7, 7), (500, 500), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))))
    assert got == {k: 0 for k in range(31)} | {99: 99, 100: 99, 500: 500}


def test_written_tables_can_be_dropped(spark):
    df = written(spark.range(5))
    assert df.count() == 5
    drop_written(df)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        df.count()
    empty = written(spark.range(0))
    folder = Path(empty._written_to)
    assert folder.exists()
    drop_written(empty)
    assert not folder.exists()


def test_chains_of_any_length(spark):
    """A road of 200 edges between two junctions where it ends."""
    road = spark.createDataFrame([(k, k, k + 1, 1.0) for k in range(200)] + [(500, 0, 900, 1.0), (501, 901, 0, 1.0), (502, 200, 902, 1.0), (503, 903, 200, 1.0)], "edge_id bigint, fj bigint, tj bigint, length double")
    chains = {(r["fj"], r["tj"]): r["n_edges"] for r in graph.contracted(road, graph.removable(road)).collect()}
    assert chains[(0, 200)] == 200


def test_positions_in_chains_and_rings(spark):
    """A chain of 10,000 in at most 20 rounds, short chains and rings of many sizes, a chain without its start."""
    from roadlake.operators import chains

    rnd = random.Random(5)
    order, at, links, want = rnd.sample(range(20_000), 20_000), 0, [], {}
    for size, closed in [(10_000, False), (1, False), (2, False), (7, False), (1, True), (2, True), (3, True), (64, True), (100, True), (777, True)]:
        part = order[at : at + size]
        at += size
        part = part[part.index(min(part)) :] + part[: part.index(min(part))] if closed else part
        links += [(n, part[k - 1] if k or closed else None) for k, n in enumerate(part)]
        want |= {n: (part[0], k, closed) for k, n in enumerate(part)}
    lost = order[at : at + 5]
    links += list(zip(lost[1:], lost, strict=False))
    found, rounds = chains.positions(spark.createDataFrame(links, "node bigint, before bigint"))
    got = {r["node"]: (r["start"], r["rank"], r["closed"]) for r in found.collect()}
    assert got == want
    line = spark.createDataFrame([(k, k - 1 if k else None) for k in range(10_000)], "node bigint, before bigint")
    assert chains.positions(line)[1] <= 20


def test_closed_rings_are_chains_of_their_own(spark):
    ring = [(10 + k, 100 + k, 100 + (k + 1) % 4, 1.0) for k in range(4)] + [(50, 1, 2, 1.0), (51, 2, 3, 1.0)]
    edges = spark.createDataFrame(ring, "edge_id bigint, fj bigint, tj bigint, length double")
    assert rows(graph.contracted(edges, graph.removable(edges))) == [("10 11 12 13", 100, 100, 4, 4.0, True), ("50 51", 1, 3, 2, 2.0, False)]


def plain_simplified(net, ring):
    """One junction after another, then the ring, then junctions again."""
    edges = {(str(e),): (str(a), str(b)) for e, a, b in net}
    kept = {edges[(str(e),)][0] for e in ring}
    while True:
        while True:
            into, out = {}, {}
            for e, (a, b) in edges.items():
                out.setdefault(a, []).append(e)
                into.setdefault(b, []).append(e)
            for j in sorted(into.keys() & out.keys()):
                sources, targets = [edges[e][0] for e in into[j]], [edges[e][1] for e in out[j]]
                one = len(sources) == len(targets) == 1 and sources != targets
                two = len(sources) == len(targets) == 2 == len(set(sources)) and set(sources) == set(targets)
                if (one or two) and j not in kept and j not in sources:
                    for e in into[j]:
                        f = next(f for f in out[j] if edges[f][1] != edges[e][0])
                        edges[e + f] = (edges[e][0], edges[f][1])
                    for e in {*into[j], *out[j]}:
                        del edges[e]
                    break
            else:
                break
        if not kept:
            return sorted((" ".join(e), a, b) for e, (a, b) in edges.items())
        node = f"r{min(ring)}"
        edges = {e: tuple(node if j in kept else j for j in ends) for e, ends in edges.items() if e not in {(str(x),) for x in ring}}
        kept = set()


def test_simplified_is_that_of_one_junction_after_another(spark):
    """A roundabout of four with two arms that go on as chains once it is a node, and a two-way road beside."""
    net = [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 1), (5, 50, 51), (6, 51, 1), (7, 3, 60), (8, 60, 61), (9, 61, 62)]
    net += [(20, 70, 71), (21, 71, 70), (22, 71, 72), (23, 72, 71), (24, 72, 73), (25, 73, 72), (26, 73, 90), (27, 73, 91)]
    edges = spark.createDataFrame([(*e, 1.0) for e in net], "edge_id bigint, fj bigint, tj bigint, length double")
    found, passes = graph.simplified(edges, spark.createDataFrame([("1 2 3 4",)], "ring string"))
    assert rows(found, "edge_id", "fj", "tj") == plain_simplified(net, [1, 2, 3, 4])
    assert ("5 6 7 8 9", "50", "62") in rows(found, "edge_id", "fj", "tj") and passes == 3


def test_places_within_groups(spark):
    rnd = random.Random(6)
    data = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randint(0, 9), k) for k in range(500)]
    got = rows(sequences.placed(spark.createDataFrame(data, "g string, v int, id int").repartition(7), "g", ["v", "id"]), "g", "v", "id", "place")
    want, seen = [], {}
    for g, v, k in sorted(data, key=lambda r: r[1:]):
        want.append((g, v, k, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert got == sorted(want, key=repr)


def test_smoothing_by_blocks_is_one_fold(spark):
    rnd = random.Random(7)
    data = [(rnd.randint(1, 3), rnd.randint(0, 40) * 900, k, rnd.uniform(1, 50)) for k in range(400)] + [(9, 0, 999, 7.25)]
    dump = spark.createDataFrame(data, "edge_id bigint, begin bigint, event_id bigint, traveltime double")
    want = []
    for edge in (1, 2, 3, 9):
        values = [t for e, _, _, t in sorted(data, key=lambda r: r[1:3]) if e == edge]
        smooth = values[0]
        for t in values[1:]:
            smooth = smooth * 0.75 + t * 0.25
        want.append((edge, len(values), int(smooth * 1000)))
    for block in (1, 7, 1024):
        assert rows(congestion.smoothed(dump, 0.25, block)) == want


def test_bitmaps_are_sets(spark):
    """Unions, sizes and differences of many random sub-graphs over several buckets."""
    from roadlake.operators import bitmaps

    rnd = random.Random(13)
    edges = [10 * k + 3 for k in range(70_000)]
    ids = spark.createDataFrame(list(enumerate(edges)), "id bigint, edge_id bigint")
    some = rnd.sample(edges, 300) + [edges[0], edges[32767], edges[32768], edges[65535], edges[65536], edges[-1]]
    first, second = ([(rnd.choice(["p", "q", "r"]), rnd.randint(1, 4), rnd.choice(some)) for _ in range(900)] + [(g, 1, 4) for g in "pq"] for _ in range(2))
    make = lambda data: bitmaps.edge_bitmaps(spark.createDataFrame(data * 2, "g string, k int, edge_id bigint"), ["g", "k"], ids)
    sets = lambda data: {g: {e for h, _, e in data if h == g and e in set(some)} for g in "pqr"}
    a, b = sets(first), sets(second)
    want = sorted((g, len(a[g]), len(b[g]), len(a[g] & b[g]), len(a[g] - b[g]), len(b[g] - a[g])) for g in "pqr")
    assert rows(bitmaps.compared(make(first), make(second), ["g"])) == want
    assert rows(bitmaps.edges_of(bitmaps.merged(make(first), ["g"]), ["g"], ids), "g", "edge_id") == sorted(((g, e) for g in a for e in a[g]), key=repr)


def test_moves_in_blocks_are_those_of_all(spark):
    rnd = random.Random(4)
    points = spark.createDataFrame([(k, rnd.randint(0, 50), rnd.randint(0, 50), rnd.randint(1, 5)) for k in range(300)], "id bigint, x bigint, y bigint, w bigint")
    assert rows(gravity.moved(points, 40)) == rows(gravity.moved(points))


def test_pulls_are_whole_and_taken_in_few_places_at_once(monkeypatch):
    """Light and heavy places, near and far, as the plain sum has them; no array is larger than what is taken at once."""
    largest, real = [0], np.maximum
    monkeypatch.setattr(gravity.np, "maximum", lambda a, *rest, **out: (largest.append(a.size), real(a, *rest, **out))[1])
    rnd = random.Random(6)
    for span, heavy, factor in ((40, 3, 1000), (10**6, 10**5, 10**6), (10**8, 5, 1000)):
        x, y, w = ([rnd.randint(a, b) for _ in range(1500)] for a, b in ((-span, span), (-span, span), (0, heavy)))
        want = []
        for k in range(40):
            near = [(x[j] - x[k], y[j] - y[k], w[j]) for j in range(1500)]
            want.append(tuple(sum((1 if d[c] >= 0 else -1) * (abs(d[c]) * d[2] * factor // max(d[0] ** 2 + d[1] ** 2, 1)) for d in near) for c in (0, 1)))
        got = gravity.pulls(np.array(x[:40]), np.array(y[:40]), np.array(x), np.array(y), np.array(w), factor)
        assert list(zip(*(g.tolist() for g in got), strict=True)) == want
    assert 0 < max(largest) <= 32 * 1024


def test_dense_places_are_pulled_without_meeting_each_other(monkeypatch):
    """The pulls of weights that many places have come from a convolution; those of the others, and of far places, are as plain."""
    met, real = [0], np.maximum
    monkeypatch.setattr(gravity.np, "maximum", lambda a, *rest, **out: (met.append(a.size), real(a, *rest, **out))[1])
    rnd = random.Random(7)
    dense = sorted({(rnd.randint(-40, 50), rnd.randint(-60, 20)) for _ in range(3000)})
    for mine, other, factor in ((dense, dense, 1000), (dense[:700], [(x + 90, y - 31) for x, y in dense[500:]], 1000), (dense[:50], [(10**6 + 9 * x, y) for x, y in dense], 1000)):
        w = [rnd.choice((1, 2, 2, 7, 90 + k % 50)) if k % 30 == 0 else rnd.randint(1, 2) for k in range(len(other))]
        met[:] = [0]
        monkeypatch.setattr(gravity, "PAIRS_A_CELL", 2)
        got = gravity.place_pulls(*[np.array(v) for v in (*zip(*mine), *zip(*other), w)], factor)
        for k in range(0, len(mine), 97):
            near = [(x - mine[k][0], y - mine[k][1], v) for (x, y), v in zip(other, w, strict=True)]
            want = [sum((1 if d[c] >= 0 else -1) * (abs(d[c]) * d[2] * factor // max(d[0] ** 2 + d[1] ** 2, 1)) for d in near) for c in (0, 1)]
            assert [int(g[k]) for g in got] == want
        assert sum(met) < len(mine) * len(other) / 10


def test_moves_in_tiles_and_of_odd_points(spark, monkeypatch):
    """Tiles or blocks, many points at a place or one, places that are not known: the same pulls."""
    rnd = random.Random(4)
    points = [(k, rnd.randint(0, 50), rnd.randint(0, 50), rnd.randint(1, 5)) for k in range(300)] + [(300 + k, 7, 7, 1) for k in range(200)]
    table = spark.createDataFrame(points + [(900, None, None, 3), (901, None, None, None)], "id bigint, x bigint, y bigint, w bigint")
    plain = lambda p, c: sum((1 if q[c] >= p[c] else -1) * (abs(q[c] - p[c]) * q[3] * 1000 // max((q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, 1)) for q in at)
    at = [(0, *xy, sum(p[3] for p in points if p[1:3] == xy)) for xy in {p[1:3] for p in points}]
    want = sorted([(p[0], plain(p, 1), plain(p, 2)) for p in points] + [(900, None, None), (901, None, None)], key=repr)
    for side, block in ((10**4, 50_000), (20, 300), (20, 50_000)):
        monkeypatch.setattr(gravity, "SIDE", side)
        assert rows(gravity.moved(table, block)) == want
    assert rows(gravity.moved(table.where("id = 1"))) == [(1, 0, 0)] and gravity.moved(table.where("false")).count() == 0


def all_ways(net, turns, first, last):
    """(milli, path) of every way without an edge twice, least first."""
    after = {}
    for a, b in turns:
        after.setdefault(a, []).append(b)

    def go(path):
        if path[-1] == last:
            yield sum(int(net[e] * 1000) for e in path), path
            return
        for b in after.get(path[-1], ()):
            if b not in path:
                yield from go([*path, b])

    return sorted(go([first])) if first in net and last in net else []


@pytest.mark.parametrize("seed, k, stretch", [(1, 1, 1.0), (2, 2, 3.0), (3, 5, 100.0), (4, 5, 1.6)])
def test_best_ways_are_the_k_shortest(spark, seed, k, stretch):
    from roadlake.operators import paths

    rnd = random.Random(seed)
    net = [(e, rnd.randint(0, 4), rnd.randint(0, 4), float(rnd.randint(1, 4))) for e in range(16)]
    edges = spark.createDataFrame(net, "edge_id bigint, fj bigint, tj bigint, length double")
    turns = {(a[0], b[0]) for a in net for b in net if a[2] == b[1] and a[0] != b[0] and rnd.random() < 0.8}
    keys = {(rnd.randrange(16), rnd.randrange(16)) for _ in range(12)} | {(3, 3), (2, 99), (98, 2)}
    got = paths.best_ways(spark.createDataFrame(list(keys) * 2, "first_edge int, last_edge int"), edges, spark.createDataFrame(list(turns), "from_edge bigint, to_edge bigint"), k, stretch)
    want = []
    for a, b in keys:
        ways = all_ways({e[0]: e[3] for e in net}, turns, a, b)
        want += [(a, b, r, m, " ".join(map(str, p))) for r, (m, p) in enumerate(ways[:k], 1) if m <= ways[0][0] * stretch]
    assert rows(got) == sorted(want, key=repr) and len(want) >= 6


def test_a_pair_without_a_way_ends_with_what_its_first_edge_leads_to(spark):
    """A road of 60 edges leads to the last edge; what leads away from it can't come back."""
    from roadlake.operators import paths

    net = [(e, e, e + 1, 1.0) for e in range(60)] + [(100 + e, 60 + e, 61 + e, 1.0) for e in range(3)]
    edges = spark.createDataFrame(net, "edge_id bigint, fj bigint, tj bigint, length double")
    keys = spark.createDataFrame([(101, 59), (57, 59), (40, 59), (102, 102)], "first_edge bigint, last_edge bigint")
    assert rows(paths.least_lengths(keys, edges, graph.connections(edges)), "first_edge", "milli") == [(102, 1000), (40, 20000), (57, 3000)]
    assert rows(paths.best_ways(keys, edges, graph.connections(edges), 2, 2.0), "first_edge", "milli") == [(102, 1000), (40, 20000), (57, 3000)]


def test_second_way_over_an_edge_that_shorter_ways_reach(spark):
    """Both shortest ways to edge 7 have edge 1; the second way of the pair reaches it later."""
    from roadlake.operators import paths

    net = [(0, 0, 1, 1.0), (1, 1, 2, 1.0), (2, 1, 4, 50.0), (3, 2, 9, 1.0), (4, 2, 3, 1.0), (5, 2, 3, 2.0), (6, 4, 3, 1.0), (7, 3, 1, 1.0)]
    edges = spark.createDataFrame(net, "edge_id bigint, fj bigint, tj bigint, length double")
    got = paths.best_ways(spark.createDataFrame([(0, 3)], "first_edge bigint, last_edge bigint"), edges, graph.connections(edges), 2, 100.0)
    assert rows(got, "rank", "path") == [(1, "0 1 3"), (2, "0 2 6 7 1 3")]


def test_further_ways_take_no_further_jobs(spark):
    """A rank more is no round more, and pairs of one last edge that are dealt to several tasks have the same ways."""
    from roadlake.operators import paths

    rnd = random.Random(9)
    net = [(e, rnd.randint(0, 4), rnd.randint(0, 4), float(rnd.randint(1, 4))) for e in range(18)]
    edges = spark.createDataFrame(net, "edge_id bigint, fj bigint, tj bigint, length double")
    keys, jobs = spark.createDataFrame([(e, 3 + e % 2) for e in range(18)], "first_edge bigint, last_edge bigint"), {}
    for k in (2, 9):
        spark.sparkContext.setJobGroup(f"ways {k}", "")
        found = rows(paths.best_ways(keys, edges, graph.connections(edges), k, 9.0, together=2))
        jobs[k] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ways {k}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == rows(paths.best_ways(keys, edges, graph.connections(edges), 9, 9.0)) and any(r[2] == 9 for r in found)
    assert jobs[9] <= jobs[2]


def test_more_turns_a_round_find_the_same_lengths_in_fewer_jobs(spark, monkeypatch):
    """Ways of more turns may be shorter, and a pair without a way is given up."""
    from roadlake.operators import paths

    rnd = random.Random(14)
    net = [(e, rnd.randint(0, 7), rnd.randint(0, 7), float(rnd.choice((1, 2, 30)))) for e in range(20)] + [(100 + e, 50 + e, 51 + e, 1.0) for e in range(18)]
    edges, turns = spark.createDataFrame(net, "edge_id bigint, fj bigint, tj bigint, length double"), [(a[0], b[0]) for a in net for b in net if a[2] == b[1] and a[0] != b[0]]
    asked, milli, want = [(rnd.randrange(20), rnd.randrange(20)) for _ in range(25)] + [(100, 117), (117, 100), (5, 110)], {e[0]: int(e[3] * 1000) for e in net}, set()
    for first, last in asked:
        least = {first: milli[first]}
        for a, b in turns * len(net):
            if a in least:
                least[b] = min(least.get(b, 10**9), least[a] + milli[b])
        want |= {(first, last, least[last])} if last in least else set()
    jobs = {}
    for n in (1, 3):
        monkeypatch.setattr(paths, "TURNS_A_ROUND", n)
        spark.sparkContext.setJobGroup(f"turns {n}", "")
        found = paths.least_lengths(spark.createDataFrame(asked, "first_edge bigint, last_edge bigint"), edges, spark.createDataFrame(turns, "from_edge bigint, to_edge bigint"))
        assert rows(found, "first_edge", "last_edge", "milli") == sorted(want, key=repr) and (100, 117, 18000) in want
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"turns {n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[3] < jobs[1]


def test_draws_do_not_depend_on_partitions(spark):
    one = selection.random_flow(spark, 0, 3000, 300, 2, 4, 1)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(one.repartition(7)) == rows(selection.random_flow(spark, 0, 3000, 300, 2, 4, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fronts_in_blocks(spark):
    """Fronts of blocks of any size are those that are taken off one by one."""
    rnd = random.Random(4)
    points = [(k, k % 3, rnd.randrange(9), rnd.randrange(30)) for k in range(150)]
    left, front, k = list(points), {}, 0
    beats = lambda p, q: p[1] == q[1] and p[2] <= q[2] and p[3] <= q[3] and p[2:] != q[2:]
    while left:
        k += 1
        best = [p for p in left if not any(beats(q, p) for q in left)]
        front |= {p[0]: k for p in best}
        left = [p for p in left if p not in best]
    frame = spark.createDataFrame(points, "id bigint, g bigint, a bigint, b bigint")
    for block in (7, 1000):
        assert dict(rows(records.fronts(frame, "g", "a", "b", block), "id", "front")) == front
