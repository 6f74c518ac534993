"""The chain from routes to sub-networks against a plain version, one vehicle after another."""

import random

from roadlake.operators import subnetworks as sub

from .test_operators import all_ways, rows


def plain(routes, region, turns, k, stretch, eps, samples, least, picks):
    """(status, firsts, lasts, edges) of each route; a dictionary is the memo."""
    memo, out = {}, {}
    inner = {(a, b) for a, b in turns if a in region and b in region}
    for rid, edges in routes.items():
        best = (0, 0)
        for a in range(len(edges)):
            b = a
            while b < len(edges) and edges[b] in region:
                b += 1
            if b - a > best[1] - best[0]:
                best = (a, b)
        left, right = best
        if right - left < 3:
            out[rid] = ("invalid" if right == left else "short", None, None, None)
            continue
        j = region[edges[left]][0]
        firsts = [e for e in region if region[e][0] == j and (edges[left - 1], e) in turns] if left > 1 else [edges[left]]
        j = region[edges[right - 1]][1]
        lasts = [e for e in region if region[e][1] == j and (e, edges[right]) in turns] if right < len(edges) else [edges[right - 1]]
        key = tuple(sorted(firsts)), tuple(sorted(lasts))
        if key not in memo:
            net = {e: x[2] for e, x in region.items()}
            ways = sorted(w for a in firsts for b in lasts for w in all_ways(net, inner, a, b))[:k]
            ways = [w for w in ways if w[0] <= ways[0][0] * stretch]
            memo[key] = None
            if len(ways) > 1:
                memo[key] = sorted({e for w in chosen(ways, eps, samples, least, picks) for e in w[1]})
        out[rid] = ("found" if memo[key] else "invalid", list(key[0]), list(key[1]), memo[key])
    return out, memo


def chosen(ways, eps, samples, least, picks):
    if len(ways) < least:
        return ways
    close = lambda a, b: len({*a[1]} & {*b[1]}) >= (1 - eps) * len({*a[1]} | {*b[1]}) - 1e-9
    cores = [k for k, a in enumerate(ways) if sum(close(a, b) for b in ways) >= samples]
    name = lambda k: f"{k + 1}"
    label = {k: k for k in cores}
    for _ in cores:
        for a in cores:
            for b in cores:
                if close(ways[a], ways[b]):
                    low = min(label[a], label[b], key=name)
                    label[a] = label[b] = low
    for k, a in enumerate(ways):
        near = [label[c] for c in cores if close(a, ways[c])]
        if k not in label and near:
            label[k] = min(near, key=name)
    if not label:
        return ways
    clusters = {}
    for k in sorted(label):
        clusters.setdefault(label[k], []).append(k)
    turns = sorted((t, ways[k][0], k) for members in clusters.values() for t, k in enumerate(members))
    return [ways[k] for _, _, k in turns[:picks]]


def network(seed):
    rnd = random.Random(seed)
    net = {e: (rnd.randint(0, 6), rnd.randint(0, 6), float(rnd.randint(1, 5))) for e in range(26)}
    turns = {(a, b) for a in net for b in net if a != b and net[a][1] == net[b][0] and rnd.random() < 0.9}
    region = {e: net[e] for e in net if rnd.random() < 0.75}
    after = {a: [b for x, b in turns if x == a] for a in net}
    routes = {}
    for rid in range(60):
        route = [rnd.randrange(26)]
        while after[route[-1]] and len(route) < rnd.randint(1, 9):
            route.append(rnd.choice(after[route[-1]]))
        routes[rid] = route
    return net, turns, region, routes


def frames(spark, net, turns, region, routes):
    edges = spark.createDataFrame([(e, *x) for e, x in net.items()], "edge_id bigint, fj bigint, tj bigint, length double")
    return (
        spark.createDataFrame([(r, p, e) for r, es in routes.items() for p, e in enumerate(es)], "route_id bigint, pos bigint, edge_id bigint"),
        edges.where(edges["edge_id"].isin(list(region))),
        spark.createDataFrame(list(turns), "from_edge bigint, to_edge bigint"),
    )


def test_batches_are_what_one_vehicle_after_another_gives(spark, monkeypatch):
    net, turns, region, routes = network(3)
    options = {"k": 6, "stretch": 3.0, "eps": 0.5, "min_samples": 2, "least": 3, "picks": 2}
    want, memo = plain(routes, region, turns, 6, 3.0, 0.5, 2, 3, 2)
    assert {w[0] for w in want.values()} == {"invalid", "short", "found"} and len(memo) > 5
    route, inside, connections = frames(spark, net, turns, region, routes)
    sought = []
    real = sub.ways_of_ends

    def counted(keys, *rest):
        sought.extend((tuple(r["firsts"]), tuple(r["lasts"])) for r in keys.collect())
        return real(keys, *rest)

    monkeypatch.setattr(sub, "ways_of_ends", counted)
    kept, got = sub.Memo(), {}
    for part in range(3):
        found = sub.batch_subnetworks(route.where(f"route_id % 3 = {part}"), inside, connections, kept, **options)
        got |= {r["route_id"]: (r["status"], r["firsts"], r["lasts"], r["edges"]) for r in found.collect()}
    assert got == want
    assert sorted(sought) == sorted(memo)  # each key once, over all batches
    again = sub.batch_subnetworks(route, inside, connections, kept, **options)
    assert len(sought) == len(memo) and {r["route_id"]: r["edges"] for r in again.collect()} == {r: w[3] for r, w in want.items()}


def test_episodes(spark):
    net, turns, region, routes = network(5)
    want, _ = plain(routes, region, turns, 4, 2.0, 0.26, 2, 10, 5)
    route, inside, connections = frames(spark, net, turns, region, routes)
    vehicle = spark.createDataFrame([(100 + r, r, 50 + 7 * r) for r in routes], "vehicle_id bigint, route_id bigint, depart bigint")
    found = sub.subnetworks(vehicle, route, inside, connections, 210, k=4, stretch=2.0)
    assert rows(found, "episode", "vehicle_id", "status", "edges") == sorted(((7 * r // 210, 100 + r, want[r][0], want[r][3]) for r in routes), key=repr)
    none = sub.subnetworks(vehicle.where("false"), route, inside, connections, 210)
    assert none.count() == 0


def test_ways_are_picked_where_they_are(spark):
    """No job and no join takes part, and keys with few ways keep all."""
    rnd = random.Random(8)
    keys = {(key, 90 + key): sorted((rnd.randint(10, 40), rnd.sample(range(8), 5)) for _ in range(n)) for key, n in ((1, 12), (2, 12), (3, 9), (4, 2))}
    table = [([a], [b], r, m, " ".join(map(str, p))) for (a, b), ways in keys.items() for r, (m, p) in enumerate(ways, 1)]
    ways = spark.createDataFrame(table, "firsts array<bigint>, lasts array<bigint>, rank bigint, milli bigint, path string")
    spark.sparkContext.setJobGroup("picked", "")
    found = sub.picked(ways, 0.5, 3, 9, 5)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("picked")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = [(a, n, m, " ".join(map(str, p))) for (a, _), w in keys.items() for n in [len(w)] for m, p in chosen(w, 0.5, 3, 9, 5)]
    assert sorted((r["firsts"][0], r["n_ways"], r["milli"], r["path"]) for r in found.collect()) == sorted(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and len(want) < len(table)


def test_more_episodes_take_no_more_jobs(spark, monkeypatch):
    """All batches of a table are sought at once; what a memo knows is not sought again."""
    net, turns, region, routes = network(5)
    route, inside, connections = frames(spark, net, turns, region, routes)
    vehicle = spark.createDataFrame([(100 + r, r, 50 + 7 * r) for r in routes], "vehicle_id bigint, route_id bigint, depart bigint")
    sought, real = [], sub.ways_of_ends
    monkeypatch.setattr(sub, "ways_of_ends", lambda keys, *rest: (sought.append(keys.count()), real(keys, *rest))[1])
    jobs, got, memo = {}, {}, sub.Memo()
    for length, kept in ((1000, None), (50, None), (100, memo), (60, memo)):
        spark.sparkContext.setJobGroup(f"episodes {length}", "")
        found = sub.subnetworks(vehicle, route, inside, connections, length, memo=kept, k=4, stretch=2.0)
        got[length] = rows(found, "vehicle_id", "status", "edges")
        jobs[length] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"episodes {length}"))
        assert found.select("episode").distinct().count() == -(-7 * len(routes) // length)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[1000] == got[50] == got[100] == got[60] and len(sought) == 3 and len(set(sought)) == 1
    assert jobs[50] <= jobs[1000] + 2 and jobs[60] < jobs[50]


def test_ends_of_routes_with_gaps_and_turns_that_are_not_there(spark):
    """Positions that are missing end a run; a junction without an allowed edge leaves no ends on either side."""
    net = {e: (e, e + 1, 1.0) for e in range(8)} | {20: (2, 3, 1.0)}
    turns = {(e, e + 1) for e in range(7)} | {(1, 20), (20, 3)}
    routes = {0: range(8), 1: [7, 5, 2, 3, 4], 2: [2, 3, 4, 9], 3: [0], 4: [1, 2, 3, 4, 0]}
    steps = [(r, p, e) for r, es in routes.items() for p, e in enumerate(es)] + [(5, p, e) for p, e in ((0, 2), (1, 3), (3, 2), (4, 3), (5, 4), (7, 5))]
    route = spark.createDataFrame(steps, "route_id bigint, pos bigint, edge_id bigint")
    _, inside, connections = frames(spark, net, turns, {e: net[e] for e in (2, 3, 4, 20)}, {0: []} | routes)
    found = sub.allowed_ends(route, inside, connections)
    assert rows(found, "route_id", "status", "left", "right", "firsts", "lasts") == sorted(
        [
            (0, "open", 2, 5, [2, 20], [4]),
            (1, "open", 2, 5, None, None),
            (2, "open", 0, 3, None, None),
            (3, "invalid", 0, 0, None, None),
            (4, "open", 1, 4, None, None),
            (5, "open", 3, 6, [2], [4]),
        ],
        key=repr,
    )
