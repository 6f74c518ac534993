"""Gravity clustering of weighted points: moves, merges in order, and a parallel merge on a grid."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written
from roadlake.operators.components import connected_components

#: Places that are held against each other at once, and that a task takes at least.
BLOCK_PLACES, BLOCK_POINTS = 50_000, 1_024
#: Cells on a side of a tile of dense places, and pairs that cost as much as a cell of a transform. Weights that share a task.
SIDE, PAIRS_A_CELL, WEIGHTS_TOGETHER = 1_280, 20, 4
#: Of these, so many points and places whose pulls are taken at once.
AT_ONCE = 32, 1_024
#: Pairs of places whose distance is taken at once.
CANDIDATES = 1_000_000
#: Slots of a tile, about, and of the fullest tile at most where smaller tiles can help.
TILE_SLOTS, MOST_SLOTS = 2_048, 16_384
#: So few points left are moved and merged in one task, by the same steps.
FEW_POINTS = 16_384


def moved(points: DataFrame, block: int = BLOCK_PLACES, factor: int = 1000) -> DataFrame:
    """(id, dx, dy): the pull of all other points, times ``factor`` and truncated.

    Each pair pulls with weight over squared distance, 1 for coincident points. Points at the same
    place are summed first, and pulled alike, so only places meet. Where they are dense, tiles of ``SIDE`` cells
    meet the places of some weights of each tile, and a task may take a weight's pulls as a convolution
    (``place_pulls``); else blocks of about ``block`` places meet blocks. Pulls are added by place.
    """
    salts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = written(points.where("x is not null and y is not null").groupBy("x", "y").agg(F.sum("w").alias("w")))
    has = places.agg(F.count(F.lit(1)).alias("n"), *[at(c).alias(f"{at.__name__}_{c}") for at in (F.min, F.max) for c in "xy"]).first()
    nx, ny = ((has[f"max_{c}"] - has[f"min_{c}"]) // SIDE + 1 if has["n"] else 1 for c in "xy")
    dealt = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    if nx * ny <= max(1, 8 * has["n"] // block):
        tile = (F.floor((F.col("x") - (has["min_x"] or 0)) / SIDE) * ny + F.floor((F.col("y") - (has["min_y"] or 0)) / SIDE)).cast("int")
        some = max(1, -(-places.select("w").distinct().count() // WEIGHTS_TOGETHER))
        targets, sources, t, s = nx * ny, nx * ny * some, tile, tile * some + dealt(["w"], some)
    else:
        sources = max(1, -(-has["n"] // block))
        targets = max(sources, min(salts, -(-has["n"] // BLOCK_POINTS)))
        t, s = dealt(["x", "y"], targets), dealt(["x", "y"], sources)
    # a number of its own, since few bytes are much work here, and large enough that few pairs of t and s share a task
    tasks = max(salts, min(4 * targets * sources, 4096))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = places.select("x", "y", t.alias("t"), numbers(sources).alias("s")).repartition(tasks, "t", "s")
    right = places.where("w is not null").select("x", "y", "w", s.alias("s"), numbers(targets).alias("t")).repartition(tasks, "t", "s")

    def pull(own: pa.Table, other: pa.Table) -> pa.Table:
        (x, y), (px, py, pw) = ([some.column(c).to_numpy() for c in names] for some, names in ((own, ("x", "y")), (other, ("x", "y", "w"))))
        return pa.table([x, y, *place_pulls(x, y, px, py, pw, factor)], ["x", "y", "dx", "dy"])

    met = left.groupBy("t", "s").cogroup(right.groupBy("t", "s")).applyInArrow(pull, "x bigint, y bigint, dx bigint, dy bigint")
    return points.select("id", "x", "y").join(met.groupBy("x", "y").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy")), ["x", "y"], "left").select("id", "dx", "dy")


def place_pulls(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, pw: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``pulls``, for distinct places; weights that many places have are taken by convolution where that is less work.

    The pull of a place depends on its weight and on how far off it is in x and y, so over the cells of both boxes the
    places of a weight times the pulls of one such place are all its pulls. Sums of whole numbers are rounded; the error of the
    transforms is bounded by the norms of what is transformed, and what could be off by a quarter is left to ``pulls``.
    """
    out = np.zeros((2, len(x)), np.int64)
    if not len(x) or not len(px):
        return out[0], out[1]
    spans = [(int(o.min()), int(o.max()) - int(o.min()) + 1, int(p.min()), int(p.max()) - int(p.min()) + 1) for o, p in ((x, px), (y, py))]
    shape = [_fast(o + p - 1) for _, o, _, p in spans]
    cells = shape[0] * shape[1]
    weights, counts = np.unique(pw, return_counts=True)
    wide = max(abs(c - a) + o + p for a, o, c, p in spans)
    rest = np.ones(len(pw), bool)
    many = weights[(counts * len(x) > PAIRS_A_CELL * cells) & (weights > 0) & (weights < 2**52 // (wide * factor))] if 2 * wide * wide < 2**52 else weights[:0]
    if len(many):
        # how far off a place is from a point of cell k, on a ring of cells
        (dx, dy), total, error = _offsets(spans, shape), np.zeros((2, shape[0], shape[1] // 2 + 1), np.complex128), 0.0
        d2 = dx * dx + dy * dy
        d2[d2 == 0] = 1
        for w in many:
            mine = pw == w
            held = np.zeros(shape)
            held[px[mine] - spans[0][2], py[mine] - spans[1][2]] = 1
            pulled = [np.trunc(d * float(w * factor) / d2) for d in (dx, dy)]
            off = 64 * np.finfo(float).eps * np.log2(cells) * np.sqrt(mine.sum()) * max(np.linalg.norm(k) for k in pulled)
            if error + off >= 0.25:
                continue
            error, rest = error + off, rest & ~mine
            held = np.fft.rfft2(held)
            for k in (0, 1):
                total[k] += held * np.fft.rfft2(pulled[k])
        for k in (0, 1):
            out[k] = np.rint(np.fft.irfft2(total[k], shape)[x - spans[0][0], y - spans[1][0]]).astype(np.int64)
    other = pulls(x, y, px[rest], py[rest], pw[rest], factor)
    return out[0] + other[0], out[1] + other[1]


def _fast(n: int) -> int:
    """The least number from n on that has only 2, 3 and 5 as factors, as transforms like it."""
    fits = [2**a * 3**b * 5**c for a in range(n.bit_length() + 1) for b in range(n.bit_length() + 1) for c in range(n.bit_length() + 1) if n <= 2**a * 3**b * 5**c < 2 * n]
    return min(fits, default=n)


def _offsets(spans: list[tuple], shape: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The way from a point to a place, in x and in y, by the point's cell less the place's."""
    ways = []
    for (a, o, c, _), n in zip(spans, shape, strict=True):
        m = np.arange(n)
        ways.append((c - a - np.where(m < o, m, m - n)).astype(float))
    return ways[0][:, None], ways[1][None, :]


def _near_first(x: np.ndarray, y: np.ndarray, some: int, by: np.ndarray | None = None) -> np.ndarray:
    """An order in which runs of ``some`` are close to each other, and of similar weights ``by``."""
    strips = max(1, int(np.sqrt(len(x) / some)))
    strip = (x - x.min()) * strips // (int(x.max()) - int(x.min()) + 1)
    return np.lexsort((y, strip) if by is None else (y, strip, np.log2(np.clip(np.abs(by), 1, None)).astype(int)))


def pulls(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, pw: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """What the places px, py of weight pw pull at each point x, y.

    Few points meet few places at once, so that they stay in the processor's cache, and not at all where the places are so far
    off that each pull is below one: farther than their weight times ``factor``. Places light enough for it
    are divided as doubles: a quotient of whole numbers below 2^52 is never rounded up to a whole one.
    """
    out = np.zeros((2, len(x)), np.int64)
    if not len(x) or not len(px):
        return out[0], out[1]
    wide = max(int(max(o.max(), p.max()) - min(o.min(), p.min())) for o, p in ((x, px), (y, py)))
    # of two sides and a sum over the places that are taken at once
    light = pw < min(2**52 // max(1, wide * factor), 2**52 // (factor * AT_ONCE[1])) if 2 * wide * wide < 2**52 else np.zeros(len(px), bool)
    turn = _near_first(x, y, AT_ONCE[0])
    starts = np.arange(0, len(x), AT_ONCE[0])
    box = [(np.minimum.reduceat(v[turn], starts), np.fmax.reduceat(v[turn], starts)) for v in (x, y)]
    for kind, mine, pull in ((np.float64, light, _as_doubles), (np.int64, ~light, _as_integers)):
        if not mine.any():
            continue
        places = np.flatnonzero(mine)[_near_first(px[mine], py[mine], AT_ONCE[1], pw[mine])]
        (ox, oy), (qx, qy, w) = ((v.astype(kind) for v in some) for some in ((x[turn], y[turn]), (px[places], py[places], pw[places] * factor)))
        for at in range(0, len(qx), AT_ONCE[1]):
            place = slice(at, at + AT_ONCE[1])
            gaps = [np.clip(np.where(low > q[place].max(), low - q[place].max(), q[place].min() - high), 0, None).astype(float) for (low, high), q in zip(box, (qx, qy), strict=True)]
            for n in np.flatnonzero(np.hypot(*gaps) * (1 - 1e-9) <= float(np.abs(w[place]).max())):
                own = slice(starts[n], starts[n] + AT_ONCE[0])
                dx, dy = qx[None, place] - ox[own, None], qy[None, place] - oy[own, None]
                d2 = dx * dx
                d2 += dy * dy
                np.maximum(d2, 1, out=d2)
                for k, d in enumerate((dx, dy)):
                    out[k, turn[own]] += pull(d, w[place], d2).sum(1).astype(np.int64)
    return out[0], out[1]


def _as_doubles(d: np.ndarray, w: np.ndarray, d2: np.ndarray) -> np.ndarray:
    d *= w
    d /= d2
    return np.trunc(d, out=d)


def _as_integers(d: np.ndarray, w: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return np.sign(d) * (np.abs(d) * w // d2)


def mutual_neighbours(points: DataFrame, radius: int) -> DataFrame:
    """(a, b, d2): pairs a < b that are each other's nearest point within ``radius``.

    Ties go to the lower id. Of points at one place the two lowest ids are a pair, and no other pair has
    a point of that place; all others are places of one point, which ``_mutual`` looks for.
    """
    first, second = F.min("id").alias("id"), F.max("id").alias("next")
    ranked = points.select("id", "x", "y").dropna().withColumn("_rank", F.row_number().over(W.partitionBy("x", "y").orderBy("id"))).where("_rank <= 2")
    places = written(ranked.groupBy("x", "y").agg(first, second).withColumn("next", F.when(F.col("next") > F.col("id"), F.col("next"))))
    same = places.where("next is not null").select(F.col("id").alias("a"), F.col("next").alias("b"), F.lit(0).cast("bigint").alias("d2"))
    return same.unionByName(_mutual(places.select("id", "x", "y", F.col("next").isNull().alias("single")), radius))


def _mutual(places: DataFrame, radius: int) -> DataFrame:
    """(a, b, d2) of ``single`` places (id, x, y, single), no two alike, that are each other's nearest.

    Tiles are eight radii wide and see two radii beyond their borders, where the nearest place of a
    nearest place lies. Each pair is found in the tile of its lower id. Tiles are dealt into groups of
    about ``BLOCK_PLACES`` places, and no tile has more than whole-number places in it.
    """
    side, groups = 8 * radius, max(1, -(-places.count() // BLOCK_PLACES))
    tiles = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + by) / side) for by in (-2 * radius, 2 * radius)])))
    seen = places.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x, y = (rows[c].to_numpy() for c in ("id", "x", "y"))
        tile = rows.groupby(["tx", "ty"], sort=False).ngroup().to_numpy()
        near, d2 = nearest(tile, x - rows["tx"].to_numpy() * side, y - rows["ty"].to_numpy() * side, ids, radius)
        own = (x // side == rows["tx"]) & (y // side == rows["ty"]) & rows["single"] & (near >= 0)
        k = np.flatnonzero(own.to_numpy())
        k = k[(near[near[k]] == k) & rows["single"].to_numpy()[near[k]] & (ids[k] < ids[near[k]])]
        return pd.DataFrame({"a": ids[k], "b": ids[near[k]], "d2": d2[k]})

    return seen.groupBy(F.pmod(F.xxhash64("tx", "ty"), F.lit(groups)).alias("group")).applyInPandas(run, "a bigint, b bigint, d2 bigint")


def nearest(tile: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each place's nearest of the same tile within ``radius`` stands, -1 if it has none, and the squared distance.

    Those without one at 1, 2, 4 and so on are sought twice as far. Around such a place half of the reach is
    empty, so that few of them are near each other and the candidates stay in proportion to the places.
    """
    near, least = np.full(len(x), -1), np.zeros(len(x), np.int64)
    todo, reach = np.arange(len(x)), min(1, radius)
    while len(todo):
        cx, cy = ((v // reach - (v // reach).min() + 1).astype(np.int64) for v in (x, y))
        tall = cy.max() + 2
        key = (tile * (cx.max() + 2) + cx) * tall + cy
        order = np.argsort(key, kind="stable")
        ranges = [np.searchsorted(key[order], key[todo] + by * tall + (-1, 1)[side == "right"], side) for by in (-1, 0, 1) for side in ("left", "right")]
        low, high = np.stack(ranges[::2], 1), np.stack(ranges[1::2], 1)
        total = np.cumsum((high - low).sum(1))
        cuts = np.unique(np.searchsorted(total, np.arange(CANDIDATES, total[-1], CANDIDATES)))
        for part in np.split(np.arange(len(todo)), cuts):
            n = (high[part] - low[part]).ravel()
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low[part].ravel(), n)
            one, other = np.repeat(todo[part], n.reshape(-1, 3).sum(1)), order[at]
            d2 = (x[one] - x[other]) ** 2 + (y[one] - y[other]) ** 2
            fit = np.flatnonzero((d2 <= reach * reach) & (one != other))
            fit = fit[np.lexsort((ids[other[fit]], d2[fit], one[fit]))]
            fit = fit[np.unique(one[fit], return_index=True)[1]]
            near[one[fit]], least[one[fit]] = other[fit], d2[fit]
        if reach == radius:
            break
        todo, reach = todo[near[todo] < 0], min(2 * reach, radius)
    return near, least


def merged_pairs(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Points after each mutual pair has become one, at the mean place with the summed weight."""
    lead = pairs.select(F.col("b").alias("id"), F.col("a").alias("lead"))
    led = points.join(lead, "id", "left").withColumn("id", F.coalesce("lead", "id"))
    return led.groupBy("id").agg(F.floor(F.avg("x")).alias("x"), F.floor(F.avg("y")).alias("y"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("size"))


def grid_clusters(points: DataFrame, radius: int, rounds: int | None = None) -> DataFrame:
    """(id, leader): clusters by parallel merges until nothing merges, or after ``rounds``.

    Each round first makes one point of all at the same place, then merges mutual pairs. The
    lowest id of those at the least distance is in such a pair, so that rounds end.
    """
    now = written(points.select("id", "x", "y", "w"))
    member = written(points.select("id", F.col("id").alias("leader")))
    done = 0
    while rounds is None or done < rounds:
        places = written(now.groupBy("x", "y").agg(F.min("id").alias("id"), F.sum("w").alias("w")).select("id", "x", "y", "w"))
        pairs = written(_mutual(places.select("id", "x", "y", F.lit(True).alias("single")), radius))
        at = places.select("x", "y", F.col("id").alias("up"))
        same = now.join(at, ["x", "y"]).select("id", "up").join(pairs.select(F.col("b").alias("up"), "a"), "up", "left")
        to = written(same.select(F.col("id").alias("leader"), F.coalesce("a", "up").alias("up")).where("leader <> up"))
        if to.isEmpty():
            break
        old = (now, member, places, pairs, to)
        now = written(merged_pairs(places, pairs).select("id", "x", "y", "w"))
        member = written(member.join(to, "leader", "left").select("id", F.coalesce("up", "leader").alias("leader")))
        for table in old:
            drop_written(table)
        done += 1
    return member


#: A slot is a place with its ``n`` points: their weight, the lowest id that hasn't acted and its
#: weight, the heaviest point's weight and id. kind 0: a slot that is left; 1: ``slot`` went into
#: ``into``; 2: the point ``low`` acted at x, y in round ``at``.
SLOT = "slot bigint, x bigint, y bigint, n bigint, w bigint, low bigint, low_w bigint, top_w bigint, top bigint"
STEP = f"kind int, {SLOT}, into bigint, at int"
SLOT_COLUMNS = [c.split()[0] for c in SLOT.split(", ")]


def act(slots: list[list], radius: int, reach: int, low: tuple[float, float], high: tuple[float, float]) -> tuple[list, list, list]:
    """(slots left, [slot, into], [id, x, y] of acts) after all points acted that could, by rising id.

    A point that acts takes in all within ``radius``. The heaviest of them leads, the first by id of
    equal ones, unless none is heavier than the one that acts; it goes to the mean of all their
    places, rounded down, with their summed weight. A point waits if less than ``reach`` away from it
    lies a border of the tile from ``low`` to ``high``, or a point that waits.
    """
    cells, waiting = defaultdict(set), defaultdict(list)
    cell = lambda s: (s[1] // reach, s[2] // reach)
    around = lambda s, grid: (j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in grid.get((s[1] // reach + a, s[2] // reach + b), ()))
    near = lambda s, o, limit: (s[1] - o[1]) ** 2 + (s[2] - o[2]) ** 2 < limit * limit
    for k, s in enumerate(slots):
        cells[cell(s)].add(k)
    heap = [(s[5], k) for k, s in enumerate(slots) if s[5] is not None]
    heapq.heapify(heap)
    gone, went, acts = set(), [], []
    while heap:
        own, k = heapq.heappop(heap)
        s = slots[k]
        if k in gone or s[5] != own:
            continue
        inside = all(low[i] <= s[i + 1] - reach and s[i + 1] + reach < high[i] for i in (0, 1))
        if not inside or any(near(s, slots[j], reach) for j in around(s, waiting)):
            waiting[cell(s)].append(k)
            continue
        acts.append([own, s[1], s[2]])
        taken = [j for j in around(s, cells) if near(s, slots[j], radius)]
        if len(taken) == 1 and s[3] == 1:
            s[5] = None
            continue
        heaviest = max(slots[j][7] for j in taken)
        lead, name, may_act = k, own, False
        if heaviest > s[6]:
            lead = min((j for j in taken if slots[j][7] == heaviest), key=lambda j: slots[j][8])
            name, may_act = slots[lead][8], slots[lead][3] > 1 or slots[lead][5] is not None
        n, w = sum(slots[j][3] for j in taken), sum(slots[j][4] for j in taken)
        x, y = (sum(slots[j][3] * slots[j][i] for j in taken) // n for i in (1, 2))
        for j in taken:
            cells[cell(slots[j])].discard(j)
            if j != lead:
                gone.add(j)
                went.append([slots[j][0], slots[lead][0]])
        slots[lead][1:] = [x, y, 1, w, name if may_act else None, w, w, name]
        cells[cell(slots[lead])].add(lead)
        if may_act:
            heapq.heappush(heap, (name, lead))
    return [s for k, s in enumerate(slots) if k not in gone], went, acts


def _as_lists(rows: pd.DataFrame) -> list[list]:
    return [[None if v is None or v != v else int(v) for v in r] for r in rows[SLOT_COLUMNS].astype(object).itertuples(index=False)]


def _tile_step(radius: int, reach: int, at: int, side: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, went, acts = act(_as_lists(rows), radius, reach, key, tuple(k + side for k in key))
        out = [(0, *s, None, None) for s in left] + [(1, a, *[None] * 8, b, None) for a, b in went] + [(2, None, x, y, None, None, i, *[None] * 3, None, at) for i, x, y in acts]
        names = ["kind", *SLOT_COLUMNS, "into", "at"]
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names})

    return run


def _in_order(state: DataFrame, radius: int, reach: int) -> tuple[DataFrame, DataFrame, bool]:
    """(slots left, pointers, whether it was right): rounds over shifted tiles until every point has acted.

    A tile is 16 reaches wide at least (``_side``), so that in one of four shifts any point is far from its borders, and
    the lowest id that hasn't acted always can. Points act out of order only where ``act`` saw
    nothing that waits within ``reach``; since those that wait may come closer later, all acts are
    held against each other at the end: two whose circles are apart can be swapped, and if any
    two out of order are less than two radii apart the rounds were wrong.
    """
    (side, n), round_, steps = _side(state, 16 * reach), 0, []
    # a number of its own, since few bytes are much work here
    tasks = max(1, min(4 * int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n // TILE_SLOTS))
    while True:
        shift = [(0, 0), (side // 2, 0), (0, side // 2), (side // 2, side // 2)][round_ % 4]
        corner = lambda c, by: F.floor((F.col(c) - by) / side) * side + by
        dealt = state.withColumns({"tx": corner("x", shift[0]), "ty": corner("y", shift[1])}).repartition(tasks, "tx", "ty")
        step = written(dealt.groupBy("tx", "ty").applyInPandas(_tile_step(radius, reach, round_, side), STEP))
        steps.append(step)
        state = step.where("kind = 0").select(*SLOT_COLUMNS)
        round_ += 1
        if state.where("low is not null").isEmpty():
            break
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step.where("kind > 0"))
    acts = every.where("kind = 2").select("low", "x", "y", "at", F.floor(F.col("x") / (2 * radius)).alias("cx"), F.floor(F.col("y") / (2 * radius)).alias("cy"))
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = acts.select(F.col("low").alias("i"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("at").alias("t"), F.explode(around).alias("c")).select("i", "ox", "oy", "t", "c.*")
    apart = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    right = round_ == 1 or acts.join(other, ["cx", "cy"]).where((F.col("low") < F.col("i")) & (F.col("at") > F.col("t")) & (apart < 4 * radius * radius)).isEmpty()
    pointers = written(every.where("kind = 1").select("slot", "into"))
    state = written(state)
    drop_written(*steps)
    return state, pointers, right


def _side(slots: DataFrame, least: int) -> tuple[int, int]:
    """How wide tiles are: ``least``, or so many times two that they hold about ``TILE_SLOTS`` slots; and the number of slots.

    Few slots a tile are many calls and many that wait at borders. Where a tile would be too full, since slots
    lie in clusters, tiles are halved.
    """
    has = slots.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c) + 1).cast("double").alias(c) for c in "xy"]).first()
    side = least
    while has["n"] and 4.0 * side * side * has["n"] <= TILE_SLOTS * has["x"] * has["y"]:
        side *= 2
    while side > least:
        tiles = slots.groupBy(*[F.floor(F.col(c) / side).alias(c) for c in "xy"]).agg(F.count(F.lit(1)).alias("n"))
        if (tiles.agg(F.max("n").alias("n")).first()["n"] or 0) <= MOST_SLOTS:
            break
        side //= 2
    return side, has["n"]


def merged_in_order(points: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """((id, x, y, w) of the points left, (id, leader) of all): each point, by rising id, takes in those within ``radius``.

    The same as a loop over all points (see ``act``), run in tiles: a point acts once every lower id
    within reach has acted. Points at one place are one slot from the start, so a tile holds at most
    as many as it has whole-number places. Should points come closer that were out of reach, the
    pass is repeated with twice the reach. Ids are distinct; coordinates and weights whole numbers.
    """
    first = F.min(F.struct((-F.col("w")).alias("v"), "id"))
    slots = points.groupBy("x", "y").agg(F.min("id").alias("slot"), F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min_by("w", "id").alias("low_w"), first.alias("t"))
    slots = written(slots.select("slot", "x", "y", "n", "w", F.col("slot").alias("low"), "low_w", (-F.col("t.v")).alias("top_w"), F.col("t.id").alias("top")))
    reach = 2 * radius
    left, pointers, right = _in_order(slots, radius, reach)
    while not right:
        drop_written(left, pointers)
        reach *= 2
        left, pointers, right = _in_order(slots, radius, reach)
    roots = connected_components(pointers, "slot", "into")
    rooted = slots.select("slot", F.col("x").alias("px"), F.col("y").alias("py")).join(roots.withColumnRenamed("node", "slot"), "slot", "left").withColumn("root", F.coalesce("root", "slot"))
    leaders = left.join(rooted.select("slot", "root"), "slot").select("root", F.col("top").alias("leader"))
    at = rooted.join(leaders, "root").select(F.col("px").alias("x"), F.col("py").alias("y"), "leader")
    return left.select(F.col("top").alias("id"), "x", "y", "w"), written(points.join(at, ["x", "y"]).select("id", "leader"))


def ordered_clusters(points: DataFrame, radius: float, iterations: int = 200, few: int = FEW_POINTS) -> DataFrame:
    """(id, leader): all points move and merge in order, ``iterations`` times or until one is left.

    Coordinates count in thousandths from here on. Each iteration moves every point by the pull of all
    others (``moved``), then merges (``merged_in_order``). Where at most ``few`` points are left, the
    rest of the iterations takes the same steps in one task.
    """
    wide = round(radius * 1000)
    now = written(points.select("id", (F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y"), "w"))
    member = written(points.select("id", F.col("id").alias("leader")))
    for k in range(iterations):
        if now.count() <= few:
            rest = now.groupBy().applyInPandas(_few(wide, iterations - k), "old bigint, leader bigint")
            return member.withColumnRenamed("leader", "old").join(rest, "old").select("id", "leader")
        # first all are on whole numbers, where a pull in thousandths is the same, and where they may be dense
        pulled = moved(now, factor=10**6) if k else moved(points, factor=1000)
        placed = written(now.join(pulled, "id").select("id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "w"))
        new, to = merged_in_order(placed, wide)
        joined = written(member.withColumnRenamed("leader", "old").join(to.withColumnRenamed("id", "old"), "old").select("id", "leader"))
        drop_written(now, placed, member, to)
        now, member = written(new), joined
        drop_written(new)
    return member


def _few(radius: int, iterations: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """(old, leader) of a few points after all iterations."""
    everywhere = (float("-inf"),) * 2, (float("inf"),) * 2

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        lead = {int(i): int(i) for i in rows["id"]}
        ids, x, y, w = (rows[c].to_numpy(np.int64) for c in ("id", "x", "y", "w"))
        for _ in range(iterations):
            if len(ids) < 2:
                break
            dx, dy = pulls(x, y, x, y, w, 10**6)
            slots = [[i, a, b, 1, v, i, v, v, i] for i, a, b, v in zip(ids.tolist(), (x + dx).tolist(), (y + dy).tolist(), w.tolist(), strict=True)]
            left, went, _ = act(slots, radius, 2 * radius, *everywhere)
            into = dict(went)
            for old, now in lead.items():
                while now in into:
                    now = into[now]
                lead[old] = now
            left.sort()
            ids, x, y, w = (np.array([s[c] for s in left], np.int64) for c in (0, 1, 2, 4))
        return pd.DataFrame({"old": list(lead), "leader": list(lead.values())}, dtype="int64")

    return run


def cluster_sizes(member: DataFrame, over: int) -> DataFrame:
    """(leader, size) of clusters of more than ``over`` members."""
    return member.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > over)


def cluster_borders(edges: DataFrame, label: DataFrame) -> DataFrame:
    """(leader, in_edges, out_edges): edges that lead from another cluster into one, and out of it.

    ``label`` has edge_id and leader; the edges of a connection are compared.
    """
    from roadlake.operators.graph import connections

    a = label.select(F.col("edge_id").alias("from_edge"), F.col("leader").alias("la"))
    b = label.select(F.col("edge_id").alias("to_edge"), F.col("leader").alias("lb"))
    cross = connections(edges).join(a, "from_edge").join(b, "to_edge").where("la <> lb")
    into = cross.groupBy(F.col("lb").alias("leader")).agg(F.count_distinct("to_edge").alias("in_edges"))
    out = cross.groupBy(F.col("la").alias("leader")).agg(F.count_distinct("from_edge").alias("out_edges"))
    return into.join(out, "leader", "full").fillna(0, ["in_edges", "out_edges"])


def best_borders(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of most ``left`` in each leader; ties by edge_id."""
    order = W.partitionBy("leader").orderBy(F.desc("left"), "edge_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)
