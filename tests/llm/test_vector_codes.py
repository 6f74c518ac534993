import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from roadlake.llm.vector_codes import assign, book_digest, codes, fitted, root_above, root_below

from .conftest import plain

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, code string, error string"


def plain_codes(rows, rounds=6):
    """All points against all entries, with Python's integers."""
    rows = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    width = len(rows[0][1]) // 8
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(8)]
    book = [[cut(r[1])[p] for r in rows[:16]] for p in range(8)]
    for k in range(rounds + 1):
        apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        given = [[min((apart(part, c), e) for e, c in enumerate(book[p])) for p, part in enumerate(cut(r[1]))] for r in rows]
        if k < rounds:
            for p in range(8):
                parts = defaultdict(list)
                for r, g in zip(rows, given, strict=True):
                    parts[g[p][1]].append(cut(r[1])[p])
                for e, members in parts.items():
                    book[p][e] = [sum(m[i] for m in members) // len(members) for i in range(width)]
    errors = [sum(d for d, _ in g) for g in given]
    by_label = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{e:02x}" for _, e in g), err, by_label[r[2]], digest) for r, g, err in zip(rows, given, errors, strict=True)]


def check(spark, rows):
    df = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], SCHEMA).repartition(3)
    got = plain(codes(df), "vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert got == sorted(plain_codes(rows), key=repr)


def vectors(n, width, seed, step=None):
    rnd = random.Random(seed)
    value = lambda: rnd.choice([-1, 0, 1]) * step if step else float(np.float32(rnd.gauss(0, 1)))
    return [(k, [value() for _ in range(width)], rnd.choice([1, 2, None])) for k in range(n)]


def test_same_as_plain_rounds(spark):
    check(spark, vectors(300, 24, 1))


def test_ties_and_repeated_rows(spark):
    rows = vectors(200, 16, 2, step=0.25)
    check(spark, rows + rows[:40] + [(None, rows[3][1], 1), (None, rows[4][1], None)])


def test_dropped_rows_and_few_rows(spark):
    rows = vectors(9, 16, 3)
    bad = [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 2), (-1, [float("inf")] * 16, None), (-2, [0.5] * 15 + [float("-inf")], 1)]
    check(spark, rows + bad)
    df = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in bad], SCHEMA)
    assert codes(df).count() == 0 and codes(df.where("false")).count() == 0


def test_other_lengths(spark):
    rows = vectors(30, 16, 4)
    odd = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in [*rows, (99, [1.0], 1), (98, [], 1)]], SCHEMA)
    assert plain(codes(odd), "vec_id", "code", "error") == sorted(((r[0], r[1], r[2]) for r in plain_codes(rows)), key=repr)
    filled = [(i, v[:13] + [0.0] * 3, label) for i, v, label in rows]
    short = spark.createDataFrame([(i, v[:13], label, "a", "b", "c") for i, v, label in rows], SCHEMA)
    assert plain(codes(short), "vec_id", "code", "error") == sorted(((r[0], r[1], r[2]) for r in plain_codes(filled)), key=repr)
    none = spark.createDataFrame([(k, [], 1, "a", "b", "c") for k in range(3)], SCHEMA)
    assert {(r["code"], r["error"]) for r in codes(none).collect()} == {("00" * 8, 0)}


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(5)
    x = rnd.integers(-4096, 4096, (500, 2, 3))
    book = rnd.integers(-4096, 4096, (2, 7, 3))
    entry, upper, lower = np.zeros((500, 2), np.int64), np.full((500, 2), 1 << 30), np.zeros((500, 2, 7), np.int64)
    for _ in range(4):
        assign(x, entry, upper, lower, book)
        d = ((x[:, :, None, :] - book) ** 2).sum(-1)
        assert (entry == d.argmin(-1)).all()
        assert (lower.astype(float) ** 2 <= d).all() and (upper.astype(float) ** 2 >= d.min(-1)).all()
        new = book + rnd.integers(-40, 40, book.shape)
        moved = root_above(((new - book) ** 2).sum(-1))
        upper, lower, book = upper + moved[np.arange(2), entry], np.maximum(lower - moved, 0), new
    measured = assign(x, entry, upper, lower, book) >= 0
    assert not measured.all()


def test_roots():
    squares = np.array([0, 1, 2, 3, 4, 2**52 - 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 - 1, 2**60 + 1])
    assert root_below(squares).tolist() == [math.isqrt(s) for s in squares.tolist()]
    assert root_above(squares).tolist() == [math.isqrt(s - 1) + 1 if s else 0 for s in squares.tolist()]


def test_state_is_one_table(spark):
    df = spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in vectors(40, 16, 6)], SCHEMA)
    state, book = fitted(df, rounds=2)
    assert state.count() == 40 and book.shape == (8, 16, 2) and len(book_digest(book)) == 64
