"""Vector codes: each part of a vector is named by its codebook's nearest entry, found by Lloyd rounds with Elkan's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows with a component of this size or more are dropped, like those that aren't finite: no 64-bit sum of squares could hold them.
TOO_LARGE = 32768.0
#: Rows whose distances a task works out at once.
BATCH = 4096
#: The salts among which one label's rows are dealt for their sum.
SALTS = 16
FAR = 1 << 31
STATE = "vec_id bigint, label string, x array<int>, entry array<tinyint>, upper array<int>, lower array<int>"


def root_below(squares: np.ndarray) -> np.ndarray:
    """The largest integers whose squares are at most these."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def root_above(squares: np.ndarray) -> np.ndarray:
    """The smallest integers whose squares are at least these."""
    r = root_below(squares)
    return r + (r * r < squares)


def gaps(book: np.ndarray) -> np.ndarray:
    """[part, entry, entry]: distances between a part's entries, rounded down."""
    apart = book[:, :, None, :] - book[:, None, :, :]
    return root_below((apart * apart).sum(-1))


def assign(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Give every part its nearest entry, ties to the lower index; bounds are tightened in place.

    x is [row, part, position]; entry and upper are [row, part], lower [row, part, entry]. Bounds are
    integers on the safe side, and an entry is left out only where it is strictly farther than the
    part's own: its lower bound is above the upper one, or it is over twice the upper bound from the
    own entry. All others are measured in integers, so ties are seen. Returns [row, part] squared
    distances where they were measured, else -1.
    """
    between = gaps(book)
    squares = np.full(entry.shape, -1, np.int64)
    n_entries = book.shape[1]
    for p in range(book.shape[0]):
        e, u, low, points = entry[:, p], upper[:, p], lower[:, p], x[:, p]
        open_ = ((low <= u[:, None]) & (between[p][e] <= 2 * u[:, None])) & (np.arange(n_entries) != e[:, None])
        at = np.flatnonzero(open_.any(1))
        if not len(at):
            continue
        own = points[at] - book[p, e[at]]
        best = (own * own).sum(1)
        here = e[at].copy()
        u[at], low[at, here] = root_above(best), root_below(best)
        for k in range(n_entries):
            v = u[at]
            near = np.flatnonzero((here != k) & (low[at, k] <= v) & (between[p][here, k] <= 2 * v))
            if not len(near):
                continue
            row = at[near]
            d = points[row] - book[p, k]
            d = (d * d).sum(1)
            low[row, k] = root_below(d)
            won = (d < best[near]) | ((d == best[near]) & (k < here[near]))
            taken = near[won]
            here[taken], best[taken] = k, d[won]
            u[at[taken]] = root_above(d[won])
        e[at], squares[at, p] = here, best
    return squares


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` values a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1), kind))


def _bounds(batch: pa.RecordBatch, shape: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    (parts, entries, width), n = shape, batch.num_rows
    x = _rows(batch.column("x"), parts * width).reshape(n, parts, width)
    return x, _rows(batch.column("entry"), parts), _rows(batch.column("upper"), parts), _rows(batch.column("lower"), parts * entries).reshape(n, parts, entries)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _round(book: np.ndarray, moved: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shift the bounds by what each entry moved, then assign."""
    parts = book.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x, entry, upper, lower = _bounds(batch, book.shape)
            upper = np.minimum(upper + moved[np.arange(parts), entry], FAR - 1)
            lower = np.maximum(lower - moved, 0)
            assign(x, entry, upper, lower, book)
            columns = [batch.column("vec_id"), batch.column("label"), batch.column("x"), _lists(entry, pa.int8()), _lists(upper, pa.int32()), _lists(lower, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "entry", "upper", "lower"])

    return run


def _codes(book: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """code and error of every row: squared distances to the assigned entries."""
    parts = book.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            x, entry, _, _ = _bounds(batch, book.shape)
            d = x - book[np.arange(parts), entry]
            code = ["".join(f"{k:02x}" for k in row) for row in entry.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array((d * d).sum((1, 2)), pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _partial_sums(shape: tuple[int, int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each entry that a task's rows use: how many, and the sums by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in _pieces(batches):
            x, entry, _, _ = _bounds(batch, shape)
            for p in range(shape[0]):
                np.add.at(total[p], entry[:, p], x[:, p])
                count[p] += np.bincount(entry[:, p], minlength=shape[1])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), _lists(total[p, e], pa.int64())], ["p", "e", "n", "s"])

    return run


def next_book(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The componentwise floor of the mean of what each entry was given; unused entries stay.

    Tasks add up their own rows; what the driver reads is the codebook, whatever the number of rows.
    """
    partial = state.select("x", "entry", "upper", "lower").mapInArrow(_partial_sums(book.shape), "p int, e int, n bigint, s array<bigint>")
    sums = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(book.shape[2])])
    out = book.copy()
    for r in sums.collect():
        out[r["p"], r["e"]] = [r[f"s{k}"] // r["n"] for k in range(book.shape[2])]
    return out


def scaled(vector: Column) -> Column:
    """The integers floor(4096 x) of a vector's components; null where a row is dropped."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def book_digest(book: np.ndarray) -> str:
    """Hex SHA-256 of all components, by part, entry, position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def fitted(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(state, codebook) after ``rounds`` and the last assignment; state is a written table of ``STATE``.

    ``vectors`` has vec_id, label, embedding. Rows whose vector is null, or holds null, non-finite or
    too large components, are dropped. The rest must be of one length, of which the first rows by
    vec_id decide: others are dropped too. A length that 8 doesn't divide is filled up with zeros.
    The codebook begins with the 16 smallest vec_ids, equal ones in the order of their components and
    null ones last; with fewer rows it has fewer entries, and with none it is None. Each round's
    assignments and bounds are a table in the shared folder, so that a lost executor costs part of
    one round; the one before is then deleted.
    """
    kept = vectors.select("vec_id", F.col("label").cast("string").alias("label"), scaled(F.col("embedding")).alias("x")).where("x is not null")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], STATE), None
    size = len(first[0]["x"])
    width = -(-size // PARTS)
    seeds = [r["x"] + [0] * (width * PARTS - size) for r in first if len(r["x"]) == size]
    book = np.array(seeds, np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()
    filled = F.concat("x", F.array_repeat(F.lit(0), width * PARTS - size)).alias("x")
    none = [F.array_repeat(F.lit(0).cast("tinyint"), PARTS).alias("entry"), F.array_repeat(F.lit(FAR - 1), PARTS).alias("upper"), F.array_repeat(F.lit(0), PARTS * len(seeds)).alias("lower")]
    state = kept.where(F.size("x") == size).select("vec_id", "label", filled, *none)
    moved, last = np.zeros(book.shape[:2], np.int64), None
    for k in range(rounds + 1):
        state = written(state.mapInArrow(_round(book, moved), STATE))
        if last is not None:
            drop_written(last)
        last = state
        if k < rounds:
            new = next_book(state, book)
            step = new - book
            book, moved = new, root_above((step * step).sum(-1))
    return state, book


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that isn't dropped.

    label_error sums the errors of all rows of a label, nulls being one; each label's sum is dealt
    over salts before it is joined, so a label that a third of all rows have isn't one task's work.
    Repeated rows are answered alike. An empty table, or one without usable vectors, gives no rows.
    See ``fitted`` for nulls, odd lengths and ties.
    """
    state, book = fitted(vectors)
    if book is None:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    found = written(state.select("vec_id", "label", "x", "entry", "upper", "lower").mapInArrow(_codes(book), "vec_id bigint, label string, code string, error bigint"))
    drop_written(state)
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    dealt = sums.select("of", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = found.withColumn("at", salt).join(dealt, F.col("label").eqNullSafe(F.col("of")) & (F.col("at") == F.col("salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
