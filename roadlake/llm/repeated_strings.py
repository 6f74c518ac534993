"""Long strings that occur twice or more in a corpus, by refinement of q-gram buckets.

Each 400-byte window is dealt to one 200-byte string in it, the one of the lowest identifier;
equal windows are dealt alike, so only these strings stand for the windows around them. Strings of
one identifier are the initial buckets. A member that is alone leaves; members whose whole
surroundings agree are done together, and one of them goes on for all. The rest are refined:
first by the identifier of 300 bytes that half of their windows share, then, to either side, by pairs
of the own bucket's identifier and the bucket identifier at a later offset. Those of 2, 4, 8, …
bytes at an offset come from pairs of identifiers of half as many bytes at that offset and a later
one, are worked out once, and serve all widths that end there. Rounds end when no bucket has two
members. A window occurs twice if two members are in one bucket to its left end and to its right end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.llm._batch import chunks, each, identity, text_bytes

#: Bytes of a window, and of an initial bucket's string.
WINDOW, GRAM = 400, 200
SPREAD = WINDOW - GRAM + 1
#: Windows by how many bytes before the string they start, first and last of each half.
HALVES = ((0, 100), (101, 200))
#: Window starts that are handled at once in a long text.
PIECE = 1 << 18
#: Buckets with more members are refined by a shuffle of their windows, others inside a task.
MAX_IN_TASK = 1000
#: Members that one task refines, about.
TASK_MEMBERS = 20_000

#: Odd multiplier of the rolling identifiers, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Prime moduli and multipliers of the second identifiers.
PRIMES, PRIME_BASES = (2147483647, 2147483629), (1103515245, 1220703125)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}

ANCHOR = "gram bigint, around bigint, at bigint, low int, high int"


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base``, from the first on."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))
    return _powers[base][:n]


def _residue_powers(base: int, modulus: int, n: int) -> np.ndarray:
    """The first n powers of ``base`` modulo a prime under 2^31, each run from the one before."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), modulus)) % np.uint64(modulus)))
    return out[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Identifiers of any slices of some bytes; equal slices have equal ones anywhere.

    They choose and bucket strings. Being sums modulo 2^64, unequal slices with equal ones can be made
    up, so nothing is removed by them alone (see ``anchors`` and ``Residues``).
    """

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _power(BASE, len(data)), out=self.sums[1:])
        self.back = _power(pow(BASE, -1, 1 << 64), len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


class Residues:
    """Identifiers of any slices of some bytes by sums modulo two primes; equal slices have equal ones anywhere."""

    def __init__(self, data: np.ndarray) -> None:
        self.lanes = []
        for modulus, base in zip(PRIMES, PRIME_BASES, strict=True):
            m = np.uint64(modulus)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[data] % m * _residue_powers(base, modulus, len(data)) % m, out=sums[1:])
            self.lanes.append((m, sums, _residue_powers(pow(base, -1, modulus), modulus, len(data) + 1)))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((sums[end] - sums[start]) % m * back[start] % m for m, sums, back in self.lanes)
        return _mixed(one << np.uint64(32) | two)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, offset in it, bytes, offsets): whole texts, or overlapping parts of a long one."""
    first = 0
    for part in chunks(texts, PIECE + WINDOW):
        data, offsets = text_bytes(part)
        if len(data) <= PIECE + WINDOW:
            yield first, 0, data, offsets
        else:
            for at in range(0, len(data) - WINDOW + 1, PIECE):
                some = data[at : at + PIECE + WINDOW - 1]
                yield first, at, some, np.array([0, len(some)])
        first += len(part)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, at, low, high, gram, around) of the strings that windows are dealt to.

    ``at`` is where the string starts; the windows that are dealt to it start ``low`` to ``high``
    bytes before. ``around`` identifies the bytes of all of them together, by a hash of the bytes
    themselves, so members of equal (gram, around) are equal but for a chance of 2^-64 a pair.
    """
    n = len(data) - GRAM + 1
    if n < SPREAD:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    rolling = Rolling(data)
    gram = rolling(np.arange(n), np.arange(GRAM, GRAM + n))
    # lowest of every SPREAD consecutive keys, the leftmost on ties: prefix and suffix minima of blocks
    blocks = -(-n // SPREAD)
    keys = np.full(blocks * SPREAD, ~np.uint64(0))
    keys[:n] = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    grid = keys.reshape(blocks, SPREAD)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - SPREAD + 1
    chosen = (np.minimum(after[:starts], before[SPREAD - 1 : SPREAD - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.flatnonzero(np.arange(starts) + WINDOW <= offsets[text + 1])
    chosen, text = chosen[inside], text[inside]
    if not len(inside):
        return anchors(data[:0], offsets[:1])
    first = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(chosen)) - 1
    at, low, high = chosen[first], chosen[first] - inside[last], chosen[first] - inside[first]
    view, spans = memoryview(np.ascontiguousarray(data)), zip((at - high).tolist(), (at + WINDOW - low).tolist(), strict=True)
    names = b"".join([hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in spans])
    around = np.frombuffer(names, np.uint64) ^ _mixed((low * WINDOW + high + 1).astype(np.uint64))
    return text[first], at - offsets[text[first]], low, high, gram[at], around


def _anchor_lists(text: Column) -> Column:
    """array of ``ANCHOR`` structs of a text."""
    kind = pa.struct([("gram", pa.int64()), ("around", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in each(batches, 1 << 20):
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for first, base, data, offsets in _pieces(batch):
                text_, at, low, high, gram, around = anchors(data, offsets)
                for column, part in zip(columns, (text_ + first, gram.view(np.int64), around.view(np.int64), at + base, low, high), strict=True):
                    column.append(part)
            of, *rest = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
            at = np.searchsorted(of, np.arange(len(batch) + 1))
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(r).cast(f.type) for r, f in zip(rest, kind, strict=True)], fields=list(kind)))

    return F.arrow_udf(run, f"array<struct<{ANCHOR.replace(' ', ':').replace(',:', ',')}>>")(text)


def _surroundings(text: Column, members: Column) -> Column:
    """For each (at, low, high): the halves of its windows, as (half, key, at, low, high, bytes).

    ``key`` identifies the bytes that all windows of the half share, ``low`` and ``high`` are how
    many bytes before ``at`` the last and the first of this member's windows start, and ``bytes``
    are those of all of them.
    """
    kind = pa.list_(pa.struct([("half", pa.int32()), ("key", pa.binary()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())]))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for k, members_ in enumerate(lists.to_pylist()):
                data, _ = text_bytes(texts.slice(k, 1))
                rows = []
                for m in members_ or ():
                    at = m["at"]
                    for half, (first, last) in enumerate(HALVES):
                        low, high = max(m["low"], first), min(m["high"], last)
                        if low <= high:
                            key = hashlib.blake2b(data[at - first : at + WINDOW - last], digest_size=16, salt=bytes([half])).digest()
                            rows.append({"half": half, "key": key, "at": at, "low": low, "high": high, "bytes": data[at - high : at + WINDOW - low].tobytes()})
                out.append(rows)
            yield pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<half:int,key:binary,at:bigint,low:int,high:int,bytes:binary>>")(text, members)


def _paired(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets after one refinement: members stay together if they agree in both."""
    return np.unique(bucket * (int(later.max()) + 1) + later, return_inverse=True)[1].astype(np.int64)


def _refined(bucket: np.ndarray, data: np.ndarray, place: np.ndarray, step: int, reach: np.ndarray, width: int) -> list[np.ndarray]:
    """Bucket identifiers after 0, 1, … ``width`` bytes from ``place`` on in steps of 1 or -1.

    Member k has ``reach[k]`` bytes there; beyond, its symbol is one that no byte has. The buckets of
    w bytes are those of w less its lowest binary digit, refined by the identifiers of that many
    bytes from there on, which halve down to symbols.
    """
    known: dict[tuple[int, int], np.ndarray] = {}

    def pointer(size: int, offset: int) -> np.ndarray:
        if (size, offset) not in known:
            if size == 1:
                inside = reach > offset
                known[size, offset] = np.where(inside, data[np.where(inside, place + step * offset, 0)], 256).astype(np.int64)
            else:
                known[size, offset] = _paired(pointer(size // 2, offset), pointer(size // 2, offset + size // 2))
        return known[size, offset]

    out = [bucket]
    for w in range(1, width + 1):
        if out[-1].max() + 1 == len(bucket):
            out.append(out[-1])
        else:
            out.append(_paired(out[w - (w & -w)], pointer(w & -w, w - (w & -w))))
    return out


def _repeated_windows(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(member, distance before its string) of the windows that two members of a bucket have."""
    members, distances = [], []
    keys = np.unique(np.array(batch.column("key").to_pylist(), "S16"), return_inverse=True)[1].astype(np.int64)
    column = lambda c: batch.column(c).to_numpy().astype(np.int64)
    half, low, high = column("half"), column("low"), column("high")
    data, offsets = text_bytes(batch.column("bytes").combine_chunks())
    for k, (first, last) in enumerate(HALVES):
        own = np.flatnonzero(half == k)
        if not len(own):
            continue
        bucket = np.unique(keys[own], return_inverse=True)[1].astype(np.int64)
        begin, lo, hi = offsets[own], low[own], high[own]
        width = last - first
        left = _refined(bucket, data, begin + hi - first - 1, -1, hi - first, width)
        right = _refined(bucket, data, begin + hi + WINDOW - last, 1, last - lo, width)
        for d in range(first, last + 1):
            here = np.flatnonzero((lo <= d) & (d <= hi))
            _, which, times = np.unique(left[d - first][here] * (len(own) + 1) + right[last - d][here], return_inverse=True, return_counts=True)
            twice = here[times[which] > 1] if len(here) else here
            members.append(own[twice])
            distances.append(np.full(len(twice), d))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *members]), np.concatenate([empty, *distances])


def _refined_in_task(table: pa.Table) -> pa.Table:
    """Spans of the windows that occur twice among the members of a task's buckets."""
    member, distance = _repeated_windows(table)
    at = table.column("at").to_numpy()[member] - distance
    order = np.lexsort((at, member))
    member, at = member[order], at[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (member[1:] != member[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return pa.table({"row": table.column("row").take(pa.array(member[first])), "from": at[first], "to": at[last] + WINDOW})


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, row, start): the windows of members of large buckets by their identifiers."""
    for batch in batches:
        for k in range(0, len(batch), 500):
            some = batch.slice(k, 500)
            data, offsets = text_bytes(some.column("bytes"))
            low, high = (some.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            each_ = high - low + 1
            member = np.repeat(np.arange(len(each_)), each_)
            step = np.arange(len(member)) - np.repeat(np.cumsum(each_) - each_, each_)
            place = offsets[:-1][member] + step
            name = Rolling(data)(place, place + WINDOW) ^ Residues(data)(place, place + WINDOW)
            index = pa.array(member)
            yield pa.RecordBatch.from_arrays([some.column("key").take(index), pa.array(name.view(np.int64)), some.column("row").take(index), pa.array((some.column("at").to_numpy() - high)[member] + step)], ["key", "name", "row", "start"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(row, from, to): byte spans of each row's text that windows occurring elsewhere cover.

    ``texts`` has row (binary) and text; rows of one id must be copies of each other. Buckets of
    at most ``MAX_IN_TASK`` members are refined inside tasks, by bytes; larger ones by a shuffle
    of their windows, of which two are equal if bucket (128 bits) and identifier (64) are.
    """
    found = written(texts.select("row", F.explode(_anchor_lists(F.col("text"))).alias("a")).select("row", "a.*"))
    cells = found.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "low", "high")).alias("first"))
    cells = written(cells)
    shared = cells.where("n > 1").select("gram", "around")
    whole = found.join(shared, ["gram", "around"]).select("row", (F.col("at") - F.col("high")).alias("from"), (F.col("at") + WINDOW - F.col("low")).alias("to"))

    differing = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram")
    members = cells.join(differing, "gram").select("first.*")
    lists = members.groupBy("row").agg(F.collect_list(F.struct("at", "low", "high")).alias("members"))
    sides = texts.join(lists, "row").select("row", F.explode(_surroundings(F.col("text"), F.col("members"))).alias("s")).select("row", "s.*").dropDuplicates(["row", "half", "at", "high"])
    sides = written(sides)
    keys = written(sides.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = max(1, -(-sides.count() // TASK_MEMBERS))
    left = sides.join(keys, "key")
    within = left.where(F.col("n") <= MAX_IN_TASK).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    within = within.select("part", "row", "half", "key", "at", "low", "high", "bytes").groupBy("part").applyInArrow(_refined_in_task, "row binary, from bigint, to bigint")
    names = left.where(F.col("n") > MAX_IN_TASK).select("key", "row", "at", "low", "high", "bytes").mapInArrow(_window_rows, "key binary, name bigint, row binary, start bigint")
    pair = F.struct("row", "start")
    twice = names.groupBy("key", "name").agg(F.min(pair).alias("a"), F.max(pair).alias("b")).where("a <> b").select("key", "name")
    across = names.join(twice, ["key", "name"]).select("row", F.col("start").alias("from"), (F.col("start") + WINDOW).alias("to"))
    return whole.unionByName(within).unionByName(across)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _cut(text: Column, spans: Column) -> Column:
    """struct(n_bytes, n_removed, spans, kept): a text without the bytes of its spans."""
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            out = []
            for k, spans_ in enumerate(lists.to_pylist()):
                data, _ = text_bytes(texts.slice(k, 1))
                runs = _merged(spans_ or [])
                parts, at = [], 0
                for a, b in runs:
                    parts.append(data[at:a])
                    at = b
                parts.append(data[at:])
                out.append({"n_bytes": len(data), "n_removed": sum(b - a for a, b in runs), "spans": [{"from": a, "to": b} for a, b in runs], "kept": b"".join(p.tobytes() for p in parts)})
            yield pa.array(out, kind)

    return F.arrow_udf(run, "n_bytes bigint, n_removed bigint, spans array<struct<from:bigint,to:bigint>>, kept binary")(text, spans)


def without_repeats(docs: DataFrame, into: str = "_r") -> DataFrame:
    """``docs`` (all columns) with ``into``: struct(n_bytes, n_removed, spans, kept) of each text.

    A null text is empty, and an empty table gives no rows. Rows with the same doc_id and text are
    copies of each other: what they hold is repeated, as it is for copies under different ids.
    """
    row = identity(F.col("doc_id"), F.col("text"))
    texts = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(texts).groupBy("row").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    all_ = docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row")).join(spans, "row", "left")
    return all_.select("doc.*", _cut(F.col("doc.text"), F.col("spans")).alias(into))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    cut = without_repeats(docs.select("doc_id", "text"))
    return cut.select("doc_id", "_r.n_bytes", "_r.n_removed", F.size("_r.spans").cast("bigint").alias("n_spans"), F.sha2("_r.kept", 256).alias("kept_sha256"))
