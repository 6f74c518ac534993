"""Byte-level BPE: pre-tokenisation by transition-function scans, cached merging, decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm._batch import each, per_text, text_bytes

# Symbols: what a code point is to the splitting pattern, the next code points included.
(LETTER, LEAD_ONE, LEAD_TWO, DIGIT, OTHER, QUOTE, SPACE_LAST, BLANK_LAST, BLANK_INSIDE, STOP) = range(10)
# States: what the text so far ends in.
(FRESH, IN_LETTERS, IN_DIGITS, IN_OTHER, AT_QUOTE, AFTER_SPACE, IN_BLANKS, HALF_SUFFIX) = range(8)

#: Fixed value: White_Space of the Unicode Character Database.
BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and digits that Unicode 16.0 added, first and last of each range. The
#: library that the results must equal knows them; Python's tables may be older.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

#: Rank files above this size are refused, since every worker holds one.
MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct pieces whose merges a worker remembers; more are merged again when met.
CACHE_PIECES = 100_000

#: Bytes of text whose tokens are held at once where only numbers or digests of them leave; fewer, larger chunks are quicker.
DIGEST_BYTES = 1 << 20


@cache
def class_table() -> np.ndarray:
    """Symbol of every code point without its neighbours."""
    groups = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((groups.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for symbol, ranges in ((LETTER, NEW_LETTERS), (DIGIT, NEW_DIGITS)):
        for a, b in ranges:
            table[a : b + 1] = symbol
    table[BLANKS] = BLANK_INSIDE
    table[ord("'")] = QUOTE
    for c in "stmd":
        table[ord(c)] = LEAD_ONE
    return table


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts before this code point)."""
    if symbol in (LETTER, LEAD_ONE, LEAD_TWO):
        if state == AT_QUOTE and symbol == LEAD_ONE:
            return FRESH, False
        if state == AT_QUOTE and symbol == LEAD_TWO:
            return HALF_SUFFIX, False
        if state == HALF_SUFFIX:
            return FRESH, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if symbol == DIGIT:
        return IN_DIGITS, state not in (IN_DIGITS, AFTER_SPACE)
    if symbol in (OTHER, QUOTE):
        goes_on = state in (IN_OTHER, AT_QUOTE, AFTER_SPACE)
        return (AT_QUOTE if symbol == QUOTE and not goes_on else IN_OTHER), not goes_on
    if symbol == SPACE_LAST:
        return AFTER_SPACE, True
    if symbol == BLANK_LAST:
        return FRESH, True
    if symbol == BLANK_INSIDE:
        return IN_BLANKS, state != IN_BLANKS
    return FRESH, True


class Scanner(NamedTuple):
    """Transition functions of single symbols, closed under composition."""

    of_symbol: np.ndarray  # function id
    after: np.ndarray  # [f, g] -> id of "f, then g"
    from_fresh: np.ndarray  # state that f reaches from FRESH
    starts: np.ndarray  # [state, symbol] -> a piece starts here


@cache
def scanner() -> Scanner:
    single = [tuple(step(s, c)[0] for s in range(8)) for c in range(10)]
    ids = {f: k for k, f in enumerate(dict.fromkeys([tuple(range(8)), *single]))}
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in single:
            h = tuple(g[s] for s in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    functions = list(ids)
    after = np.array([[ids[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint8)
    starts = np.array([[step(s, c)[1] for c in range(10)] for s in range(8)])
    return Scanner(np.array([ids[f] for f in single], np.uint8), after, np.array([f[FRESH] for f in functions], np.uint8), starts)


def scanned(functions: np.ndarray, after: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix compositions: within columns of blocks, then over the blocks' totals."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for k in range(1, n):
            out[k] = after[out[k - 1], out[k]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), functions.dtype)  # id 0 is the identity
    padded = np.zeros(rows * width, functions.dtype)
    padded[:n] = functions
    grid[:] = padded.reshape(rows, width).T
    for k in range(1, width):
        grid[k] = after[grid[k - 1], grid[k]]
    before = np.zeros(rows, functions.dtype)
    before[1:] = scanned(grid[-1], after)[:-1]
    return after[before[None, :], grid].T.reshape(-1)[:n]


def symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Symbol of every code point; ``stops`` are the positions between texts."""
    out = class_table()[points]
    out[stops] = STOP
    following = np.append(points[1:], 0)
    for first, second in (("r", "e"), ("v", "e"), ("l", "l")):
        out[(points == ord(first)) & (following == ord(second)) & (out != STOP)] = LEAD_TWO
    blank = out == BLANK_INSIDE
    last = blank & ~np.append(blank[1:], True) & (np.append(out[1:], STOP) != STOP)
    out[last] = np.where(points[last] == 0x20, SPACE_LAST, BLANK_LAST)
    return out


class Encoded(NamedTuple):
    """Token ids of consecutive texts."""

    ids: np.ndarray
    counts: np.ndarray  # tokens of each text
    ends: np.ndarray  # byte offset after each token, over all texts together


class Vocabulary:
    """Ranks of a byte-level BPE, with a bounded cache of merged pieces."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b"%d," % k for k in range(size)], pa.large_binary())
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.known: dict[bytes, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is joined first, the leftmost on ties."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        found = self.known.get(piece)
        if found is None:
            found = self._merge_short(piece) if len(piece) <= 48 else self._merge_long(piece)
            if len(piece) <= 256:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _merge_short(self, piece: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pair = [get(piece[k : k + 2], none) for k in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            k = pair.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pair[k]
            if k < len(pair):
                pair[k] = get(parts[k] + parts[k + 1], none)
            if k:
                pair[k - 1] = get(parts[k - 1] + parts[k], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is joined to its left
        left = list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, to = heapq.heappop(heap)
            middle = end[k]
            if not middle or middle >= n or end[middle] != to:
                continue
            end[k], end[middle] = to, 0
            if to < n:
                left[to] = k
            for a, b in ((left[k], to), (k, end[to] if to < n else 0)):
                if a >= 0 and b and (r := get(piece[a:b])) is not None:
                    heapq.heappush(heap, (r, a, b))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[piece[k : end[k]]])
            k = end[k]
        return out

    def encode(self, texts: pa.Array) -> Encoded:
        """Ids of every text; null is empty."""
        data, offsets = text_bytes(texts)
        pieces, counts = split(data, offsets)
        coded = pieces.dictionary_encode()
        merged = [self.merged(p) for p in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter((i for m in merged for i in m), np.int64, int(sizes.sum()))
        which = coded.indices.to_numpy(zero_copy_only=False)
        size = sizes[which]
        before = np.cumsum(size) - size
        first = (np.cumsum(sizes) - sizes)[which]
        ids = flat[np.repeat(first - before, size) + np.arange(int(size.sum()))] if len(which) else np.zeros(0, np.int64)
        return Encoded(ids, per_text(size, counts), np.cumsum(self.lengths[ids]))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return text_bytes(self.tokens.take(pa.array(ids)))[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts as slices of their bytes, and how many each text has."""
    lead = (data & 0xC0) != 0x80
    points_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=points_before[1:])
    lengths = np.diff(points_before[offsets])
    ends = np.cumsum(lengths + 1)
    points = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    real = np.ones(len(points), bool)
    real[ends - 1] = False
    points[real] = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    coded, scan = symbols(points, ends - 1), scanner()
    states = scan.from_fresh[scanned(scan.of_symbol[coded], scan.after)]
    starts = scan.starts[np.concatenate(([FRESH], states[:-1])).astype(np.intp), coded]
    byte_at = np.flatnonzero(lead)[starts[real]]
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(byte_at), [None, pa.py_buffer(np.append(byte_at, len(data)).astype(np.int64)), pa.py_buffer(data.tobytes())])
    return pieces, np.diff(np.searchsorted(byte_at, offsets))


_loaded: dict[int, Vocabulary] = {}


def vocabulary(ranks) -> Vocabulary:
    """The broadcast vocabulary, built once in each worker."""
    if ranks.id not in _loaded:
        _loaded.clear()
        _loaded[ranks.id] = Vocabulary(ranks.value)
    return _loaded[ranks.id]


class Handle(NamedTuple):
    """A broadcast rank file; ``id`` tells workers whether they have it."""

    id: str
    sent: object

    @property
    def value(self) -> bytes:
        return self.sent.value


def ship(spark, path: str) -> Handle:
    """Send the rank file at ``path`` (a parameter; its size is checked) to the workers."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} exceeds {MAX_VOCABULARY_BYTES} bytes")
    return Handle(hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw))


def encoded(spark, path: str, text: Column) -> Column:
    """struct(ids array<int>, ends array<bigint>): tokens of a text and the byte offset after each.

    A null or empty text has no tokens.
    """
    ranks = ship(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(ranks)
        for texts in each(batches):
            got = words.encode(texts)
            _, offsets = text_bytes(texts)
            at = pa.array(np.concatenate(([0], np.cumsum(got.counts))), pa.int32())
            ends = got.ends - np.repeat(offsets[:-1], got.counts)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(got.ids, pa.int32())), pa.ListArray.from_arrays(at, pa.array(ends, pa.int64()))], ["ids", "ends"])

    return F.arrow_udf(run, "ids array<int>, ends array<bigint>")(text)


def decoded(spark, path: str, ids: Column) -> Column:
    """The bytes that an array of ids stands for; a null array stays null."""
    ranks = ship(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(ranks)
        for batch in batches:
            yield pa.array([None if row is None else words.decode(np.array(row, np.int64)).tobytes() for row in batch.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(ids)


def digested(spark, path: str, text: Column) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and hash both.

    Texts go through in chunks of bounded bytes, so nothing but one chunk's tokens is held.
    """
    ranks = ship(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(ranks)
        for texts in each(batches, DIGEST_BYTES):
            hashes, backs = [], []
            got = words.encode(texts)
            ids = pa.array(got.ids)
            listed, marks = text_bytes(words.decimals.take(ids))
            back, cuts = text_bytes(words.tokens.take(ids))
            for n, b in zip(got.counts.tolist(), np.cumsum(got.counts).tolist(), strict=True):
                a = b - n
                hashes.append(hashlib.sha256(listed[marks[a] : max(marks[a], marks[b] - 1)]).hexdigest())
                backs.append(hashlib.sha256(back[cuts[a] : cuts[b]]).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(got.counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")(text)


def token_lengths(spark, path: str, text: Column) -> Column:
    """Number of tokens of a text; null and empty have 0."""
    ranks = ship(spark, path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(ranks)
        for texts in each(batches, DIGEST_BYTES):
            yield pa.array(words.encode(texts).counts, pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the digests of every row of ``docs``; repeated and null ids keep their rows."""
    got = docs.select("doc_id", digested(docs.sparkSession, path, F.col("text")).alias("_d"))
    return got.select("doc_id", "_d.*")
