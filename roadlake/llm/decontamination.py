"""Benchmark passages in documents, found by backward search in an FM-index of each shard."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlake.functions.storage import written
from roadlake.llm._batch import LOWER, each, identity, slices, text_bytes, with_breaks, word_bounds

#: Words of a window.
WINDOW = 10
#: Benchmark text that goes to every worker at once; a larger benchmark goes in several passes.
BLOCK_BYTES = 8 << 20
#: Text that one index covers, about.
SHARD_BYTES = 1 << 20
#: Every so many symbols of a shard have their place kept.
SAMPLE = 8

#: Fixed value: bytes of words. Letters, digits, and all bytes of code points above 0x7F.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, ASCII lower-cased, and how many each text has."""
    data, offsets = text_bytes(texts)
    data, offsets = with_breaks(LOWER[data], offsets)
    starts, ends, counts = word_bounds(SEPARATOR[data], offsets)
    return slices(data, starts, ends), counts


class Wavelet:
    """Ranks over a sequence of symbols: one bit of each symbol a level, zeros moved to the front."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            bit = (symbols >> level) & 1
            before = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(bit) - int(before[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(place), place
        for k, level in enumerate(reversed(range(self.bits))):
            one = ((symbol >> level) & 1).astype(bool)
            before = self.ones[k]
            a, b = before[start], before[end]
            start = np.where(one, self.zeros[k] + a, start - a)
            end = np.where(one, self.zeros[k] + b, end - b)
        return end - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; ends when all ranks differ. Zeros differ by their places."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + int(zero.sum()))
    size = 1
    while True:
        pad = np.zeros(n, np.int64)
        pad[: n - size] = rank[size:] + 1 if size < n else 0
        key = rank * (int(rank.max()) + 2) + pad
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or size >= n:
            return order
        size *= 2


class Index:
    """FM-index of a shard: runs of symbols from 1 on, a zero after each run."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        order = suffix_order(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix
        self.tree = Wavelet(self.last, max(1, int(top).bit_length()))
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.first[1:])
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == 0)  # a walk never leaves its run
        self.kept, self.number = kept, np.cumsum(kept) - 1
        self.places = order[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that start with each row of ``windows`` (0: no word)."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), len(self.last), np.int64)
        for k in reversed(range(windows.shape[1])):
            use = np.flatnonzero((windows[:, k] > 0) & (low < high))
            if not len(use):
                continue
            symbol = windows[use, k].astype(np.int64)
            base = self.first[symbol]
            low[use], high[use] = base + self.tree.rank(symbol, low[use]), base + self.tree.rank(symbol, high[use])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: back through the text to the next kept one."""
        steps, rows, todo = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(todo := todo[~self.kept[rows[todo]]]):
            symbol = self.last[rows[todo]]
            rows[todo] = self.first[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
        return self.places[self.number[rows]] + steps


class Phrases(NamedTuple):
    """Windows of a block of the benchmark, over the numbers of its words."""

    vocabulary: pa.Array
    windows: np.ndarray  # [n, WINDOW], right-aligned, word number + 1, 0 where a window is short
    lengths: np.ndarray
    of_item: np.ndarray  # pairs of window and item
    item_of: np.ndarray
    items: list[str | None]


def phrases(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Windows of every item: all of ``window`` words, or the whole of a shorter item."""
    words, counts = words_of(pa.array([t for _, t in items], pa.string()))
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    each_ = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
    owners = np.repeat(np.arange(len(counts)), each_)
    begin = np.cumsum(counts) - counts
    first = begin[owners] + np.arange(len(owners)) - np.repeat(np.cumsum(each_) - each_, each_)
    place = first[:, None] + np.arange(-window, 0) + np.minimum(counts[owners], window)[:, None]
    inside = place >= first[:, None]  # a shorter item's words stand at the right end
    rows = np.where(inside, numbers[np.where(inside, place, 0)] if len(numbers) else 0, 0).astype(np.int32)
    table, which = np.unique(rows.reshape(-1, window), axis=0, return_inverse=True)
    pairs = np.unique(np.stack((which.reshape(-1), owners), 1), axis=0)
    return Phrases(coded.dictionary, table, (table > 0).sum(1), pairs[:, 0], pairs[:, 1], [None if i is None else str(i) for i, _ in items])


def hits(texts: pa.Array, block: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words of each text, the merged spans of hit words, and the items that occur in it.

    Only runs of benchmark words that are long enough to hold a window are indexed: no other
    word can be part of one.
    """
    words, counts = words_of(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    found: list[list[str]] = [[] for _ in counts]
    if not len(words) or not len(block.windows):
        return counts, spans, found
    number = pc.fill_null(pc.index_in(words, value_set=block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    text_of = np.repeat(np.arange(len(counts)), counts)
    inside = number > 0
    begins = inside & (np.concatenate(([True], ~inside[:-1])) | np.concatenate(([True], text_of[1:] != text_of[:-1])))
    run = np.cumsum(begins) * inside
    sizes = np.bincount(run)
    sizes[0] = 0
    place = np.flatnonzero(sizes[run] >= block.lengths.min())
    if not len(place):
        return counts, spans, found
    breaks = np.flatnonzero(np.diff(run[place], append=-1)) + 1
    symbols = np.insert(number[place], breaks, 0)
    origin = np.insert(place, breaks, -1)
    index = Index(symbols, len(block.vocabulary))
    low, high = index.search(block.windows)
    times = high - low
    if not times.sum():
        return counts, spans, found
    which = np.repeat(np.arange(len(times)), times)
    at = origin[index.locate(np.repeat(low - (np.cumsum(times) - times), times) + np.arange(int(times.sum())))]
    change = np.zeros(len(number) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + block.lengths[which], -1)
    hit = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    first = np.concatenate(([0], np.cumsum(counts)))
    edges = np.flatnonzero(np.diff(hit.astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    # a run of hits may go on from the last word of one text to the first of the next
    for k in np.unique(text_of[at]).tolist():
        a, b = int(first[k]), int(first[k + 1])
        for s, e in zip(starts[(s0 := np.searchsorted(ends, a, side="right")) : (e0 := np.searchsorted(starts, b))].tolist(), ends[s0:e0].tolist(), strict=True):
            spans[k].append((max(s, a) - a, min(e, b) - a))
    pairs = np.unique(np.stack((text_of[at], which), 1), axis=0)
    from_, to = np.searchsorted(block.of_item, pairs[:, 1]), np.searchsorted(block.of_item, pairs[:, 1], side="right")
    for k, a, b in zip(pairs[:, 0].tolist(), from_.tolist(), to.tolist(), strict=True):
        found[k].extend(block.items[i] for i in block.item_of[a:b].tolist() if block.items[i] is not None)
    return counts, spans, [sorted(set(x)) for x in found]


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def searched(sent, text: Column, cut: bool = False) -> Column:
    """struct(n_words, spans, items) of a text against a broadcast block of items; spans count words.

    With ``cut`` it also has left, the text without its spans (``without``), null where there is none; so no second function
    needs a worker of its own beside this one.
    """
    fields = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
    arrow = pa.struct([*fields, ("left", pa.string())] if cut else fields)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches, SHARD_BYTES):
            counts, spans, found = hits(texts, sent.value)
            rows = [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in s], "items": i} for n, s, i in zip(counts.tolist(), spans, found, strict=True)]
            if cut:
                for k, row in enumerate(rows):
                    row["left"] = without(texts[k].as_py(), spans[k]) if spans[k] else None
            yield pa.array(rows, arrow)

    # so marked, a text is searched once, however many conditions use what was found
    return F.arrow_udf(run, T.StructType([*RESULT, T.StructField("left", T.StringType())]) if cut else RESULT).asNondeterministic()(text)


def word_count(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches, SHARD_BYTES):
            yield pa.array(words_of(texts)[1], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's rows in blocks of at most ``limit`` bytes of text, or of one row."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        n = len(row[1].encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def merged_spans(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap joined."""
    span = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(span),
        lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, *, cut: bool = False) -> DataFrame:
    """(doc, hits): every row's columns, and struct(n_words, spans, items) of its text against all items; with ``cut`` also left.

    About ``SHARD_BYTES`` of a task's texts are a shard with an index of its own. The benchmark is
    sent in blocks of bounded size, one at a time: what a further block finds in a pass over the
    texts is written, the block is taken back from the workers, and all passes' finds are joined
    by row. Null texts have no words, null items no windows; items with the same id count once; an
    item without an id marks its words and isn't listed; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found, todo = None, blocks(benchmark, block_bytes)
    block, following = next(todo), next(todo, None)
    whole = F.struct(*docs.columns).alias("doc")
    if following is None:
        return docs.select(whole, searched(spark.sparkContext.broadcast(phrases(block)), F.col("text"), cut).alias("hits"))
    row = identity(F.col("doc_id"), F.col("text")).alias("row")
    while block is not None:
        sent = spark.sparkContext.broadcast(phrases(block))
        part = written(docs.select(row, searched(sent, F.col("text")).alias("h")).where(F.size("h.spans") > 0))
        sent.destroy()
        found = part if found is None else found.unionByName(part)
        block, following = following, next(todo, None)
    lists = found.groupBy("row").agg(F.collect_list("h.spans").alias("spans"), F.collect_list("h.items").alias("items"))
    joined = docs.select(whole, row, word_count(F.col("text")).alias("n")).join(lists, "row", "left")
    spans = F.coalesce(merged_spans(F.flatten("spans")), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    items = F.coalesce(F.array_sort(F.array_distinct(F.flatten("items"))), F.array().cast("array<string>"))
    whole = joined.select("doc", F.col("n").alias("n_words"), spans.alias("spans"), items.alias("items"))
    left = [F.when(F.size("spans") > 0, without_spans(F.col("doc.text"), F.col("spans"))).alias("left")] if cut else []
    return whole.select("doc", F.struct("n_words", "spans", "items", *left).alias("hits"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of its spans, and without what lies between those of one."""
    data, offsets = text_bytes(pa.array([text], pa.string()))
    lowered, ends_at = with_breaks(LOWER[data], offsets)
    starts, ends, _ = word_bounds(SEPARATOR[lowered], ends_at)
    keep = np.ones(len(data), bool)
    for a, b in spans:
        keep[starts[a] : ends[b - 1]] = False
    return data[keep].tobytes().decode()


def without_spans(text: Column, spans: Column) -> Column:
    """The text without its hit words, and without what lies between them.

    What stands between two kept words stays as it is.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, marked in batches:
            yield pa.array([without(t, [(s["start"], s["end"]) for s in m]) if m else t for t, m in zip(texts.to_pylist(), marked.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(text, spans)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    found = contaminated(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc.doc_id",
        "hits.n_words",
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
