"""Quality rules of single texts, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.llm._batch import LOWER, SPACE, chunks, each, per_text, slices, text_bytes, with_breaks, word_bounds

#: Fixed value: the symbols that are counted.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate of a host if more documents than this, and more than this share of the
#: host's, contain it, and more different texts than this: so a line that only the many copies of a
#: few texts hold isn't.
MAX_LINE_DOCS = 50
MAX_LINE_SHARE = 0.10
MIN_LINE_TEXTS = 12
#: A document is depleted if fewer words, or a smaller share of them, are left without such lines.
MIN_LEFT_WORDS = 20
MIN_LEFT_SHARE = 0.3
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_positions(ids: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window that its own text holds twice or more.

    Windows get exact ranks by doubling: the rank of a window of 2k words is that of its halves'
    ranks. ``window`` is a power of two.
    """
    n = len(ids)
    text_of = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    at = np.flatnonzero(left >= window)
    covered = np.zeros(n, bool)
    if not len(at):
        return covered
    rank, size = ids, 1
    while size < window:
        pad = np.concatenate((rank[size:], np.zeros(size, np.int64)))
        rank, size = _ranked(rank * (int(pad.max()) + 1) + pad), 2 * size
    keys = rank[at] * len(counts) + text_of[at]
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    change = np.zeros(n + 1, np.int64)
    hits = at[times[which] > 1]
    np.add.at(change, hits, 1)
    np.add.at(change, hits + window, -1)
    return np.cumsum(change[:-1]) > 0


def base_counts(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``COUNTS`` for each text; a null text has none of anything."""
    data, offsets = text_bytes(texts)
    data, offsets = with_breaks(data, offsets)
    blank = SPACE[data]
    starts, ends, counts = word_bounds(blank, offsets)
    sizes = np.diff(offsets)
    lead = ((data & 0xC0) != 0x80) & ~blank
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    words = slices(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    repeats = per_text(repeated_positions(words, counts), counts)

    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.concatenate(([0], breaks + 1))[: len(breaks)]
    in_line = np.searchsorted(starts, breaks) - np.searchsorted(starts, line_starts) > 0
    line_text = np.searchsorted(offsets, line_starts, side="right") - 1
    lines = slices(data, line_starts, breaks).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = (line_text * (len(lines) + 1) + lines)[in_line]
    distinct = np.unique(keys) // (len(lines) + 1)
    n_lines = np.bincount(line_text[in_line], minlength=len(texts))
    dups = n_lines - np.bincount(distinct, minlength=len(texts))
    return [counts, per_text(lead, sizes), per_text(symbol[data], sizes), dups, repeats]


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, words): the distinct normalised lines of each text, and the words in all that are alike.

    Words are ASCII lower-cased and stand one space apart; lines without a word aren't listed.
    """
    data, offsets = text_bytes(texts)
    data, offsets = with_breaks(LOWER[data], offsets)
    breaks = np.flatnonzero(data == 0x0A)
    blank = SPACE[data]
    starts, ends, _ = word_bounds(blank, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    keep = ~blank
    keep[ends] = True
    data[ends] = 0x20
    packed = data[keep].tobytes()
    stops = np.cumsum(ends - starts + 1) - 1
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    last = np.append(first[1:], len(starts)) - 1
    begins = stops - (ends - starts)
    hashes = np.array([xxhash.xxh64_intdigest(packed[a:b]) for a, b in zip(begins[first].tolist(), stops[last].tolist(), strict=True)], np.uint64)
    text = np.searchsorted(offsets, starts[first], side="right") - 1
    order = np.lexsort((hashes, text))
    hashes, text, words = hashes[order], text[order], (last - first + 1)[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at].view(np.int64), np.add.reduceat(words, at)


MEASURED = COUNTS + ", lines array<struct<hash:bigint,n:bigint>>"


def measured(text: Column) -> Column:
    """struct of ``MEASURED`` for a text: its counts, and its distinct lines with their words."""
    names = [part.split()[0] for part in COUNTS.split(", ")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches):
            of, hashes, words = line_words(texts)
            at = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
            lines = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int64())], ["hash", "n"]))
            yield pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in base_counts(texts)], lines], [*names, "lines"])

    return F.arrow_udf(run, MEASURED)(text)


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes ``gone``; null where it has none of them."""

    def cut(t: str, drop: set[int]) -> str:
        lines = t.split("\n")
        own = (line.encode().translate(LOWER.tobytes()).split() for line in lines)
        return "\n".join(line for line, words in zip(lines, own, strict=True) if not words or xxhash.xxh64_intdigest(b" ".join(words)) not in drop)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hashes in batches:
            at = 0
            for part in chunks(texts):
                drops = hashes.slice(at, len(part)).to_pylist()
                at += len(part)
                yield pa.array([cut(part[k].as_py(), {h % (1 << 64) for h in drop}) if drop else None for k, drop in enumerate(drops)], pa.string())

    return F.arrow_udf(run, "string")(text, gone)


def frequent_lines(texts: DataFrame) -> DataFrame:
    """(host, frequent): the hashes of the lines that are boilerplate of each host that has any.

    ``texts`` has host, key (of the document), content (of the text) and lines. Lines are first counted
    by rows, in every task before the shuffle, so neither a host nor a line that a third of all rows
    share is one task's work. Only for those that could be above the limits are distinct documents and
    distinct texts counted, exactly. Each of these is in over a tenth of the host's documents, so a
    host has at most ten times as many as its documents have lines, on average.
    """
    lines = texts.select("host", F.explode("lines.hash").alias("hash"))
    often = lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > MAX_LINE_DOCS)
    hosts = texts.groupBy(F.col("host").alias("of")).agg(F.count_distinct("key").alias("n_host"))
    above = often.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_rows") > MAX_LINE_SHARE * F.col("n_host"))
    likely = written(above.groupBy(F.col("host").alias("of")).agg(F.collect_list("hash").alias("likely"), F.max("n_host").alias("n_host")))
    held = texts.join(likely, F.col("host").eqNullSafe(F.col("of"))).select("host", "n_host", "key", "content", F.explode(F.array_intersect("lines.hash", "likely")).alias("hash"))
    counted = held.groupBy("host", "hash").agg(F.max("n_host").alias("n_host"), F.count_distinct("key").alias("n_docs"), F.count_distinct("content").alias("n_texts"))
    over = (F.col("n_docs") > MAX_LINE_DOCS) & (F.col("n_docs") > MAX_LINE_SHARE * F.col("n_host")) & (F.col("n_texts") > MIN_LINE_TEXTS)
    return counted.where(over).groupBy("host").agg(F.collect_list("hash").alias("frequent"))


def judged(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, q, gone) of every row of ``docs``: its columns ``keep`` (all of them), the verdict, and its frequent lines.

    ``q`` holds the counts, base_failed and kept. A document fails by its own text (fewer than 20
    words, or over 30 percent of its words in repeated windows), or since too little is left of it
    without its host's frequent lines; ``gone`` has the hashes of those. ``source`` is the host; a null
    source is a host of its own, a null or empty text fails, rows of one doc_id are one document (rows
    without an id are the same if their texts are), and an empty table gives no rows. Texts are read
    once: what is measured is written beside ``keep``, and the frequent lines are joined by host, by
    whichever join their size calls for.
    """
    content = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.hex(content)))
    texts = written(docs.select(F.struct(*(keep or docs.columns)).alias("doc"), F.col("source").alias("host"), key.alias("key"), content.alias("content"), measured(F.col("text")).alias("m")))
    frequent = written(frequent_lines(texts.select("host", "key", "content", "m.lines"))).withColumnRenamed("host", "of")
    joined = texts.join(frequent, F.col("host").eqNullSafe(F.col("of")), "left")
    hits = joined.select("doc", "m", F.coalesce(F.array_intersect("m.lines.hash", "frequent"), F.array().cast("array<bigint>")).alias("gone"))
    words = F.aggregate(F.filter("m.lines", lambda line: F.array_contains("gone", line["hash"])), F.lit(0).cast("bigint"), lambda n, line: n + line["n"])
    left = F.col("m.n_words") - F.when(F.size("gone") > 0, words).otherwise(0)
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    depleted = (left < MIN_LEFT_WORDS) | (left < MIN_LEFT_SHARE * F.col("m.n_words"))
    counts = [F.col(f"m.{part.split()[0]}") for part in COUNTS.split(", ")]
    return hits.select("doc", F.struct(*counts, failed.alias("base_failed"), (~failed & ~depleted).alias("kept")).alias("q"), "gone")


def kept_documents(docs: DataFrame) -> DataFrame:
    """(doc, text): the rows of ``docs`` that pass, and their texts without their host's frequent lines."""
    kept = judged(docs).where("q.kept")
    return kept.select("doc", F.coalesce(without_lines(F.col("doc.text"), F.col("gone")), F.col("doc.text")).alias("text"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of every row of ``docs``; see ``judged`` for nulls, repeated rows and empty tables."""
    return judged(docs, ["doc_id"]).select("doc.doc_id", "q.*")
