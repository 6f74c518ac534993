"""How far the words of sources differ: byte tries of term counts, merged by ranges of prefixes."""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written
from roadlake.llm._batch import chunks

#: A term is kept if so many documents of its language have it.
MIN_DOCS = 3
#: Ranks of the part ``term``.
TOP = 200
UNIT = 1_000_000_000
#: Bytes of text between two looks at a task's counters, and how many it holds before they leave it as tries.
CHUNK, MAX_COUNTERS = 1 << 20, 1 << 20
#: Rows of a batch that leaves a task.
ROWS = 1 << 14
#: Sources whose sums a task holds at once, and the numbers that it compares at once.
SOURCE_BLOCK, CELLS = 64, 1 << 18
#: Numbers that a task compares in all, as far as there are partitions to deal more to.
TASK_CELLS = 1 << 34
#: Fixed value: bytes of terms, A to Z in lower case; all others separate.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAVES = "lang string, term string, n_docs bigint, counts array<struct<source:string,n:bigint>>"


class Trie:
    """A radix trie over bytes: an edge holds the longest run that all terms below it share.

    A node is its edges by first byte, as (label, below); its own leaf is under ``OWN``. Below an edge
    is a node or, where nothing branches, the number of the leaf alone.
    """

    __slots__ = ("root", "size")
    OWN = -1

    def __init__(self) -> None:
        self.root, self.size = {}, 0

    def _new(self) -> int:
        self.size += 1
        return self.size - 1

    def leaf(self, term: bytes) -> int:
        """The number of a term's leaf; new leaves get the next one."""
        node, at = self.root, 0
        while at < len(term):
            first = term[at]
            edge = node.get(first)
            if edge is None:
                number = self._new()
                node[first] = term[at:], number
                return number
            label, below = edge
            if term.startswith(label, at):
                at += len(label)
                if type(below) is int:
                    if at == len(term):
                        return below
                    below = {self.OWN: below}
                    node[first] = label, below
            else:
                same = 1
                while at + same < len(term) and label[same] == term[at + same]:
                    same += 1
                below = {label[same]: (label[same:], below)}
                node[first] = label[:same], below
                at += same
            node = below
        if self.OWN not in node:
            node[self.OWN] = self._new()
        return node[self.OWN]

    def walk(self) -> tuple[list[bytes], list[int]]:
        """(terms, leaves) in the order of their bytes, which is that of UTF-8."""
        terms, leaves, open_ = [], [], [(b"", self.root)]
        while open_:
            term, below = open_.pop()
            if type(below) is int:
                terms.append(term)
                leaves.append(below)
                continue
            for first in sorted(below, reverse=True):
                edge = below[first]
                open_.append((term, edge) if first == self.OWN else (term + edge[0], edge[1]))
        return terms, leaves


def _table(lang: pa.Array, terms: pa.Array, n_docs: np.ndarray, at: np.ndarray, sources: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
    counts = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([sources, pa.array(numbers, pa.int64())], ["source", "n"]))
    return pa.RecordBatch.from_arrays([lang, terms, pa.array(n_docs, pa.int64()), counts], ["lang", "term", "n_docs", "counts"])


def _numbers(values, n: int) -> np.ndarray:
    return np.fromiter(values, np.int64, n)


def _tries(words: dict, holders: dict) -> Iterator[pa.RecordBatch]:
    """The leaves of one trie a language, in order: documents of each, and occurrences by source."""
    for lang in sorted(holders):
        trie, docs = Trie(), holders[lang]
        gc.disable()  # nothing here is garbage, and looking for it takes a third of the time
        leaf = {term: trie.leaf(term) for term in docs}
        terms, order = trie.walk()
        gc.enable()
        place = np.zeros(trie.size, np.int64)
        place[order] = np.arange(trie.size)
        sources = sorted(source for of, source in words if of == lang)
        own = [words[lang, source] for source in sources]
        at = place[np.concatenate([_numbers(map(leaf.__getitem__, c), len(c)) for c in own])]
        numbers = np.concatenate([_numbers(c.values(), len(c)) for c in own])
        origin = np.repeat(np.arange(len(own)), [len(c) for c in own])
        by_leaf = np.argsort(at, kind="stable")
        numbers, origin = numbers[by_leaf], pa.array(sources, pa.string()).take(pa.array(origin[by_leaf]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=trie.size))])
        n_docs, names = _numbers(docs.values(), len(docs))[order], pa.array(terms, pa.binary()).cast(pa.string())
        for low in range(0, trie.size, ROWS):
            high = min(low + ROWS, trie.size)
            a, b = ends[low], ends[high]
            yield _table(pa.repeat(lang, high - low), names.slice(low, high - low), n_docs[low:high], ends[low : high + 1] - a, origin.slice(a, b - a), numbers[a:b])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of a task's texts; counters that grow many leave early."""
    words: dict = {}
    holders: dict = {}
    for batch in batches:
        lang, source, at = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), 0
        for texts in chunks(batch.column("text"), CHUNK):
            for k, text in enumerate(texts.cast(pa.binary()).to_pylist(), at):
                found = text.translate(TERM_BYTES).split()
                words.setdefault((lang[k], source[k]), Counter()).update(found)
                holders.setdefault(lang[k], Counter()).update(set(found))
            at += len(texts)
            if sum(map(len, words.values())) > MAX_COUNTERS:
                yield from _tries(words, holders)
                words, holders = {}, {}
    yield from _tries(words, holders)


def merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries' leaves in the order of (lang, term), equal ones merged; terms of too few documents go.

    The last term of a batch waits for the next one, which may go on with it.
    """
    rest = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            first = _first_of_each(rows)
            yield from _merged(rows.slice(0, first[-1]), first[:-1])
            rest = rows.slice(first[-1])
    if rest is not None:
        yield from _merged(rest, np.zeros(1, np.int64))


def _first_of_each(rows: pa.RecordBatch) -> np.ndarray:
    """Where a new (lang, term) begins."""
    n = rows.num_rows
    other = lambda c: pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other("lang") | other("term")) + 1])


def _merged(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(first):
        return
    n_docs = np.add.reduceat(rows.column("n_docs").to_numpy(), first)
    kept = n_docs >= MIN_DOCS
    if not kept.any():
        return
    lists = rows.column("counts")
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    group = np.repeat(np.arange(len(first)), np.diff(np.append(ends[first], ends[-1])))
    used = np.flatnonzero(kept[group])
    source = flat.field("source").take(pa.array(used)).dictionary_encode()
    n_sources = len(source.dictionary)
    keys, which = np.unique((np.cumsum(kept) - 1)[group[used]] * n_sources + source.indices.to_numpy(), return_inverse=True)
    numbers = np.zeros(len(keys), np.int64)
    np.add.at(numbers, which, flat.field("n").to_numpy()[used])
    starts, index = np.searchsorted(keys, np.arange(kept.sum() + 1) * n_sources), pa.array(first[kept])
    yield _table(rows.column("lang").take(index), rows.column("term").take(index), n_docs[kept], starts, source.dictionary.take(pa.array(keys % n_sources)), numbers)


def kept_terms(texts: DataFrame) -> DataFrame:
    """``LEAVES`` of the terms that at least three documents of their language have, as a written table.

    Each task's tries leave it leaf by leaf; ranges of (lang, term) are dealt to tasks, which merge
    them in the order of their bytes, a batch at a time. A term that every text has is one row of
    each trie before.
    """
    leaves = written(texts.mapInArrow(count_terms, LEAVES))
    merged = written(leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge_ranges, LEAVES))
    drop_written(leaves)
    return merged


def probabilities(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals below 9 * 10^15, three digits at a time."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + whole
    return out + 1


class _Sums:
    """What one task knows of a block of sources: sums of pairs, and the best terms."""

    def __init__(self, lang: str, block: int, salt: int, names: list[str], totals: np.ndarray, n_terms: int) -> None:
        self.lang, self.names, self.seen, self.first = lang, names, False, salt == 0
        self.low, self.high = block * SOURCE_BLOCK, min((block + 1) * SOURCE_BLOCK, len(names))
        self.totals, self.all = totals + n_terms, int(totals.sum()) + n_terms
        self.pairs = np.zeros((max(self.high - self.low, 0), len(names)), np.int64)
        self.best: list = [(np.zeros(0, np.int64), []) for _ in range(self.low, self.high)]

    def add(self, terms: list[str], counts: np.ndarray) -> None:
        """Terms in the order of their bytes with [term, source] counts."""
        self.seen = True
        p = probabilities(counts, self.totals)
        q = probabilities(counts.sum(1), np.int64(self.all))
        for k in range(self.low, self.high):
            apart = p[:, k, None] - p
            self.pairs[k - self.low] += (apart * apart // p).sum(0)
            at = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
            apart = p[at, k] - q[at]
            values, old = apart * apart // q[at], self.best[k - self.low]
            if len(old[1]) == TOP:  # on a tie the earlier term stays
                at, values = at[values > old[0][-1]], values[values > old[0][-1]]
            if len(at):
                joined, names = np.concatenate([old[0], values]), old[1] + [terms[t] for t in at.tolist()]
                order = np.argsort(-joined, kind="stable")[:TOP]
                self.best[k - self.low] = joined[order], [names[t] for t in order.tolist()]

    def read(self, batch: pa.RecordBatch) -> None:
        """Rows of terms with their counts, in bounded matrices."""
        if self.low >= self.high:
            return
        step, names = max(1, CELLS // len(self.names)), pa.array(self.names, pa.string())
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            lists = part.column("counts")
            flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            counts = np.zeros((len(lists), len(names)), np.int64)
            counts[np.repeat(np.arange(len(lists)), sizes), pc.index_in(flat.field("source"), names).to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
            self.add(part.column("term").to_pylist(), counts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.seen or self.first:
            for k in range(self.low, self.high):
                others = [n for n in range(len(self.names)) if n != k]
                yield self._made(k, "pair", [self.names[n] for n in others], self.pairs[k - self.low][others])
                values, names = self.best[k - self.low]
                yield self._made(k, "term", names, values)

    def _made(self, k: int, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
        n = len(items)
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), pa.array([self.names[k]] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of pairs and best terms of each (lang, block, salt): a head row, then terms in order."""
    now = None
    for batch in batches:
        heads = batch.column("sources").is_valid().to_numpy(zero_copy_only=False)
        at = 0
        for stop in [*np.flatnonzero(heads).tolist(), batch.num_rows]:
            if stop > at:
                now.read(batch.slice(at, stop - at))
            if stop < batch.num_rows:
                if now is not None:
                    yield from now.rows()
                head = batch.slice(stop, 1).to_pylist()[0]
                now = _Sums(head["lang"], head["block"], head["salt"], [s["source"] for s in head["sources"]], np.array([s["n"] for s in head["sources"]], np.int64), head["n_terms"])
            at = stop + 1
    if now is not None:
        yield from now.rows()


def _dealing(heads: DataFrame, partitions: int) -> DataFrame:
    """``heads`` with a language's blocks of sources, and its salts, by which a block's terms are dealt.

    For each salt a block gives back its pairs and best terms. So many terms go to a salt that these are no
    more rows than it reads, however many partitions there are; a language of fewer terms has one salt.
    Only one of so many sources that a task would compare above ``TASK_CELLS`` numbers has more.
    """
    n = F.size("sources")
    wide = F.least(n, F.lit(SOURCE_BLOCK))
    terms = F.least(wide * (n + TOP), F.lit(TASK_CELLS) / (wide * n))
    salts = F.greatest(F.lit(1), F.least(F.lit(partitions), F.floor(F.col("n_terms") / terms)))
    return heads.withColumns({"blocks": F.ceil(n / SOURCE_BLOCK).cast("int"), "salts": salts.cast("int")})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others.

    Part ``pair`` has every other source with the divergence from its term probabilities; part ``term``
    the at most 200 terms that stand out most against the language. Null text, lang and source are
    empty; every row is a document, repeated ones too; sources without terms take part; ties go by
    the bytes of the item; an empty table gives no rows. Kept terms are dealt by hash to tasks with
    their language's sources before them, in blocks of 64 sources, so neither a language nor a
    source is one task's work; what tasks give back is added up by pair.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = docs.select(empty("lang"), empty("source"), empty("text"))
    terms = kept_terms(texts)
    used = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = texts.groupBy("lang", "source").agg(F.lit(0).cast("bigint").alias("n")).unionByName(used).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    heads = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")).join(sizes, "lang", "left").select("lang", "sources", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    heads = written(_dealing(heads, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None)
    first = heads.withColumn("block", to("blocks")).withColumn("salt", to("salts")).select("lang", "block", "salt", none.cast("string").alias("term"), none.cast("array<struct<source:string,n:bigint>>").alias("counts"), "sources", "n_terms")
    own = terms.join(heads.select("lang", "blocks", "salts"), "lang")
    dealt = own.select("lang", to("blocks").alias("block"), F.pmod(F.xxhash64("term"), F.col("salts")).cast("int").alias("salt"), "term", "counts", none.cast("array<struct<source:string,n:bigint>>").alias("sources"), none.cast("bigint").alias("n_terms"))
    order = [F.col("lang"), F.col("block"), F.col("salt"), F.col("term").asc_nulls_first()]
    sorted_ = first.unionByName(dealt).repartition("lang", "block", "salt").sortWithinPartitions(*order)
    found = written(sorted_.mapInArrow(compare, "lang string, source string, part string, item string, value bigint"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_value))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= TOP))
