"""Near copies: texts whose sets of five-word shingles are alike to four fifths, each pair checked exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import drop_written, written
from roadlake.llm import simhash
from roadlake.llm._batch import LOWER, SPACE, chunks, each, text_bytes, with_breaks, word_bounds
from roadlake.operators.components import connected_components

WORDS = 5
#: Minima of a key, and keys of a text. A pair at 0.8 shares no key with a chance of (1 - 0.8 ** 4) ** 24, 3 in a million.
ROWS, BANDS = 4, 24
#: Members of a bucket that are all paired at once; of larger ones, only those that are in different components after a first round.
SMALL_BUCKET = 24
#: Sets, and shingles in them, that are held against as many others inside a task.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18
#: Sets of classes further apart than one can't be alike: each class is wider than 0.8.
CLASS_RATIO = 1.26
_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64)
FACTORS, ADDENDS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct word shingles of each text in ascending order; a shorter text is one shingle."""
    data, offsets = text_bytes(texts)
    data, offsets = with_breaks(LOWER[data], offsets)
    starts, ends, counts = word_bounds(SPACE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    packed, digest = data.tobytes(), xxhash.xxh64_intdigest
    word = np.array([digest(packed[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] + [0] * WORDS, np.uint64)
    after = np.repeat(np.cumsum(counts), counts) - np.arange(len(starts))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero((after >= WORDS) | (place == 0))
    h = np.zeros(len(first), np.uint64)
    for k in range(WORDS):
        h = np.where(after[first] > k, _mixed(h + word[first + k] + np.uint64(0x9E3779B97F4A7C15)), h)
    text = np.repeat(np.arange(len(counts)), counts)[first]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(counts))


def sketch(text: Column) -> Column:
    """fp: the SimHash fingerprint; sid, n: identity and size of the shingle set; keys: of its buckets. Without a word, only fp."""
    kind = pa.struct([("fp", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches):
            hashes, counts = shingle_sets(texts)
            full = counts > 0
            at = (np.cumsum(counts) - counts)[full]
            keys = np.zeros((len(at), BANDS), np.uint64)
            for k in range(ROWS * BANDS) if len(at) else ():
                low = np.minimum.reduceat(hashes * FACTORS[k] + ADDENDS[k], at)
                keys[:, k // ROWS] = _mixed(keys[:, k // ROWS] + low + np.uint64(k))
            ends = np.cumsum(counts).tolist()
            sid = [hashlib.blake2b(hashes[b - c : b].tobytes(), digest_size=16).digest() if c else None for b, c in zip(ends, counts.tolist(), strict=True)]
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum(full * BANDS, out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(simhash.fingerprints(texts), pa.int64()), pa.array(sid, pa.binary()), pa.array(counts, pa.int64()), lists], fields=list(kind))

    return F.arrow_udf(run, "struct<fp: bigint, sid: binary, n: bigint, keys: array<bigint>>")(text)


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with ``set``, the ascending shingles of their text, in place of the text; they leave chunk by chunk."""
    names = ["sid", "fp", "n", "keys"]
    for batch in batches:
        at = 0
        for texts in chunks(batch.column("text")):
            hashes, counts = shingle_sets(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
            rows = batch.slice(at, len(texts))
            at += len(texts)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], lists], [*names, "set"])


def _sets(docs: DataFrame, nodes: DataFrame, sids: DataFrame, row: str) -> DataFrame:
    """(sid, fp, n, keys, set) of some shingle sets, as a written table."""
    wanted = nodes.join(sids.distinct(), "sid", "left_semi")
    texts = docs.select(row, "text").join(wanted, row).select("sid", "fp", "n", "keys", "text")
    return written(texts.mapInArrow(_with_sets, "sid binary, fp bigint, n bigint, keys array<bigint>, set array<bigint>"))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the fingerprints of those pairs (sa, sb) whose sets share at least 0.8 of their union."""
    of = lambda side: sets.select(F.col("sid").alias(f"s{side}"), F.col("set").alias(f"set{side}"), F.col("fp").alias(side))
    both = pairs.join(of("b"), "sb").join(of("a"), "sa")
    return written(both.where(_enough(F.size(F.array_intersect("seta", "setb")), F.size("seta") + F.size("setb"))).select("a", "b").where("a <> b").distinct())


def _enough(shared, sizes):
    """Whether so many shingles of two sets with so many in all are four fifths of their union."""
    return shared * 9 >= sizes * 4


def near_copies(docs: DataFrame, row: str, radius: int = 2) -> DataFrame:
    """doc_id, root and ``row`` for every row of ``docs``; root is the same over a group.

    A group is what pairs of one shingle set, of sets alike to 0.8, and of fingerprints within
    ``radius`` bits connect. ``row`` tells rows apart; null and empty texts are alike by their
    fingerprint, an empty table gives no rows. Sets meet in buckets of equal minima; a pair is
    checked on the sets themselves. In a bucket of over ``SMALL_BUCKET`` sets all are first held
    against one, and then against each other where they are still in different groups (``across``).
    """
    prints = written(docs.select("doc_id", row, sketch(F.col("text")).alias("s")).select("doc_id", row, "s.*"))
    nodes = written(prints.where("sid is not null").groupBy("sid").agg(F.min(F.struct("fp", "n", row, "keys")).alias("m")).select("sid", "m.*"))
    dealt = nodes.select("sid", "n", "fp", F.posexplode("keys").alias("band", "key"))
    member = F.struct("sid", "n")
    sizes = dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min(member).alias("lead")).where("size > 1")
    shared = written(dealt.join(sizes, ["band", "key"]))
    large = shared.where(F.col("size") > SMALL_BUCKET)
    arrays = shared.where(F.col("size") <= SMALL_BUCKET).groupBy("band", "key").agg(F.array_sort(F.collect_list(member)).alias("m"))
    fits = lambda x, y: F.least(x["n"], y["n"]) * 5 >= F.greatest(x["n"], y["n"]) * 4
    ends = lambda x, y: F.struct(x["sid"].alias("sa"), y["sid"].alias("sb"))
    each_two = F.flatten(F.transform("m", lambda x, k: F.transform(F.filter(F.slice("m", k + 2, F.size("m")), lambda y: fits(x, y)), lambda y: ends(x, y))))
    led = large.where(F.col("sid") != F.col("lead.sid")).where(fits(F.col("lead"), F.struct("sid", "n"))).select(F.col("lead.sid").alias("sa"), F.col("sid").alias("sb"))
    pairs = written(arrays.select(F.explode(each_two).alias("p")).select("p.*").unionByName(led).distinct())
    sets = _sets(docs, nodes, pairs.select(F.col("sa").alias("sid")).unionByName(pairs.select(F.col("sb").alias("sid"))), row)
    found = alike(pairs, sets)
    drop_written(sets)
    same = prints.where("sid is not null").groupBy("sid").agg(F.collect_set("fp").alias("f")).where(F.size("f") > 1)
    same = same.select(F.array_min("f").alias("a"), F.explode("f").alias("b")).where("a <> b")
    links = written(simhash.links(prints.select("fp").distinct(), radius).unionByName(same).unionByName(found))
    roots = connected_components(links).withColumnRenamed("node", "fp")
    placed = large.select("band", "key", "sid", "n", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    several = placed.groupBy("band", "key").agg((F.min("root") != F.max("root")).alias("several")).where("several").select("band", "key")
    apart = written(placed.join(several, ["band", "key"], "left_semi").select("band", "key", "sid", "n", "root"))
    if not apart.isEmpty():
        more = across(apart, _sets(docs, nodes, apart.select("sid"), row))
        roots = connected_components(links.unionByName(more)).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").select("doc_id", F.coalesce("root", "fp").alias("root"), row)


def across(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the groups (root) that share a bucket; all pairs of sets of different groups are checked.

    A bucket is cut into classes by the size of its sets, since sets of classes two apart can't be
    alike, and classes into blocks by hash. Each two blocks of the same or of adjacent classes
    meet in a task, as bounded arrays, and only links leave it, one for each two groups; a pair of sets
    is checked in the first bucket that both share. So a bucket of any size is many tasks' work, and no
    pair becomes a row.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / np.log(CLASS_RATIO)).cast("int")
    marked = apart.withColumn("c", size)
    held = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(BLOCK_SHINGLES / F.pow(F.lit(CLASS_RATIO), F.col("c") + 1)))).cast("int")
    counts = marked.groupBy("band", "key", "c").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("blocks"))
    up = counts.select("band", "key", (F.col("c") - 1).alias("c"), F.col("blocks").alias("above"))
    down = counts.select("band", "key", (F.col("c") + 1).alias("c"), F.col("blocks").alias("below"))
    where = ["band", "key", "c"]
    dealt = marked.join(counts.join(up, where, "left").join(down, where, "left"), where).withColumn("i", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda c, i, d, j: F.struct(c.alias("c1"), i.alias("b1"), d.alias("c2"), j.alias("b2"))
    own, i = F.col("c"), F.col("i")
    tasks = F.concat(
        F.transform(numbers("blocks"), lambda j: meet(own, F.least(i, j), own, F.greatest(i, j))),
        F.transform(numbers("above"), lambda j: meet(own, i, own + 1, j)),
        F.transform(numbers("below"), lambda j: meet(own - 1, j, own, i)),
    )
    task = ["band", "key", "c1", "b1", "c2", "b2"]
    rows = dealt.select("band", "key", "c", "i", "sid", "root", F.explode(tasks).alias("t")).select("band", "key", "c", "i", "sid", "root", "t.*")
    full = rows.join(sets.select("sid", "fp", "keys", "set"), "sid")
    return written(full.groupBy(*task).applyInArrow(_linked, "a bigint, b bigint").distinct())


def _linked(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between the sets of two blocks, or inside one, that are of different groups."""
    band, _, c1, b1, c2, b2 = (k.as_py() for k in key)
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    first, second = (column("c") == c1) & (column("i") == b1), (column("c") == c2) & (column("i") == b2)
    root, fp = column("root"), column("fp")
    lists = rows.column("set").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    ends = np.cumsum(counts)
    left, right = np.flatnonzero(first), np.flatnonzero(second)
    width, element = counts[right], ids[np.concatenate([np.arange(ends[k] - counts[k], ends[k]) for k in right])] if len(right) else ids[:0]
    at, flag, out = np.cumsum(width) - width, np.zeros(ids.max(initial=-1) + 1, bool), {}
    for k in left.tolist() if len(right) else ():
        equal = keys[right] == keys[k]
        open_ = (root[right] != root[k]) & (equal.argmax(1) == band) & ((right > k) if (c1, b1) == (c2, b2) else True)
        if open_.any():
            own = ids[ends[k] - counts[k] : ends[k]]
            flag[own] = True
            shared = np.add.reduceat(flag[element], at)
            flag[own] = False
            for j in right[open_ & _enough(shared, width + counts[k])].tolist():
                out.setdefault((root[k], root[j]), (fp[k], fp[j]))
    return pa.table({"a": pa.array([a for a, _ in out.values()], pa.int64()), "b": pa.array([b for _, b in out.values()], pa.int64())})
