"""SimHash near-duplicates: covering bit masks find every pair within the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.llm._batch import LOWER, SPACE, each, per_text, text_bytes, with_breaks, word_bounds
from roadlake.operators.components import connected_components

BITS = 64
#: Members of a bucket that are compared in an array of one row; larger ones go by middle points.
SMALL_BUCKET = 24


def fingerprints(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """Majority bits over XXH64 of all word shingles of each text, as int64; 0 without a word."""
    data, offsets = text_bytes(texts)
    data, offsets = with_breaks(LOWER[data], offsets)
    blank = SPACE[data]
    starts, ends, counts = word_bounds(blank, offsets)
    if not len(starts):
        return np.zeros(len(texts), np.int64)
    # words in one buffer, one space after each
    keep = ~blank
    keep[ends] = True
    data[ends] = 0x20
    packed = data[keep].tobytes()
    stops = np.cumsum(ends - starts + 1) - 1
    begins = stops - (ends - starts)
    # a shingle starts at each word that has enough after it, or at the first word of a short text
    after = np.repeat(np.cumsum(counts), counts) - np.arange(len(starts))
    place = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = np.flatnonzero((after >= words) | (place == 0))
    last = first + np.minimum(after[first], words) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(packed[a:b], seed) for a, b in zip(begins[first].tolist(), stops[last].tolist(), strict=True)], np.uint64)
    each = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    out = np.zeros(len(texts), np.uint64)
    for bit in range(BITS):
        ones = per_text(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), each)
        out |= (2 * ones > each).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint of a text as bigint; null is empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches):
            yield pa.array(fingerprints(texts, words), pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks such that any ``radius`` bits lie outside at least one of them.

    Bit i has a nonzero vector of radius + 1 bits; mask v keeps the bits whose vector has an odd
    product with v. For any ``radius`` vectors some nonzero v is orthogonal to all of them.
    """
    vectors = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, vectors + 1):
        masks.append(sum(1 << i for i in range(BITS) if ((1 + i % vectors) & v).bit_count() % 2))
    return masks


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all within ``radius`` bits.

    ``prints``: one column ``fp`` of distinct values. Buckets of each masked value with one member
    link nothing. Small buckets are compared in place, and only links leave. A larger bucket
    isn't compared pair by pair: each member names the points within radius // 2 changes of bits
    outside the mask; members that name the same point are at most ``radius`` apart, and any
    two within it name one. Such members are linked to the point's smallest, so that the
    components are those of all pairs. For odd radii the comparison is exact for small buckets
    only, hence radius must be even or 1.
    """
    if radius not in (1, 2):
        raise ValueError("radius is 1 or 2")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for k, m in enumerate(masks)])
    dealt = prints.select("fp", F.explode(tables).alias("b")).select("fp", "b.t", "b.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(dealt.join(sizes, ["t", "key"]))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    arrays = shared.where(F.col("n") <= SMALL_BUCKET).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, k: F.transform(F.filter(F.slice("m", k + 2, F.size("m")), lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = arrays.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    large = shared.where(F.col("n") > SMALL_BUCKET)
    free = F.element_at(F.array(*[F.array(*[_signed(1 << i) for i in range(BITS) if not m >> i & 1]) for m in masks]), F.col("t").cast("int") + 1)
    points = large.select("fp", F.explode(F.concat(F.array("fp"), F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("point")).distinct()
    if radius == 1:
        named = large.select("fp", F.explode(F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("point")).distinct()
        large_links = named.join(prints.select(F.col("fp").alias("point")), "point", "left_semi").select(F.col("point").alias("a"), F.col("fp").alias("b"))
    else:
        centres = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
        large_links = points.join(centres, "point").where("a <> fp").select("a", F.col("fp").alias("b"))
    return small.unionByName(large_links).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, root, component_id (and the columns ``carry``) for every row of ``docs``.

    Rows with equal fingerprints are one node; nodes within ``radius`` bits are linked, and
    component_id is the smallest doc_id of all rows that are reachable; root names the component by one of its fingerprints. Null ids keep their
    rows but never name a component, unless all of its ids are null.
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp"), *carry))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = written(placed.join(lowest, "root").select("fp", "root", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "root", "component_id", *carry)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint in 16 hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
