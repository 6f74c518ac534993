"""Sets of edges as bitmaps over dense ids: partial aggregates that merge by or."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions.storage import written

#: Ids that one bitmap covers.
WIDTH = 32768


def edge_bitmaps(rows: DataFrame, by: list[str], ids: DataFrame) -> DataFrame:
    """(by, bucket, bits): the edges of each group of ``rows`` (by, edge_id), as 4 KB bitmaps over ``ids`` (edge_id, id from 0 on).

    Repeated rows set one bit in every task before the shuffle, so a group costs at most its bitmaps,
    however many rows it has. Unknown edges are left out.
    """
    placed = rows.select(*by, "edge_id").join(ids.select("edge_id", F.col("id").alias("_id")), "edge_id")
    bucket = F.bitmap_bucket_number(F.col("_id") + 1)
    return placed.groupBy(*by, bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_id") + 1)).alias("bits"))


def merged(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, bits): the union of bitmaps over the columns that aren't in ``by``."""
    return bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def compared(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, second, both, only_first, only_second): sizes of two families of sets and of their differences, by group.

    Of A, B and their union alone: |A - B| is |A or B| - |B|.
    """
    sides = [x.select(*by, "bucket", "bits", F.lit(name).alias("side")) for name, x in (("a", first), ("b", second))]
    both = written(reduce(DataFrame.unionByName, sides))
    per_side = both.groupBy(*by, "bucket", "side").agg(F.bitmap_or_agg("bits").alias("bits"))
    sizes = per_side.groupBy(*by).agg(*[F.sum(F.when(F.col("side") == s, F.bitmap_count("bits")).otherwise(0)).alias(s) for s in ("a", "b")])
    whole = merged(both, by).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum(F.bitmap_count("bits")).alias("u"))
    joined = sizes.join(whole, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]))
    return joined.select(*by, F.col("a").alias("first"), F.col("b").alias("second"), (F.col("a") + F.col("b") - F.col("u")).alias("both"), (F.col("u") - F.col("b")).alias("only_first"), (F.col("u") - F.col("a")).alias("only_second"))


def edges_of(bitmaps: DataFrame, by: list[str], ids: DataFrame) -> DataFrame:
    """(by, edge_id): the members of bitmaps."""
    byte = lambda k: F.conv(F.hex(F.substring("bits", (k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    full = F.filter(F.transform(F.sequence(F.lit(0), F.lit(WIDTH // 8 - 1)), lambda k: F.struct(k.alias("k"), byte(k).alias("v"))), lambda x: x["v"] > 0)
    bits = F.flatten(F.transform(full, lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.get(F.array(*[x["v"].bitwiseAND(1 << n) for n in range(8)]), b) > 0), lambda b: x["k"] * 8 + b)))
    members = bitmaps.select(*by, "bucket", F.explode(bits).alias("_bit")).select(*by, ((F.col("bucket") - 1) * WIDTH + F.col("_bit")).alias("_id"))
    return members.join(ids.select("edge_id", F.col("id").alias("_id")), "_id").select(*by, "edge_id")
