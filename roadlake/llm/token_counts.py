"""Exact histogram of encoded lengths, and what every context limit would keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths are dealt to blocks of this many, so that no task sees all of them.
BLOCK = 1024


def length_histogram(lengths: DataFrame, length: Column) -> DataFrame:
    """(n_tokens, n_docs): how many rows have each length; rows with a null length count as 0.

    Counted before the shuffle, so a length that a third of all rows share is one row a task.
    """
    return lengths.groupBy(F.coalesce(length, F.lit(0)).cast("bigint").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length L in the histogram, as a context limit, what it does to the corpus.

    n_docs, n_tokens_total: of documents of exactly L tokens; docs_at_least, tokens_at_least:
    suffix sums from L on; docs_over, tokens_lost: documents longer than L and the tokens that
    truncation to L cuts; truncated_total: sum of min(length, L); quantile: share of documents
    of at most L tokens. An empty histogram gives no rows. The histogram is read several times,
    so it should be a table and not recomputed from texts. The suffix sums are taken within
    blocks of lengths and over the blocks' totals, which are few.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    cells = histogram.withColumn("_block", block).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = cells.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(everything).alias("_docs"),
        F.sum("_t").over(everything).alias("_all"),
    )
    down = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.join(totals, "_block").select(
        "n_tokens",
        "n_docs",
        F.col("_tokens").alias("n_tokens_total"),
        (F.sum("n_docs").over(down) + F.col("_docs_after")).alias("docs_at_least"),
        (F.sum("_tokens").over(down) + F.col("_tokens_after")).alias("tokens_at_least"),
        "_docs",
        "_all",
    )
    over, beyond = F.col("docs_at_least") - F.col("n_docs"), F.col("tokens_at_least") - F.col("n_tokens_total")
    return sums.select(
        "n_tokens",
        "n_docs",
        "n_tokens_total",
        "docs_at_least",
        "tokens_at_least",
        over.alias("docs_over"),
        (beyond - over * F.col("n_tokens")).alias("tokens_lost"),
        (F.col("_all") - beyond + over * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("_docs") - over) / F.col("_docs")).alias("quantile"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row (limit, truncated_total) for any limit, from the next listed length at or above it.

    Documents of at least the limit give the limit, the others all their tokens; no row if
    the table is empty.
    """
    whole = F.sum("n_tokens_total")
    long_docs = F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0))
    long_tokens = F.sum(F.when(F.col("n_tokens") > limit, F.col("n_tokens_total")).otherwise(0))
    return limits.agg((whole - long_tokens + long_docs * limit).alias("truncated_total")).where("truncated_total is not null").select(F.lit(limit).cast("bigint").alias("limit"), "truncated_total")


def quantile_length(limits: DataFrame, share: float) -> DataFrame:
    """One row (n_tokens): the least length that at least ``share`` of the documents don't exceed."""
    return limits.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens")).where("n_tokens is not null")
