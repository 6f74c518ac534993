"""Five stages that clean the documents of a corpus and encode what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.llm import byte_bpe, decontamination, near_copies, quality_rules, secret_scan
from roadlake.llm._batch import identity
from roadlake.llm.queries import table, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are boilerplate of their host.

    Null and empty texts fail; repeated rows pass or fail together; an empty table gives no rows.
    Columns of any name pass through.
    """
    return _with_text(quality_rules.kept_documents(docs), F.col("text"), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id.

    Of rows with that doc_id one stays, the one of the lowest hash over its columns, so of repeated
    rows one stays; rows without a doc_id stay only where their group has no other. Null and empty
    texts are one group. An empty table gives no rows, and columns of any name pass through.
    """
    marked = docs.select(F.struct(*docs.columns).alias("doc"), identity(*[F.col(c) for c in docs.columns]).alias("row"))
    groups = near_copies.near_copies(marked.select("doc.doc_id", "doc.text", "row"), "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    chosen = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("keep"))
    kept = marked.join(chosen, F.col("row") == F.col("keep"), "left_semi")
    return kept.dropDuplicates(["row"]).select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that lose most of their words go.

    A document goes if it loses words and fewer than 20, or less than half of them, are left. Null
    and empty texts stay as they are, as do repeated rows; an empty table gives no rows. Columns
    of any name pass through.
    """
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), cut=True)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    left = F.col("hits.n_words") - n_hit
    kept = found.where((n_hit == 0) | ((left >= 20) & (2 * left >= F.col("hits.n_words"))))
    return _with_text(kept, F.when(F.size("hits.spans") > 0, F.col("hits.left")).otherwise(F.col("doc.text")), docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mask.

    Null texts stay null, empty ones empty; repeated rows stay; an empty table gives no rows.
    Columns of any name pass through.
    """
    found = secret_scan.scanned(docs.select(F.struct(*docs.columns).alias("doc"), "text"), "spans")
    return _with_text(found, secret_scan.redacted(F.col("text"), F.col("spans")), docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids of every document.

    Null and empty texts have no tokens; repeated rows stay; an empty table gives no rows. Other
    columns end here.
    """
    coded = docs.select("doc_id", "lang", "source", byte_bpe.encoded(spark, vocabulary_path(), F.col("text")).alias("e"))
    return coded.select("doc_id", "lang", "source", F.size("e.ids").cast("bigint").alias("n_tokens"), F.col("e.ids").alias("ids"))


def _with_text(found: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """The given columns of ``doc`` with a new text, and n_chars in keeping with it."""
    changed = found.select("doc", text.alias("new"))
    value = {"text": F.col("new"), "n_chars": F.char_length("new").cast("bigint")}
    return changed.select(*[value.get(c, F.col("doc")[c]).alias(c) for c in columns])


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("encoding", encoding_stage),
]

#: Stages 2 and 5 can't be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
