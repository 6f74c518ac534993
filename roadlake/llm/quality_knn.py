"""Quality by the votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm._batch import chunks, each, text_bytes, with_breaks

#: Terms are byte trigrams, hashed to so many cells.
TERMS = 2048
#: Dimensions of the latent space.
DIMENSIONS = 48
#: Labelled rows that the space is fitted on and that vote, at most; half of them of each label.
MAX_LABELLED = 4096
#: Voters of a document.
NEIGHBOURS = 15
#: Similarities are raised to this power as weights of the votes.
SHARPNESS = 4


def term_counts(texts: pa.Array) -> np.ndarray:
    """[text, term] counts. Letters, digits and symbols all count; null is empty."""
    data, offsets = text_bytes(texts)
    data, offsets = with_breaks(data, offsets)
    if len(data) < 3:
        return np.zeros((len(texts), TERMS))
    wide = data.astype(np.uint32)
    gram = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    cell = ((gram * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
    text_at = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = text_at[:-2] == text_at[2:]
    return np.bincount((text_at[:-2] * TERMS + cell)[inside], minlength=len(texts) * TERMS).reshape(-1, TERMS).astype(np.float64)


def weighted(counts: np.ndarray) -> np.ndarray:
    """Damped counts, by the length of the text."""
    total = counts.sum(1, keepdims=True)
    return np.log1p(counts * (1000 / np.maximum(total, 1)))


class Voters:
    """The space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float64)
        seen = (counts > 0).sum(0)
        self.rarity = np.log((1 + len(counts)) / (1 + seen)) + 1
        rows = self._terms(counts)
        values, vectors = np.linalg.eigh(rows.T @ rows)
        self.basis = np.ascontiguousarray(vectors[:, np.argsort(-values)[:DIMENSIONS]])
        self.points = self._placed(rows)

    def _terms(self, counts: np.ndarray) -> np.ndarray:
        rows = weighted(counts) * self.rarity
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def _placed(self, rows: np.ndarray) -> np.ndarray:
        at = rows @ self.basis
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by similarity.

        Similarities count to five digits, and voters as near as the last one all vote.
        """
        near = self._placed(self._terms(term_counts(texts))) @ self.points.T
        near = np.round(near, 5)
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= last, np.maximum(near, 0) ** SHARPNESS + 1e-9, 0)
        return (weight * self.labels).sum(1) / weight.sum(1)


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that vote: at most half of ``MAX_LABELLED`` of each label.

    ``docs`` has doc_id and text, ``labels`` doc_id and label (0 or 1). Ids are chosen by their
    lowest hash before any text is read, so few enough for a broadcast; of rows with the same id
    the first text counts.
    """
    known = labels.where("label in (0, 1)").join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    zero, one = (known.where(F.col("label") == k).orderBy(*order).limit(MAX_LABELLED // 2) for k in (0, 1))
    chosen = zero.unionByName(one).select("doc_id", F.col("label").cast("int").alias("label"))
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fitted(sample: DataFrame) -> Voters | None:
    """Voters from a bounded sample (doc_id, text, label), in order of doc_id; None if it is empty.

    The driver gets the texts' term counts only, in sparse form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, at = batch.column(0), batch.column(2).to_pylist(), 0
            for texts in chunks(batch.column(1), 1 << 20):
                counts = term_counts(texts)
                own = labels[at : at + len(texts)]
                at += len(texts)
                columns = [ids.slice(at - len(texts), len(texts)), pa.array([np.flatnonzero(c).astype(np.int16).tobytes() for c in counts], pa.binary()), pa.array([c[c > 0].astype(np.float32).tobytes() for c in counts], pa.binary()), pa.array(own, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "terms", "counts", "label"])

    rows = sample.select(F.col("doc_id").cast("bigint"), "text", "label").mapInArrow(run, "id bigint, terms binary, counts binary, label int").collect()
    rows.sort(key=lambda r: (r["id"], r["terms"], r["counts"], r["label"]))
    if not rows:
        return None
    counts = np.zeros((len(rows), TERMS))
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r["terms"], np.int16)] = np.frombuffer(r["counts"], np.float32)
    return Voters(counts, np.array([r["label"] for r in rows]))


def score(spark, voters: Voters | None, text: Column) -> Column:
    """Score of a text from 0 to 1; 0.5 for every text where nothing was labelled."""
    if voters is None:
        return F.lit(0.5)
    sent = spark.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches):
            for k in range(0, len(texts), 512):
                yield pa.array(sent.value.scores(texts.slice(k, 512)), pa.float64())

    return F.arrow_udf(run, "double")(text)


def predictions(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    ``labels`` has doc_id and quality; several labels of a document count by their mean, rounded
    up from a half. Rows that are held out teach nothing; an empty table gives no rows.
    """
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    voters = fitted(sampled(docs.where(~held_out).select("doc_id", "text"), own))
    found = docs.select("doc_id", held_out.alias("held_out"), score(docs.sparkSession, voters, F.col("text")).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
