"""Language mixtures of documents: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm._batch import chunks, each, text_bytes, with_breaks

#: n-grams are UTF-8 trigrams of the lower-cased letters of a text, hashed to so many cells.
CELLS = 1 << 15
#: Added to each count of a cell, in a language.
SMOOTHING = 0.5
#: Steps of expectation-maximisation for each set of languages.
STEPS = 8
#: Table entries that one step of a fit holds at once: n-grams of texts times languages.
BLOCK_ENTRIES = 1 << 21

#: ASCII that isn't a letter becomes a space; other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(128)]


def trigram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, count) of the distinct cells of each text, sorted by text.

    Letters beyond ASCII are lower-cased as code points; a trigram of three spaces isn't counted.
    """
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    data, offsets = with_breaks(data, offsets)
    folded = FOLD[data].astype(np.uint32)
    if len(folded) < 3:
        return (np.zeros(0, np.int64),) * 3
    gram = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
    blank = (folded[1:-1] == 0x20) & ((folded[:-2] == 0x20) | (folded[2:] == 0x20))
    cell = ((gram * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    text_at = np.repeat(np.arange(len(texts)), np.diff(offsets))
    text_of = text_at[1:-1]
    keys = np.sort((text_of * CELLS + cell)[~blank & (text_at[:-2] == text_at[2:])])
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first] // CELLS, keys[first] % CELLS, np.diff(np.append(first, len(keys)))


def cell_totals(labelled: DataFrame) -> DataFrame:
    """(lang, cell, n) over all rows of ``labelled`` (text, lang).

    Each task sums its own rows into one table a language before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0), np.array(batch.column(1).to_pylist(), object)
            at = 0
            for part in chunks(texts):
                text, cell, count = trigram_counts(part)
                own = langs[at : at + len(part)]
                at += len(part)
                for lang in set(own.tolist()):
                    use = (own == lang)[text] if len(text) else np.zeros(0, bool)
                    sums[lang] = sums.get(lang, 0) + np.bincount(cell[use], count[use], CELLS)
        for lang, total in sums.items():
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(total[cells].astype(np.int64))], ["lang", "cell", "n"])

    return labelled.select("text", "lang").mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Probabilities of cells in each language: 128 KB a language, however many there are."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        weight = counts + SMOOTHING
        self.given = np.ascontiguousarray((weight / weight.sum(1, keepdims=True)).T.astype(np.float32))  # [cell, language]
        self.prior = counts.sum(1) / max(1, counts.sum())

    def _full(self, cell: np.ndarray, count: np.ndarray, starts: np.ndarray, of: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """[text, language] proportions over all languages, in blocks of languages."""
        k = len(self.langs)
        width = max(1, BLOCK_ENTRIES // max(1, len(cell)))
        parts = [slice(a, min(a + width, k)) for a in range(0, k, width)]
        pi = np.full((len(starts), k), 1 / k)
        for _ in range(STEPS):
            total = np.zeros(len(cell))
            for p in parts:
                total += (self.given[cell, p] * pi[of, p]).sum(1)
            for p in parts:
                pi[:, p] = np.add.reduceat(self.given[cell, p] * pi[of, p] * (count / total)[:, None], starts) / mass[:, None]
        return pi

    def mixtures(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] proportions of the selected set, and how many n-grams a text has.

        A text's set starts with the language of its largest proportion and takes in the next
        one as long as its own penalised likelihood grows, whatever the other texts do.
        """
        n, k = len(texts), len(self.langs)
        text, cell, count = trigram_counts(texts)
        sizes = np.bincount(text, minlength=n)
        share = np.zeros((n, k))
        has = np.flatnonzero(sizes)
        totals = np.bincount(text, count, n)
        if not len(has) or not k:
            return share, totals
        begin = (np.cumsum(sizes) - sizes)[has]
        full = self._full(cell, count.astype(float), begin, np.repeat(np.arange(len(has)), sizes[has]), totals[has])
        order = np.argsort(-full, 1, kind="stable")
        active, score = np.arange(len(has)), np.full(len(has), -np.inf)
        for size in range(1, k + 1):
            own = sizes[has[active]]
            of = np.repeat(np.arange(len(active)), own)
            at = np.repeat(begin[active] - (np.cumsum(own) - own), own) + np.arange(len(of))
            starts, mass, weight = np.cumsum(own) - own, totals[has[active]], count[at].astype(float)
            chosen = order[active, :size]
            pi = np.take_along_axis(full[active], chosen, 1) + 1e-6
            pi /= pi.sum(1, keepdims=True)
            given = self.given[cell[at][:, None], chosen[of]]
            for _ in range(1 if size == 1 else STEPS):
                joint = given * pi[of]
                total = joint.sum(1)
                likelihood = np.add.reduceat(weight * np.log(total), starts)
                pi = np.add.reduceat(joint * (weight / total)[:, None], starts) / mass[:, None]
            penalised = likelihood - 0.5 * (size - 1) * np.log(np.maximum(mass, 2))
            better = penalised > score[active]
            active, chosen, pi = active[better], chosen[better], pi[better]
            if not len(active):
                break
            score[active] = penalised[better]
            share[has[active]] = 0
            share[has[active][:, None], chosen] = pi
        return share, totals


def fitted(labelled: DataFrame) -> Model:
    """A model of every language in ``labelled`` (text, lang not null), over all of its rows.

    What comes to the driver is one count for each cell of each language.
    """
    totals = cell_totals(labelled.where("lang is not null"))
    rows = totals.groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    counts = np.zeros((len(rows), CELLS))
    for k, r in enumerate(rows):
        counts[k, r["cells"]] = r["n"]
    return Model([r["lang"] for r in rows], counts)


def mixture(spark, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, langs, shares) of a text.

    lang_pred is the language of the largest proportion and score that proportion; langs and
    shares are the selected set, largest first. A text with a letter but no n-gram has the most
    frequent language, with its share of all n-grams. A null text, one without a letter, and any
    text under a model without languages gives `und` with score 0.
    """
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches):
            out = []
            shares, totals = sent.value.mixtures(texts)
            bare = (totals == 0) & pc.is_valid(texts).to_numpy(zero_copy_only=False)
            if bare.any() and len(sent.value.prior):
                shares[bare, sent.value.prior.argmax()] = sent.value.prior.max()
            for row in shares:
                top = [k for k in np.argsort(-row, kind="stable").tolist() if row[k] > 0]
                if not top:
                    out.append({"lang_pred": "und", "score": 0.0, "langs": [], "shares": []})
                    continue
                out.append({"lang_pred": sent.value.langs[top[0]], "score": min(1.0, float(row[top[0]])), "langs": [sent.value.langs[k] for k in top], "shares": row[top].tolist()})
            yield pa.array(out, kind)

    lettered = F.when(text.rlike(r"\p{L}"), text)
    return F.arrow_udf(run, "lang_pred string, score double, langs array<string>, shares array<double>")(lettered)


def predictions(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; the model learns from the other rows.

    Null langs teach nothing, repeated rows teach and are predicted as often as they stand there,
    and an empty table gives no rows.
    """
    model = fitted(docs.where(~held_out).select("text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), mixture(docs.sparkSession, model, F.col("text")).alias("_m"))
    return found.select("doc_id", "held_out", "_m.lang_pred", "_m.score")
