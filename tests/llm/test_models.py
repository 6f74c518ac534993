import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlake.llm import language_id, license_scan, quality_knn

from .conftest import plain

SYLLABLES = {"en": ["th", "ing", "er", "on", "and"], "fr": ["eau", "oi", "é", "que", "ment"], "de": ["sch", "ung", "ü", "ein", "icht"]}


def text_in(lang, rnd, words=60):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    rows = [(k, text_in(lang, rnd), lang) for k, lang in enumerate(["en", "fr", "de"] * 40)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_of_held_out_texts(labelled):
    rows, df = labelled
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = {r["doc_id"]: r for r in language_id.predictions(df, held).collect()}
    assert {k for k, r in got.items() if r["held_out"]} == {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    assert all(got[k]["lang_pred"] == lang and 0.9 <= got[k]["score"] <= 1 for k, _, lang in rows)


def test_mixtures_select_their_languages(spark, labelled):
    rows, df = labelled
    rnd = random.Random(9)
    mixed = text_in("en", rnd, 200) + " " + text_in("de", rnd, 100)
    texts = pa.array([text_in("fr", rnd), mixed, "", "123 !!"])
    model = language_id.fitted(df.select("text", "lang"))
    share, totals = model.mixtures(texts)
    names = [[model.langs[k] for k in np.argsort(-row) if row[k] > 0] for row in share]
    assert names[0] == ["fr"] and names[1] == ["en", "de"]
    assert 0.5 < share[1].max() < 0.8
    assert totals[2] == totals[3] == 0


def plain_mixture(model, text):
    """Expectation-maximisation and the growth of the set, text by text and n-gram by n-gram."""
    import math

    _, cells, counts = language_id.trigram_counts(pa.array([text]))
    grams = list(zip(cells.tolist(), counts.tolist(), strict=True))
    total = sum(c for _, c in grams)
    given = lambda cell, k: float(model.given[cell, k])

    def fit(pi, steps):
        for _ in range(steps):
            new, likelihood = dict.fromkeys(pi, 0.0), 0.0
            for cell, c in grams:
                all_ = sum(pi[k] * given(cell, k) for k in pi)
                likelihood += c * math.log(all_)
                for k in pi:
                    new[k] += c * pi[k] * given(cell, k) / all_ / total
            pi = new
        return pi, likelihood

    n = len(model.langs)
    full, _ = fit(dict.fromkeys(range(n), 1 / n), language_id.STEPS)
    order, best, score = sorted(full, key=lambda k: (-full[k], k)), {}, -math.inf
    for size in range(1, n + 1):
        start = {k: full[k] + 1e-6 for k in order[:size]}
        pi, likelihood = fit({k: v / sum(start.values()) for k, v in start.items()}, 1 if size == 1 else language_id.STEPS)
        likelihood -= 0.5 * (size - 1) * math.log(max(total, 2))
        if likelihood <= score:
            break
        best, score = pi, likelihood
    return best


def test_mixtures_same_as_plain_expectation_maximisation(spark, labelled):
    rows, df = labelled
    rnd = random.Random(4)
    model = language_id.fitted(df.select("text", "lang"))
    texts = [" ".join(text_in(lang, rnd, rnd.randint(1, 60)) for lang in rnd.sample(model.langs, rnd.randint(1, len(model.langs)))) for _ in range(12)]
    together, _ = model.mixtures(pa.array(texts))
    for text, row in zip(texts, together, strict=True):
        want = plain_mixture(model, text)
        assert {k for k in range(len(row)) if row[k] > 0} == set(want)
        assert all(abs(row[k] - v) < 1e-5 for k, v in want.items())
        alone, _ = model.mixtures(pa.array([text]))
        assert np.allclose(alone[0], row)


def test_three_hundred_languages(spark, monkeypatch):
    rnd = random.Random(2)
    words = [["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for _ in range(300)]
    rows = [(k, " ".join(rnd.choices(words[k % 300], k=40)), f"l{k % 300:03}") for k in range(600)]
    rows += [(1000, " ".join(" ".join(rnd.choices(words[k], k=300)) for k in range(8)), None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language_id, "BLOCK_ENTRIES", 1 << 14)
    model = language_id.fitted(df)
    assert len(model.langs) == 300
    got = df.select("doc_id", "lang", language_id.mixture(spark, model, F.col("text")).alias("m")).collect()
    assert all(r["m"]["lang_pred"] == r["lang"] for r in got if r["lang"])
    assert set(got[-1]["m"]["langs"]) == {f"l{k:03}" for k in range(8)}


def test_texts_without_letters_are_undetermined(spark, docs, rows, no_docs):
    got = language_id.predictions(docs, F.lit(False))
    want = sorted(((r[0], r[1] is None or not any(c.isalpha() for c in r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["lang_pred"] == "und") for r in got.collect()), key=repr) == want
    nothing = language_id.predictions(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(False))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert language_id.predictions(no_docs, F.lit(False)).count() == 0


def test_short_texts_have_a_language(spark, labelled):
    _, df = labelled
    model = language_id.fitted(df.select("text", "lang"))
    texts = [("a",), ("a1",), ("é",), ("7",), ("",), (None,)]
    got = spark.createDataFrame(texts, "text string").select("text", language_id.mixture(spark, model, F.col("text")).alias("m"))
    found = {r["text"]: r["m"] for r in got.collect()}
    assert all(found[t]["lang_pred"] in model.langs and 0 < found[t]["score"] <= 1 for t in ("a", "a1", "é"))
    assert all((found[t]["lang_pred"], found[t]["score"]) == ("und", 0.0) for t in ("7", "", None))


def test_counts_are_those_of_all_trigrams(labelled):
    rows, df = labelled
    counted = sum(r["n"] for r in language_id.cell_totals(df).collect())
    assert counted == sum(int(language_id.trigram_counts(pa.array([t]))[2].sum()) for _, t, _ in rows)


@pytest.fixture(scope="module")
def quality(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(240):
        bad = k % 3 == 0
        words = text_in(rnd.choice(["en", "fr"]), rnd, rnd.randint(20, 80)).split()
        rows.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), 0 if bad else 1))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, quality int")


def test_votes_of_held_out_texts(quality):
    rows, df = quality
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = {r["doc_id"]: r for r in quality_knn.predictions(df.select("doc_id", "text"), df.select("doc_id", "quality"), held).collect()}
    assert all(got[k]["predicted"] == q == int(got[k]["score"] >= 0.5) for k, _, q in rows)


def test_scores_are_exact_neighbour_votes(quality):
    rows, _ = quality
    counts = quality_knn.term_counts(pa.array([t for _, t, _ in rows[:100]]))
    voters = quality_knn.Voters(counts, np.array([q for *_, q in rows[:100]]))
    got = voters.scores(pa.array([t for _, t, _ in rows[100:120]]))
    placed = voters._placed(voters._terms(quality_knn.term_counts(pa.array([t for _, t, _ in rows[100:120]]))))
    for p, score in zip(placed, got, strict=True):
        near = sorted(((float(p @ q), k) for k, q in enumerate(voters.points)), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(s, 0) ** quality_knn.SHARPNESS for s, _ in near]
        assert abs(score - sum(w * rows[k][2] for w, (_, k) in zip(weights, near, strict=True)) / sum(weights)) < 1e-4


def test_ties_all_vote():
    texts = ["aaa bbb ccc"] * 20 + ["xyz"] * 5
    labels = np.array([1, 0] * 10 + [1] * 5)
    voters = quality_knn.Voters(quality_knn.term_counts(pa.array(texts)), labels)
    assert voters.scores(pa.array(["aaa bbb ccc"]))[0] == pytest.approx(0.5)


def test_scores_do_not_depend_on_partitions(quality):
    _, df = quality
    score = lambda n: plain(quality_knn.predictions(df.repartition(n).select("doc_id", "text"), df.select("doc_id", "quality"), F.lit(False)), "doc_id", "score")
    assert score(2) == score(7)


def test_odd_rows_and_no_labels(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (5, None), (None, 1), (99999, 0)], "doc_id bigint, quality int")
    got = quality_knn.predictions(docs, labels, F.lit(False)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_knn.predictions(docs, labels.where("false"), F.lit(False)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert quality_knn.predictions(no_docs, labels, F.lit(False)).count() == 0


BSD_2, BSD_3, MIT = (next(t for n, t in license_scan.TEMPLATES if n == name and len(t) > 500) for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT"))


def test_licences_and_inheritance(spark):
    notes = "\n".join(f"# {line}" for line in BSD_2.split("\n"))
    files = [
        ("a/LICENSE", "Copyright (c) 2011 Some One\n\n" + MIT),
        ("a/b/code", "nothing here"),
        ("a/b/own", "first line\nLicensed under the Apache License, Version 2.0.\n" + "word " * 100),
        ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/d/e/deep", "deep"),
        ("x/alone", "a licence to print money"),
        ("y/two", BSD_2),
        ("y/three", BSD_3),
        ("z/header", notes + "\n\n" + "zzz zzz\n" * 400),
        ("top", None),
        (None, ""),
        ("a/b/code", "nothing here"),
    ]
    df = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("clash"))
    got = license_scan.with_licenses(df)
    assert got.select("doc.*").columns == ["path", "text", "license"]
    assert plain(got, "path", "license", "inherited_from") == sorted(
        [
            ("a/LICENSE", "MIT", None),
            ("a/b/code", "MIT", "a"),
            ("a/b/code", "MIT", "a"),
            ("a/b/own", "Apache-2.0", None),
            ("a/b/c/COPYING", "GPL-3.0", None),
            ("a/b/c/d/e/deep", "GPL-3.0", "a/b/c"),
            ("x/alone", None, None),
            ("y/two", "BSD-2-Clause", None),
            ("y/three", "BSD-3-Clause", None),
            ("z/header", "BSD-2-Clause", None),
            ("top", None, None),
            (None, None, None),
        ],
        key=repr,
    )
    assert {r["path"] for r in got.where("is_license_file").collect()} == {"a/LICENSE", "a/b/c/COPYING", "y/two", "y/three"}


def test_cosines_are_those_of_tf_idf(spark):
    import math
    import re
    from collections import Counter

    terms = [re.findall(license_scan.TERM, t.lower()) for _, t in license_scan.TEMPLATES]
    idf = lambda t: math.log((1 + len(terms)) / (1 + sum(t in own for own in terms))) if any(t in own for own in terms) else None
    weigh = lambda own: {t: (1 + math.log(c)) * idf(t) if idf(t) is not None else None for t, c in Counter(own).items()}
    notices = ["Licensed under CC BY-NC 4.0.", "licensed under the mit licence, mit", "GNU General Public License, version 2 or 3", BSD_3, BSD_2.replace("list", "x y"), MIT[:500], "of the and to software"]
    rnd = random.Random(12)
    notices += [" ".join(rnd.sample(rnd.choice(terms), 5) + ["other"] * rnd.randint(0, 4)) for _ in range(40)]
    got = {r["text"]: r["score"] for r in license_scan.own_licenses(spark.createDataFrame([("p", n.replace("\n", " ")) for n in notices], "path string, text string")).select("doc.text", "score").collect()}
    parts = lambda text: [text, *re.split(r"(?<=[.!?;])[ \t]+", text)]
    for text, score in got.items():
        best = 0.0
        for unit in parts(text):
            words = re.findall(license_scan.TERM, unit.lower())
            own = weigh(words)
            norm = math.sqrt(sum(w * w for w in own.values() if w is not None) + license_scan.OTHER**2 * sum(idf(t) is None for t in words))
            for other in map(weigh, terms):
                if norm:
                    dot = sum((w or 0) * (other.get(t) or 0) for t, w in own.items())
                    best = max(best, dot / norm / math.sqrt(sum(w * w for w in other.values())))
        assert abs(score - (best if best >= license_scan.MIN_COSINE else 0)) < 1e-4


def test_licence_rows(docs, rows, no_docs):
    got = license_scan.scan(docs)
    assert got.count() == len(rows)
    assert {(r["own_license"], r["is_license_file"]) for r in got.collect() if r["own_license"]} == {("MIT", True), ("CC-BY-NC-4.0", False)}
    assert license_scan.scan(no_docs).count() == 0


def test_terms_of_many_parts(spark):
    texts = [(1, "12." * 350_000 + "1", "s", "en"), (2, "ab-" * 350_000 + "1\nReleased under the MIT License.", "s", "en")]
    got = license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string, source string, lang string"))
    assert {(r["doc_id"], r["own_license"]) for r in got.collect()} == {(1, None), (2, "MIT")}
