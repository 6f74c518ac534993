import hashlib
import re
from collections import Counter

import pytest

from roadlake.llm import decontamination, quality_rules
from roadlake.llm.decontamination import Index, suffix_order

from .conftest import plain

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


def normal(line):
    return re.sub("[\x20\x09-\x0D]+", " ", line.translate(LOWER)).strip(" ")


def boilerplate(rows):
    """Whether a line is one of a host, by sets of documents and of texts."""
    of_host, holders, texts = {}, {}, {}
    for i, t, _, s, *_ in rows:
        key = ("t", t or "") if i is None else ("i", i)
        of_host.setdefault(s, set()).add(key)
        for line in {normal(x) for x in (t or "").split("\n")} - {""}:
            holders.setdefault((s, line), set()).add(key)
            texts.setdefault((s, line), set()).add(t)
    limits = quality_rules
    return lambda s, line: len(holders[s, line]) > max(limits.MAX_LINE_DOCS, limits.MAX_LINE_SHARE * len(of_host[s])) and len(texts[s, line]) > limits.MIN_LINE_TEXTS


def kept(rows):
    common, limits = boilerplate(rows), quality_rules
    for _, t, _, s, *_ in rows:
        n, *_, failed = base(t)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if normal(x) and common(s, normal(x)))
        yield not failed and n - gone >= limits.MIN_LEFT_WORDS and n - gone >= limits.MIN_LEFT_SHARE * n


@pytest.mark.parametrize("limit", [50, 2])
def test_verdicts(docs, rows, monkeypatch, limit):
    monkeypatch.setattr(quality_rules, "MAX_LINE_DOCS", limit)
    monkeypatch.setattr(quality_rules, "MIN_LINE_TEXTS", 1 if limit == 2 else 12)
    want = [(r[0], *base(r[1]), k) for r, k in zip(rows, kept(rows), strict=True)]
    got = quality_rules.verdicts(docs)
    assert plain(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=repr)
    assert quality_rules.kept_documents(docs).select("doc.*").columns == docs.columns


def test_frequent_lines_deplete(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAX_LINE_DOCS", 3)
    monkeypatch.setattr(quality_rules, "MIN_LINE_TEXTS", 1)
    common = " ".join(f"menu{k}" for k in range(30))
    own = lambda k: "\n".join(f"w{k}a{j} w{k}b{j} w{k}c{j}" for j in range(12))
    rows = [(k, f"{common.upper()}  \n{'' if k % 2 else own(k)}\nlast {k}", None, "h" if k < 8 else "g", 1) for k in range(10)] + [(50, own(50), None, "h", 1), (51, own(50), None, "h", 1)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == {k: k % 2 == 0 for k in range(8)} | {8: True, 9: True, 50: True, 51: True}
    assert got == {r[0]: k for r, k in zip(rows, kept(rows), strict=True)}


def test_documents_and_texts_are_counted_exactly(spark):
    """60 documents of 12 texts share no boilerplate, of 13 they do; repeated rows of a document count once."""
    filler = lambda k: "\n".join(f"w{k}a{j} w{k}b{j} w{k}c{j} w{k}d{j}" for j in range(10))
    menu = " ".join(f"menu{k}" for k in range(100))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n_texts, n_docs, gone in ((12, 60, False), (13, 60, True), (51, 51, True), (13, 50, False)):
        rows = [(k, f"{menu}\n{filler(k % n_texts)}", None, "h", 1) for k in range(n_docs)]
        rows += rows[:5] * 4
        got = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(spark.createDataFrame(rows, schema)).collect()}
        assert set(got.values()) == {not gone} and list(kept(rows)) == [not gone] * len(rows)


def test_frequent_lines_are_taken_out_of_kept_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAX_LINE_DOCS", 3)
    monkeypatch.setattr(quality_rules, "MIN_LINE_TEXTS", 1)
    own = lambda k: [f"w{k}a{j} é{k}b{j} w{k}c{j}" for j in range(12)]
    rows = [(k, "\n".join([f"Menu  One{' ' * k}", *own(k), "", "menu one\t", "É é"][: 15 + k % 2]), None, "h", 1) for k in range(8)]
    common, found = boilerplate(rows), {}
    for i, t, _, s, *_ in rows:
        found[i] = "\n".join(x for x in t.split("\n") if not normal(x) or not common(s, normal(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc.doc_id"]: r["text"] for r in quality_rules.kept_documents(df).select("doc.doc_id", "text").withColumnRenamed("doc_id", "doc.doc_id").collect()} == found
    assert all("enu" not in t and "w" in t for t in found.values()) and found[1].endswith("É é") is False


def test_copies_do_not_make_their_own_lines_boilerplate(spark):
    text = "\n".join(f"w{j} x{j} y{j} z{j}" for j in range(10))
    rows = [(k, text, None, "h", 1) for k in range(200)]
    assert quality_rules.kept_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).count() == 200
    assert all(kept(rows))


TOKEN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items):
    windows = {}
    for i, t in items:
        words = TOKEN.findall((t or "").translate(LOWER))
        for k in range(max(len(words) - 10, 0) + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(i))
    for i, t, *_ in docs:
        words = TOKEN.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(words[k : k + n])]
        yield i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [8 << 20, 500])
def test_decontamination(spark, docs, rows, block, monkeypatch):
    texts = [r[1] for r in rows if r[1]]
    items = [(0, texts[3]), (1, texts[41][:150]), (2, "The OF and"), (3, None), (4, " ?! "), (5, texts[3][5:]), (6, "tail"), (7, "not there at all")]
    monkeypatch.setattr(decontamination.contaminated, "__defaults__", (block,))
    got = decontamination.digests(docs, spark.createDataFrame(items, "item_id int, text string"))
    assert plain(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(hits(rows, items), key=repr)


def test_items_without_ids_mark_their_words(spark):
    words = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"zero {words} eleven"), (2, None), (3, words)], "doc_id bigint, text string")
    for ids in ([None], [None, 7]):
        items = spark.createDataFrame([(i, words) for i in ids], "item_id int, text string")
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.digests(docs, items).collect()}
        assert got == {1: (10, len(ids) - 1, True), 2: (0, 0, False), 3: (10, len(ids) - 1, True)}


def test_no_items_and_no_documents(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id int, text string")
    assert plain(decontamination.digests(docs, none), "doc_id", "n_words", "n_hit") == sorted([h[:3] for h in hits(rows, [])], key=repr)
    assert decontamination.digests(no_docs, none).count() == 0
    assert quality_rules.verdicts(no_docs).count() == 0


@pytest.mark.parametrize("size", [50, 5000])
def test_answers_do_not_depend_on_chunks(spark, docs, rows, monkeypatch, size):
    """Texts above and below the bytes that are handled at once, in a process of its own limits."""
    import pyarrow as pa

    from roadlake.llm import _batch, language_id, near_copies, quality_knn, simhash

    texts = pa.array([r[1] for r in rows], pa.string())
    parts = list(_batch.chunks(texts, size))
    assert len(parts) > 5 and max(len(t or "") for t in texts.to_pylist()) > size
    model = language_id.Model(["x", "y"], language_id.np.random.default_rng(1).integers(1, 50, (2, language_id.CELLS)).astype(float))
    voters = quality_knn.Voters(quality_knn.term_counts(texts), language_id.np.arange(len(texts)) % 2)
    phrases = decontamination.phrases([(1, rows[3][1]), (2, rows[41][1][:200])])
    for f in (
        lambda t: list(zip(*map(list, quality_rules.base_counts(t)), strict=True)),
        lambda t: list(simhash.fingerprints(t)),
        lambda t: list(near_copies.shingle_sets(t)[1]),
        lambda t: [tuple(round(float(v), 9) for v in r) for r in model.mixtures(t)[0]],
        lambda t: [round(float(v), 6) for v in voters.scores(t)],
        lambda t: [(int(n), s, i) for n, s, i in zip(*decontamination.hits(t, phrases), strict=True)],
        lambda t: [sorted((int(h), int(n)) for o, h, n in zip(*quality_rules.line_words(t), strict=True) if o == k) for k in range(len(t))],
    ):
        assert [x for p in parts for x in f(p)] == f(texts)


def test_spans_are_cut_out_of_texts(spark):
    text = "Keep this. One two three four five six seven eight nine ten, and keep that"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id int, text string")
    found = decontamination.contaminated(docs, items)
    got = found.select("doc.doc_id", decontamination.without_spans(found["doc.text"], found["hits.spans"]).alias("t"))
    assert plain(got, "doc_id", "t") == [(1, "Keep this. , and keep that"), (2, None), (3, "")]


def test_index_counts_and_locates():
    import numpy as np

    rnd = np.random.default_rng(5)
    symbols = rnd.integers(1, 6, 400)
    symbols[[50, 51, 200, 399]] = 0
    order = suffix_order(symbols)
    assert sorted(order.tolist()) == list(range(400))
    index = Index(symbols, 5)
    for n in (1, 2, 3, 5):
        for at in range(0, 390, 7):
            want = symbols[at : at + n]
            if (want == 0).any():
                continue
            low, high = index.search(np.pad(want, (10 - n, 0))[None, :])
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [k for k in range(400 - n + 1) if (symbols[k : k + n] == want).all()]
