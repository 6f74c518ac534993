import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from roadlake.functions.storage import written  # noqa: E402

from .conftest import corpus, plain  # noqa: E402
from .test_encoding import library  # noqa: E402, F401
from .test_duplicates import lowest_reachable, print_of  # noqa: E402
from .test_rules import TOKEN, LOWER, hits, kept  # noqa: E402
from .test_secrets import spans_of  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [r[1] for r in corpus() if r[1]]
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, texts[41][:150]), (2, texts[9][:90])], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_agree_with_a_plain_version(spark, folder, docs, library):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [tuple(r[c] for c in own) for r in now.collect()]

    now = written(pipeline.quality_stage(spark, now, folder))
    rows = [r for r, k in zip(rows, list(kept(rows)), strict=True) if k]
    assert now.columns == own and plain(now, *own) == sorted(rows, key=repr)

    now = written(pipeline.near_duplicate_stage(spark, now, folder))
    tops = lowest_reachable([print_of(r[1]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    first = {t: min(r[0] for r, u in zip(rows, tops, strict=True) if u == t) for t in tops}
    rows = list({r for r, t in zip(rows, tops, strict=True) if r[0] == first[t]})
    assert now.columns == own and plain(now, *own) == sorted(rows, key=repr)

    now = written(pipeline.decontamination_stage(spark, now, folder))
    found = {h[0]: (h[1], h[2]) for h in hits(rows, items)}
    rows = [r for r in rows if not found[r[0]][1] or (found[r[0]][0] - found[r[0]][1] >= 20 and 2 * found[r[0]][1] <= found[r[0]][0])]
    assert now.columns == own and {r["doc_id"] for r in now.collect()} == {r[0] for r in rows}
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    for r in rows:
        if not found[r[0]][1]:
            assert texts[r[0]] == r[1]
        else:
            assert len(TOKEN.findall(texts[r[0]].translate(LOWER))) == found[r[0]][0] - found[r[0]][1]
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())

    now = written(pipeline.secret_stage(spark, now, folder))
    for r in now.collect():
        masked, at = [], 0
        for a, _, b in spans_of(texts[r["doc_id"]]):
            masked += [texts[r["doc_id"]][at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
        assert r["text"] == "".join([*masked, texts[r["doc_id"]][at:]])
        assert not re.search("[0-9a-f]{16}", r["text"])

    last = pipeline.encoding_stage(spark, now, folder)
    masked = {r["doc_id"]: r["text"] for r in now.collect()}
    encode = library.encode_ordinary
    got = {r["doc_id"]: r for r in last.collect()}
    assert got.keys() == masked.keys() and all(got[k]["ids"] == encode(t) and got[k]["n_tokens"] == len(got[k]["ids"]) for k, t in masked.items())


def test_stages_keep_columns_of_any_name(spark, docs, folder):
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {r["_row"] + r["_new"] + r["doc"] for r in out.collect()} == {"agi"}


def test_run_and_names(spark, folder):
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "encoding"]
    assert pipeline.run(spark, folder).count() > 0


def test_rows_without_ids_stay_one_by_one(spark, folder):
    rows = [(None, f"word{k} other{k} more{k} text{k}", "en", "s", 1) for k in range(3)] + [(None, "word1 other1 more1 text1", "en", "s", 1), (4, "word2 other2 more2 text2", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipeline.near_duplicate_stage(spark, docs, folder)
    assert plain(got, "doc_id", "text") == sorted([(None, rows[0][1]), (None, rows[1][1]), (4, rows[2][1])], key=repr)


def test_empty_documents(spark, docs, folder, tmp_path):
    none = docs.select("doc_id", "text", "lang", "source", "n_chars").where("false")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_edited_copies_are_one_group(spark, folder, monkeypatch):
    rnd = random.Random(3)
    make = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    sets = lambda words: {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    alike = lambda a, b: len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b))
    base, other = make(300), make(300)
    texts = [base] + [base[:at] + make(n) + base[at + n :] for at, n in ((20, 20), (90, 25), (200, 28), (150, 60))] + [other[:150] + base[:150], other, make(3), make(4)]
    tops = lowest_reachable(texts, alike)
    assert any(alike(a, b) and (print_of(" ".join(a)) ^ print_of(" ".join(b))).bit_count() > 2 for a in texts for b in texts)
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for small in (24, 1):
        monkeypatch.setattr(pipeline.near_copies, "SMALL_BUCKET", small)
        got = pipeline.near_duplicate_stage(spark, docs, folder)
        assert sorted(r["doc_id"] for r in got.collect()) == sorted({tops.index(t) for t in tops})


def test_secret_stage_takes_long_terms_of_many_parts(spark, folder):
    texts = ["ab-" * 350_000 + "1", "12." * 350_000 + "1"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"]: r["text"] for r in pipeline.secret_stage(spark, docs, folder).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("small, block, shingles", [(24, 512, 1 << 18), (1, 3, 200)])
def test_buckets_of_many_unlike_sets_lose_no_pair(spark, monkeypatch, small, block, shingles):
    """Variants of one text that are 0.5 to 0.95 alike, of many sizes: their groups are those of all pairs."""
    near_copies = pipeline.near_copies
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        text = base[: rnd.choice([60, 60, 48, 40])]
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
        texts.append(text)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    tops = lowest_reachable(list(range(150)), lambda a, b: len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]) or (print_of(" ".join(texts[a])) ^ print_of(" ".join(texts[b]))).bit_count() <= 2)
    for name, value in (("SMALL_BUCKET", small), ("BLOCK_SETS", block), ("BLOCK_SHINGLES", shingles)):
        monkeypatch.setattr(near_copies, name, value)
    docs = spark.createDataFrame([(k, " ".join(t), k) for k, t in enumerate(texts)], "doc_id long, text string, row long")
    groups = {}
    for r in near_copies.near_copies(docs, "row").collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    assert len(set(tops)) > 5
    assert sorted(map(sorted, groups.values())) == sorted([k for k, t in enumerate(tops) if t == top] for top in set(tops))


def test_passages_are_found_and_cut_in_one_function(spark, folder):
    """One worker a task, and the same texts as from finding first and cutting then, in one pass or in several."""
    from roadlake.llm import decontamination

    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = pipeline.decontamination_stage(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bArrowEvalPython\b", plan)) == 1
    found = decontamination.contaminated(docs, items)
    want = plain(found.select("doc.doc_id", decontamination.without_spans(found["doc.text"], found["hits.spans"]).alias("t")).where("t is distinct from doc.text"), "doc_id", "t")
    for block in (decontamination.BLOCK_BYTES, 100):
        got = decontamination.contaminated(docs, items, block, cut=True)
        assert plain(got.where("hits.left is not null").select("doc.doc_id", "hits.left"), "doc_id", "left") == want and want
