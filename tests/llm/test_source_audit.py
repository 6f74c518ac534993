import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from roadlake.llm import source_audit
from roadlake.llm.source_audit import Trie, audit, probabilities

from .conftest import plain

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain_audit(rows):
    """Rows of (text, lang, source), with dictionaries and Python's integers."""
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in holders.items() if n >= source_audit.MIN_DOCS]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(t for t in words if t in set(kept))
        whole = sum(counts.values(), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[: source_audit.TOP], 1)]
    return sorted(out, key=repr)


def test_same_as_plain_count(docs, rows):
    assert plain(audit(docs), *COLUMNS) == plain_audit([(r[1], r[2], r[3]) for r in rows])


def odd_texts():
    rnd = random.Random(4)
    words = ["a", "ab", "abc", "abd", "b", "é", "éa", "中文", "中", "😀", "zz", "Z", "ｚ", "the", "then", "them"]
    texts = [(" ".join(rnd.choices(words, k=rnd.randint(0, 9))), rnd.choice(["x", "y", None]), rnd.choice(["s1", "s2", "S3", "é", None, "t"])) for _ in range(150)]
    return texts + [("only one holds this", "w", "s"), (None, "v", "s"), ("", "v", "t"), (None, None, None)]


def test_random_texts(spark):
    df = spark.createDataFrame([(*t, "c", 1) for t in odd_texts()], "text string, lang string, source string, term string, n_docs int").repartition(5)
    assert plain(audit(df), *COLUMNS) == plain_audit(odd_texts())


def test_cuts_change_nothing(monkeypatch):
    """What tasks do, with tries that leave early, blocks of two sources, matrices of a few cells and three ranks."""
    for name, value in (("MAX_COUNTERS", 8), ("SOURCE_BLOCK", 2), ("CELLS", 20), ("CHUNK", 64), ("ROWS", 5), ("TOP", 3)):
        monkeypatch.setattr(source_audit, name, value)
    texts = [(t or "", lang or "", source or "") for t, lang, source in odd_texts()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts[at : at + 40], strict=True)], ["text", "lang", "source"]) for at in range(0, len(texts), 40)]
    leaves = [row for b in batches for out in source_audit.count_terms(iter([b])) for row in out.to_pylist()]
    assert len(leaves) > len({(r["lang"], r["term"]) for r in leaves}) + 20
    leaves.sort(key=lambda r: (r["lang"], r["term"].encode()))
    kind = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("counts", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])
    merged = [row for out in source_audit.merge_ranges(iter([pa.RecordBatch.from_pylist(leaves[at : at + 7], kind) for at in range(0, len(leaves), 7)])) for row in out.to_pylist()]
    found = []
    wide = kind.append(pa.field("sources", kind.field("counts").type)).append(pa.field("block", pa.int32())).append(pa.field("salt", pa.int32())).append(pa.field("n_terms", pa.int64()))
    for lang in sorted({t[1] for t in texts}):
        own = [r for r in merged if r["lang"] == lang]
        names = sorted({t[2] for t in texts if t[1] == lang})
        totals = [{"source": s, "n": sum(c["n"] for r in own for c in r["counts"] if c["source"] == s)} for s in names]
        for block in range(3):
            head = {"lang": lang, "block": block, "salt": 0, "sources": totals, "n_terms": len(own)}
            rows = [head, *[{**r, "sources": None} for r in sorted(own, key=lambda r: r["term"].encode())]]
            found += [r for out in source_audit.compare(iter([pa.RecordBatch.from_pylist(rows[at : at + 5], wide) for at in range(0, len(rows), 5)])) for r in out.to_pylist()]
    ranks, out = Counter(), []
    for r in sorted(found, key=lambda r: (-r["value"], r["item"].encode())):
        ranks[r["lang"], r["source"], r["part"]] += 1
        out.append((r["lang"], r["source"], r["part"], r["item"], r["value"], ranks[r["lang"], r["source"], r["part"]]))
    assert sorted(out, key=repr) == plain_audit(odd_texts())


def test_partitions_do_not_multiply_partial_sums(spark, monkeypatch):
    """Few terms go to one task a language, whatever the number of partitions; more tasks' sums add up to the same."""
    df, tables = spark.createDataFrame(odd_texts(), "text string, lang string, source string"), []
    monkeypatch.setattr(source_audit, "written", lambda t, of=source_audit.written: tables.append(of(t)) or tables[-1])
    monkeypatch.setattr(spark.conf, "get", lambda key, *a, of=spark.conf.get: "37" if key == "spark.sql.shuffle.partitions" else of(key, *a))
    found = plain(audit(df), *COLUMNS)
    assert found == plain_audit(odd_texts()) and tables[-1].count() == len(found)
    monkeypatch.setattr(source_audit, "TASK_CELLS", 1, raising=False)
    assert plain(audit(df), *COLUMNS) == found and tables[-1].count() > 2 * len(found)


def test_languages_of_few_and_of_many_sources(spark):
    """One language has two blocks of sources, another one a single source."""
    rnd = random.Random(7)
    texts = [(" ".join(rnd.choices("abcdefgh", k=4)), "many", f"s{k % 70}") for k in range(140)] + [("a b c", "one", "s1")] * 3
    assert plain(audit(spark.createDataFrame(texts, "text string, lang string, source string")), *COLUMNS) == plain_audit(texts)


def test_trie_walks_in_order():
    rnd = random.Random(5)
    terms = ["".join(rnd.choices("abé中", k=rnd.randint(0, 7))).encode() for _ in range(900)]
    trie = Trie()
    leaf = {t: trie.leaf(t) for t in terms}
    assert all(trie.leaf(t) == leaf[t] for t in terms) and sorted(leaf.values()) == list(range(trie.size)) and trie.size == len(set(terms))
    assert trie.walk() == (sorted(leaf), [leaf[t] for t in sorted(leaf)])


def test_probabilities_are_exact():
    rnd = random.Random(6)
    totals = [1, 2, 7, 10**9, 10**15 + 7, 8_999_999_999_999_999]
    for total in totals:
        counts = [0, total - 1, *[rnd.randrange(total) for _ in range(20)]]
        assert probabilities(np.array(counts), np.int64(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


def test_empty_table(no_docs):
    assert audit(no_docs).count() == 0


def test_one_source_has_no_pairs(spark):
    df = spark.createDataFrame([("a b", "en", "s")] * 3, "text string, lang string, source string")
    assert plain(audit(df), *COLUMNS) == [] and audit(df.withColumn("source", F.lit(None).cast("string"))).count() == 0
