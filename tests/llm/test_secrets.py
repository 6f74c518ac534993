import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from roadlake.llm.secret_scan import ALLOWED, ASSIGN, CANDIDATE, KINDS, LIMITS, WINDOW, redacted, scan_digests, scanned

from .conftest import plain


def spans_of(text):
    text, out = text or "", []
    for m in re.finditer(ASSIGN, text, re.ASCII):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 18), (2, "[0-9a-f]+", 16)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    base = list(out)
    for m in re.finditer(CANDIDATE, text):
        s = m[0]
        if any(re.search(p, s) for p in ALLOWED) or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
            continue
        limit = LIMITS["hex"] if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else LIMITS["alnum"] if s.isalnum() else LIMITS["token"]
        entropy = max(math.log2(WINDOW) - sum(c * math.log2(c) for c in Counter(s[k : k + WINDOW]).values()) / WINDOW for k in range(len(s) - WINDOW + 1))
        if entropy * 1e6 >= limit - 1 and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(df, texts):
    want = []
    for i, t in texts:
        spans = spans_of(t)
        base = [s for s in spans if s[1] < 3]
        want.append((i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
    assert plain(scan_digests(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == sorted(want, key=repr)


def test_same_as_plain_search(docs, rows):
    check(docs, [r[:2] for r in rows])


def test_random_texts(spark):
    rnd = random.Random(3)
    parts = ["password", "Token", "API_KEY", "secret", "=", " = ", ":", '"', "'", " ", "AKIA", "ABCDEF0123456789", "deadbeef01234567", "abc", "\x01", "é", "😀", "ſecret", "x" * 12, "a1b2c3d4e5f6", "Zx9+/=_-", "\n", "q8Rt5Yp0Lm3Kj7Hg2Fd6", "example"]
    texts = [(k, "".join(rnd.choices(parts, k=rnd.randint(0, 30)))) for k in range(300)]
    check(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_very_many_matches_in_one_text(spark):
    rnd = random.Random(6)
    texts = [(1, " ".join(f"{rnd.getrandbits(128):032x}" for _ in range(2500)))]
    check(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_time_grows_with_the_length_of_a_candidate(spark):
    rnd = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [(1, "".join(rnd.choices(letters, k=1_000_000))), (2, "xy1" * 300_000)]
    got = {r["doc_id"]: r["spans"] for r in scan_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "entropy:0:1000000", 2: ""}


def test_redaction_masks_runs_of_spans(docs):
    found = scanned(docs, "s").select("text", "s", redacted(F.col("text"), F.col("s")).alias("new"))
    for r in found.collect():
        if r["text"] is None:
            assert r["new"] is None
            continue
        at, out = 0, []
        for a, _, b in spans_of(r["text"]):
            if a >= at or not out:
                out.append(r["text"][at:a])
            at = max(at, b)
        assert r["new"] == "[SECRET]".join([*out, r["text"][at:]])


def test_empty_table(no_docs):
    assert scan_digests(no_docs).count() == 0


def test_long_candidates_of_many_parts(spark):
    texts = [(1, "ab-" * 350_000 + "1"), (2, "12-" * 350_000 + "34"), (3, "a=" * 500_000)]
    got = {r["doc_id"]: r["spans"] for r in scan_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: ""}
