import hashlib
import random
import re

from pyspark.sql import functions as F

from roadlake.llm.personal_data import KINDS, personal_spans, redacted, scan_digests, spans_of

from .conftest import plain

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def base_of(text):
    """The patterns as they are written, each match checked."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def check(df, texts):
    want = []
    for i, t in texts:
        base = base_of(t or "")
        want.append((i, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest()))
    assert plain(scan_digests(df), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_same_as_plain_patterns(docs, rows):
    check(docs, [r[:2] for r in rows])


def test_random_texts(spark):
    rnd = random.Random(8)
    parts = ["a@b.c", "@", ".", "x", "_", "%", "-", "d@e", "1.2.3.4", "256", "0255", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500", " ", "+1 (555) 010-9999", "+", "(", "49", "12345678", "é", "😀", "\n", "999.1", "0000000000000", "call ", "ssn ", "GB82 WEST 1234 5698 7654 32"]
    texts = [(k, "".join(rnd.choices(parts, k=rnd.randint(0, 14)))) for k in range(1500)]
    check(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_added_kinds_need_checksums_and_context():
    found = lambda t: [(KINDS[k], t[a:b]) for k, a, b, _ in spans_of(t) if k >= 4]
    assert found("IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432") == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert found("IBAN DE88 3704 0044 0532 0130 00") == []
    assert found("his SSN is 123-45-6789") == [("national_id", "123-45-6789")]
    assert found("part 123-45-6789") == [] and found("ssn 000-45-6789") == [] and found("invoice order, ssn 123-45-6789") == []
    assert found("call 555-010-9999 now") == [("local_phone", "555-010-9999")] and found("about 555-010-9999") == []
    assert found("call +1 555-010-9999 now") == []  # inside a span of the base


def test_context_moves_the_score_of_base_spans():
    score = lambda t: [s[3] for s in spans_of(t)]
    assert score("x 10.0.0.1") == [50] and score("server 10.0.0.1") == [70] and score("version 10.0.0.1") == [30]
    assert score("version, server 10.0.0.1") == [50] and score("serverversion 10.0.0.1") == [50]


def test_long_runs_take_linear_time(spark):
    n = 1_000_000
    texts = ["a" * n, "a" * n + "@b", "1" * n, "1." * n, "@" * n, "a@" * n, "a.b@c." * (n // 6), "+1" * n, "+" + "1" * n, "1 " * n, ("12-" * n), "ABCD" * n, "a@b.c" * (n // 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in scan_digests(df).collect()}
    assert {k for k, v in got.items() if v} <= {3, 6, 12} and got[6] and got[12]


def test_redaction(spark, docs):
    text = "mail a@b.co, 4111 1111 1111 1111 end"
    df = spark.createDataFrame([(text,), (None,), ("clean",), ("a@1.2.3.4 x",)], "text string").withColumn("s", personal_spans(F.col("text")))
    assert {r[0] for r in df.select(redacted(F.col("text"), F.col("s"))).collect()} == {"mail [EMAIL], [CARD] end", None, "clean", "[EMAIL] x"}


def test_empty_table(no_docs):
    assert scan_digests(no_docs).count() == 0
