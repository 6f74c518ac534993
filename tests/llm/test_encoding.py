import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from roadlake.llm import byte_bpe, token_counts
from roadlake.llm.queries import vocabulary_path

from .conftest import plain

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_are_the_librarys(docs, rows, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = byte_bpe.encode_digests(docs, vocabulary_path())
    assert plain(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_texts_above_a_chunk(spark, library):
    """Batches of several chunks, and a text that is longer than one."""
    rnd = random.Random(11)
    make = lambda n: " ".join("".join(rnd.choices("abcdeé ", k=rnd.randint(1, 9))) for _ in range(n))
    rows = [(k, make(n)) for k, n in enumerate([200_000, 30_000, 30_000, 5, 60_000])]
    got = byte_bpe.encode_digests(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), vocabulary_path())
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {k: len(library.encode_ordinary(t)) for k, t in rows}


def test_splits_like_the_pattern(library):
    with open(vocabulary_path(), "rb") as f:
        words = byte_bpe.Vocabulary(f.read())
    rnd = random.Random(2)
    letters = list("aáB ''’stredlvm19½\n\t  .!é😀́\x1c\x00中٣")
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 30))) for _ in range(5000)] + ["a" * 3000, "'" * 99, "'ll've're's" * 9]
    got, at = words.encode(pa.array(texts)), 0
    for text, n in zip(texts, got.counts.tolist(), strict=True):
        assert got.ids[at : at + n].tolist() == library.encode_ordinary(text)
        at += n


def test_classes_of_all_code_points():
    """A code point joins the piece before it if that is of its class; merges of its first byte show it."""
    ranks = {bytes([k]): k for k in range(256)}
    for first in (b"a", b"1", b"!"):
        for k in range(128, 256):
            ranks[first + bytes([k])] = len(ranks)
    library = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table, names = byte_bpe.class_table(), [byte_bpe.LETTER, byte_bpe.DIGIT, byte_bpe.OTHER]
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 7 == 0 or c < 0x3000)]
    points += [c for a, b in byte_bpe.NEW_LETTERS + byte_bpe.NEW_DIGITS for c in (a - 1, a, b, b + 1)]
    for c in points:
        size = len(chr(c).encode())
        joined = [n for n, first in zip(names, "a1!", strict=True) if len(library.encode_ordinary(first + chr(c))) == size]
        assert (joined or [byte_bpe.BLANK_INSIDE]) == [table[c]]


def test_long_pieces_merge_like_short_ones():
    with open(vocabulary_path(), "rb") as f:
        words = byte_bpe.Vocabulary(f.read())
    rnd = random.Random(4)
    for _ in range(300):
        piece = bytes(rnd.choices(b"aeinrst\xc3\xa9", k=rnd.randint(2, 60)))
        assert words._merge_short(piece) == words._merge_long(piece)


def test_scan_equals_stepping():
    rnd = np.random.default_rng(3)
    scan, symbols = byte_bpe.scanner(), rnd.integers(0, 10, 5000)
    state, want = byte_bpe.FRESH, []
    for s in symbols:
        state = byte_bpe.step(state, int(s))[0]
        want.append(state)
    assert scan.from_fresh[byte_bpe.scanned(scan.of_symbol[symbols], scan.after)].tolist() == want


def test_ids_decode_and_offsets_end_tokens(spark, docs):
    coded = docs.select("text", byte_bpe.encoded(spark, vocabulary_path(), F.col("text")).alias("e"))
    back = coded.select("text", "e", byte_bpe.decoded(spark, vocabulary_path(), F.col("e.ids")).alias("b"))
    for r in back.collect():
        assert bytes(r["b"]) == (r["text"] or "").encode()
        assert (r["e"]["ends"] or [0])[-1] == len((r["text"] or "").encode())


def test_histogram_answers_limits(spark, docs, rows, library):
    lengths = [len(library.encode_ordinary(t or "")) for _, t, *_ in rows]
    got = token_counts.length_histogram(docs.select(byte_bpe.token_lengths(spark, vocabulary_path(), F.col("text")).alias("n")), F.col("n"))
    limits = token_counts.context_limits(got).cache()
    for r in limits.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert r["tokens_lost"] == sum(max(x - n, 0) for x in lengths)
        assert r["quantile"] == sum(x <= n for x in lengths) / len(lengths)
    for limit in (0, 7, 100, 10**6):
        assert token_counts.truncated_total(limits, limit).first()["truncated_total"] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile_length(limits, 0.5).first()["n_tokens"] == sorted(lengths)[(len(lengths) - 1) // 2]


def test_empty_tables(spark, no_docs):
    assert byte_bpe.encode_digests(no_docs, vocabulary_path()).count() == 0
    empty = token_counts.context_limits(token_counts.length_histogram(no_docs.select(F.length("text").alias("n")), F.col("n")))
    assert empty.count() == 0
    assert token_counts.truncated_total(empty, 5).count() == 0
