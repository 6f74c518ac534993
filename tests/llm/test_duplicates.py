import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadlake.llm import repeated_strings, simhash
from roadlake.operators.components import connected_components

from .conftest import plain

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def lowest_reachable(keys, linked):
    """Smallest position that each position reaches over linked pairs."""
    up = list(range(len(keys)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if linked(keys[a], keys[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return [top(k) for k in range(len(keys))]


def test_components_and_fingerprints(docs, rows):
    prints = [print_of(r[1]) for r in rows]
    tops = lowest_reachable(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for r, t in zip(rows, tops, strict=True):
        if r[0] is not None:
            first[t] = min(first.get(t, r[0]), r[0])
    want = [(r[0], f"{p:016x}", first.get(t)) for r, p, t in zip(rows, prints, tops, strict=True)]
    assert plain(simhash.digests(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_all_choices_of_bits(radius):
    masks = simhash.covering_masks(radius)
    rnd = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(m & bits == 0 for m in masks)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("small", [2, 24])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, radius, small):
    """Also where buckets are larger than what is compared in place."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rnd = random.Random(radius)
    values = {rnd.getrandbits(64) for _ in range(5)}
    for v in list(values):
        values |= {v ^ (1 << b) for b in rnd.sample(range(64), 12)} | {v ^ (1 << b) ^ (1 << c) for b, c in (rnd.sample(range(64), 2) for _ in range(12))}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    tops = lowest_reachable(values, near)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), radius)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= radius for r in links.collect())
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert [got.get(v, v) for v in values] == [values[t] for t in tops]


def removed(texts):
    data = [(t or "").encode() for t in texts]
    size = repeated_strings.WINDOW
    seen = Counter(b[k : k + size] for b in data for k in range(len(b) - size + 1))
    for b in data:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                cover[k : k + size] = True
        yield b, cover


def check_repeats(df, rows):
    want = []
    for (i, *_), (b, cover) in zip(rows, removed([r[1] for r in rows]), strict=True):
        starts = int((np.diff(cover.astype(int), prepend=0) == 1).sum())
        want.append((i, len(b), int(cover.sum()), starts, hashlib.sha256(np.frombuffer(b, np.uint8)[~cover].tobytes()).hexdigest()))
    assert plain(repeated_strings.digests(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_repeats_same_as_counting_windows(docs, rows):
    check_repeats(docs, rows)


@pytest.mark.parametrize("in_task", [0, 3, 1000])
def test_partial_overlaps(spark, monkeypatch, in_task):
    """Strings that share 390 to 700 bytes with others, by both ways of the last refinement."""
    monkeypatch.setattr(repeated_strings, "MAX_IN_TASK", in_task)
    monkeypatch.setattr(repeated_strings, "PIECE", 3000)
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choices("abcdefghij é", k=n))
    shared = [noise(700) for _ in range(3)]
    rows = []
    for k in range(60):
        s = rnd.choice(shared)
        a = rnd.randint(0, 320)
        rows.append((k, noise(rnd.randint(0, 500)) + s[a : a + rnd.randint(380, 700)] + noise(rnd.randint(0, 500))))
    rows += [(100, "ab" * 500), (101, noise(4000) + shared[0] + noise(2500) + shared[0]), (102, "x" * 399), (103, "x" * 400), (104, "x" * 401)]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_empty_tables(no_docs):
    assert simhash.digests(no_docs).count() == 0
    assert repeated_strings.digests(no_docs).count() == 0


def test_other_columns_stay(docs, rows):
    got = repeated_strings.without_repeats(docs)
    assert got.columns == [*docs.columns, "_r"]
    assert got.count() == len(rows)


def test_components_of_chains_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99, 500: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0


@pytest.mark.parametrize("step", [1, -1])
def test_refinement_groups_by_the_bytes_of_every_width(step):
    rnd = np.random.default_rng(3)
    data = rnd.choice(np.frombuffer(b"ab", np.uint8), 4000, p=[0.9, 0.1])
    place, reach, bucket = rnd.integers(200, 3800, 300), rnd.integers(0, 120, 300), rnd.integers(0, 4, 300)
    bucket = np.unique(bucket, return_inverse=True)[1].astype(np.int64)
    found = repeated_strings._refined(bucket, data, place, step, reach, 100)
    assert len(found) == 101
    seen = lambda k, w: (bucket[k], tuple(data[place[k] + step * i] if i < reach[k] else 256 for i in range(w)))
    for w in range(101):
        pairs = {(int(found[w][k]), seen(k, w)) for k in range(300)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_made_up_strings_of_equal_rolling_names_stay_apart():
    """Thue-Morse words of 1,024 bytes have equal names modulo 2^64; nothing that removes bytes has."""
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    one = np.array([97 + x for x in word], np.uint8)
    two = np.array([98 - x for x in word], np.uint8)
    both, at = np.concatenate((one, two)), np.array([0, 1024])
    rolling, residues = (kind(both)(at, at + 1024) for kind in (repeated_strings.Rolling, repeated_strings.Residues))
    assert rolling[0] == rolling[1] and residues[0] != residues[1]
    twice = np.concatenate((one, one))
    assert np.ptp(repeated_strings.Residues(twice)(at, at + 1024)) == 0
    assert np.ptp(repeated_strings.Residues(one)(np.arange(600), np.arange(600) + 400)) > 0


def test_equal_surroundings_have_equal_identifiers():
    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 100, 3000).astype(np.uint8)
    other = rnd.integers(97, 100, 500).astype(np.uint8)
    data = np.concatenate((text, other, text))
    of, at, low, high, gram, around = repeated_strings.anchors(data, np.array([0, 3000, 3500, 6500]))
    rows = lambda k: [(a, lo, hi, g, x) for t, a, lo, hi, g, x in zip(of, at, low, high, gram, around, strict=True) if t == k]
    assert rows(0) == rows(2) and not {x for *_, x in rows(0)} & {x for *_, x in rows(1)}
