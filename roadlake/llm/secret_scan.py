"""Secrets in texts: fixed patterns, and windows of high entropy, with column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: Strings that are measured: long runs of the characters that keys are written in.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters in a window over a candidate.
WINDOW = 20
#: Least entropy of a window in millionths of a bit a character, by class: digits and a-f or A-F
#: with both digits and letters; letters and digits of mixed kinds; others with + / = _ or -.
LIMITS = {"hex": 3_000_000, "alnum": 3_500_000, "token": 3_600_000}
#: Suppressed: placeholders, dashed or underscored words, and plain words or numbers. Repeated groups
#: are possessive: they match the same, and a long candidate doesn't exhaust the matcher's stack.
ALLOWED = [r"(?i)example|sample|dummy|placeholder|changeme|redacted", r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+[-_/=+]*+$", r"^[0-9]++(?:[-_/][0-9]++)*+$", r"(.)\1{7,}"]

#: Marks a match in a text; the text's own marks become another character of no class.
MARK, SUBSTITUTE = "\x01", "\x02"
#: Pieces of a text that are summed together; even, so that a block starts between matches.
BLOCK = 1000


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches of a pattern: every second piece is a match."""
    return F.split(F.regexp_replace(F.translate(text, MARK, SUBSTITUTE), f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, found)> in code points.

    Lengths of the pieces are summed within blocks of them, and the blocks' sums before, so
    that a text of very many matches takes time in proportion to them.
    """
    empty = "array<struct<start:bigint,end:bigint,found:string>>"
    length = lambda p: F.char_length(p).cast("bigint")
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(
            block["pieces"],
            F.struct(at.alias("at"), F.lit(False).alias("hit"), F.array().cast(empty).alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + length(p)).alias("at"),
                (~acc["hit"]).alias("hit"),
                F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + length(p)).alias("end"), p.alias("found"))))).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def blocks(pieces: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda k: F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(each, lambda b: F.struct(b.alias("pieces"), F.aggregate(b, zero, lambda n, p: n + length(p)).alias("n")))

    def placed(cut: Column) -> Column:
        before = F.aggregate(cut, F.struct(zero.alias("at"), none.alias("out")), lambda acc, b: F.struct((acc["at"] + b["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(cut, before, within))

    # an array of one element gives its value a name that is computed once
    found = F.flatten(F.transform(F.array(_pieces(text, pattern)), lambda p: F.flatten(F.transform(F.array(blocks(p)), placed))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(empty))


def _scaled(count: int) -> int:
    return round(count * math.log2(count) * 1_000_000) if count else 0


def entropy_limit(found: Column) -> Column:
    """The least entropy for the class of a candidate's characters; null suppresses it."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | found.rlike(pattern)
    return (
        F.when(allowed | ~found.rlike("[0-9]") | ~found.rlike("[A-Za-z]"), F.lit(None))
        .when(found.rlike("^([0-9a-f]+|[0-9A-F]+)$"), LIMITS["hex"])
        .when(found.rlike("^[A-Za-z0-9]+$"), LIMITS["alnum"])
        .otherwise(LIMITS["token"])
    )


def window_entropy(found: Column) -> Column:
    """Highest entropy over all windows of a candidate, in millionths of a bit a character.

    With c the count of each character, the entropy of a window of w characters is
    log2(w) - sum(c log2 c) / w. The candidate is cut into characters once; then a fold over the
    characters that leave and enter the window carries the count of each and the sum, of which
    one entry changes at a time. So time grows with the candidate's length.
    """
    table = F.array(*[F.lit(_scaled(c)).cast("bigint") for c in range(WINDOW + 2)])
    first, last = ord("+"), ord("z")  # all characters of candidates lie between
    # counts are the characters of a string, 0 as A: shorter to copy than an array
    none = F.struct(F.lit("A" * (last - first + 1)).alias("counts"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.lit(2**62).cast("bigint").alias("low"))
    entry = lambda code, by: F.struct(code.alias("at"), F.lit(by).alias("by"))

    def steps(codes: Column) -> Column:
        return F.flatten(F.transform(codes, lambda c, k: F.when(k >= WINDOW, F.array(entry(F.get(codes, k - WINDOW), -1), entry(c, 1))).otherwise(F.array(entry(c, 1)))))

    def move(acc: Column, step: Column) -> Column:
        old = F.ascii(acc["counts"].substr(step["at"], F.lit(1))) - ord("A")
        new, n = old + step["by"], acc["n"] + step["by"]
        total = acc["sum"] + F.get(table, new) - F.get(table, old)
        counts = F.overlay(acc["counts"], F.char(new + ord("A")), step["at"], F.lit(1))
        return F.struct(counts.alias("counts"), n.alias("n"), total.alias("sum"), F.when(n == WINDOW, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"))

    codes = F.transform(F.split(found, ""), lambda c: F.ascii(c) - (first - 1))
    # an array of one element gives its value a name that is computed once
    low = F.element_at(F.transform(F.array(codes), lambda c: F.aggregate(steps(c), none, move, lambda acc: acc["low"])), 1)
    return F.lit(_scaled(WINDOW) // WINDOW) - F.floor(low / WINDOW)


def secret_spans(text: Column) -> Column:
    """array<struct(start, kind, end)> of all secrets in a text, sorted; kind indexes ``KINDS``.

    Base kinds are the leftmost non-overlapping matches of each pattern, those of too short
    values dropped. Candidates with a window of high entropy that overlap no base span are
    added. Null and empty texts have none; positions are code points, ends exclusive.
    """
    text = F.coalesce(text, F.lit(""))
    made = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"))
    assign = F.filter(_matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 12)
    base = F.concat(F.transform(assign, made(0)), F.transform(_matches(text, ACCESS), made(1)), F.transform(_matches(text, HEX), made(2)))
    limited = F.filter(F.transform(_matches(text, CANDIDATE), lambda m: F.struct(m["start"], m["end"], m["found"], entropy_limit(m["found"]).alias("limit"))), lambda m: m["limit"].isNotNull())
    measured = F.filter(limited, lambda m: window_entropy(m["found"]) >= m["limit"])
    return F.array_sort(F.concat(base, F.transform(measured, made(3))))


def without_overlaps(spans: Column) -> Column:
    """The sorted spans without those of kind entropy that overlap one of a base kind.

    Candidates don't overlap each other, so one at a time is open while spans go by in order.
    """
    span = "struct<start:bigint,kind:int,end:bigint>"
    shut = lambda acc: F.when(acc["open"]["end"] > 0, F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])
    none = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(3).alias("kind"), F.lit(0).cast("bigint").alias("end"))

    def go(acc: Column, s: Column) -> Column:
        is_base = s["kind"] < 3
        return F.struct(
            F.when(is_base, F.greatest(acc["covered"], s["end"])).otherwise(acc["covered"]).alias("covered"),
            F.when(is_base, F.when(s["start"] < acc["open"]["end"], none).otherwise(acc["open"])).when(s["start"] >= acc["covered"], s).otherwise(none).alias("open"),
            F.when(is_base, acc["out"]).otherwise(shut(acc)).alias("out"),
        )

    measured = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("covered"), none.alias("open"), F.array().cast(f"array<{span}>").alias("out")), go, shut)
    return F.when(F.exists(spans, lambda s: s["kind"] == 3), F.array_sort(F.concat(F.filter(spans, lambda s: s["kind"] < 3), measured))).otherwise(spans)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with the column ``into``: the spans of each row's text. Other columns stay."""
    found = docs.withColumn(into, secret_spans(F.col("text")))
    return found.withColumn(into, without_overlaps(F.col(into)))


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans replaced by ``mask``.

    One pass over the sorted spans keeps the last end and the pieces between them.
    """
    clear = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]) | (acc["at"] == 0), F.concat(acc["out"], F.array(text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(text.substr((acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))),
    )
    return F.when(F.size(spans) > 0, F.array_join(clear, mask)).otherwise(text)


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans, for every row of ``docs``."""
    found = scanned(docs.select("doc_id", "text"), "_s").select("doc_id", "_s")
    base = F.filter("_s", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("_s", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_s")).alias("spans"))
