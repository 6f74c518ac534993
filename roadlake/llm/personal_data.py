"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.llm._batch import each

#: In the order in which kinds are listed; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "national_id", "local_phone"]
N_BASE = 4

#: The patterns of the base kinds. Runs that can't become a match are passed as a
#: whole, so that a long run takes time in proportion to its length; matches are the same.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Patterns of the kinds that are added: account numbers, identity numbers, numbers without a country.
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", re.ASCII)
NATIONAL_ID = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
LOCAL_PHONE = re.compile(r"\b[0-9]{2,4}[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}\b", re.ASCII)

#: Score of a kind before its context, in hundredths, and what a context word adds to it.
SCORES = {"email": (90, 10), "ip": (50, 20), "card": (80, 10), "phone": (60, 20), "iban": (90, 10), "national_id": (40, 30), "local_phone": (40, 30)}
#: Words that support a kind, and words that speak against any, in so many code points before and after.
CONTEXT = {
    "email": ["mail", "e-mail", "email", "contact", "write"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "mastercard", "credit", "payment"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "transfer"],
    "national_id": ["ssn", "social security", "national id", "insurance"],
    "local_phone": ["phone", "tel", "call", "mobile", "fax"],
}
AGAINST = ["version", "order", "invoice", "isbn", "part no", "page"]
BEFORE, AFTER = 40, 20
PENALTY = 20
#: Added spans need so much.
THRESHOLD = 60

_SUPPORT = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b", re.ASCII) for kind, words in CONTEXT.items()}
_AGAINST = re.compile(rf"\b(?:{'|'.join(AGAINST)})\b", re.ASCII)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits, every second one from the right but one doubled, sum to a multiple of ten."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number leaves 1 modulo 97: its first four characters go last, letters count 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: the run of characters before it, as far as the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        size, run = 64, 0
        while True:  # a longer piece only if the run fills the shorter one
            piece = text[max(done, at - size) : at][::-1]
            found = LOCAL.match(piece)
            run = found.end() if found else 0
            if run < len(piece) or at - size <= done:
                break
            size *= 8
        domain = DOMAIN.match(text, at + 1) if run else None
        if domain:
            yield at - run, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if len(parts) == 4 and all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(1 for _ in _DIGITS.finditer(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in IBAN.finditer(text) if mod97(m[0].replace(" ", "")))


def _national_ids(text: str) -> Iterator[tuple[int, int]]:
    for m in NATIONAL_ID.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in LOCAL_PHONE.finditer(text))


_FINDERS = [_emails, _ips, _cards, _phones, _ibans, _national_ids, _local_phones]


def score(kind: str, text: str, start: int, end: int) -> int:
    """The kind's score, more with a supporting word nearby, less with one against; 0 to 100."""
    near = (text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]).translate(_LOWER)
    base, more = SCORES[kind]
    return max(0, min(100, base + more * bool(_SUPPORT[kind].search(near)) - PENALTY * bool(_AGAINST.search(near))))


def spans_of(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, score) by kind, then start.

    All valid base spans are there, whatever their score. An added one must reach the threshold, and
    must not overlap a base span or an added one of an earlier kind.
    """
    out: list[tuple[int, int, int, int]] = []
    for k, (kind, find) in enumerate(zip(KINDS, _FINDERS, strict=True)):
        found = [(k, a, b, score(kind, text, a, b)) for a, b in find(text)]
        if k >= N_BASE and found:
            found = _clear([s for s in found if s[3] >= THRESHOLD], out)
        out += found
    return out


def _clear(found: list[tuple[int, int, int, int]], taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Those found that overlap none that are taken; both are swept once in order."""
    out, k, order, reach = [], 0, sorted((a, b) for _, a, b, _ in taken), 0
    for s in found:
        while k < len(order) and order[k][0] < s[2]:
            reach = max(reach, order[k][1])
            k += 1
        if reach <= s[1]:
            out.append(s)
    return out


SPANS = "array<struct<kind:int,start:bigint,end:bigint,score:int>>"


def personal_spans(text: Column) -> Column:
    """``SPANS`` of a text, by kind and start, in code points, ends exclusive; kind indexes ``KINDS``. Null and empty texts have none."""
    names = ["kind", "start", "end", "score"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in each(batches):
            found = [spans_of(t) if t else [] for t in texts.to_pylist()]
            flat = [s for spans in found for s in spans]
            at = [0]
            for spans in found:
                at.append(at[-1] + len(spans))
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array([s[k] for s in flat], kinds[k]) for k in range(4)], names))

    return F.arrow_udf(run, SPANS)(text)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every maximal run of overlapping spans replaced by the kind of its first, as in [EMAIL]."""
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda a, n: text.substr((a + 1).cast("int"), n.cast("int"))
    clear = F.aggregate(
        sorted_,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]) | (acc["at"] == 0), F.concat(acc["out"], F.array(piece(acc["at"], s["start"] - acc["at"]), F.get(tags, s["kind"])))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.array(piece(acc["at"], F.lit(2**31 - 1)))),
    )
    return F.when(F.size(spans) > 0, F.array_join(clear, "")).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, all spans and their scores, for every row of ``docs``.

    Null and empty texts have no spans; repeated rows are answered alike; an empty table gives no
    rows. Other columns of ``docs`` are not read.
    """
    found = docs.select("doc_id", personal_spans(F.col("text")).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    base = F.filter("s", lambda s: s["kind"] < N_BASE)
    scores = F.array_join(F.transform("s", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in range(N_BASE)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"), scores.alias("scores"))
