"""Licences of files: TF-IDF cosines of headers and texts to templates, then inheritance by directory."""

from __future__ import annotations

import json
import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlake.functions.storage import written
from roadlake.llm._batch import identity
from roadlake.llm.licenses import TEMPLATES

#: Possessive: it matches the same, and a long dotted term doesn't exhaust the matcher's stack.
TERM = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"
#: Weight of a term that no template has, each time it occurs.
OTHER = 2.0
#: Least cosine of a header or text to a template.
MIN_COSINE = 0.7
#: A file is a licence file if so large a share of its terms is in what matches best, or by name.
FILE_SHARE = 0.3
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


@cache
def template_weights() -> list[tuple[int, str, str, float, float]]:
    """(template, licence, term, weight in the unit vector, idf) of the templates.

    A term that occurs c times weighs (1 + ln c) ln((1 + n) / (1 + d)) before the vector is made a
    unit, n being the templates and d those that have it; terms of all templates weigh nothing.
    """
    terms = [re.findall(TERM, text.lower()) for _, text in TEMPLATES]
    held = {t: sum(t in own for own in terms) for own in terms for t in own}
    idf = {t: math.log((1 + len(terms)) / (1 + d)) for t, d in held.items()}
    out = []
    for k, ((name, _), own) in enumerate(zip(TEMPLATES, terms, strict=True)):
        raw = {t: (1 + math.log(own.count(t))) * idf[t] for t in dict.fromkeys(own) if idf[t] > 0}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out += [(k, name, t, w / norm, idf[t]) for t, w in raw.items()]
    return out


#: Templates of which so few terms can make a cosine of ``MIN_COSINE`` are sought by those terms.
FEW = 6


@cache
def telling_terms() -> tuple[list[str], int]:
    """(terms, number): what has none of the terms, and fewer known terms than the number, is like no template.

    A cosine is at most the length of the part of the template's unit vector that is shared. So
    ``MIN_COSINE`` takes at least as many terms as the heaviest that make a part of that length. Where
    these are few, one of them must be there: those are heaviest whose absence leaves too short a rest.
    """
    out: set[str] = set()
    number = len(template_weights())
    for k in range(len(TEMPLATES)):
        own = sorted(((w * w, t) for n, _, t, w, _ in template_weights() if n == k), reverse=True)
        least = next(m for m in range(1, len(own) + 1) if sum(w for w, _ in own[:m]) > MIN_COSINE**2 - 1e-6)
        if least <= FEW:
            out |= {t for m, (_, t) in enumerate(own) if sum(w for w, _ in own[m:]) > MIN_COSINE**2 - 1e-6}
        else:
            number = min(number, least)
    return sorted(out), number


def _template_table(spark: SparkSession) -> DataFrame:
    """``template_weights`` as a table; its size is that of the templates."""
    made = F.from_json(F.lit(json.dumps(template_weights())), "array<array<string>>")
    rows = spark.range(1).select(F.explode(made).alias("t"))
    return rows.select(*[F.col("t")[k].cast(kind).alias(name) for k, (name, kind) in enumerate([("template", "int"), ("license", "string"), ("term", "string"), ("w", "double"), ("idf", "double")])])


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def can_match(unit: Column) -> Column:
    """False only for what can't reach ``MIN_COSINE``: a cosine is at most the share of known terms in the vector's length.

    The idf of a known term is rounded up to that of its class: terms of few templates, of some,
    and of many.
    """
    idf = {t: i for _, _, t, _, i in template_weights()}
    steps = [0.9, 1.6]
    low, middle = [[t for t, i in idf.items() if lower < i <= upper] for lower, upper in ((0, steps[0]), (steps[0], steps[1]))]
    most = lambda t: F.when(t.isin(low), steps[0] ** 2).when(t.isin(middle), steps[1] ** 2).otherwise(max(idf.values()) ** 2)
    tf = lambda c: 1 + F.log(c.cast("double"))
    known = F.aggregate(unit["terms"], F.lit(0.0), lambda n, t: n + most(t["term"]) * tf(t["c"]) * tf(t["c"]))
    others = unit["n"] - F.aggregate(unit["terms"], F.lit(0), lambda n, t: n + t["c"])
    return known * (1 - MIN_COSINE**2) * 1.0001 >= others * (OTHER * MIN_COSINE) ** 2


def units(text: Column) -> Column:
    """array<struct(n, terms)>: what is compared with the templates: the whole text, its paragraphs, its lines and sentences.

    ``n`` counts all terms; ``terms`` holds each known one and its number. Only what can reach
    ``MIN_COSINE`` is listed: by ``telling_terms``, and by ``can_match``.
    """
    wanted, number = telling_terms()
    known = F.lit(sorted({t for _, _, t, _, _ in template_weights()}))
    # an array of one element gives its value a name that is computed once
    named = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def counted(terms: Column, own: Column) -> Column:
        each = F.transform(F.array_intersect(terms, own), lambda t: F.struct(t.alias("term"), (F.size(terms) - F.size(F.array_remove(terms, t))).alias("c")))
        return F.struct(F.size(terms).alias("n"), each.alias("terms"))

    def listed(paragraphs: Column, own: Column) -> Column:
        telling = F.array_intersect(own, F.lit(wanted))
        like = lambda terms: F.arrays_overlap(terms, telling) | (F.size(F.array_intersect(terms, own)) >= number)
        parts = F.concat(F.array(F.flatten(F.flatten(paragraphs))), F.transform(paragraphs, F.flatten), F.flatten(paragraphs))
        chosen = F.filter(F.transform(F.filter(parts, like), lambda terms: counted(terms, own)), can_match)
        return F.when((F.size(telling) > 0) | (F.size(own) >= number), chosen).otherwise(F.array().cast("array<struct<n:int,terms:array<struct<term:string,c:int>>>>"))

    lines = lambda p: F.transform(F.split(p, r"\n|(?<=[.!?;])[\x20\t]+"), _terms)
    split = F.transform(F.split(text, r"\n[\x20\t]*\n"), lines)
    return named(split, lambda p: named(F.array_intersect(F.flatten(F.flatten(p)), known), lambda own: listed(p, own)))


def matches(texts: DataFrame) -> DataFrame:
    """(row, license, score, largest): the licence of each text that has one.

    ``texts`` is a table of row (the same for equal texts) and units. Terms become rows, which join
    the weights of the templates; cosines are sums over them.
    """
    listed = texts.select("row", F.posexplode("units").alias("unit", "u"))
    others = F.col("u.n") - F.aggregate("u.terms", F.lit(0), lambda n, t: n + t["c"])
    rows = listed.select("row", "unit", "u.n", others.alias("others"), F.explode("u.terms").alias("t"))
    rows = rows.select("row", "unit", "n", "others", "t.term", (1 + F.log(F.col("t.c").cast("double"))).alias("tf")).distinct()
    weights = F.broadcast(_template_table(texts.sparkSession))
    idf = F.broadcast(_template_table(texts.sparkSession).select("term", "idf").distinct())
    norms = rows.join(idf, "term").groupBy("row", "unit", "n").agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2) + F.max("others") * OTHER**2).alias("norm"))
    dots = rows.join(weights, "term").groupBy("row", "unit", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("w")).alias("dot"))
    scored = dots.join(norms, ["row", "unit"]).withColumn("score", F.least(F.lit(1.0), F.round(F.col("dot") / F.col("norm"), 5))).where(F.col("score") >= MIN_COSINE)
    best = F.struct((-F.col("score")).alias("score"), "license")
    return scored.groupBy("row").agg(F.min(best).alias("b"), F.max("n").alias("largest")).select("row", "b.license", (-F.col("b.score")).alias("score"), "largest")


def own_licenses(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, path, license, score, is_file) of every row of ``files``, which has path and text; doc holds its columns ``keep`` (all).

    The licence of a file is that of the template with the highest cosine to its text or to a
    header in it, the first by name on ties; null below ``MIN_COSINE``, and null for null and
    empty texts. Repeated rows are answered alike; an empty table gives no rows. Texts are read
    once: what is compared is written beside ``keep``.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = written(files.select(F.struct(*(keep or files.columns)).alias("doc"), "path", identity(F.col("text")).alias("row"), F.size(_terms(text)).alias("n_terms"), units(text).alias("units")))
    found = written(matches(keyed.where(F.size("units") > 0).select("row", "units")))
    joined = keyed.select("doc", "path", "row", "n_terms").join(found, "row", "left")
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    is_file = F.col("license").isNotNull() & (named | (F.col("largest") >= FILE_SHARE * F.col("n_terms")))
    return joined.select("doc", "path", "license", F.coalesce("score", F.lit(0.0)).alias("score"), is_file.alias("is_file"))


def directory(path: Column) -> Column:
    """The path without its last part; the empty root for a path without a slash."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def with_licenses(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, path, own_license, score, is_license_file, license, inherited_from) of every row of ``files``.

    A file without a licence of its own has that of the nearest directory at or above it that
    holds a licence file; of several there, the most frequent licence, then the first by name.
    inherited_from is that directory, null for files with their own. Paths are joined for
    distinct directories, of which each names its ancestors; so a directory that holds a third of
    all files is one row until the last join, whose right side is one row a directory. A null
    path is in the root.
    """
    rated = own_licenses(files, keep).withColumn("dir", directory(F.col("path")))
    votes = rated.where("is_file").groupBy("dir", "license").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("dir").orderBy(F.desc("n"), "license")
    given = votes.withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("dir").alias("from"), F.col("license").alias("given"))
    folders = rated.groupBy("dir").agg(F.count(F.lit(1)).alias("k"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("name"), k.alias("depth")))
    chain = folders.select("dir", F.explode(F.array_distinct(above)).alias("a")).select("dir", F.col("a.name").alias("from"), F.col("a.depth").alias("depth"))
    nearest = chain.join(given, "from").groupBy("dir").agg(F.max(F.struct("depth", "from", "given")).alias("up")).select(F.col("dir").alias("of"), "up")
    joined = rated.join(nearest, F.col("dir") == F.col("of"), "left")
    own = F.col("license")
    return joined.select("doc", "path", own.alias("own_license"), "score", F.col("is_file").alias("is_license_file"), F.coalesce(own, F.col("up.given")).alias("license"), F.when(own.isNull(), F.col("up.from")).alias("inherited_from"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, score, is_license_file, license, inherited_from of every row.

    Documents carry no paths, so each is laid out as source/lang/doc_id.
    """
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return with_licenses(docs.select("doc_id", path.alias("path"), "text"), ["doc_id"]).select("doc.doc_id", "path", "own_license", "score", "is_license_file", "license", "inherited_from")
