"""Map objects with their versions, files of changes to them, and snapshots that changes are merged into."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadlake.functions.storage import written
from roadlake.sources.sinks import write_elements

KINDS, ACTIONS = ["node", "way", "relation"], ["create", "modify", "delete"]
#: The columns of an object; tags, refs and members are null where the kind has none.
OBJECT = "kind string, id bigint, version bigint, timestamp string, uid bigint, user string, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
COLUMNS = [c.split()[0] for c in OBJECT.split(", ")]
_AUTHOR = "_id:bigint,_version:bigint,_timestamp:string,_uid:bigint,_user:string"
_TAG = "tag:array<struct<_k:string,_v:string>>"
_FIELDS = {
    "node": f"{_AUTHOR},_lat:double,_lon:double,{_TAG}",
    "way": f"{_AUTHOR},nd:array<struct<_ref:bigint>>,{_TAG}",
    "relation": f"{_AUTHOR},member:array<struct<_type:string,_ref:bigint,_role:string>>,{_TAG}",
}


def _row_schema(kind: str) -> StructType:
    return StructType.fromDDL(f"o struct<{_FIELDS[kind]}>")["o"].dataType


def _columns(o: Column, kind: str) -> list[Column]:
    """An element of a kind as the columns of ``OBJECT``."""
    absent = {"lat": "double", "lon": "double", "refs": "array<bigint>", "members": "array<struct<type:string,ref:bigint,role:string>>"}
    own = {}
    if kind == "node":
        own = {"lat": o["_lat"], "lon": o["_lon"]}
    elif kind == "way":
        own = {"refs": F.coalesce(F.transform(o["nd"], lambda n: n["_ref"]), F.array().cast("array<bigint>"))}
    else:
        member = lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))
        own = {"members": F.coalesce(F.transform(o["member"], member), F.array().cast(absent["members"]))}
    tags = F.map_from_entries(F.coalesce(o["tag"], F.array().cast("array<struct<_k:string,_v:string>>")))
    found = {"kind": F.lit(kind), "tags": tags} | {c: o[f"_{c}"] for c in ("id", "version", "timestamp", "uid", "user")} | {c: F.lit(None).cast(t) for c, t in absent.items()} | own
    return [found[c].alias(c) for c in COLUMNS]


def map_format(spark: SparkSession, path: str) -> str:
    """``osm`` or ``osc`` by the root element of the files; an error for any other and for both at once."""
    root = F.regexp_extract("value", r"<(osm|osmChange)[\s>]", 1)
    found = sorted(r[0] for r in spark.read.text(path).where(F.col("value").contains("<osm")).select(root.alias("r")).where("r <> ''").distinct().collect())
    if found not in (["osm"], ["osmChange"]):
        raise ValueError(f"{path} holds no map objects and no changes, or both: {found}")
    return {"osm": "osm", "osmChange": "osc"}[found[0]]


def objects(spark: SparkSession, path: str, kinds: list[str] = KINDS) -> DataFrame:
    """The objects of ``kinds`` in the form of ``OBJECT``; kinds that aren't asked for aren't read."""
    parts = []
    for kind in kinds:
        found = spark.read.format("xml").option("rowTag", kind).option("mode", "FAILFAST").schema(_row_schema(kind)).load(path)
        parts.append(found.select(F.struct("*").alias("o")).select(*_columns(F.col("o"), kind)))
    return reduce(DataFrame.unionByName, parts)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(action, and the columns of ``OBJECT``) of a file of changes.

    A block of one action is read as one row before its objects part; ``write_changes`` gives each
    object a block of its own, and other writers a block for each run of one action.
    """
    schema = ", ".join(f"{kind} array<struct<{_FIELDS[kind]}>>" for kind in KINDS)
    parts = []
    for action in ACTIONS:
        blocks = spark.read.format("xml").option("rowTag", action).option("mode", "FAILFAST").schema(schema).load(path)
        of = lambda kind: F.transform(kind, lambda o: F.struct(*_columns(o, kind)))
        every = F.flatten(F.array_compact(F.array(*map(of, KINDS))))
        parts.append(blocks.select(F.explode(every).alias("o")).select(F.lit(action).alias("action"), "o.*"))
    return reduce(DataFrame.unionByName, parts)


def newest(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each (kind, id) by ``order``, partial first, so many changes of one object aren't one task's work."""
    rest = [c for c in rows.columns if c not in ("kind", "id")]
    found = rows.groupBy("kind", "id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("o"))
    return found.select("kind", "id", *[F.col("o")[c].alias(c) for c in rest])


def merged(snapshot: DataFrame, change: DataFrame) -> DataFrame:
    """``snapshot`` (``OBJECT`` and visible) after ``change`` (``OBJECT`` and action), in the same form.

    The change of highest version holds, of equal versions a deletion and then the later time; it
    replaces what the snapshot has unless that is newer. A deleted object stays as a tombstone,
    not visible, so an older change that comes in a later file doesn't bring it back; the result is the
    same in any order of files. Rows without an id or version go; repeated changes are one.

    The changes of each object become one row first, as a written table, so that files of changes are read once. Then the snapshot meets the changed ids only,
    which Spark may broadcast where they are few, so a large snapshot needn't be shuffled.
    """
    known = change.where("kind is not null and id is not null and version is not null")
    whole = F.xxhash64(F.to_json(F.struct(*[c for c in COLUMNS if c != "tags"], F.array_sort(F.map_entries("tags")).alias("t"))))
    last = written(newest(known.select(*COLUMNS, (F.col("action") == "delete").alias("_gone"), whole.alias("_row")), ["version", "_gone", "timestamp", "_row"]))
    key = ["kind", "id"]
    versions = last.select(*key, F.col("version").alias("_new"))
    base = snapshot.where("kind is not null and id is not null and version is not null")
    met = base.join(versions, key, "left")
    kept = met.where("_new is null or version > _new").select(*COLUMNS, "visible")
    newer = base.select(*key, "version").join(versions, key).where("version > _new").select(*key)
    won = last.join(newer, key, "left_anti").select(*COLUMNS, (~F.col("_gone")).alias("visible"))
    return kept.unionByName(won)


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that turn the visible objects of one snapshot into those of another.

    An object that is only in ``new`` is created, one of a higher version there modified, one that
    is only in ``old`` deleted, with the version after its own. Lower and equal versions change nothing.
    """
    key = ["kind", "id"]
    a, b = old.where("visible"), new.where("visible")
    versions = a.select(*key, F.col("version").alias("_old"))
    there = b.join(versions, key, "left").where("_old is null or version > _old")
    made = there.select(F.when(F.col("_old").isNull(), "create").otherwise("modify").alias("action"), *COLUMNS)
    gone = a.join(b.select(*key), key, "left_anti").withColumn("version", F.col("version") + 1)
    return made.unionByName(gone.select(F.lit("delete").alias("action"), *COLUMNS))


def _elements(authors: bool) -> list[Column]:
    """The attributes and elements of an object, for a file."""
    named = ["id", "version", "timestamp", "uid", "user", "lat", "lon"] if authors else ["id", "lat", "lon"]
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v")))
    nd = F.transform("refs", lambda r: F.struct(r.alias("_ref")))
    member = F.transform("members", lambda m: F.struct(m["type"].alias("_type"), m["ref"].alias("_ref"), m["role"].alias("_role")))
    return [*[F.col(c).alias(f"_{c}") for c in named], nd.alias("nd"), member.alias("member"), tags.alias("tag")]


def write_objects(rows: DataFrame, path: str, kinds: list[str] = KINDS, authors: bool = True) -> None:
    """Objects as elements, each kind in a folder of its own under ``path``; without ``authors`` versions and users go."""
    for kind in kinds:
        write_elements(rows.where(F.col("kind") == kind).select(*_elements(authors)), f"{path}/{kind}", "osm", kind)


def write_changes(rows: DataFrame, path: str) -> None:
    """Changes as blocks of their action, one object each, each action in a folder of its own under ``path``."""
    for action in ACTIONS:
        of = lambda kind: F.when(F.col("kind") == kind, F.struct(*_elements(True))).alias(kind)
        write_elements(rows.where(F.col("action") == action).select(*map(of, KINDS)), f"{path}/{action}", "osmChange", action)
