"""Files of map objects and of changes, against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from roadlake.operators.selection import tag_condition
from roadlake.sources import changes

SEEN = ["kind", "id", "version", "visible"]


def objects(spark, rows, extra=""):
    full = [(k, i, n, None, 7, "ann", 1.5 if k == "node" else None, 2.5 if k == "node" else None, {"name": f"v{n}", "a&b": "<x>"}, [1, 2] if k == "way" else None, [("way", 4, "outer")] if k == "relation" else None, *rest) for k, i, n, *rest in rows]
    return spark.createDataFrame(full, changes.OBJECT + extra)


def state(df):
    return sorted(map(tuple, df.select(*SEEN).collect()))


def replay(snapshot, change):
    held = {(k, i): (n, s) for k, i, n, s in snapshot}
    for k, i, n, action in sorted(change, key=lambda c: (c[2], c[3] == "delete")):
        if (k, i) not in held or held[k, i][0] <= n:
            held[k, i] = (n, action != "delete")
    return sorted((k, i, n, s) for (k, i), (n, s) in held.items())


def case(seed):
    dice = random.Random(seed)
    snapshot = [(k, i, dice.randint(1, 9), dice.random() < 0.9) for k in changes.KINDS for i in range(20)]
    change = [(dice.choice(changes.KINDS), dice.randrange(30), dice.randint(1, 12), dice.choice(changes.ACTIONS)) for _ in range(120)]
    return snapshot, change


def test_files_of_changes_give_a_plain_replay(spark, tmp_path):
    snapshot, change = case(1)
    changes.write_changes(objects(spark, change, ", action string"), str(tmp_path / "osc"))
    assert changes.map_format(spark, str(tmp_path / "osc/*")) == "osc"
    read = changes.changes(spark, str(tmp_path / "osc/*"))
    assert sorted(map(tuple, read.select("kind", "id", "version", "action").collect())) == sorted(change)
    got = changes.merged(objects(spark, snapshot, ", visible boolean"), read)
    assert state(got) == replay(snapshot, change)
    way = got.where("kind = 'way' and visible").first()
    assert way["tags"] == {"name": f"v{way['version']}", "a&b": "<x>"} and way["refs"] == [1, 2] and way["lat"] is None


def test_order_of_files_makes_no_difference(spark):
    snapshot, change = case(2)
    base = objects(spark, snapshot, ", visible boolean")
    for order in (change, change[::-1]):
        got = base
        for part in (order[:50], order[50:90], order[90:]):
            got = changes.merged(got, objects(spark, part + part[:3], ", action string"))
        assert state(got) == replay(snapshot, change)


def test_differences_turn_one_snapshot_into_the_other(spark):
    snapshot, change = case(3)
    old = objects(spark, snapshot, ", visible boolean")
    new = changes.merged(old, objects(spark, change, ", action string"))
    steps = changes.changes_between(old, new)
    back = changes.merged(old, steps)
    shown = lambda df: state(df.where("visible"))
    assert shown(back) == shown(new)
    assert changes.changes_between(new, new).count() == 0


def test_objects_of_all_kinds_survive_a_file(spark, tmp_path):
    rows = objects(spark, [("node", 1, 3), ("way", 1, 4), ("relation", 9, 5)])
    changes.write_objects(rows, str(tmp_path / "all"))
    by_id = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["id"], r["kind"]))
    assert by_id(changes.objects(spark, str(tmp_path / "all/*"))) == by_id(rows)
    assert [r["kind"] for r in changes.objects(spark, str(tmp_path / "all/*"), ["way"]).collect()] == ["way"]
    changes.write_objects(rows, str(tmp_path / "bare"), ["node"], authors=False)
    bare = changes.objects(spark, str(tmp_path / "bare/*"), ["node"]).first()
    assert (bare["id"], bare["version"], bare["user"], bare["lat"]) == (1, None, None, 1.5)
    assert changes.map_format(spark, str(tmp_path / "all/*")) == "osm"
    (tmp_path / "other.xml").write_text("<net></net>")
    with pytest.raises(ValueError):
        changes.map_format(spark, str(tmp_path / "other.xml"))


def test_rows_without_id_or_version_and_empty_tables(spark):
    empty = objects(spark, [("node", 1, 1, True)], ", visible boolean").where("id < 0")
    change = objects(spark, [("node", 1, 2, "modify"), ("node", None, 2, "modify"), ("node", 3, None, "delete"), ("way", 4, 1, "delete")], ", action string")
    assert state(changes.merged(empty, change)) == [("node", 1, 2, True), ("way", 4, 1, False)]
    assert state(changes.merged(empty, change.where("id < 0"))) == []


def test_filters_by_author_by_key_pattern_and_by_several_values(spark):
    df = spark.createDataFrame([(1, 5, "ann", {"amenity": "pub", "addr:city": "Brno"}), (22, 60, "bob", {"amenity": "bar"}), (3, None, None, {})], "id bigint, uid bigint, user string, tags map<string,string>")
    pick = lambda text: [r["id"] for r in df.where(tag_condition(text)).collect()]
    assert pick("amenity=pub =bar") == [1, 22] and pick("amenity=cafe =bar and @uid>9") == [22]
    assert pick("addr:*=Brno") == [1] and pick("*city=") == [1] and pick("*men*=b*") == [22]
    assert pick("@id=2*") == [22] and pick("@user=ann") == [1] and pick("@uid<10") == [1] and pick("@id>=3") == [22, 3]
    with pytest.raises(ValueError):
        pick("=bar")
    assert df.where(F.lit(True)).count() == 3


def test_files_of_changes_are_read_once(spark, tmp_path):
    """What is merged reads the newest change of each object, not the files again."""
    rows = objects(spark, [("way", 1, 2, "modify"), ("way", 1, 3, "delete"), ("way", 2, 1, "modify")], ", action string")
    rows.drop("tags").write.json(str(tmp_path / "c"))
    change = spark.read.schema(rows.drop("tags").schema).json(str(tmp_path / "c")).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))
    found = changes.merged(objects(spark, [("way", 1, 1, True), ("way", 2, 5, True)], ", visible boolean"), change)
    assert " json" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert state(found) == [("way", 1, 3, False), ("way", 2, 5, True)]
