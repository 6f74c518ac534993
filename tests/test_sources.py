"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from roadlake.operators.planning import parsed_plan
from roadlake.sources import network, sinks

NET = """<net>
 <junction id="a" type="priority" x="1.234" y="2"/><junction id="b" type="traffic_light" x="3" y="4"/><junction id=":i" type="internal" x="0" y="0"/>
 <edge id=":e" function="internal"><lane id=":e_0" length="1" speed="2" shape="0,0 1,1"/></edge>
 <edge id="1" from="a" to="b" type="road"><lane id="1_0" length="10.12345" speed="5.5" shape="0,0 1,1"/><lane id="1_1" length="11" speed="6" shape="2,2 3,3"/></edge>
 <edge id="2" from="b" to="a" type="road"><lane id="2_0" length="20" speed="5" shape="0,0 1,1"/></edge>
 <connection from="1" to="2"/><connection from="1" to="2"/><connection from=":e" to="2"/>
 <roundabout nodes="a b" edges="1 2"/>
</net>"""


@pytest.fixture
def file(tmp_path):
    def make(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return make


def test_network(spark, file):
    path = file("n.net.xml", NET)
    assert [tuple(r) for r in network.junctions(spark, path).orderBy("junction").collect()] == [("a", "priority", 1.23, 2.0), ("b", "traffic_light", 3.0, 4.0)]
    assert [tuple(r) for r in network.edges(spark, path).orderBy("edge_id").collect()] == [("1", "a", "b", 10.123, 5.5, 2, "road", "0,0 1,1"), ("2", "b", "a", 20.0, 5.0, 1, "road", "0,0 1,1")]
    assert [tuple(r) for r in network.connections(spark, path).collect()] == [("1", "2")]
    assert network.lanes(spark, path).count() == 3
    assert network.roundabouts(spark, path).first()["nodes"] == ["a", "b"]


def test_routes_and_vehicles_round_trip(spark, file, tmp_path):
    lists = spark.createDataFrame([("r0", [1, 2]), ("r1", [3])], "route_id string, edges array<int>")
    sinks.write_routes(lists, f"{tmp_path}/routes")
    assert sorted((r["route_id"], r["edges"]) for r in network.routes(spark, f"{tmp_path}/routes").collect()) == [("r0", ["1", "2"]), ("r1", ["3"])]
    cars = spark.createDataFrame([("v1", "r0", 2.345, "car"), ("v0", "r1", 1.0, "car")], "vehicle_id string, route_id string, depart double, vtype string")
    sinks.write_vehicles(cars, f"{tmp_path}/cars")
    assert sorted(tuple(r) for r in network.vehicles(spark, f"{tmp_path}/cars").collect()) == [("v0", "r1", 1.0, "car"), ("v1", "r0", 2.34, "car")]
    bad = file("bad.add.xml", '<additional><vehicle id="v" depart="1" type="car"/></additional>')
    with pytest.raises(Exception, match="no route"):
        network.vehicles(spark, bad).collect()


def test_measurements(spark, file):
    path = file("d.out.xml", '<meandata><interval begin="0" end="1800"><edge id="1" traveltime="9.5" left="3"/><edge id="2"/></interval><interval begin="3600" end="5400"><edge id="1" traveltime="7"/></interval></meandata>')
    assert [tuple(r)[2:4] for r in network.measurements(spark, path, 0, 1).orderBy("edge_id").collect()] == [("1", 9.5), ("2", None)]
    assert network.measurements(spark, path).count() == 3


def test_statistics_report(spark, file, tmp_path):
    for k in (2, 1):
        file(f"s{k}.xml", f'<statistics><vehicles loaded="{k}0" inserted="5" running="1" waiting="0"/><teleports total="0" jam="0" yield="0" wrongLane="0"/><safety collisions="0" emergencyStops="0" emergencyBraking="0"/><vehicleTripStatistics count="4" routeLength="1.50"/></statistics>')
    got = network.statistics(spark, f"{tmp_path}/s*.xml")
    assert [(r["name"], r["vehicles_loaded"], r["vehicleTripStatistics_routeLength"]) for r in got.collect()] == [("s1", "10", "1.50"), ("s2", "20", "1.50")]
    sinks.write_report(got.select("name", "vehicles_loaded"), f"{tmp_path}/report")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/report").collect()] == [("s1", "10"), ("s2", "20")]


def test_plans(spark, file):
    path = file("p.pddl", "; note\n(drive-to-light v12 j3 r4 j5s1 use0 use1)\n(short)\n\n(drive-to-congested v1 j1 r2 j3 use1)\n")
    got = parsed_plan(network.plans(spark, path).select("value"))
    assert [tuple(r) for r in got.collect()] == [("drive-to-light", 12, "j3", 4, "j5s1"), ("drive-to-congested", 1, "j1", 2, "j3")]


def test_problem_texts(spark, tmp_path):
    facts = spark.createDataFrame([("p1", "init", "(b)"), ("p1", "init", "(a)"), ("p1", "goal", "(g)"), ("p2", "init", "(c)")], "problem string, section string, fact string")
    sinks.write_problems(facts, f"{tmp_path}/problems")
    text = {r["problem"]: r["value"] for r in spark.read.text(f"{tmp_path}/problems", wholetext=True).collect()}
    assert text == {"p1": "(:goal\n(g)\n)\n(:init\n(a)\n(b)\n)\n", "p2": "(:init\n(c)\n)\n"}


def test_weight_matrix(spark, file):
    path = file("m.prob", "a b\nx 1 2\ny 3 4\n")
    assert sorted(tuple(r) for r in network.weight_matrix(spark, path).collect()) == [("a", "x", 1), ("a", "y", 3), ("b", "x", 2), ("b", "y", 4)]


def test_map_objects(spark, file):
    path = file("m.osm", '<osm><node id="1" lat="1.5" lon="2"/><node id="2" lat="1" lon="2"><tag k="a" v="b"/></node><way id="5"><nd ref="1"/><nd ref="2"/><tag k="highway" v="path"/></way><relation id="9"><member type="way" ref="5" role="x"/></relation></osm>')
    way = network.tagged(spark, path, "way").first()
    assert (way["id"], way["tags"], way["refs"]) == (5, {"highway": "path"}, [1, 2])
    assert network.tagged(spark, path, "relation").first()["refs"] == [5]
    assert network.tagged(spark, path, "node").where(F.col("tags")["a"] == "b").count() == 1


def test_positions_are_those_of_the_files(spark, tmp_path):
    """The same ids from one file, from nine, and however many partitions read them."""
    from roadlake.sources import network

    names = [f"j{k * 7919 % 1000}" for k in range(900)]
    line = lambda name: f'<junction id="{name}" type="{"internal" if name.endswith("3") else "priority"}" x="1" y="2">\n</junction>'
    for parts in (1, 9):
        (tmp_path / f"of{parts}").mkdir()
        for k in range(parts):
            (tmp_path / f"of{parts}" / f"part-{k}.xml").write_text("<net>\n" + "\n".join(map(line, names[k * 900 // parts : (k + 1) * 900 // parts])) + "\n</net>")
    outer = [n for n in names if not n.endswith("3")]
    for parts in (1, 9):
        found = network.in_file_order(network.elements(spark, str(tmp_path / f"of{parts}"), "junction", network.JUNCTION))
        assert [r["_id"] for r in found.orderBy("position").collect()] == names and found.agg({"position": "max"}).first()[0] == 899
        kept = network.numbered(found.where("_type <> 'internal'"))
        assert [(r["id"], r["_id"]) for r in kept.orderBy("id").collect()] == list(enumerate(outer))
        assert tuple(network.extent(spark, str(tmp_path / f"of{parts}"), "junction").first()) == ("junction", names.index(outer[0]), names.index(outer[-1]))


def test_loading_counts_and_quarantines(spark, tmp_path):
    from roadlake.sources import network

    lane = '<lane id="l" length="{0}" speed="5" shape="0,0"/>'
    road = lambda i, a, b, length=9: f'<edge id="{i}" from="{a}" to="{b}">{lane.format(length)}</edge>'
    parts = {
        "junctions": [f'<junction id="{j}" type="priority" x="0" y="0"/>' for j in ("a", "b", "c", "b", "lone")] + ['<junction type="priority" x="1" y="1"/>', '<junction id=":x" type="internal" x="1" y="1"/>'],
        "edges": [road("ab", "a", "b"), road("bc", "b", "c"), road("bc", "b", "a"), road("cz", "c", "z"), road("ca", "c", "a", 0), '<edge id=":i" function="internal"/>', '<edge id="none" from="a" to="b"/>', road("cb", "c", "b")],
        "connections": ['<connection from="ab" to="bc"/>', '<connection from="bc" to="ca"/>', '<connection from="ab" to="cb"/>', '<connection from=":i" to="bc"/>'],
    }
    for name, rows in parts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.xml").write_text("<net>\n" + "\n".join(rows) + "\n</net>")
    net = network.load_network(spark, str(tmp_path))
    assert net.counts == {"junctions": (6, 2), "edges": (7, 4), "connections": (3, 2)}
    assert sorted((r["check"], r["key"]) for r in net.faults.collect()) == sorted([("junction_twin", "b"), ("junction_id", "#5"), ("edge_twin", "bc"), ("edge_end", "cz"), ("edge_measure", "ca"), ("edge_measure", "none"), ("connection_edge", "bc>ca"), ("connection_meet", "ab>cb"), ("junction_unused", "lone"), ("junction_closed", "c")])
    assert sorted((r["id"], r["edge_id"], r["route_id"]) for r in net.tables["edges"].collect()) == [(0, "ab", "r0"), (1, "bc", "r1"), (2, "cb", "r2")]
    assert [r["junction"] for r in net.tables["junctions"].orderBy("id").collect()] == ["a", "b", "c", "lone"]


def test_paths_seen_from_a_folder(spark):
    cases = [("/a/b", "../c.xml", "/a/c.xml"), ("file:///a/b", "./x/../c.xml", "file:///a/b/c.xml"), ("/a", "/z/../q.xml", "/q.xml"), ("/a", "../../../c", "/c"), ("/a", "hdfs://h/p/../c", "hdfs://h/c"), ("/a", None, None)]
    df = spark.createDataFrame(cases, "folder string, name string, want string")
    got = df.select("want", network.resolved_path(F.col("folder"), F.col("name")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_matrix_of_weights_survives_its_file(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 3), ("a", "x", 2), ("a", "y", 1), ("a", "y", 4)], "origin string, destination string, weight bigint")
    sinks.write_weight_matrix(df, str(tmp_path / "m"))
    got = {(r["origin"], r["destination"]): r["weight"] for r in network.weight_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {("a", "x"): 2, ("b", "x"): 3, ("a", "y"): 5, ("b", "y"): 0}


def test_steps_of_plans(spark):
    lines = spark.createDataFrame([("f", 0, "(car1 drive r12 x)"), ("f", 1, "(car2 drive r3)")], "file string, line int, value string")
    found = lambda p: [(r["vehicle"], r["route"]) for r in network.plan_steps(lines, p).orderBy("line").collect()]
    assert found(False) == [("car1", "r12"), ("car2", "r3")] and found(True) == [("car1", "12"), ("car2", "3")]
    with pytest.raises(Exception, match="no step"):
        network.plan_steps(spark.createDataFrame([("f", 0, "(car1 r)")], "file string, line int, value string")).collect()


def test_vehicles_need_a_type(spark, tmp_path):
    cars = spark.createDataFrame([(1, 2.0, 5, None)], "vehicle_id bigint, depart double, route_id bigint, vtype string")
    with pytest.raises(Exception, match="no type"):
        sinks.write_vehicles(cars, str(tmp_path / "v"))
