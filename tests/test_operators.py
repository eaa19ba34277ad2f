from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.functions import similarity
from gridloom.operators import clusters, graph, routes, selection, spatial
from gridloom.sources import artifacts
from gridloom.streaming import visits


def values(spark, expression, rows, name="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r.v for r in df.select("i", expression(F.col(name)).alias("v")).orderBy("i").collect()]


def test_casts(spark):
    assert values(spark, S.safe_double, ["1.5", "NaN", "inf", "-Infinity", "x", None, ""]) == [1.5, 0, 0, 0, 0, 0, 0]
    assert values(spark, S.numeral, ["7", "三", "十", "十二", "二十", "九十九", "x", None]) == [7, 3, 10, 12, 20, 99, None, None]


def test_text_keys(spark):
    assert values(spark, S.drawing_text, [r"\A1;{安全\P出口}　x", None]) == ["安全出口x", None]
    assert values(spark, S.library_key, [" a（b）　c ", ""]) == ["A(B)C", ""]
    assert values(spark, S.identifier, ["--a b--", "!!", "", "a_b"]) == ["a_b", "item", "item", "a_b"]
    assert values(spark, S.layer_key, ["A-Wall_(1)【x】/b"]) == ["AWALL1XB"]


def test_floors(spark):
    titles = {
        "3F": ["F3"], "3F 平面图": [], "B2F": ["B2"], "屋面 F12": ["ROOF"], "十二层": ["F12"], "81层": [], "夹层": ["MEZZANINE"], "": [], "AF3": [], "地下一层": ["B1"], "地下2层": ["B2"], "负二层": ["B2"], "首层": ["F1"],
        "顶层": ["ROOF"], "地下二层、二层": ["B2"], "地下二层、三层": ["B2", "F3"], "第二十三层平面": ["F23"], "B9": [], "b3-12f": ["B3", "F12"], "设备层 标准层 避难层": ["EQUIPMENT", "REFUGE", "STANDARD"], "二三层": [],
    }
    assert values(spark, S.floor_mentions, list(titles)) == list(titles.values())
    upper = ["F2", "2F", "2层", "二楼", "F7__B01", "ROOF", "屋顶层", "EQUIPMENT", "十二层", "(F3)", "x屋面"]
    lower = ["F1", "1F", "首层", "B1", "地下二层", "UNKNOWN", "", "负2层", "B1 3层", "一层", "F1 F2", "a F3"]
    assert values(spark, S.is_upper_floor, upper + lower) == [True] * len(upper) + [False] * len(lower)
    assert spark.range(1).select(S.is_upper_floor(F.lit("x"), F.lit(None).cast("string"), F.lit("3层")).alias("a"), S.is_upper_floor(F.lit("B1"), F.lit("3层")).alias("b")).first() == (True, False)
    assert values(spark, S.building_labels, ["1、2、3#", "A1号 b2号 A1号", "x"]) == [["1", "2", "3"], ["A1", "B2"], []]


def test_json(spark):
    assert values(spark, S.json_in_text, ['```json\n{"a": {"b": 1}}\n```', 'so {"a": 1} it', "none"]) == ['{"a": {"b": 1}}', '{"a": 1}', ""]
    assert values(spark, S.counter_total, ['{"a": 2, "b": 3}', "x", None, "{}"]) == [5, 0, 0, 0]


@pytest.mark.parametrize(("a", "b", "expected"), [("MARTHA", "MARHTA", 0.961111), ("DIXON", "DICKSONX", 0.813333), ("abcxyz", "abqqqq", 0.644444), ("", "a", 0), ("a", "a", 1)])
def test_jaro_winkler(a, b, expected):
    assert similarity.jaro_winkler(a, b) == pytest.approx(expected, abs=1e-5)


def test_greedy_matching_uses_each_end_once(spark):
    rng = random.Random(3)
    rows = [(1, rng.randrange(30), 30 + rng.randrange(30), 1.0, 1.0, rng.random()) for _ in range(200)]
    out = selection.greedy_matching(spark.createDataFrame(rows, "floor int, left_id long, right_id long, turned double, common double, apart double"), "floor").collect()
    ends = [e for r in out for e in (r.left_id, r.right_id)]
    assert len(ends) == len(set(ends))
    assert all(r[1] in ends or r[2] in ends for r in rows)


def test_components_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 1)], "u long, v long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9}
    e = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 1, 3, 5.0), (0, 7, 8, 1.0)], "floor int, a long, b long, w double")
    t = spark.createDataFrame([(0, 1), (0, 3), (0, 7)], "floor int, target long")
    got = {(r.src, r.dst): r.distance for r in graph.metric_closure(e, t).collect()}
    assert got == {(1, 1): 0, (3, 3): 0, (7, 7): 0, (1, 3): 2, (3, 1): 2}


def test_nearest_neighbors_equal_all_pairs(spark):
    rng = random.Random(4)
    pts = [(i % 2, i, rng.random() * (1 if i % 10 else 50), rng.random()) for i in range(80)]
    got = {(r.target_id, r.rank): r.other_id for r in spatial.nearest_neighbors(spark.createDataFrame(pts, "floor int, target_id long, x double, y double"), 2, 0.1).collect()}
    for f, i, x, y in pts:
        near = sorted((np.hypot(x - a, y - b), j) for g, j, a, b in pts if g == f and j != i)[:2]
        assert [got[i, 1], got[i, 2]] == [j for _, j in near]


def test_running_clusters(spark):
    rng = random.Random(6)
    values = [(f, round(rng.random() * 40, 2)) for f in range(2) for _ in range(60)] + [(3, 1.0)]
    got = {}
    for r in clusters.axis_clusters(spark.createDataFrame(values, "floor int, v double"), "v", 0.5).orderBy("floor", "place").collect():
        got.setdefault(r.floor, []).append((round(r.mean, 6), r.n))
    for floor in (0, 1, 3):
        out = []
        for v in sorted(v for f, v in values if f == floor):
            if out and abs(v - out[-1][0]) <= 0.5:
                out[-1] = [(out[-1][0] * out[-1][1] + v) / (out[-1][1] + 1), out[-1][1] + 1]
            else:
                out.append([v, 1])
        assert got[floor] == [(round(m, 6), n) for m, n in out]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = visits.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("SELECT * FROM counts").collect())) == sorted(map(tuple, visits.windowed_counts(events).collect()))


def test_sources_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "{1}", 1.5, ["x", "y"]), ("b", None, None, [])], "id string, text string, x double, path array<string>")
    artifacts.write_csv(rows, str(tmp_path / "c"))
    back = artifacts.read_csv(spark, str(tmp_path / "c"), "id string, text string, x double, path string").orderBy("id").collect()
    assert [(r.id, r.text, r.x, r.path) for r in back] == [("a", "{1}", 1.5, '["x","y"]'), ("b", None, None, "[]")]
    points = spark.createDataFrame([(1, "f1", 0.0, 0.0, 2.0, 1.0)], "id int, floor string, x0 double, y0 double, x1 double, y1 double")
    features = artifacts.features(points, ["id", "floor"])
    artifacts.write_geojson(features, str(tmp_path / "g"))
    out = artifacts.read_geojson(spark, str(tmp_path / "g"), "id int, floor string").collect()
    assert out[0].id == 1 and out[0].ring[2] == [2.0, 1.0]
    with pytest.raises(Exception, match="unknown obstacle type"):
        artifacts.checked_types(points.withColumn("kind", F.lit(None).cast("string")), "kind", ["column"]).collect()


def grid(n):
    """Edges of an n by n grid of nodes 0 to n * n - 1."""
    return [(0, a, b, 1.0) for a in range(n * n) for b in (a + 1, a + n) if b < n * n and (b != a + 1 or b % n)]


def test_paths(spark):
    from gridloom.operators import planning

    edges = spark.createDataFrame(grid(5), "floor int, a long, b long, w double")
    legs = spark.createDataFrame([(0, 1, 0, 24), (0, 2, 24, 4), (0, 3, 4, 99)], "floor int, place int, src long, dst long")
    paths = planning.shortest_paths(edges, legs)
    assert {(r.src, r.dst): (len(r.nodes), r.length) for r in paths.collect()} == {(0, 24): (9, 8.0), (24, 4): (5, 4.0)}
    events = planning.visit_events(legs, paths).orderBy("event").collect()
    assert [r.event for r in events] == list(range(1, 14))
    assert events[0].node == 0 and events[8].node == 24 and events[-1].node == 4


def test_grown_regions(spark):
    from gridloom.operators import planning

    seeds = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 10.0, 0.0)], "floor int, seed long, x double, y double")
    items = spark.createDataFrame([(0, float(x), float(y)) for x, y in ((1, 0), (2, 0), (2, 1), (9, 0), (5.6, 9), (30, 30))], "floor int, x double, y double")
    out = {r.seed: (r.x0, r.y0, r.x1, r.y1, r.rounds) for r in planning.grown_regions(seeds, items, 1.5).collect()}
    assert out == {1: (0, 0, 2, 1, 2), 2: (9, 0, 10, 0, 1)}


def test_rules(spark):
    from gridloom.operators import pools

    assert pools.checked_rules([{"type": "quota_total", "classes": ["a"], "quota": "3"}]) == [{"rule_id": "rule_0", "type": "quota_total", "classes": ["a"], "quota": 3}]
    for bad in ({"type": "x", "classes": ["a"]}, {"type": "quota_total"}, {"type": "quota_total", "classes": ["a"], "quota": 0}):
        with pytest.raises(ValueError):
            pools.checked_rules([bad])


def test_ways_over_near_points_are_those_over_their_edges(spark):
    import numpy as np

    from gridloom.operators import planning
    from gridloom.operators import spatial as J

    rng = np.random.default_rng(7)
    points = [(f, k, float(x), float(y)) for f in (0, 1) for k, (x, y) in enumerate(np.round(rng.random((70, 2)), 2 + f))]
    points += [(0, 70, 0.5, 0.5), (0, 71, 0.5, 0.5), (0, 72, 0.5000003, 0.5), (0, 73, 9.0, 9.0), (0, 74, None, 0.5)]  # coincident, close, far off, nowhere
    p = spark.createDataFrame(points, "floor int, target_id long, x double, y double")
    near = J.near_pairs(p, 0.17).where("target_id < other_id")
    edges = near.select("floor", F.col("target_id").alias("a"), F.col("other_id").alias("b"), F.round("distance", 6).alias("w"))
    legs = spark.createDataFrame([(f, a, b) for f in (0, 1) for a in range(0, 70, 5) for b in range(0, 75 - 5 * f, 3)] + [(0, 70, 3), (0, 71, 72), (0, 72, 8)], "floor int, src long, dst long")
    want = {(r.floor, r.src, r.dst): (r.nodes, r.length) for r in planning.shortest_paths(edges, legs).collect()}
    weight = {(r.floor, *ends): r.w for r in edges.collect() for ends in ((r.a, r.b), (r.b, r.a))}
    for most in (2048, 50):
        got = {(r.floor, r.src, r.dst): (r.nodes, r.length) for r in planning.near_paths(p, legs, 0.17, most).collect()}
        assert set(got) == set(want) and len(got) > 500
        for (f, a, b), (nodes, length) in got.items():
            walked = sum(weight[f, u, v] for u, v in zip(nodes, nodes[1:]))  # every leg is an edge
            assert nodes[0] == a and nodes[-1] == b and length == want[f, a, b][1] and abs(walked - length) < 1e-6
            if not f:
                continue
            assert nodes == want[f, a, b][0]


def test_visit_events_makes_no_row_an_edge(spark, tmp_path):
    from gridloom.plans import catalog

    rows = [(k, [0.0001 * k, 0.0], 0) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES["visit_events"](spark, str(tmp_path))
    assert found.count() == 60
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "other_id" not in plan and "ox" not in plan
