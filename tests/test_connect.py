"""Connectors, candidates, masks, regions and scans against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import polygons as P
from gridloom.operators import candidates as C
from gridloom.operators import connectors as N
from gridloom.operators import inventory as I
from gridloom.operators import masks as M
from gridloom.operators import regions as R

box = P.box_ring


def test_gaps_between_regions():
    a, b = [box(0, 0, 2, 2)], [box(5, 6, 7, 8)]
    gap, p, q = N.gap_between(a, b)
    assert gap == 5 and p.tolist() == [2, 2] and q.tolist() == [5, 6]
    assert N.gap_between([box(0, 0, 4, 1)], [box(1, -3, 2, 4)])[0] == 0 and N.gap_between([box(0, 0, 9, 9)], [box(1, 1, 2, 2)])[0] == 0
    tip = [np.array([[3.0, 1.0], [6.0, 0.0], [6.0, 2.0]])]
    gap, p, q = N.gap_between(a, tip)
    assert gap == 1 and p.tolist() == [2, 1] and q.tolist() == [3, 1]


def test_connectors_join_parts_once(spark):
    parts = {1: (0, 0, 10, 10), 2: (11, 0, 20, 10), 3: (21.0, 0, 30, 10), 4: (0, 12.5, 30, 20), 5: (90, 0, 99, 9)}
    p = spark.createDataFrame([("F1", k, [[float(v) for v in box(*b).ravel()]]) for k, b in parts.items()], "scope string, component int, rings array<array<double>>")
    gaps = N.component_gaps(p, 3.0, 10.0)
    assert {(g.component_a, g.component_b): round(g.gap, 6) for g in gaps.collect()} == {(1, 2): 1.0, (2, 3): 1.0, (1, 4): 2.5, (2, 4): 2.5, (3, 4): 2.5}
    used = spark.createDataFrame([("F1", k, 2 if k != 3 else 9) for k in parts], "scope string, component int, targets long")
    doors = spark.createDataFrame([("F1", 25.0, 11.0, 26.0, 11.0), ("F1", 50.0, 50.0, 51.0, 50.0)], "scope string, ax double, ay double, bx double, by double")
    c = N.connector_candidates(gaps, doors, used, 1.0, 10.0)
    rows = {(r.component_a, r.component_b): r for r in c.collect()}
    assert rows[1, 2].source == "geometric_gap" and rows[1, 2].confidence == pytest.approx(0.82 - 0.2 / 1.25) and rows[2, 3].place < rows[1, 2].place
    assert (1, 4) not in rows and (2, 4) not in rows  # too wide without a door
    nodes = spark.createDataFrame([("F1", k, 10 * k, (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0, k if k != 2 else 1) for k, b in parts.items()], "scope string, component int, node long, x double, y double, part int")
    found = N.connectors(c, p, nodes, 1.0).collect()
    assert [(r.component_a, r.component_b) for r in found if r.component_b != 4] == [(2, 3)]  # 1 and 2 are joined already
    r = found[[x.component_b for x in found].index(3)]
    assert (r.node_a, r.node_b, r.x) == (20, 30, 20.5) and r.length_a == pytest.approx(np.hypot(20 - 15.5, r.y - 5) + 0.5)


def test_distances_of_segments(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, rng.integers(0, 6, 8))) for k in range(300)]
    names = ["ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"]
    df = spark.createDataFrame(rows, ["k", *names])
    s = lambda n: F.struct(*[F.col(c).alias(a) for c, a in zip(n, ("ax", "ay", "bx", "by"), strict=True)])
    got = {r.k: r.d for r in df.select("k", N.segments_apart(s(names[:4]), s(names[4:])).alias("d")).collect()}
    t = np.linspace(0, 1, 201)
    for k, *v in rows:
        a, b, c, d = np.array(v).reshape(4, 2)
        p, q = a + t[:, None] * (b - a), c + t[:, None] * (d - c)
        assert got[k] == pytest.approx(np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1)).min(), abs=0.05)


def test_graphs_refuse_odd_edges(spark):
    nodes = spark.createDataFrame([("f", 1, 0.0), ("f", 1, 5.0), ("f", 2, 3.0)], "scope string, node long, x double")
    edge = lambda a, b, p: spark.createDataFrame([("f", a, b, "k", p)], "scope string, node_a long, node_b long, kind string, path array<double>")
    n, e = N.graph_rows(nodes, edge(1, 2, [0.0, 0.0, 3.0, 4.0, 3.0, 5.0]))
    assert {r.node: r.x for r in n.collect()} == {1: 0.0, 2: 3.0} and [(r.edge, r.length) for r in e.collect()] == [(1, 6.0)]
    assert N.graph_rows(nodes, edge(1, 2, []))[1].first().length == 0
    for a, b in ((1, 1), (1, 9)):
        with pytest.raises(Exception, match="unknown node or its own start"):
            N.graph_rows(nodes, edge(a, b, [0.0, 0.0, 1.0, 1.0]))[1].collect()


def test_rule_files_are_checked(spark):
    rules = {r.id: r for r in C.loaded_rules(spark, {"rules": [{"mode": "sample_each_subitem", "id": "s", "subitems": [{"classes": ["a"]}, {"classes": [" b "]}], "sample_size": 3}, {"name": "n", "type": "all", "classes": ["c"]}]}).collect()}
    assert (rules["s"].type, rules["s"].classes, rules["s"].quota) == ("quota_per_class", ["a", "b"], 3) and rules["n"].type == "mandatory_all"
    for bad in ({}, {"rules": [3]}, {"rules": [{"type": "any", "classes": ["a"]}]}, {"rules": [{"type": "all", "classes": []}]}, {"rules": [{"type": "sample_each_subitem", "classes": ["a"]}]}):
        with pytest.raises(ValueError):
            C.loaded_rules(spark, bad)


def test_objects_without_ids_stay(spark):
    rows = [("f", "o", "", None, "c", 1), ("f", "o", "name", "d", None, 2), ("f", None, "", None, "c", 3), ("f", "", "", None, "c", 4), ("g", "o", "", None, None, 5)]
    df = spark.createDataFrame(rows, "floor string, object string, raw_name string, raw_class string, standard_class string, item long")
    assert {(r.floor, r.object): r.item for r in C.distinct_objects(df).collect()} == {("f", "o"): 2, ("f", "__item__3"): 3, ("f", "__item__4"): 4, ("g", "o"): 5}
    empty = C.requirements(C.distinct_objects(df.limit(0)), C.loaded_rules(spark, {"rules": [{"type": "all", "classes": ["c"]}]}))
    assert empty.count() == 0


def test_odd_boxes_of_targets_raise(spark):
    schema = "target long, scope string, floor string, building string, class string, x0 double, y0 double, x1 double, y1 double"
    members = spark.createDataFrame([], "scope string, place int, building string, ring array<double>")
    with pytest.raises(Exception, match="no box of annotation 7"):
        C.target_rows(spark.createDataFrame([(7, "f", "f", None, "c", 1.0, 0.0, 0.0, 1.0)], schema), members).collect()


def test_splits_of_masks():
    mask = np.zeros((100, 200), bool)
    mask[20:80, 20:80] = mask[20:80, 120:190] = True
    sizes = M.Sizes(gap=10, part=5, reach=5, margin=2, merge=4)
    axis, at, score = M.best_split(mask, (0, 0, 200, 100), sizes)
    assert axis == "x" and 95 <= at <= 105 and score > 0
    assert M.best_split(mask, (0, 0, 90, 100), sizes) is None and M.best_split(np.zeros((9, 9), bool), (0, 0, 9, 9), sizes) is None
    assert M.best_split(mask.T, (0, 0, 100, 200), sizes)[0] == "y"
    assert M.tight(mask, (0, 0, 100, 100), (0, 0, 100, 100), 3) == (17, 17, 83, 83)


def test_grown_masks_equal_plain_loops():
    rng = np.random.default_rng(1)
    mask = rng.random((17, 23)) < 0.03
    want = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        want[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3] = True
    assert (M.grown(mask, 5) == want).all()


def test_parts_groups_and_support():
    mask = np.zeros((100, 200), bool)
    mask[10:30, 10:30] = mask[10:30, 34:60] = mask[60:90, 150:190] = True
    sizes = M.Sizes(part=5, reach=3, margin=1, merge=6, near=5)
    frame = (0, 0, 200, 100)
    assert sorted(M.part_boxes(mask, frame, frame, sizes)) == [(8, 8, 32, 32), (32, 8, 62, 32), (148, 58, 192, 92)]
    whole, parts, n = M.grouped(mask, [frame], frame, sizes)
    assert parts == [(8, 8, 62, 32), (148, 58, 192, 92)] and whole == (8, 8, 192, 92) and n == mask.sum()
    kept, gone = M.supported(mask, parts, [(0, 0, 50, 50)], frame, sizes)
    assert kept == parts[:1] and gone == parts[1:] and M.supported(mask, parts, [], frame, sizes) == (parts, [])
    assert M.supported(mask, parts, [(0, 0, 50, 50), (100, 60, 145, 90)], frame, sizes)[0] == parts  # near, and a major share
    assert M.bridges([(0, 0, 10, 10), (14, 5, 20, 30), (0, 90, 10, 99)], 6) == [(10, 5, 14, 10)]
    assert M.merged([(0, 0, 1, 1), (3, 0, 4, 1), (5, 0, 6, 1), (50, 0, 51, 1)], 2) == [(0, 0, 6, 1), (50, 0, 51, 1)]


def test_buildings_need_review(spark):
    cells = spark.createDataFrame([("i", x, y) for x in (*range(5, 40), *range(60, 95)) for y in range(10, 50)], "image string, x int, y int")
    images = spark.createDataFrame([("i", 200, 60), ("j", 50, 50)], "image string, width int, height int")
    found = spark.createDataFrame([("i", "A", 0.0, 0.0, 50.0, 60.0), ("i", "B", 55.0, 0.0, 100.0, 60.0), ("i", "C", 150.0, 0.0, 190.0, 60.0), ("i", "D", 58.0, 0.0, 99.0, 60.0)], "image string, building string, x0 double, y0 double, x1 double, y1 double")
    out = {r.building: r for r in M.reconciled_buildings(cells, images, found, M.Sizes(part=5, reach=3, margin=1, merge=4, near=3)).collect()}
    assert not out["A"].needs_review and (out["A"].x0, out["A"].x1) == (3, 42) and out["A"].cells == 35 * 40
    assert out["C"].reason == "no_obstacles" and out["B"].reason == "overlap" == out["D"].reason


ITEM = "drawing long, item long, x0 double, y0 double, x1 double, y1 double, entity_type string, geometry_kind string, layer string, block string, text string, source string"


def regions(spark, rows):
    i = spark.createDataFrame(rows, ITEM)
    items = i.select("drawing", "item", B.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"), "entity_type", "geometry_kind", "layer", "block", "text", "source")
    sheets = spark.createDataFrame([(1, 1, 0.0, 0.0, 1000.0, 1000.0)], "drawing long, sheet long, x0 double, y0 double, x1 double, y1 double").select("drawing", "sheet", B.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
    return R.inspection_regions(sheets, items, 200.0).orderBy("region").collect()


def line(k, x0, y0, x1, y1, layer):
    return (1, k, float(x0), float(y0), float(x1), float(y1), "LINE", "line", layer, "", "", "direct_entity")


def test_regions_by_layers_labels_and_nothing(spark):
    axes = [line(k, 200, 200 + 60 * k, 800, 201 + 60 * k, "AXIS") for k in range(8)] + [line(20 + k, 200 + 80 * k, 200, 201 + 80 * k, 640, "AXIS") for k in range(8)]
    far = [line(90 + k, 5, 900 + k, 20, 901 + k, "DIM-X") for k in range(3)]
    (r,) = regions(spark, axes + far)
    assert r.source == "axis_dimension_layer_envelope" and (r.x0, r.y0, r.x1, r.y1) == (197.5, 197.5, 802.5, 642.5) and r.objects == 16
    (r,) = regions(spark, axes[:2])
    assert r.source == "sheet_bbox_fallback" and r.x1 == 1000
    (r,) = regions(spark, axes)
    assert r.source == "axis_dimension_envelope"  # one layer is all that there is
    label = lambda k, x, y, t: (1, 200 + k, float(x), float(y), x + 5.0, y + 5.0, "TEXT", "text", "AXIS_TEXT", "", t, "direct_entity")
    labels = [label(k, 50 + 60 * k, 20, f"A-{k}") for k in range(5)] + [label(10 + k, 600 + 60 * k, 20, f"B{k}") for k in range(5)] + [label(30, 5, 500, "DN100")]
    both = regions(spark, axes + labels)
    assert [(r.region, r.source) for r in both] == [("R01_A", "axis_label_group_A"), ("R02_B", "axis_label_group_B")]


def test_grids_of_unnamed_layers(spark):
    grid = [line(k, 100, 100 + 50 * k, 900, 101 + 50 * k, "X1") for k in range(10)] + [line(20 + k, 100 + 80 * k, 100, 101 + 80 * k, 700, "X1") for k in range(10)]
    (r,) = regions(spark, grid)
    assert r.source == "axis_dimension_envelope" and r.objects == 20
    assert regions(spark, grid[:12])[0].source == "sheet_bbox_fallback"


def test_stairs_cluster(spark):
    rows = [(1, k, "A-STRS", "LINE", 100.0 * k, 0.0, 100.0 * k + 10, 500.0) for k in range(5)] + [(1, 20, "A-STRS", "LINE", 9000.0, 0.0, 9010.0, 10.0), (1, 30, "楼 梯", "INSERT", 5000.0, 5000.0, 5100.0, 5100.0), (1, 40, "A-STRS", "LINE", 0.0, 0.0, 20000.0, 9.0), (1, 50, "WALL", "INSERT", 0.0, 0.0, 9.0, 9.0)]
    i = spark.createDataFrame(rows, "sheet long, item long, layer string, entity_type string, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(1, 0.0, 0.0, 50000.0, 40000.0)], "sheet long, x0 double, y0 double, x1 double, y1 double")
    of = lambda df, *c: df.select(*c, B.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
    out = R.stair_rows(of(i, "sheet", "item", "layer", "entity_type"), of(s, "sheet"), 500.0).orderBy("object_id", "layer").collect()
    assert [(r.layer, r.members, r.x0, r.x1) for r in out] == [("A-STRS", 5, 0.0, 410.0), ("楼 梯", 1, 5000.0, 5100.0)]


def test_label_texts(spark):
    df = spark.createDataFrame([("（a－1）", "AXIS"), ("12", "轴号"), ("FM12", "AXIS"), ("A1", "WALL"), (None, "AXIS"), ("ABCDE1", "AXIS")], "t string, m string")
    assert [r.g for r in df.select(R.label_group(F.col("t"), F.col("m")).alias("g")).collect()] == ["A", "NUM", None, None, None, None]


def test_scans_and_shapes(spark):
    members = spark.createDataFrame([("A", 1, "h1", "LINE", "0", "", None), ("A", 2, "h2", "INSERT", "0", "", "B"), ("B", 3, "h3", "TEXT", "0", "x", None), ("B", 4, "h4", "INSERT", "0", "", "A"), ("C", 5, "h5", "LINE", "0", "", None)], "block string, member long, handle string, entity_type string, layer string, text string, child string")
    inserts = spark.createDataFrame([("Model", 100, "top", "A", "L"), ("Model", 101, "", "C", "L")], "layout string, insert_id long, handle string, block string, layer string")
    attributes = spark.createDataFrame([(100, 900, "L", "no. 1"), (2, 901, "L", "no. 2")], "owner long, attribute long, layer string, text string")
    rows = I.expanded(inserts, members, attributes, None, 2).collect()
    got = {(r.source, r.depth, r.member, "/".join(r.block_path), "/".join(r.insert_path)) for r in rows if r.insert_id == 100}
    assert got == {
        ("insert_container", 0, None, "A", "top"), ("insert_attrib", 1, 900, "A", "top"), ("virtual_entity_in_insert", 1, 1, "A", "top"), ("insert_container", 1, 2, "A/B", "top/h2"), ("insert_attrib", 2, 901, "A/B", "top/h2"),
        ("virtual_entity_in_insert", 2, 3, "A/B", "top/h2"), ("insert_container", 2, 4, "A/B/A", "top/h2/h4"),
    }
    assert len(rows) == 9
    signed = spark.createDataFrame([("A", True, False), ("B", True, False), ("C", False, False)], "block string, has_recursive_semantics boolean, has_recursive_geometry_semantics boolean")
    some = I.expanded(inserts, members, attributes, signed, 2).collect()
    assert not [r for r in some if r.insert_id == 101 and r.source != "insert_container"] and not [r for r in some if r.member == 1]  # plain lines within blocks stay out
    e = spark.createDataFrame([("CIRCLE", None, False, 1.0, 2.0, 3.0, 0.0, 0.0), ("ARC", None, False, 0.0, 0.0, 1.0, 350.0, 10.0), ("POLYLINE", [[0.0, 0.0], [1.0, 0.0]], True, 0.0, 0.0, 0.0, 0.0, 0.0), ("CIRCLE", None, False, 0.0, 0.0, 0.0, 0.0, 0.0)], "entity_type string, points array<array<double>>, closed boolean, x double, y double, r double, a double, b double")
    g = I.geometry_rows(e.withColumn("s", I.shape_points(*map(F.col, ("entity_type", "points", "closed", "x", "y", "r", "a", "b")))), "s").collect()
    assert [(r.entity_type, r.geometry_point_count, r.geometry_polygon_count) for r in g] == [("CIRCLE", 49, 1), ("ARC", 24, 0), ("POLYLINE", 3, 0)]
    assert g[0].geometry_area == pytest.approx(24 * 9 * math.sin(2 * math.pi / 48)) and g[1].geometry_length == pytest.approx(math.radians(20), rel=1e-3)


def test_gaps_of_many_pairs_and_one_by_one():
    rng = np.random.default_rng(2)
    for corners in (3, 4, 6):
        turns = np.sort(rng.uniform(0, 2 * np.pi, (2, 120, corners)), axis=2)
        a, b = (np.stack([np.cos(t), np.sin(t)], 2) * rng.uniform(0.2, 3, (120, 1, 2)) + rng.uniform(-3, 3, (120, 1, 2)) for t in turns)
        gap, p, q = N.gaps_between(a, b)
        for k in range(120):
            one, on_a, on_b = N.gap_between([a[k]], [b[k]])
            assert (gap[k], *p[k], *q[k]) == pytest.approx((one, *on_a, *on_b), abs=1e-12)


def test_crossing_parts_without_a_corner_in_the_other_meet():
    cross = N.gaps_between(np.array([P.box_ring(-2.0, -0.1, 2.0, 0.1)]), np.array([P.box_ring(-0.1, -2.0, 0.1, 2.0)]))
    assert cross[0][0] == 0


def test_gaps_of_parts_with_and_without_holes_in_one_batch(spark):
    rng = np.random.default_rng(4)
    shapes = {}
    for k in range(60):
        x, y = map(float, rng.uniform(0, 6, 2))
        turn = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 6))))
        shapes[k] = [box(x, y, x + 1, y + 1)] if k % 3 else [np.stack([x + np.cos(turn) / 2, y + np.sin(turn) / 2], 1)]
        if k % 7 == 0:
            shapes[k] = [box(x, y, x + 1, y + 1), box(x + 0.2, y + 0.2, x + 0.8, y + 0.8)[::-1]]
    p = spark.createDataFrame([("F1", k, [r.ravel().tolist() for r in s]) for k, s in shapes.items()], "scope string, component int, rings array<array<double>>").coalesce(1)
    found = N.component_gaps(p, 0.4, 2.0)
    got = {(r.component_a, r.component_b): (r.gap, r.ax, r.ay, r.bx, r.by) for r in found.collect()}
    want = {(a, b): N.gap_between(shapes[a], shapes[b]) for a in shapes for b in shapes if a < b}
    assert set(got) == {k for k, (gap, _, _) in want.items() if gap <= 0.4} and len(got) > 100
    assert all(g[0] == pytest.approx(want[k][0], abs=1e-12) and math.hypot(g[3] - g[1], g[4] - g[2]) == pytest.approx(g[0], abs=1e-9) for k, g in got.items())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # no list of lists a pair in Python
