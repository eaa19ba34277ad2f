"""Scopes, free space and envelopes by hand-made cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import polygons as P
from gridloom.operators import overlays as O
from gridloom.sources.shared import in_blocks


def ring(x0, y0, x1, y1):
    return [x0, y0, x1, y0, x1, y1, x0, y1, x0, y0]


def region(rows):
    return [np.asarray(r, float).reshape(-1, 2) for r in rows]


def test_damaged_polygons(spark):
    df = spark.createDataFrame([("a", ring(0.0, 0.0, 2.0, 2.0)), ("a", [0.0, 0.0, 1.0, 1.0]), ("a", ring(1.0, 1.0, 3.0, 3.0)[::1])], "scope string, ring array<double>")
    row = O.polygon_unions(df).first()
    assert (row.polygons, row.area, row.parts, row.holes, len(row.rings[0]) // 2) == (2, 7.0, 1, 0, 8)
    with pytest.raises(Exception, match="none of 1 polygons has an area"):
        O.polygon_unions(df.where("size(ring) = 4")).collect()
    assert O.polygon_unions(df.limit(0)).count() == 0


def test_free_space_of_blocked_and_open_scopes(spark):
    d = spark.createDataFrame([(s, ring(0.0, 0.0, 10.0, 10.0)) for s in "abc"], "scope string, ring array<double>")
    o = spark.createDataFrame([("a", ring(-1.0, -1.0, 11.0, 11.0)), ("b", ring(4.0, -5.0, 6.0, 15.0)), ("z", ring(0.0, 0.0, 1.0, 1.0))], "scope string, ring array<double>")
    f = O.free_regions(d, o)
    assert {r.scope: (r.obstacle_area, r.outside_area, r.free_area, r.parts, r.blocked) for r in f.collect()} == {"a": (100.0, 44.0, 0.0, 0, True), "b": (20.0, 20.0, 80.0, 2, False), "c": (0.0, 0.0, 100.0, 1, False)}
    assert O.not_all_blocked(f).count() == 3
    with pytest.raises(Exception, match="every scope is blocked"):
        O.not_all_blocked(f.where("scope = 'a'")).select("scope").collect()
    joined = O.effective_free(f.where("scope = 'b'"), spark.createDataFrame([("b", ring(3.0, 4.0, 7.0, 5.0))], "scope string, ring array<double>")).first()
    assert (joined.area, joined.parts_before, joined.parts) == (82.0, 2, 1)
    edges = spark.createDataFrame([("b", 1, [1.0, 1.0, 3.0, 9.0]), ("b", 2, [1.0, 1.0, 9.0, 1.0]), ("a", 3, [1.0, 1.0, 2.0, 2.0]), ("b", 4, [4.0, 0.0, 4.0, 10.0])], "scope string, edge long, path array<double>")
    assert {r.edge: r.valid for r in O.certified_edges(edges, f).collect()} == {1: True, 2: False, 3: False, 4: True}


@pytest.mark.parametrize(("group", "verified", "how", "scope"), [("C001", True, "manual_verified", "F1__CONN_C001"), ("C001", False, "manual_verified", "F1__B01"), ("C001", True, "shared_free_boundary_vector_clearance", "F1__B01"), (None, True, "manual_verified", "F1__B01"), ("C 1/x", True, " CAD_portal_verified ", "F1__CONN_C_1_x")])
def test_scopes_of_buildings(spark, group, verified, how, scope):
    c = O.building_scope(F.lit("F1"), F.lit("B01"), F.lit(group).cast("string"), F.lit(verified), F.lit(how))
    assert spark.range(1).select(c.alias("v")).first().v == scope
    assert spark.range(1).select(O.building_scope(F.lit("F1"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(None).cast("string")).alias("v")).first().v == "F1__B00"


def test_unvalidated_buildings_are_isolated_all_the_same(spark):
    regions = spark.createDataFrame([("S1", "F6", "R01", "title_block", 0.5, ring(0.0, 0.0, 20.0, 10.0)), ("S1", "F6", "R02", "sheet_bbox", 0.5, ring(0.0, 0.0, 20.0, 10.0)), ("S2", "F7", "R01", "x", 0.5, ring(0.0, 0.0, 20.0, 10.0))], "sheet string, floor string, region string, source string, confidence double, ring array<double>")
    rows = [("S1", "R01", "B01", ring(0.0, 0.0, 10.0, 10.0), "F6__B01", "ok", "vision_candidate_only", None), ("S1", "R01", "B02", ring(10.0, 0.0, 30.0, 10.0), "F6__B02", "ok", "vision_candidate_only", 0.8), ("S1", "R01", "B03", ring(50.0, 0.0, 60.0, 10.0), "F6__B03", "ok", "x", 0.8), ("S2", "R01", "B01", ring(0.0, 0.0, 10.0, 10.0), "F7__B01", "error", "x", 0.8)]
    b = spark.createDataFrame(rows, "sheet string, region string, building string, ring array<double>, scope string, status string, validation string, confidence double")
    got = {r.scope: (r.region, r.isolation_only, r.area, r.confidence) for r in O.scope_regions(regions, b).collect()}
    assert got == {"F6__B01": ("R01__B01", True, 100.0, 0.5), "F6__B02": ("R01__B02", True, 100.0, 0.8), "F7": ("R01", False, 200.0, 0.5)}


SCOPES = "floor string, scope string, buildings array<string>, groups array<string>, rings array<array<double>>, x0 double, y0 double, x1 double, y1 double"


def test_a_shared_boundary_alone_joins_nothing(spark):
    rows = lambda groups, wall: [("F2", "F2__B01", ["B01"], groups, [ring(0.0, 0.0, 10.0, 10.0)], 0.0, 0.0, 10.0, 10.0), ("F2", "F2__B02", ["B02"], groups, [ring(10.0 + wall, 0.0, 20.0, 10.0)], 10.0, 0.0, 20.0, 10.0)]
    def merged(groups, wall=0.0):
        s = spark.createDataFrame(rows(groups, wall), SCOPES)
        return {r.scope: r.merged for r in O.merged_scopes(s, O.corridor_links(s)).collect()}

    assert merged([]) == {"F2__B01": "F2__B01", "F2__B02": "F2__B02"}
    assert merged(["C001"]) == {"F2__B01": "F2__CONN_AUTO_C001", "F2__B02": "F2__CONN_AUTO_C001"}
    assert merged(["C001"], 0.5) == {"F2__B01": "F2__B01", "F2__B02": "F2__B02"}  # a wall stands between


def test_outer_walls_close_over_a_gap(spark):
    wall = [(x, y) for x in range(10, 91) for y in (10, 90)] + [(90, y) for y in range(10, 91)] + [(10, y) for y in range(10, 91) if y < 41 or y > 60]
    b = spark.createDataFrame([("F4__B01", "F4", ring(0.0, 0.0, 100.0, 100.0)), ("F2__B01", "F2", ring(0.0, 0.0, 100.0, 100.0))], "scope string, floor string, ring array<double>")
    w = spark.createDataFrame([(s, x, y) for s in ("F4__B01", "F2__B01") for x, y in wall], "scope string, cx int, cy int")
    row = O.closed_envelopes(b, w, 1.0).collect()
    assert [(r.scope, r.snapped) for r in row] == [("F4__B01", 4)]
    closed = region(row[0].rings)
    assert P.covers(closed, [[10, 50], [0, 50], [50, 50], [90, 90]]).tolist() == [True, False, False, True]


def test_walls_without_evidence_stay(spark):
    b = spark.createDataFrame([("F4__B01", "F4", ring(0.0, 0.0, 100.0, 10.0))], "scope string, floor string, ring array<double>")
    row = O.closed_envelopes(b, spark.createDataFrame([], "scope string, cx int, cy int"), 0.05).first()
    assert (row.snapped, row.inferred, row.fallback) == (0, 0, 4)
    assert P.covers(region(row.rings), [[0.01, 5.0], [50.0, 5.0]]).tolist() == [True, False]


@pytest.mark.parametrize(("floor", "high"), [("F3", True), ("F2", False), ("F12", True), ("屋面", True), ("RF", True), (None, False), ("B3", False)])
def test_floors_with_envelopes(spark, floor, high):
    assert spark.range(1).select(O.third_floor_or_above(F.lit(floor).cast("string")).alias("v")).first().v is high


def test_targets_go_to_their_component(spark):
    c = spark.createDataFrame([("F1", "b", [ring(0.0, 0.0, 10.0, 10.0)]), ("F1", "a", [ring(5.0, 0.0, 20.0, 10.0)])], "scope string, component string, rings array<array<double>>")
    t = spark.createDataFrame([("F1", 1, 7.0, 5.0), ("F1", 2, 2.0, 5.0), ("F1", 3, 25.0, 5.0), ("F2", 4, 1.0, 1.0)], "scope string, target long, x double, y double")
    got = {r.target: (r.component, r.status, r.x, r.distance) for r in O.component_assignment(t, c).collect()}
    assert got == {1: ("a", "inside_free_space", 7.0, 0.0), 2: ("b", "inside_free_space", 2.0, 0.0), 3: ("a", "projected_to_free_space", 20.0, 5.0), 4: ("", "missing_floor", 1.0, 0.0)}


BENT = [0.0, 0.0, 9.7, 0.3, 10.1, 9.9, 5.0, 7.0, 0.1, 10.3]
#: Many corners, so that lengths and areas within are sums of many parts.
ROUND = [v for t in np.arange(0, 2 * np.pi, 0.03).tolist() for v in (4 + 20 * float(np.cos(t)), 4 + 20 * float(np.sin(t)))]


def test_equal_lengths_go_to_the_surer_floor(spark):
    rng = np.random.default_rng(3)
    f = spark.createDataFrame([("d", "a", [ROUND], 0.1), ("d", "b", [BENT], 0.9), ("d", "c", [ring(50.0, 0.0, 51.0, 1.0)], 0.9)], "drawing string, floor string, rings array<array<double>>, confidence double")
    rows = [("d", k, "", *map(float, p)) for k, p in enumerate(rng.uniform(1, 6, (60, 4)).round(3))] + [("d", 98, "c", 1.0, 1.0, 2.0, 2.0), ("d", 99, "", 49.0, 0.0, 49.5, 9.0), ("e", 100, "", 0.0, 0.0, 1.0, 1.0)]
    got = {r.segment: r.owner for r in O.segment_owners(spark.createDataFrame(rows, "drawing string, segment long, declared string, ax double, ay double, bx double, by double"), f).collect()}
    assert got == {k: "b" for k in range(60)} | {98: "c", 99: "c", 100: None}


def test_segments_at_once_and_one_by_one():
    rng, r = np.random.default_rng(4), region([BENT, [2.0, 2.0, 2.0, 4.0, 4.0, 4.0, 4.0, 2.0]])
    a, b = rng.integers(-2, 13, (2, 200, 2)).astype(float)
    assert P.covered_lengths(a, b, r) == pytest.approx([P.covered_length(np.array(x), r) for x in zip(a, b, strict=True)], abs=1e-9)
    assert P.segment_distances(a, b, r) == pytest.approx([P.segment_distance(*x, r) for x in zip(a, b, strict=True)], abs=1e-9)


def test_a_floor_is_dealt_over_several_tasks(spark):
    left = spark.createDataFrame([(f, k) for f in "ab" for k in range(20)] + [(None, 99)], "f string, k long")
    right = spark.createDataFrame([("a", k) for k in range(10)], "f string, n long")
    run = lambda key, x, y: pd.DataFrame([(key[0], int(k), len(x), int(y["n"].sum())) for k in x["k"]], columns=["f", "k", "rows", "sum"])
    got = in_blocks(left, right, "f", "k", run, "f string, k long, rows int, sum long", 50).collect()
    assert sorted((str(r.f), r.k, r.sum) for r in got) == sorted([("a", k, 45) for k in range(20)] + [("b", k, 0) for k in range(20)] + [("None", 99, 0)])
    assert max(r.rows for r in got if r.f == "a") < 20


def test_halos_of_bent_regions(spark):
    rng, rings = np.random.default_rng(5), {"x": [BENT], "y": [ring(20.0, 0.0, 22.0, 2.0)]}
    ends = rng.uniform(-5, 25, (80, 4))
    s = spark.createDataFrame([("f", k, *map(float, p)) for k, p in enumerate(ends)], "floor string, segment long, ax double, ay double, bx double, by double")
    got = {(r.region, r.segment) for r in O.halo_members(s, spark.createDataFrame([("f", n, r) for n, r in rings.items()], "floor string, region string, rings array<array<double>>")).collect()}
    assert got == {(n, k) for n, r in rings.items() for k, p in enumerate(ends) if P.segment_distance(p[:2], p[2:], region(r)) <= 0.75 * np.hypot(*(p[2:] - p[:2])) + 1e-9} and len(got) > 20


def test_equal_overlaps_go_to_the_surer_region(spark):
    r = spark.createDataFrame([("f", "a", [ROUND], 0.1), ("f", "b", [BENT], 0.9), ("f", "c", [ring(50.0, 0.0, 60.0, 9.0)], 0.5)], "floor string, region string, rings array<array<double>>, confidence double")
    at = np.random.default_rng(6).uniform(1, 5, (40, 2)).round(3)
    rows = [("f", k, ring(x, y, x + 0.7, y + 0.9), ring(x, y, x + 1.0, y + 1.0)) for k, (x, y) in enumerate(at.tolist())]
    rows += [("f", 90, ring(48.0, 0.0, 49.0, 1.0), ring(48.0, 0.0, 51.0, 1.0)), ("f", 91, [0.0, 0.0], [0.0, 0.0]), ("g", 92, ring(0.0, 0.0, 1.0, 1.0), ring(0.0, 0.0, 1.0, 1.0))]
    got = {x.pair: (x.routing, x.owner, x.outputs) for x in O.pair_owners(spark.createDataFrame(rows, "floor string, pair long, core array<double>, full array<double>"), r).collect()}
    assert got == {k: ("core", "b", ["a", "b"]) for k in range(40)} | {90: ("topology_only", "c", ["c"]), 91: ("halo_ghost", "", []), 92: ("halo_ghost", "", [])}


def test_blocked_scopes_have_a_boundary_of_no_length(spark):
    rows = [("F2", f"F2__B0{k}", [f"B0{k}"], ["C001"], rings, 10.0 * k, 0.0, 10.0 * k + 10, 10.0) for k, rings in ((1, [ring(10.0, 0.0, 20.0, 10.0)]), (2, []), (3, []))]
    got = O.corridor_links(spark.createDataFrame(rows, SCOPES)).collect()
    assert sorted((r.left_scope, r.right_scope, r.open_length, r.least, r.linked) for r in got) == [(f"F2__B0{a}", f"F2__B0{b}", 0.0, 1.0, False) for a, b in ((1, 2), (1, 3), (2, 3))]


def test_level_and_sloping_edges_cross():
    a, b = [P.box_ring(0.0, 0.0, 4.0, 4.0)], [P.ring_of([2.0, -1.0, 6.0, 2.0, 2.0, 5.0, -2.0, 2.0])]
    assert {round(float(x), 9) for x in P.crossings(P.segments([*a, *b]))} >= {round(2 / 3, 9), round(10 / 3, 9)}
    assert P.area(P.intersection(a, b)) == pytest.approx(16 - 4 * (2 / 3 * 0.5 / 2))
    assert not len(P.crossings(P.segments([P.box_ring(0.0, 0.0, 4.0, 4.0), P.box_ring(1.0, 1.0, 6.0, 3.0)])))  # at ends' x alone
