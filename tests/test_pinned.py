"""Small cases that pin the semantics of whole steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions import scalars as S
from gridloom.operators import aggregates, cascades, clusters, graph, lookups, planning, pools, selection, spatial


def test_stairs_count_on_upper_floors_alone(spark):
    rows = [(f, k * 10 + i, 100.0 * i, 0.0, 100.0 * i + 60, 200.0) for k, f in enumerate(("F2", "F1")) for i in range(6)]
    df = spark.createDataFrame(rows, "name string, id long, x0 double, y0 double, x1 double, y1 double")
    b = df.where(S.is_upper_floor(F.col("name"))).select(F.lit(2).alias("floor"), "id", B.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
    out = clusters.box_clusters(b, 30.0, 500.0, 5).collect()
    assert [(r.floor, r.cluster, r.members, r.b.x1) for r in out] == [(2, 0, 6, 560.0)]


def test_regions_contain_by_smallest_area(spark):
    points = spark.createDataFrame([(1, 1, 1.0, 1.0), (1, 2, 5.0, 5.0), (1, 3, 50.0, 50.0), (2, 4, 1.0, 1.0)], "floor int, target_id long, x double, y double")
    regions = spark.createDataFrame([(1, 10, 0.0, 0.0, 9.0, 9.0), (1, 11, 0.0, 0.0, 2.0, 2.0)], "floor int, region_id long, x0 double, y0 double, x1 double, y1 double")
    regions = regions.select("floor", "region_id", B.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
    assert {r.target_id: (r.region_id, r.n_covering) for r in spatial.smallest_region(points, regions, 3.0).collect()} == {1: (11, 2), 2: (10, 1)}


def test_second_component_begins_virtually(spark):
    order = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 2), (1, 3, "c", 1)], "route int, place int, target string, component int")
    out = planning.component_segments(order).orderBy("place").collect()
    assert [(r.target, r.segment, r.virtual_start) for r in out] == [("a", 1, False), ("c", 1, False), ("b", 2, True)]


def test_quotas_are_held_to_the_pool(spark):
    pool = spark.createDataFrame([("x", i, float(i)) for i in range(2)] + [("y", i, float(i)) for i in range(3)], "g string, item int, score double")
    rules = spark.createDataFrame([("x", False, 5), ("y", True, 1), ("z", False, 1)], "g string, mandatory boolean, quota int")
    chosen = selection.quota_selection(pool, rules, "g", "item", "score")
    audit = {r.g: (r.required, r.shortfall, r.exact, r.enough) for r in selection.requirement_audit(pool, chosen, rules, "g").collect()}
    assert audit == {"x": (2, 3, True, True), "y": (3, 0, True, True), "z": (0, 1, True, True)}


def test_equal_values_scale_to_a_half(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 0.0), (2, 4.0), (2, 1.0)], "g int, v double")
    assert sorted(r.s for r in aggregates.min_max(df, "g", "v", "s").collect()) == [0.0, 0.25, 0.5, 0.5, 1.0]


def test_wide_outliers_are_rejected(spark):
    df = spark.createDataFrame([(1, v) for v in (10.0, 11.0, 9.0, 10.0, 100.0)] + [(2, 1.0), (2, 1.0), (2, 5.0)], "g int, v double")
    out = {(r.g, r.v): (r.rejected, r.supported) for r in aggregates.robust_gate(df, "g", "v").collect()}
    assert out[1, 100.0] == (True, False) and out[1, 10.0] == (False, True) and out[2, 5.0] == (True, False) and out[2, 1.0] == (False, False)


def test_parallel_edges_and_crossings(spark):
    e = spark.createDataFrame([(1, 1, 2, 1, 5.0), (1, 1, 1, 2, 3.0), (1, 2, 1, 2, 1.0), (1, 1, 3, 4, float("inf")), (1, 1, 3, 4, -1.0), (1, 1, 3, 4, None)], "floor int, other_floor int, a long, b long, w double")
    assert [tuple(r) for r in graph.simple_edges(e).collect()] == [(1, 1, 2, 3.0)]


def test_names_before_classes(spark):
    items = spark.createDataFrame([(1, 1, "fire door", "door"), (1, 2, "door", "door"), (2, 3, "door", "door")], "floor int, item long, raw_name string, class string")
    wanted = spark.createDataFrame([("door", "fire door")], "class string, raw string")
    assert {(r.floor, r.item) for r in pools.candidate_pools(items, wanted).collect()} == {(1, 1), (2, 3)}


def test_identity_falls_back_to_unique_objects(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (3, "c")], "floor int, object_id string")
    nodes = spark.createDataFrame([(1, "a", 10, False), (1, "a", 11, True), (5, "b", 12, False)], "floor int, object_id string, node_id long, has_access boolean")
    assert {(r.floor, r.object_id): (r.node_id, r.matched) for r in lookups.merged_identity(rows, nodes).collect()} == {(1, "a"): (11, "floor"), (2, "a"): (None, "none"), (3, "b"): (12, "unique"), (3, "c"): (None, "none")}


def test_counters_break_ties_by_value(spark):
    df = spark.createDataFrame([("k", v) for v in ("b", "a", "c", "c", "", None)], "key string, item string")
    assert [r.counter for r in aggregates.top_counter(df, "key", "item", 2).collect()] == ["c:2,a:1"]


def test_percentages(spark):
    df = spark.createDataFrame([(1, 8), (1, 0), (1, 800)], "a int, b int")
    assert [r.p for r in df.select(aggregates.percent(F.col("a"), F.col("b")).alias("p")).collect()] == [12.5, 0.0, 0.12]


@pytest.mark.parametrize(("text", "reason"), [("", "empty"), ("x", "single_character"), ("3.5", "measurement"), ("B2", "floor_code"), ("Note: this", "title_block"), ("pump", "kept"), (None, "empty")])
def test_noise(spark, text, reason):
    assert cascades.noise_reasons(spark.createDataFrame([(text,)], "t string"), "t").first().reason == reason


def test_suppression_keeps_the_best_of_a_class(spark):
    rows = [(1, "a", 1, 0.5, 0.0, 0.0, 2.0, 2.0), (1, "a", 2, 0.9, 0.1, 0.1, 2.1, 2.1), (1, "a", 3, 0.1, 9.0, 9.0, 10.0, 10.0), (1, "b", 4, 0.1, 0.1, 0.1, 2.1, 2.1), (1, "b", 5, 0.1, 0.1, 0.1, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "floor int, class string, id long, score double, x0 double, y0 double, x1 double, y1 double")
    assert {r.id for r in selection.suppress(df, ["floor", "class"], 0.55, 0.01).collect()} == {2, 3, 5}
    points = lambda *v: spark.range(1).select(selection.annotation_priority(*[F.lit(x) for x in v]).alias("p")).first().p
    assert [points("INSERT", "", "direct_entity", True), points("MTEXT", "", "virtual_entity_in_insert", False), points("X", "block_insert", "insert_container", False), points("X", "text", "", False)] == [340, 190, 320, 200]
