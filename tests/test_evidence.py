"""Doors, stairs, noise and decisions by small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import evidence as E
from gridloom.operators import inventory as I


def one(spark, expression, **columns):
    return spark.range(1).select(expression(**{k: F.lit(v).cast("string") if v is None or isinstance(v, str) else F.lit(v) for k, v in columns.items()}).alias("v")).first().v


@pytest.mark.parametrize(("term", "layer", "block", "door"), [("FM乙12", "DOOR_FIRE_TEXT", "", True), ("防火门", "", "", True), ("M1021", "DOOR_FIRE", "", True), ("M1021", "A-WALL", "", False), ("安全出口", "DOOR_FIRE", "", False), ("AQCK", "DOOR_FIRE", None, False), ("FGM甲1-2", None, None, True), (None, None, None, False)])
def test_fire_doors(spark, term, layer, block, door):
    assert one(spark, E.fire_door, term=term, layer=layer, block=block) is door


@pytest.mark.parametrize(("term", "floor", "role", "reason"), [
    ("专业疏散楼梯间", "F3", "inspection_object", "closed_set_classification"), ("专业疏散楼梯间", "F1", "IGNORE", "stair_below_second_floor_not_safety_exit"), ("FM乙12", "F3", "IGNORE", "fire_door_not_safety_exit"),
])
def test_a_model_cannot_make_exits(spark, term, floor, role, reason):
    t, none = F.lit(term), F.lit("")
    m = E.settled_decision(F.lit("inspection_object"), F.lit("安全出口"), F.lit(0.95), F.lit("安全出口"), F.lit(1.0), E.fire_door(t, F.lit("DOOR_FIRE_TEXT"), none), E.stair(t, none, none), S.is_upper_floor(F.lit(floor)))
    got = spark.range(1).select(m.alias("m")).first().m
    assert (got.role, got.reason) == (role, reason)
    assert got.confidence == (0.965 if role == "inspection_object" else 1.0)


def test_decisions_are_held_within_bounds(spark):
    no = F.lit(False)
    settle = lambda role, p, score: spark.range(1).select(E.settled_decision(F.lit(role), F.lit("x"), F.lit(p), F.lit("x"), F.lit(score), no, no, no).alias("m")).first().m
    assert settle("other", 0.9, 1.0).confidence == 0.5 and settle(None, 0.3, 1.0).role == "IGNORE"
    assert settle("inspection_object", 0.1, 0.1).confidence == 0.6 and settle("inspection_object", None, 1.0).confidence == 0.6


@pytest.mark.parametrize(("values", "matched"), [(("楼梯间", "", "F2"), True), (("楼梯间", "", "F1"), False), (("x", "A-STRS", "F3"), True), (("x", "HS-A-楼梯", "3层"), True), (("STAIR", "", "B1"), False), (("x", "y", "F9"), False)])
def test_upper_aliases(spark, values, matched):
    aliases = spark.createDataFrame([("安全出口", "楼梯"), ("安全出口", "STRS"), ("安全出口", "STAIR"), ("安全出口", "楼梯间")], "class string, alias string")
    out = E.best_upper_alias(spark.createDataFrame([(1, *values)], "id int, term string, layer string, floor string"), aliases, "id", ["term", "layer"], ["floor"]).collect()
    assert [r["class"] for r in out] == ["安全出口"] * matched
    if values[0] == "楼梯间" and matched:
        assert out[0].alias == "楼梯间"  # the longest


NOISE = [
    (None, "text", "TEXT", None, "empty_term"), ("机房", "text", "TEXT", "", "generic_standalone_object_term"), ("疏散宽度", "text", "TEXT", "", "explanatory_text"), ("井", "text", "TEXT", "", None), ("X", "text", "TEXT", "", "single_character"),
    ("12.5", "layer", "LINE", "", "layer_code_only"), ("12.5", "text", "TEXT", "", "dimension_or_number"), ("100 mm", "text", "TEXT", "", "measurement_or_floor_range"), ("3F~5F", "text", "TEXT", "", "measurement_or_floor_range"), ("B1-B2", "block", "INSERT", "", "floor_code_only"),
    ("甲乙丙", "text", "TEXT", "图框A1", "title_block_text"), ("甲乙丙", "text", "TEXT", "剖面", "drawing_block_noise"), ("HVAC", "text", "TEXT", "", "discipline_title_text"), ("某平面图", "text", "TEXT", "", "drawing_note_or_title"), ("甲" * 49, "text", "TEXT", "", "long_explanatory_text"),
    ("M-12", "text", "DIMENSION", "", None), ("XF12", "text", "DIMENSION", "", "annotation_entity"), ("A", "block", "INSERT", "TITLE", "single_character"), ("AB", "block", "INSERT", "SHEET", "title_block_insert"), ("AXIS1", "block", "INSERT", "", "drawing_symbol_block"),
    ("配电间", "text", "TEXT", "", None), ("消防平面图", "text", "TEXT", "", "discipline_title_text"), ("消防控制图例", "text", "TEXT", "", "explanatory_text"),
]


def test_candidate_noise(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(NOISE)], "i int, term string, source string, kind string, block string, want string")
    got = df.withColumn("got", E.candidate_noise(*map(F.col, ("term", "source", "kind", "block")), F.lit(False))).orderBy("i").collect()
    assert [(r.term, r.got) for r in got] == [(r.term, r.want) for r in got]
    kept = df.where("term in ('12.5', 'HVAC') and source = 'text'").select(E.candidate_noise(*map(F.col, ("term", "source", "kind", "block")), F.lit(True)).alias("v")).collect()
    assert [r.v for r in kept] == [None, None]


def test_classifier_keeps_codes(spark):
    noise = lambda t, s="text": one(spark, lambda **c: E.classifier_noise(c["t"], c["s"], F.lit("TEXT"), F.lit("text"), F.lit(False)), t=t, s=s)
    assert [noise(t) for t in ("FJ12", "12-5", "A", "房间", "图例表", None, "水泵")] == [None, "plain_number_or_code", "plain_number_or_code", "generic_standalone_object_term", "noise_term", "empty_term", None]
    assert noise("x", "line") == "not_text_or_block_semantics"


def test_short_words(spark):
    said = lambda t, c="": one(spark, lambda **x: E.short_word(x["t"], x["c"]), t=t, c=c)
    assert [said("强 电")["class"], said("客梯", "ELEV")["class"], said("泵", "消防 泵房")["reason"], said("配电间", "配电间")["class"]] == ["强电间", "消防电梯", "short_pump_room_context", "配电房"]
    assert [said("机房", "配电"), said("楼梯", "消防"), said("门"), said(None)] == [None] * 4
    assert one(spark, lambda **x: E.short_room(x["t"], x["c"]), t="弱电", c="MTEXT") == "弱电间" and one(spark, lambda **x: E.short_room(x["t"], x["c"]), t="弱电", c="") is None


def test_rules_run_once_a_combination_and_keep_all_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, None)], "id int, p string, q string")
    out = E.by_distinct(df, ["p", "q"], {"r": F.coalesce("p", "q", F.lit("none"))}).orderBy("id").collect()
    assert [(r.id, r.r) for r in out] == [(1, "a"), (2, "a"), (3, "x"), (4, "none")]


def test_blocks_that_hold_each_other(spark):
    members = [("a", 1, "INSERT", "0", "", "b"), ("b", 2, "INSERT", "0", "", "a"), ("b", 3, "TEXT", "0", "t", None), ("c", 4, "LINE", "A-WALL", "", None), ("d", 5, "INSERT", "0", "", "c"), ("e", 6, "LINE", "0", "", None)]
    df = spark.createDataFrame(members, "block string, member int, entity_type string, layer string, text string, child string")
    got = {r.block: (r.has_recursive_semantics, r.has_recursive_geometry_semantics) for r in I.block_signatures(df).collect()}
    assert got == {"a": (True, False), "b": (True, False), "c": (False, True), "d": (False, True), "e": (False, False)}
    inserts = spark.createDataFrame([(9, "a")], "insert_id int, block string")
    assert sorted((r.depth, r.path, r.member) for r in I.placed_blocks(inserts, df, 3).collect()) == [(1, "a", 1), (2, "a/b", 2), (2, "a/b", 3), (3, "a/b/a", 1)]
    assert I.placed_blocks(inserts, df.limit(0), 2).count() == 0


def test_boxes_shown(spark):
    box = lambda *v: tuple(spark.range(1).select(I.annotation_box(*[F.lit(x).cast("double") for x in v]).alias("b")).first().b or ())
    assert box(0, 0, 1000, 1000, None, None) == (-180.0, -180.0, 1180.0, 1180.0)
    assert box(None, None, None, None, 0, 0) == (-480.0, -430.0, 480.0, 430.0)
    assert box(0, 0, 10_000, 100, None, None) == (-800.0, -930.0, 10_800.0, 1030.0)
    assert box(5, 0, 5, 9, None, None) == ()
