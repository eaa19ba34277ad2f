"""Order lines in the role of a drawing's entities: one row a line item, with type, layer, block, text and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import load

TYPES = [
    "TEXT", "MTEXT", "ATTRIB", "INSERT", "LINE", "XLINE", "RAY", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE", "ELLIPSE", "SPLINE", "HATCH", "SOLID", "REGION", "WIPEOUT", "DIMENSION", "LEADER", "MLEADER",
    "POINT", "OLE2FRAME",
]
LAYERS = ["0", "A-WALL", "墙体", "S-COLU", "DOOR_FIRE", "A-STRS", "PUB_TEXT", "WINDOW", "TK_LABEL", "AXIS", "E-强电", "HS-A-楼梯", "", "留洞", "PUMP-ROOM"]
BLOCKS = ["", "STAIR-01", "图框A1", "FM-DOOR", "配电箱", "PUMP", "窗C1", "标注块", "风机", "(建筑)"]
LINES = ["CONTINUOUS", "DASHED", "BYLAYER", "Center2", "虚线"]
FLOORS = ["F1", "F2", "B1", "2F", "地下二层", "屋顶层", "首层", "F7__B01", "3层", "", "EQUIPMENT", "十二层", "二楼", "UNKNOWN", "1F", "夹层 B1F"]
TERMS = [
    "", "强电", "弱电间", "消防水泵房", "水泵", "楼梯间", "安全出口", "FM乙12", "FM", "M1021", "JXM-12", "防火门甲", "AQCK", "1200x900", "12.5", "-3.500", "100 mm", "3F~5F", "B1-B2", "12F", "机房", "间",
    "井", "泵", "A", "详图", "疏散宽度 1.2", "消防电梯", "客梯", "电梯井", "说明：本工程", "配电间", "排烟机房", "报警阀", "图例", "给排水平面图", "HVAC PLAN", "XF-01", "SB12(A)", "卫生间", "消控", "阀", "楼 梯", "STAIR A",
    "一层平面图", "地下一层平面图", "二层消防平面图", "屋面排水平面图", "剖面图 1-1", "首层平面图（局部放大）", "注" + "意" * 50, "负二层平面图", "B2F 平面图", "标准层平面图",
]
SOURCES = ["direct_entity", "virtual_entity_in_insert", "insert_container", "insert_attrib"]

#: The entities' columns by rule: (list, the number that picks from it, in SQL's arithmetic).
PICKED = {
    "entity_type": (TYPES, "l_partkey % 22"),
    "layer": (LAYERS, "(l_suppkey + l_linenumber) % 15"),
    "parent_block_name": (BLOCKS, "(l_partkey + l_linenumber) % 10"),
    "raw_text": (TERMS, f"(l_orderkey * 7 + l_linenumber) % {len(TERMS)}"),
    "linetype": (LINES, "l_suppkey % 5"),
    "floor_id": (FLOORS, "l_orderkey % 16"),
    "source": (SOURCES, "l_partkey % 4"),
}
#: Corner, width and height of an entity; every 41st has none.
EXTENT = {"x0": "(l_partkey * 37 % 9973) * 20.0", "y0": "(l_suppkey * 91 + l_orderkey * 13) % 7919 * 15.0", "w": "l_quantity * (l_linenumber * l_linenumber * 10)", "h": "l_tax * 10000 + l_linenumber * 5"}


def picked(values: list[str], index: str) -> Column:
    return F.array(*map(F.lit, values))[F.expr(f"cast({index} as int)")]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, entity_type, layer, color, linetype, parent_block_name, raw_text, norm_text, floor_id, source, depth, handle,
    geometry_kind, is_closed (0 or 1), bbox_minx, bbox_miny, bbox_maxx, bbox_maxy (null together)."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    kind = {name: picked(*rule).alias(name) for name, rule in PICKED.items()}
    has_box = F.expr("(l_orderkey + l_linenumber) % 41 <> 0")
    at = {name: F.when(has_box, F.expr(rule).cast("double")) for name, rule in EXTENT.items()}
    base = l.select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("object_id"), *kind.values(), F.col("l_linenumber").alias("color"), F.expr("cast(l_partkey % 4 as int)").alias("depth"),
        F.concat(F.lit("H"), F.expr("cast(l_orderkey * 8 + l_linenumber as string)")).alias("handle"), (F.col("l_returnflag") == "R").alias("closed"),
        at["x0"].alias("bbox_minx"), at["y0"].alias("bbox_miny"), (at["x0"] + at["w"]).alias("bbox_maxx"), (at["y0"] + at["h"]).alias("bbox_maxy"),
    )
    texts = F.when(F.col("entity_type").isin("TEXT", "MTEXT", "ATTRIB"), F.col("raw_text")).otherwise("")
    return base.withColumn("raw_text", texts).select(
        *[c for c in base.columns if c != "closed"], S.drawing_text(F.col("raw_text")).alias("norm_text"), S.geometry_kind(F.col("entity_type"), F.col("closed")).alias("geometry_kind"),
        S.is_closed(F.col("entity_type"), F.col("closed")).alias("is_closed"),
    )


def _case(values: list[str], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({index} AS INT) + 1)"


def _entities_sql() -> str:
    columns = ", ".join(f"{_case(*rule)} AS {name}" for name, rule in PICKED.items())
    x0, y0, w, h = EXTENT.values()
    return f"""raw AS (SELECT l_orderkey * 8 + l_linenumber AS object_id, {columns}, l_linenumber AS color, CAST(l_partkey % 4 AS INT) AS depth, 'H' || (l_orderkey * 8 + l_linenumber) AS handle, l_returnflag = 'R' AS closed,
  (l_orderkey + l_linenumber) % 41 <> 0 AS has, CAST({x0} AS DOUBLE) AS x0, CAST({y0} AS DOUBLE) AS y0, CAST({w} AS DOUBLE) AS w, CAST({h} AS DOUBLE) AS h FROM lineitem),
entities AS (SELECT object_id, entity_type, layer, parent_block_name, linetype, floor_id, source, color, depth, handle,
  CASE WHEN entity_type IN ('TEXT', 'MTEXT', 'ATTRIB') THEN raw_text ELSE '' END AS raw_text, CASE WHEN entity_type IN ('TEXT', 'MTEXT', 'ATTRIB') THEN replace(raw_text, ' ', '') ELSE '' END AS norm_text,
  CASE WHEN entity_type IN ('TEXT', 'MTEXT', 'ATTRIB') THEN 'text' WHEN entity_type = 'INSERT' THEN 'block_insert' WHEN entity_type IN ('LINE', 'XLINE', 'RAY') THEN 'line'
    WHEN entity_type IN ('LWPOLYLINE', 'POLYLINE') THEN CASE WHEN closed THEN 'polyline_closed' ELSE 'polyline_open' END WHEN entity_type IN ('ARC', 'CIRCLE', 'ELLIPSE') THEN 'curve' WHEN entity_type = 'SPLINE' THEN 'spline_curve'
    WHEN entity_type = 'HATCH' THEN 'hatch_area' WHEN entity_type IN ('SOLID', 'REGION', 'WIPEOUT') THEN 'area_entity' WHEN entity_type IN ('DIMENSION', 'LEADER', 'MLEADER') THEN 'annotation_dimension'
    WHEN entity_type = 'POINT' THEN 'point' ELSE 'other' END AS geometry_kind,
  CAST(entity_type IN ('LWPOLYLINE', 'POLYLINE') AND closed OR entity_type IN ('HATCH', 'CIRCLE', 'ELLIPSE', 'REGION') AS INT) AS is_closed,
  CASE WHEN has THEN x0 END AS bbox_minx, CASE WHEN has THEN y0 END AS bbox_miny, CASE WHEN has THEN x0 + w END AS bbox_maxx, CASE WHEN has THEN y0 + h END AS bbox_maxy FROM raw)"""


ENTITIES_SQL = _entities_sql()
