"""Queries over a drawing's entities: inventories, catalogs, evidence and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..operators import inventory as I
from ..sources import drawing as D
from ..sources import tables as T


def inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    r = I.inventory_rows(D.entities(spark, d))
    return r.withColumns({c: F.array_join(c, "/") for c in ("block_path", "insert_path")})


INVENTORY_ROWS = f"""
WITH {D.ENTITIES_SQL} SELECT printf('CADOBJ_%07d', object_id) AS object_id, 'Model' AS layout, source, depth, depth AS insert_depth, entity_type, handle, layer, color, '' AS true_color, linetype, '' AS lineweight, parent_block_name, '' AS block_path, '' AS insert_path, raw_text, norm_text,
  geometry_kind, is_closed, (bbox_minx + bbox_maxx) / 2 AS x, (bbox_miny + bbox_maxy) / 2 AS y, bbox_minx, bbox_miny, bbox_maxx, bbox_maxy, (bbox_maxx - bbox_minx) * (bbox_maxy - bbox_miny) AS bbox_area FROM entities"""


def catalog_signatures(spark: SparkSession, d: str) -> DataFrame:
    return I.catalog(D.entities(spark, d))


def sample_sql(keys: str, item: str, order: str, most: int, name: str, where: str = "true") -> str:
    return f"""(SELECT {keys}, string_agg(v, '|' ORDER BY k) AS {name} FROM (SELECT {keys}, CAST({item} AS VARCHAR) AS v, row_number() OVER (PARTITION BY {keys} ORDER BY min({order}), {item}) AS k FROM e
  WHERE CAST({item} AS VARCHAR) <> '' AND {where} GROUP BY {keys}, {item}) WHERE k <= {most} GROUP BY {keys})"""


EXTENT_SQL = "min(bbox_minx) AS bbox_minx, min(bbox_miny) AS bbox_miny, max(bbox_maxx) AS bbox_maxx, max(bbox_maxy) AS bbox_maxy, greatest(0, max(bbox_maxx) - min(bbox_minx)) * greatest(0, max(bbox_maxy) - min(bbox_miny)) AS bbox_area"
KEYS = ", ".join(I.SIGNATURE)
CATALOG_SIGNATURES = f"""
WITH {D.ENTITIES_SQL}, e AS (SELECT *, CASE WHEN geometry_kind = 'text' THEN norm_text ELSE '' END AS text_key FROM entities),
g AS (SELECT {KEYS}, count(*) AS "count", min(depth) AS depth_min, max(depth) AS depth_max, CASE WHEN count(*) >= 100 THEN 3 WHEN count(*) >= 20 THEN 2 WHEN count(*) >= 5 THEN 1 ELSE 0 END
  + CASE WHEN geometry_kind = 'text' AND text_key <> '' THEN 3 ELSE 0 END + CASE WHEN layer NOT IN ('', '0') THEN 2 ELSE 0 END + CASE WHEN parent_block_name <> '' THEN 1 ELSE 0 END
  + CASE WHEN geometry_kind IN ('hatch_area', 'polyline_closed', 'block_insert') THEN 1 ELSE 0 END AS llm_review_priority, {EXTENT_SQL} FROM e GROUP BY {KEYS})
SELECT g.*, raw_text_sample, sample_object_ids, row_number() OVER (ORDER BY "count" DESC, {KEYS}) AS rank
FROM g LEFT JOIN {sample_sql(KEYS, 'raw_text', 'object_id', 5, 'raw_text_sample')} USING ({KEYS}) LEFT JOIN {sample_sql(KEYS, 'object_id', 'object_id', 8, 'sample_object_ids')} USING ({KEYS})"""


def text_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.text_summary(D.entities(spark, d))


def counter_sql(key: str, item: str, most: int, name: str, source: str = "e") -> str:
    return f"""(SELECT {key}, string_agg(v || ':' || n, ',' ORDER BY k) AS {name} FROM (SELECT {key}, {item} AS v, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {item}) AS k FROM {source} WHERE {item} <> '' GROUP BY 1, 2) WHERE k <= {most} GROUP BY 1)"""


TEXT_SUMMARY = f"""
WITH {D.ENTITIES_SQL}, e AS (SELECT * FROM entities WHERE norm_text <> ''), g AS (SELECT norm_text, count(*) AS "count", {EXTENT_SQL} FROM e GROUP BY 1)
SELECT * FROM g LEFT JOIN {counter_sql('norm_text', 'layer', 20, 'layer_counter')} USING (norm_text) LEFT JOIN {counter_sql('norm_text', 'parent_block_name', 20, 'block_counter')} USING (norm_text)
LEFT JOIN {counter_sql('norm_text', 'entity_type', 20, 'entity_type_counter')} USING (norm_text) LEFT JOIN {sample_sql('norm_text', 'object_id', 'object_id', 8, 'sample_object_ids')} USING (norm_text)"""


def layer_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.layer_summary(D.entities(spark, d))


LAYER_SUMMARY = f"""
WITH {D.ENTITIES_SQL}, e AS (SELECT *, substr(parent_block_name, 1, 80) AS b80, substr(norm_text, 1, 80) AS t80 FROM entities WHERE layer <> ''), g AS (SELECT layer, count(*) AS "count" FROM e GROUP BY 1)
SELECT * FROM g LEFT JOIN {counter_sql('layer', 'entity_type', 10, 'entity_types')} USING (layer) LEFT JOIN {counter_sql('layer', 'geometry_kind', 10, 'geometry_kinds')} USING (layer)
LEFT JOIN {counter_sql('layer', 'b80', 8, 'sample_blocks')} USING (layer) LEFT JOIN {counter_sql('layer', 't80', 8, 'sample_texts')} USING (layer)"""


def block_members(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' line items as members of blocks: block s holds an insert of block (3 s + 1) mod 100 where its type is INSERT."""
    e = D.entities(spark, d).select("object_id", "entity_type", "layer", "norm_text")
    l = T.load(spark, d, "lineitem").select(F.expr("l_orderkey * 8 + l_linenumber").alias("object_id"), "l_suppkey")  # noqa: E741
    child = F.when(F.col("entity_type") == "INSERT", F.concat(F.lit("BLK"), ((F.col("l_suppkey") * 3 + 1) % 100).cast("string")))
    kind = F.when((F.col("entity_type") == "MTEXT") & (F.col("l_suppkey") % 3 > 0) | F.col("entity_type").isin("TEXT", "ATTRIB"), "SOLID").otherwise(F.col("entity_type"))
    j = e.join(l, "object_id").where("object_id % 17 = 0 or entity_type = 'INSERT' and object_id % 5 = 0")
    return j.select(F.concat(F.lit("BLK"), F.col("l_suppkey").cast("string")).alias("block"), F.col("object_id").alias("member"), kind.alias("entity_type"), "layer", F.col("norm_text").alias("text"), child.alias("child"))


def block_signatures(spark: SparkSession, d: str) -> DataFrame:
    return I.block_signatures(block_members(spark, d))


MEMBERS_SQL = f"""{D.ENTITIES_SQL}, members AS (SELECT 'BLK' || l_suppkey AS block, object_id AS member, CASE WHEN entity_type = 'MTEXT' AND l_suppkey % 3 > 0 OR entity_type IN ('TEXT', 'ATTRIB') THEN 'SOLID' ELSE entity_type END AS entity_type, layer, norm_text AS text,
  CASE WHEN entity_type = 'INSERT' THEN 'BLK' || ((l_suppkey * 3 + 1) % 100) END AS child FROM entities JOIN (SELECT l_orderkey * 8 + l_linenumber AS object_id, l_suppkey FROM lineitem) USING (object_id) WHERE object_id % 17 = 0 OR entity_type = 'INSERT' AND object_id % 5 = 0)"""
MARKS = "regexp_matches(upper(replace({0}, ' ', '')), '" + "|".join(E.bare(E.STRUCTURAL)) + "')"
TYPES_SQL = "('" + "', '".join(E.STRUCTURAL_TYPES) + "')"
BLOCK_SIGNATURES = f"""
WITH RECURSIVE {MEMBERS_SQL}, g AS (SELECT block, count(*) AS entity_count, max(entity_type IN ('TEXT', 'MTEXT', 'ATTDEF')) AS has_direct_semantics,
  max(entity_type IN {TYPES_SQL} AND ({MARKS.format('layer')} OR {MARKS.format('block')})) AS has_direct_geometry_semantics, coalesce(array_to_string(list_sort(list(DISTINCT child) FILTER (entity_type = 'INSERT')), ','), '') AS child_blocks FROM members GROUP BY 1),
c AS (SELECT DISTINCT block, child FROM members WHERE child IS NOT NULL),
r AS (SELECT block FROM g WHERE has_direct_semantics UNION SELECT c.block FROM c JOIN r ON c.child = r.block), q AS (SELECT block FROM g WHERE has_direct_geometry_semantics UNION SELECT c.block FROM c JOIN q ON c.child = q.block),
e AS (SELECT * FROM members), s AS (SELECT g.*, g.block IN (SELECT block FROM r) AS has_recursive_semantics, g.block IN (SELECT block FROM q) AS has_recursive_geometry_semantics, t.text_samples FROM g LEFT JOIN {sample_sql('block', 'text', 'member', 24, 'text_samples')} t ON t.block = g.block)
SELECT *, sha256(block || '|' || entity_count || '|' || child_blocks || '|' || coalesce(text_samples, '') || '|' || has_direct_semantics || '|' || has_recursive_semantics || '|' || has_direct_geometry_semantics || '|' || has_recursive_geometry_semantics) AS signature_hash FROM s"""


def expanded_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The recursive scan of the inserts of five blocks, three levels deep, counted by block, level and type."""
    members = block_members(spark, d)
    inserts = members.where("block in ('BLK1', 'BLK7', 'BLK22', 'BLK40', 'BLK99') and child is not null").select(F.col("member").alias("insert_id"), F.col("child").alias("block"))
    return I.placed_blocks(inserts, members, 3).groupBy("block", "depth", "path", "entity_type").agg(F.count("*").alias("n"))


EXPANDED_BLOCKS = f"""
WITH RECURSIVE {MEMBERS_SQL}, w AS (SELECT member AS insert_id, child AS block, 0 AS depth, child AS path, CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS child, CAST(NULL AS VARCHAR) AS home FROM members WHERE block IN ('BLK1', 'BLK7', 'BLK22', 'BLK40', 'BLK99') AND child IS NOT NULL
  UNION ALL SELECT w.insert_id, m.child, w.depth + 1, CASE WHEN m.entity_type = 'INSERT' THEN w.path || '/' || m.child ELSE w.path END, m.entity_type, m.child, w.block FROM w JOIN members m ON m.block = w.block WHERE w.depth < 3)
SELECT home AS block, depth, CASE WHEN entity_type = 'INSERT' THEN left(path, length(path) - length(child) - 1) ELSE path END AS path, entity_type, count(*) AS n FROM w WHERE depth > 0 GROUP BY 1, 2, 3, 4"""


def scanned_inserts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a scan into the inserts of five blocks, two levels deep, each insert with an attribute; counted."""
    members = block_members(spark, d).withColumn("handle", F.col("member").cast("string"))
    inserts = members.where("block in ('BLK1', 'BLK7', 'BLK22', 'BLK40', 'BLK99') and child is not null").select(F.lit("Model").alias("layout"), F.col("member").alias("insert_id"), "handle", F.col("child").alias("block"), "layer")
    attributes = members.where("entity_type = 'INSERT' and child is not null").select(F.col("member").alias("owner"), F.col("member").alias("attribute"), F.lit("A").alias("layer"), F.lit("no").alias("text")).distinct()
    rows = I.expanded(inserts, members.where("entity_type <> 'INSERT' or child is not null"), attributes, None, 2)
    return rows.groupBy("source", "depth", "entity_type", "parent_block_name", F.size("block_path").alias("blocks"), F.size("insert_path").alias("inserts")).agg(F.count("*").alias("n"))


SCANNED_INSERTS = f"""
WITH RECURSIVE {MEMBERS_SQL}, w AS (SELECT child AS block, 0 AS depth, 'INSERT' AS entity_type, CAST(NULL AS VARCHAR) AS home FROM members WHERE block IN ('BLK1', 'BLK7', 'BLK22', 'BLK40', 'BLK99') AND child IS NOT NULL
  UNION ALL SELECT m.child, w.depth + 1, m.entity_type, w.block FROM w JOIN members m ON m.block = w.block WHERE w.entity_type = 'INSERT' AND w.depth < 2 AND (m.entity_type <> 'INSERT' OR m.child IS NOT NULL))
SELECT source, depth, entity_type, parent_block_name, blocks, blocks AS inserts, count(*) AS n FROM (
  SELECT 'insert_container' AS source, depth, 'INSERT' AS entity_type, block AS parent_block_name, depth + 1 AS blocks FROM w WHERE entity_type = 'INSERT'
  UNION ALL SELECT 'insert_attrib', depth + 1, 'ATTRIB', block, depth + 1 FROM w WHERE entity_type = 'INSERT'
  UNION ALL SELECT 'virtual_entity_in_insert', depth, entity_type, home, depth FROM w WHERE entity_type <> 'INSERT') GROUP BY ALL"""


def geometry_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of six kinds from the embeddings' first components: counts, lengths and areas."""
    c = T.component
    kind = F.array(*map(F.lit, ("LINE", "LWPOLYLINE", "POLYLINE", "CIRCLE", "ARC", "TEXT")))[(F.col("vec_id") % 6).cast("int")]
    at = lambda a, b: F.array(c(a), c(b))
    points = F.when(F.col("vec_id") % 6 == 0, F.array(at(0, 1), at(2, 3))).otherwise(F.array(at(0, 1), at(2, 3), at(4, 5)))
    e = T.load(spark, d, "embeddings").select("vec_id", kind.alias("entity_type"), points.alias("points"), (F.col("vec_id") % 6 == 2).alias("closed"), c(0).alias("x"), c(1).alias("y"), F.abs(c(2)).alias("r"), F.lit(300.0).alias("a"), (F.col("vec_id") % 90).cast("double").alias("b"))
    shape = I.shape_points(*map(F.col, ("entity_type", "points", "closed", "x", "y", "r", "a", "b")))
    g = I.geometry_rows(e.withColumn("shape", shape), "shape")
    return g.select("vec_id", "entity_type", "geometry_point_count", "geometry_line_count", "geometry_polygon_count", F.round("geometry_length", 5).alias("geometry_length"), F.round("geometry_area", 5).alias("geometry_area"))


GEOMETRY_INVENTORY = """
WITH e AS (SELECT vec_id, CAST(vec_id % 6 AS INT) AS k, list_transform(embedding[1:6], lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), s AS (SELECT *, sqrt((v[3] - v[1]) ** 2 + (v[4] - v[2]) ** 2) AS a, sqrt((v[5] - v[3]) ** 2 + (v[6] - v[4]) ** 2) AS b, sqrt((v[5] - v[1]) ** 2 + (v[6] - v[2]) ** 2) AS c,
  abs((v[3] - v[1]) * (v[6] - v[2]) - (v[5] - v[1]) * (v[4] - v[2])) / 2 AS t, abs(v[3]) AS r FROM e)
SELECT vec_id, ['LINE', 'LWPOLYLINE', 'POLYLINE', 'CIRCLE', 'ARC'][k + 1] AS entity_type, CAST([2, 3, 8, 49, 24][k + 1] AS INT) AS geometry_point_count, CAST([1, 1, 1, 0, 1][k + 1] AS INT) AS geometry_line_count, CAST([0, 0, 1, 1, 0][k + 1] AS INT) AS geometry_polygon_count,
  round(CASE k WHEN 0 THEN a WHEN 1 THEN a + b WHEN 2 THEN a + b + c WHEN 3 THEN 0 ELSE 23 * 2 * r * sin(radians(60 + vec_id % 90) / 46) END, 5)::DOUBLE AS geometry_length, round(CASE k WHEN 2 THEN t WHEN 3 THEN 24 * r * r * sin(2 * pi() / 48) ELSE 0 END, 5)::DOUBLE AS geometry_area
FROM s WHERE k < 5 AND (k < 3 OR r > 0)"""


def selective_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entities that a selective scan keeps, by type, layer and depth."""
    e = D.entities(spark, d)
    kept = e.where(E.expands(F.col("entity_type"), F.col("layer"), F.col("parent_block_name"), F.col("depth")))
    return kept.groupBy("entity_type", "layer", "depth").agg(F.count("*").alias("n"))


SELECTIVE_SCAN = f"""
WITH {D.ENTITIES_SQL} SELECT entity_type, layer, depth, count(*) AS n FROM entities
WHERE depth = 0 OR entity_type IN ('TEXT', 'MTEXT', 'ATTRIB', 'INSERT') OR entity_type IN {TYPES_SQL} AND ({MARKS.format('layer')} OR {MARKS.format('parent_block_name')}) GROUP BY 1, 2, 3"""

#: Terms that a library of objects knows, for the cascades.
KNOWN = ["消防水泵房", "安全出口", "消防电梯", "配电间", "XF-01"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Entities as candidates: their term, where it comes from, and whether a library knows it."""
    e = D.entities(spark, d).withColumn("_c", E.candidate_term(F.col("entity_type"), F.col("norm_text"), F.col("parent_block_name")))
    return e.select("*", "_c.term", "_c.source_type").drop("_c").withColumn("protected", F.col("term").isin(*KNOWN))


GENERIC_SQL = "('" + "', '".join(E.bare(E.GENERIC)) + "')"
KEY = "upper(replace(translate({0}, '（）', '()'), ' ', ''))"
CANDIDATES_SQL = f"""{D.ENTITIES_SQL}, m AS (SELECT *, CASE WHEN {KEY.format('norm_text')} IN {GENERIC_SQL} THEN '' ELSE norm_text END AS t, CASE WHEN {KEY.format('parent_block_name')} IN {GENERIC_SQL} THEN '' ELSE parent_block_name END AS b FROM entities),
c AS (SELECT *, CASE WHEN t <> '' AND entity_type IN ('TEXT', 'MTEXT', 'ATTRIB') THEN t WHEN b <> '' AND entity_type = 'INSERT' THEN b ELSE '' END AS term,
  CASE WHEN t <> '' AND entity_type IN ('TEXT', 'MTEXT', 'ATTRIB') THEN 'text' WHEN b <> '' AND entity_type = 'INSERT' THEN 'block' ELSE 'none' END AS source_type FROM m),
k AS (SELECT *, term IN ('{"', '".join(KNOWN)}') AS known, {KEY.format('term')} AS tk, {KEY.format("(term || ' ' || parent_block_name)")} AS ev, {KEY.format('parent_block_name')} AS bk FROM c)"""


def marks_sql(column: str, marks: tuple[str, ...]) -> str:
    return f"regexp_matches({column}, '{'|'.join(E.bare(marks))}')"


def candidate_noise(spark: SparkSession, d: str) -> DataFrame:
    """Why candidates are noise, counted by source and reason; rules run once for each distinct candidate."""
    c = candidates(spark, d).select("term", "source_type", "entity_type", "parent_block_name", "protected")
    reason = E.candidate_noise(*map(F.col, c.columns))
    out = E.by_distinct(c, c.columns, {"reason": reason})
    return out.groupBy("source_type", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("term").alias("terms"))


CANDIDATE_NOISE = rf"""
WITH {CANDIDATES_SQL}, f AS (SELECT *, {marks_sql('ev', E.HINTS)} AS hinted, {marks_sql('ev', E.SYSTEMS)} AND {marks_sql('tk', E.NOUNS)} AS building, regexp_extract(tk, '^([A-Z]{{1,8}})[-_]?[0-9]{{1,6}}(?:\([^)]*\))?$', 1) AS code FROM k),
r AS (SELECT *, CASE WHEN tk = '' THEN 'empty_term' WHEN tk IN ('{"', '".join(E.GENERIC_OBJECTS)}') THEN 'generic_standalone_object_term' WHEN {marks_sql('tk', E.EXPLANATORY)} THEN 'explanatory_text' WHEN length(tk) = 1 AND tk NOT IN ('井', '泵', '阀', '梯') THEN 'single_character'
  WHEN source_type = 'text' AND regexp_matches(trim(term), '(?i)^([-+]?[0-9]+(\.[0-9]+)?|[0-9]+[xX×][0-9]+)$') AND NOT known THEN 'dimension_or_number'
  WHEN source_type = 'text' AND regexp_matches(term || ' ', '(?i)([0-9]+(\.[0-9]+)?\s*(m|mm|cm|kg|kw|kva|%|㎡|m2|m3)[^a-z0-9_一-龥]|[-+]?[0-9]+\s*f\s*(至|~|-|到)\s*[-+]?[0-9]+\s*f)') AND NOT known THEN 'measurement_or_floor_range'
  WHEN source_type IN ('text', 'block') AND regexp_matches(trim(term), '(?i)^(b[0-9]+([-_~至到]b?[0-9]+)?|[0-9]+f|[-+]?[0-9]+([-_~至到][0-9]+)?f|[-+]?[0-9]+[-_~至到][0-9]+f?)$') AND NOT known THEN 'floor_code_only'
  WHEN source_type = 'text' AND {marks_sql('bk', E.TITLE_BLOCKS)} THEN 'title_block_text' WHEN source_type = 'text' AND {marks_sql('bk', E.DRAWING_NOISE)} AND NOT hinted AND NOT building THEN 'drawing_block_noise'
  WHEN source_type = 'text' AND {marks_sql('tk', E.DISCIPLINES)} AND NOT known AND NOT building THEN 'discipline_title_text' WHEN source_type = 'text' AND NOT hinted AND ({marks_sql('tk', E.DRAWING_NOISE)} OR {marks_sql('tk', E.HARD_EXCLUDED)}) THEN 'drawing_note_or_title'
  WHEN source_type = 'text' AND NOT hinted AND length(tk) > 48 THEN 'long_explanatory_text' WHEN source_type = 'text' AND code <> '' AND code NOT IN ('FJ', 'XF', 'SB') AND NOT known THEN 'kept'
  WHEN source_type = 'block' AND {marks_sql('ev', E.TITLE_BLOCKS)} THEN 'title_block_insert' WHEN source_type = 'block' AND {marks_sql('ev', E.DRAWING_NOISE)} AND NOT known THEN 'drawing_symbol_block'
  WHEN entity_type IN ('DIMENSION', 'LEADER', 'MLEADER') THEN 'annotation_entity' ELSE 'kept' END AS reason FROM f)
SELECT source_type, reason, count(*) AS n, count(DISTINCT term) AS terms FROM r GROUP BY 1, 2"""


def classifier_noise(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("term", "source_type", "entity_type", "geometry_kind", "protected")
    out = E.by_distinct(c, c.columns, {"reason": E.classifier_noise(*map(F.col, c.columns))})
    return out.groupBy("term", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


CLASSIFIER_NOISE = rf"""
WITH {CANDIDATES_SQL}, r AS (SELECT term, CASE WHEN source_type = 'none' THEN 'not_text_or_block_semantics' WHEN trim(term) = '' THEN 'empty_term' WHEN tk IN ('{"', '".join(E.GENERIC_OBJECTS)}') THEN 'generic_standalone_object_term'
  WHEN regexp_matches(trim(term), '^[A-Za-z0-9][A-Za-z0-9_\-]{{1,24}}$') AND regexp_matches(term, '[A-Za-z]') AND regexp_matches(term, '[0-9]') THEN 'kept'
  WHEN regexp_matches(trim(term), '^([0-9]+([.\-_:xX×][0-9]+)*|[A-Za-z])$') AND NOT known THEN 'plain_number_or_code' WHEN {marks_sql('tk', E.CLASSIFIER_NOISE)} THEN 'noise_term' ELSE 'kept' END AS reason FROM k)
SELECT term, reason, count(*) AS n FROM r GROUP BY 1, 2"""


def doors_and_stairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are fire doors or stairs, and whether their floor is an upper one."""
    c = candidates(spark, d).select("term", "layer", "parent_block_name", "floor_id")
    door, up = E.fire_door(*map(F.col, c.columns[:3])), S.is_upper_floor(F.col("floor_id"))
    out = E.by_distinct(c, c.columns, {"is_fire_door": door, "is_stair": E.stair(*map(F.col, c.columns[:3])), "upper": up})
    return out.groupBy("term", "is_fire_door", "is_stair", "upper").agg(F.count("*").alias("n"))


UPPER_SQL = "floor_id IN ('F2', '2F', '屋顶层', 'F7__B01', '3层', 'EQUIPMENT', '十二层', '二楼')"
DOORS_SQL = rf"""{CANDIDATES_SQL}, x AS (SELECT *, contains(tk, '防火门') OR regexp_matches(tk, '^(FM|FGM|FJM)([甲乙丙丁]?[0-9]{{0,8}}([-_][0-9]+)?)?$') OR NOT {marks_sql('tk', E.EXITS)} AND regexp_matches(tk, '^[A-Z]{{1,8}}[甲乙丙丁]?[0-9]{{1,8}}([-_][0-9]+)?$')
  AND regexp_matches({KEY.format("(layer || ' ' || parent_block_name)")}, '防火门|DOOR_FIRE|FIRE_DOOR') AS is_fire_door, regexp_matches({KEY.format("(term || ' ' || layer || ' ' || parent_block_name)")}, '楼梯|STAIR|STRS') AS is_stair, {UPPER_SQL} AS upper FROM k)"""
DOORS_AND_STAIRS = f"WITH {DOORS_SQL} SELECT term, is_fire_door, is_stair, upper, count(*) AS n FROM x GROUP BY 1, 2, 3, 4"


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which candidates may prove a class, for three classes."""
    c = candidates(spark, d).select("term", "layer", "parent_block_name", "floor_id", "source_type", "entity_type")
    stairs = E.stair(F.col("term"), F.col("layer"), F.col("parent_block_name")) & S.is_upper_floor(F.col("floor_id")) & F.col("source_type").isin("text", "block", "layer")
    kinds = {"exit": "安全出口", "room": "配电房", "device": "喷头"}
    gates = {n: E.allows_class(F.lit(name), F.col("source_type"), F.col("entity_type"), stairs) for n, name in kinds.items()}
    out = E.by_distinct(c, c.columns, gates)
    return out.groupBy("source_type", *kinds).agg(F.count("*").alias("n"))


EVIDENCE_GATE = f"""
WITH {DOORS_SQL}, g AS (SELECT source_type, source_type = 'text' AND entity_type IN ('TEXT', 'MTEXT', 'ATTRIB') AS t, source_type = 'block' AND entity_type = 'INSERT' AS b, is_stair AND upper AND source_type IN ('text', 'block') AS s FROM x)
SELECT source_type, s OR t OR b AS exit, t AS room, t OR b AS device, count(*) AS n FROM g GROUP BY 1, 2, 3, 4"""


def short_words(spark: SparkSession, d: str) -> DataFrame:
    """What short terms mean in their context, and rooms of exactly two words."""
    c = candidates(spark, d).select(*E.CONTEXT)
    context = F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in E.CONTEXT])
    out = E.by_distinct(c, c.columns, {"m": E.short_word(F.col("term"), context), "room": E.short_room(F.col("term"), context)})
    return out.groupBy("term", F.col("m.class").alias("class"), F.col("m.reason").alias("reason"), F.col("m.confidence").alias("confidence"), "room").agg(F.count("*").alias("n"))


def short_sql() -> tuple[str, str, str]:
    """CASE expressions for class, reason and confidence by the table of rules."""
    rules = [(f"tk = '{w}'", name, "short_word_exact_rule", 0.86) for w, name in E.EXACT_WORDS.items()]
    rules += [(" AND ".join([marks_sql("tk", words), *[marks_sql("cx", c) for c in contexts]]), name, reason, p) for reason, name, p, words, contexts in E.SHORT_WORDS]
    first = "CASE WHEN tk IN ('" + "', '".join(E.GENERIC_OBJECTS) + "') THEN NULL "
    case = lambda pick: first + " ".join(f"WHEN {c} THEN {pick(r)}" for c, *r in rules) + " END"
    text = lambda v: "NULL" if v is None else f"'{v}'"
    return case(lambda r: text(r[0])), case(lambda r: text(r[1]) if r[0] else "NULL"), case(lambda r: f"CAST({r[2]} AS DOUBLE)" if r[0] else "NULL")


CLASS_SQL, REASON_SQL, CONFIDENCE_SQL = short_sql()
SHORT_WORDS = f"""
WITH {CANDIDATES_SQL}, s AS (SELECT *, {KEY.format("(term || ' ' || layer || ' ' || parent_block_name || ' ' || source_type || ' ' || entity_type || ' ' || geometry_kind)")} AS cx FROM k),
r AS (SELECT term, {CLASS_SQL} AS class, {REASON_SQL} AS reason, {CONFIDENCE_SQL} AS confidence, CASE WHEN regexp_matches(cx, 'TEXT|MTEXT|ATTRIB|房间|房名|门|地下一层|地下二层|地库') AND NOT {marks_sql('tk', E.EXPLANATORY)} THEN CASE tk WHEN '强电' THEN '强电间' WHEN '弱电' THEN '弱电间' END END AS room FROM s)
SELECT term, class, reason, confidence, room, count(*) AS n FROM r GROUP BY 1, 2, 3, 4, 5"""


def settled_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Made-up model answers for the candidates, settled by the closed set's rules."""
    c = candidates(spark, d).select("object_id", "term", "layer", "parent_block_name", "floor_id")
    role = F.when(F.col("object_id") % 5 == 0, "other").otherwise("inspection_object")
    matched = F.when(F.col("object_id") % 3 == 0, "安全出口").otherwise("配电房")
    p, score = (F.col("object_id") % 100) / 100, (F.col("object_id") % 7) / 7
    place = list(map(F.col, ("term", "layer", "parent_block_name")))
    m = E.settled_decision(role, matched, p, matched, score, E.fire_door(*place), E.stair(*place), S.is_upper_floor(F.col("floor_id")))
    out = c.select("object_id", m.alias("m")).select("object_id", "m.*")
    return out.groupBy("role", "class", "reason").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


SETTLED_DECISIONS = f"""
WITH {DOORS_SQL}, p AS (SELECT *, CASE WHEN object_id % 5 = 0 THEN 'other' ELSE 'inspection_object' END AS r, CASE WHEN object_id % 3 = 0 THEN '安全出口' ELSE '配电房' END AS m, (object_id % 100) / 100 AS c, (object_id % 7) / 7 AS s FROM x),
q AS (SELECT CASE WHEN r <> 'inspection_object' THEN 'no_object' WHEN m = '安全出口' AND is_fire_door THEN 'fire_door_not_safety_exit' WHEN m = '安全出口' AND is_stair AND NOT upper THEN 'stair_below_second_floor_not_safety_exit' ELSE 'closed_set_classification' END AS reason, * FROM p)
SELECT CASE WHEN reason = 'closed_set_classification' THEN 'inspection_object' ELSE 'IGNORE' END AS role, CASE WHEN reason = 'closed_set_classification' THEN m ELSE 'IGNORE' END AS class, reason, count(*) AS n,
  round(sum(CASE reason WHEN 'no_object' THEN round(least(c, 0.5), 3) WHEN 'closed_set_classification' THEN round(greatest(0.6, least(1, 0.7 * c + 0.3 * s)), 3) ELSE 1 END), 3) AS confidence FROM q GROUP BY 1, 2, 3"""

UPPER_ALIASES = [("安全出口", "楼梯"), ("安全出口", "楼梯间"), ("安全出口", "STRS"), ("安全出口", "STAIR"), ("避难间", "电梯井")]


def upper_floor_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Candidates on upper floors with the longest alias that counts only there; one row a distinct candidate."""
    c = candidates(spark, d).select("term", "layer", "parent_block_name", "floor_id").distinct().withColumn("item", F.concat_ws("|", "term", "layer", "parent_block_name", "floor_id"))
    return E.best_upper_alias(c, spark.createDataFrame(UPPER_ALIASES, "class string, alias string"), "item", ["term", "layer", "parent_block_name"], ["floor_id"])


UPPER_FLOOR_ALIASES = f"""
WITH {CANDIDATES_SQL}, a(class, alias) AS (VALUES {', '.join(map(str, UPPER_ALIASES))}), u AS (SELECT DISTINCT term, layer, parent_block_name, floor_id FROM k WHERE {UPPER_SQL}),
h AS (SELECT term || '|' || layer || '|' || parent_block_name || '|' || floor_id AS item, class, alias FROM u JOIN a ON {' OR '.join(f"(contains({KEY.format(c)}, alias) AND NOT {marks_sql(KEY.format(c), E.EXPLANATORY)})" for c in ('term', 'layer', 'parent_block_name'))})
SELECT item, arg_min(class, (-length(alias), -length(class), class, alias)) AS class, arg_min(alias, (-length(alias), -length(class), class, alias)) AS alias FROM h GROUP BY 1"""

DECISIONS = [("A-WALL", ["wall"], ""), ("墙体", ["filled"], "solid"), ("S-COLU", ["column"], ""), ("WINDOW", ["column", "wall"], ""), ("DOOR_FIRE", [], "curtain wall"), ("PUMP-ROOM", [], "")]


def obstacle_types(spark: SparkSession, d: str) -> DataFrame:
    """Entities of layers that were judged obstacles: what kind, whether walls are meant, openings, dashed lines."""
    e = D.entities(spark, d).select("layer", "entity_type", "linetype", "geometry_kind")
    j = e.join(spark.createDataFrame(DECISIONS, "layer string, types array<string>, reason string"), "layer")
    out = j.select(
        "layer", "entity_type", E.obstacle_type(F.col("types"), F.col("entity_type")).alias("kind"), E.has_wall(F.col("layer"), F.col("types"), F.col("reason")).alias("has_wall"), E.has_opening(F.col("layer")).alias("has_opening"),
        E.dashed(F.col("linetype"), F.col("geometry_kind")).alias("is_dashed"),
    )
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


OBSTACLE_TYPES = f"""
WITH {D.ENTITIES_SQL}, t(layer, types, reason) AS (VALUES {', '.join(f"('{a}', CAST({b} AS VARCHAR[]), '{c}')" for a, b, c in DECISIONS)}), j AS (SELECT e.layer, entity_type, linetype, geometry_kind, types, reason FROM entities e JOIN t ON e.layer = t.layer)
SELECT layer, entity_type, CASE WHEN list_contains(types, 'column') AND entity_type = 'CIRCLE' THEN 'column' WHEN list_contains(types, 'wall') THEN 'wall' WHEN list_contains(types, 'column') THEN 'column' ELSE 'filled_obstacle' END AS kind,
  list_contains(types, 'wall') OR regexp_matches(upper(layer || ' ' || reason || ' ' || array_to_string(types, ' ')), 'WALL|CURTAIN|GLZ|GLAZ|墙') AS has_wall, regexp_matches(upper(layer), 'DOOR|OPENING|留洞|洞口') AS has_opening,
  regexp_matches(upper(linetype || ' ' || geometry_kind), 'DASH|HIDDEN|PHANTOM|CENTER|DOT|虚线') AS is_dashed, count(*) AS n FROM j GROUP BY ALL"""


def annotation_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box shown about each entity, its own, a point's or none."""
    e = D.entities(spark, d)
    at = lambda v: F.when(F.col("object_id") % 3 > 0, F.expr(v))
    b = I.annotation_box(*map(F.col, ("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy")), at("cast(object_id % 1000 as double)"), at("cast(object_id % 777 as double)"))
    return e.select("object_id", b.alias("b")).select("object_id", *[F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


ANNOTATION_BOXES = f"""
WITH {D.ENTITIES_SQL}, o AS (SELECT object_id, bbox_maxx > bbox_minx AND bbox_maxy > bbox_miny AS ok, CASE WHEN object_id % 3 > 0 THEN object_id % 1000 END AS x, CASE WHEN object_id % 3 > 0 THEN object_id % 777 END AS y, bbox_minx, bbox_miny, bbox_maxx, bbox_maxy FROM entities),
p AS (SELECT object_id, CASE WHEN ok THEN bbox_minx ELSE x - 250 END AS a, CASE WHEN ok THEN bbox_miny ELSE y - 250 END AS b, CASE WHEN ok THEN bbox_maxx ELSE x + 250 END AS c, CASE WHEN ok THEN bbox_maxy ELSE y + 250 END AS d FROM o),
q AS (SELECT *, CASE WHEN a IS NOT NULL THEN greatest(180, least(800, greatest(c - a, d - b) * 0.18)) END AS pad FROM p)
SELECT object_id, round(a - greatest(0, 600 - (c - a)) / 2 - pad, 4) AS x0, round(b - greatest(0, 360 - (d - b)) / 2 - pad, 4) AS y0, round(c + greatest(0, 600 - (c - a)) / 2 + pad, 4) AS x1, round(d + greatest(0, 360 - (d - b)) / 2 + pad, 4) AS y1 FROM q"""


def merged_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all floors merged by their key: how often, the smallest spelling, and the first 8 layers and 16 floors."""
    c = candidates(spark, d).where("term <> ''").withColumn("term_key", E.key(F.col("term")))
    g = c.groupBy("term_key").agg(F.count("*").alias("n"), F.min("term").alias("term"), F.countDistinct("floor_id").alias("floors"))
    layers = I.first_distinct(c, ["term_key"], "layer", "object_id", 8, "layers")
    return g.join(layers, "term_key", "left").join(I.first_distinct(c, ["term_key"], "floor_id", "object_id", 16, "floor_ids"), "term_key", "left")


MERGED_TERMS = f"""
WITH {CANDIDATES_SQL}, e AS (SELECT *, tk AS term_key FROM k WHERE term <> ''), g AS (SELECT term_key, count(*) AS n, min(term) AS term, count(DISTINCT floor_id) AS floors FROM e GROUP BY 1)
SELECT * FROM g LEFT JOIN {sample_sql('term_key', 'layer', 'object_id', 8, 'layers')} USING (term_key) LEFT JOIN {sample_sql('term_key', 'floor_id', 'object_id', 16, 'floor_ids')} USING (term_key)"""

_NAMES = "inventory_rows catalog_signatures text_summary layer_summary block_signatures expanded_blocks scanned_inserts geometry_inventory selective_scan candidate_noise classifier_noise doors_and_stairs evidence_gate short_words settled_decisions upper_floor_aliases obstacle_types annotation_boxes merged_terms".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
