"""Queries over casts, normalisers, box algebra and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import scalars as S
from ..operators import cascades
from ..sources import drawing as D
from ..sources import tables as T


def scalar_casts(spark: SparkSession, d: str) -> DataFrame:
    pages = T.load(spark, d, "pages").select("page_id", "url")
    tail = F.regexp_extract("url", "[?]([a-z_]+)=([^&#]*)", 2)
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    return pages.select(
        "page_id", S.safe_int(tail, -1).alias("tail_int"), S.safe_double(F.concat(number, F.lit(".5"))).alias("half"),
        S.safe_double(F.when(F.col("page_id") % 7 == 0, "NaN").otherwise(number), -1.0).alias("finite"),
        S.first_positive(tail, number).alias("positive"), S.first_filled(tail, number).alias("filled"),
    )


SCALAR_CASTS = """
WITH p AS (SELECT page_id, regexp_extract(url, '[?]([a-z_]+)=([^&#]*)', 2) AS tail, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages),
q AS (SELECT *, TRY_CAST(tail AS INT) AS t, TRY_CAST(number AS INT) AS n, TRY_CAST(number || '.5' AS DOUBLE) AS h,
  TRY_CAST(CASE WHEN page_id % 7 = 0 THEN 'NaN' ELSE number END AS DOUBLE) AS f FROM p)
SELECT page_id, coalesce(t, -1) AS tail_int, coalesce(h, 0.0) AS half, CASE WHEN f IS NULL OR isnan(f) OR isinf(f) THEN -1.0 ELSE f END AS finite,
  coalesce(CASE WHEN t > 0 THEN t END, CASE WHEN n > 0 THEN n END, 0) AS positive,
  coalesce(CASE WHEN trim(tail) <> '' THEN tail END, CASE WHEN trim(number) <> '' THEN number END) AS filled FROM q"""


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    docs = T.load(spark, d, "documents").select("doc_id", "text", "source")
    raw = F.concat(F.lit(r"{\A1;"), "text", F.lit(r"\P（x）}"))
    return docs.select(
        "doc_id", F.md5(S.drawing_text(raw)).alias("drawing"), F.md5(S.library_key(raw)).alias("library"), F.md5(S.ascii_compact(F.col("text"))).alias("compact"),
        F.size(S.token_set(F.col("text"))).cast("long").alias("n_tokens"), S.layer_key(F.concat(F.lit("a-wall_("), "source", F.lit(")/【1】"))).alias("layer"),
        S.identifier(F.concat(F.lit("-- "), "source", F.lit(" / 1 --"))).alias("name"),
    )


SP = r"[\s\x{00A0}\x{3000}]+"
TEXT_NORMALIZE = rf"""
WITH r AS (SELECT doc_id, text, source, '{{\A1;' || text || '\P（x）}}' AS raw FROM documents)
SELECT doc_id, md5(regexp_replace(replace(replace(regexp_replace(regexp_replace(raw, '\\[Pp]', '', 'g'), '\\[A-Za-z][^;\\]{{0,16}};', '', 'g'), '{{', ''), '}}', ''), '{SP}', '', 'g')) AS drawing,
  md5(upper(regexp_replace(translate(replace(raw, 'ß', 'SS'), '（）', '()'), '{SP}', '', 'g'))) AS library,
  md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', '', 'g')) AS compact,
  CAST(len(list_distinct(list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]+'), lambda t: t <> ''))) AS BIGINT) AS n_tokens,
  upper(regexp_replace('a-wall_(' || source || ')/【1】', '[\s_\-()\[\]/\\【】（）]+', '', 'g')) AS layer,
  coalesce(nullif(regexp_replace(regexp_replace('-- ' || source || ' / 1 --', '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'item') AS name FROM r"""

TYPES = ["LINE", "LWPOLYLINE", "CIRCLE", "TEXT", "INSERT", "HATCH", "DIMENSION"]


def entities(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as entities: a type by line number, closed by return flag, a layer by both flags."""
    kind = F.array(*map(F.lit, TYPES))[F.col("l_linenumber") - 1]
    return T.load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", kind.alias("kind"), (F.col("l_returnflag") == "R").alias("closed"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("layer"),
    )


ENTITIES_SQL = f"""entities AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, list_extract({TYPES}, l_linenumber) AS kind,
  l_returnflag = 'R' AS closed, l_returnflag || '-' || l_linestatus AS layer FROM lineitem)"""


def geometry_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All entity types, open and closed."""
    e = D.entities(spark, d).select("entity_type", "geometry_kind", "is_closed")
    return e.groupBy("entity_type", "geometry_kind", "is_closed").agg(F.count("*").alias("n"))


GEOMETRY_KINDS = f"WITH {D.ENTITIES_SQL} SELECT entity_type, geometry_kind, is_closed, count(*) AS n FROM entities GROUP BY 1, 2, 3"


def polyline_measures(spark: SparkSession, d: str) -> DataFrame:
    """An embedding's components as a path of points, two by two; and a circle and an arc of its first components."""
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y")))
    e = T.load(spark, d, "embeddings").select("vec_id", points.alias("p"), (F.abs(T.component(2)) + 1).alias("r"))
    zero = F.lit(0.0)
    return e.select(
        "vec_id", F.round(B.path_length(F.col("p")), 6).alias("length"), F.round(B.ring_area(F.col("p")), 6).alias("area"),
        F.round(B.ring_area(B.circle_points(zero, zero, F.col("r"))), 6).alias("circle"),
        F.round(B.path_length(B.arc_points(zero, zero, F.col("r"), F.lit(350.0), F.lit(80.0))), 6).alias("arc"),
    )


POLYLINE_MEASURES = """
WITH e AS (SELECT vec_id, embedding, abs(CAST(embedding[3] AS DOUBLE)) + 1 AS r FROM embeddings),
p AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM e, range(32) t(i)),
m AS (SELECT a.vec_id, sum(CASE WHEN a.i < 31 THEN sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) ELSE 0 END) AS length, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area
  FROM p a JOIN p b ON a.vec_id = b.vec_id AND b.i = (a.i + 1) % 32 GROUP BY 1)
SELECT e.vec_id, round(length, 6) AS length, round(area, 6) AS area, round(24 * r * r * sin(2 * pi() / 48), 6) AS circle, round(23 * 2 * r * sin(pi() / 180 * 90 / 46), 6) AS arc
FROM e JOIN m ON e.vec_id = m.vec_id"""


def bbox_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Each target's box against that of the next target: an equi-join, no pairs beyond."""
    b = T.target_boxes(spark, d)
    a = b.select(F.col("target_id"), F.col("b").alias("p"), (F.col("target_id") + 1).alias("next"))
    j = a.join(b.select(F.col("target_id").alias("next"), F.col("b").alias("q")), "next")
    p, q = F.col("p"), F.col("q")
    part = B.clip(p, q)
    return j.select(
        "target_id", F.round(B.iou(p, q), 6).alias("iou"), F.round(B.contained(p, q), 6).alias("contained"), F.round(B.area(B.cover(p, q)), 6).alias("cover_area"),
        F.round(B.point_distance(p, q["x0"], q["y0"]), 6).alias("distance"), F.round(F.coalesce(B.area(part), F.lit(-1.0)), 6).alias("clip_area"),
        F.round(B.area(B.inflate(p, 0.5)), 6).alias("inflated"), F.round(B.angle(F.struct(p["x0"].alias("x"), p["y0"].alias("y")), F.struct(q["x0"].alias("x"), q["y0"].alias("y"))), 4).alias("angle"),
    )


BBOX_ALGEBRA = f"""
WITH {T.BOXES_SQL}, j AS (SELECT p.target_id, p.x0 px0, p.y0 py0, p.x1 px1, p.y1 py1, q.x0 qx0, q.y0 qy0, q.x1 qx1, q.y1 qy1 FROM boxes p JOIN boxes q ON q.target_id = p.target_id + 1),
k AS (SELECT *, greatest(0, least(px1, qx1) - greatest(px0, qx0)) * greatest(0, least(py1, qy1) - greatest(py0, qy0)) AS c, (px1 - px0) * (py1 - py0) AS pa, (qx1 - qx0) * (qy1 - qy0) AS qa FROM j)
SELECT target_id, round(c / (pa + qa - c), 6) AS iou, round(c / pa, 6) AS contained, round((greatest(px1, qx1) - least(px0, qx0)) * (greatest(py1, qy1) - least(py0, qy0)), 6) AS cover_area,
  round(sqrt(greatest(0, px0 - qx0, qx0 - px1) ** 2 + greatest(0, py0 - qy0, qy0 - py1) ** 2), 6) AS distance,
  round(CASE WHEN least(px1, qx1) > greatest(px0, qx0) AND least(py1, qy1) > greatest(py0, qy0) THEN c ELSE -1.0 END, 6) AS clip_area,
  round((px1 - px0 + 1) * (py1 - py0 + 1), 6) AS inflated, round(CASE WHEN degrees(atan2(qy0 - py0, qx0 - px0)) < 0 THEN degrees(atan2(qy0 - py0, qx0 - px0)) + 180 ELSE degrees(atan2(qy0 - py0, qx0 - px0)) END, 4) AS angle FROM k"""


def pixel_transform(spark: SparkSession, d: str) -> DataFrame:
    b = T.target_boxes(spark, d)
    frame = B.box(F.lit(-1.0), F.lit(-0.5), F.lit(1.0), F.lit(0.5))
    x, y = B.to_pixels(F.col("b.x0"), F.col("b.y0"), frame, F.lit(1000.0))
    t = B.thousandths(B.box(F.col("b.x0") * 4000, F.col("b.y0") * 4000, F.col("b.x1") * 4000, F.col("b.y1") * 4000))
    return b.select("target_id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"), F.round(t["x0"], 6).alias("u0"), F.round(t["y1"], 6).alias("v1"), S.content_id(F.col("b.x0"), F.col("b.y0")).alias("content_id"))


PIXEL_TRANSFORM = f"""
WITH {T.BOXES_SQL} SELECT target_id, round((x0 + 1) * 500, 4) AS px, round(1000 - ((y0 + 0.5) * 500 + 250), 4) AS py,
  round(greatest(0, least(1000, x0 * 4000)) / 1000, 6) AS u0, round(greatest(0, least(1000, y1 * 4000)) / 1000, 6) AS v1,
  substr(sha256(printf('%.3f', round(x0, 3) + 0.0) || ',' || printf('%.3f', round(y0, 3) + 0.0)), 1, 16) AS content_id FROM boxes"""


def floor_mentions(spark: SparkSession, d: str) -> DataFrame:
    t = T.floor_texts(spark, d).withColumn("floors", S.floor_mentions(F.col("title")))
    return t.select(
        "p_partkey", "title", F.array_join("floors", ",").alias("floors"), F.array_join(F.transform("floors", S.floor_name), ",").alias("names"), S.is_upper_floor(F.col("title")).alias("upper"),
        F.array_min(F.transform("floors", S.floor_order)).alias("lowest"), F.array_join(S.building_labels(F.col("title")), ",").alias("buildings"),
    )


#: What each title says by the definitions, one case a title.
FLOOR_MENTIONS = f"""
WITH {T.FLOOR_TEXTS_SQL}, f AS (SELECT *, CASE k WHEN 0 THEN ['F' || n] WHEN 3 THEN ['B' || m, 'F' || n] WHEN 4 THEN ['ROOF', 'F' || n] WHEN 5 THEN ['EQUIPMENT'] WHEN 6 THEN ['STANDARD', 'F' || (10 + m)] WHEN 7 THEN ['B' || m]
  WHEN 8 THEN ['F1', 'B' || m] WHEN 9 THEN ['REFUGE', 'MEZZANINE', 'ROOF'] WHEN 11 THEN ['F' || n] WHEN 12 THEN ['B2'] WHEN 15 THEN ['F' || n] ELSE CAST([] AS VARCHAR[]) END AS floors FROM titles)
SELECT p_partkey, title, array_to_string(floors, ',') AS floors,
  array_to_string(list_transform(floors, lambda x: CASE x WHEN 'ROOF' THEN '屋顶层' WHEN 'STANDARD' THEN '标准层' WHEN 'EQUIPMENT' THEN '设备层' WHEN 'MEZZANINE' THEN '夹层' WHEN 'REFUGE' THEN '避难层' WHEN 'F1' THEN '首层' ELSE CASE WHEN x[1] = 'B' THEN '地下' ELSE '' END || substr(x, 2) || '层' END), ',') AS names,
  CASE WHEN k IN (0, 1, 11, 14, 15) THEN n >= 2 ELSE k IN (4, 5, 6, 13) END AS upper,
  CASE k WHEN 0 THEN n WHEN 3 THEN -m WHEN 4 THEN n WHEN 5 THEN 2000 WHEN 6 THEN 10 + m WHEN 7 THEN -m WHEN 8 THEN -m WHEN 9 THEN 1000 WHEN 11 THEN n WHEN 12 THEN -2 WHEN 15 THEN n END AS lowest,
  CASE WHEN k = 10 THEN array_to_string(list_distinct([CAST(m AS VARCHAR)]) || CASE WHEN m = n THEN [] ELSE [CAST(n AS VARCHAR)] END, ',') ELSE '' END AS buildings FROM f"""


def json_cells(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object within fences and prose, and a cell of counts."""
    e = T.load(spark, d, "events").select("event_id", "props", "event_type")
    inner = S.json_in_text(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    counts = F.concat(F.lit('{"a": 2, "b": '), F.get_json_object(inner, "$.k"), F.lit("}"))
    return e.select("event_id", F.get_json_object(inner, "$.k").try_cast("long").alias("k"), S.counter_total(counts).alias("total"), S.json_in_text(F.concat(F.lit("so "), "props", F.lit(" it is"))).alias("found"))


JSON_CELLS = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 2 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS total, props AS found FROM events"""


def preview_grid(spark: SparkSession, d: str) -> DataFrame:
    """Targets on a 60 by 36 grid of their floor's extent, at most 3 of a cell shown."""
    return cascades.preview(T.targets(spark, d), columns=60, rows=36, most=3)


PREVIEW_GRID = f"""
WITH {T.TARGETS_SQL}, e AS (SELECT *, min(x) OVER w AS ax, max(x) OVER w AS bx, min(y) OVER w AS ay, max(y) OVER w AS by_ FROM targets WINDOW w AS (PARTITION BY floor)),
g AS (SELECT floor, target_id, CAST(least(59, floor((x - ax) / greatest(bx - ax, 1e-9) * 60)) AS INT) AS cx, CAST(least(35, floor((y - ay) / greatest(by_ - ay, 1e-9) * 36)) AS INT) AS cy FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY floor, cx, cy ORDER BY target_id) AS k FROM g)
SELECT floor, target_id, cx, cy FROM r WHERE k <= 3"""


def noise_cascade(spark: SparkSession, d: str) -> DataFrame:
    return cascades.noise_reasons(T.load(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


NOISE_CASCADE = r"""
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) = 1 THEN 'single_character' WHEN regexp_full_match(trim(text), '[0-9]+([.,][0-9]+)?') THEN 'measurement'
  WHEN regexp_full_match(upper(trim(text)), '(B[1-8]|F?[1-9][0-9]?F?)') THEN 'floor_code' WHEN regexp_matches(lower(text), '^(note|notes|legend|drawing no|scale)\b') THEN 'title_block'
  WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' WHEN regexp_matches(text, '[*#$%&]{3}') THEN 'ornament'
  WHEN contains(text, ' | ') THEN 'table' WHEN length(text) > 4800 THEN 'too_long' ELSE 'kept' END AS reason FROM documents"""


def layer_roles(spark: SparkSession, d: str) -> DataFrame:
    return cascades.layer_roles(T.load(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size"))


LAYER_ROLES = """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' AND p_size % 5 = 0 THEN 'not_obstacle' WHEN contains(p_name, 'bolt') THEN 'wall' WHEN contains(p_name, 'ring') THEN 'column'
  WHEN contains(p_name, 'gear') OR contains(p_name, 'plate') THEN 'opening' WHEN p_size > 40 THEN 'filled' ELSE 'passable' END AS role,
  CASE WHEN p_type = 'PROMO' AND p_size % 5 = 0 THEN CASE WHEN contains(p_name, 'bolt') THEN 'wall' WHEN contains(p_name, 'ring') THEN 'column' WHEN contains(p_name, 'gear') OR contains(p_name, 'plate') THEN 'opening' WHEN p_size > 40 THEN 'filled' ELSE 'passable' END END AS overridden,
  CAST(contains(p_name, 'bolt') OR contains(p_name, 'ring') AS BOOLEAN) AS has_evidence FROM part"""

QUERIES = {
    "scalar_casts": scalar_casts, "text_normalize": text_normalize, "geometry_kinds": geometry_kinds, "polyline_measures": polyline_measures, "bbox_algebra": bbox_algebra,
    "pixel_transform": pixel_transform, "floor_mentions": floor_mentions, "json_cells": json_cells, "preview_grid": preview_grid, "noise_cascade": noise_cascade, "layer_roles": layer_roles,
}
ORACLE_SQL = {
    "scalar_casts": SCALAR_CASTS, "text_normalize": TEXT_NORMALIZE, "geometry_kinds": GEOMETRY_KINDS, "polyline_measures": POLYLINE_MEASURES, "bbox_algebra": BBOX_ALGEBRA,
    "pixel_transform": PIXEL_TRANSFORM, "floor_mentions": FLOOR_MENTIONS, "json_cells": JSON_CELLS, "preview_grid": PREVIEW_GRID, "noise_cascade": NOISE_CASCADE, "layer_roles": LAYER_ROLES,
}
