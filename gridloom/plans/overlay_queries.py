"""Queries over polygons of floors: targets' boxes as obstacles in a domain of 70 by 70 about the origin, in hundredths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import overlays as O
from ..sources import tables as T

SIDE = 35.0


def scope(c: str = "floor"):
    return F.concat(F.lit("F"), F.col(c).cast("string"))


def obstacles(spark: SparkSession, d: str) -> DataFrame:
    b = T.target_boxes(spark, d)
    return b.select(scope().alias("scope"), F.col("target_id").alias("id"), *[(F.col(f"b.{c}") * 100).alias(c) for c in ("x0", "y0", "x1", "y1")])


def ringed(df: DataFrame) -> DataFrame:
    return df.select("scope", O.box_ring(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("ring"))


def floors(spark: SparkSession, d: str) -> DataFrame:
    return T.targets(spark, d).select(scope().alias("scope")).distinct()


def domains(spark: SparkSession, d: str) -> DataFrame:
    return floors(spark, d).select("scope", O.box_ring(F.lit(-SIDE), F.lit(-SIDE), F.lit(SIDE), F.lit(SIDE)).alias("ring"))


OBSTACLES_SQL = f"{T.BOXES_SQL}, o AS (SELECT 'F' || floor AS scope, target_id AS id, x0 * 100 AS x0, y0 * 100 AS y0, x1 * 100 AS x1, y1 * 100 AS y1 FROM boxes)"


def area_sql(source: str, name: str) -> str:
    """The union's area of boxes (scope, x0, y0, x1, y1): between all neighbouring ends, what a box covers."""
    return f"""{name}_x AS (SELECT scope, x AS a, lead(x) OVER (PARTITION BY scope ORDER BY x) AS b FROM (SELECT scope, x0 AS x FROM {source} UNION SELECT scope, x1 FROM {source})),
{name}_y AS (SELECT scope, y AS c, lead(y) OVER (PARTITION BY scope ORDER BY y) AS d FROM (SELECT scope, y0 AS y FROM {source} UNION SELECT scope, y1 FROM {source})),
{name}_c AS (SELECT DISTINCT x.scope, a, b, c, d FROM {name}_x x JOIN {name}_y y ON x.scope = y.scope JOIN {source} s ON s.scope = x.scope AND s.x0 <= a AND s.x1 >= b AND s.y0 <= c AND s.y1 >= d WHERE b IS NOT NULL AND d IS NOT NULL),
{name} AS (SELECT scope, sum((b - a) * (d - c)) AS area FROM {name}_c GROUP BY 1)"""


def polygon_union(spark: SparkSession, d: str) -> DataFrame:
    """Areas of unions, in one piece and by tiles."""
    r = ringed(obstacles(spark, d))
    whole = O.polygon_unions(r).select("scope", "polygons", F.round("area", 5).alias("area"))
    return whole.join(O.union_areas(r, 20.0).select("scope", F.round("area", 5).alias("tiled")), "scope")


POLYGON_UNION = f"WITH {OBSTACLES_SQL}, {area_sql('o', 'u')}, n AS (SELECT scope, count(*) AS polygons FROM o GROUP BY 1) SELECT scope, polygons, round(area, 5) AS area, round(area, 5) AS tiled FROM u JOIN n USING (scope)"


def free(spark: SparkSession, d: str) -> DataFrame:
    return O.free_regions(domains(spark, d), ringed(obstacles(spark, d)))


def free_regions(spark: SparkSession, d: str) -> DataFrame:
    f = O.not_all_blocked(free(spark, d))
    return f.select("scope", "blocked", *[F.round(c, 5).alias(c) for c in ("domain_area", "obstacle_area", "outside_area", "free_area")])


CLIP_SQL = f"c AS (SELECT scope, greatest(x0, -{SIDE}) AS x0, greatest(y0, -{SIDE}) AS y0, least(x1, {SIDE}) AS x1, least(y1, {SIDE}) AS y1 FROM o WHERE x0 < {SIDE} AND x1 > -{SIDE} AND y0 < {SIDE} AND y1 > -{SIDE})"
FREE_REGIONS = f"""
WITH {OBSTACLES_SQL}, {CLIP_SQL}, {area_sql('o', 'u')}, {area_sql('c', 'v')}
SELECT u.scope, false AS blocked, 4900.0::DOUBLE AS domain_area, round(coalesce(v.area, 0), 5) AS obstacle_area, round(u.area - coalesce(v.area, 0), 5) AS outside_area, round(4900 - coalesce(v.area, 0), 5) AS free_area FROM u LEFT JOIN v USING (scope)"""


def effective_free(spark: SparkSession, d: str) -> DataFrame:
    """Free space with one level connector through each floor."""
    level = floors(spark, d).select("scope", O.box_ring(F.lit(-50.0), F.lit(-1.0), F.lit(50.0), F.lit(1.0)).alias("ring"))
    return O.effective_free(free(spark, d), level).select("scope", F.round("area", 5).alias("area"))


EFFECTIVE_FREE = f"""
WITH {OBSTACLES_SQL}, {CLIP_SQL}, k AS (SELECT scope, x0, y0, x1, least(y1, -1.0) AS y1 FROM c WHERE y0 < -1 UNION ALL SELECT scope, x0, greatest(y0, 1.0), x1, y1 FROM c WHERE y1 > 1), {area_sql('k', 'v')}
SELECT f.scope, round(4900 - coalesce(v.area, 0) + 2 * 2 * 15, 5) AS area FROM (SELECT DISTINCT scope FROM o) f LEFT JOIN v USING (scope)"""


def legs(spark: SparkSession, d: str) -> DataFrame:
    """Straight ways from each target to the next by id, in hundredths."""
    w = Window.partitionBy("floor").orderBy("target_id")
    t = T.targets(spark, d).select(scope().alias("scope"), F.col("target_id").alias("edge"), (F.col("x") * 100).alias("ax"), (F.col("y") * 100).alias("ay"), (F.lead("x").over(w) * 100).alias("bx"), (F.lead("y").over(w) * 100).alias("by"))
    return t.where("bx is not null")


LEGS_SQL = f"""{T.TARGETS_SQL}, legs AS (SELECT * FROM (SELECT 'F' || floor AS scope, target_id AS edge, x * 100 AS ax, y * 100 AS ay, lead(x) OVER w * 100 AS bx, lead(y) OVER w * 100 AS by_ FROM targets WINDOW w AS (PARTITION BY floor ORDER BY target_id)) WHERE bx IS NOT NULL)"""
#: The part of a segment within a box: from the later entry to the earlier exit along either axis.
INSIDE_SQL = "least(1, greatest((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)), greatest((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay))) - greatest(0, least((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)), least((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)))"


def certified_edges(spark: SparkSession, d: str) -> DataFrame:
    e = legs(spark, d).select("scope", "edge", F.array("ax", "ay", "bx", "by").alias("path"))
    return O.certified_edges(e, free(spark, d))


CERTIFIED_EDGES = f"""
WITH {OBSTACLES_SQL}, {LEGS_SQL}, h AS (SELECT l.scope, edge, max(CAST({INSIDE_SQL} > 1e-9 AS INT)) AS hit FROM legs l JOIN o ON o.scope = l.scope GROUP BY 1, 2)
SELECT scope, edge, hit = 0 AND greatest(abs(ax), abs(bx), abs(ay), abs(by_)) <= {SIDE} AS valid FROM legs JOIN h USING (scope, edge)"""


def sheet_regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A region a floor and its two halves as buildings; every third floor's connection is trusted, every fifth's detection failed."""
    f = T.targets(spark, d).select("floor").distinct()
    regions = f.select(F.concat(F.lit("S"), "floor").alias("sheet"), scope().alias("floor"), F.lit("R01").alias("region"), F.when(F.col("floor") == 7, "sheet_bbox_fallback").otherwise("title_block").alias("source"), F.lit(0.7).alias("confidence"), O.box_ring(F.lit(-SIDE), F.lit(-SIDE), F.lit(SIDE), F.lit(SIDE)).alias("ring"))
    half = F.explode(F.array(*[F.struct(F.lit(n).alias("building"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for n, a, b in (("B01", -60.0, 0.0), ("B02", 0.0, 60.0))]))
    b = f.select("floor", half.alias("h")).select("floor", "h.*")
    buildings = b.select(
        F.concat(F.lit("S"), "floor").alias("sheet"), F.lit("R01").alias("region"), "building", O.box_ring(F.col("x0"), F.lit(-20.0), F.col("x1"), F.lit(50.0)).alias("ring"),
        O.building_scope(scope(), F.col("building"), F.lit("C 1"), F.col("floor") % 3 == 0, F.when(F.col("floor") == 3, "guessed").otherwise("Manual_Verified")).alias("scope"), F.when(F.col("floor") % 5 == 4, "ERROR").otherwise("ok").alias("status"),
        F.when(F.col("floor") % 2 == 0, "vector_validated").otherwise("vision_candidate_only").alias("validation"), F.when(F.col("building") == "B01", 0.9).alias("confidence"),
    )
    return regions, buildings


def scope_regions(spark: SparkSession, d: str) -> DataFrame:
    return O.scope_regions(*sheet_regions(spark, d)).drop("rings").withColumn("area", F.round("area", 5))


SCOPE_REGIONS = f"""
WITH f AS (SELECT DISTINCT label AS floor FROM embeddings WHERE label <> 7), b AS (SELECT floor, building FROM f, (VALUES ('B01'), ('B02')) t(building) WHERE floor % 5 <> 4)
SELECT CASE WHEN floor % 3 = 0 AND floor <> 3 THEN 'F' || floor || '__CONN_C_1' ELSE 'F' || floor || '__' || building END AS scope, 'F' || floor AS floor, 'S' || floor AS sheet, 'R01__' || building AS region, building, CASE WHEN building = 'B01' THEN 0.9::DOUBLE ELSE 0.7 END AS confidence,
  floor % 2 <> 0 AS isolation_only, 1925.0::DOUBLE AS area FROM b UNION ALL SELECT 'F' || floor, 'F' || floor, 'S' || floor, 'R01', '', 0.7, false, 4900.0 FROM f WHERE floor % 5 = 4"""


def halves(spark: SparkSession, d: str) -> DataFrame:
    """Two scopes a floor, left and right of its middle, with free space."""
    f = floors(spark, d)
    half = F.explode(F.array(*[F.struct(F.lit(n).alias("building"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for n, a, b in (("B01", -SIDE, 0.0), ("B02", 0.0, SIDE))]))
    return f.select(F.col("scope").alias("floor"), half.alias("h")).select("floor", F.concat_ws("__", "floor", "h.building").alias("scope"), "h.building", "h.x0", F.lit(-SIDE).alias("y0"), "h.x1", F.lit(SIDE).alias("y1"))


def resolved_scopes(spark: SparkSession, d: str) -> DataFrame:
    """The half of its floor that each target's box belongs to; some declare one."""
    h = halves(spark, d).select("floor", "scope", F.array(O.box_ring(*map(F.col, ("x0", "y0", "x1", "y1")))).alias("rings"))
    t = obstacles(spark, d).select(F.col("id").alias("target"), F.col("scope").alias("floor"), F.when(F.col("id") % 3 == 0, F.concat(F.col("scope"), F.lit("__B01"))).otherwise("").alias("declared"), "x0", "y0", "x1", "y1")
    return O.resolved_scopes(t, h)


RESOLVED_SCOPES = f"""
WITH {OBSTACLES_SQL}, h(b, hx0, hx1) AS (VALUES ('B01', -{SIDE}, 0.0), ('B02', 0.0, {SIDE})), j AS (SELECT id, scope || '__' || b AS s, (x0 + x1) / 2 BETWEEN hx0 AND hx1 AND (y0 + y1) / 2 BETWEEN -{SIDE} AND {SIDE} AS held,
  greatest(0, least(x1, hx1) - greatest(x0, hx0)) * greatest(0, least(y1, {SIDE}) - greatest(y0, -{SIDE})) / greatest((x1 - x0) * (y1 - y0), 1) AS share FROM o, h),
g AS (SELECT id, min(s) FILTER (held) AS inside, arg_max(s, (share, s)) FILTER (share >= 0.5) AS most FROM j GROUP BY 1) SELECT id AS target, coalesce(inside, most) AS scope FROM g"""


def corridor_links(spark: SparkSession, d: str) -> DataFrame:
    """Open boundaries between the halves of floors; even floors have a trusted connection."""
    h = halves(spark, d)
    both = h.select("scope", O.box_ring(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("ring"))
    solid = obstacles(spark, d).withColumnRenamed("scope", "floor").join(h.select("floor", "scope"), "floor").select("scope", O.box_ring(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("ring"))
    rings = O.free_regions(both, solid).select("scope", "rings")
    trusted = F.when(F.substr("floor", F.lit(2)).cast("int") % 2 == 0, F.array(F.lit("C001"))).otherwise(F.array().cast("array<string>"))
    s = h.join(rings, "scope").select("floor", "scope", F.array("building").alias("buildings"), trusted.alias("groups"), "rings", "x0", "y0", "x1", "y1")
    links = O.corridor_links(s)
    return O.merged_scopes(h, links).join(links.select("floor", F.round("open_length", 5).alias("open_length"), "least"), "floor", "left")


CORRIDOR_LINKS = f"""
WITH {OBSTACLES_SQL}, w AS (SELECT scope, greatest(y0, -{SIDE}) AS a, least(y1, {SIDE}) AS b FROM o WHERE x0 < 0 AND x1 > 0 AND y0 < {SIDE} AND y1 > -{SIDE}),
m AS (SELECT *, max(b) OVER (PARTITION BY scope ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), u AS (SELECT scope, sum(greatest(0, b - greatest(a, coalesce(reach, a)))) AS solid FROM m GROUP BY 1),
f AS (SELECT s.scope AS floor, CAST(substr(s.scope, 2) AS INT) % 2 = 0 AS trusted, 70 - coalesce(solid, 0) AS open FROM (SELECT DISTINCT scope FROM o) s LEFT JOIN u USING (scope))
SELECT floor, floor || '__' || b AS scope, CASE WHEN trusted AND open >= 1 THEN floor || '__CONN_AUTO_C001' ELSE floor || '__' || b END AS merged, CASE WHEN trusted THEN round(open, 5) END AS open_length, CASE WHEN trusted THEN 1.0::DOUBLE END AS least FROM f, (VALUES ('B01'), ('B02')) t(b)"""


def grown_boxes(o: DataFrame) -> DataFrame:
    """Boxes, grown by 10, as components or regions of their floors."""
    ring = O.box_ring(F.col("x0") - 10, F.col("y0") - 10, F.col("x1") + 10, F.col("y1") + 10)
    return o.select("scope", F.format_string("C%06d", "id").alias("component"), F.array(ring).alias("rings"), (F.col("id") % 7 / 7).alias("confidence"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth target's box, grown; component_assignment and its SQL alone take these."""
    return grown_boxes(obstacles(spark, d).where("id % 10 = 0"))


def every_part(spark: SparkSession, d: str) -> DataFrame:
    """Every target's box, grown."""
    return grown_boxes(obstacles(spark, d))


EVERY_PART_SQL = "parts AS (SELECT scope, printf('C%06d', id) AS component, x0 - 10 AS x0, y0 - 10 AS y0, x1 + 10 AS x1, y1 + 10 AS y1, id % 7 / 7 AS confidence FROM o)"
PARTS_SQL = "parts AS (SELECT scope, printf('C%06d', id) AS component, x0 - 10 AS x0, y0 - 10 AS y0, x1 + 10 AS x1, y1 + 10 AS y1, id % 7 / 7 AS confidence FROM o WHERE id % 10 = 0)"


def component_assignment(spark: SparkSession, d: str) -> DataFrame:
    t = T.targets(spark, d).select(scope().alias("scope"), F.col("target_id").alias("target"), (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    a = O.component_assignment(t, parts(spark, d))
    return a.select("scope", "target", "component", "status", F.round("distance", 6).alias("distance"))


COMPONENT_ASSIGNMENT = f"""
WITH {T.TARGETS_SQL}, {OBSTACLES_SQL}, {PARTS_SQL}, j AS (SELECT 'F' || floor AS scope, target_id AS target, component, sqrt(greatest(0, x0 - x * 100, x * 100 - x1) ** 2 + greatest(0, y0 - y * 100, y * 100 - y1) ** 2) AS distance FROM targets LEFT JOIN parts p ON p.scope = 'F' || floor)
SELECT scope, target, coalesce(arg_min(component, (distance, component)), '') AS component, CASE WHEN min(distance) IS NULL THEN 'missing_floor' WHEN min(distance) = 0 THEN 'inside_free_space' ELSE 'projected_to_free_space' END AS status, round(coalesce(min(distance), 0), 6) AS distance FROM j GROUP BY 1, 2"""

#: The distance of a segment from a box: 0 where they meet, else the least of both ends' from the box and the corners' from the segment.
_ENDS = ["sqrt(greatest(0, x0 - {0}x, {0}x - x1) ** 2 + greatest(0, y0 - {0}y{1}, {0}y{1} - y1) ** 2)".format(p, q) for p, q in (("a", ""), ("b", "_"))]
_AT = "least(1, greatest(0, (({0} - ax) * (bx - ax) + ({1} - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2)))"
_CORNERS = [f"sqrt(({cx} - ax - {_AT.format(cx, cy)} * (bx - ax)) ** 2 + ({cy} - ay - {_AT.format(cx, cy)} * (by_ - ay)) ** 2)" for cx in ("x0", "x1") for cy in ("y0", "y1")]
APART_SQL = f"CASE WHEN {INSIDE_SQL} >= 0 THEN 0 ELSE least({', '.join(_ENDS + _CORNERS)}) END"


def halo_members(spark: SparkSession, d: str) -> DataFrame:
    s = legs(spark, d).select(F.col("scope").alias("floor"), F.col("edge").alias("segment"), "ax", "ay", "bx", "by").withColumns({"bx": F.col("ax") + (F.col("bx") - F.col("ax")) / 4, "by": F.col("ay") + (F.col("by") - F.col("ay")) / 4})
    return O.halo_members(s, every_part(spark, d).select(F.col("scope").alias("floor"), F.col("component").alias("region"), "rings"))


SHORT_SQL = "s AS (SELECT scope, edge, ax, ay, ax + (bx - ax) / 4 AS bx, ay + (by_ - ay) / 4 AS by_ FROM legs)"
HALO_MEMBERS = f"""
WITH {OBSTACLES_SQL}, {EVERY_PART_SQL}, {LEGS_SQL}, {SHORT_SQL} SELECT s.scope AS floor, component AS region, edge AS segment FROM s JOIN parts p ON p.scope = s.scope WHERE {APART_SQL} <= 0.75 * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) + 1e-9"""


def segment_owners(spark: SparkSession, d: str) -> DataFrame:
    """Which component of its floor owns each quarter of a leg."""
    s = legs(spark, d).select(F.col("scope").alias("drawing"), F.col("edge").alias("segment"), F.when(F.col("edge") % 11 == 0, "C000010").otherwise("").alias("declared"), "ax", "ay", "bx", "by").withColumns({"bx": F.col("ax") + (F.col("bx") - F.col("ax")) / 4, "by": F.col("ay") + (F.col("by") - F.col("ay")) / 4})
    return O.segment_owners(s, every_part(spark, d).select(F.col("scope").alias("drawing"), F.col("component").alias("floor"), "rings", "confidence"))


SEGMENT_OWNERS = f"""
WITH {OBSTACLES_SQL}, {EVERY_PART_SQL}, {LEGS_SQL}, {SHORT_SQL}, j AS (SELECT s.*, component, confidence, greatest(0, {INSIDE_SQL}) * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS length, (ax + bx) / 2 BETWEEN x0 AND x1 AND (ay + by_) / 2 BETWEEN y0 AND y1 AS middle, {APART_SQL} AS apart, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) * 0.75 AS reach FROM s JOIN parts p ON p.scope = s.scope),
g AS (SELECT scope, edge, max(CASE WHEN edge % 11 = 0 AND component = 'C000010' THEN component END) AS declared, arg_min(component, (-round(length, 9), NOT middle, -confidence, component)) FILTER (length > 1e-9 OR middle) AS direct, arg_min(component, (apart, component)) FILTER (apart <= reach + 1e-9) AS near FROM j GROUP BY 1, 2)
SELECT edge AS segment, coalesce(declared, direct, near) AS owner FROM g"""


def pair_owners(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as cores and the same grown by 4 as wholes, by component."""
    o = obstacles(spark, d)
    p = o.select(F.col("scope").alias("floor"), F.col("id").alias("pair"), O.box_ring(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("core"), O.box_ring(F.col("x0") - 4, F.col("y0") - 4, F.col("x1") + 4, F.col("y1") + 4).alias("full"))
    r = O.pair_owners(p, every_part(spark, d).select(F.col("scope").alias("floor"), F.col("component").alias("region"), "rings", "confidence"))
    return r.withColumn("outputs", F.array_join("outputs", ","))


PAIR_OWNERS = f"""
WITH {OBSTACLES_SQL}, {EVERY_PART_SQL}, j AS (SELECT o.id, component, confidence, greatest(0, least(o.x1, p.x1) - greatest(o.x0, p.x0)) * greatest(0, least(o.y1, p.y1) - greatest(o.y0, p.y0)) AS core, greatest(0, least(o.x1 + 4, p.x1) - greatest(o.x0 - 4, p.x0)) * greatest(0, least(o.y1 + 4, p.y1) - greatest(o.y0 - 4, p.y0)) AS whole,
  (o.x0 + o.x1) / 2 BETWEEN p.x0 AND p.x1 AND (o.y0 + o.y1) / 2 BETWEEN p.y0 AND p.y1 AS centre FROM o JOIN parts p ON p.scope = o.scope),
g AS (SELECT id, arg_min(component, (NOT centre, -round(core, 9), -confidence, component)) FILTER (core > 1e-9) AS c, list_sort(list(component) FILTER (core > 1e-9)) AS cs, arg_min(component, (NOT centre, -round(whole, 9), -confidence, component)) FILTER (whole > 1e-9) AS w, list_sort(list(component) FILTER (whole > 1e-9)) AS ws FROM j GROUP BY 1)
SELECT id AS pair, CASE WHEN c IS NOT NULL THEN 'core' WHEN w IS NOT NULL THEN 'topology_only' ELSE 'halo_ghost' END AS routing, coalesce(c, w, '') AS owner, coalesce(array_to_string(coalesce(cs, ws), ','), '') AS outputs FROM g"""


def cut_regions(spark: SparkSession, d: str) -> DataFrame:
    """Floors' domains cut by a level and an upright portal, and the faces that each portal divides."""
    whole = domains(spark, d).select("scope", F.array("ring").alias("rings"))
    cuts = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("portal"), *[F.lit(v).alias(c) for c, v in zip(("ax", "ay", "bx", "by"), at, strict=True)]) for n, at in ((1, (-SIDE, 5.0, SIDE, 5.0)), (2, (0.0, -SIDE, 0.0, 5.0)), (3, (20.0, 20.0, 21.0, 20.0)))]))
    portals = floors(spark, d).select("scope", cuts.alias("p")).select("scope", "p.*")
    faces = O.cut_regions(whole, portals, 0.5, 10.0)
    pairs = O.portal_regions(portals, faces, 0.8)
    a = pairs.select("scope", F.concat_ws("-", F.lit("portal"), F.col("portal").cast("string")).alias("name"), F.concat_ws("|", F.col("area_a").cast("string"), F.col("area_b").cast("string")).alias("value"))
    return a.unionByName(faces.select("scope", F.concat_ws("-", F.lit("face"), F.col("face").cast("string")).alias("name"), F.format_string("%.4f", "area").alias("value")))


CUT_REGIONS = """
WITH f AS (SELECT DISTINCT 'F' || label AS scope FROM embeddings), v(name, value) AS (VALUES ('face-1', '2064.0000'), ('face-2', '1362.7500'), ('face-3', '1362.7500'), ('portal-1', '1|2'), ('portal-2', '2|3'), ('portal-3', '')) SELECT * FROM f, v"""


def capped_portals(spark: SparkSession, d: str) -> DataFrame:
    """Parts as portals of their types' scopes, the 100 surest of each."""
    p = T.load(spark, d, "part").select(F.col("p_type").alias("scope"), F.col("p_partkey").alias("portal"), (F.col("p_size") % 9 / 9).alias("confidence"), F.col("p_retailprice").alias("width"))
    return O.capped_portals(p, 100).select("scope", "portal", "number")


CAPPED_PORTALS = "SELECT * FROM (SELECT p_type AS scope, p_partkey AS portal, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size % 9 / 9 DESC, p_retailprice, p_partkey) AS INT) AS number FROM part) WHERE number <= 100"


def wall_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Line items as hits of a supplier's edge: where its outer wall lies."""
    l = T.load(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("edge"), F.col("l_orderkey").alias("sample"), F.when(F.col("l_partkey") % 3 > 0, (F.col("l_quantity") + F.col("l_suppkey") % 40).cast("int")).alias("offset"))  # noqa: E741
    return O.offset_histogram(l, 100)


WALL_OFFSETS = """
WITH h AS (SELECT l_suppkey % 40 AS edge, l_orderkey AS sample, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_quantity + l_suppkey % 40 AS INT) END AS o FROM lineitem), n AS (SELECT edge, count(DISTINCT sample) AS samples FROM h GROUP BY 1),
m AS (SELECT edge, sample, min(o) AS o FROM h WHERE o IS NOT NULL GROUP BY 1, 2), s AS (SELECT edge, p, count(*) AS c FROM m, range(0, 101) t(p) WHERE abs(o - p) <= 3 GROUP BY 1, 2), b AS (SELECT edge, arg_min(p, (-c, p)) AS dom FROM s GROUP BY 1),
u AS (SELECT n.edge, samples, dom, (SELECT count(*) FROM m WHERE m.edge = n.edge AND abs(m.o - dom) <= 4) AS supported FROM n LEFT JOIN b USING (edge)), x AS (SELECT *, coalesce(supported / samples >= 0.04, false) AS snapped FROM u)
SELECT edge, samples, CAST(CASE WHEN snapped OR supported >= greatest(12, ceil(samples * 0.015)) THEN dom ELSE 0 END AS INT) AS "offset", supported, snapped, NOT snapped AND supported >= greatest(12, ceil(samples * 0.015)) AS inferred FROM x"""


def closed_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Closed outer walls of upper floors' domains, moved to cells of a made-up wall with a gap."""
    b = floors(spark, d).select("scope", F.col("scope").alias("floor"), O.box_ring(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0)).alias("ring"))
    k = F.explode(F.sequence(F.lit(10), F.lit(90)))
    w = floors(spark, d).select("scope", k.alias("k"))
    walls = w.select("scope", F.col("k").alias("cx"), F.lit(10).alias("cy")).union(w.select("scope", "k", F.lit(90))).union(w.where("k <= 40 or k > 60").select("scope", F.lit(10), "k")).union(w.select("scope", F.lit(90), "k"))
    return O.closed_envelopes(b, walls, 1.0).select("scope", "snapped", "inferred", "fallback", F.round("area", 5).alias("area"))


CLOSED_ENVELOPES = "SELECT DISTINCT 'F' || label AS scope, 4 AS snapped, 0 AS inferred, 0 AS fallback, CAST(93 * 93 - 79 * 79 AS DOUBLE) AS area FROM embeddings WHERE label >= 3"

_NAMES = "polygon_union free_regions effective_free certified_edges scope_regions resolved_scopes corridor_links component_assignment halo_members segment_owners pair_owners cut_regions capped_portals wall_offsets closed_envelopes".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
