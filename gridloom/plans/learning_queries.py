"""Queries over floors as graphs, recommendations, walls, and loosely typed cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rows as R
from ..operators import learning as L
from ..operators import skeleton as K
from ..operators import spatial as J
from ..operators import walls as W
from ..sources import tables as T
from ..streaming import visits as V
from . import overlay_queries as Q
from .graph_queries import near_edges, near_sql
from .join_queries import PARALLEL_SQL, segments

#: Three rules: name, mandatory, quota, categories.
RULES = [("r0", True, 1, ["c0", "c1"]), ("r1", False, 6, ["c2"]), ("r2", True, 2, ["c3", "c9"])]


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Targets of eleven areas, six categories and four rules, one of them unknown; portals join neighbouring areas."""
    i = F.col("target_id")
    text = lambda letter, n: F.concat(F.lit(letter), (i % n).cast("string"))
    t = T.targets(spark, d).select(
        "floor", i.alias("target"), "x", "y", (i % 11).cast("int").alias("area"), F.when(i % 6 == 5, "").otherwise(text("c", 6)).alias("category"), text("r", 4).alias("rule"), (i % 10 / 10).alias("confidence"),
        (i % 5 == 0).alias("virtual"), (i % 4 * 0.01).alias("access"),
    )
    areas = t.groupBy("floor", "area").agg(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.first("area") * 1.0).alias("size"), F.lit(2).alias("portals"))
    portals = areas.where("area < 10").select("floor", F.col("area").alias("portal"), F.col("area").alias("area_a"), (F.col("area") + 1).alias("area_b"), F.lit(0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.02).alias("width"), F.lit(0.01).alias("clearance"), F.lit(0.5).alias("bottleneck"), F.lit(0.9).alias("confidence"))
    rules = spark.createDataFrame(RULES, "rule string, mandatory boolean, quota int, categories array<string>")
    return L.floor_graph(t, areas, rules, portals, 0.1, 16)


GRAPH_SQL = f"""{T.TARGETS_SQL}, t AS (SELECT floor, target_id AS i, x, y, target_id % 11 AS area, CASE WHEN target_id % 6 = 5 THEN '' ELSE 'c' || (target_id % 6) END AS category, 'r' || (target_id % 4) AS rule, target_id % 10 / 10.0 AS confidence FROM targets),
areas AS (SELECT DISTINCT floor, area FROM t), rules AS (SELECT * FROM (VALUES ('r0', ['c0', 'c1'], 1), ('r1', ['c2'], 6), ('r2', ['c3', 'c9'], 2)) AS r(rule, cats, quota)),
ports AS (SELECT floor, area FROM areas WHERE area < 10), cats AS (SELECT floor, category, count(*) AS n FROM t WHERE category <> '' GROUP BY 1, 2), floors AS (SELECT DISTINCT floor FROM t),
scale AS (SELECT floor, least(min(x), 0) AS x0, greatest(greatest(max(x), 0.1) - least(min(x), 0), greatest(max(y), 0) - least(min(y), 0), 1) AS scale FROM t GROUP BY 1),
near AS (SELECT * FROM (SELECT a.floor, a.i, b.i AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / scale AS dist, row_number() OVER (PARTITION BY a.i ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.i) AS k
  FROM t a JOIN t b ON a.floor = b.floor AND a.i <> b.i JOIN scale s ON s.floor = a.floor WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / scale <= 0.1) WHERE k <= 16),
one AS (
  SELECT floor, 'target::' || i AS src, 'area::' || area AS dst, 'LOCATED_IN_AREA' AS relation, 'CONTAINS_TARGET' AS back, 0.0 AS dist, 0.0 AS decay, 0.0 AS width FROM t
  UNION ALL SELECT floor, 'target::' || i, 'category::' || category, 'INSTANCE_OF_CATEGORY', 'HAS_INSTANCE', 0, 0, 0 FROM t WHERE category <> ''
  UNION ALL SELECT floor, 'target::' || i, 'rule::' || rule, 'GOVERNED_BY_RULE', 'APPLIES_TO_TARGET', 0, 0, 0 FROM t WHERE rule <> 'r3'
  UNION ALL SELECT floor, 'floor', 'rule::' || rule, 'HAS_RULE', 'IN_FLOOR', 0, 0, 0 FROM floors, rules
  UNION ALL SELECT floor, 'rule::' || rule, 'category::' || category, 'APPLIES_TO_CATEGORY', 'GOVERNED_BY_RULE', 0, 0, 0 FROM cats JOIN rules ON list_contains(cats, category)
  UNION ALL SELECT floor, 'floor', 'area::' || area, 'CONTAINS_AREA', 'IN_FLOOR', 0, 0, 0 FROM areas
  UNION ALL SELECT floor, 'floor', 'category::' || category, 'HAS_CATEGORY', 'IN_FLOOR', 0, 0, 0 FROM cats
  UNION ALL SELECT p.floor, 'area::' || (area + k), 'portal::' || area, 'CONNECTED_VIA_PORTAL', 'CONNECTS_AREA', 0, 0, 0.02 / scale FROM ports p JOIN scale s ON s.floor = p.floor, range(2) AS r(k)),
e AS (SELECT floor, src, dst, relation, dist, decay, width FROM one UNION ALL SELECT floor, dst, src, back, dist, decay, width FROM one UNION ALL SELECT floor, 'target::' || i, 'target::' || j, 'NEAR_TARGET', dist, exp(-dist / 0.1), 0 FROM near)"""


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    at = lambda name: F.round(F.sum(F.col("values")[L.EDGE_FEATURES.index(name)]), 5).alias(name)
    return graph(spark, d)[1].groupBy("floor", "relation").agg(F.count("*").alias("n"), at("distance"), at("decay"), at("width"))


GRAPH_EDGES = f"WITH {GRAPH_SQL} SELECT floor, relation, count(*) AS n, round(sum(dist), 5)::DOUBLE AS distance, round(sum(decay), 5)::DOUBLE AS decay, round(sum(width), 5)::DOUBLE AS width FROM e GROUP BY 1, 2"


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    at = lambda name: F.round(F.sum(F.col("features")[L.NODE_FEATURES.index(name)]), 5).alias(name)
    return graph(spark, d)[0].groupBy("floor", "type").agg(F.count("*").alias("n"), *map(at, ("degree", "recognition_confidence", "area_fraction", "category_share", "rule_quota", "present")))


GRAPH_NODES = f"""WITH {GRAPH_SQL}, total AS (SELECT floor, greatest(sum(area), 0) AS size FROM areas GROUP BY 1), many AS (SELECT floor, count(*) AS m FROM t GROUP BY 1),
n AS (
  SELECT floor, 'target::' || i AS node, 'InspectionTarget' AS type, confidence AS rc, 0.0 AS af, 0.0 AS cs, 0.0 AS rq FROM t
  UNION ALL SELECT a.floor, 'area::' || area, 'AreaRegion', 0, area / CASE WHEN size > 0 THEN size ELSE 1 END, 0, 0 FROM areas a JOIN total USING (floor)
  UNION ALL SELECT floor, 'portal::' || area, 'Portal', 0, 0, 0, 0 FROM ports
  UNION ALL SELECT c.floor, 'category::' || category, 'InspectionCategory', 0, 0, c.n / m, 0 FROM cats c JOIN many USING (floor)
  UNION ALL SELECT floor, 'rule::' || rule, 'InspectionRule', 0, 0, 0, least(1, quota / 4) FROM floors, rules
  UNION ALL SELECT floor, 'floor', 'FloorContext', 0, 0, 0, 0 FROM floors),
g AS (SELECT floor, node, count(*) AS deg FROM (SELECT floor, src AS node FROM e UNION ALL SELECT floor, dst FROM e) GROUP BY 1, 2),
k AS (SELECT n.*, coalesce(deg, 0) AS deg, greatest(ln(1 + max(coalesce(deg, 0)) OVER (PARTITION BY n.floor)), 1) AS top FROM n LEFT JOIN g ON g.floor = n.floor AND g.node = n.node)
SELECT floor, type, count(*) AS n, round(sum(ln(1 + deg) / top), 5)::DOUBLE AS degree, round(sum(rc), 5)::DOUBLE AS recognition_confidence, round(sum(af), 5)::DOUBLE AS area_fraction, round(sum(cs), 5)::DOUBLE AS category_share,
  round(sum(rq), 5)::DOUBLE AS rule_quota, count(*)::DOUBLE AS present FROM k GROUP BY 1, 2"""


def weights(shapes: dict[str, tuple[int, ...]], seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}


DIM = 8


def gated_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Two gated layers over the floors' graphs and a selection head, with weights of a fixed seed."""
    nodes, edges = graph(spark, d)
    types, words = ["InspectionTarget", "AreaRegion", "Portal", "InspectionCategory", "InspectionRule", "FloorContext"], [f"c{k}" for k in range(6)]
    names = sorted({*L.RELATIONS, *L.RELATIONS.values(), "NEAR_TARGET"})
    f = len(L.NODE_FEATURES)
    first = weights({"type": (len(types), DIM), "category": (len(words) + 1, DIM), "features.0.weight": (f, DIM), "features.0.bias": (DIM,)}, 1)
    h = L.embedded(nodes, first, types, words)
    for k in (2, 3):
        shapes = {f"relation.{r}": (DIM, DIM) for r in names} | {f"gate.{r}.0.weight": (2 * len(L.EDGE_FEATURES), 1) for r in names} | {f"gate.{r}.0.bias": (1,) for r in names}
        w = weights(shapes | {"self.0.weight": (DIM, DIM), "self.0.bias": (DIM,)}, k) | {"norm.weight": np.ones(DIM), "norm.bias": np.zeros(DIM)}
        h = L.gated_layer(h, edges, w, names, DIM)
    head = weights({"selection.0.weight": (DIM, 4), "selection.0.bias": (4,), "selection.1.weight": (4, 1), "selection.1.bias": (1,)}, 4) | {"selection.mean": np.zeros(DIM), "selection.std": np.ones(DIM)}
    scored = L.head_scores(h.where(F.col("node").startswith("target::")), "h", head, "selection", "score")
    return scored.select("floor", "node", F.round("score", 5).alias("score"))


def learned(spark: SparkSession, d: str) -> DataFrame:
    return T.targets(spark, d).where("target_id % 4 <> 0").select("floor", F.col("target_id").alias("target"), (F.col("target_id") % 17 / 17).alias("score"))


def recommended_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = near_edges(spark, d).select("floor", (F.col("target_id") % 3).alias("requirement"), F.col("target_id").alias("left"), F.col("other_id").alias("right"), (F.round(1 - F.col("distance") * 10, 4)).alias("pair_score"))
    return L.pair_recommendations(p, learned(spark, d)).select("floor", "requirement", "left", "right", F.round("score", 6).alias("score"), "rank")


RECOMMENDED_PAIRS = f"""WITH {near_sql(0.03)}, s AS (SELECT target_id, CASE WHEN target_id % 4 <> 0 THEN target_id % 17 / 17 ELSE 0 END AS score FROM targets),
p AS (SELECT n.floor, n.target_id % 3 AS requirement, n.target_id AS l, other_id AS r, 0.5 * round(1 - distance * 10, 4) + 0.5 * (a.score + b.score) / 2 AS score FROM near n JOIN s a ON a.target_id = n.target_id JOIN s b ON b.target_id = other_id WHERE n.target_id < other_id)
SELECT * FROM (SELECT floor, requirement, l AS "left", r AS "right", round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY floor, requirement ORDER BY score DESC, l, r) AS INT) AS rank FROM p) WHERE rank <= 20"""


def recommendation_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = T.targets(spark, d).select("floor", F.col("target_id").alias("target"), F.when(F.col("target_id") % 8 != 0, F.col("target_id") % 13 / 13).alias("u_rule"))
    view = L.recommendation_view(c, learned(spark, d)).groupBy("floor").agg(F.round(F.sum("score"), 5).alias("score"), F.count_if(F.col("source") == "rule_value").alias("by_rule"))
    return view.join(L.coverage(c, learned(spark, d)), "floor")


RECOMMENDATION_COVERAGE = "SELECT label AS floor, round(sum(CASE WHEN vec_id % 4 <> 0 THEN vec_id % 17 / 17 WHEN vec_id % 8 <> 0 THEN vec_id % 13 / 13 ELSE 0 END), 5) AS score, count(*) FILTER (vec_id % 4 = 0) AS by_rule, count(*) AS candidates, count(*) FILTER (vec_id % 4 <> 0) AS scored, bool_and(vec_id % 4 <> 0) AS complete FROM embeddings GROUP BY 1"


def likely_successors(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest next targets among the nearest 20, with a transition head of fixed weights over vectors of four."""
    e = T.load(spark, d, "embeddings")
    cut = lambda a, b: F.transform(F.slice("embedding", a, b), lambda v: v.cast("double"))
    t = e.select(F.col("label").alias("floor"), F.col("vec_id").alias("target"), cut(1, 4).alias("embedding"), cut(5, 2).alias("context"), F.concat(F.lit("k"), F.col("vec_id") % 3).alias("component"))
    steps = J.nearest(J.near_pairs(T.targets(spark, d), 0.1), 20).select("floor", F.col("target_id").alias("src"), F.col("other_id").alias("dst"))
    w = weights({"transition.0.weight": (20, 6), "transition.0.bias": (6,), "transition.1.weight": (6, 1), "transition.1.bias": (1,)}, 5) | {"transition.mean": np.zeros(20), "transition.std": np.ones(20)}
    return L.successors(t, steps, w, 5).select("floor", "src", "dst", F.round("score", 6).alias("score"), "rank")


def bands(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return W.pair_bands(J.parallel_pairs(s), s)


def wall_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands of parallel pairs: intervals along the left segment, offsets across it, area."""
    b = bands(spark, d).where("ring is not null")
    return b.select("floor", "left_id", "right_id", *[F.round(c, 6).alias(c) for c in ("along_from", "along_to", "across_from", "across_to", "width")], F.round((F.col("along_to") - F.col("along_from")) * F.col("width"), 6).alias("area"))


BANDS_SQL = f"""{PARALLEL_SQL}, d AS (SELECT p.floor, left_id, right_id, s.ax AS sax, s.ay AS say, s.bx AS sbx, s.by_ AS sby, r.ax AS rax, r.ay AS ray, r.bx AS rbx, r.by_ AS rby, (s.bx - s.ax) / s.length AS ux, (s.by_ - s.ay) / s.length AS uy
  FROM pairs p JOIN segments s ON s.seg_id = left_id JOIN segments r ON r.seg_id = right_id),
f AS (SELECT *, CASE WHEN ux < 0 OR abs(ux) < 1e-9 AND uy < 0 THEN -1 ELSE 1 END AS g FROM d), u AS (SELECT * REPLACE (ux * g AS ux, uy * g AS uy) FROM f),
v AS (SELECT *, sax * ux + say * uy AS s1, sbx * ux + sby * uy AS s2, rax * ux + ray * uy AS r1, rbx * ux + rby * uy AS r2, (say * ux - sax * uy + sby * ux - sbx * uy) / 2 AS sv, (ray * ux - rax * uy + rby * ux - rbx * uy) / 2 AS rv FROM u),
b AS (SELECT floor, left_id, right_id, ux, uy, greatest(least(s1, s2), least(r1, r2)) AS along_from, least(greatest(s1, s2), greatest(r1, r2)) AS along_to, least(sv, rv) AS across_from, greatest(sv, rv) AS across_to FROM v),
bands AS (SELECT *, across_to - across_from AS width FROM b WHERE along_to > along_from AND across_to > across_from)"""
WALL_BANDS = f"WITH {BANDS_SQL} SELECT floor, left_id, right_id, round(along_from, 6) AS along_from, round(along_to, 6) AS along_to, round(across_from, 6) AS across_from, round(across_to, 6) AS across_to, round(width, 6) AS width, round((along_to - along_from) * width, 6) AS area FROM bands"


def periodic_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within arrays of three and more lines, at a pitch within a quarter."""
    return W.periodic_arrays(segments(spark, d), 3, 0.25, 0.3)


PERIODIC_ARRAYS = f"""WITH {BANDS_SQL}, m AS (SELECT b.floor, left_id, right_id, (CAST(least(floor(s.angle / 5), 35) AS INT) - CAST(least(floor(l.angle / 5), 35) AS INT) + 36) % 36 AS turn,
  least(along_to, greatest(s.ax * ux + s.ay * uy, s.bx * ux + s.by_ * uy)) - greatest(along_from, least(s.ax * ux + s.ay * uy, s.bx * ux + s.by_ * uy)) AS shared, along_to - along_from AS own,
  ((s.ay * ux - s.ax * uy + s.by_ * ux - s.bx * uy) / 2 - across_from) / width AS place FROM bands b JOIN segments s ON s.floor = b.floor JOIN segments l ON l.seg_id = left_id),
runs AS (SELECT floor, left_id, right_id, list_distinct(list(CAST(round(place) AS INT))) AS steps FROM m WHERE turn IN (0, 1, 35) AND shared >= 0.3 * own AND abs(place - round(place)) <= 0.25 AND abs(round(place)) <= 3 GROUP BY 1, 2, 3)
SELECT floor, left_id, right_id FROM runs WHERE list_min(list_filter(range(0, 5), lambda x: NOT list_contains(steps, x))) - list_max(list_filter(range(-4, 0), lambda x: NOT list_contains(steps, x))) - 1 >= 3"""


def small_boxes(spark: SparkSession, d: str) -> DataFrame:
    return T.targets(spark, d).select(Q.scope().alias("scope"), "x", "y", (F.col("x") + 0.02).alias("x1"), (F.col("y") + 0.02).alias("y1"))


def linework_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of the outlines of small boxes about targets that the boxes cover: together the boxes' union."""
    b = small_boxes(spark, d)
    edge = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("ax", "ay", "bx", "by"), strict=True)])
    lines = b.select("scope", F.explode(F.array(edge("x", "y", "x1", "y"), edge("x1", "y", "x1", "y1"), edge("x1", "y1", "x", "y1"), edge("x", "y1", "x", "y"))).alias("e")).select("scope", "e.*")
    cores = b.select("scope", Q.O.box_ring(*map(F.col, ("x", "y", "x1", "y1"))).alias("ring"))
    return W.wall_faces(lines, cores).groupBy("scope").agg(F.round(F.sum("area"), 5).alias("area"))


LINEWORK_FACES = f"WITH {T.TARGETS_SQL}, o AS (SELECT 'F' || floor AS scope, x AS x0, y AS y0, x + 0.02 AS x1, y + 0.02 AS y1 FROM targets), {Q.area_sql('o', 'u')} SELECT scope, round(area, 5) AS area FROM u"


def wall_records(spark: SparkSession, d: str) -> DataFrame:
    """Obstacle records of matched wall pairs."""
    return W.wall_obstacles(segments(spark, d)).select("floor", "obstacle", "kind", "source", "left_id", "right_id", F.round("width", 6).alias("width"), F.round("area", 6).alias("area"), "supported")


def free_components(spark: SparkSession, d: str) -> DataFrame:
    return K.components(Q.free(spark, d).select("scope", "rings")).where("area > 20")


def skeleton_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the floors' skeletons."""
    return K.navigation_graph(free_components(spark, d), 0.5).select("scope", "component", "node_a", "node_b", "kind", F.round("length", 4).alias("length"))


def portal_bottlenecks(spark: SparkSession, d: str) -> DataFrame:
    return K.portals(free_components(spark, d), 0.5).select("scope", "component", "portal", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "confidence")], "reason")


def geometry_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of lines and polygons, some malformed or missing: undashed open segments, their length, and polygons."""
    v = lambda k: T.component(k)
    at = lambda a, b: F.array(v(a), v(b))
    n = F.col("vec_id") % 5
    line = F.when(n == 4, F.array(at(0, 1), at(0, 1), at(2, 3))).otherwise(F.array(at(0, 1), at(2, 3), at(4, 5)))
    ring = F.when(n == 3, F.array(at(0, 1), at(2, 3), at(4, 5))).otherwise(F.array(at(0, 1), at(2, 3), at(4, 5), at(0, 1)))
    cell = F.to_json(F.struct(F.array(line).alias("lines"), F.array(ring).alias("polygons")))
    e = T.load(spark, d, "embeddings").select("vec_id", F.when(n == 1, "oops").when(n != 2, cell).alias("cell"), F.when(n == 3, "CIRCLE").otherwise("LINE").alias("kind"), v(0).alias("x"), v(1).alias("y"))
    closed, shown = F.when(F.col("vec_id") % 7 == 0, "1").otherwise("0"), F.lit(False)
    cut = R.open_segments(F.col("cell"), F.col("kind"), closed, shown)
    polygons = R.polygons_of(F.col("cell"), F.col("kind"), F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)
    length = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.hypot(s["bx"] - s["ax"], s["by"] - s["ay"]))
    return e.select("vec_id", cut.alias("s"), F.size(polygons).alias("polygons")).select("vec_id", F.size("s").alias("segments"), F.round(length, 6).alias("length"), "polygons")


GEOMETRY_CELLS = """
WITH e AS (SELECT vec_id, vec_id % 5 AS n, vec_id % 7 = 0 AS closed, list_transform(embedding[1:6], lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT *, CASE WHEN v[1] = v[3] AND v[2] = v[4] THEN 0 ELSE 1 END AS a, CASE WHEN n = 4 OR v[3] = v[5] AND v[4] = v[6] THEN 0 ELSE 1 END AS b, n IN (0, 4) AND NOT closed AS used FROM e)
SELECT vec_id, CAST(CASE WHEN used THEN a + b ELSE 0 END AS INT) AS segments, round(CASE WHEN used THEN sqrt((v[3] - v[1]) ** 2 + (v[4] - v[2]) ** 2) + CASE WHEN n = 4 THEN 0 ELSE sqrt((v[5] - v[3]) ** 2 + (v[6] - v[4]) ** 2) END ELSE 0 END, 6) AS length,
  CAST(CASE WHEN n = 3 THEN 1 WHEN n IN (0, 4) AND abs((v[3] - v[1]) * (v[6] - v[2]) - (v[5] - v[1]) * (v[4] - v[2])) > 0 THEN 1 ELSE 0 END AS INT) AS polygons FROM l"""


def distance_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Distances in three layouts; every seventh has none, some are negative."""
    i, w = F.col("target_id"), F.when(F.col("target_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.round("x", 6))
    a, b = i.cast("string"), (i + 1).cast("string")
    grid = F.to_json(F.struct(F.array(a, b).alias("target_ids"), F.array(F.array(F.lit(0.0), F.lit(None).cast("double")), F.array(w, F.lit(0.0))).alias("distances")))
    nested = F.to_json(F.struct(F.create_map(a, F.create_map(b, F.coalesce(w.cast("string"), F.lit("inf")))).alias("distance_matrix")))
    listed = F.to_json(F.struct(F.array(F.struct(a.alias("source"), b.alias("target"), w.alias("length"), F.when(i % 2 == 0, "true").otherwise("0").alias("reachable"))).alias("pairs")))
    cell = F.when(i % 3 == 0, grid).when(i % 3 == 1, nested).otherwise(listed)
    r = R.distance_rows(T.targets(spark, d).withColumn("cell", cell), "floor", "cell")
    return r.select("floor", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "distance")


DISTANCE_LAYOUTS = f"""
WITH {T.TARGETS_SQL}, t AS (SELECT floor, target_id AS i, CASE WHEN target_id % 7 <> 0 THEN round(x, 6) END AS w FROM targets),
e AS (SELECT floor, i AS src, i AS dst, 0.0::DOUBLE AS distance FROM t WHERE i % 3 = 0 UNION SELECT floor, i + 1, i + 1, 0.0 FROM t WHERE i % 3 = 0 UNION SELECT floor, i + 1, i, w FROM t WHERE i % 3 = 0
  UNION SELECT floor, i, i + 1, w FROM t WHERE i % 3 = 1 UNION SELECT floor, i, i + 1, w FROM t WHERE i % 3 = 2 AND i % 2 = 0 UNION SELECT floor, i + 1, i, w FROM t WHERE i % 3 = 2 AND i % 2 = 0)
SELECT floor, src, dst, distance FROM e WHERE distance >= 0"""


def building_detections(spark: SparkSession, d: str) -> DataFrame:
    """Answers with three buildings by a part's size: one by its box, one by its polygon, one by neither."""
    s = F.col("p_size").cast("string")
    text = F.lit('Sure: ```json {"buildings": [{"bbox_1000": [S, 10, 1S, 1300], "confidence": "0.4"}, {"building_id": "X", "polygon": [[S, S], [9S, S], [S, 950]], "confidence": 3, "label": " east "}, {"confidence": 0.3}]}```')
    rows = T.load(spark, d, "part").select("p_partkey", F.replace(text, F.lit("S"), s).alias("answer"), F.lit(2000).alias("w"), F.lit(1000).alias("h"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("A栋"))).otherwise(F.array(F.lit("A栋"), F.lit("B栋"))).alias("labels"))
    return R.detections(rows, "answer", "w", "h", "labels").select("p_partkey", "building_index", "building_id", "name_text", "confidence", "x0", "y0", "x1", "y1", "review_reason", "needs_review")


BUILDING_DETECTIONS = """
WITH p AS (SELECT p_partkey, p_size AS s, CAST('1' || p_size AS DOUBLE) AS o, CAST('9' || p_size AS DOUBLE) AS n, p_partkey % 2 = 0 AS few FROM part)
SELECT p_partkey, 1 AS building_index, 'B01' AS building_id, 'A栋' AS name_text, 0.4::DOUBLE AS confidence, round(least(s, o) * 2.0, 3)::DOUBLE AS x0, 10.0::DOUBLE AS y0, round(greatest(s, o) * 2.0, 3)::DOUBLE AS x1, 1000.0::DOUBLE AS y1,
  CASE WHEN few THEN 'count_differs_from_title;low_confidence' ELSE 'low_confidence' END AS review_reason, true AS needs_review FROM p
UNION ALL SELECT p_partkey, 2, 'X', 'east', 1.0, round(s * 2.0, 3)::DOUBLE, round(s * 1.0, 3)::DOUBLE, round(n * 2.0, 3), 950.0, CASE WHEN few THEN 'count_differs_from_title' ELSE '' END, few FROM p"""


def sliding_event_windows(spark: SparkSession, d: str) -> DataFrame:
    return V.sliding_counts(T.load(spark, d, "events").select("ts", "event_type", "value"))


SLIDING_EVENT_WINDOWS = "SELECT CAST(epoch(date_trunc('day', ts) - to_days(CAST(k AS INT))) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events, range(2) AS r(k) GROUP BY 1, 2"

_NAMES = """graph_edges graph_nodes gated_embeddings recommended_pairs recommendation_coverage likely_successors wall_bands periodic_arrays linework_faces wall_records skeleton_graph portal_bottlenecks
geometry_cells distance_layouts building_detections sliding_event_windows""".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
