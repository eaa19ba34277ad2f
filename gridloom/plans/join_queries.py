"""Queries over spatial and keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import lookups as L
from ..operators import spatial as J
from ..sources import tables as T


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth target's box, grown, is a region of its floor."""
    b = T.target_boxes(spark, d).where(F.col("target_id") % 10 == 0)
    return b.select("floor", F.col("target_id").alias("region_id"), B.inflate(F.col("b"), 0.1).alias("b"))


REGIONS_SQL = "regions AS (SELECT floor, target_id AS region_id, x0 - 0.1 AS x0, y0 - 0.1 AS y0, x1 + 0.1 AS x1, y1 + 0.1 AS y1 FROM boxes WHERE target_id % 10 = 0)"


def containment_join(spark: SparkSession, d: str) -> DataFrame:
    return J.smallest_region(T.targets(spark, d), regions(spark, d), 0.25)


CONTAINMENT_JOIN = f"""
WITH {T.TARGETS_SQL}, {T.BOXES_SQL}, {REGIONS_SQL}, j AS (SELECT t.floor, target_id, region_id, (x1 - x0) * (y1 - y0) AS a FROM targets t JOIN regions r ON t.floor = r.floor AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)
SELECT floor, target_id, arg_min(region_id, (a, region_id)) AS region_id, count(*) AS n_covering FROM j GROUP BY 1, 2"""


def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    rows = T.target_boxes(spark, d).select("floor", F.col("target_id").alias("left_id"), F.col("b").alias("p"))
    return J.best_overlap(rows, regions(spark, d), 0.25).withColumn("share", F.round("share", 6))


OVERLAP_JOIN = f"""
WITH {T.BOXES_SQL}, {REGIONS_SQL}, j AS (SELECT b.floor, target_id AS left_id, region_id, greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) AS share
  FROM boxes b JOIN regions r ON b.floor = r.floor)
SELECT floor, left_id, arg_min(region_id, (-share, region_id)) AS region_id, round(max(share), 6) AS share FROM j WHERE share >= 0.5 GROUP BY 1, 2"""


def intersect_join(spark: SparkSession, d: str) -> DataFrame:
    rows = T.target_boxes(spark, d).select("floor", F.col("target_id").alias("left_id"), F.col("b").alias("p"))
    q = regions(spark, d).select("floor", F.col("region_id").alias("right_id"), F.col("b").alias("q"))
    return J.overlapping_boxes(rows, q, 0.25).select("floor", "left_id", "right_id", F.round(B.common_area(F.col("p"), F.col("q")), 6).alias("common"), F.round(B.iou(F.col("p"), F.col("q")), 6).alias("iou"))


INTERSECT_JOIN = f"""
WITH {T.BOXES_SQL}, {REGIONS_SQL}, j AS (SELECT b.floor, target_id AS left_id, region_id AS right_id, greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) AS c,
  (b.x1 - b.x0) * (b.y1 - b.y0) AS pa, (r.x1 - r.x0) * (r.y1 - r.y0) AS qa FROM boxes b JOIN regions r ON b.floor = r.floor)
SELECT floor, left_id, right_id, round(c, 6) AS common, round(c / (pa + qa - c), 6) AS iou FROM j WHERE c > 0"""

RADIUS = 0.06


def near_relations(spark: SparkSession, d: str) -> DataFrame:
    """Up to 32 neighbours within a radius, with weights that fall with the distance."""
    near = J.nearest(J.near_pairs(T.targets(spark, d), RADIUS), 32)
    return near.select("floor", "target_id", "other_id", F.round("distance", 6).alias("distance"), "rank", F.round(F.exp(-F.col("distance") / RADIUS), 6).alias("weight"))


NEAR_RELATIONS = f"""
WITH {T.TARGETS_SQL}, j AS (SELECT a.floor, a.target_id, b.target_id AS other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM targets a JOIN targets b ON a.floor = b.floor AND a.target_id <> b.target_id),
r AS (SELECT *, row_number() OVER (PARTITION BY floor, target_id ORDER BY distance, other_id) AS rank FROM j WHERE distance <= {RADIUS})
SELECT floor, target_id, other_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank, round(exp(-distance / {RADIUS}), 6) AS weight FROM r WHERE rank <= 32"""


def nearest_neighbor(spark: SparkSession, d: str) -> DataFrame:
    near = J.nearest_neighbors(T.targets(spark, d), 3, 0.02)
    return near.select("floor", "target_id", "other_id", F.round("distance", 6).alias("distance"), "rank")


NEAREST_NEIGHBOR = f"""
WITH {T.TARGETS_SQL}, j AS (SELECT a.floor, a.target_id, b.target_id AS other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM targets a JOIN targets b ON a.floor = b.floor AND a.target_id <> b.target_id),
r AS (SELECT *, row_number() OVER (PARTITION BY floor, target_id ORDER BY distance, other_id) AS rank FROM j)
SELECT floor, target_id, other_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.struct(T.component(0).alias("x"), T.component(1).alias("y")), F.struct(T.component(2).alias("x"), T.component(3).alias("y"))
    e = T.load(spark, d, "embeddings").select(F.col("label").alias("floor"), F.col("vec_id").alias("seg_id"), a.alias("a"), b.alias("b"))
    return e.select("floor", "seg_id", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), B.angle(F.col("a"), F.col("b")).alias("angle"))


SEGMENTS_SQL = """raw AS (SELECT label AS floor, vec_id AS seg_id, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS bx, CAST(embedding[4] AS DOUBLE) AS by_ FROM embeddings),
segments AS (SELECT *, CASE WHEN degrees(atan2(by_ - ay, bx - ax)) < 0 THEN degrees(atan2(by_ - ay, bx - ax)) + 180 ELSE degrees(atan2(by_ - ay, bx - ax)) END AS angle, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS length FROM raw)"""


def parallel_band_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = J.parallel_pairs(segments(spark, d))
    return p.select("floor", "left_id", "right_id", F.round("turned", 4).alias("turned"), F.round("common", 6).alias("common"), F.round("apart", 6).alias("apart"))


PARALLEL_SQL = f"""{SEGMENTS_SQL}, j AS (SELECT l.floor, l.seg_id AS left_id, r.seg_id AS right_id, least(abs(l.angle - r.angle), 180 - abs(l.angle - r.angle)) AS turned, l.length AS ll, r.length AS rl,
  ((r.ax - l.ax) * (l.bx - l.ax) + (r.ay - l.ay) * (l.by_ - l.ay)) / l.length AS a, ((r.bx - l.ax) * (l.bx - l.ax) + (r.by_ - l.ay) * (l.by_ - l.ay)) / l.length AS b,
  ((r.ay - l.ay) * (l.bx - l.ax) - (r.ax - l.ax) * (l.by_ - l.ay)) / l.length AS c, ((r.by_ - l.ay) * (l.bx - l.ax) - (r.bx - l.ax) * (l.by_ - l.ay)) / l.length AS e
  FROM segments l JOIN segments r ON l.floor = r.floor AND l.seg_id < r.seg_id),
k AS (SELECT *, least(ll, greatest(a, b)) - greatest(0, least(a, b)) AS common, abs((c + e) / 2) AS apart FROM j),
pairs AS (SELECT * FROM k WHERE turned <= 5 AND common > 0.05 * least(ll, rl) AND apart > 0 AND apart <= 0.6 * common)"""
PARALLEL_BAND_PAIRS = f"WITH {PARALLEL_SQL} SELECT floor, left_id, right_id, round(turned, 4) AS turned, round(common, 6) AS common, round(apart, 6) AS apart FROM pairs"


def identity_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a floor (nation) and object, suppliers as nodes; objects by rounded balance."""
    rows = T.load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("floor"), (F.floor("c_acctbal") % 300).alias("object_id"))
    nodes = T.load(spark, d, "supplier").select(F.col("s_nationkey").alias("floor"), (F.floor("s_acctbal") % 300).alias("object_id"), F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 3 == 0).alias("has_access"))
    return L.merged_identity(rows, nodes)


IDENTITY_JOIN = """
WITH r AS (SELECT c_custkey, c_nationkey AS floor, CAST(floor(c_acctbal) AS BIGINT) % 300 AS object_id FROM customer),
n AS (SELECT s_nationkey AS floor, CAST(floor(s_acctbal) AS BIGINT) % 300 AS object_id, s_suppkey AS node_id, s_suppkey % 3 = 0 AS has_access FROM supplier),
f AS (SELECT floor, object_id, arg_min(node_id, (NOT has_access, node_id)) AS exact FROM n GROUP BY 1, 2),
u AS (SELECT object_id, min(node_id) AS only_id FROM n GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, r.floor, r.object_id, coalesce(exact, only_id) AS node_id, CASE WHEN exact IS NOT NULL THEN 'floor' WHEN only_id IS NOT NULL THEN 'unique' ELSE 'none' END AS matched
FROM r LEFT JOIN f ON r.floor = f.floor AND r.object_id = f.object_id LEFT JOIN u ON r.object_id = u.object_id"""


def decision_join(spark: SparkSession, d: str) -> DataFrame:
    """The last event of a user as the decision on its orders' customer: last wins, then a join back to all rows."""
    events = T.load(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    last = L.last_decisions(events, "user_id", "event_id", "event_type", "value")
    orders = T.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = orders.join(last, F.col("o_custkey") == F.col("user_id"), "left")
    return joined.groupBy(F.coalesce("event_type", F.lit("none")).alias("decision")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


DECISION_JOIN = """
WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1)
SELECT coalesce(event_type, 'none') AS decision, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders LEFT JOIN l ON o_custkey = user_id GROUP BY 1"""


def semi_anti_scope(spark: SparkSession, d: str) -> DataFrame:
    """Customers by whether they are in the allowed set, missing from it, or finished within it."""
    c = T.load(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = T.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    parts = [("allowed", c.join(o, "c_custkey", "left_semi")), ("missing", c.join(o, "c_custkey", "left_anti")), ("finished", c.join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi"))]
    out = [df.select(F.lit(name).alias("scope"), "c_nationkey") for name, df in parts]
    return out[0].union(out[1]).union(out[2]).groupBy("scope", "c_nationkey").agg(F.count("*").alias("n"))


SEMI_ANTI_SCOPE = """
SELECT 'allowed' AS scope, c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 2
UNION ALL SELECT 'missing', c_nationkey, count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 2
UNION ALL SELECT 'finished', c_nationkey, count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 2"""


def candidate_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as candidates of nations; a nation without any rich one gets as many made-up ids as it has customers by 20."""
    groups = T.load(spark, d, "customer").groupBy("c_nationkey").agg((F.count("*") / 20).cast("int").alias("n")).withColumnRenamed("c_nationkey", "nation")
    rich = T.load(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").cast("string").alias("candidate"))
    return L.with_fallback(groups, rich, "nation")


CANDIDATE_FALLBACK = """
WITH g AS (SELECT c_nationkey AS nation, CAST(floor(count(*) / 20.0) AS INT) AS n FROM customer GROUP BY 1), r AS (SELECT s_nationkey AS nation, CAST(s_suppkey AS VARCHAR) AS candidate FROM supplier WHERE s_acctbal > 8000)
SELECT nation, candidate, false AS synthetic FROM r
UNION ALL SELECT nation, nation || '#' || i, true FROM g, range(1, 1000) t(i) WHERE i <= n AND nation NOT IN (SELECT nation FROM r)"""


def quota_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.top_pairs(T.load(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", "s_suppkey", "s_acctbal").withColumn("value", F.round("value", 2))


QUOTA_PAIRS = """
WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS k FROM supplier)
SELECT a.s_nationkey, a.s_suppkey AS first, b.s_suppkey AS second, round(a.s_acctbal + b.s_acctbal, 2) AS value FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND a.k = 1 AND b.k = 2"""



def requirement_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rich suppliers of nations that ask for two."""
    c = T.load(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("requirement"), F.col("s_suppkey").alias("item"))
    r = T.load(spark, d, "nation").select(F.col("n_nationkey").alias("requirement"), (F.col("n_nationkey") % 3).alias("quota"))
    return L.requirement_pairs(c, r)


REQUIREMENT_PAIRS = "SELECT a.s_nationkey AS requirement, a.s_suppkey AS \"left\", b.s_suppkey AS \"right\" FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal > 5000 AND b.s_acctbal > 5000 AND a.s_nationkey % 3 = 2"


def peer_segments(spark: SparkSession, d: str) -> DataFrame:
    """The 24 nearest segments within ten degrees of each segment's direction."""
    p = J.directional_peers(segments(spark, d))
    return p.select("floor", "seg_id", "peer_id", F.round("distance", 6).alias("distance"), "rank")


PEER_SEGMENTS = f"""
WITH {SEGMENTS_SQL}, j AS (SELECT a.floor, a.seg_id, b.seg_id AS peer_id, sqrt(((a.ax + a.bx) / 2 - (b.ax + b.bx) / 2) ** 2 + ((a.ay + a.by_) / 2 - (b.ay + b.by_) / 2) ** 2) AS distance FROM segments a JOIN segments b ON a.floor = b.floor AND a.seg_id <> b.seg_id WHERE least(abs(a.angle - b.angle), 180 - abs(a.angle - b.angle)) <= 10),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY floor, seg_id ORDER BY distance, peer_id) AS INT) AS rank FROM j) SELECT floor, seg_id, peer_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 24"""

QUERIES = {
    "requirement_pairs": requirement_pairs, "peer_segments": peer_segments, "containment_join": containment_join, "overlap_join": overlap_join, "intersect_join": intersect_join, "near_relations": near_relations, "nearest_neighbor": nearest_neighbor,
    "parallel_band_pairs": parallel_band_pairs, "identity_join": identity_join, "decision_join": decision_join, "semi_anti_scope": semi_anti_scope, "candidate_fallback": candidate_fallback, "quota_pairs": quota_pairs,
}
ORACLE_SQL = {
    "requirement_pairs": REQUIREMENT_PAIRS, "peer_segments": PEER_SEGMENTS, "containment_join": CONTAINMENT_JOIN, "overlap_join": OVERLAP_JOIN, "intersect_join": INTERSECT_JOIN, "near_relations": NEAR_RELATIONS, "nearest_neighbor": NEAREST_NEIGHBOR,
    "parallel_band_pairs": PARALLEL_BAND_PAIRS, "identity_join": IDENTITY_JOIN, "decision_join": DECISION_JOIN, "semi_anti_scope": SEMI_ANTI_SCOPE, "candidate_fallback": CANDIDATE_FALLBACK, "quota_pairs": QUOTA_PAIRS,
}
