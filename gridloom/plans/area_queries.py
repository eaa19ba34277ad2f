"""Queries over free space, pools, periodic lines and the classification cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import cascades, classifier
from ..operators import matching as M
from ..operators import pools as P
from ..operators import raster as R
from ..sources import tables as T
from .graph_queries import ALIASES, KEYWORD_PATTERNS, PATTERNS

CELL = 0.02


def floor_boxes(spark: SparkSession, d: str) -> DataFrame:
    return T.target_boxes(spark, d).select("floor", F.col("target_id").alias("id"), "b")


def free_space(spark: SparkSession, d: str) -> DataFrame:
    return R.free_cells(floor_boxes(spark, d), CELL)


FREE_SQL = f"""{T.BOXES_SQL}, e AS (SELECT floor, min(floor(x0 / {CELL})) AS a, max(floor(x1 / {CELL})) AS b, min(floor(y0 / {CELL})) AS c, max(floor(y1 / {CELL})) AS d FROM boxes GROUP BY 1),
domain AS (SELECT e.floor, CAST(x AS BIGINT) AS cx, CAST(y AS BIGINT) AS cy FROM e, range(-200, 200) s(x), range(-200, 200) t(y) WHERE x BETWEEN a AND b AND y BETWEEN c AND d),
blocked AS (SELECT DISTINCT m.floor, cx, cy FROM domain m JOIN boxes b ON b.floor = m.floor AND cx >= ceil(x0 / {CELL} - 0.5) AND cx <= floor(x1 / {CELL} - 0.5) AND cy >= ceil(y0 / {CELL} - 0.5) AND cy <= floor(y1 / {CELL} - 0.5)),
free AS (SELECT * FROM domain EXCEPT SELECT * FROM blocked)"""
FREE_SPACE = f"WITH {FREE_SQL} SELECT floor, cx, cy FROM free"


def clearance_map(spark: SparkSession, d: str) -> DataFrame:
    b = floor_boxes(spark, d)
    return R.clearance(R.free_cells(b, CELL), R.covered_cells(b, CELL)).groupBy("floor", "steps").agg(F.count("*").alias("cells"))


CLEARANCE_MAP = f"WITH {FREE_SQL}, s AS (SELECT f.floor, f.cx, f.cy, min(abs(f.cx - b.cx) + abs(f.cy - b.cy)) AS steps FROM free f JOIN blocked b ON f.floor = b.floor GROUP BY 1, 2, 3) SELECT floor, steps, count(*) AS cells FROM s GROUP BY 1, 2"


def free_areas(spark: SparkSession, d: str) -> DataFrame:
    return R.areas(free_space(spark, d), CELL)


FREE_AREAS = f"""
WITH RECURSIVE {FREE_SQL}, k AS (SELECT floor, cx, cy, floor * 1000000 + (cx + 400) * 1000 + cy + 400 AS u FROM free), n AS (SELECT a.u, b.u AS v FROM k a JOIN k b ON a.floor = b.floor AND abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
p(u, label) USING KEY (u) AS (SELECT u, u FROM k UNION SELECT q.v, q.label FROM (SELECT n.v, min(p.label) AS label FROM p JOIN n ON p.u = n.u GROUP BY 1) q JOIN recurring.p r ON r.u = q.v WHERE q.label < r.label),
g AS (SELECT floor, label, count(*) AS cells FROM k JOIN p USING (u) GROUP BY 1, 2)
SELECT floor, cells, round(CAST(cells AS DOUBLE) * {CELL} * {CELL}, 6) AS area, round(cells / sum(cells) OVER (PARTITION BY floor), 6) AS share FROM g"""


def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    items = T.load(spark, d, "part").select((F.col("p_size") % 10).alias("floor"), F.col("p_partkey").alias("item"), F.col("p_name").alias("raw_name"), F.col("p_type").alias("class"))
    wanted = spark.createDataFrame([("ECONOMY", "red bolt"), ("SMALL", "blue ring"), ("PROMO", "nothing")], "class string, raw string")
    return P.candidate_pools(items, wanted)


CANDIDATE_POOLS = """
WITH w(class, raw) AS (VALUES ('ECONOMY', 'red bolt'), ('SMALL', 'blue ring'), ('PROMO', 'nothing')), j AS (SELECT p_size % 10 AS floor, class, raw, p_partkey AS item, p_name = raw AS by_name FROM part JOIN w ON p_type = class),
k AS (SELECT *, max(CAST(by_name AS INT)) OVER (PARTITION BY floor, class, raw) AS m FROM j) SELECT floor, class, raw, item, by_name FROM k WHERE by_name OR m = 0"""


def top_successors(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = T.load(spark, d, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 10).cast("string")).alias("source"), F.lead("event_type").over(w).alias("next")).where("next IS NOT NULL")
    return P.top_successors(e, 3)


TOP_SUCCESSORS = """
WITH e AS (SELECT event_type || '-' || user_id % 10 AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events), n AS (SELECT source, next, count(*) AS n FROM e WHERE next IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, next) AS INT) AS rank FROM n) SELECT source, next, n, rank FROM r WHERE rank <= 3"""


def periodic_lines(spark: SparkSession, d: str) -> DataFrame:
    o = T.load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").cast("double").alias("at"))
    return P.periodic_runs(o, 3, 0.3).select("group", "lines", "first_at", F.round("pitch", 4).alias("pitch"))


PERIODIC_LINES = """
WITH o AS (SELECT o_custkey AS grp, CAST(o_orderkey AS DOUBLE) AS a, o_orderkey - lag(o_orderkey) OVER w AS gap FROM orders WHERE o_orderstatus = 'P' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
g AS (SELECT *, coalesce(CAST(abs(gap - lag(gap) OVER w) > 0.3 * lag(gap) OVER w AS INT), 1) AS fresh FROM o WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY grp ORDER BY a)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY grp ORDER BY a) AS run FROM g)
SELECT grp AS "group", count(*) + 1 AS lines, min(a) - arg_min(gap, a) AS first_at, round(avg(gap), 4) AS pitch FROM r GROUP BY grp, run HAVING count(*) + 1 >= 3"""


def classification_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Noise goes, then aliases, then keyword patterns decide, and what is left is ignored: one row a text."""
    items = cascades.noise_reasons(T.load(spark, d, "part").select("p_partkey", "p_name"), "p_name")
    kept = items.where("reason = 'kept'")
    alias = M.best_alias(kept, spark.createDataFrame(ALIASES[:4], "class string, alias string, priority int"), "p_partkey", "p_name").select("p_partkey", F.col("class").alias("a"), F.col("confidence").alias("ac"))
    pattern = M.best_pattern(kept, "p_partkey", "p_name", PATTERNS).select("p_partkey", F.col("class").alias("k"), F.col("confidence").alias("kc"))
    j = items.join(alias, "p_partkey", "left").join(pattern, "p_partkey", "left")
    return j.select("p_partkey", "reason", F.coalesce("a", "k", F.lit("IGNORE")).alias("class"), F.coalesce("ac", "kc", F.lit(0.0)).alias("confidence"))


CLASSIFICATION_PIPELINE = f"""
WITH a(class, alias, priority) AS (VALUES {', '.join(map(str, ALIASES[:4]))}), h AS (SELECT p_partkey, a.*, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, length(class) DESC, priority, class DESC) AS k FROM part JOIN a ON contains(p_name, alias)),
q AS ({KEYWORD_PATTERNS.replace('WITH h AS', 'WITH r AS').replace('FROM h GROUP', 'FROM r GROUP')})
SELECT p.p_partkey, 'kept' AS reason, coalesce(h.class, q.class, 'IGNORE') AS class, CAST(coalesce(CASE WHEN h.class IS NOT NULL THEN CASE WHEN h.priority < 2 THEN 1.0 ELSE 0.96 END END, q.confidence, 0) AS DOUBLE) AS confidence
FROM part p LEFT JOIN h ON h.p_partkey = p.p_partkey AND h.k = 1 LEFT JOIN q ON q.p_partkey = p.p_partkey"""


def wall_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a floor in reading order with the gap to the next along x."""
    w = Window.partitionBy("floor").orderBy("x0", "id")
    b = floor_boxes(spark, d).select("floor", "id", F.col("b.x0").alias("x0"), F.col("b.x1").alias("x1"), F.round(B.area(F.col("b")), 6).alias("area"))
    return b.select("floor", "id", "area", F.round(F.greatest(F.lit(0.0), F.lead("x0").over(w) - F.col("x1")), 6).alias("gap"))


WALL_GAPS = f"""WITH {T.BOXES_SQL} SELECT floor, target_id AS id, round((x1 - x0) * (y1 - y0), 6) AS area, CASE WHEN lead(x0) OVER w IS NULL THEN 0.0 ELSE round(greatest(0, lead(x0) OVER w - x1), 6) END AS gap FROM boxes WINDOW w AS (PARTITION BY floor ORDER BY x0, target_id)"""


def binary_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts, learned on four fifths and judged on all."""
    items = T.load(spark, d, "part").select("p_partkey", "p_name", F.col("p_name").rlike("bolt|ring").cast("int").alias("label"))
    model = classifier.fit(items.where("p_partkey % 5 <> 0"), "p_name", "label")
    return classifier.classify(items, model, "p_name").select("p_partkey", "label", "p", "verdict")


_NAMES = "free_space clearance_map free_areas candidate_pools top_successors periodic_lines classification_pipeline wall_gaps binary_classifier".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
