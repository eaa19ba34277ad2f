"""Queries over graphs, routes, texts, clusters and windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import similarity as X
from ..operators import aggregates as A
from ..operators import clusters as K
from ..operators import graph as G
from ..operators import matching as M
from ..operators import routes as R
from ..operators import spatial as J
from ..sources import tables as T
from ..streaming import visits as V
from .join_queries import PARALLEL_SQL, segments

DMAX = 0.03


def near_edges(spark: SparkSession, d: str, radius: float = DMAX) -> DataFrame:
    return J.near_pairs(T.targets(spark, d), radius).where("target_id < other_id")


def near_sql(radius: float) -> str:
    return f"{T.TARGETS_SQL}, near AS (SELECT a.floor, a.target_id, b.target_id AS other_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM targets a JOIN targets b ON a.floor = b.floor AND a.target_id <> b.target_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {radius})"


COMPONENTS_SQL = f"{near_sql(DMAX)}, reach AS (SELECT target_id AS node, other_id AS other FROM near UNION SELECT r.node, n.other_id FROM reach r JOIN near n ON r.other = n.target_id), comp AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY 1)"


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return G.connected_components(near_edges(spark, d).select(F.col("target_id").alias("u"), F.col("other_id").alias("v")))


CONNECTED_COMPONENTS = f"WITH RECURSIVE {COMPONENTS_SQL} SELECT node, component FROM comp"


def reachability_rates(spark: SparkSession, d: str) -> DataFrame:
    c = connected_components(spark, d).select(F.col("node").alias("target_id"), "component")
    return A.reachability(T.targets(spark, d).join(c, "target_id", "left").select("floor", "target_id", "component"))


REACHABILITY_RATES = f"""
WITH RECURSIVE {COMPONENTS_SQL}, s AS (SELECT floor, component, count(*) AS n FROM targets LEFT JOIN comp ON target_id = node GROUP BY 1, 2)
SELECT floor, CAST(sum(n) AS BIGINT) AS n_targets, round(sum(CASE WHEN component IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) AS attach_rate, arg_min(component, (-n, component)) FILTER (component IS NOT NULL) AS primary_component,
  round(CASE WHEN sum(n) > 1 THEN sum(CASE WHEN component IS NOT NULL THEN n * (n - 1) / 2 ELSE 0 END) / (sum(n) * (sum(n) - 1) / 2) ELSE 1 END, 6) AS pair_rate FROM s GROUP BY 1"""


def edge_min_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-part edges with quantities as weights; floors are nations of supplier and part number."""
    l = T.load(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("floor"), (F.col("l_partkey") % 10).alias("other_floor"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").alias("w"))  # noqa: E741
    return G.simple_edges(l)


EDGE_MIN_DEDUPE = "SELECT l_suppkey % 10 AS floor, least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, min(l_quantity) AS w FROM lineitem WHERE l_suppkey % 10 = l_partkey % 10 GROUP BY 1, 2, 3"


def metric_closure(spark: SparkSession, d: str) -> DataFrame:
    t = T.targets(spark, d).withColumnRenamed("target_id", "target")
    return G.near_closure(t, 0.06).withColumn("distance", F.round("distance", 6))


METRIC_CLOSURE = f"""
WITH RECURSIVE {near_sql(0.06)}, t AS (SELECT floor, target_id FROM targets),
p(floor, src, node, distance) USING KEY (floor, src, node) AS (SELECT floor, target_id, target_id, CAST(0 AS DOUBLE) FROM t
  UNION SELECT q.floor, q.src, q.other_id, q.distance FROM (SELECT p.floor, p.src, n.other_id, min(p.distance + round(n.distance, 6)) AS distance FROM p JOIN near n ON p.floor = n.floor AND p.node = n.target_id GROUP BY 1, 2, 3) q
  LEFT JOIN recurring.p r ON r.floor = q.floor AND r.src = q.src AND r.node = q.other_id WHERE r.distance IS NULL OR q.distance < r.distance - 1e-9)
SELECT p.floor, src, node AS dst, round(distance, 6) AS distance FROM p WHERE src = node AND p.floor IN (SELECT floor FROM near) OR src <> node"""


#: Components of an embedding.
DIM = 64


def message_passing(spark: SparkSession, d: str) -> DataFrame:
    """One relational step over whole embeddings: the first four components, and all of them weighed by their place."""
    nodes = T.load(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("h"))
    edges = J.near_pairs(T.targets(spark, d), 0.05).select(F.col("other_id").alias("src"), F.col("target_id").alias("dst"), F.exp(-F.col("distance") / 0.05).alias("gate"), F.lit(0.5).alias("scale"))
    weighed = F.aggregate(F.transform("h", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return G.message_layer(nodes, edges, DIM).select("node", *[F.round(F.col("h")[k], 5).alias(f"h{k}") for k in range(4)], F.round(weighed, 3).alias("weighed"))


MESSAGE_PASSING = f"""
WITH {near_sql(0.05)}, h AS (SELECT vec_id AS node, i, CAST(embedding[i] AS DOUBLE) AS h FROM embeddings, range(1, {DIM + 1}) t(i)),
g AS (SELECT n.target_id AS node, h.i, sum(exp(-distance / 0.05)) AS g, sum(exp(-distance / 0.05) * 0.5 * h.h) AS s FROM near n JOIN h ON h.node = n.other_id GROUP BY 1, 2),
r AS (SELECT h.node, h.i, h.h + greatest(0, h.h + coalesce(s / greatest(g, 1), 0)) AS r FROM h LEFT JOIN g ON h.node = g.node AND h.i = g.i),
z AS (SELECT *, (r - avg(r) OVER w) / sqrt(var_pop(r) OVER w + 1e-5) AS z FROM r WINDOW w AS (PARTITION BY node))
SELECT node, round(max(CASE WHEN i = 1 THEN z END), 5) AS h0, round(max(CASE WHEN i = 2 THEN z END), 5) AS h1, round(max(CASE WHEN i = 3 THEN z END), 5) AS h2, round(max(CASE WHEN i = 4 THEN z END), 5) AS h3, round(sum(i * z), 3)::DOUBLE AS weighed FROM z GROUP BY 1"""


def block_containment(spark: SparkSession, d: str) -> DataFrame:
    """Parts as blocks: part p holds part (3p + 1) mod 2000 and (7p) mod 2000; big ones are marked."""
    p = T.load(spark, d, "part").select("p_partkey", "p_size")
    children = p.where("p_partkey % 4 <> 3").select(F.col("p_partkey").alias("block"), F.explode(F.array((F.col("p_partkey") * 3 + 1) % 2000, F.col("p_partkey") * 7 % 2000)).alias("child"))
    return G.contains_marked(children, p.where("p_size = 50").select(F.col("p_partkey").alias("block")))


BLOCK_CONTAINMENT = """
WITH RECURSIVE c AS (SELECT p_partkey AS block, (p_partkey * 3 + 1) % 2000 AS child FROM part WHERE p_partkey % 4 <> 3 UNION SELECT p_partkey, p_partkey * 7 % 2000 FROM part WHERE p_partkey % 4 <> 3),
r AS (SELECT p_partkey AS block FROM part WHERE p_size = 50 UNION SELECT c.block FROM c JOIN r ON c.child = r.block) SELECT block FROM r"""


def route_plans(spark: SparkSession, d: str) -> DataFrame:
    """Every whole floor's route, exactly up to 16 targets, else by heuristics."""
    return R.plan_routes(T.targets(spark, d))


def insertion_costs(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest place at which each odd target enters the floor's route over even ones by id; ends cost one leg."""
    t = T.targets(spark, d)
    w = Window.partitionBy("floor").orderBy("target_id")
    even = t.where("target_id % 2 = 0")
    legs = even.select("floor", F.lag("x").over(w).alias("ax"), F.lag("y").over(w).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return R.insertion_costs(t.where("target_id % 2 = 1"), legs).select("floor", "target_id", F.round("saving", 6).alias("saving"))


INSERTION_COSTS = f"""
WITH {T.TARGETS_SQL}, l AS (SELECT floor, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS by_ FROM targets WHERE target_id % 2 = 0 WINDOW w AS (PARTITION BY floor ORDER BY target_id))
SELECT t.floor, target_id, round(min(CASE WHEN ax IS NULL THEN sqrt((x - bx) ** 2 + (y - by_) ** 2) ELSE sqrt((x - ax) ** 2 + (y - ay) ** 2) + sqrt((x - bx) ** 2 + (y - by_) ** 2) - sqrt((ax - bx) ** 2 + (ay - by_) ** 2) END), 6) AS saving
FROM targets t JOIN l ON t.floor = l.floor WHERE target_id % 2 = 1 GROUP BY 1, 2"""


def route_start(spark: SparkSession, d: str) -> DataFrame:
    """Per floor the legal start: required first, then the smallest summed distance to the floor's centre of targets, then
    the score and the id. Distances to all targets are sums over one aggregate of the floor's points."""
    t = T.targets(spark, d)
    c = t.groupBy("floor").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    legal = t.where("target_id % 6 = 0").join(c, "floor").withColumn("far", F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 6))
    order = F.struct((F.col("target_id") % 9 != 0).cast("int").alias("optional"), "far", (-(F.col("target_id") % 5)).alias("score"), "target_id")
    return legal.groupBy("floor").agg(F.min(order).alias("m")).select("floor", F.col("m.target_id").alias("start_id"), F.col("m.far").alias("far"))


ROUTE_START = f"""
WITH {T.TARGETS_SQL}, c AS (SELECT floor, avg(x) AS mx, avg(y) AS my FROM targets GROUP BY 1),
l AS (SELECT t.floor, target_id, round(sqrt((x - mx) ** 2 + (y - my) ** 2), 6) AS far FROM targets t JOIN c ON t.floor = c.floor WHERE target_id % 6 = 0)
SELECT floor, arg_min(target_id, (CAST(target_id % 9 <> 0 AS INT), far, -(target_id % 5), target_id)) AS start_id, arg_min(far, (CAST(target_id % 9 <> 0 AS INT), far, -(target_id % 5), target_id)) AS far FROM l GROUP BY 1"""


def edge_passes(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as a walk over types: passes of each undirected leg and its first ordinal."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = T.load(spark, d, "events").select("user_id", "event_id", "event_type", F.lead("event_type").over(w).alias("to"), F.row_number().over(w).alias("leg")).where("to IS NOT NULL")
    return e.groupBy("user_id", F.least("event_type", "to").alias("a"), F.greatest("event_type", "to").alias("b")).agg(F.count("*").alias("passes"), F.min("leg").alias("first_leg"))


EDGE_PASSES = """
WITH e AS (SELECT user_id, event_type, lead(event_type) OVER w AS nxt, CAST(row_number() OVER w AS INT) AS leg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, least(event_type, nxt) AS a, greatest(event_type, nxt) AS b, count(*) AS passes, min(leg) AS first_leg FROM e WHERE nxt IS NOT NULL GROUP BY 1, 2, 3"""


def char_ngram_cosine(spark: SparkSession, d: str) -> DataFrame:
    n = X.gram_counts(T.load(spark, d, "benchmark").select("item_id", "text"), "item_id", "text")
    c = X.cosine(n, n.withColumnRenamed("item_id", "other_id"), "item_id", "other_id")
    return c.where("item_id < other_id").withColumn("cosine", F.round("cosine", 6))


GRAMS_SQL = "grams AS (SELECT item_id, substr(text, CAST(i AS INT), CAST(n AS INT)) AS gram, count(*) AS n FROM benchmark, range(1, 4) l(n), unnest(range(1, length(text) + 1)) t(i) WHERE i + n - 1 <= length(text) GROUP BY 1, 2)"
CHAR_NGRAM_COSINE = f"""
WITH {GRAMS_SQL}, m AS (SELECT item_id, sqrt(sum(n * n)) AS s FROM grams GROUP BY 1), p AS (SELECT a.item_id, b.item_id AS other_id, sum(a.n * b.n) AS dot FROM grams a JOIN grams b ON a.gram = b.gram AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT p.item_id, other_id, round(dot / (x.s * y.s), 6) AS cosine FROM p JOIN m x ON x.item_id = p.item_id JOIN m y ON y.item_id = other_id"""


def tfidf_similarity(spark: SparkSession, d: str) -> DataFrame:
    w = X.tf_idf(X.gram_counts(T.load(spark, d, "benchmark").select("item_id", "text"), "item_id", "text"), "item_id")
    return X.cosine(w, w.withColumnRenamed("item_id", "other_id"), "item_id", "other_id", "w").where("item_id < other_id").withColumn("cosine", F.round("cosine", 6))


TFIDF_SIMILARITY = f"""
WITH {GRAMS_SQL}, f AS (SELECT gram, count(*) AS df FROM grams GROUP BY 1), t AS (SELECT item_id, g.gram, n * (ln((1 + (SELECT count(DISTINCT item_id) FROM grams)) / (1 + df)) + 1) AS w FROM grams g JOIN f ON g.gram = f.gram),
m AS (SELECT item_id, sqrt(sum(w * w)) AS s FROM t GROUP BY 1), p AS (SELECT a.item_id, b.item_id AS other_id, sum(a.w * b.w) AS dot FROM t a JOIN t b ON a.gram = b.gram AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT p.item_id, other_id, round(dot / (x.s * y.s), 6) AS cosine FROM p JOIN m x ON x.item_id = p.item_id JOIN m y ON y.item_id = other_id"""


def fuzzy_class_match(spark: SparkSession, d: str) -> DataFrame:
    items = T.load(spark, d, "part").select("p_partkey", "p_name")
    return M.fuzzy_class(items, classes(spark), "p_partkey", "p_name")


#: No SQL: DuckDB's Jaro rounds half transpositions down. tests/test_fidelity.py holds the operator against a plain version.
CLASSES = ["blue ring", "large bolt", "gear box", "widget", "small plate", "redd bolt", "green gear"]


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CLASSES], "class string")


ALIASES = [("bolt", "bolt", 0), ("bolt", "lt", 2), ("ring", "ring", 0), ("gear", "gear", 1), ("red thing", "red", 1), ("blue thing", "blue", 1), ("small thing", "small", 2)]


def alias_best_match(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "class string, alias string, priority int")
    return M.best_alias(T.load(spark, d, "part").select("p_partkey", "p_name"), aliases, "p_partkey", "p_name")


ALIAS_BEST_MATCH = f"""
WITH a(class, alias, priority) AS (VALUES {', '.join(map(str, ALIASES))}), h AS (SELECT p_partkey, a.* FROM part JOIN a ON contains(p_name, alias)),
b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, length(class) DESC, priority, class DESC) AS k FROM h)
SELECT p_partkey, class, alias, CASE WHEN priority < 2 THEN 1.0::DOUBLE ELSE 0.96 END AS confidence FROM b WHERE k = 1"""

PATTERNS = [
    {"class": "red bolt", "must_all": ["red", "bolt"], "should_any": ["r"], "confidence": 0.85},
    {"class": "any bolt", "must_all": ["bolt"], "exclude_any": ["blue"], "confidence": 0.8},
    {"class": "round", "must_any": [["ring", "gear"], ["small", "large"]], "should_any": ["small", "gear"], "confidence": 0.9},
]


def keyword_patterns(spark: SparkSession, d: str) -> DataFrame:
    return M.best_pattern(T.load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", PATTERNS)


KEYWORD_PATTERNS = """
WITH h AS (SELECT p_partkey, 'red bolt' AS class, 2 AS must, least(0.92, 0.85 + 0.02) AS confidence FROM part WHERE contains(p_name, 'red') AND contains(p_name, 'bolt')
  UNION ALL SELECT p_partkey, 'any bolt', 1, 0.8 FROM part WHERE contains(p_name, 'bolt') AND NOT contains(p_name, 'blue')
  UNION ALL SELECT p_partkey, 'round', 0, least(0.92, 0.9 + 0.02 * (CAST(contains(p_name, 'small') AS INT) + CAST(contains(p_name, 'gear') AS INT))) FROM part WHERE (contains(p_name, 'ring') OR contains(p_name, 'gear')) AND (contains(p_name, 'small') OR contains(p_name, 'large')))
SELECT p_partkey, arg_max(class, (confidence, must, class)) AS class, round(CAST(max(confidence) AS DOUBLE), 4) AS confidence FROM h GROUP BY 1"""


def box_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = K.box_clusters(T.target_boxes(spark, d).select("floor", F.col("target_id").alias("id"), "b"), 0.0, 0.25, 5)
    return c.select("floor", "cluster", "members", F.round(B.area(F.col("b")), 6).alias("area"))


BOX_CLUSTERS = f"""
WITH RECURSIVE {T.BOXES_SQL}, o AS (SELECT a.target_id AS u, b.target_id AS v FROM boxes a JOIN boxes b ON a.floor = b.floor AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)),
r AS (SELECT u, v FROM o UNION SELECT r.u, o.v FROM r JOIN o ON r.v = o.u), c AS (SELECT u AS target_id, min(v) AS cluster FROM r GROUP BY 1)
SELECT floor, cluster, count(*) AS members, round((max(x1) - min(x0)) * (max(y1) - min(y0)), 6) AS area FROM boxes JOIN c USING (target_id) GROUP BY 1, 2 HAVING count(*) >= 5"""


def dense_clusters(spark: SparkSession, d: str) -> DataFrame:
    return K.dense_clusters(T.targets(spark, d), 0.04, 5).drop("cluster")


DENSE_CLUSTERS = f"""
WITH RECURSIVE {T.TARGETS_SQL}, c AS (SELECT floor, CAST(floor(x / 0.04) AS BIGINT) AS cx, CAST(floor(y / 0.04) AS BIGINT) AS cy, count(*) AS n FROM targets GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (ORDER BY floor, cx, cy) AS id FROM c), e AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b ON a.floor = b.floor AND abs(a.cx - b.cx) + abs(a.cy - b.cy) <= 1),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), m AS (SELECT u AS id, min(v) AS g FROM r GROUP BY 1)
SELECT floor, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points FROM k JOIN m USING (id) GROUP BY floor, g HAVING sum(n) >= 5"""


def axis_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = K.axis_clusters(T.targets(spark, d), "x", 0.01)
    return c.withColumn("mean", F.round("mean", 6))


AXIS_CLUSTERS = f"""
WITH RECURSIVE {T.TARGETS_SQL}, o AS (SELECT floor, x, row_number() OVER (PARTITION BY floor ORDER BY x) AS k FROM targets),
s AS (SELECT floor, k, CAST(0 AS INT) AS place, x AS mean, CAST(1 AS INT) AS n FROM o WHERE k = 1
  UNION ALL SELECT o.floor, o.k, CASE WHEN abs(o.x - s.mean) > 0.01 THEN s.place + 1 ELSE s.place END, CASE WHEN abs(o.x - s.mean) > 0.01 THEN o.x ELSE s.mean + (o.x - s.mean) / (s.n + 1) END, CASE WHEN abs(o.x - s.mean) > 0.01 THEN 1 ELSE s.n + 1 END FROM s JOIN o ON o.floor = s.floor AND o.k = s.k + 1)
SELECT floor, place, round(arg_max(mean, k), 6) AS mean, max(n) AS n FROM s GROUP BY 1, 2"""


def projection_gaps(spark: SparkSession, d: str) -> DataFrame:
    return K.projection_gaps(T.targets(spark, d), 0.01, 2)


PROJECTION_GAPS = f"""
WITH {T.TARGETS_SQL}, b AS (SELECT floor, CAST(floor(x / 0.01) AS INT) AS bin, count(*) AS n FROM targets GROUP BY 1, 2), s AS (SELECT floor, min(bin) AS a, max(bin) AS z FROM b GROUP BY 1),
e AS (SELECT s.floor, CAST(i AS INT) AS bin FROM s, range(-2000, 2000) t(i) WHERE i BETWEEN a AND z), v AS (SELECT e.floor, e.bin, avg(coalesce(n, 0)) OVER (PARTITION BY e.floor ORDER BY e.bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM e LEFT JOIN b ON e.floor = b.floor AND e.bin = b.bin),
l AS (SELECT *, bin - row_number() OVER (PARTITION BY floor ORDER BY bin) AS run FROM v WHERE s < 1) SELECT floor, min(bin) AS first_bin, max(bin) AS last_bin, round(min(s), 6) AS emptiest FROM l GROUP BY floor, run"""


def wall_bands(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles between parallel segments: common length by distance, per floor."""
    p = J.parallel_pairs(segments(spark, d))
    return p.groupBy("floor").agg(F.count("*").alias("bands"), F.round(F.sum(F.col("common") * F.col("apart")), 6).alias("area"), F.round(F.max("apart"), 6).alias("widest"))


WALL_BANDS = f"WITH {PARALLEL_SQL} SELECT floor, count(*) AS bands, round(sum(common * apart), 6) AS area, round(max(apart), 6) AS widest FROM pairs GROUP BY 1"


def near_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that lie at most 0.02 apart."""
    return K.near_clusters(T.target_boxes(spark, d).select("floor", F.col("target_id").alias("id"), "b"), 0.01, 0.25)


NEAR_CLUSTERS = f"""
WITH RECURSIVE {T.BOXES_SQL}, e AS (SELECT a.target_id AS u, b.target_id AS v FROM boxes a JOIN boxes b ON a.floor = b.floor AND sqrt(greatest(0, a.x0 - b.x1, b.x0 - a.x1) ** 2 + greatest(0, a.y0 - b.y1, b.y0 - a.y1) ** 2) <= 0.02),
p(u, label) USING KEY (u) AS (SELECT target_id, target_id FROM boxes UNION SELECT q.v, q.label FROM (SELECT e.v, min(p.label) AS label FROM p JOIN e ON p.u = e.u GROUP BY 1) q JOIN recurring.p r ON r.u = q.v WHERE q.label < r.label)
SELECT u AS id, label AS cluster FROM p"""


def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Small boxes merged to a fixpoint: covers that come within 0.003 merge again."""
    b = T.target_boxes(spark, d).select("floor", F.col("target_id").alias("id"), B.box(F.col("b.x0"), F.col("b.y0"), F.col("b.x0") + 0.02, F.col("b.y0") + 0.02).alias("b"))
    m = K.merged_boxes(b, 0.003, 0.1)
    return m.select("floor", "id", "members", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return V.windowed_counts(T.load(spark, d, "events").select("ts", "event_type", "value"))


EVENT_WINDOWS = "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return V.sessions(T.load(spark, d, "events").select("ts", "user_id"))


EVENT_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k"""

_NAMES = "connected_components reachability_rates edge_min_dedupe metric_closure message_passing block_containment route_plans insertion_costs route_start edge_passes char_ngram_cosine tfidf_similarity fuzzy_class_match alias_best_match keyword_patterns box_clusters near_clusters merged_boxes dense_clusters axis_clusters projection_gaps wall_bands event_windows event_sessions".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
