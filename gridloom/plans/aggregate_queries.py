"""Queries over summaries, rankings and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import selection as C
from ..operators import spatial as J
from ..operators.inventory import numbered
from ..sources import tables as T
from .join_queries import PARALLEL_SQL, segments
from .scalar_queries import ENTITIES_SQL, entities


def signature_catalog(spark: SparkSession, d: str) -> DataFrame:
    return A.signature_catalog(entities(spark, d))


SIGNATURE_CATALOG = f"""
WITH {ENTITIES_SQL}, g AS (SELECT layer, kind, closed, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, min(l_partkey) AS first_part FROM entities GROUP BY 1, 2, 3)
SELECT *, CASE WHEN n >= 100 THEN 3 WHEN n >= 20 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END + CASE WHEN kind = 'TEXT' THEN 3 ELSE 0 END + 2 + CASE WHEN kind = 'INSERT' THEN 1 ELSE 0 END
  + CASE WHEN kind IN ('HATCH', 'INSERT') OR kind = 'LWPOLYLINE' AND closed THEN 1 ELSE 0 END AS priority, row_number() OVER (ORDER BY n DESC, layer, kind, closed) AS rank FROM g"""


def group_summary_topn(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").select("event_type", "user_id", "value")
    counter = A.top_counter(e.select("event_type", F.col("user_id").cast("string").alias("user")), "event_type", "user", 20)
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("user_id").alias("users")).join(counter, "event_type")


GROUP_SUMMARY_TOPN = """
WITH c AS (SELECT event_type, CAST(user_id AS VARCHAR) AS u, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, u) AS k FROM c),
t AS (SELECT event_type, string_agg(u || ':' || n, ',' ORDER BY k) AS counter FROM r WHERE k <= 20 GROUP BY 1)
SELECT e.event_type, count(*) AS n, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users, any_value(counter) AS counter FROM events e JOIN t ON e.event_type = t.event_type GROUP BY 1"""


def inspection_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Instances by part name: texts and inserts count, other geometry supports; highest confidence; by count and name."""
    e = entities(spark, d).join(T.load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    counts = F.col("kind").isin("TEXT", "INSERT")
    g = e.groupBy("p_name").agg(F.sum(counts.cast("long")).alias("instances"), F.sum((~counts).cast("long")).alias("supporting"), F.max(F.col("l_quantity") / 50).alias("confidence"))
    return numbered(g, "instances", ["p_name"], "place")


INSPECTION_CATALOG = f"""
WITH {ENTITIES_SQL}, g AS (SELECT p_name, CAST(sum(CAST(kind IN ('TEXT', 'INSERT') AS INT)) AS BIGINT) AS instances, CAST(sum(CAST(kind NOT IN ('TEXT', 'INSERT') AS INT)) AS BIGINT) AS supporting, max(l_quantity / 50) AS confidence
  FROM entities JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT *, row_number() OVER (ORDER BY instances DESC, p_name) AS place FROM g"""


def robust_width_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = T.load(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    gate = A.robust_gate(rows, "l_suppkey", "l_quantity")
    return gate.groupBy("l_suppkey").agg(F.max("median").alias("median"), F.max("mad").alias("mad"), F.sum(F.col("rejected").cast("long")).alias("rejected"), F.sum(F.col("supported").cast("long")).alias("supported"), F.count("*").alias("n"))


ROBUST_WIDTH_GATE = """
WITH m AS (SELECT l_suppkey, median(l_quantity) AS median, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT l.l_suppkey, median(abs(l_quantity - m.median)) AS mad FROM lineitem l JOIN m USING (l_suppkey) GROUP BY 1),
h AS (SELECT l_suppkey, l_quantity, count(*) AS c FROM lineitem GROUP BY 1, 2),
p AS (SELECT x.l_suppkey, x.l_quantity, CAST(sum(y.c) AS BIGINT) - 1 AS peers FROM h x JOIN h y ON x.l_suppkey = y.l_suppkey AND y.l_quantity * 1.5 >= x.l_quantity AND y.l_quantity <= x.l_quantity * 1.5 GROUP BY 1, 2)
SELECT l.l_suppkey, max(m.median) AS median, max(a.mad) AS mad, CAST(sum(CAST(CASE WHEN m.n - 1 < 3 THEN l.l_quantity > 4 * m.median ELSE l.l_quantity > greatest(3 * m.median, m.median + 6 * a.mad) END AS INT)) AS BIGINT) AS rejected,
  CAST(sum(CAST(p.peers >= greatest(3, 0.25 * (m.n - 1)) AS INT)) AS BIGINT) AS supported, count(*) AS n
FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey JOIN a ON l.l_suppkey = a.l_suppkey JOIN p ON l.l_suppkey = p.l_suppkey AND l.l_quantity = p.l_quantity GROUP BY 1"""


def minmax_by_floor(spark: SparkSession, d: str) -> DataFrame:
    c = T.load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return A.min_max(c, "c_nationkey", "c_acctbal", "scaled").select("c_custkey", "c_nationkey", F.round("scaled", 6).alias("scaled"))


MINMAX_BY_FLOOR = """
SELECT c_custkey, c_nationkey, round(CASE WHEN max(c_acctbal) OVER w - min(c_acctbal) OVER w <= 1e-12 THEN 0.5 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END, 6) AS scaled
FROM customer WINDOW w AS (PARTITION BY c_nationkey)"""


def quantile_context(spark: SparkSession, d: str) -> DataFrame:
    """The 0.7 quantile of a floor's heights as clearance, the bottleneck score 1 / (1 + clearance), and the floor's scale."""
    b = T.target_boxes(spark, d)
    q = b.groupBy("floor").agg(F.percentile(B.height(F.col("b")), F.lit(0.7)).alias("q"), F.greatest(F.max("b.x1") - F.min("b.x0"), F.max("b.y1") - F.min("b.y0"), F.lit(1.0)).alias("scale"))
    return q.select("floor", F.round("q", 6).alias("clearance"), F.round(1 / (1 + F.col("q")), 6).alias("bottleneck"), F.round("scale", 6).alias("scale"))


QUANTILE_CONTEXT = f"""
WITH {T.BOXES_SQL}, q AS (SELECT floor, quantile_cont(y1 - y0, 0.7) AS q, greatest(max(x1) - min(x0), max(y1) - min(y0), 1) AS scale FROM boxes GROUP BY 1)
SELECT floor, round(q, 6) AS clearance, round(1 / (1 + q), 6) AS bottleneck, round(scale, 6) AS scale FROM q"""


def context_features(spark: SparkSession, d: str) -> DataFrame:
    """A: load density, N: neighbours' values weighted by decay; each scaled within its floor, and their mean."""
    t = T.targets(spark, d).withColumn("value", F.col("target_id") % 7 + 1)
    near = J.nearest(J.near_pairs(t.select("floor", "target_id", "x", "y"), 0.06), 32)
    weight = F.exp(-F.col("distance") / 0.06)
    n = near.join(t.select("floor", F.col("target_id").alias("other_id"), F.col("value").alias("v")), ["floor", "other_id"]).groupBy("floor", "target_id").agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias("n"), F.count("*").alias("load"))
    f = t.join(n, ["floor", "target_id"], "left").select("floor", "target_id", F.coalesce("n", F.lit(0.0)).alias("n"), (0.6 * F.log1p(F.coalesce("load", F.lit(0)))).alias("a"))
    f = A.min_max(A.min_max(f, "floor", "a", "a1"), "floor", "n", "n1")
    return f.select("floor", "target_id", F.round("a1", 6).alias("a"), F.round("n1", 6).alias("n"), F.round((F.col("a1") + F.col("n1")) / 2, 6).alias("u"))


CONTEXT_FEATURES = f"""
WITH {T.TARGETS_SQL}, j AS (SELECT a.floor, a.target_id, b.target_id % 7 + 1 AS v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance, b.target_id AS o FROM targets a JOIN targets b ON a.floor = b.floor AND a.target_id <> b.target_id),
r AS (SELECT *, row_number() OVER (PARTITION BY floor, target_id ORDER BY distance, o) AS k FROM j WHERE distance <= 0.06),
n AS (SELECT floor, target_id, sum(exp(-distance / 0.06) * v) / sum(exp(-distance / 0.06)) AS n, count(*) AS load FROM r WHERE k <= 32 GROUP BY 1, 2),
f AS (SELECT t.floor, t.target_id, coalesce(n.n, 0) AS n, 0.6 * ln(1 + coalesce(load, 0)) AS a FROM targets t LEFT JOIN n ON t.floor = n.floor AND t.target_id = n.target_id),
s AS (SELECT floor, target_id, CASE WHEN max(a) OVER w - min(a) OVER w <= 1e-12 THEN 0.5 ELSE (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) END AS a1,
  CASE WHEN max(n) OVER w - min(n) OVER w <= 1e-12 THEN 0.5 ELSE (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w) END AS n1 FROM f WINDOW w AS (PARTITION BY floor))
SELECT floor, target_id, round(a1, 6) AS a, round(n1, 6) AS n, round((a1 + n1) / 2, 6) AS u FROM s"""


def distance_stats(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between a user's events in seconds: legs, excess over an hour, long gaps, the largest."""
    v = T.load(spark, d, "events").select(F.col("user_id").alias("route"), F.col("event_type").alias("target"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hour = 3_600_000_000
    return A.legs(v).groupBy("route").agg(
        F.count("*").alias("legs"), F.sum(F.greatest(F.lit(0), F.col("gap") - hour)).alias("excess"), F.sum((F.col("gap") > hour * 24).cast("long")).alias("long_gaps"), F.max("gap").alias("longest"),
        F.sum((F.col("target") == F.col("to_target")).cast("long")).alias("same"),
    )


DISTANCE_STATS = """
WITH l AS (SELECT user_id AS route, event_type AS target, lead(event_type) OVER w AS to_target, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT route, count(*) AS legs, CAST(sum(greatest(0, gap - 3600000000)) AS BIGINT) AS excess, CAST(sum(CAST(gap > 86400000000 AS INT)) AS BIGINT) AS long_gaps, max(gap) AS longest, CAST(sum(CAST(target = to_target AS INT)) AS BIGINT) AS same
FROM l WHERE to_target IS NOT NULL GROUP BY 1"""


def visit_ordinals(spark: SparkSession, d: str) -> DataFrame:
    v = T.load(spark, d, "events").select(F.col("user_id").alias("route"), F.col("event_type").alias("target"), F.col("event_id").alias("seq"))
    return A.visit_ordinals(v)


VISIT_ORDINALS = """SELECT user_id AS route, event_type AS target, event_id AS seq, CAST(row_number() OVER w AS INT) AS ordinal, row_number() OVER w > 1 AS repeated FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)"""


def acceptance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, labelled ones, good ones, and their percentages; by language beside."""
    docs, labels = T.load(spark, d, "documents").select("doc_id", "source", "lang"), T.load(spark, d, "labels")
    g = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.sum(F.coalesce("quality", F.lit(0))).cast("long").alias("good"), F.countDistinct("lang").alias("languages"))
    return g.select("*", A.percent(F.col("labelled"), F.col("n")).alias("labelled_pct"), A.percent(F.col("good"), F.col("labelled")).alias("good_pct"))


ACCEPTANCE_METRICS = """
WITH g AS (SELECT source, count(*) AS n, count(quality) AS labelled, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS good, count(DISTINCT lang) AS languages FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)
SELECT *, coalesce(round_even(100 * CAST(labelled AS DOUBLE) / n, 2), 0) AS labelled_pct, CASE WHEN labelled = 0 THEN 0.0 ELSE round_even(100 * CAST(good AS DOUBLE) / labelled, 2) END AS good_pct FROM g"""


def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "v"))
    return e.groupBy("label", "k").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


MEAN_EMBEDDING = "SELECT label, CAST(i AS INT) AS k, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean FROM embeddings, range(64) t(i) GROUP BY 1, 2"


def vote_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return A.majority(T.load(spark, d, "labels").join(T.load(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source", "quality")


VOTE_DEDUPE = "SELECT source, CAST(sum(quality) * 2 > count(*) AS INT) AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1"


def rollup_report(spark: SparkSession, d: str) -> DataFrame:
    l = T.load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")  # noqa: E741
    return l.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


ROLLUP_REPORT = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """A cube, chosen grouping sets, and an approximate count of parts that is held against the exact one."""
    l = T.load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_partkey")  # noqa: E741
    measures = [F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("_about")]
    cube = l.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), *measures).withColumn("l_linenumber", F.lit(None).cast("int")).withColumn("kind", F.lit("cube"))
    sets = l.groupingSets([("l_returnflag", "l_linenumber"), ("l_linestatus",), ()], "l_returnflag", "l_linestatus", "l_linenumber").agg(F.grouping_id().alias("level"), *measures).withColumn("kind", F.lit("sets"))
    both = cube.unionByName(sets)
    return both.withColumn("close", F.abs(F.col("_about") - F.col("parts")) <= 0.1 * F.col("parts")).drop("_about")


GROUPING_SETS = """
SELECT l_returnflag, l_linestatus, CAST(NULL AS INT) AS l_linenumber, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_partkey) AS parts, 'cube' AS kind, true AS close FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber, CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS BIGINT), count(*), sum(l_quantity), count(DISTINCT l_partkey), 'sets', true FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linestatus), ())"""


def pool_and_rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = T.load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    rules = T.load(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") == 0).alias("mandatory"), (F.col("n_nationkey") % 4 * 25).cast("int").alias("quota"))
    return pool, rules


RULES_SQL = "rules AS (SELECT n_nationkey AS c_nationkey, n_regionkey = 0 AS mandatory, CAST(n_nationkey % 4 * 25 AS INT) AS quota FROM nation), chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN rules USING (c_nationkey)) WHERE mandatory OR rank <= quota)"


def quota_selection(spark: SparkSession, d: str) -> DataFrame:
    pool, rules = pool_and_rules(spark, d)
    return C.quota_selection(pool, rules, "c_nationkey", "c_custkey", "c_acctbal").select("c_nationkey", "c_custkey", "rank")


QUOTA_SELECTION = f"WITH {RULES_SQL} SELECT c_nationkey, c_custkey, CAST(rank AS INT) AS rank FROM chosen"


def requirement_audit(spark: SparkSession, d: str) -> DataFrame:
    pool, rules = pool_and_rules(spark, d)
    return C.requirement_audit(pool, C.quota_selection(pool, rules, "c_nationkey", "c_custkey", "c_acctbal"), rules, "c_nationkey")


REQUIREMENT_AUDIT = f"""
WITH {RULES_SQL}, p AS (SELECT c_nationkey, count(*) AS pool FROM customer GROUP BY 1), t AS (SELECT c_nationkey, count(*) AS chosen FROM chosen GROUP BY 1),
q AS (SELECT r.c_nationkey, mandatory, quota, coalesce(pool, 0) AS pool, coalesce(chosen, 0) AS chosen, CASE WHEN mandatory THEN coalesce(pool, 0) ELSE least(quota, coalesce(pool, 0)) END AS required FROM rules r LEFT JOIN p USING (c_nationkey) LEFT JOIN t USING (c_nationkey))
SELECT c_nationkey, pool, required, CAST(CASE WHEN mandatory THEN 0 ELSE quota - required END AS BIGINT) AS shortfall, chosen, chosen = required AS exact, chosen >= required AS enough FROM q"""


def rule_weights(spark: SparkSession, d: str) -> DataFrame:
    """1 for mandatory rules, else the quota's share of the pool."""
    pool, rules = pool_and_rules(spark, d)
    n = pool.groupBy("c_nationkey").agg(F.count("*").alias("pool"))
    w = F.when(F.col("mandatory"), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("quota"), F.col("pool")), F.lit(0.0))))
    return rules.join(n, "c_nationkey", "left").select("c_nationkey", F.round(w, 6).alias("weight"))


RULE_WEIGHTS = f"WITH {RULES_SQL}, p AS (SELECT c_nationkey, count(*) AS pool FROM customer GROUP BY 1) SELECT c_nationkey, round(CASE WHEN mandatory THEN 1.0::DOUBLE ELSE least(1.0, coalesce(quota / pool, 0.0)) END, 6) AS weight FROM rules LEFT JOIN p USING (c_nationkey)"


def distinct_category_pick(spark: SparkSession, d: str) -> DataFrame:
    pool = T.load(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")
    return C.distinct_categories(pool, "c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal", 2, 3).select("c_nationkey", "c_mktsegment", "c_custkey", "category_rank", "item_rank")


DISTINCT_CATEGORY_PICK = """
WITH t AS (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY sum(c_acctbal) DESC, c_mktsegment) AS category_rank FROM customer GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS item_rank FROM customer)
SELECT c_nationkey, c_mktsegment, c_custkey, CAST(category_rank AS INT) AS category_rank, CAST(item_rank AS INT) AS item_rank FROM i JOIN t USING (c_nationkey, c_mktsegment) WHERE category_rank <= 2 AND item_rank <= 3"""


def top_payload(spark: SparkSession, d: str) -> DataFrame:
    """The 350 parts of highest priority and count: a top-k, no full sort."""
    c = T.load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return c.withColumn("priority", A.review_priority(F.col("n"), F.col("q") > 45, F.lit("0"), F.col("l_partkey") % 2 == 0, F.lit(False))).orderBy(F.desc("priority"), F.desc("n"), "l_partkey").limit(350).select("l_partkey", "n", "priority")


TOP_PAYLOAD = """
WITH c AS (SELECT l_partkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_partkey, n, CASE WHEN n >= 100 THEN 3 WHEN n >= 20 THEN 2 WHEN n >= 5 THEN 1 ELSE 0 END + CASE WHEN q > 45 THEN 3 ELSE 0 END + CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END AS priority FROM c ORDER BY priority DESC, n DESC, l_partkey LIMIT 350"""


def best_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Per floor the sheet of the highest additive score, and how sure the floor's title vote is."""
    o = T.load(spark, d, "orders").select((F.col("o_custkey") % 40).alias("floor"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    score = F.when(F.col("o_orderstatus") != "P", 1000).otherwise(0) + F.least(F.lit(12000.0), F.col("o_totalprice") / 10) / 120 + F.when(F.col("o_orderpriority") == "1-URGENT", 80).otherwise(0)
    g = o.withColumn("score", score).groupBy("floor").agg(F.max_by("o_orderkey", F.struct("score", -F.col("o_orderkey"))).alias("sheet"), F.round(F.max("score"), 4).alias("score"), (F.sum((F.col("o_orderstatus") == "O").cast("int")) / F.count("*")).alias("s"))
    return g.select("floor", "sheet", "score", F.round(F.greatest(F.lit(0.72), F.least(F.lit(0.98), 0.6 + 0.5 * F.col("s"))), 6).alias("confidence"))


BEST_SHEET = """
WITH o AS (SELECT o_custkey % 40 AS floor, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN 1000 ELSE 0 END + least(12000, o_totalprice / 10) / 120 + CASE WHEN o_orderpriority = '1-URGENT' THEN 80 ELSE 0 END AS score FROM orders)
SELECT floor, arg_max(o_orderkey, (score, -o_orderkey)) AS sheet, round(max(score), 4) AS score, round(greatest(0.72, least(0.98, 0.6 + 0.5 * (sum(CAST(o_orderstatus = 'O' AS INT)) / count(*)))), 6) AS confidence FROM o GROUP BY 1"""


def ranking_frames(spark: SparkSession, d: str) -> DataFrame:
    c = T.load(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.floor("s_acctbal").alias("b"))
    w = Window.partitionBy("s_nationkey").orderBy("b", "s_suppkey")
    r = Window.partitionBy("s_nationkey").orderBy("b").rangeBetween(-1000, 0)
    return c.select("s_suppkey", F.dense_rank().over(Window.partitionBy("s_nationkey").orderBy("b")).alias("dense"), F.ntile(3).over(w).alias("third"), F.round(F.cume_dist().over(w), 6).alias("cumulative"), F.count("*").over(r).alias("near"), F.lag("s_suppkey").over(w).alias("before"))


RANKING_FRAMES = """
WITH c AS (SELECT s_suppkey, s_nationkey, CAST(floor(s_acctbal) AS BIGINT) AS b FROM supplier)
SELECT s_suppkey, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY b) AS INT) AS dense, CAST(ntile(3) OVER w AS INT) AS third, round(cume_dist() OVER w, 6) AS cumulative,
  count(*) OVER (PARTITION BY s_nationkey ORDER BY b RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near, lag(s_suppkey) OVER w AS before FROM c WINDOW w AS (PARTITION BY s_nationkey ORDER BY b, s_suppkey)"""


def annotation_nms(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of two classes a floor; a box gives way to a better one of its own class alone."""
    b = T.target_boxes(spark, d)
    kind, source = pick(["INSERT", "TEXT", "LINE"], F.col("target_id") % 3), pick(["direct_entity", "insert_container", "virtual_entity_in_insert", "insert_attrib"], F.col("target_id") % 4)
    score = C.annotation_priority(kind, F.lit(""), source, F.col("target_id") % 5 == 0).cast("double")
    rows = b.select("floor", (F.floor(F.col("target_id") / 3) % 2).alias("class"), F.col("target_id").alias("id"), score.alias("score"), F.col("b.x0").alias("x0"), F.col("b.y0").alias("y0"), F.col("b.x1").alias("x1"), F.col("b.y1").alias("y1"))
    return C.suppress(rows, ["floor", "class"], 0.55, 0.03).select("floor", "class", "id")


def pick(values: list[str], k: Column) -> Column:
    return F.array(*map(F.lit, values))[k.cast("int")]


ANNOTATION_NMS = f"""
WITH RECURSIVE {T.BOXES_SQL}, p AS (SELECT *, target_id // 3 % 2 AS class, CASE target_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 200 ELSE 0 END + CASE target_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN -10 ELSE 0 END + CASE WHEN target_id % 5 = 0 THEN 10 ELSE 0 END AS score FROM boxes),
o AS (SELECT *, floor * 2 + class AS g, row_number() OVER (PARTITION BY floor, class ORDER BY score DESC, (x1 - x0) * (y1 - y0), target_id) AS k FROM p),
hit AS (SELECT a.g, a.k, list(b.k) AS earlier FROM o a JOIN o b ON a.g = b.g AND b.k < a.k WHERE
  (greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) >= 0.55
  OR sqrt(((a.x0 + a.x1) - (b.x0 + b.x1)) ** 2 + ((a.y0 + a.y1) - (b.y0 + b.y1)) ** 2) / 2 <= 0.03 GROUP BY 1, 2),
s AS (SELECT g, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM o GROUP BY 1
  UNION ALL SELECT s.g, s.k + 1, CASE WHEN h.earlier IS NOT NULL AND list_has_any(h.earlier, s.kept) THEN s.kept ELSE list_append(s.kept, s.k + 1) END FROM s JOIN o ON o.g = s.g AND o.k = s.k + 1 LEFT JOIN hit h ON h.g = s.g AND h.k = s.k + 1),
f AS (SELECT g, arg_max(kept, k) AS kept FROM s GROUP BY 1)
SELECT o.floor, class, target_id AS id FROM o JOIN f ON o.g = f.g WHERE list_contains(kept, o.k)"""


def wall_matching(spark: SparkSession, d: str) -> DataFrame:
    pairs = J.parallel_pairs(segments(spark, d))
    rounded = pairs.select("floor", "left_id", "right_id", F.round("turned", 4).alias("turned"), F.round("common", 6).alias("common"), F.round("apart", 6).alias("apart"))
    return C.greedy_matching(rounded, "floor").select("floor", "left_id", "right_id")


WALL_MATCHING = f"""
WITH RECURSIVE {PARALLEL_SQL}, o AS (SELECT floor, left_id, right_id, row_number() OVER (PARTITION BY floor ORDER BY round(apart, 6), round(turned, 4), -round(common, 6), left_id, right_id) AS k FROM pairs),
s AS (SELECT floor, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS kept FROM o GROUP BY 1
  UNION ALL SELECT s.floor, s.k + 1, CASE WHEN list_has_any(s.used, [o.left_id, o.right_id]) THEN s.used ELSE list_concat(s.used, [o.left_id, o.right_id]) END,
    CASE WHEN list_has_any(s.used, [o.left_id, o.right_id]) THEN s.kept ELSE list_append(s.kept, o.k) END FROM s JOIN o ON o.floor = s.floor AND o.k = s.k + 1),
f AS (SELECT floor, arg_max(kept, k) AS kept FROM s GROUP BY 1)
SELECT o.floor, left_id, right_id FROM o JOIN f ON o.floor = f.floor WHERE list_contains(kept, o.k)"""


def row_bands(spark: SparkSession, d: str) -> DataFrame:
    """Every target's box, grown like a region's."""
    b = T.target_boxes(spark, d).withColumn("b", B.inflate(F.col("b"), 0.1))
    return C.row_bands(b.select("floor", F.col("target_id").alias("id"), F.col("b.x0").alias("x0"), F.col("b.y0").alias("y0"), F.col("b.x1").alias("x1"), F.col("b.y1").alias("y1")), "floor")


ROW_BANDS = f"""
WITH RECURSIVE {T.BOXES_SQL}, g AS (SELECT floor, target_id AS id, x0 - 0.1 AS x0, y0 - 0.1 AS y0, x1 + 0.1 AS x1, y1 + 0.1 AS y1 FROM boxes), h AS (SELECT floor, list_sort(list(y1 - y0)) AS hs FROM g GROUP BY 1),
o AS (SELECT g.*, (y0 + y1) / 2 AS cy, greatest(0.02, 0.45 * hs[CAST(len(hs) // 2 + 1 AS INT)]) AS tol, row_number() OVER (PARTITION BY g.floor ORDER BY (y0 + y1) / 2 DESC, id) AS k FROM g JOIN h USING (floor)),
s AS (SELECT floor, k, CAST(0 AS INT) AS band, cy AS centre, 1 AS n, id FROM o WHERE k = 1
  UNION ALL SELECT o.floor, o.k, CASE WHEN abs(o.cy - s.centre) > o.tol THEN s.band + 1 ELSE s.band END, CASE WHEN abs(o.cy - s.centre) > o.tol THEN o.cy ELSE s.centre + (o.cy - s.centre) / (s.n + 1) END, CASE WHEN abs(o.cy - s.centre) > o.tol THEN 1 ELSE s.n + 1 END, o.id FROM s JOIN o ON o.floor = s.floor AND o.k = s.k + 1)
SELECT s.floor, s.id, s.band, CAST(row_number() OVER (PARTITION BY s.floor ORDER BY s.band, o.x0, s.id) AS INT) AS place FROM s JOIN o ON o.floor = s.floor AND o.id = s.id"""


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Of three families of candidates the first that a nation has any of; and terms merged by their key."""
    s = T.load(spark, d, "supplier")
    families = [s.where("s_acctbal > 9000"), s.where("s_acctbal > 5000"), s]
    rows = [f.select("s_nationkey", "s_suppkey", F.lit(i).alias("family")) for i, f in enumerate(families)]
    u = rows[0].unionByName(rows[1]).unionByName(rows[2])
    best = u.groupBy("s_nationkey").agg(F.min("family").alias("family"))
    return u.join(best, ["s_nationkey", "family"])


CANDIDATE_UNION = """
WITH u AS (SELECT s_nationkey, s_suppkey, 0 AS family FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_nationkey, s_suppkey, 2 FROM supplier)
SELECT s_nationkey, family, s_suppkey FROM u WHERE (s_nationkey, family) IN (SELECT s_nationkey, min(family) FROM u GROUP BY 1)"""


def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Customers' and suppliers' nations by rounded balance: in both, in one alone; and edges that cross floors."""
    a = T.load(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 500).alias("v"))
    b = T.load(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 500).alias("v"))
    mark = lambda df, name: df.select(F.lit(name).alias("side"), "k", "v")
    return mark(a.intersect(b), "both").union(mark(b.subtract(a), "right")).union(mark(a.subtract(b), "left"))


SET_ALGEBRA = """
WITH a AS (SELECT c_nationkey AS k, CAST(floor(c_acctbal / 500) AS BIGINT) AS v FROM customer), b AS (SELECT s_nationkey AS k, CAST(floor(s_acctbal / 500) AS BIGINT) AS v FROM supplier)
SELECT 'both' AS side, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'left', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""


def resume_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content keys of finished work: a digest over ordered columns, in shards by its first two digits."""
    o = T.load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key = F.sha2(F.concat_ws("|", "n_name", F.col("n_regionkey").cast("string"), F.lit("v1")), 256)
    return o.select("n_nationkey", F.substr(key, F.lit(1), F.lit(20)).alias("version"), F.substr(key, F.lit(1), F.lit(2)).alias("shard"), S.identifier(F.col("n_name")).alias("name"))


RESUME_KEYS = "SELECT n_nationkey, substr(sha256(n_name || '|' || n_regionkey || '|v1'), 1, 20) AS version, substr(sha256(n_name || '|' || n_regionkey || '|v1'), 1, 2) AS shard, n_name AS name FROM nation"

_NAMES = "signature_catalog group_summary_topn inspection_catalog robust_width_gate minmax_by_floor quantile_context context_features distance_stats visit_ordinals acceptance_metrics mean_embedding vote_dedupe rollup_report grouping_sets quota_selection requirement_audit rule_weights distinct_category_pick top_payload best_sheet ranking_frames annotation_nms wall_matching row_bands candidate_union set_algebra resume_keys".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in _NAMES if n.upper() in globals()}
