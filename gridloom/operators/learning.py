"""Floors as heterogeneous graphs, a gated relational layer over them, scoring heads, and recommendations.

Weights are given, never learned here: small arrays that travel to the tasks, their size checked. Node and edge tables stay
DataFrames; messages meet by joins and sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import near_pairs, nearest

#: Features of nodes and edges, in order.
NODE_FEATURES = (
    "x", "y", "degree", "recognition_confidence", "virtual_access", "access_distance", "area_fraction", "area_portals", "portal_width", "portal_clearance", "portal_bottleneck", "portal_confidence", "connector_gap",
    "connector_confidence", "rule_mandatory", "rule_quota", "category_share", "present",
)
EDGE_FEATURES = ("distance", "width", "clearance", "confidence", "bottleneck", "gap", "evidence", "decay")
#: Relations and their reverses.
RELATIONS = {
    "LOCATED_IN_AREA": "CONTAINS_TARGET", "INSTANCE_OF_CATEGORY": "HAS_INSTANCE", "GOVERNED_BY_RULE": "APPLIES_TO_TARGET", "HAS_RULE": "IN_FLOOR", "APPLIES_TO_CATEGORY": "GOVERNED_BY_RULE", "CONTAINS_AREA": "IN_FLOOR",
    "HAS_CATEGORY": "IN_FLOOR", "CONNECTED_VIA_PORTAL": "CONNECTS_AREA",
}
#: Bytes of weights that may travel to every task.
MOST_WEIGHTS = 64 << 20


def pair_edges(rows: DataFrame, relation: str, **features: str) -> DataFrame:
    """(floor, src, dst, relation, features map) of rows (floor, src, dst, ...), and the reverse relation."""
    kept = F.map_filter(F.create_map(*[x for n, c in features.items() for x in (F.lit(n), F.col(c).cast("double"))]), lambda k, v: v.isNotNull()) if features else F.create_map().cast("map<string,double>")
    one = rows.select("floor", "src", "dst", F.lit(relation).alias("relation"), kept.alias("features"))
    return one.unionByName(rows.select("floor", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(RELATIONS[relation]).alias("relation"), kept.alias("features")))


def floor_graph(targets: DataFrame, areas: DataFrame, rules: DataFrame, portals: DataFrame, radius: float = 0.15, most: int = 32) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all floors: targets (floor, target, x, y, area, category, rule, confidence, virtual, access), areas (floor, area,
    x, y, size, portals), rules (rule, mandatory, quota, categories array), portals (floor, portal, area_a, area_b, x, y, width,
    clearance, bottleneck, confidence). Nodes are (floor, node, type, category, features); edges (floor, src, dst, relation, values,
    mask). Distances are parts of the floor's scale; targets near one another, within a radius of it, are linked both ways."""
    name = lambda kind, *c: F.concat_ws("::", F.lit(kind), *[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    floors = targets.select("floor").distinct()
    placed = targets.select("floor", "x", "y").unionByName(areas.select("floor", "x", "y")).unionByName(portals.select("floor", "x", "y"))
    scale = placed.groupBy("floor").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1.0)).alias("scale"))
    rule_at = floors.crossJoin(rules)  # a row a floor and rule: the rules are one configuration
    categories = targets.where("category <> ''").groupBy("floor", "category").agg(F.count("*").alias("n"))
    t = targets.withColumn("node", name("target", "target"))
    edges = [
        pair_edges(t.where("area is not null").select("floor", F.col("node").alias("src"), name("area", "area").alias("dst")), "LOCATED_IN_AREA"),
        pair_edges(t.where("category <> ''").select("floor", F.col("node").alias("src"), name("category", "category").alias("dst")), "INSTANCE_OF_CATEGORY"),
        pair_edges(t.join(rules.select("rule"), "rule", "left_semi").select("floor", F.col("node").alias("src"), name("rule", "rule").alias("dst")), "GOVERNED_BY_RULE"),
        pair_edges(rule_at.select("floor", F.lit("floor").alias("src"), name("rule", "rule").alias("dst")), "HAS_RULE"),
        pair_edges(rule_at.select("floor", "rule", F.explode("categories").alias("category")).join(categories.select("floor", "category"), ["floor", "category"], "left_semi").select("floor", name("rule", "rule").alias("src"), name("category", "category").alias("dst")), "APPLIES_TO_CATEGORY"),
        pair_edges(areas.select("floor", F.lit("floor").alias("src"), name("area", "area").alias("dst")), "CONTAINS_AREA"),
        pair_edges(categories.select("floor", F.lit("floor").alias("src"), name("category", "category").alias("dst")), "HAS_CATEGORY"),
    ]
    for side in ("area_a", "area_b"):
        rows = portals.where(F.col(side).isNotNull()).select("floor", name("area", side).alias("src"), name("portal", "portal").alias("dst"), "width", "clearance", "confidence", "bottleneck")
        edges.append(pair_edges(rows, "CONNECTED_VIA_PORTAL", width="width", clearance="clearance", confidence="confidence", bottleneck="bottleneck"))
    scaled = targets.join(scale, "floor").select("floor", F.col("target").alias("target_id"), (F.col("x") / F.col("scale")).alias("x"), (F.col("y") / F.col("scale")).alias("y"))
    near = nearest(near_pairs(scaled, radius), most)
    edges.append(near.select("floor", name("target", "target_id").alias("src"), name("target", "other_id").alias("dst"), F.lit("NEAR_TARGET").alias("relation"), F.create_map(F.lit("scaled"), F.col("distance"), F.lit("decay"), F.exp(-F.col("distance") / radius)).alias("features")))
    e = edges[0]
    for more in edges[1:]:
        e = e.unionByName(more)
    degree = e.select("floor", F.explode(F.array("src", "dst")).alias("node")).groupBy("floor", "node").agg(F.count("*").alias("degree"))

    def typed(df: DataFrame, kind: str, node: Column, category: Column, x: Column | None = None, y: Column | None = None, **given: Column) -> DataFrame:
        values = F.map_filter(F.create_map(*[v for n, c in given.items() for v in (F.lit(n), c.cast("double"))]), lambda k, v: v.isNotNull()) if given else F.create_map().cast("map<string,double>")
        none = F.lit(None).cast("double")
        return df.select("floor", node.alias("node"), F.lit(kind).alias("type"), category.alias("category"), (none if x is None else x).alias("x"), (none if y is None else y).alias("y"), values.alias("given"))

    total = areas.groupBy("floor").agg(F.sum(F.greatest("size", F.lit(0.0))).alias("_size"), F.greatest(F.max("portals"), F.lit(1)).alias("_portals"))
    count = targets.groupBy("floor").agg(F.count("*").alias("_targets"))
    at, none = (F.col("x"), F.col("y")), F.lit("")
    nodes = [
        typed(t.join(scale.select("floor", "scale"), "floor"), "InspectionTarget", F.col("node"), F.col("category"), *at, recognition_confidence=F.col("confidence"), virtual_access=F.col("virtual").cast("int"), access_distance=F.greatest("access", F.lit(0.0)) / F.col("scale")),
        typed(areas.join(total, "floor"), "AreaRegion", name("area", "area"), none, *at, area_fraction=F.greatest("size", F.lit(0.0)) / F.when(F.col("_size") > 0, F.col("_size")).otherwise(1.0), area_portals=F.col("portals") / F.col("_portals")),
        typed(portals.join(scale.select("floor", "scale"), "floor"), "Portal", name("portal", "portal"), none, *at, portal_width=F.col("width") / F.col("scale"), portal_clearance=F.col("clearance") / F.col("scale"), portal_bottleneck=F.col("bottleneck"), portal_confidence=F.col("confidence")),
        typed(categories.join(count, "floor"), "InspectionCategory", name("category", "category"), F.col("category"), category_share=F.col("n") / F.col("_targets")),
        typed(rule_at, "InspectionRule", name("rule", "rule"), none, rule_mandatory=F.col("mandatory").cast("int"), rule_quota=F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("quota") / 4.0))),
        typed(floors, "FloorContext", F.lit("floor"), none),
    ]
    n = nodes[0]
    for more in nodes[1:]:
        n = n.unionByName(more)
    n = n.join(scale, "floor").join(degree, ["floor", "node"], "left").na.fill({"degree": 0})
    top = F.greatest(F.log1p(F.max("degree").over(Window.partitionBy("floor"))), F.lit(1.0))
    own = {"x": (F.col("x") - F.col("x0")) / F.col("scale"), "y": (F.col("y") - F.col("y0")) / F.col("scale"), "degree": F.log1p("degree") / top, "present": F.lit(1.0)}
    features = F.array(*[F.coalesce(own.get(f, F.try_element_at("given", F.lit(f))), F.lit(0.0)) for f in NODE_FEATURES])
    n = n.select("floor", "node", "type", "category", features.alias("features"))
    lengths = {"distance", "width", "clearance", "gap"}
    value = lambda f: F.coalesce(F.try_element_at("features", F.lit("scaled")), F.try_element_at("features", F.lit(f)) / F.col("scale")) if f == "distance" else F.try_element_at("features", F.lit(f)) / F.col("scale") if f in lengths else F.try_element_at("features", F.lit(f))
    e = e.join(scale.select("floor", "scale"), "floor")
    e = e.select("floor", "src", "dst", "relation", F.array(*[F.coalesce(value(f), F.lit(0.0)) for f in EDGE_FEATURES]).alias("values"), F.array(*[value(f).isNotNull().cast("double") for f in EDGE_FEATURES]).alias("mask"))
    return n, e


def aligned(features: Column, names: Sequence[str], wanted: Sequence[str]) -> Column:
    """Features by name in another order; what isn't there is 0."""
    at = {n: k for k, n in enumerate(names)}
    return F.array(*[features[at[w]] if w in at else F.lit(0.0) for w in wanted])


def numbered_words(values: Column, vocabulary: Sequence[str], unknown: int = 0) -> Column:
    """Words as numbers from 1 by a vocabulary; others are `unknown`."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, w in enumerate(vocabulary, 1) for x in (F.lit(w), F.lit(k))]), values), F.lit(unknown)) if vocabulary else F.lit(unknown)


def shipped(spark, weights: Mapping[str, np.ndarray]):
    size = sum(np.asarray(w).nbytes for w in weights.values())
    if size > MOST_WEIGHTS:
        raise ValueError(f"{size} bytes of weights; {MOST_WEIGHTS} may travel to every task")
    return spark.sparkContext.broadcast({k: np.asarray(w, float) for k, w in weights.items()})


def dense(x: np.ndarray, w: Mapping[str, np.ndarray], name: str) -> np.ndarray:
    """A stack of linear layers name.0, name.1, ... (weight (in, out), bias) with the positive part between them."""
    k = 0
    while f"{name}.{k}.weight" in w:
        x = x @ w[f"{name}.{k}.weight"] + w[f"{name}.{k}.bias"]
        k += 1
        if f"{name}.{k}.weight" in w:
            x = np.maximum(x, 0)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def gated_layer(nodes: DataFrame, edges: DataFrame, weights: Mapping[str, np.ndarray], relations: Sequence[str], dim: int) -> DataFrame:
    """One edge-gated relational layer: nodes (floor, node, h), edges (floor, src, dst, relation, values, mask) to (floor, node, h).

    An edge's gate is the sigmoid of its relation's stack over values * mask and mask; its message is the source's h by the
    relation's matrix. A node adds the positive part of its own h by `self`, plus the gated mean of messages (the sum of gates, 1 at
    least), and is standardised over its components, then scaled by norm.weight and norm.bias. Edges of other relations count for
    nothing."""
    given = shipped(nodes.sparkSession, weights)
    known = edges.where(F.col("relation").isin(*relations))
    j = known.join(nodes.select("floor", F.col("node").alias("src"), "h"), ["floor", "src"])

    def send(batches):
        w = given.value
        for rows in batches:
            out = np.zeros((len(rows), dim + 1))
            h = np.array(rows["h"].tolist(), float).reshape(len(rows), dim)
            v, m = (np.array(rows[c].tolist(), float).reshape(len(rows), -1) for c in ("values", "mask"))
            for r in relations:
                own = (rows["relation"] == r).to_numpy()
                if own.any():
                    gate = sigmoid(dense(np.hstack([v[own] * m[own], m[own]]), w, f"gate.{r}"))
                    out[own] = np.hstack([gate * (h[own] @ w[f"relation.{r}"]), gate])
            yield pd.DataFrame({"floor": rows["floor"], "node": rows["dst"], **{f"m{k}": out[:, k] for k in range(dim + 1)}})

    names = [f"m{k}" for k in range(dim + 1)]
    kinds = f"floor {nodes.schema['floor'].dataType.simpleString()}, node {nodes.schema['node'].dataType.simpleString()}"
    sent = j.select("floor", "dst", "relation", "h", "values", "mask").mapInPandas(send, f"{kinds}, " + ", ".join(f"{n} double" for n in names))
    summed = sent.groupBy("floor", "node").agg(*[F.sum(n).alias(n) for n in names])

    def update(batches):
        w = given.value
        for rows in batches:
            h = np.array(rows["h"].tolist(), float).reshape(len(rows), dim)
            got = rows[names].fillna(0.0).to_numpy(float)
            new = h + np.maximum(0, dense(h, w, "self") + got[:, :dim] / np.maximum(got[:, dim:], 1.0))
            new = (new - new.mean(axis=1, keepdims=True)) / np.sqrt(new.var(axis=1, keepdims=True) + 1e-5) * w["norm.weight"] + w["norm.bias"]
            yield pd.DataFrame({"floor": rows["floor"], "node": rows["node"], "h": new.tolist()})

    return nodes.select("floor", "node", "h").join(summed, ["floor", "node"], "left").mapInPandas(update, f"{kinds}, h array<double>")


def embedded(nodes: DataFrame, weights: Mapping[str, np.ndarray], types: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """(floor, node, h): the sum of a node's type, its category (0 for unknown ones) and its features through a stack."""
    given = shipped(nodes.sparkSession, weights)
    kinds = f"floor {nodes.schema['floor'].dataType.simpleString()}, node {nodes.schema['node'].dataType.simpleString()}"
    coded = nodes.select("floor", "node", (numbered_words(F.col("type"), types) - 1).alias("t"), numbered_words(F.col("category"), categories).alias("c"), "features")

    def run(batches):
        w = given.value
        for rows in batches:
            x = np.array(rows["features"].tolist(), float)
            h = w["type"][rows["t"].to_numpy(int)] + w["category"][rows["c"].to_numpy(int)] + dense(x, w, "features")
            yield pd.DataFrame({"floor": rows["floor"], "node": rows["node"], "h": h.tolist()})

    return coded.mapInPandas(run, f"{kinds}, h array<double>")


def head_scores(rows: DataFrame, features: str, weights: Mapping[str, np.ndarray], name: str, out: str) -> DataFrame:
    """rows with the sigmoid of a stack over standardised features (name.mean, name.std)."""
    given = shipped(rows.sparkSession, weights)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        w = given.value
        v = (np.array(x.tolist(), float).reshape(len(x), -1) - w[f"{name}.mean"]) / np.maximum(w[f"{name}.std"], 1e-6)
        return pd.Series(sigmoid(dense(v, w, name)).reshape(len(x)))

    return rows.withColumn(out, score(F.col(features)))


def _each(f, *arrays: Column) -> Column:
    return F.zip_with(arrays[0], arrays[1], f)


def pair_features(left: str, right: str) -> Column:
    """Symmetric features of two targets, structs (embedding, context, x, y, scale, area, component, virtual): sums, differences and
    products of embeddings and contexts, then distances over the scale and what they share."""
    a, b = F.col(left), F.col(right)
    parts = [_each(f, a[c], b[c]) for c in ("embedding", "context") for f in (lambda x, y: x + y, lambda x, y: F.abs(x - y), lambda x, y: x * y)]
    scale = F.greatest(F.lit(1.0), a["scale"])
    dx, dy = F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"])
    same = lambda c: (F.coalesce(a[c] != "", F.lit(False)) & F.coalesce(a[c] == b[c], F.lit(False))).cast("double")
    far, virtual = F.hypot(dx, dy) / scale, (a["virtual"] | b["virtual"]).cast("double")
    return F.concat(*parts, F.array(far, dx / scale, dy / scale, same("area"), same("component"), 1 - virtual, virtual, far + 1 - same("component")))


def transition_features(left: str, right: str) -> Column:
    """Features of a step from one target to another: both embeddings, their differences and products, both contexts."""
    a, b = F.col(left), F.col(right)
    return F.concat(a["embedding"], b["embedding"], _each(lambda x, y: F.abs(x - y), a["embedding"], b["embedding"]), _each(lambda x, y: x * y, a["embedding"], b["embedding"]), a["context"], b["context"])


def successors(targets: DataFrame, steps: DataFrame, weights: Mapping[str, np.ndarray], most: int = 20) -> DataFrame:
    """(floor, src, dst, score, rank): the likeliest next targets. targets (floor, target, embedding, context, component); steps (floor,
    src, dst) are the pairs to judge, such as the nearest ones, so that no floor's product is made; targets of different components
    follow nothing of one another."""
    info = F.struct("embedding", "context", "component")
    a, b = targets.select("floor", F.col("target").alias("src"), info.alias("a")), targets.select("floor", F.col("target").alias("dst"), info.alias("b"))
    j = steps.where("src <> dst").join(a, ["floor", "src"]).join(b, ["floor", "dst"])
    j = j.where((F.coalesce("a.component", F.lit("")) == "") | (F.coalesce("b.component", F.lit("")) == "") | (F.col("a.component") == F.col("b.component")))
    scored = head_scores(j.select("floor", "src", "dst", transition_features("a", "b").alias("f")), "f", weights, "transition", "score").drop("f")
    place = F.row_number().over(Window.partitionBy("floor", "src").orderBy(F.desc("score"), "dst"))
    return scored.withColumn("rank", place).where(F.col("rank") <= most)


def pair_recommendations(pairs: DataFrame, scores: DataFrame, weight: float = 0.5, most: int = 20) -> DataFrame:
    """(floor, requirement, left, right, score, rank): pairs (floor, requirement, left, right, pair_score) ranked by their own score and
    the mean of their targets' (floor, target, score)."""
    of = lambda c: scores.select("floor", F.col("target").alias(c), F.col("score").alias(f"_{c}"))
    j = pairs.join(of("left"), ["floor", "left"], "left").join(of("right"), ["floor", "right"], "left").na.fill({"_left": 0.0, "_right": 0.0})
    j = j.withColumn("score", weight * F.col("pair_score") + (1 - weight) * (F.col("_left") + F.col("_right")) / 2)
    place = F.row_number().over(Window.partitionBy("floor", "requirement").orderBy(F.desc("score"), "left", "right"))
    return j.withColumn("rank", place).where(F.col("rank") <= most).select("floor", "requirement", "left", "right", "score", "rank")


def recommendation_view(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates (floor, target, u_rule) with the learned score, or what the rules say where there is none, and which of the two."""
    j = candidates.join(scores.select("floor", "target", F.col("score").alias("_learned")), ["floor", "target"], "left")
    return j.withColumns({"score": F.coalesce("_learned", "u_rule", F.lit(0.0)), "source": F.when(F.col("_learned").isNotNull(), "selection_head").otherwise("rule_value")}).drop("_learned")


def coverage(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Per floor how many candidates have a learned score, and whether all do."""
    j = candidates.join(scores.select("floor", "target", F.lit(1).alias("_s")).distinct(), ["floor", "target"], "left")
    return j.groupBy("floor").agg(F.count("*").alias("candidates"), F.count("_s").alias("scored"), (F.count("*") == F.count("_s")).alias("complete"))


def node_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(floor, component, node): skeleton, portal and virtual nodes (floor, component, node, kind) that have an edge (floor, a, b), by
    the free component that they lie in."""
    used = edges.select("floor", F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.where(F.col("kind").isin("skeleton", "portal", "virtual_target_access") & F.col("component").isNotNull()).join(used, ["floor", "node"], "left_semi").select("floor", "component", "node")
