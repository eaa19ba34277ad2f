"""Inspection candidates of floors: annotations to objects, pools and requirements by rules, graph data and rules of candidates, targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import polygons as P
from ..sources.shared import by_key

#: Rule types by the names under which a configuration may have them.
TYPES = {"all": "mandatory_all", "sample_total": "quota_per_class", "max_sample": "quota_per_class", "sample_each_subitem": "quota_per_class"}
KINDS = ("mandatory_all", "quota_per_class", "quota_total", "distinct_category_group")
RULES = "place int, id string, name string, type string, classes array<string>, quota int, categories int, instances int"


def loaded_rules(spark: SparkSession, config: dict) -> DataFrame:
    """A configuration's rules as a table; a configuration without a list of rules, and rules of unknown types, without classes or
    without sub-items, raise. Quotas are 2 and distinct categories 2 where they are missing."""
    if not isinstance(config.get("rules"), list):
        raise ValueError("a configuration needs a list named rules")
    rows = []
    for place, rule in enumerate(config["rules"]):
        if not isinstance(rule, dict):
            raise ValueError(f"rule {place} is no object")
        given = str(rule.get("type") or rule.get("mode") or "").strip()
        kind = TYPES.get(given, given)
        if kind not in KINDS:
            raise ValueError(f"rule {place}: unknown type {given!r}")
        items = rule.get("subitems") if given == "sample_each_subitem" else None
        if given == "sample_each_subitem" and not items or given != "sample_each_subitem" and not rule.get("classes"):
            raise ValueError(f"rule {place} has no {'sub-items' if given == 'sample_each_subitem' else 'classes'}")
        classes = [str(c).strip() for part in [rule, *(items or [])] for c in part.get("classes") or [] if str(c).strip()]
        name = str(rule.get("id") or rule.get("name") or kind)
        rows.append((place, name, str(rule.get("name") or name), kind, classes, int(rule.get("quota") or rule.get("sample_size") or 2), int(rule.get("required_distinct_categories") or 2), int(rule.get("instances_per_category") or 1)))
    return spark.createDataFrame(rows, RULES)


def distinct_objects(annotations: DataFrame) -> DataFrame:
    """One annotation of each object (floor, object, raw_name, raw_class, standard_class, item): one with an original name first, then one
    with a class, then the first item. Annotations without an object stand for themselves."""
    own = F.coalesce(F.nullif("object", F.lit("")), F.concat(F.lit("__item__"), F.col("item").cast("string")))
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", 0).otherwise(1)
    row = F.struct(*[c for c in annotations.columns if c not in ("floor", "object")])
    a = annotations.withColumn("object", own)
    return a.groupBy("floor", "object").agg(F.min_by(row, F.struct(known("raw_name"), known("standard_class"), "item")).alias("r")).select("floor", "object", "r.*")


def class_pools(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """(floor, class, object, basis): a class's objects by their original name, and only on floors without any by their class."""
    wanted = rules.select(F.explode("classes").alias("class")).distinct()
    said = objects.select("floor", "object", "raw_class", F.explode(F.array_distinct(F.array_compact(F.array("raw_class", "standard_class")))).alias("class"))
    said = said.join(wanted, "class", "left_semi").withColumn("by_name", F.coalesce(F.col("raw_class") == F.col("class"), F.lit(False)))
    named = said.groupBy("floor", "class").agg(F.max("by_name").alias("any"))
    j = said.join(named, ["floor", "class"]).where("by_name or not any")
    return j.select("floor", "class", "object", F.when(F.col("by_name"), "raw_name").otherwise("standard_class").alias("basis"))


def _of_rules(pools: DataFrame, rules: DataFrame) -> DataFrame:
    """A row a rule, class and pool member."""
    r = rules.select("place", "id", "type", "quota", "categories", F.posexplode("classes").alias("class_place", "class"))
    return pools.join(r, "class")


def requirements(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """What each floor must visit: (floor, requirement, rule, type, available, required, shortfall, status, candidates). Rules of a class
    each ask for all, or a quota, of what there is; a total asks for its quota over its classes; a category group for so many
    classes that have any. Floors without any candidate have the requirement too, of nothing."""
    pools = class_pools(objects, rules)
    members = _of_rules(pools, rules).where("type <> 'distinct_category_group'")
    each = F.col("type").isin("mandatory_all", "quota_per_class")
    name = F.when(each, F.concat_ws(":", "id", "class")).otherwise(F.col("id"))
    counted = members.withColumn("requirement", name).groupBy("floor", "requirement").agg(F.sort_array(F.collect_set("object")).alias("candidates"))
    present = _of_rules(pools, rules).where("type = 'distinct_category_group'").groupBy("floor", F.col("id").alias("requirement")).agg(F.countDistinct("class").alias("present"), F.sort_array(F.collect_set("object")).alias("members"))
    floors = objects.select("floor").distinct()
    per_class = rules.where("type in ('mandatory_all', 'quota_per_class')").select("id", "type", "quota", "categories", F.explode("classes").alias("class")).select(F.concat_ws(":", "id", "class").alias("requirement"), F.col("id").alias("rule"), "type", "quota", "categories")
    whole = rules.where("type in ('quota_total', 'distinct_category_group')").select(F.col("id").alias("requirement"), F.col("id").alias("rule"), "type", "quota", "categories")
    asked = per_class.unionByName(whole).agg(F.collect_list(F.struct("requirement", "rule", "type", "quota", "categories")).alias("_asked"))
    every = floors.crossJoin(F.broadcast(asked)).select("floor", F.explode("_asked").alias("r")).select("floor", "r.*")  # one row: the configuration
    j = every.join(counted, ["floor", "requirement"], "left").join(present, ["floor", "requirement"], "left")
    group = F.col("type") == "distinct_category_group"
    objects_of = F.coalesce(F.when(group, F.col("members")).otherwise(F.col("candidates")), F.array().cast("array<string>"))
    n, classes = F.size("candidates"), F.coalesce("present", F.lit(0))
    j = j.withColumn("candidates", objects_of)
    required = F.when(group, F.least("categories", classes)).when(F.col("type") == "mandatory_all", n).otherwise(F.least("quota", n))
    short = F.when(group, F.greatest(F.lit(0), F.col("categories") - classes)).otherwise(0)
    status = F.when(n == 0, "not_present").when(short > 0, "partially_available").when(group, "ready").otherwise("satisfied")
    return j.select("floor", "requirement", "rule", "type", n.cast("long").alias("available"), required.cast("long").alias("required"), short.cast("long").alias("shortfall"), status.alias("status"), "candidates")


def candidates(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """(floor, object, class, basis, matched, rule, rule_type, mandatory): objects that any rule asks for, under the class of the first
    rule that does; the rule that they count for is the first by name."""
    m = _of_rules(class_pools(objects, rules), rules)
    first = F.min_by(F.struct("class", "basis"), F.struct("place", "class_place"))
    g = m.groupBy("floor", "object").agg(first.alias("f"), F.sort_array(F.collect_set("id")).alias("matched"), F.min_by("type", "id").alias("rule_type"), F.max(F.col("type") == "mandatory_all").alias("mandatory"))
    return g.select("floor", "object", "f.class", "f.basis", "matched", F.col("matched")[0].alias("rule"), "rule_type", "mandatory")


def decorated(candidates: DataFrame, nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates (floor, target, class, matched) with their node's data (nodes: target, node_class, access, area, component, x, y), the
    first of their matched rules, or of the rules of their class where none of those is known, and whether any of them is mandatory."""
    c = candidates.join(nodes, "target", "left").withColumn("class", F.coalesce(F.nullif("class", F.lit("")), "node_class", F.lit(""))).drop("node_class")
    kind = rules.select("id", "type")
    named = c.select("floor", "target", F.posexplode("matched").alias("k", "id")).join(kind, "id").groupBy("floor", "target").agg(F.min_by(F.struct("id", "type"), "k").alias("named"), F.max(F.col("type") == "mandatory_all").alias("named_all"))
    of_class = rules.select("place", "id", "type", F.explode("classes").alias("class")).groupBy("class").agg(F.min_by(F.struct("id", "type"), "place").alias("general"), F.max(F.col("type") == "mandatory_all").alias("general_all"))
    j = c.join(named, ["floor", "target"], "left").join(of_class, "class", "left")
    rule = F.coalesce("named", "general")
    own = F.when(F.col("named").isNotNull(), F.col("named_all")).otherwise(F.col("general_all"))
    out = j.withColumns({"rule": F.coalesce(rule["id"], F.lit("")), "rule_mode": F.coalesce(rule["type"], F.lit("")), "quota_group": F.coalesce(rule["id"], F.col("class")), "mandatory": F.coalesce(own, F.lit(False))})
    return out.drop("named", "named_all", "general", "general_all")


def building_of(scope: Column, floor: Column, given: Column, covering: Column) -> Column:
    """A target's building: the given one, that of the member whose polygon covers it, or what the scope's name adds to its floor's, but
    for connections."""
    rest = F.when(F.startswith(scope, F.concat(floor, F.lit("__"))), F.substr(scope, F.length(floor) + 3))
    named = F.when(~F.startswith(rest, F.lit("CONN_")), rest)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.nullif(covering, F.lit("")), named, F.lit(""))


def covering_members(points: DataFrame, members: DataFrame) -> DataFrame:
    """(target, building) of points (scope, target, x, y) whose scope has a member (scope, place, building, ring) over them; the first
    by place counts. Members are a scope's few buildings; one task takes a scope's points."""

    def run(key: tuple, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found = pd.Series([None] * len(p), dtype=object)
        at = p[["x", "y"]].to_numpy(float)
        for r in m.sort_values("place", ascending=False).itertuples(index=False):
            ring = P.ring_of(np.asarray(r.ring, float).reshape(-1, 2))
            if ring is not None and len(p):
                found[P.covers([ring], at)] = r.building
        return pd.DataFrame({"target": p["target"].to_numpy(), "building": found})

    return by_key(points, "scope").cogroup(by_key(members.select(F.col("scope").alias("s"), "place", "building", "ring"), "s")).applyInPandas(run, "target long, building string")


def target_rows(annotations: DataFrame, members: DataFrame) -> DataFrame:
    """Targets of annotations (target, scope, floor, building, class, x0, y0, x1, y1) with a scope, numbered over all scopes in order:
    number, id, building, connection, x, y. A box that is none raises, as no target may get lost. Numbers are counted in two steps,
    scopes' totals and places within a scope."""
    sound = (F.col("x1") >= F.col("x0")) & (F.col("y1") >= F.col("y0"))
    a = annotations.withColumn("scope", F.when(F.coalesce(sound, F.lit(False)), F.col("scope")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no box of annotation"), F.col("target")))))
    a = a.where("scope is not null").withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})
    held = covering_members(a.select("scope", "target", "x", "y"), members).withColumnRenamed("building", "_covering")
    count = a.groupBy("scope").agg(F.count("*").alias("_n"))
    before = count.select("scope", (F.sum("_n").over(Window.orderBy("scope").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # a row a scope
    number = F.col("_before") + F.row_number().over(Window.partitionBy("scope").orderBy("target"))
    j = a.join(held, "target", "left").join(before, "scope").withColumn("number", number)
    connection = F.when(F.col("scope").contains("__CONN_"), F.regexp_extract("scope", "__CONN_(.*)$", 1)).otherwise("")
    return j.select("number", F.format_string("%s_TARGET_%07d", "scope", "number").alias("id"), "target", "scope", building_of(F.col("scope"), F.col("floor"), F.col("building"), F.col("_covering")).alias("building"), connection.alias("connection"), "class", "x", "y")
