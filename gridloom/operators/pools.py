"""Candidate pools, rule configurations, locked plans and the classification cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("mandatory_all", "quota_per_class", "quota_total", "distinct_category_group")


def candidate_pools(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """items (floor, item, raw_name, class) for each wanted (class, raw): on a floor the items of that raw name, and only
    where there is none those of the class."""
    j = items.join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, "class").withColumn("hit", F.col("raw_name") == F.col("raw"))
    any_hit = F.max("hit").over(Window.partitionBy("floor", "class", "raw"))
    return j.withColumn("any_hit", any_hit).where(F.col("hit") | ~F.col("any_hit")).select("floor", "class", "raw", "item", F.col("hit").alias("by_name"))


def checked_rules(rules: list[dict]) -> list[dict]:
    """A configuration's rules with their defaults; an unknown kind, a missing class or a quota under 1 raises."""
    out = []
    for i, r in enumerate(rules):
        kind = r.get("type")
        if kind not in KINDS:
            raise ValueError(f"rule {i}: type {kind!r} is none of {', '.join(KINDS)}")
        if not r.get("classes"):
            raise ValueError(f"rule {i}: no classes")
        quota = int(r.get("quota", 1))
        if quota < 1:
            raise ValueError(f"rule {i}: quota {quota}")
        out.append({"rule_id": r.get("rule_id", f"rule_{i}"), "type": kind, "classes": list(r["classes"]), "quota": quota})
    return out


def top_successors(legs: DataFrame, most: int) -> DataFrame:
    """Per source its most frequent successors, ties by name; counted before anything meets."""
    n = legs.groupBy("source", "next").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "next"))).where(F.col("rank") <= most)


def periodic_runs(offsets: DataFrame, least: int, tolerance: float) -> DataFrame:
    """Runs of at least `least` parallel lines (group, at) whose gaps differ from the gap before by at most the tolerance."""
    w = Window.partitionBy("group").orderBy("at")
    g = offsets.withColumn("gap", F.col("at") - F.lag("at").over(w)).where("gap IS NOT NULL")
    g = g.withColumn("new", F.coalesce((F.abs(F.col("gap") - F.lag("gap").over(w)) > tolerance * F.lag("gap").over(w)).cast("int"), F.lit(1)))
    g = g.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("group", "run").agg((F.count("*") + 1).alias("lines"), (F.min("at") - F.min_by("gap", "at")).alias("first_at"), F.avg("gap").alias("pitch")).where(F.col("lines") >= least).drop("run")
