"""Keyed joins: decisions, identities with a fallback, allowed sets, synthetic candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_decisions(decisions: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One decision a key, the latest by order: a partial aggregate before the shuffle."""
    return decisions.groupBy(key).agg(*[F.max_by(v, order).alias(v) for v in values])


def merged_identity(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (floor, object_id) with node_id: by floor and object, else by the object alone where it is unique over all
    floors. Of several nodes of a floor the one with an access id comes first, then the smaller id."""
    rank = F.struct((~F.col("has_access")).cast("int"), F.col("node_id"))
    per_floor = nodes.groupBy("floor", "object_id").agg(F.min_by("node_id", rank).alias("exact"))
    alone = nodes.groupBy("object_id").agg(F.count("*").alias("n"), F.first("node_id").alias("only")).where("n = 1").select("object_id", "only")
    return rows.join(per_floor, ["floor", "object_id"], "left").join(alone, "object_id", "left").select(
        *rows.columns, F.coalesce("exact", "only").alias("node_id"), F.when(F.col("exact").isNotNull(), "floor").when(F.col("only").isNotNull(), "unique").otherwise("none").alias("matched")
    )


def with_fallback(groups: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Candidates of each group, or, for groups without any, as many synthetic ids as the group counts."""
    real = candidates.select(key, "candidate", F.lit(False).alias("synthetic"))
    empty = groups.join(candidates, key, "left_anti")
    made = empty.select(key, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n"))).cast("array<int>")).alias("i"), "n").where("i <= n")
    return real.unionByName(made.select(key, F.concat_ws("#", F.col(key).cast("string"), F.col("i").cast("string")).alias("candidate"), F.lit(True).alias("synthetic")))


def top_pairs(rows: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """Of a key's items the two of highest value, as a pair, ties to the larger item: each task keeps its two best before the
    shuffle, and all unordered pairs need never be made."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value), F.desc(item)))
    best = rows.withColumn("_k", place).where("_k <= 2")
    of = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    return best.groupBy(key).agg(F.count("*").alias("_n"), of(item, 1).alias("first"), of(item, 2).alias("second"), F.sum(value).alias("value")).where("_n = 2").drop("_n")


def requirement_pairs(candidates: DataFrame, requirements: DataFrame) -> DataFrame:
    """(requirement, left, right): all unordered pairs of the candidates (requirement, item) of requirements (requirement, quota) that
    ask for two. The pairs are the result; a requirement's pool is one floor's class."""
    asked = candidates.join(requirements.where("quota = 2").select("requirement"), "requirement", "left_semi").distinct()
    other = asked.select("requirement", F.col("item").alias("right"))
    return asked.select("requirement", F.col("item").alias("left")).join(other, "requirement").where("left < right")
