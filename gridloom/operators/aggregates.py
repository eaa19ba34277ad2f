"""Grouped summaries: counters, catalogs, robust gates, scaling, reachability and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counter(df: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """Per key the most frequent non-empty items as "item:count" text, by count and then item: counts are aggregated before
    a key's rows come together, so a hot key brings its distinct items only."""
    counts = df.where((F.col(item).isNotNull()) & (F.col(item) != "")).groupBy(key, item).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), item))).where(F.col("k") <= most)
    listed = F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", F.col(item), F.col("n").cast("string")).alias("s"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("counter"))


def review_priority(count: Column, is_text: Column, layer: Column, is_block: Column, is_area: Column) -> Column:
    """3 from 100 on, 2 from 20, 1 from 5; with text +3, another layer than 0 +2, blocks and areas (hatches, closed polylines,
    inserts) +1 each."""
    tier = F.when(count >= 100, 3).when(count >= 20, 2).when(count >= 5, 1).otherwise(0)
    return tier + F.when(is_text, 3).otherwise(0) + F.when(layer != "0", 2).otherwise(0) + F.when(is_block, 1).otherwise(0) + F.when(is_area, 1).otherwise(0)


def signature_catalog(entities: DataFrame) -> DataFrame:
    """One row a signature (layer, kind, closed): count, extents, first samples and review priority, numbered by count."""
    g = entities.groupBy("layer", "kind", "closed").agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.min("l_partkey").alias("first_part")
    )
    priority = review_priority(F.col("n"), F.col("kind") == "TEXT", F.col("layer"), F.col("kind") == "INSERT", F.col("kind").isin("HATCH", "INSERT") | (F.col("kind") == "LWPOLYLINE") & F.col("closed"))
    from .inventory import numbered  # which builds on this module

    return numbered(g.withColumn("priority", priority), "n", ["layer", "kind", "closed"])


def robust_gate(df: DataFrame, group: str, value: str) -> DataFrame:
    """df with the group's median, median absolute deviation and whether the value is rejected: over max(3 medians, median +
    6 deviations), or over 4 medians in groups of fewer than 3 peers; supported if at least max(3, a quarter) of the group
    lies within 1.5 times of it either way."""
    med = df.groupBy(group).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    with_median = df.join(med, group)
    mad = with_median.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    both = with_median.join(mad, group)
    v, limit = F.col(value), F.greatest(3 * F.col("median"), F.col("median") + 6 * F.col("mad"))
    rejected = F.when(F.col("n") - 1 < 3, v > 4 * F.col("median")).otherwise(v > limit)
    # Peers within a ratio are a range over the logarithm.
    logs = F.log(v)
    near = F.expr(f"count(*) OVER (PARTITION BY `{group}` ORDER BY _log RANGE BETWEEN {LOG_NEAR}D PRECEDING AND {LOG_NEAR}D FOLLOWING)")
    counted = both.withColumns({"_log": logs, "rejected": rejected}).withColumn("peers", near - 1)
    return counted.withColumn("supported", F.col("peers") >= F.greatest(F.lit(3.0), 0.25 * (F.col("n") - 1))).drop("_log")


#: Logarithm of 1.5, a little wider than its last digit.
LOG_NEAR = 0.405465108109


def min_max(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """df with the value scaled to its group's range; 0.5 where all are equal."""
    extent = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") - F.col("_lo") <= 1e-12, 0.5).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(extent, group).withColumn(name, scaled).drop("_lo", "_hi")


def reachability(members: DataFrame) -> DataFrame:
    """Per floor from (floor, target_id, component): targets, attached share, the largest component (ties to the smaller) and
    the share of pairs within a component."""
    sizes = members.groupBy("floor", "component").agg(F.count("*").alias("n"))
    pairs = F.sum(F.when(F.col("component").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0.0))
    attached = F.sum(F.when(F.col("component").isNotNull(), F.col("n")).otherwise(0))
    total = F.sum("n")
    best = F.min(F.when(F.col("component").isNotNull(), F.struct((-F.col("n")).alias("n"), "component")))
    return sizes.groupBy("floor").agg(
        total.alias("n_targets"), F.round(attached / total, 6).alias("attach_rate"), best["component"].alias("primary_component"),
        F.round(F.when(total > 1, pairs / (total * (total - 1) / 2)).otherwise(1.0), 6).alias("pair_rate"),
    )


def percent(part: Column, whole: Column) -> Column:
    """A percentage rounded half to even to 2 places; 0 of nothing is 0."""
    return F.coalesce(F.bround(F.try_divide(100 * part.cast("double"), whole.cast("double")), 2), F.lit(0.0))


def visit_ordinals(visits: DataFrame) -> DataFrame:
    """visits (route, target, seq) with each visit's ordinal at its target and whether it repeats."""
    n = F.row_number().over(Window.partitionBy("route", "target").orderBy("seq"))
    return visits.withColumn("ordinal", n).withColumn("repeated", F.col("ordinal") > 1)


def legs(visits: DataFrame) -> DataFrame:
    """Consecutive visits of a route."""
    w = Window.partitionBy("route").orderBy("seq")
    return visits.withColumns({"to_target": F.lead("target").over(w), "gap": F.lead("at").over(w) - F.col("at")}).where(F.col("to_target").isNotNull())


def majority(samples: DataFrame, feature: str, label: str) -> DataFrame:
    """Per feature its majority label of 0 and 1; ties give 0."""
    votes = samples.groupBy(feature).agg(F.sum(label).alias("ones"), F.count("*").alias("n"))
    return votes.select(feature, (F.col("ones") * 2 > F.col("n")).cast("int").alias("label"), "n")
