"""Ordered rule cascades: the first rule that holds decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise(otherwise)


def any_term(c: Column, *terms: str) -> Column:
    """Whether a text holds one of the terms, in any case."""
    low = F.lower(c)
    return reduce(lambda a, t: a | low.contains(t.lower()), terms, F.lit(False))


def noise_reasons(df: DataFrame, text: str) -> DataFrame:
    """df with the reason for which a text can't name an object, or kept; null is empty."""
    c = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim(c)
    rules = [
        ("empty", bare == ""),
        ("single_character", F.length(bare) == 1),
        ("measurement", bare.rlike(r"^[0-9]+([.,][0-9]+)?$")),
        ("floor_code", F.upper(bare).rlike(r"^(B[1-8]|F?[1-9][0-9]?F?)$")),
        ("title_block", F.lower(c).rlike(r"^(note|notes|legend|drawing no|scale)\b")),
        ("legal", any_term(c, "license", "copyright")),
        ("ornament", c.rlike(r"[*#$%&]{3}")),
        ("table", c.contains(" | ")),
        ("too_long", F.length(c) > 4800),
    ]
    return df.withColumn("reason", first_rule(rules, "kept"))


def layer_roles(parts: DataFrame) -> DataFrame:
    """A layer's role by what its name says; a façade layer is never an obstacle, and the role it would have had is kept."""
    rules = [
        ("wall", F.col("p_name").contains("bolt")),
        ("column", F.col("p_name").contains("ring")),
        ("opening", F.col("p_name").contains("gear") | F.col("p_name").contains("plate")),
        ("filled", F.col("p_size") > 40),
    ]
    said, forced = first_rule(rules, "passable"), (F.col("p_type") == "PROMO") & (F.col("p_size") % 5 == 0)
    return parts.select(
        "p_partkey", F.when(forced, "not_obstacle").otherwise(said).alias("role"), F.when(forced, said).alias("overridden"), (rules[0][1] | rules[1][1]).alias("has_evidence")
    )


def preview(targets: DataFrame, columns: int, rows: int, most: int) -> DataFrame:
    """Targets on a grid over their floor's extent; of a cell the first `most` by id. One shuffle by floor and cell after a
    partial aggregate of the extents."""
    extent = targets.groupBy("floor").agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    cell = lambda v, a, b, n: F.least(F.lit(n - 1), F.floor((F.col(v) - F.col(a)) / F.greatest(F.col(b) - F.col(a), F.lit(1e-9)) * n)).cast("int")
    placed = targets.join(extent, "floor").select("floor", "target_id", cell("x", "ax", "bx", columns).alias("cx"), cell("y", "ay", "by", rows).alias("cy"))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("floor", "cx", "cy").orderBy("target_id")))
    return ranked.where(F.col("k") <= most).drop("k")
