"""The stages of a run over one drawing's tables, each written under a key of its content and skipped where that is there already.

    inventory     entities to a catalog of signatures
    objects       candidates to decisions: noise, aliases of upper floors, short words; what is left is ignored
    obstacles     segments to wall records, and what is free of them
    navigation    free space to components, portals and a skeleton's graph
    plan          targets, rules and ways to plans of all floors
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import evidence as E
from .operators import inventory as I
from .operators import overlays as O
from .operators import planner as N
from .operators import skeleton as K
from .operators import walls as W
from .sources.shared import content_key, done_before

#: Part of every key: results of other versions are made anew.
VERSION = "2"


@dataclass(frozen=True)
class StageResult:
    name: str
    key: str
    path: str
    reused: bool

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def fingerprint(df: DataFrame) -> str:
    """A number for a table's rows, whatever their order: their hashes' sum and count."""
    total = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
    return f"{total[0]}/{total[1]}"


def run_stage(spark: SparkSession, name: str, make: Callable[[], DataFrame], inputs: list[DataFrame | str], folder: str, **settings: object) -> StageResult:
    """One stage: its result under a key of the inputs, the settings and the version, made only if it isn't there. An input is a table,
    whose rows are then read once for their number, or the key of the stage that made it."""
    key = content_key(name, VERSION, *[i if isinstance(i, str) else fingerprint(i) for i in inputs], *sorted(settings.items()))
    at = f"{folder}/{name}"
    reused = done_before(spark, at, key)
    if not reused:
        make().write.mode("overwrite").parquet(f"{at}/{key}")
    return StageResult(name, key, f"{at}/{key}", reused)


def inventory(entities: DataFrame) -> DataFrame:
    return I.catalog(entities)


def objects(entities: DataFrame, aliases: DataFrame, known: list[str]) -> DataFrame:
    """Per distinct candidate what it is: (term, source_type, layer, parent_block_name, entity_type, floor_id, count, role, class,
    stage, confidence). Rules run on distinct candidates; noise first, then aliases that count on upper floors, then short words;
    classes that this kind of evidence can't prove, fire doors and lower stairs are ignored."""
    c = entities.withColumn("_c", E.candidate_term(F.col("entity_type"), F.col("norm_text"), F.col("parent_block_name"))).select("*", "_c.term", "_c.source_type")
    keys = ["term", "source_type", "layer", "parent_block_name", "entity_type", "geometry_kind", "floor_id"]
    d = c.groupBy(*keys).agg(F.count("*").alias("count")).withColumn("item", F.concat_ws("|", *[F.coalesce(k, F.lit("")) for k in keys]))
    noise = E.candidate_noise(*map(F.col, ("term", "source_type", "entity_type", "parent_block_name")), F.col("term").isin(*known))
    upper = E.best_upper_alias(d, aliases, "item", ["term", "layer", "parent_block_name"], ["floor_id"]).select("item", F.col("class").alias("_upper"))
    context = F.concat_ws(" ", *[F.coalesce(F.col(k), F.lit("")) for k in keys[:6]])
    place = [F.col(k) for k in ("term", "layer", "parent_block_name")]
    j = d.join(upper, "item", "left").withColumns({"_noise": noise, "_short": E.short_word(F.col("term"), context)})
    is_upper = S.is_upper_floor(F.col("floor_id"))
    proof = lambda name: E.allows_class(name, F.col("source_type"), F.col("entity_type"), E.stair(*place) & is_upper)
    none = F.struct(F.lit("IGNORE").alias("role"), F.lit("IGNORE").alias("class"), F.lit("").alias("stage"), F.lit(0.0).alias("confidence"))
    said = lambda name, stage, p: F.struct(F.lit("inspection_object").alias("role"), name.alias("class"), F.lit(stage).alias("stage"), p.cast("double").alias("confidence"))
    ignored = lambda why: none.withField("stage", F.lit(why) if isinstance(why, str) else why)
    m = (
        F.when(F.col("_noise").isNotNull(), ignored(F.col("_noise")))
        .when(F.col("_upper").isNotNull() & (F.col("_upper") == "安全出口") & E.fire_door(*place), ignored("fire_door_not_safety_exit"))
        .when(F.col("_upper").isNotNull() & proof(F.col("_upper")), said(F.col("_upper"), "upper_floor_alias_rule", F.lit(0.94)))
        .when(F.col("_short").isNotNull() & proof(F.col("_short.class")), said(F.col("_short.class"), "short_word_rule", F.col("_short.confidence")))
        .otherwise(ignored("undecided"))
    )
    return j.withColumn("m", m).select(*keys[:5], "floor_id", "count", "m.*")


def object_catalog(decisions: DataFrame) -> DataFrame:
    """Objects by class: how many, candidates, highest confidence, and the stages that decided, numbered by count."""
    g = decisions.where("role = 'inspection_object'").groupBy("class").agg(F.sum("count").alias("count"), F.countDistinct("term").alias("terms"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))
    return I.numbered(g, "count", ["class"])


def obstacles(segments: DataFrame) -> DataFrame:
    return W.wall_obstacles(segments)


def navigation(free: DataFrame, pixel: float) -> DataFrame:
    """The graphs of all components of free regions (scope, rings)."""
    return K.navigation_graph(K.components(free), pixel)


def refinement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Reachability of each scope's targets before and after edges were added: tables (scope, target, component). Refinement may only
    join: a scope in which two targets are parted afterwards raises."""
    def pairs(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy("scope", "component").agg(F.count("*").alias("n"))
        return sizes.groupBy("scope").agg((F.sum(F.when(F.col("component").isNotNull(), F.col("n") * (F.col("n") - 1) / 2).otherwise(0.0))).alias(name), F.sum("n").alias("targets"))

    j = pairs(before, "_b").join(pairs(after, "_a").drop("targets"), "scope")
    total = F.col("targets") * (F.col("targets") - 1) / 2
    rate = lambda c: F.when(total > 0, F.col(c) / total).otherwise(1.0)
    sure = F.when(F.col("_a") >= F.col("_b"), rate("_a")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("refinement parted targets of"), "scope")))
    return j.select("scope", "targets", rate("_b").alias("before"), sure.alias("after"))


def register_functions(spark: SparkSession) -> list[str]:
    """The scalar operators as SQL functions of the session: SQL bodies where they have one, so that the optimizer sees through them,
    and a vectorised function for the one that hasn't."""
    bodies = {
        "box_area(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) RETURNS DOUBLE": "greatest(0D, x1 - x0) * greatest(0D, y1 - y0)",
        "box_common(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE) RETURNS DOUBLE": "greatest(0D, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0D, least(ay1, by1) - greatest(ay0, by0))",
        "point_distance(x DOUBLE, y DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) RETURNS DOUBLE": "hypot(greatest(0D, x0 - x, x - x1), greatest(0D, y0 - y, y - y1))",
        "edit_similarity(a STRING, b STRING) RETURNS DOUBLE": "CASE WHEN a = b THEN 1D WHEN a = '' OR b = '' THEN 0D ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END",
        "physical_floor(scope STRING) RETURNS STRING": "split_part(scope, '__', 1)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    from .functions.similarity import jaro_winkler_udf

    spark.udf.register("jaro_winkler", jaro_winkler_udf)
    return [h.partition("(")[0] for h in bodies] + ["jaro_winkler"]


def run(spark: SparkSession, tables: dict[str, DataFrame], folder: str, pixel: float = 1.0, ratio: float = N.DMAX) -> dict[str, StageResult]:
    """All stages in order over tables: entities, aliases, segments, domains, solids (scope, ring), targets, requirements and ways.
    Finished stages are read, not made again."""
    t = tables
    out = {
        "inventory": run_stage(spark, "inventory", lambda: inventory(t["entities"]), [t["entities"]], folder),
        "objects": run_stage(spark, "objects", lambda: objects(t["entities"], t["aliases"], []), [t["entities"], t["aliases"]], folder),
        "obstacles": run_stage(spark, "obstacles", lambda: obstacles(t["segments"]), [t["segments"]], folder),
    }
    out["free"] = run_stage(spark, "free", lambda: O.not_all_blocked(O.free_regions(t["domains"], t["solids"])), [t["domains"], t["solids"]], folder)
    free = out["free"].read(spark)
    out["navigation"] = run_stage(spark, "navigation", lambda: navigation(free, pixel), [out["free"].key], folder, pixel=pixel)
    chosen = lambda: N.floor_plans(t["targets"], N.rule_targets(t["targets"], t["requirements"]), t["ways"], ratio=ratio)
    out["plan"] = run_stage(spark, "plan", chosen, [t["targets"], t["requirements"], t["ways"]], folder, ratio=ratio)
    return out
