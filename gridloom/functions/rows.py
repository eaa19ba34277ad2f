"""Readers of nested and loosely typed cells: geometries, model detections, distance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S

PAYLOAD = "lines array<array<array<double>>>, polygons array<array<array<double>>>"
_POINTS = "array<struct<x:double,y:double>>"


def points_of(path: Column) -> Column:
    """Points with two finite numbers each, of an array of arrays."""
    sound = lambda p: (F.size(p) >= 2) & F.coalesce(~F.isnan(p[0]) & ~F.isnan(p[1]) & (F.abs(p[0]) < float("inf")) & (F.abs(p[1]) < float("inf")), F.lit(False))
    return F.transform(F.filter(path, sound), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def geometry(cell: Column) -> Column:
    """struct(lines, polygons) of arrays of points from a geometry cell; what doesn't parse has none. Lines have two points and more,
    polygons four and more, as a ring names its end."""
    raw = F.from_json(cell, PAYLOAD)
    cut = lambda paths, least: F.filter(F.transform(F.coalesce(paths, F.array().cast("array<array<array<double>>>")), points_of), lambda p: F.size(p) >= least)
    return F.struct(cut(raw["lines"], 2).alias("lines"), cut(raw["polygons"], 4).alias("polygons"))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))


def polygons_of(cell: Column, entity_type: Column, x0: Column, y0: Column, x1: Column, y1: Column, least: float = 0.0) -> Column:
    """An entity's polygons of more than an area; circles, regions and solids without any stand by their box."""
    def area(p: Column) -> Column:
        n = F.size(p)
        turn = F.transform(p, lambda q, i: q["x"] * F.get(p, (i + 1) % n)["y"] - F.get(p, (i + 1) % n)["x"] * q["y"])
        return F.abs(F.aggregate(turn, F.lit(0.0), lambda a, t: a + t)) / 2

    own = F.filter(geometry(cell)["polygons"], lambda p: area(p) > least)
    stand_in = F.when(F.upper(entity_type).isin("CIRCLE", "REGION", "SOLID") & (x1 > x0) & (y1 > y0), F.array(box_ring(x0, y0, x1, y1)))
    return F.when(F.size(own) > 0, own).otherwise(F.coalesce(stand_in, F.array().cast(f"array<{_POINTS}>")))


def open_segments(cell: Column, entity_type: Column, is_closed: Column, dashed: Column) -> Column:
    """struct(ax, ay, bx, by) of an open, undashed line or polyline: two neighbouring points each, none of no length."""
    def cut(line: Column) -> Column:
        n = F.size(line)
        pair = F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
        return F.filter(pair, lambda s: (s["ax"] != s["bx"]) | (s["ay"] != s["by"]))

    wanted = F.upper(entity_type).isin("LINE", "LWPOLYLINE", "POLYLINE") & ~F.lower(F.coalesce(is_closed.cast("string"), F.lit(""))).isin("1", "true") & ~dashed
    return F.when(wanted, F.flatten(F.transform(geometry(cell)["lines"], cut))).otherwise(F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>"))


DETECTION = "buildings array<struct<building_id:string,bbox_1000:array<double>,bbox:array<double>,polygon_1000:array<array<double>>,polygon:array<array<double>>,name_text:string,label:string,confidence:string,needs_review:boolean,evidence:string>>"


def detections(rows: DataFrame, answer: str, width: str, height: str, labels: str) -> DataFrame:
    """A model's answers (JSON in text, in thousandths of an image) as validated buildings, one row each: rows' other columns, index,
    building_id, name_text, confidence (0 to 1), x0, y0, x1, y1 in pixels, needs_review and why. Boxes come from polygons where they
    are missing, and the other way round; buildings with neither are left out; missing names come from the labels."""
    parsed = F.from_json(S.json_in_text(F.col(answer)), DETECTION)
    held = lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1000.0), v)))

    def placed(b: Column) -> Column:
        polygon = F.coalesce(F.when(F.size(b["polygon_1000"]) >= 3, b["polygon_1000"]), F.when(F.size(b["polygon"]) >= 3, b["polygon"]))
        box = F.coalesce(F.when(F.size(b["bbox_1000"]) == 4, b["bbox_1000"]), F.when(F.size(b["bbox"]) == 4, b["bbox"]))
        at = [F.transform(polygon, lambda p: held(p[0])), F.transform(polygon, lambda p: held(p[1]))]
        low = [F.coalesce(F.least(held(box[k]), held(box[k + 2])), F.array_min(at[k])) for k in (0, 1)]
        high = [F.coalesce(F.greatest(held(box[k]), held(box[k + 2])), F.array_max(at[k])) for k in (0, 1)]
        sure = F.coalesce(b["confidence"].try_cast("double"), F.lit(0.0))
        return F.struct(b.alias("_b"), *[v.alias(n) for v, n in zip([*low, *high], ("_x0", "_y0", "_x1", "_y1"), strict=True)], F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 4).alias("confidence"))

    keys = rows.columns
    every = rows.select("*", F.transform(F.coalesce(parsed["buildings"], F.array().cast(DETECTION.split(" ", 1)[1])), placed).alias("_every"))
    sound = every.select(*keys, F.filter("_every", lambda r: (r["_x1"] > r["_x0"]) & (r["_y1"] > r["_y0"])).alias("_all"))
    found = sound.select(*keys, F.size("_all").alias("_many"), F.posexplode("_all").alias("_i", "_r"))
    label = F.coalesce(F.get(F.col(labels), F.col("_i")), F.lit(""))
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (F.col("_r._b.name_text"), F.col("_r._b.label"), label)], F.lit(""))
    few = F.size(F.coalesce(F.col(labels), F.array().cast("array<string>")))
    wrong = F.concat_ws(";", F.when((few > 0) & (F.col("_many") != few), "count_differs_from_title"), F.when(F.col("_r.confidence") < 0.5, "low_confidence"), F.when(F.coalesce(F.col("_r._b.needs_review"), F.lit(False)), "model_asks"))
    scale = {"x0": width, "x1": width, "y0": height, "y1": height}
    out = found.select(
        *keys, (F.col("_i") + 1).alias("building_index"), F.coalesce(F.nullif(F.trim("_r._b.building_id"), F.lit("")), F.format_string("B%02d", F.col("_i") + 1)).alias("building_id"), name.alias("name_text"), F.col("_r.confidence").alias("confidence"),
        *[F.round(F.col(f"_r._{c}") * F.col(s) / 1000.0, 3).alias(c) for c, s in scale.items()], wrong.alias("review_reason"),
    )
    return out.withColumn("needs_review", F.col("review_reason") != "")


PAIRS = "array<struct<target_a:string,source_target_id:string,source:string,target_b:string,target_target_id:string,target:string,distance:string,length:string,reachable:string>>"
BLOCK = f"target_ids array<string>, ids array<string>, distances string, distance_matrix string, pairs {PAIRS}"


def distance_rows(cells: DataFrame, floor: str, cell: str) -> DataFrame:
    """(floor, src, dst, distance) from JSON cells of several layouts: a matrix with its ids, a table of tables by id, or a list of
    pairs (which hold both ways). Missing, infinite, negative and unreachable distances have no row."""
    b = cells.select(F.col(floor).alias("floor"), F.from_json(F.col(cell), BLOCK).alias("b"))
    ids = F.coalesce("b.target_ids", "b.ids")
    table = F.coalesce("b.distances", "b.distance_matrix")
    grid = F.from_json(table, "array<array<string>>")
    rows = b.select("floor", ids.alias("ids"), F.posexplode(F.when(F.ltrim(table).startswith("["), grid)).alias("i", "row"))
    listed = rows.select("floor", "ids", "i", F.posexplode("row").alias("j", "v")).select("floor", F.get("ids", "i").alias("src"), F.get("ids", "j").alias("dst"), "v")
    nested = b.select("floor", F.explode(F.when(F.ltrim(table).startswith("{"), F.from_json(table, "map<string,map<string,string>>"))).alias("src", "row")).select("floor", "src", F.explode("row").alias("dst", "v"))
    p = b.select("floor", F.explode("b.pairs").alias("p")).where(~F.lower(F.coalesce("p.reachable", F.lit("true"))).isin("false", "0", "no"))
    a, z, v = F.coalesce("p.target_a", "p.source_target_id", "p.source"), F.coalesce("p.target_b", "p.target_target_id", "p.target"), F.coalesce("p.distance", "p.length")
    pairs = p.select("floor", a.alias("src"), z.alias("dst"), v.alias("v"))
    every = listed.unionByName(nested).unionByName(pairs).unionByName(pairs.select("floor", F.col("dst").alias("src"), F.col("src").alias("dst"), "v"))
    d = F.col("v").try_cast("double")
    return every.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < float("inf"))).select("floor", "src", "dst", d.alias("distance")).distinct()
