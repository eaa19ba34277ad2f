"""Entity inventories: rows, catalogs by signature, summaries of layers, blocks and texts, block signatures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from .aggregates import review_priority, top_counter
from .evidence import expands, structural
from .graph import contains_marked

SIGNATURE = ("layer", "entity_type", "geometry_kind", "color", "linetype", "is_closed", "parent_block_name", "text_key")


def inventory_rows(entities: DataFrame) -> DataFrame:
    """One flat row an entity in 26 columns: its fields, the centre of its box and the box's area. Columns that a source lacks are the
    drawing's defaults: layout Model, no true colour, line weight or paths."""
    box_known = F.col("bbox_minx").isNotNull() & F.col("bbox_maxx").isNotNull()
    centre = lambda a, b: F.when(box_known, (F.col(a) + F.col(b)) / 2)
    area = F.when(box_known, F.greatest(F.lit(0.0), (F.col("bbox_maxx") - F.col("bbox_minx")) * (F.col("bbox_maxy") - F.col("bbox_miny"))))
    more = {"layout": F.lit("Model"), "true_color": F.lit(""), "lineweight": F.lit(""), "block_path": F.array().cast("array<string>"), "insert_path": F.array().cast("array<string>")}
    entities = entities.withColumns({c: v for c, v in more.items() if c not in entities.columns})
    return entities.select(
        F.format_string("CADOBJ_%07d", "object_id").alias("object_id"), "layout", "source", "depth", F.col("depth").alias("insert_depth"), "entity_type", "handle", "layer", "color", "true_color", "linetype", "lineweight",
        "parent_block_name", "block_path", "insert_path",
        "raw_text", "norm_text", "geometry_kind", "is_closed", centre("bbox_minx", "bbox_maxx").alias("x"), centre("bbox_miny", "bbox_maxy").alias("y"), "bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy",
        area.alias("bbox_area"),
    )


def first_distinct(df: DataFrame, keys: list[str], item: str, order: str, most: int, name: str) -> DataFrame:
    """Per key the first `most` distinct non-empty items in the order in which they come (equal places by the item), joined by |. Each item's first place
    is aggregated before a key's rows meet, so a hot key brings its distinct items only."""
    first = df.where((F.col(item).cast("string") != "") & F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(order).alias("_first"))
    ranked = first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_first", item))).where(F.col("_k") <= most)
    listed = F.array_sort(F.collect_list(F.struct("_k", F.col(item).cast("string").alias("_v"))))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_v"]), "|").alias(name))


def extent() -> list[Column]:
    """The extent of a group's boxes and its area, null where none has one."""
    ends = [F.min("bbox_minx"), F.min("bbox_miny"), F.max("bbox_maxx"), F.max("bbox_maxy")]
    area = F.greatest(F.lit(0.0), ends[2] - ends[0]) * F.greatest(F.lit(0.0), ends[3] - ends[1])
    return [e.alias(n) for e, n in zip([*ends, area], ("bbox_minx", "bbox_miny", "bbox_maxx", "bbox_maxy", "bbox_area"), strict=True)]


def catalog(entities: DataFrame) -> DataFrame:
    """One row a signature of eight fields (texts by their words), numbered by descending count and then the signature: extent,
    depths, review priority, and the first samples of ids and texts. The numbering counts ranks within counts, so no task holds
    all signatures' rows in order."""
    e = entities.withColumn("text_key", F.when(F.col("geometry_kind") == "text", F.col("norm_text")).otherwise(""))
    keys = [*SIGNATURE]
    said = (F.col("geometry_kind") == "text") & (F.col("norm_text") != "")
    area_like = F.col("geometry_kind").isin("hatch_area", "polyline_closed", "block_insert")
    priority = review_priority(F.count("*"), F.max(said), F.max(F.when(F.col("layer") != "", F.col("layer")).otherwise("0")), F.max(F.col("parent_block_name") != ""), F.max(area_like))
    g = e.groupBy(*keys).agg(F.count("*").alias("count"), F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"), priority.alias("llm_review_priority"), *extent())
    texts = first_distinct(e, keys, "raw_text", "object_id", 5, "raw_text_sample")
    ids = first_distinct(e, keys, "object_id", "object_id", 8, "sample_object_ids")
    return numbered(g.join(texts, keys, "left").join(ids, keys, "left"), "count", keys)


def numbered(df: DataFrame, count: str, keys: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place by descending count and then the keys: places within a count, after all rows of higher counts.
    Counts are few, so the running total over them is a small table."""
    before = df.groupBy(count).agg(F.count("*").alias("_n"))
    before = before.select(F.col(count).alias("_count"), (F.sum("_n").over(Window.orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(count).orderBy(*keys))
    return df.withColumn("_within", within).join(before, F.col(count) == F.col("_count")).withColumn(name, F.col("_before") + F.col("_within")).drop("_within", "_count", "_before")


def text_summary(entities: DataFrame, most: int = 20) -> DataFrame:
    """Per words of texts: count, extent, the most frequent layers, blocks and types, and the first ids."""
    e = entities.where("norm_text <> ''")
    g = e.groupBy("norm_text").agg(F.count("*").alias("count"), *extent())
    for item, name in (("layer", "layer_counter"), ("parent_block_name", "block_counter"), ("entity_type", "entity_type_counter")):
        g = g.join(top_counter(e, "norm_text", item, most).withColumnRenamed("counter", name), "norm_text", "left")
    return g.join(first_distinct(e, ["norm_text"], "object_id", "object_id", 8, "sample_object_ids"), "norm_text", "left")


def layer_summary(entities: DataFrame) -> DataFrame:
    """Per named layer the ten most frequent types and kinds, and eight of the blocks and texts, cut at 80 characters."""
    e = entities.where("layer <> ''").withColumns({"_block": F.substr("parent_block_name", F.lit(1), F.lit(80)), "_text": F.substr("norm_text", F.lit(1), F.lit(80))})
    g = e.groupBy("layer").agg(F.count("*").alias("count"))
    for item, name, most in (("entity_type", "entity_types", 10), ("geometry_kind", "geometry_kinds", 10), ("_block", "sample_blocks", 8), ("_text", "sample_texts", 8)):
        g = g.join(top_counter(e, "layer", item, most).withColumnRenamed("counter", name), "layer", "left")
    return g


def block_signatures(members: DataFrame) -> DataFrame:
    """Blocks from their members (block, member, entity_type, layer, text, child): counts, the first 24 texts, children, whether
    a block holds texts or structural geometry itself, and whether it or a block within it does; cycles are allowed."""
    direct = F.col("entity_type").isin("TEXT", "MTEXT", "ATTDEF")
    g = members.groupBy("block").agg(
        F.count("*").alias("entity_count"), F.max(direct).alias("has_direct_semantics"), F.max(structural(F.col("entity_type"), F.col("layer"), F.col("block"))).alias("has_direct_geometry_semantics"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("entity_type") == "INSERT", F.col("child")))), ",").alias("child_blocks"),
    )
    children = members.where("entity_type = 'INSERT' and child is not null").select("block", "child").distinct()
    for source, name in (("has_direct_semantics", "has_recursive_semantics"), ("has_direct_geometry_semantics", "has_recursive_geometry_semantics")):
        reached = contains_marked(children, g.where(source).select("block")).select("block", F.lit(True).alias(name))
        g = g.join(reached, "block", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    g = g.join(first_distinct(members, ["block"], "text", "member", 24, "text_samples"), "block", "left")
    stable = ("block", "entity_count", "child_blocks", "text_samples", "has_direct_semantics", "has_recursive_semantics", "has_direct_geometry_semantics", "has_recursive_geometry_semantics")
    return g.withColumn("signature_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stable]), 256))


def placed_blocks(inserts: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """The recursive scan: inserts (insert_id, block) and all that stands in them, down to a depth of `most`: (insert_id, block,
    depth, path, member, entity_type). One join a level, so a deep drawing takes as many rounds as it has levels."""
    level = inserts.select("insert_id", F.col("block"), F.lit(0).alias("depth"), F.col("block").alias("path"))
    out = None
    for depth in range(1, most + 1):
        inside = level.join(members, "block").select("insert_id", "block", F.lit(depth).alias("depth"), "path", "member", "entity_type", "layer", "child")
        out = inside if out is None else out.unionByName(inside)
        level = inside.where("entity_type = 'INSERT' and child is not null").select("insert_id", F.col("child").alias("block"), "depth", F.concat_ws("/", "path", "child").alias("path"))
    return out


def expanded(inserts: DataFrame, members: DataFrame, attributes: DataFrame, signatures: DataFrame | None, most: int) -> DataFrame:
    """The rows of a scan into inserts (layout, insert_id, handle, block, layer): the insert itself, its attributes (owner: the insert or
    the member that is one, attribute, layer, text), and what stands in its block (members: block, member, handle, entity_type,
    layer, text, child), down to a depth.
    Each has its source, depth, block_path, insert_path and parent_block_name. With signatures (as of block_signatures) only blocks
    that hold texts or structural geometry somewhere are entered, and only such members come out."""
    none = F.array().cast("array<string>")
    added = lambda path, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(path, F.array(F.col(c).cast("string")))).otherwise(path)
    out = ["layout", "insert_id", "member", "source", "depth", "entity_type", "layer", "text", "block_path", "insert_path", "parent_block_name"]
    level = inserts.withColumns({"depth": F.lit(0), "member": F.lit(None).cast(members.schema["member"].dataType), "block_path": added(none, "block"), "insert_path": added(none, "handle")})
    rows = None
    for depth in range(most + 1):
        box = level.select("layout", "insert_id", "member", F.lit("insert_container").alias("source"), F.lit(depth).alias("depth"), F.lit("INSERT").alias("entity_type"), "layer", F.lit("").alias("text"), "block_path", "insert_path", F.col("block").alias("parent_block_name"))
        rows = box if rows is None else rows.unionByName(box)
        own = level.select("layout", "insert_id", F.coalesce("member", "insert_id").alias("owner"), "block", "block_path", "insert_path").join(attributes.select("owner", "attribute", "layer", "text"), "owner")
        rows = rows.unionByName(own.select("layout", "insert_id", F.col("attribute").alias("member"), F.lit("insert_attrib").alias("source"), F.lit(depth + 1).alias("depth"), F.lit("ATTRIB").alias("entity_type"), "layer", "text", "block_path", "insert_path", F.col("block").alias("parent_block_name")))
        if depth == most:
            break
        entered = level if signatures is None else level.join(signatures.where("has_recursive_semantics or has_recursive_geometry_semantics").select("block"), "block", "left_semi")
        inside = entered.select("layout", "insert_id", "block", "block_path", "insert_path").join(members.select("block", "member", F.col("handle").alias("_handle"), "entity_type", "layer", "text", "child"), "block")
        plain = inside.where("entity_type <> 'INSERT'")
        if signatures is not None:
            plain = plain.where(expands(F.col("entity_type"), F.col("layer"), F.array_join("block_path", "/"), F.lit(depth + 1)))
        rows = rows.unionByName(plain.select("layout", "insert_id", "member", F.lit("virtual_entity_in_insert").alias("source"), F.lit(depth + 1).alias("depth"), "entity_type", "layer", "text", "block_path", "insert_path", F.col("block").alias("parent_block_name")))
        below = inside.where("entity_type = 'INSERT'").select("layout", "insert_id", "member", F.col("child").alias("block"), F.col("_handle").alias("handle"), "layer", "block_path", "insert_path")
        level = below.withColumns({"block_path": added(F.col("block_path"), "block"), "insert_path": added(F.col("insert_path"), "handle")})
    return rows.select(*out)


#: Corners of a circle and points of an arc.
CORNERS, ARC_POINTS = 48, 24


def shape_points(entity_type: Column, points: Column, closed: Column, x: Column, y: Column, radius: Column, start: Column, end: Column) -> Column:
    """struct(lines, polygons) of an entity, arrays of paths of [x, y]: lines and polylines by their points (closed ones as rings, also as
    polygons from three corners on), circles as polygons of 48 corners, arcs as lines of 24 points from start to end in degrees."""
    kind, at = F.upper(entity_type), lambda t: F.array(x + radius * F.cos(t), y + radius * F.sin(t))
    circle = F.transform(F.sequence(F.lit(0), F.lit(CORNERS)), lambda i: at(F.lit(2 * math.pi) * (i % CORNERS) / CORNERS))
    turn = F.when(end < start, end + 360.0).otherwise(end) - start
    arc = F.transform(F.sequence(F.lit(0), F.lit(ARC_POINTS - 1)), lambda i: at(F.radians(start + turn * i / (ARC_POINTS - 1))))
    path = F.filter(F.coalesce(points, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)
    n = F.size(path)
    ring = F.when(F.element_at(path, 1) == F.element_at(path, -1), path).otherwise(F.concat(path, F.slice(path, 1, 1)))
    none, one = F.array().cast("array<array<array<double>>>"), lambda c: F.array(c)
    out = lambda lines, polygons: F.struct(lines.alias("lines"), polygons.alias("polygons"))
    whole, drawn = F.coalesce(closed, F.lit(False)) & (n >= 2), kind.isin("LINE", "LWPOLYLINE", "POLYLINE", "HATCH") & (n >= 2)
    round_ok = F.coalesce(radius > 0, F.lit(False)) & x.isNotNull() & y.isNotNull()
    return (
        F.when(drawn & whole & (kind != "LINE"), out(one(ring), F.when(F.size(ring) >= 4, one(ring)).otherwise(none)))
        .when(drawn, out(one(path), none))
        .when((kind == "CIRCLE") & round_ok, out(none, one(circle)))
        .when((kind == "ARC") & round_ok, out(one(arc), none))
    )


def geometry_rows(entities: DataFrame, shape: str) -> DataFrame:
    """Entities with a shape, as shape_points gives it: geometry_json and its counts, length and area."""
    s = F.col(shape)
    steps = lambda p, f: F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), f), F.lit(0.0), lambda a, v: a + v)
    length = F.aggregate(F.transform(s["lines"], lambda p: steps(p, lambda a, b: F.hypot(b[0] - a[0], b[1] - a[1]))), F.lit(0.0), lambda a, v: a + v)
    area = F.aggregate(F.transform(s["polygons"], lambda p: F.abs(steps(p, lambda a, b: a[0] * b[1] - b[0] * a[1])) / 2), F.lit(0.0), lambda a, v: a + v)
    count = F.size(F.flatten(s["lines"])) + F.size(F.flatten(s["polygons"]))
    e = entities.where(s.isNotNull()).withColumns({"geometry_point_count": count, "geometry_line_count": F.size(s["lines"]), "geometry_polygon_count": F.size(s["polygons"]), "geometry_length": length, "geometry_area": area})
    return e.withColumn("geometry_json", F.to_json(F.struct(F.lit(1).alias("version"), F.upper("entity_type").alias("entity_type"), s["lines"].alias("lines"), s["polygons"].alias("polygons"), F.col("geometry_point_count").alias("point_count"))))


def region_or_sheet(row: dict[str, Column]) -> Column:
    """A sheet's inspection region if it has one of positive size, else its box, else null."""
    def sound(prefix: str) -> Column:
        x0, y0, x1, y1 = (row[f"{prefix}_{c}"] for c in ("minx", "miny", "maxx", "maxy"))
        return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))

    return F.coalesce(sound("inspection_region"), sound("bbox"))


def annotation_box(minx: Column, miny: Column, maxx: Column, maxy: Column, x: Column, y: Column) -> Column:
    """The box shown about an object: 250 about its point where it has none of its own, at least 600 by 360, and a margin of 18 %
    of its longer side between 180 and 800."""
    sound = (maxx > minx) & (maxy > miny)
    point = F.when(x.isNotNull() & y.isNotNull(), F.struct((x - 250.0).alias("x0"), (y - 250.0).alias("y0"), (x + 250.0).alias("x1"), (y + 250.0).alias("y1")))
    own = F.struct(minx.alias("x0"), miny.alias("y0"), maxx.alias("x1"), maxy.alias("y1"))

    def shown(b: Column) -> Column:
        pad = F.greatest(F.lit(180.0), F.least(F.lit(800.0), F.greatest(B.width(b), B.height(b)) * 0.18))
        dx, dy = F.greatest(F.lit(0.0), 600.0 - B.width(b)) / 2 + pad, F.greatest(F.lit(0.0), 360.0 - B.height(b)) / 2 + pad
        return F.when(b.isNotNull(), F.struct((b["x0"] - dx).alias("x0"), (b["y0"] - dy).alias("y0"), (b["x1"] + dx).alias("x1"), (b["y1"] + dy).alias("y1")))

    return F.transform(F.array(F.when(F.coalesce(sound, F.lit(False)), own).otherwise(point)), shown)[0]
