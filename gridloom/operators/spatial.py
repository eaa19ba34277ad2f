"""Spatial joins on grid cells: equi-joins that Spark can distribute, then the exact predicate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..sources.shared import in_blocks, written


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


#: Cells along one side of a box at most; one that spans more is damaged, or the cells are far too small for it.
MOST_CELLS = 20_000


def bounded_sequence(first: Column, last: Column, most: int = MOST_CELLS) -> Column:
    """Whole numbers from first to last; more than `most` raise, so that one outlying coordinate can't fill the cluster."""
    n = F.concat_ws(" ", F.lit("a side spans too many cells:"), (last - first + 1).cast("string"))
    return F.when(last - first < most, F.sequence(first, last)).otherwise(F.raise_error(n))


def box_cells(b: Column, size: float) -> Column:
    """All cells that a box touches, as an array of struct(cx, cy)."""
    xs = bounded_sequence(cell(b["x0"], size), cell(b["x1"], size))
    ys = bounded_sequence(cell(b["y0"], size), cell(b["y1"], size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def point_in_boxes(points: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """All pairs of a point (floor, target_id, x, y) and a region (floor, region_id, b) of its floor that covers it."""
    spread = regions.select("floor", "region_id", "b", F.explode(box_cells(F.col("b"), size)).alias("c")).select("floor", "region_id", "b", "c.cx", "c.cy")
    placed = points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    return placed.join(spread, ["floor", "cx", "cy"]).where(B.covers(F.col("b"), F.col("x"), F.col("y"))).drop("cx", "cy")


def smallest_region(points: DataFrame, regions: DataFrame, size: float) -> DataFrame:
    """Per covered point its smallest region, ties to the smaller id: one aggregate, no sort."""
    pairs = point_in_boxes(points, regions, size)
    best = F.min(F.struct(B.area(F.col("b")).alias("area"), "region_id"))
    return pairs.groupBy("floor", "target_id").agg(best["region_id"].alias("region_id"), F.count("*").alias("n_covering"))


def touching_boxes(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (floor, p, ...) and (floor, q, ...) that touch or overlap, with their other columns. A pair is taken in the cell
    of its common corner alone, so none comes twice and no distinct is needed."""
    a = left.withColumn("_cell", F.explode(box_cells(F.col("p"), size)))
    b = right.withColumn("_cell", F.explode(box_cells(F.col("q"), size)))
    p, q = F.col("p"), F.col("q")
    low, high = (F.greatest(p["x0"], q["x0"]), F.greatest(p["y0"], q["y0"])), (F.least(p["x1"], q["x1"]), F.least(p["y1"], q["y1"]))
    joined = a.join(b, ["floor", "_cell"]).where((low[0] <= high[0]) & (low[1] <= high[1]))
    return joined.where((cell(low[0], size) == F.col("_cell.cx")) & (cell(low[1], size) == F.col("_cell.cy"))).drop("_cell")


def overlapping_boxes(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (floor, left_id, p) and (floor, right_id, q) that overlap."""
    both = touching_boxes(left.select("floor", "left_id", "p"), right.select("floor", "right_id", "q"), size)
    return both.where(B.common_area(F.col("p"), F.col("q")) > 0)


def best_overlap(points: DataFrame, regions: DataFrame, size: float, least: float = 0.5) -> DataFrame:
    """Per box (floor, left_id, p) the region that covers the largest share of it, from `least` on; ties to the smaller id."""
    pairs = overlapping_boxes(points, regions.select("floor", F.col("region_id").alias("right_id"), F.col("b").alias("q")), size)
    share = B.contained(F.col("p"), F.col("q"))
    found = pairs.withColumn("share", share).where(F.col("share") >= least)
    best = F.min(F.struct((-F.col("share")).alias("share"), F.col("right_id").alias("region_id")))
    return found.groupBy("floor", "left_id").agg(best["region_id"].alias("region_id"), (-best["share"]).alias("share"))


def near_pairs(targets: DataFrame, radius: float, probes: DataFrame | None = None) -> DataFrame:
    """Ordered pairs (floor, target_id, other_id, distance) of a target, or one of the probes, and another target within the
    radius: cells as wide as the radius, one side on its own cell and the other on the nine about it."""
    x, y = cell(F.col("x"), radius), cell(F.col("y"), radius)
    around = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((x + i).alias("cx"), (y + j).alias("cy")))))
    probe = (probes or targets).select("floor", "target_id", "x", "y", F.explode(around).alias("c")).select("floor", "target_id", "x", "y", "c.cx", "c.cy")
    other = targets.select("floor", F.col("target_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), x.alias("cx"), y.alias("cy"))
    pairs = probe.join(other, ["floor", "cx", "cy"]).where("target_id <> other_id").withColumn("distance", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
    return pairs.where(F.col("distance") <= radius).select("floor", "target_id", "other_id", "distance")


def nearest(pairs: DataFrame, most: int) -> DataFrame:
    """The nearest `most` others of each target, ties to the smaller id."""
    order = Window.partitionBy("floor", "target_id").orderBy("distance", "other_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def nearest_within(targets: DataFrame, radius: float, most: int) -> DataFrame:
    """nearest(near_pairs(targets, radius), most) without its rank and without a row for the pairs that it leaves out: the points of a
    cell against those of the nine about it, in blocks."""
    x, y = cell(F.col("x"), radius), cell(F.col("y"), radius)
    name = lambda i, j: F.concat_ws("/", "floor", (x + i).cast("string"), (y + j).cast("string"))
    known = targets.where("floor is not null and x is not null and y is not null")
    own = known.select("floor", "target_id", "x", "y", name(0, 0).alias("cell"))
    about = known.select(F.col("target_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.array(*[name(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("cell"))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["floor", "target_id", "other_id", "distance"])
        b = b.sort_values("other_id")
        ids, others = a["target_id"].to_numpy(), b["other_id"].to_numpy()
        d = np.hypot(a["x"].to_numpy(float)[:, None] - b["ox"].to_numpy(float), a["y"].to_numpy(float)[:, None] - b["oy"].to_numpy(float))
        d[~(d <= radius) | (ids[:, None] == others)] = np.inf
        last = np.partition(d, most - 1, axis=1)[:, most - 1] if len(b) > most else np.full(len(a), np.inf)
        i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
        order = np.lexsort((j, d[i, j], i))
        i, j = i[order], j[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < most
        i, j = i[kept], j[kept]
        return pd.DataFrame({"floor": a["floor"].iloc[0], "target_id": ids[i], "other_id": others[j], "distance": d[i, j]})

    kinds = dict(targets.dtypes)
    schema = f"floor {kinds['floor']}, target_id {kinds['target_id']}, other_id {kinds['target_id']}, distance double"
    return in_blocks(own, about, "cell", "target_id", run, schema)


def nearest_neighbors(targets: DataFrame, k: int, width: float) -> DataFrame:
    """Exactly the k nearest others on the same floor. Rounds of fourfold radius: a target is settled by a round in which it has k
    others within the radius, or in which the radius spans its floor. Only unsettled targets go on."""
    span = targets.groupBy("floor").agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    widest = span.agg(F.max("span")).first()[0] or 0.0
    found, todo, radius = None, targets, width
    while True:
        within = written(nearest(near_pairs(targets, radius, todo), k), "nearest")
        if radius >= widest:
            return within if found is None else found.unionByName(within)
        full = within.groupBy("floor", "target_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("floor", "target_id")
        settled = within.join(full, ["floor", "target_id"], "left_semi")
        found = settled if found is None else found.unionByName(settled)
        todo, radius = written(todo.join(full, ["floor", "target_id"], "left_anti"), "unsettled"), radius * 4
        if todo.isEmpty():
            return found


def directional_peers(segments: DataFrame, within: float = 10.0, most: int = 24) -> DataFrame:
    """Per segment (floor, seg_id, ax, ay, bx, by, angle) the nearest others, by their middles, whose directions differ by at most
    `within` degrees modulo 180: they meet by direction buckets of that width, each with its two neighbours."""
    n = int(180 / within)
    turn = F.least(F.floor(F.col("angle") / within), F.lit(n - 1)).cast("int")
    own = segments.select("floor", "seg_id", "angle", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"), turn.alias("turn"))
    left = own.withColumn("turn", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(F.col("turn") + i, F.lit(n))))))
    right = own.select("floor", "turn", F.col("seg_id").alias("peer_id"), F.col("angle").alias("pa"), F.col("mx").alias("px"), F.col("my").alias("py"))
    j = left.join(right, ["floor", "turn"]).where("seg_id <> peer_id").withColumn("turned", F.least(F.abs(F.col("angle") - F.col("pa")), 180 - F.abs(F.col("angle") - F.col("pa"))))
    j = j.where(F.col("turned") <= within).withColumn("distance", F.hypot(F.col("mx") - F.col("px"), F.col("my") - F.col("py")))
    rank = F.row_number().over(Window.partitionBy("floor", "seg_id").orderBy("distance", "peer_id"))
    return j.withColumn("rank", rank).where(F.col("rank") <= most).select("floor", "seg_id", "peer_id", "distance", "rank")


def parallel_pairs(segments: DataFrame, bucket: float = 5.0, overlap: float = 0.05, width: float = 0.6, size: float = 0.25) -> DataFrame:
    """Pairs of segments (floor, seg_id, ax, ay, bx, by, angle) whose directions differ by at most `bucket` degrees modulo
    180, that overlap along the first by more than a share of the shorter, and lie apart by at most a share of the overlap.
    Directions join on buckets of their own width and the two beside them, round the end. Within those, segments meet in grid cells:
    a partner lies within width times a segment's length, and a little more for its own turn, so boxes widened by that touch."""
    n = int(180 / bucket)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    own = segments.withColumn("turn", F.least(F.floor(F.col("angle") / bucket), F.lit(n - 1)).cast("int")).withColumn("length", length)
    slack = math.sin(math.radians(bucket)) / 2
    wide = lambda by: B.inflate_by(B.box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), by)
    near = F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(F.col("turn") + i, F.lit(n)))))
    left = own.select("*", near.alias("meet"))
    p = wide(F.col("length") * (width + slack) + 1e-9)
    q = wide(F.col("length") * slack + 1e-9)
    left = left.select(F.concat_ws("/", "floor", "meet").alias("floor"), F.col("floor").alias("of"), F.struct("seg_id", "ax", "ay", "bx", "by", "angle", "length").alias("l"), F.col("seg_id").alias("left_id"), p.alias("p"))
    right = own.select(F.concat_ws("/", "floor", "turn").alias("floor"), F.struct("seg_id", "ax", "ay", "bx", "by", "angle", "length").alias("r"), F.col("seg_id").alias("right_id"), q.alias("q"))
    j = touching_boxes(left, right, size).where("left_id < right_id")
    ux, uy = (F.col("l.bx") - F.col("l.ax")) / F.col("l.length"), (F.col("l.by") - F.col("l.ay")) / F.col("l.length")
    along = lambda px, py: (px - F.col("l.ax")) * ux + (py - F.col("l.ay")) * uy
    across = lambda px, py: (py - F.col("l.ay")) * ux - (px - F.col("l.ax")) * uy
    a, b = along(F.col("r.ax"), F.col("r.ay")), along(F.col("r.bx"), F.col("r.by"))
    j = j.withColumns({
        "turned": F.least(F.abs(F.col("l.angle") - F.col("r.angle")), 180 - F.abs(F.col("l.angle") - F.col("r.angle"))),
        "common": F.least(F.col("l.length"), F.greatest(a, b)) - F.greatest(F.lit(0.0), F.least(a, b)),
        "apart": F.abs((across(F.col("r.ax"), F.col("r.ay")) + across(F.col("r.bx"), F.col("r.by"))) / 2),
    })
    kept = (F.col("turned") <= bucket) & (F.col("common") > overlap * F.least("l.length", "r.length")) & (F.col("apart") > 0) & (F.col("apart") <= width * F.col("common"))
    return j.where(kept).select(F.col("of").alias("floor"), "left_id", "right_id", "turned", "common", "apart")
