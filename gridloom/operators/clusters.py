"""Clusters of boxes, cells and values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..sources.shared import written
from .graph import connected_components
from .spatial import bounded_sequence, overlapping_boxes, touching_boxes


def box_clusters(boxes: DataFrame, buffer: float, size: float, least: int = 1) -> DataFrame:
    """Boxes (floor, id, b) that touch when widened by the buffer, as clusters of at least so many: floor, cluster (smallest
    id), members and the cover. Ids are unique over floors."""
    wide = boxes.select("floor", "id", B.inflate(F.col("b"), buffer).alias("b"))
    pairs = overlapping_boxes(wide.select("floor", F.col("id").alias("left_id"), F.col("b").alias("p")), wide.select("floor", F.col("id").alias("right_id"), F.col("b").alias("q")), size)
    found = connected_components(pairs.select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    g = boxes.join(found.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id").groupBy("floor", "cluster")
    cover = B.box(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1"))
    return g.agg(F.count("*").alias("members"), cover.alias("b")).where(F.col("members") >= least)


def near_clusters(boxes: DataFrame, gap: float, size: float) -> DataFrame:
    """(id, cluster): boxes (floor, id, b) of which rounded margins of the gap meet, that is, which lie at most two gaps apart; a cluster
    has its smallest id."""
    wide = boxes.select("floor", "id", "b", B.inflate(F.col("b"), gap).alias("w"))
    left, right = wide.select("floor", F.col("id").alias("u"), F.col("b").alias("a"), F.col("w").alias("p")), wide.select("floor", F.col("id").alias("v"), F.col("b").alias("c"), F.col("w").alias("q"))
    a, c, zero = F.col("a"), F.col("c"), F.lit(0.0)
    apart = F.hypot(F.greatest(zero, a["x0"] - c["x1"], c["x0"] - a["x1"]), F.greatest(zero, a["y0"] - c["y1"], c["y0"] - a["y1"]))
    edges = touching_boxes(left, right, size).where((F.col("u") <= F.col("v")) & (apart <= 2 * gap)).select("u", "v")
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def merged_boxes(boxes: DataFrame, gap: float, size: float, rounds: int = 100) -> DataFrame:
    """Boxes (floor, id, b) merged until none lie within the gap of one another: covers of what is close are compared anew, as growth
    brings others near. (floor, id, members, b) with the smallest id; every round at least halves no less than one pair."""
    now = boxes.select("floor", "id", F.lit(1).cast("long").alias("members"), "b")
    for _ in range(rounds):
        now = written(now, "merged")
        wide = now.select("floor", "id", "b")
        left, right = wide.select("floor", F.col("id").alias("u"), B.inflate(F.col("b"), gap).alias("p")), wide.select("floor", F.col("id").alias("v"), F.col("b").alias("q"))
        edges = touching_boxes(left, right, size).where("u < v").select("u", "v")
        if edges.isEmpty():
            break
        found = connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("to"))
        g = now.join(found, "id", "left").groupBy("floor", F.coalesce("to", "id").alias("id"))
        now = g.agg(F.sum("members").alias("members"), B.box(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).alias("b"))
    return now


def dense_clusters(points: DataFrame, size: float, least: int) -> DataFrame:
    """Cells of at least one point joined with their four neighbours: floor, cluster (its smallest cell as text), cells and
    points, from so many points on."""
    cells = points.groupBy("floor", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy")).agg(F.count("*").alias("n"))
    name = lambda x, y: F.concat_ws("/", F.format_string("%05d", F.col("floor")), F.format_string("%08d", x + 1000), F.format_string("%08d", y + 1000))
    named = cells.withColumn("u", name(F.col("cx"), F.col("cy")))
    beside = F.explode(F.array(name(F.col("cx"), F.col("cy")), name(F.col("cx") + 1, F.col("cy")), name(F.col("cx"), F.col("cy") + 1)))
    edges = named.select("u", beside.alias("v")).join(named.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    found = connected_components(edges)
    return named.join(found.select(F.col("node").alias("u"), F.col("component").alias("cluster")), "u").groupBy("floor", "cluster").agg(F.count("*").alias("cells"), F.sum("n").alias("points")).where(F.col("points") >= least)


def axis_clusters(points: DataFrame, value: str, tolerance: float) -> DataFrame:
    """(floor, place, mean, n): sorted values of a floor in clusters; a value further than the tolerance from the running mean of the
    last cluster starts a new one. A gap of more than the tolerance always does, so floors are first cut at such gaps, and each run
    between them is a task of its own; places count on over the runs."""
    cut = points.select("floor", F.col(value).alias("v")).withColumn("new", F.coalesce((F.col("v") - F.lag("v").over(Window.partitionBy("floor").orderBy("v")) > tolerance).cast("int"), F.lit(0)))
    runs = cut.withColumn("run", F.sum("new").over(Window.partitionBy("floor").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for v in np.sort(rows["v"].to_numpy(float)):
            if not out or abs(v - out[-1][0]) > tolerance:
                out.append([v, 1])
            else:
                out[-1][1] += 1
                out[-1][0] += (v - out[-1][0]) / out[-1][1]
        return pd.DataFrame([(key[0], key[1], k, m, n) for k, (m, n) in enumerate(out)], columns=["floor", "run", "k", "mean", "n"])

    found = runs.groupBy("floor", "run").applyInPandas(chain, "floor int, run long, k int, mean double, n int")
    return found.select("floor", (F.row_number().over(Window.partitionBy("floor").orderBy("run", "k")) - 1).alias("place"), "mean", "n")


def projection_gaps(points: DataFrame, size: float, half: int) -> DataFrame:
    """Along each floor's x the bins whose average count over a window of bins is under one, as runs: first and last bin."""
    bins = points.groupBy("floor", F.floor(F.col("x") / size).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    span = bins.groupBy("floor").agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    every = span.select("floor", F.explode(bounded_sequence(F.col("a"), F.col("b"), 1_000_000)).alias("bin")).join(bins, ["floor", "bin"], "left").na.fill(0, ["n"])
    smooth = every.withColumn("s", F.avg("n").over(Window.partitionBy("floor").orderBy("bin").rowsBetween(-half, half)))
    low = smooth.where("s < 1").withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("floor").orderBy("bin")))
    return low.groupBy("floor", "run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.round(F.min("s"), 6).alias("emptiest")).drop("run")
