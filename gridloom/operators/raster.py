"""Floors as grids of cells: free space, clearance and areas. A cell is (floor, cx, cy); its centre decides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import by_key
from .graph import connected_components
from .spatial import bounded_sequence


def covered_cells(boxes: DataFrame, size: float) -> DataFrame:
    """Cells whose centre lies in a box (floor, b), each once."""
    first = lambda v: F.ceil(v / size - 0.5).cast("long")
    last = lambda v: F.floor(v / size - 0.5).cast("long")
    b = F.col("b")
    spans = boxes.select("floor", first(b["x0"]).alias("a"), last(b["x1"]).alias("c"), first(b["y0"]).alias("d"), last(b["y1"]).alias("e")).where("a <= c and d <= e")
    columns = spans.select("floor", F.explode(bounded_sequence(F.col("a"), F.col("c"))).alias("cx"), "d", "e")
    return columns.select("floor", "cx", F.explode(bounded_sequence(F.col("d"), F.col("e"))).alias("cy")).distinct()


def domain_cells(boxes: DataFrame, size: float) -> DataFrame:
    """All cells of each floor's extent."""
    ends = ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))
    extent = boxes.groupBy("floor").agg(*[f(F.floor(F.col(f"b.{c}") / size)).alias(c) for f, c in ends])
    columns = extent.select("floor", F.explode(bounded_sequence(F.col("x0"), F.col("x1"))).alias("cx"), "y0", "y1")
    return columns.select("floor", "cx", F.explode(bounded_sequence(F.col("y0"), F.col("y1"))).alias("cy"))


def free_cells(boxes: DataFrame, size: float) -> DataFrame:
    """The domain less the obstacles. A floor whose boxes leave nothing has no row."""
    return domain_cells(boxes, size).join(covered_cells(boxes, size), ["floor", "cx", "cy"], "left_anti")


def clearance(cells: DataFrame, blocked: DataFrame) -> DataFrame:
    """Steps from each free cell to the nearest blocked one, by two sweeps over the floor's grid (a task holds one floor's
    grid); null on a floor without any."""

    def run(key: tuple, free: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(free):
            return pd.DataFrame(columns=["floor", "cx", "cy", "steps"])
        block = block.rename(columns={"bx": "cx", "by": "cy"})
        both = pd.concat([free[["cx", "cy"]], block[["cx", "cy"]]])
        ox, oy = both["cx"].min(), both["cy"].min()
        far = int(both["cx"].max() - ox + both["cy"].max() - oy + 2)
        d = np.full((both["cx"].max() - ox + 1, both["cy"].max() - oy + 1), far, np.int64)
        d[block["cx"] - ox, block["cy"] - oy] = 0
        for axis in (0, 1):
            n = d.shape[axis]
            steps = np.arange(n).reshape((-1, 1) if axis == 0 else (1, -1))
            forward = np.minimum.accumulate(d - steps, axis=axis) + steps
            backward = np.flip(np.minimum.accumulate(np.flip(d + steps, axis), axis=axis), axis) - steps
            d = np.minimum(forward, backward)
        steps = d[free["cx"] - ox, free["cy"] - oy]
        return pd.DataFrame({"floor": key[0], "cx": free["cx"], "cy": free["cy"], "steps": pd.Series(steps, index=free.index).where(steps < far).astype("Int64")})

    # Both may come from the same boxes; new names keep their columns apart.
    other = blocked.select(F.col("floor").alias("f"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    return by_key(cells, "floor").cogroup(by_key(other, "f")).applyInPandas(run, "floor int, cx long, cy long, steps long")


def areas(cells: DataFrame, size: float) -> DataFrame:
    """Areas of cells joined by their sides: floor, area (a running number by size), cells and the share of the floor."""
    name = lambda x, y: F.format_string("%d/%d/%d", "floor", x, y)
    own = cells.withColumn("u", name(F.col("cx"), F.col("cy")))
    beside = F.explode(F.array(name(F.col("cx"), F.col("cy")), name(F.col("cx") + 1, F.col("cy")), name(F.col("cx"), F.col("cy") + 1)))
    edges = own.select("u", beside.alias("v")).join(own.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v")
    parts = own.join(connected_components(edges).withColumnRenamed("node", "u"), "u").groupBy("floor", "component").agg(F.count("*").alias("cells"))
    totals = parts.groupBy("floor").agg(F.sum("cells").alias("total"))
    return parts.join(totals, "floor").select("floor", "cells", F.round(F.col("cells") * size * size, 6).alias("area"), F.round(F.col("cells") / F.col("total"), 6).alias("share"))

