"""Connectors between parts of free space: gaps, what supports them, and those that join a floor's graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import polygons as P
from ..sources.shared import by_key
from .spatial import touching_boxes

#: Fixed values, in pixels: gaps that need no door, that a door may span, how near a door must be, and half a connector's width.
GAP, DOOR_GAP, DOOR_REACH, HALF = 1.25, 3.0, 2.5, 0.45
#: Connectors of a floor, and nodes that are tried for a view of a connector's end.
CONNECTORS, VIEWS = 256, 96


def region(rings) -> P.Region:
    return [np.asarray(r, float).reshape(-1, 2) for r in rings]


def gap_between(a: P.Region, b: P.Region) -> tuple[float, np.ndarray, np.ndarray]:
    """The distance of two regions and the points on either that are nearest; 0 and a shared point where they meet."""
    for one, other in ((a, b), (b, a)):
        inside = P.covers(one, np.vstack(other))
        if inside.any():
            p = np.vstack(other)[inside.argmax()]
            return 0.0, p, p
    for x1, y1, x2, y2 in P.segments(a):
        start, way = np.array([x1, y1]), np.array([x2 - x1, y2 - y1])
        for t in P.cut_points(start, start + way, b)[1:-1]:
            if P.covers(b, start + t * way)[0]:
                return 0.0, start + t * way, start + t * way
    on_b, far_b = P.nearest(b, np.vstack(a))
    on_a, far_a = P.nearest(a, np.vstack(b))
    i, j = far_b.argmin(), far_a.argmin()
    return (float(far_b[i]), np.vstack(a)[i], on_b[i]) if far_b[i] <= far_a[j] else (float(far_a[j]), on_a[j], np.vstack(b)[j])


def gaps_between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gap_between of many pairs of regions of one ring each, arrays (pair, corner, 2). Only pairs whose bounds meet, though no corner
    of one lies in the other, are looked at one by one."""
    m = np.arange(len(a))
    # pairs come last, so that every step runs over one corner's or edge's numbers of all pairs
    va, vb = (np.ascontiguousarray(r.transpose(1, 2, 0)) for r in (a, b))

    def nearest(r: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.roll(r, -1, axis=0) - r
        length = np.maximum(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1], 1e-300)
        at, far = np.empty_like(points), np.full((len(points), len(m)), np.inf)
        for k, (x, y) in enumerate(points):
            for (qx, qy), (dx, dy), n in zip(r, d, length, strict=True):
                t = np.clip(((x - qx) * dx + (y - qy) * dy) / n, 0, 1)
                ox, oy = qx + t * dx, qy + t * dy
                new = np.hypot(x - ox, y - oy)
                less = new < far[k]
                np.copyto(far[k], new, where=less)
                np.copyto(at[k, 0], ox, where=less)
                np.copyto(at[k, 1], oy, where=less)
        return at, far

    def covered(r: np.ndarray, points: np.ndarray, far: np.ndarray) -> np.ndarray:
        d, turns = np.roll(r, -1, axis=0) - r, np.zeros((len(points), len(m)), np.int8)
        for k, (x, y) in enumerate(points):
            for (qx, qy), (dx, dy) in zip(r, d, strict=True):
                side, below, above = dx * (y - qy) - (x - qx) * dy, qy <= y, qy + dy > y
                turns[k] += below & above & (side > 0)
                turns[k] -= ~below & ~above & (side < 0)
        return (turns != 0) | (far <= P.TINY * (r.max(axis=0) - r.min(axis=0)).max(axis=0))

    (on_a, far_a), (on_b, far_b) = nearest(va, vb), nearest(vb, va)
    in_a, in_b = covered(va, vb, far_a), covered(vb, va, far_b)
    i, j = far_b.argmin(axis=0), far_a.argmin(axis=0)
    first = far_b[i, m] <= far_a[j, m]
    gap = np.where(first, far_b[i, m], far_a[j, m])
    p, q = np.where(first[:, None], a[m, i], on_a[j, :, m]), np.where(first[:, None], on_b[i, :, m], b[m, j])
    meet = in_a.any(axis=0) | in_b.any(axis=0)
    shared = np.where(in_a.any(axis=0)[:, None], b[m, in_a.argmax(axis=0)], a[m, in_b.argmax(axis=0)])
    gap, p, q = np.where(meet, 0.0, gap), np.where(meet[:, None], shared, p), np.where(meet[:, None], shared, q)
    slack = 4 * P.TINY * np.maximum(np.abs(a).max(axis=(1, 2)), np.abs(b).max(axis=(1, 2)))[:, None]
    apart = ((a.min(axis=1) > b.max(axis=1) + slack) | (b.min(axis=1) > a.max(axis=1) + slack)).any(axis=1)
    for k in np.flatnonzero(~meet & ~apart):
        gap[k], p[k], q[k] = gap_between([a[k]], [b[k]])
    return gap, p, q


GAPS = "scope string, component_a int, component_b int, gap double, ax double, ay double, bx double, by double"


def component_gaps(parts: DataFrame, most: float, size: float) -> DataFrame:
    """Pairs of parts (scope, component, rings) at most so far apart, with the gap and its ends. Boxes of parts meet in grid cells, so
    only near parts are measured, many at once."""
    flat = parts.select("scope", "component", "rings", F.flatten("rings").alias("_v"))
    xs, ys = F.filter("_v", lambda v, i: i % 2 == 0), F.filter("_v", lambda v, i: i % 2 == 1)
    flat = flat.select("scope", "component", "rings", F.array_min(xs).alias("_x0"), F.array_min(ys).alias("_y0"), F.array_max(xs).alias("_x1"), F.array_max(ys).alias("_y1"))
    box = B.box(F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1"))
    left = flat.select(F.col("scope").alias("floor"), F.col("component").alias("a"), F.col("rings").alias("ra"), B.inflate(box, most).alias("p"))
    right = flat.select(F.col("scope").alias("floor"), F.col("component").alias("b"), F.col("rings").alias("rb"), box.alias("q"))
    p, q = F.col("p"), F.col("q")
    across = lambda c: F.greatest(F.lit(0.0), q[f"{c}0"] - p[f"{c}1"] + most, p[f"{c}0"] + most - q[f"{c}1"])
    # parts are no nearer than their boxes
    near = touching_boxes(left, right, size).where("a < b").where(F.hypot(across("x"), across("y")) <= most * (1 + 1e-9) + 1e-12 * F.greatest(*[F.abs(q[c]) for c in ("x0", "y0", "x1", "y1")]))

    def corners(c: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of rings: whether a row has one ring alone, where that begins, and how many numbers it has."""
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        outer, inner = c.offsets.to_numpy(), c.values.offsets.to_numpy()
        return np.diff(outer) == 1, inner[outer[:-1]], inner[np.minimum(outer[:-1] + 1, len(inner) - 1)] - inner[outer[:-1]]

    def run(batches):
        for rows in batches:
            columns = [rows.column(c) for c in ("ra", "rb")]
            (one_a, at_a, n_a), (one_b, at_b, n_b) = map(corners, columns)
            values = [c.values.values.to_numpy(zero_copy_only=False) for c in columns]
            gap, ends, single = np.empty(rows.num_rows), np.empty((rows.num_rows, 4)), one_a & one_b
            for k in np.flatnonzero(~single):
                gap[k], p, q = gap_between(*[region(c[int(k)].as_py()) for c in columns])
                ends[k] = *p, *q
            for x, y in set(zip(n_a[single].tolist(), n_b[single].tolist(), strict=True)):
                k = np.flatnonzero(single & (n_a == x) & (n_b == y))
                ring = lambda v, at, n: v[at[k][:, None] + np.arange(n)].reshape(len(k), -1, 2)  # noqa: B023, E731
                gap[k], p, q = gaps_between(ring(values[0], at_a, x), ring(values[1], at_b, y))
                ends[k] = np.hstack([p, q])
            kept = np.flatnonzero(gap <= most)
            ids = rows.select(["floor", "a", "b"]).take(pa.array(kept)).columns
            yield pa.RecordBatch.from_arrays([*ids, *[pa.array(v[kept]) for v in (gap, *ends.T)]], names=[c.split()[0] for c in GAPS.split(", ")])

    return near.select("floor", "a", "b", "ra", "rb").mapInArrow(run, GAPS)


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def segments_apart(p: Column, q: Column) -> Column:
    """The distance of two segments, structs (ax, ay, bx, by); 0 where they cross."""
    turn = lambda s, x, y: (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
    cross = (turn(p, q["ax"], q["ay"]) * turn(p, q["bx"], q["by"]) < 0) & (turn(q, p["ax"], p["ay"]) * turn(q, p["bx"], p["by"]) < 0)
    ends = [to_segment(s[x], s[y], *[o[c] for c in ("ax", "ay", "bx", "by")]) for s, o in ((p, q), (q, p)) for x, y in (("ax", "ay"), ("bx", "by"))]
    return F.when(cross, 0.0).otherwise(F.least(*ends))


def connector_candidates(gaps: DataFrame, openings: DataFrame, used: DataFrame, pixel: float, size: float) -> DataFrame:
    """Gaps that a door's lines (scope, ax, ay, bx, by) or their own narrowness supports, with what supports them, how sure, the targets
    of both parts (used: scope, component, targets; parts without any connect nothing) and their order on the floor: doors first,
    then narrow ones, then those of many targets."""
    count = lambda c: used.select("scope", F.col("component").alias(f"component_{c}"), F.col("targets").alias(f"targets_{c}"))
    g = gaps.where(F.col("gap") <= pixel * DOOR_GAP).join(count("a"), ["scope", "component_a"]).join(count("b"), ["scope", "component_b"])
    bridge = g.select(F.col("scope").alias("floor"), "component_a", "component_b", F.struct("ax", "ay", "bx", "by").alias("s"), B.inflate(B.box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), pixel * DOOR_REACH).alias("p"))
    door = openings.select(F.col("scope").alias("floor"), F.struct("ax", "ay", "bx", "by").alias("o"), B.box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("q"))
    apart = touching_boxes(bridge, door, size).select(F.col("floor").alias("scope"), "component_a", "component_b", segments_apart(F.col("s"), F.col("o")).alias("evidence_distance"))
    nearest = apart.groupBy("scope", "component_a", "component_b").agg(F.min("evidence_distance").alias("evidence_distance"))
    j = g.join(nearest, ["scope", "component_a", "component_b"], "left")
    by_door, narrow = F.coalesce(F.col("evidence_distance") <= pixel * DOOR_REACH, F.lit(False)), F.col("gap") <= pixel * GAP
    sure = F.when(by_door, 0.95).otherwise(F.greatest(F.lit(0.55), 0.82 - 0.2 * F.col("gap") / max(pixel * GAP, 1e-9)))
    j = j.where(by_door | narrow).withColumns({"source": F.when(by_door, "door_layer").otherwise("geometric_gap"), "confidence": sure, "evidence_distance": F.when(by_door, F.col("evidence_distance"))})
    order = Window.partitionBy("scope").orderBy(F.when(F.col("source") == "door_layer", 0).otherwise(1), "gap", F.desc(F.col("targets_a") + F.col("targets_b")), "component_a", "component_b")
    return j.withColumn("place", F.row_number().over(order))


CONNECTED = "scope string, portal int, component_a int, component_b int, node_a long, node_b long, gap double, source string, confidence double, x double, y double, length_a double, length_b double, carve array<double>"


def connectors(candidates: DataFrame, parts: DataFrame, nodes: DataFrame, pixel: float, most: int = CONNECTORS) -> DataFrame:
    """The candidates, in their order, that join parts of a floor's graph not joined yet. Either end must see a node of its part (nodes:
    scope, component, node, x, y, part of the graph), and both legs must lie in their parts with the carved gap. One task a floor
    holds its candidates' parts and nodes."""
    rings = lambda c: parts.select("scope", F.col("component").alias(f"component_{c}"), F.col("rings").alias(f"rings_{c}"))
    c = candidates.join(rings("a"), ["scope", "component_a"]).join(rings("b"), ["scope", "component_b"])
    c = c.select("scope", "place", "component_a", "component_b", "gap", "source", "confidence", "ax", "ay", "bx", "by", "rings_a", "rings_b")
    known = nodes.select(F.col("scope").alias("s"), "component", "node", "x", "y", "part")

    def run(key: tuple, rows: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        def view(own: pd.DataFrame, shape: P.Region, end: np.ndarray) -> tuple[int, np.ndarray] | None:
            at = own[["x", "y"]].to_numpy(float)
            for k in np.argsort(np.hypot(*(at - end).T), kind="stable")[:VIEWS]:
                if P.covers_path(shape, np.array([at[k], end])):
                    return k, at[k]
            return None

        out, groups = [], {k: g.sort_values("node") for k, g in n.groupby("component")}
        for r in rows.sort_values("place").itertuples(index=False):
            if len(out) == most:
                break
            own = groups.get(r.component_a), groups.get(r.component_b)
            if own[0] is None or own[1] is None or {root(v) for v in own[0]["part"]} & {root(v) for v in own[1]["part"]}:
                continue
            a, b, p, q = region(r.rings_a), region(r.rings_b), np.array([r.ax, r.ay]), np.array([r.bx, r.by])
            ends = view(own[0], a, p), view(own[1], b, q)
            if ends[0] is None or ends[1] is None:
                continue
            half, middle = max(pixel * HALF, 1e-6), (p + q) / 2
            carve = P.band(p, q, half, half * 1e-6) if np.hypot(*(q - p)) > 1e-9 else P.box_ring(*(middle - half), *(middle + half))
            carve = P.ring_of(carve)
            legs = [np.array([ends[0][1], p, middle]), np.array([middle, q, ends[1][1]])]
            if not all(P.covers_path(P.rings(P.union([shape, [carve]])), leg) for shape, leg in ((a, legs[0]), (b, legs[1]))):
                continue
            node = [own[k].iloc[ends[k][0]] for k in (0, 1)]
            parent[root(int(node[0]["part"]))] = root(int(node[1]["part"]))
            length = [float(np.hypot(*np.diff(leg, axis=0).T).sum()) for leg in legs]
            out.append((key[0], len(out) + 1, r.component_a, r.component_b, int(node[0]["node"]), int(node[1]["node"]), r.gap, r.source, r.confidence, *map(float, middle), *length, carve.ravel().tolist()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in CONNECTED.split(", ")])

    return by_key(c, "scope").cogroup(by_key(known, "s")).applyInPandas(run, CONNECTED)


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph's node and edge tables: the first row of a node counts; edges, undirected, are numbered on their floor, get the length of
    their path (scope, node_a, node_b, kind, path), and those that name an unknown node or lead to their own start raise."""
    first = nodes.groupBy("scope", "node").agg(F.min_by(F.struct(*[c for c in nodes.columns if c not in ("scope", "node")]), F.struct(*[c for c in nodes.columns if c not in ("scope", "node")])).alias("n")).select("scope", "node", "n.*")
    known = lambda c: first.select("scope", F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    j = edges.join(known("node_a"), ["scope", "node_a"], "left").join(known("node_b"), ["scope", "node_b"], "left")
    sound = F.col("_node_a").isNotNull() & F.col("_node_b").isNotNull() & (F.col("node_a") != F.col("node_b"))
    n = F.size("path")
    legs = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 2), lambda i: F.hypot(F.get("path", 2 * i + 2) - F.get("path", 2 * i), F.get("path", 2 * i + 3) - F.get("path", 2 * i + 1)))
    length = F.when(n >= 4, F.aggregate(legs, F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)
    number = F.row_number().over(Window.partitionBy("scope").orderBy("node_a", "node_b", "kind", "length"))
    e = j.withColumn("scope", F.when(sound, F.col("scope")).otherwise(F.raise_error(F.lit("an edge names an unknown node or its own start")))).withColumn("length", length)
    return first, e.drop("_node_a", "_node_b").withColumn("edge", number)
