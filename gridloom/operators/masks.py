"""Cells of images: splits at empty stretches, parts of what is set, groups of parts, and what supports a group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import by_key
from .skeleton import labelled

Box = tuple[int, int, int, int]


@dataclass(frozen=True)
class Sizes:
    """Fixed values, in pixels and shares of an image."""

    low: float = 0.018
    gap: int = 90
    gap_share: float = 0.028
    guard: float = 0.045
    reach: int = 41
    margin: int = 18
    merge: int = 70
    part: int = 900
    part_share: float = 0.006
    group_share: float = 0.035
    near: int = 48
    major: float = 0.08
    bridge: int = 180


def crop(mask: np.ndarray, b: Box) -> np.ndarray:
    return mask[b[1] : b[3], b[0] : b[2]]


def clipped(b: Box, frame: Box) -> Box | None:
    c = max(b[0], frame[0]), max(b[1], frame[1]), min(b[2], frame[2]), min(b[3], frame[3])
    return c if c[0] < c[2] and c[1] < c[3] else None


def wider(b: Box, by: int) -> Box:
    return b[0] - by, b[1] - by, b[2] + by, b[3] + by


def cover(boxes: Sequence[Box]) -> Box | None:
    return (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None


def low_stretches(values: np.ndarray, level: float, least: int, guard: int) -> list[tuple[int, int]]:
    """Runs of values up to a level, at least so long, that begin behind the guard and end before it or with the values."""
    low = np.concatenate([[False], values <= level, [False]]).astype(int)
    turns = np.diff(low)
    runs = zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True)
    return [(int(a), int(b)) for a, b in runs if b - a >= least and a > guard and (b == len(values) or b < len(values) - guard)]


def best_split(mask: np.ndarray, box: Box, sizes: Sizes = Sizes(), axes: str = "xy", factor: float = 1.0) -> tuple[str, int, float] | None:
    """(axis, place, score) of the best cut of a box: in the middle of a stretch on which few cells are set, by its width, how even the
    halves are and how empty it is; both halves must hold their share."""
    inner = crop(mask, box)
    total, found = int(inner.sum()), None
    for axis in axes if total else "":
        counts = inner.sum(axis="xy".index(axis)).astype(float)
        across = inner.shape["xy".index(axis)]
        if len(counts) < 2 * sizes.gap:
            continue
        window = max(9, round(len(counts) * 0.018)) | 1
        smooth = np.convolve(counts, np.full(window, 1 / window), "same")
        level = max(2.0, across * sizes.low, float(smooth.max()) * sizes.low) * max(0.1, factor)
        least, sums = max(sizes.gap, round(len(counts) * sizes.gap_share)), np.concatenate([[0], np.cumsum(counts)])
        for a, b in low_stretches(smooth, level, least, round(len(counts) * sizes.guard)):
            at = round((a + b) / 2)
            halves = sums[at], total - sums[at]
            if min(halves) < max(sizes.part, round(total * sizes.group_share)):
                continue
            score = (b - a) * (0.35 + min(halves) / max(halves)) * (1.5 - min(float(smooth[a:b].mean()) / max(level, 1.0), 1.0))
            if found is None or score > found[2]:
                found = axis, at + box["xy".index(axis)], score
    return found


def tight(mask: np.ndarray, box: Box, frame: Box, margin: int) -> Box | None:
    """The box of set cells within a box, wider by a margin, within the frame."""
    inner = crop(mask, box)
    if not inner.any():
        return None
    rows, cols = np.flatnonzero(inner.any(axis=1)), np.flatnonzero(inner.any(axis=0))
    return clipped(wider((box[0] + int(cols[0]), box[1] + int(rows[0]), box[0] + int(cols[-1]) + 1, box[1] + int(rows[-1]) + 1), margin), frame)


def grown(mask: np.ndarray, reach: int) -> np.ndarray:
    """Cells within half of an odd reach of a set one, along both axes."""
    half, out = max(3, reach) // 2, mask
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (half + 1, half)
        sums = np.cumsum(np.pad(out.astype(int), pad), axis=axis)
        n = out.shape[axis]
        out = np.take(sums, range(2 * half + 1, 2 * half + 1 + n), axis) - np.take(sums, range(n), axis) > 0
    return out


def part_boxes(mask: np.ndarray, box: Box, frame: Box, sizes: Sizes = Sizes()) -> list[Box]:
    """Boxes of what hangs together within a box once it is grown; small parts go; without any the box of all."""
    inner = crop(mask, box)
    total, out = int(inner.sum()), []
    label, n = labelled(grown(inner, sizes.reach)) if total else (inner, 0)
    for k in range(1, n + 1):
        own = label == k
        if int((own & inner).sum()) >= max(sizes.part, round(total * sizes.part_share)):
            rows, cols = np.flatnonzero(own.any(axis=1)), np.flatnonzero(own.any(axis=0))
            at = clipped(wider((box[0] + int(cols[0]), box[1] + int(rows[0]), box[0] + int(cols[-1]) + 1, box[1] + int(rows[-1]) + 1), sizes.margin), frame)
            out += [at] if at else []
    if not out and (whole := tight(mask, box, frame, sizes.margin)):
        out = [whole]
    return out


def merged(boxes: Sequence[Box], gap: int) -> list[Box]:
    """Boxes that overlap or lie within a gap become one, until none do."""
    todo, out = list(boxes), []
    while todo:
        b = todo.pop(0)
        near = [k for k, c in enumerate(todo) if max(b[0], c[0]) - min(b[2], c[2]) <= gap and max(b[1], c[1]) - min(b[3], c[3]) <= gap]
        if near:
            todo = [cover([b, *(todo[k] for k in near)]), *(c for k, c in enumerate(todo) if k not in near)]
        else:
            out.append(b)
    return sorted(out)


def grouped(mask: np.ndarray, subregions: Sequence[Box], frame: Box, sizes: Sizes = Sizes()) -> tuple[Box, list[Box], int] | None:
    """(box, parts, set cells) of subregions: the parts of each, clipped to it, merged and covered."""
    parts = []
    for s in subregions:
        if (own := clipped(s, frame)) is not None:
            parts += [c for p in part_boxes(mask, own, frame, sizes) if (c := clipped(p, own)) is not None]
    parts = merged(parts, sizes.merge)
    return (cover(parts), parts, sum(int(crop(mask, p).sum()) for p in parts)) if parts else None


def supported(mask: np.ndarray, parts: Sequence[Box], candidates: Sequence[Box], frame: Box, sizes: Sizes = Sizes()) -> tuple[list[Box], list[Box]]:
    """(kept, rejected): parts that a candidate overlaps, or nearly overlaps if they hold a major share of what is set. Without
    candidates all stay."""
    if not candidates:
        return list(parts), []
    counts = [int(crop(mask, p).sum()) for p in parts]
    total, kept, gone = max(1, sum(counts)), [], []
    guarded = [g for c in candidates if (g := clipped(wider(c, sizes.near), frame))]
    for p, n in zip(parts, counts, strict=True):
        direct, about = any(clipped(p, c) for c in candidates), any(clipped(p, c) for c in guarded)
        (kept if direct or about and n / total >= sizes.major else gone).append(p)
    return kept, gone


def bridges(parts: Sequence[Box], most: int) -> list[Box]:
    """Boxes that fill the gaps, up to a width, between parts that face one another."""
    out = []
    for k, a in enumerate(parts):
        for b in parts[k + 1 :]:
            for i, j in ((0, 1), (1, 0)):
                first, second = sorted((a, b), key=lambda p: p[i])  # noqa: B023
                gap, low, high = second[i] - first[i + 2], max(a[j], b[j]), min(a[j + 2], b[j + 2])
                if 0 < gap <= most and low < high:
                    out.append((first[i + 2], low, second[i], high) if i == 0 else (low, first[i + 2], high, second[i]))
    return sorted(set(out))


def mask_of(cells: pd.DataFrame, width: int, height: int) -> np.ndarray:
    mask = np.zeros((height, width), bool)
    mask[cells["y"].to_numpy(int), cells["x"].to_numpy(int)] = True
    return mask


SPLITS = "image string, axis string, place int, score double"


def image_splits(cells: DataFrame, images: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """The best cut of each image (image, width, height) by its set cells (image, x, y); an image is one task."""

    def run(key: tuple, i: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in i.itertuples(index=False):
            if best := best_split(mask_of(c, r.width, r.height), (0, 0, r.width, r.height), sizes):
                out.append((key[0], *best))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SPLITS.split(", ")])

    return by_key(images, "image").cogroup(by_key(cells.select(F.col("image").alias("k"), "x", "y"), "k")).applyInPandas(run, SPLITS)


BUILDINGS = "image string, building string, x0 int, y0 int, x1 int, y1 int, parts int, cells long, rejected int, needs_review boolean, reason string"


def reconciled_buildings(cells: DataFrame, images: DataFrame, detections: DataFrame, sizes: Sizes = Sizes(), overlap: float = 0.01) -> DataFrame:
    """Detected buildings (image, building, x0, y0, x1, y1 in pixels) held against an image's set cells: parts within a building's box
    that hang together, those with the support of a detection, bridged over small gaps and covered. Buildings without set cells,
    with rejected parts, or that overlap another by more than a share of the smaller, need a review."""

    def run(key: tuple, i: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in i.drop_duplicates(["width", "height"]).itertuples(index=False):
            mask, frame = mask_of(c, r.width, r.height), (0, 0, r.width, r.height)
            found = [(d.building, tuple(int(round(v)) for v in (d.x0, d.y0, d.x1, d.y1))) for d in i.sort_values("building").itertuples(index=False) if d.building is not None]
            boxes = [b for _, b in found]
            for name, box in found:
                group = grouped(mask, [wider(box, sizes.near)], frame, sizes)
                if group is None:
                    out.append([key[0], name, *box, 0, 0, 0, ["no_obstacles"]])
                    continue
                kept, gone = supported(mask, group[1], boxes, frame, sizes)
                whole = cover([*kept, *bridges(kept, sizes.bridge)]) or box
                out.append([key[0], name, *whole, len(kept), sum(int(crop(mask, p).sum()) for p in kept), len(gone), ["parts_outside_detections"] if gone else []])
            for k, a in enumerate(out):
                for b in out[k + 1 :]:
                    common = clipped(tuple(a[2:6]), tuple(b[2:6]))
                    area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
                    if common and area(common) > overlap * min(area(a[2:6]), area(b[2:6])):
                        a[9].append("overlap"), b[9].append("overlap")
        rows = [(*r[:9], bool(r[9]), ";".join(sorted(set(r[9])))) for r in out]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in BUILDINGS.split(", ")])

    both = images.join(detections, "image", "left")
    return by_key(both, "image").cogroup(by_key(cells.select(F.col("image").alias("k"), "x", "y"), "k")).applyInPandas(run, BUILDINGS)
