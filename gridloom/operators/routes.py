"""Routes over the targets of one floor: exact and heuristic orders, walks, insertion costs."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import by_key

#: Floors of up to so many targets are ordered exactly; up to so many others are improved by reversals until none helps.
EXACT, FULL = 16, 80
#: Passes over larger floors, each of which takes the best reversal; what counts as shorter.
PASSES, EPS = 8, 1e-9


class Straight:
    """Straight ways between points to nine decimals, computed where they are asked for: read by index like a matrix, never held as one.
    Points without a place are reached by none."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, at: tuple) -> np.ndarray:
        i, j = map(np.asarray, at)
        with np.errstate(invalid="ignore"):
            d = np.round(np.hypot(self.x[i] - self.x[j], self.y[i] - self.y[j]), 9)
        return np.where(i == j, 0.0, np.where(np.isnan(d), np.inf, d))[()]

    @functools.lru_cache(maxsize=1)  # noqa: B019
    def within(self, most: float) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        """What is at most so far from a point, by ascending numbers, and how far: points lie in grid cells a little wider than that."""
        size = most * (1 + 1e-6) + 1e-6
        cx, cy = np.floor(self.x / size), np.floor(self.y / size)
        order = np.lexsort((cy, cx))
        order = order[np.isfinite(cx[order]) & np.isfinite(cy[order])]
        columns, rows = cx[order], cy[order]
        names, first = np.unique(columns, return_index=True)
        start = {c: (k, e) for c, k, e in zip(names.tolist(), first.tolist(), [*first.tolist(), len(columns)][1:], strict=True)}

        def near(i: int) -> tuple[np.ndarray, np.ndarray]:
            found = []
            for c in (cx[i] - 1, cx[i], cx[i] + 1):
                if part := start.get(float(c)):
                    low, high = part[0] + np.searchsorted(rows[part[0] : part[1]], (cy[i] - 1, cy[i] + 1.5))
                    found.append(order[low:high])
            j = np.sort(np.concatenate(found)) if found else np.zeros(0, int)
            d = self[i, j]
            kept = d <= most + EPS
            return j[kept], d[kept]

        return near


def held_karp(d: np.ndarray) -> list[int] | None:
    """A shortest open path through all points, None where infinite distances leave none; of equal ones the lexicographically
    smallest found from its end. Sets of equal size are settled at once, as arrays."""
    n = len(d)
    if n < 2:
        return list(range(n))
    masks = np.arange(1 << n)
    best = np.full((1 << n, n), np.inf)
    last = np.zeros((1 << n, n), np.int8)
    best[1 << np.arange(n), np.arange(n)] = 0
    sizes = sum(masks >> j & 1 for j in range(n))
    for size in range(2, n + 1):
        own = masks[sizes == size]
        for j in range(n):
            with_j = own[own >> j & 1 == 1]
            options = best[with_j ^ 1 << j] + d[:, j]
            k = options.argmin(axis=1)
            last[with_j, j], best[with_j, j] = k, options[np.arange(len(with_j)), k]
    mask, j, path = (1 << n) - 1, int(best[-1].argmin()), []
    if not np.isfinite(best[-1, j]):
        return None
    while True:
        path.append(j)
        if mask == 1 << j:
            return path[::-1]
        mask, j = mask ^ 1 << j, int(last[mask, j])


def starts_of(n: int) -> list[int]:
    """Starts of nearest neighbour orders: all up to 32 targets, else some at equal steps, the first and the last."""
    if n <= 32:
        return list(range(n))
    some = 4 if n > 64 else 8
    return list(dict.fromkeys([*list(range(0, n, max(1, (n - 1) // (some - 1))))[:some], 0, n - 1]))


def nearest_order(xy: np.ndarray, start: int) -> list[int]:
    """From start always to the nearest target left, ties to the first."""
    path, left = [start], np.ones(len(xy), bool)
    left[start] = False
    for _ in range(len(xy) - 1):
        far = np.hypot(*(xy - xy[path[-1]]).T)
        path.append(int(np.where(left, far, np.inf).argmin()))
        left[path[-1]] = False
    return path


def reversed_fully(d: np.ndarray, path: list[int]) -> list[int]:
    """Reverses stretches of three targets and more, each as soon as it shortens the open path, until none does."""
    path, n, changed = path[:], len(path), True
    while changed:
        changed = False
        for i in range(n - 2):
            for j in range(i + 2, n):
                before = (d[path[i - 1], path[i]] if i else 0) + (d[path[j], path[j + 1]] if j + 1 < n else 0)
                after = (d[path[i - 1], path[j]] if i else 0) + (d[path[i], path[j + 1]] if j + 1 < n else 0)
                if after < before - EPS:
                    path[i : j + 1] = path[i : j + 1][::-1]
                    changed = True
    return path


def reversed_best(xy: np.ndarray, path: list[int], passes: int = PASSES) -> list[int]:
    """In each pass reverses the stretch of three targets and more that shortens the open path most; ties to the first."""
    order, n = np.array(path), len(path)
    for _ in range(passes):
        p = xy[order]
        legs = np.append(np.hypot(*(p[1:] - p[:-1]).T), 0.0)  # the last has no leg behind it
        best = (-EPS, 0, 0)
        for i in range(n - 2):
            gain = -legs[i + 2 :]
            gain[:-1] += np.hypot(*(p[i + 3 :] - p[i]).T)
            if i:
                gain += np.hypot(*(p[i + 2 :] - p[i - 1]).T) - legs[i - 1]
            k = int(gain.argmin())
            if gain[k] < best[0]:
                best = (float(gain[k]), i, i + 2 + k)
        _, i, j = best
        if not j:
            break
        order[i : j + 1] = order[i : j + 1][::-1].copy()
    return order.tolist()


def legs_of(xy: np.ndarray, path: list[int]) -> np.ndarray:
    return np.hypot(*np.diff(xy[path], axis=0).T)


def heuristic(xy: np.ndarray) -> list[int]:
    """The shortest improved nearest neighbour order over all starts, ties to the smaller order."""
    if len(xy) <= FULL:
        d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
        paths = [reversed_fully(d, nearest_order(xy, s)) for s in starts_of(len(xy))]
    else:
        paths = [reversed_best(xy, nearest_order(xy, s)) for s in starts_of(len(xy))]
    return min(paths, key=lambda p: (float(legs_of(xy, p).sum()), p))


def plan_routes(targets: DataFrame, exact: int = EXACT) -> DataFrame:
    """Per floor (route) an order over its targets (floor, target_id, x, y): exact up to `exact` targets, else the best of
    nearest neighbour orders from several starts, improved by reversals. One task holds one floor."""

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("target_id").reset_index(drop=True)
        xy = t[["x", "y"]].to_numpy()
        if len(t) <= exact:
            path = held_karp(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]))
        else:
            path = heuristic(xy)
        legs = [0.0, *legs_of(xy, path)]
        return pd.DataFrame({"floor": key[0], "target_id": t["target_id"].to_numpy()[path], "place": range(1, len(t) + 1), "leg": np.round(legs, 6), "method": "exact" if len(t) <= exact else "heuristic"})

    return by_key(targets, "floor").applyInPandas(run, "floor int, target_id long, place int, leg double, method string")


def insertion_costs(targets: DataFrame, legs: DataFrame, block: int = 2048) -> DataFrame:
    """(floor, target_id, saving): the least detour at which each target (floor, target_id, x, y) enters its floor's route, given as legs
    (floor, ax, ay, bx, by; the first without a start). Targets come in blocks, each with its floor's legs as arrays, so no pair is
    ever a row."""
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("floor")) / block))
    own = targets.withColumn("part", F.pmod(F.xxhash64("target_id"), n).cast("int"))
    dealt = legs.join(own.select("floor", "part").distinct(), "floor").select(F.col("floor").alias("f"), F.col("part").alias("p"), "ax", "ay", "bx", "by")

    def run(key: tuple, t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        xy, first = t[["x", "y"]].to_numpy(), e["ax"].isna().to_numpy()
        a, b = e[["ax", "ay"]].to_numpy(float), e[["bx", "by"]].to_numpy(float)
        far = lambda p: np.hypot(xy[:, None, 0] - p[None, :, 0], xy[:, None, 1] - p[None, :, 1])
        cost = np.where(first, far(b), far(a) + far(b) - np.hypot(*(a - b).T))
        return pd.DataFrame({"floor": np.int32(key[0]), "target_id": t["target_id"], "saving": cost.min(axis=1) if len(e) else np.nan})

    return by_key(own, "floor", "part").cogroup(by_key(dealt, "f", "p")).applyInPandas(run, "floor int, target_id long, saving double")
