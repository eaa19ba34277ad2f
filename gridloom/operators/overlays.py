"""Polygon operators over scopes: unions, free space, scopes of buildings, what lies where, and certified ways.

Polygons are rows with a flat ring (x0, y0, x1, y1, ...). A task holds one scope's polygons; areas of unions may be cut into
tiles, so that a scope with very many polygons is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import polygons as P
from ..sources.shared import by_key, in_blocks, written
from .spatial import bounded_sequence

#: How a connection of buildings may have been verified.
TRUSTED = ("manual_verified", "cad_portal_verified", "door_portal_verified")


def region_of(rings: Iterator) -> P.Region:
    return [r for r in (P.ring_of(x) for x in rings) if r is not None]


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(x0, y0, x1, y0, x1, y1, x0, y1)


def ring_bounds(ring: Column) -> dict[str, Column]:
    pick = lambda k: F.filter(ring, lambda v, i: i % 2 == k)
    return {"x0": F.array_min(pick(0)), "y0": F.array_min(pick(1)), "x1": F.array_max(pick(0)), "y1": F.array_max(pick(1))}


UNION = "scope string, polygons long, area double, parts int, holes int, rings array<array<double>>"


def polygon_unions(polygons: DataFrame) -> DataFrame:
    """Per scope the union of its polygons (scope, ring): area, parts, holes and rings. Rings without an area count for nothing; a
    scope of which nothing is left raises, as it must never become empty by damage."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        region = region_of(rows["ring"])
        if not region:
            raise ValueError(f"{key[0]}: none of {len(rows)} polygons has an area")
        t = P.union([[r] for r in region])
        found = P.rings(t)
        sizes = [P.signed_area(r) for r in found]
        return pd.DataFrame([(key[0], len(region), P.area(t), sum(s > 0 for s in sizes), sum(s < 0 for s in sizes), [r.ravel().tolist() for r in found])], columns=[c.split()[0] for c in UNION.split(", ")])

    return by_key(polygons, "scope").applyInPandas(run, UNION)


def union_areas(polygons: DataFrame, tile: float) -> DataFrame:
    """(scope, area) of unions by tiles: every polygon goes to the tiles that its bounds touch, and a tile's task measures what is
    covered within it."""
    b = ring_bounds(F.col("ring"))
    span = lambda lo, hi: bounded_sequence(F.floor(b[lo] / tile), F.floor(b[hi] / tile))
    dealt = polygons.select("scope", "ring", F.explode(span("x0", "x1")).alias("tx"), span("y0", "y1").alias("ys")).select("scope", "ring", "tx", F.explode("ys").alias("ty"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        region, frame = region_of(rows["ring"]), [P.box_ring(key[1] * tile, key[2] * tile, (key[1] + 1) * tile, (key[2] + 1) * tile)]
        return pd.DataFrame([(key[0], P.area(P.overlay(frame, region, lambda a, b: a & b)))], columns=["scope", "area"])

    return by_key(dealt, "scope", "tx", "ty").applyInPandas(run, "scope string, area double").groupBy("scope").agg(F.sum("area").alias("area"))


FREE = "scope string, domain_area double, obstacle_area double, outside_area double, free_area double, parts int, blocked boolean, rings array<array<double>>"


def free_regions(domains: DataFrame, obstacles: DataFrame) -> DataFrame:
    """Per scope its domain (scope, ring) less its obstacles (scope, ring): areas of the domain, of obstacles inside and outside it,
    and of what is free, as rings. A scope without obstacles is free; one that is blocked altogether has no rings."""

    def run(key: tuple, d: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        domain, solid = region_of(d["ring"]), region_of(o["r"])
        if not domain:
            if len(d):
                raise ValueError(f"{key[0]}: the domain has no area")
            return pd.DataFrame(columns=[c.split()[0] for c in FREE.split(", ")])
        whole, inside = P.region_area(domain), P.area(P.intersection(domain, solid))
        t = P.difference(domain, solid)
        found = P.rings(t)
        return pd.DataFrame([(key[0], whole, inside, P.region_area(solid) - inside, P.area(t), sum(P.signed_area(r) > 0 for r in found), not len(found), [r.ravel().tolist() for r in found])], columns=[c.split()[0] for c in FREE.split(", ")])

    return by_key(domains, "scope").cogroup(by_key(obstacles.select(F.col("scope").alias("s"), F.col("ring").alias("r")), "s")).applyInPandas(run, FREE)


def not_all_blocked(free: DataFrame) -> DataFrame:
    """The free regions; if all scopes are blocked, reading them raises. One number over all scopes decides, not their rows."""
    free = written(free, "free")  # read twice
    every = free.agg(F.min("blocked").alias("_all"))
    sure = F.when(F.col("_all"), F.raise_error(F.lit("every scope is blocked"))).otherwise(F.col("scope"))
    return free.crossJoin(F.broadcast(every)).withColumn("scope", sure).drop("_all")  # one row


def effective_free(free: DataFrame, connectors: DataFrame) -> DataFrame:
    """Free regions (scope, rings) joined with the connectors (scope, ring) that were cut through walls: scope, area, parts before
    and after, rings."""
    schema = "scope string, area double, parts_before int, parts int, rings array<array<double>>"

    def run(key: tuple, f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
        own = [np.asarray(r, float).reshape(-1, 2) for r in f["rings"].iloc[0]]
        t = P.union([own, region_of(c["r"])])
        found = P.rings(t)
        return pd.DataFrame([(key[0], P.area(t), sum(P.signed_area(r) > 0 for r in own), sum(P.signed_area(r) > 0 for r in found), [r.ravel().tolist() for r in found])], columns=[x.split()[0] for x in schema.split(", ")])

    return by_key(free.select("scope", "rings"), "scope").cogroup(by_key(connectors.select(F.col("scope").alias("s"), F.col("ring").alias("r")), "s")).applyInPandas(run, schema)


def certified_edges(edges: DataFrame, free: DataFrame) -> DataFrame:
    """edges (scope, edge, path flat) with valid: whether the path lies in the scope's free region (scope, rings), its boundary
    included; scopes without a region have no valid edge."""
    schema = "scope string, edge long, valid boolean"

    def run(key: tuple, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        region = [np.asarray(r, float).reshape(-1, 2) for r in f["rings"].iloc[0]] if len(f) else []
        good = [bool(region) and len(p) >= 4 and P.covers_path(region, np.asarray(p, float)) for p in e["path"]]
        return pd.DataFrame({"scope": e["scope"], "edge": e["edge"], "valid": good})

    return by_key(edges.select("scope", "edge", "path"), "scope").cogroup(by_key(free.select(F.col("scope").alias("s"), "rings"), "s")).applyInPandas(run, schema)


def scope_token(value: Column, otherwise: str) -> Column:
    token = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[^0-9A-Za-z_.-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(token, F.lit("")), F.lit(otherwise))


def building_scope(floor: Column, building: Column, group: Column, verified: Column, verification: Column) -> Column:
    """The planning scope of a building: its floor and building, or its floor and connection where that was verified in a way that
    is trusted."""
    trusted = (F.coalesce(group, F.lit("")) != "") & F.coalesce(verified, F.lit(False)) & F.lower(F.trim(F.coalesce(verification, F.lit("")))).isin(*TRUSTED)
    return F.when(trusted, F.concat(floor, F.lit("__CONN_"), scope_token(group, "GROUP"))).otherwise(F.concat(floor, F.lit("__"), scope_token(building, "B00")))


REGIONS = "scope string, floor string, sheet string, region string, building string, confidence double, isolation_only boolean, area double, rings array<array<double>>"


def scope_regions(regions: DataFrame, buildings: DataFrame) -> DataFrame:
    """The analysis domains of sheets: regions (sheet, floor, region, source, confidence, ring) cut into their buildings (sheet,
    region, building, ring, scope, status, validation, confidence), or whole where none is left of them. Regions that only repeat
    the sheet's box, and buildings of a failed detection, are left out; buildings whose validation isn't trusted are isolated all
    the same."""
    sound = regions.where(~F.coalesce(F.col("source"), F.lit("")).startswith("sheet_bbox"))
    known = buildings.where(F.lower(F.coalesce(F.col("status"), F.lit(""))) != "error")

    def run(key: tuple, r: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for x in r.itertuples(index=False):
            frame, found = region_of([x.ring]), []
            for name, of in b.groupby("building", sort=True):
                t = P.intersection(frame, P.rings(P.union([[p] for p in region_of(of["bring"])])))
                if len(t):
                    first = of.iloc[0]
                    sure = first["bconfidence"] if pd.notna(first["bconfidence"]) and first["bconfidence"] else x.confidence
                    found.append((first["bscope"], x.floor, x.sheet, f"{x.region}__{name}", name, sure, first["validation"] not in ("vector_validated", "manual_verified"), P.area(t), [q.ravel().tolist() for q in P.rings(t)]))
            rows += found or ([(x.floor, x.floor, x.sheet, x.region, "", x.confidence, False, P.region_area(frame), [q.ravel().tolist() for q in frame])] if frame else [])
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REGIONS.split(", ")])

    other = known.select(F.col("sheet").alias("s"), F.col("region").alias("g"), "building", F.col("ring").alias("bring"), F.col("scope").alias("bscope"), "validation", F.col("confidence").alias("bconfidence"))
    return by_key(sound, "sheet", "region").cogroup(by_key(other, "s", "g")).applyInPandas(run, REGIONS)


LINKS = "floor string, left_scope string, right_scope string, open_length double, least double, linked boolean"


def corridor_links(scopes: DataFrame) -> DataFrame:
    """Pairs of scopes of one floor that share a trusted connection, and how long their open boundary is: scopes (floor, scope,
    buildings array, groups array of trusted connections, rings of free space, x0, y0, x1, y1 of the domain). The boundary counts from
    1 % of the shortest side on, 1 at least; a scope that is blocked altogether has none. A floor's scopes, a few buildings, are one
    task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("scope"), []
        items = list(rows.itertuples(index=False))
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                if not len(a.buildings) or not len(b.buildings) or set(a.buildings) & set(b.buildings) or not set(a.groups) & set(b.groups):
                    continue
                left, right = ([np.asarray(r, float).reshape(-1, 2) for r in x.rings] for x in (a, b))
                short = min(a.x1 - a.x0, a.y1 - a.y0, b.x1 - b.x0, b.y1 - b.y0)
                length, least = P.shared_boundary(left, right) if left and right else 0.0, max(1.0, short * 0.01)
                out.append((key[0], a.scope, b.scope, length, least, length >= least))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LINKS.split(", ")])

    return by_key(scopes, "floor").applyInPandas(run, LINKS)


def merged_scopes(scopes: DataFrame, links: DataFrame) -> DataFrame:
    """(floor, scope, merged): scopes joined by links get one name, numbered in their floor by their smallest scope; others keep
    theirs."""

    def run(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(s["scope"]))
        label = {n: n for n in names}
        pairs = [(a, b) for a, b, on in zip(e["left_scope"], e["right_scope"], e["linked"], strict=True) if on]
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        several = [n for n in names if label[n] == n and sum(label[m] == n for m in names) > 1]
        number = {n: f"{key[0]}__CONN_AUTO_C{k:03d}" for k, n in enumerate(several, 1)}
        return pd.DataFrame([(key[0], n, number.get(label[n], n)) for n in names], columns=["floor", "scope", "merged"])

    return by_key(scopes, "floor").cogroup(by_key(links.select(F.col("floor").alias("f"), "left_scope", "right_scope", "linked"), "f")).applyInPandas(run, "floor string, scope string, merged string")


def resolved_scopes(targets: DataFrame, domains: DataFrame) -> DataFrame:
    """(target, scope) of targets (target, floor, declared, x0, y0, x1, y1): the declared scope if it holds the box's centre, else of
    the floor's scopes (itself, and its name with __) that hold the centre the smallest, else the one with most of the box, from a
    half on; null without any. domains (scope, floor, rings); a floor's targets meet its few scopes."""

    def run(key: tuple, t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=["target", "scope"])
        d = d.sort_values("scope")
        regions = {s: [np.asarray(r, float).reshape(-1, 2) for r in rs] for s, rs in zip(d["scope"], d["rings"], strict=True)}
        size = {s: P.region_area(r) for s, r in regions.items()}
        centre = np.stack([(t["x0"] + t["x1"]) / 2, (t["y0"] + t["y1"]) / 2], 1)
        held = {s: P.covers(r, centre) for s, r in regions.items()}
        out = []
        for i, row in enumerate(t.itertuples(index=False)):
            inside = [s for s in regions if held[s][i]]
            if row.declared in inside:
                out.append(row.declared)
            elif inside:
                out.append(min(inside, key=lambda s: size[s]))
            else:
                frame, best = [P.box_ring(row.x0, row.y0, row.x1, row.y1)], (0.0, None)
                whole = max((row.x1 - row.x0) * (row.y1 - row.y0), 1.0)
                for s, r in regions.items():
                    share = P.area(P.intersection(frame, r)) / whole if row.x1 > row.x0 and row.y1 > row.y0 else 0.0
                    if share > best[0]:
                        best = (share, s)
                out.append(best[1] if best[0] >= 0.5 else None)
        return pd.DataFrame({"target": t["target"], "scope": out})

    return by_key(targets, "floor").cogroup(by_key(domains.select(F.col("floor").alias("f"), "scope", "rings"), "f")).applyInPandas(run, "target long, scope string")


ASSIGNED = "scope string, target long, component string, status string, x double, y double, distance double"


def component_assignment(targets: DataFrame, components: DataFrame) -> DataFrame:
    """Targets (scope, target, x, y) by component (scope, component, rings): the first that holds the point, else the nearest (ties to
    the first by name), with the nearest point of it; without any component missing_floor."""

    def run(key: tuple, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=[x.split()[0] for x in ASSIGNED.split(", ")])
        p, c = t[["x", "y"]].to_numpy(float), c.sort_values("component")
        if not len(c):
            return pd.DataFrame({"scope": t["scope"], "target": t["target"], "component": "", "status": "missing_floor", "x": p[:, 0], "y": p[:, 1], "distance": 0.0})
        regions = [[np.asarray(r, float).reshape(-1, 2) for r in rs] for rs in c["rings"]]
        inside = np.stack([P.covers(r, p) for r in regions])
        near = [P.nearest(r, p) for r in regions]
        far = np.where(inside, 0.0, np.stack([d for _, d in near]))
        k = np.where(inside.any(axis=0), inside.argmax(axis=0), far.argmin(axis=0))
        held = inside.any(axis=0)
        at = np.stack([a for a, _ in near])[k, np.arange(len(p))]
        at = np.where(held[:, None], p, at)
        return pd.DataFrame({"scope": t["scope"], "target": t["target"], "component": c["component"].to_numpy()[k], "status": np.where(held, "inside_free_space", "projected_to_free_space"), "x": at[:, 0], "y": at[:, 1], "distance": np.hypot(*(p - at).T)})

    return by_key(targets, "scope").cogroup(by_key(components.select(F.col("scope").alias("s"), "component", "rings"), "s")).applyInPandas(run, ASSIGNED)


def as_box(region: P.Region) -> tuple[float, float, float, float] | None:
    """The bounds of a region that is one level rectangle."""
    if len(region) != 1 or len(region[0]) != 4 or P.signed_area(region[0]) <= 0:
        return None
    step = np.roll(region[0], -1, axis=0) - region[0]
    return P.bounds(region) if ((step == 0).sum(axis=1) == 1).all() else None


def boxes_of(regions: list[P.Region]) -> np.ndarray:
    """A row of bounds for each region that is a level rectangle, of no numbers for others."""
    return np.array([as_box(r) or (np.nan,) * 4 for r in regions], float).reshape(-1, 4)


def box_spans(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From which part of each segment, a row, to which it lies in each box, a column; the end comes before the start where they don't
    meet."""
    start, end = np.zeros((len(a), len(q))), np.ones((len(a), len(q)))
    for k in (0, 1):
        p, d = a[:, k, None], (b - a)[:, k, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (q[None, :, k] - p) / d, (q[None, :, k + 2] - p) / d
        level, within = d == 0, (p >= q[None, :, k]) & (p <= q[None, :, k + 2])
        start = np.maximum(start, np.where(level, np.where(within, 0.0, 2.0), np.minimum(t, u)))
        end = np.minimum(end, np.where(level, 1.0, np.maximum(t, u)))
    return start, end


def box_distances(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A row for each segment, a column for each box: how far apart they are."""
    start, end = box_spans(a, b, q)
    d, size = b - a, np.maximum(((b - a) ** 2).sum(axis=1), 1e-300)[:, None]
    outside = lambda p, k: np.maximum(0.0, np.maximum(q[None, :, k] - p[:, k, None], p[:, k, None] - q[None, :, k + 2]))
    least = np.minimum(*(outside(p, 0) ** 2 + outside(p, 1) ** 2 for p in (a, b)))
    for i in (0, 2):
        for j in (1, 3):
            x, y = q[None, :, i] - a[:, 0, None], q[None, :, j] - a[:, 1, None]
            t = np.clip((x * d[:, 0, None] + y * d[:, 1, None]) / size, 0.0, 1.0)
            least = np.minimum(least, (x - t * d[:, 0, None]) ** 2 + (y - t * d[:, 1, None]) ** 2)
    return np.where(start <= end, 0.0, np.sqrt(least))


#: Segments and boxes, or boxes and boxes, whose numbers are worked out at once.
AT_ONCE = 1 << 17


def strips(rows: int, columns: int) -> list[slice]:
    """Rows in strips of AT_ONCE numbers."""
    step = max(1, AT_ONCE // max(1, columns))
    return [slice(k, k + step) for k in range(0, rows, step)]


def near_bounds(a: np.ndarray, b: np.ndarray, region: P.Region, reach: np.ndarray) -> np.ndarray:
    """The numbers of the segments, rows of a and b, whose box comes within reach of a region's."""
    x0, y0, x1, y1 = P.bounds(region)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return np.flatnonzero((lo[:, 0] <= x1 + reach) & (hi[:, 0] >= x0 - reach) & (lo[:, 1] <= y1 + reach) & (hi[:, 1] >= y0 - reach))


def segment_owners(segments: DataFrame, floors: DataFrame, width: float = 0.6, halo: float = 1.25) -> DataFrame:
    """(segment, owner) of segments (drawing, segment, declared, ax, ay, bx, by) among floors (drawing, floor, rings, confidence): the
    declared floor if it is one, else that with most of the segment (to nine decimals), then with its middle, then the surer, then by
    name; else the nearest within the segment's length times width times halo; null without any. Every segment has one owner."""

    def run(key: tuple, s: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(s):
            return pd.DataFrame(columns=["segment", "owner"])
        f = f.sort_values("floor")
        known = [(n, [np.asarray(r, float).reshape(-1, 2) for r in rs], c) for n, rs, c in zip(f["floor"], f["rings"], f["confidence"], strict=True)]
        names = set(f["floor"])
        owner = np.array([x if x and x in names else None for x in s["declared"]], object)
        todo = np.flatnonzero(owner == None)  # noqa: E711
        a, b = s[["ax", "ay"]].to_numpy(float)[todo], s[["bx", "by"]].to_numpy(float)[todo]
        # of each segment the best so far: length, middle, confidence; by name, so that of equals the first stays
        best, chosen = np.full((len(todo), 3), -np.inf), np.full(len(todo), -1)
        regions, boxes = [r for _, r, _ in known], boxes_of([r for _, r, _ in known])
        level, others = np.flatnonzero(~np.isnan(boxes[:, 0])), np.flatnonzero(np.isnan(boxes[:, 0]))
        q, sure = boxes[level], np.array([known[k][2] for k in level], float)
        for rows in strips(len(todo), len(level)) if len(level) else []:
            start, end = box_spans(a[rows], b[rows], q)
            length, m = np.round(np.maximum(0.0, end - start) * np.hypot(*(b - a)[rows].T)[:, None], 9), (a[rows] + b[rows]) / 2
            middle = ((m[:, None] >= q[None, :, :2]) & (m[:, None] <= q[None, :, 2:])).all(axis=2)
            of = (length > 1e-9) | middle
            for key in (length, middle, np.broadcast_to(sure, of.shape)):
                key = np.where(of, key, -np.inf)
                of &= key == key.max(axis=1, keepdims=True)
            i = np.flatnonzero(of.any(axis=1))
            k = of[i].argmax(axis=1)
            best[i + rows.start], chosen[i + rows.start] = np.stack([length[i, k], middle[i, k], sure[k]], 1), level[k]
        for k in others:
            r, c = regions[k], known[k][2]
            near = near_bounds(a, b, r, P.TINY * (1 + np.abs(np.vstack(r)).max()))
            length, middle = np.round(P.covered_lengths(a[near], b[near], r), 9), P.covers(r, (a[near] + b[near]) / 2)
            old, more = best[near], (length > 1e-9) | middle
            same = (length == old[:, 0]) & (middle == old[:, 1])
            more &= (length > old[:, 0]) | (length == old[:, 0]) & (middle > old[:, 1]) | same & (c > old[:, 2]) | same & (c == old[:, 2]) & (k < chosen[near])
            best[near[more]], chosen[near[more]] = np.stack([length, middle, np.full(len(near), c)], 1)[more], k
        far, reach = np.full(len(todo), np.inf), np.hypot(*(b - a).T) * width * halo + 1e-9
        alone = np.flatnonzero(chosen < 0)
        for rows in strips(len(alone), len(level)) if len(level) else []:
            w = box_distances(a[alone[rows]], b[alone[rows]], q)
            k = w.argmin(axis=1)
            w, i = w[np.arange(len(w)), k], alone[rows]
            closer = w <= reach[i]
            far[i[closer]], chosen[i[closer]] = w[closer], level[k[closer]]
        for k in others:
            near = alone[near_bounds(a[alone], b[alone], regions[k], reach[alone])]
            w = P.segment_distances(a[near], b[near], regions[k])
            closer = (w <= reach[near]) & ((w < far[near]) | (w == far[near]) & (k < chosen[near]))
            far[near[closer]], chosen[near[closer]] = w[closer], k
        owner[todo] = [known[k][0] if k >= 0 else None for k in chosen]
        return pd.DataFrame({"segment": s["segment"], "owner": owner})

    return in_blocks(segments, floors.select("drawing", "floor", "rings", "confidence"), "drawing", "segment", run, "segment long, owner string")


def halo_members(segments: DataFrame, regions: DataFrame, width: float = 0.6, halo: float = 1.25) -> DataFrame:
    """(floor, region, segment): segments (floor, segment, ax, ay, bx, by) that a region (floor, region, rings) needs, all within their
    length times width times halo of it; a segment near a border goes to both sides."""

    def run(key: tuple, s: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        a, b, ids = s[["ax", "ay"]].to_numpy(float), s[["bx", "by"]].to_numpy(float), s["segment"].to_numpy()
        reach, names = np.hypot(*(b - a).T) * width * max(1.0, halo), r["region"].to_numpy(object)
        known = [[np.asarray(x, float).reshape(-1, 2) for x in rs] for rs in r["rings"]]
        boxes = boxes_of(known)
        level = np.flatnonzero(~np.isnan(boxes[:, 0]))
        found = []
        for rows in strips(len(a), len(level)):
            i, j = np.nonzero(box_distances(a[rows], b[rows], boxes[level]) <= reach[rows, None] + 1e-9)
            found.append((level[j], i + rows.start))
        for k in np.flatnonzero(np.isnan(boxes[:, 0])):
            near = near_bounds(a, b, known[k], reach)
            near = near[P.segment_distances(a[near], b[near], known[k]) <= reach[near] + 1e-9]
            found.append((np.full(len(near), k), near))
        if not found:
            return pd.DataFrame(columns=["floor", "region", "segment"])
        j, i = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"floor": key[0], "region": names[j], "segment": ids[i]})

    return in_blocks(segments, regions.select("floor", "region", "rings"), "floor", "segment", run, "floor string, region string, segment long")


ROUTED = "pair long, routing string, owner string, outputs array<string>"


def common_areas(own: list[P.Region], known: list[P.Region]) -> np.ndarray:
    """A row for each of own, a column for each of known: the area they share; rectangles all at once, others one by one."""
    p, q = boxes_of(own), boxes_of(known)
    side = lambda k: np.minimum(p[:, None, k + 2], q[None, :, k + 2]) - np.maximum(p[:, None, k], q[None, :, k])
    out = np.maximum(0.0, side(0)) * np.maximum(0.0, side(1))
    bounds = [[P.bounds(r) if r else None for r in rs] for rs in (own, known)]
    for i, j in zip(*np.nonzero(np.isnan(out)), strict=True):
        a, b = bounds[0][i], bounds[1][j]
        meet = a is not None and b is not None and a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]
        out[i, j] = P.area(P.intersection(own[i], known[j])) if meet else 0.0
    return out


def pair_owners(pairs: DataFrame, regions: DataFrame, least: float = 1e-9) -> DataFrame:
    """Wall pairs (floor, pair, core ring, full ring) by region (floor, region, rings, confidence): core where a region holds part of
    the core, else topology_only where one holds part of the whole, else halo_ghost. The owner is the region with the centre, then
    of most overlap (to nine decimals), then the surer, then by name; outputs are all that overlap."""

    def run(key: tuple, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame(columns=[c.split()[0] for c in ROUTED.split(", ")])
        r = r.sort_values(["confidence", "region"], ascending=[False, True])
        known, names = [[np.asarray(x, float).reshape(-1, 2) for x in rs] for rs in r["rings"]], r["region"].to_numpy(object)
        named, boxes = np.argsort(names, kind="stable"), boxes_of(known)

        def matches(rings: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            """What each ring overlaps, and the best of it."""
            own = [region_of([x]) for x in rings]
            common = common_areas(own, known)
            met = common > least
            centres = np.array([x[0].mean(axis=0) if x else (np.nan, np.nan) for x in own]).reshape(-1, 2)
            held = ((centres[:, None] >= boxes[None, :, :2]) & (centres[:, None] <= boxes[None, :, 2:])).all(axis=2)
            for k in np.flatnonzero(np.isnan(boxes[:, 0])):
                held[:, k] = P.covers(known[k], centres)
            held &= met
            of = np.where(held.any(axis=1)[:, None], held, met)
            return met, np.where(of, np.round(common, 9), -1.0).argmax(axis=1) if known else np.zeros(len(own), int)

        core, full, by_name = matches(p["core"]), matches(p["full"]), names[named]
        rows = []
        for i, pair in enumerate(p["pair"]):
            how, (met, best) = ("core", core) if core[0][i].any() else ("topology_only", full) if full[0][i].any() else ("halo_ghost", full)
            rows.append((pair, how, names[best[i]] if met[i].any() else "", by_name[met[i][named]]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ROUTED.split(", ")])

    return in_blocks(pairs, regions.select("floor", "region", "rings", "confidence"), "floor", "pair", run, ROUTED)


FACES = "scope string, face int, area double, rings array<array<double>>"


def cut_regions(free: DataFrame, cutters: DataFrame, half: float, least: float) -> DataFrame:
    """Free regions (scope, rings) cut along the accepted portals (scope, ax, ay, bx, by), each a band of half a width: faces of at
    least an area, by descending area; a region whose faces are all smaller stays whole."""

    def run(key: tuple, f: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows = []
        bands = [b for b in (P.ring_of(P.band(np.array([x.ax, x.ay]), np.array([x.bx, x.by]), half)) for x in c.itertuples(index=False)) if b is not None]
        for part in P.parts([np.asarray(r, float).reshape(-1, 2) for rs in f["rings"] for r in rs]):
            faces = [q for q in P.parts(P.rings(P.difference(part, bands))) if sum(map(P.signed_area, q)) >= least] if bands else [part]
            rows += faces or [part]
        rows.sort(key=lambda q: (-round(sum(map(P.signed_area, q)), 9), q[0].tolist()))
        return pd.DataFrame([(key[0], k, float(sum(map(P.signed_area, q))), [r.ravel().tolist() for r in q]) for k, q in enumerate(rows, 1)], columns=[x.split()[0] for x in FACES.split(", ")])

    return by_key(free.select("scope", "rings"), "scope").cogroup(by_key(cutters.select(F.col("scope").alias("s"), "ax", "ay", "bx", "by"), "s")).applyInPandas(run, FACES)


def portal_regions(portals: DataFrame, faces: DataFrame, slack: float) -> DataFrame:
    """(scope, portal, area_a, area_b): the two faces (scope, face, rings) whose boundaries run longest within slack of a portal
    (scope, portal, ax, ay, bx, by); null for a portal that doesn't divide two."""
    schema = "scope string, portal long, area_a int, area_b int"

    def run(key: tuple, p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        known, rows = [(n, [np.asarray(r, float).reshape(-1, 2) for r in rs]) for n, rs in zip(f["face"], f["rings"], strict=True)], []
        for x in p.itertuples(index=False):
            zone = region_of([P.band(np.array([x.ax, x.ay]), np.array([x.bx, x.by]), slack, slack).ravel()])
            touch = sorted(((-sum(P.covered_length(e.reshape(2, 2), zone) for e in P.segments(r)), n) for n, r in known))
            touch = [n for w, n in touch if -w > slack]
            rows.append((key[0], x.portal, *(touch[:2] if len(touch) > 1 else (None, None))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"area_a": "Int32", "area_b": "Int32"})

    return by_key(portals, "scope").cogroup(by_key(faces.select(F.col("scope").alias("s"), "face", "rings"), "s")).applyInPandas(run, schema)


def capped_portals(portals: DataFrame, most: int = 600) -> DataFrame:
    """The surest portals (scope, portal, confidence, width) of each scope, ties to the narrower and the smaller id, numbered."""
    place = Window.partitionBy("scope").orderBy(F.desc("confidence"), "width", "portal")
    return portals.withColumn("number", F.row_number().over(place)).where(F.col("number") <= most)


def offset_histogram(hits: DataFrame, reach: int, window: int = 7, share: float = 0.04, tolerance: int = 4) -> DataFrame:
    """Per edge the offset at which walls lie: hits (edge, sample, offset; null where a sample meets none), the nearest offset of each
    sample. The dominant offset has most samples within half a window either way, the smallest of equal ones; it holds if at least a
    share of the samples lie within the tolerance of it. (edge, samples, offset, supported, snapped)"""
    n = hits.groupBy("edge").agg(F.countDistinct("sample").alias("samples"))
    nearest = hits.where(F.col("offset").isNotNull()).groupBy("edge", "sample").agg(F.min("offset").alias("offset"))
    counts = nearest.groupBy("edge", "offset").agg(F.count("*").alias("c"))
    spread = counts.select("edge", "c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("offset") - window // 2), F.least(F.lit(reach), F.col("offset") + window // 2))).alias("offset"))
    smooth = spread.groupBy("edge", "offset").agg(F.sum("c").alias("c"))
    best = smooth.groupBy("edge").agg(F.min(F.struct((-F.col("c")).alias("c"), "offset")).alias("m")).select("edge", F.col("m.offset").alias("dominant"))
    held = nearest.join(best, "edge").groupBy("edge", "dominant").agg(F.count_if(F.abs(F.col("offset") - F.col("dominant")) <= tolerance).alias("supported"))
    j = n.join(held, "edge", "left")
    snapped = F.coalesce(F.col("supported") / F.greatest(F.lit(1), F.col("samples")) >= share, F.lit(False))
    inferred = ~snapped & (F.coalesce("supported", F.lit(0)) >= F.greatest(F.lit(12), F.ceil(F.col("samples") * 0.015)))
    return j.select("edge", "samples", F.when(snapped | inferred, F.col("dominant")).otherwise(0).cast("int").alias("offset"), F.coalesce("supported", F.lit(0)).alias("supported"), snapped.alias("snapped"), inferred.alias("inferred"))


def moved_ring(ring: np.ndarray, offsets: list[float]) -> np.ndarray:
    """A ring whose edges are level or upright (each by its longer side) with every edge moved inward by its offset; corners are where
    moved neighbours of different directions meet, others stay."""
    n, lines = len(ring), []
    for k in range(n):
        a, b = ring[k], ring[(k + 1) % n]
        level = abs(b[1] - a[1]) <= abs(b[0] - a[0])
        inward = np.array([-(b - a)[1], (b - a)[0]])  # to the left, where the inside is
        side = np.sign(inward[1] if level else inward[0]) or 1.0
        lines.append((level, (a + b)[1 if level else 0] / 2 + side * offsets[k]))
    out = []
    for k in range(n):
        (was_level, c), (level, e) = lines[k - 1], lines[k]
        out.append(ring[k] if was_level == level else np.array([e, c]) if was_level else np.array([c, e]))
    return np.array(out)


ENVELOPE = "scope string, snapped int, inferred int, fallback int, area double, rings array<array<double>>"


def closed_envelopes(buildings: DataFrame, walls: DataFrame, pixel: float, part: float = 0.18, width: float = 3.5) -> DataFrame:
    """A closed outer wall for every building (scope, ring) of the third floor and above: each edge is searched inward, up to a part of
    the building's shorter side, for wall cells (scope, cx, cy) of a size, moved to where most samples first meet one, and the
    moved outline becomes a wall of twice `width` cells. Edges without enough evidence stay, so that no gap opens."""

    def run(key: tuple, b: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        rows, solid = [], set(zip(w["cx"].tolist(), w["cy"].tolist(), strict=True))
        for ring in region_of(b["ring"]):
            x0, y0, x1, y1 = P.bounds([ring])
            reach = max(24, min(650, round(min(x1 - x0, y1 - y0) / pixel * part)))
            found = [edge_offset(ring[k], ring[(k + 1) % len(ring)], solid, pixel, reach) for k in range(len(ring))]
            moved = P.ring_of(moved_ring(ring, [o * pixel for o, _ in found]))
            wall = P.outline([moved], pixel * width) if moved is not None else []
            if wall:
                how = [h for _, h in found]
                rows.append((key[0], how.count("snapped"), how.count("inferred"), how.count("fallback"), float(sum(map(P.signed_area, wall))), [r.ravel().tolist() for r in wall]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ENVELOPE.split(", ")])

    high = buildings.where(third_floor_or_above(F.col("floor")))
    return by_key(high.select("scope", "ring"), "scope").cogroup(by_key(walls.select(F.col("scope").alias("s"), "cx", "cy"), "s")).applyInPandas(run, ENVELOPE)


def edge_offset(a: np.ndarray, b: np.ndarray, solid: set[tuple[int, int]], pixel: float, reach: int) -> tuple[float, str]:
    """How many cells inward of an edge (the inside being to its left) most samples first meet a wall, and how sure that is."""
    level = abs(b[1] - a[1]) <= abs(b[0] - a[0])
    side = 1 if (b[0] - a[0] if level else a[1] - b[1]) >= 0 else -1
    lo, hi = sorted((a[0], b[0]) if level else (a[1], b[1]))
    base = (a + b)[1 if level else 0] / 2
    margin = min(20, max(2, int((hi - lo) / pixel * 0.025)))
    samples = range(round(lo / pixel) + margin, round(hi / pixel) - margin + 1, max(1, int((hi - lo) / pixel // 1600)))
    depths = []
    for s in samples:
        for d in range(reach + 1):
            c = round(base / pixel) + side * d
            if ((s, c) if level else (c, s)) in solid:
                depths.append(d)
                break
    if not depths:
        return 0.0, "fallback"
    counts = np.convolve(np.bincount(depths, minlength=reach + 1).astype(float), np.ones(7), mode="same")
    best = int(counts.argmax())
    supported = sum(abs(d - best) <= 4 for d in depths)
    if supported / max(1, len(samples)) >= 0.04:
        return float(best), "snapped"
    return (float(best), "inferred") if supported >= max(12, -(-len(samples) * 15 // 1000)) else (0.0, "fallback")


def third_floor_or_above(floor: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(floor, F.lit(""))))
    number = F.regexp_extract(text, "^F([0-9]+)$", 1).try_cast("int")
    return F.coalesce(number >= 3, F.lit(False)) | text.isin("ROOF", "EQUIPMENT", "RF", "屋面", "设备层")
