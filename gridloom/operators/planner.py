"""Plans of one floor, or of one building's scope on it: clusters within a longest leg, legal starts, an area tree, relays, walks.

A scope is a matrix of walking distances between its targets, sorted by id, with their values, areas and legal starts. Targets
that can be walked to in legs of at most dmax form a cluster; each cluster that holds a required target is a segment of the plan.
The first segment begins at an exit or a fire lift; later ones begin with a virtual continuation, which is no way.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import evidence as E
from ..sources.shared import PAIRS, by_key, in_blocks
from .optimizer import matrix
from .routes import EPS, Straight

#: Classes at which a route may begin.
STARTS = ("安全出口", "消防电梯")
#: Weights of an area's value in the tree, of learned successions in local orders; rounds and span of local reversals; what a
#: mandatory target adds to its area; the longest leg as a part of the floor's scale.
AREA_BIAS, SUCCESSION, ROUNDS, SPAN, MANDATORY, DMAX = 0.35, 0.03, 4, 24, 1.0, 0.8
#: How much a relay's value and a learned succession shorten a leg in the search for relays, and the least that stays of it.
RELAY_VALUE, RELAY_SUCCESSION, RELAY_FLOOR = 0.08, 0.04, 0.8


class Successions:
    """Weights of learned successions by index, 0 where there are none."""

    def __init__(self, n: int, weights: dict[tuple[int, int], float]) -> None:
        self.n = n
        self.keys = np.array(sorted(i * n + j for i, j in weights), np.int64)
        self.weights = np.array([weights[divmod(int(k), n)] for k in self.keys], float)

    def __getitem__(self, at: tuple) -> np.ndarray:
        key = np.asarray(at[0], np.int64) * self.n + np.asarray(at[1], np.int64)
        if not len(self.keys):
            return np.zeros(key.shape)[()]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.weights[place], 0.0)[()]


@dataclass
class Scope:
    """Arrays over targets sorted by id; areas are names that sort."""

    d: np.ndarray | Straight
    follows: np.ndarray | Successions
    score: np.ndarray
    mandatory: np.ndarray
    area: list[str]
    legal: np.ndarray


def near_in(d: np.ndarray | Straight, dmax: float) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """A function from a target to those within dmax of it, and how far they are."""
    if isinstance(d, Straight):
        return d.within(dmax)

    def near(i: int) -> tuple[np.ndarray, np.ndarray]:
        j = np.flatnonzero(d[i] <= dmax + EPS)
        return j, d[i, j]

    return near


def clusters_within(d: np.ndarray | Straight, dmax: float) -> list[list[int]]:
    """Sets of targets joined by legs of at most dmax, by their smallest target."""
    near, left, out = near_in(d, dmax), np.ones(len(d), bool), []
    for i in range(len(d)):
        if not left[i]:
            continue
        left[i], inside, todo = False, [i], [i]
        while todo:
            j = near(todo.pop())[0]
            new = j[left[j]]
            left[new] = False
            todo += new.tolist()
            inside += new.tolist()
        out.append(sorted(inside))
    return out


def start_of(s: Scope, cluster: list[int], required: set[int]) -> int | None:
    """The legal start of a cluster: required ones first, then the least summed way to the required, the higher score, the id."""
    def rank(i: int) -> tuple:
        ways = s.d[i, [j for j in sorted(required) if j != i]]
        return i not in required, float(ways[np.isfinite(ways)].sum()), -s.score[i], i

    return min((i for i in cluster if s.legal[i]), key=rank, default=None)


def area_links(s: Scope, targets: list[int]) -> dict[tuple[str, str], tuple[float, int, int]]:
    """For each two areas of the targets, in order of their names, the closest pair: (distance, left, right)."""
    by: dict[str, list[int]] = {}
    for i in targets:
        by.setdefault(s.area[i], []).append(i)
    out, names = {}, sorted(by)
    for a, left in enumerate(names):
        for right in names[a + 1 :]:
            part = s.d[np.ix_(by[left], by[right])]
            i, j = np.unravel_index(int(part.argmin()), part.shape)
            if np.isfinite(part[i, j]):
                out[left, right] = (float(part[i, j]), by[left][i], by[right][j])
    return out


def area_values(s: Scope, targets: list[int]) -> dict[str, float]:
    out: dict[str, float] = {}
    for i in targets:
        out[s.area[i]] = out.get(s.area[i], 0.0) + s.score[i] + MANDATORY * bool(s.mandatory[i])
    return out


def area_tree(links: dict[tuple[str, str], tuple[float, int, int]], values: dict[str, float], root: str | None = None, bias: float = AREA_BIAS) -> tuple[str, list[tuple[str, str, float]], list[str]]:
    """The root (the area of highest value, of equal ones the last name), the tree's edges (parent, child, distance) in the order in
    which they are taken, and areas that can't be reached. Each step takes the area of least distance over 1 + bias times its part
    of the highest value; ties by the distance, the parent and the child."""
    if not values:
        return "", [], []
    root = root if root in values else max(values, key=lambda a: (values[a], a))
    ways: dict[str, list[tuple[float, str]]] = {a: [] for a in values}
    for (a, b), (w, *_) in links.items():
        ways[a].append((w, b))
        ways[b].append((w, a))
    top, inside, tree = max(max(values.values()), EPS), {root}, []
    heap: list[tuple[float, float, str, str]] = []

    def offer(a: str) -> None:
        for w, b in ways[a]:
            if b not in inside:
                heapq.heappush(heap, (w / (1 + bias * (values[b] / top)), w, a, b))

    offer(root)
    while heap:
        _, w, a, b = heapq.heappop(heap)
        if b not in inside:
            inside.add(b)
            tree.append((a, b, w))
            offer(b)
    return root, tree, sorted(set(values) - inside)


def preorder(root: str, tree: list[tuple[str, str, float]], values: dict[str, float]) -> list[str]:
    """Areas from the root down; of an area's children the one of least distance over 1 + value first, then the higher value, the
    name."""
    below: dict[str, list[tuple]] = {}
    for a, b, w in tree:
        below.setdefault(a, []).append((w / (1 + max(0.0, values.get(b, 0.0))), -values.get(b, 0.0), b))
    out, todo = [], [root] if root else []
    while todo:
        out.append(a := todo.pop())
        todo += [b for *_, b in sorted(below.get(a, []), reverse=True)]
    return out


def local_order(s: Scope, targets: list[int], before: int | None) -> list[int]:
    """The targets of an area: from the one nearest to the target before (or of highest score) always to the nearest, learned
    successions counting as a small part of the farthest way; then reversals within a span while they shorten the whole."""
    left = set(targets)
    if not left:
        return []
    own = sorted(left | ({before} if before is not None else set()))
    d, follows, score = s.d[np.ix_(own, own)], s.follows[np.ix_(own, own)], s.score[own]
    left, before = {k for k, i in enumerate(own) if i in left}, None if before is None else own.index(before)
    first = max(left, key=lambda i: (score[i], i)) if before is None else min(left, key=lambda i: (d[before, i], -score[i], i))
    path = [first]
    left.remove(first)
    while left:
        at = path[-1]
        far = [w for i in left if np.isfinite(w := d[at, i])]
        scale = max(far, default=1.0)
        step = min(left, key=lambda i: (d[at, i] - SUCCESSION * scale * follows[at, i], d[at, i], i))
        path.append(step)
        left.remove(step)
    return [own[k] for k in reversed_locally(d, path, before)]


def reversed_locally(d: np.ndarray, path: list[int], before: int | None, rounds: int = ROUNDS, span: int = SPAN) -> list[int]:
    """Reverses stretches of up to span targets, each as soon as it shortens the way from `before` on, for some rounds."""
    path, n = path[:], len(path)
    if n < 3:
        return path
    leg = lambda a, b: 0.0 if a is None or b is None else d[a, b]
    for _ in range(rounds):
        changed = False
        for i in range(n - 1):
            for j in range(i + 2, min(n, i + max(3, span)) + 1):
                head, tail = path[i - 1] if i else before, path[j] if j < n else None
                gain = leg(head, path[i]) + leg(path[j - 1], tail) - leg(head, path[j - 1]) - leg(path[i], tail)
                if gain > EPS:
                    path[i:j] = path[i:j][::-1]
                    changed = True
        if not changed:
            break
    return path


def relay_tree(s: Scope, required: set[int], among: list[int], root: int, dmax: float) -> tuple[list[tuple[int, int, float]], set[int]]:
    """A tree over the cluster's legs of at most dmax that joins the root with all required targets, any other of the cluster being a
    relay: (edges (from, to, distance) in the order taken, required targets that can't be joined). Each search runs from the whole
    tree; a leg counts less by the value of the target that it leads to and by a learned succession. As the tree only grows, a search
    goes on from what the ones before have found; of ways equally short the one over what is reached first counts, then the smaller id."""
    near, member = near_in(s.d, dmax), np.zeros(len(s.d), bool)
    member[among] = True
    worth = np.clip(s.score, 0, 1)
    far, via, inside = np.full(len(s.d), np.inf), np.full(len(s.d), -1), np.zeros(len(s.d), bool)
    far[root], inside[root] = 0.0, True
    heap, edges, left = [(0.0, root)], [], set(required) - {root}
    while left:
        reached = -1
        while heap:
            w, i = heapq.heappop(heap)
            if w > far[i]:
                continue
            if i in left:
                reached = i
                break
            j, d = near(i) if member[i] else (np.zeros(0, int), np.zeros(0))
            d, j = d[ok := member[j] & ~inside[j] & (j != i)], j[ok]
            new = w + d * np.maximum(RELAY_FLOOR, 1 - RELAY_VALUE * worth[j] - RELAY_SUCCESSION * np.clip(s.follows[i, j], 0, 1))
            had, by = far[j], via[j]
            better = new + EPS < had
            # an equal way never leads through what lies no nearer, so none leads back to itself
            equal = ~better & (np.abs(new - had) <= EPS) & (inside[i] | (w + EPS < had)) & ((w < far[by]) | (w == far[by]) & (i < by))
            via[j[better | equal]] = i
            far[j[better]] = new[better]
            for x in zip(new[better].tolist(), j[better].tolist(), strict=True):
                heapq.heappush(heap, x)
        if reached < 0:
            break
        path = [reached]
        while not inside[path[-1]]:
            path.append(int(via[path[-1]]))
        path.reverse()
        edges += [(a, b, float(s.d[a, b])) for a, b in zip(path, path[1:], strict=False)]
        far[path], inside[path] = 0.0, True
        for i in path[1:]:
            heapq.heappush(heap, (0.0, i))
        left -= set(path)
    return edges, left


def open_walk(root: int, edges: list[tuple[int, int, float]], preferred: dict[int, int], follows: np.ndarray | None = None) -> tuple[list[int], int]:
    """A walk over a tree from its root that ends at the leaf farthest from it (of equal ones the last), and that leaf. Branches off
    the way there are walked first and back, in the preferred order, else by length less a little for learned successions."""
    ways: dict[int, list[tuple[int, float]]] = {root: []}
    for a, b, w in edges:
        ways.setdefault(a, []).append((b, w))
        ways.setdefault(b, []).append((a, w))
    parent, far, todo = {root: root}, {root: 0.0}, [root]
    while todo:
        a = todo.pop()
        for b, w in ways[a]:
            if b not in parent:
                parent[b], far[b] = a, far[a] + w
                todo.append(b)
    end = max((i for i in parent if i != root and len(ways[i]) == 1), key=lambda i: (far[i], i), default=root)
    last, i = {root}, end
    while i != root:
        last.add(i)
        i = parent[i]

    def rank(a: int, b: int, w: float) -> tuple:
        learned = 0.0 if follows is None else follows[a, b]
        return b in last, preferred.get(b, len(preferred) + 1), w - w * 0.03 * learned, b

    walk, todo = [], [(root, False)]
    while todo:
        a, back = todo.pop()
        walk.append(a)
        if back:
            continue
        children = sorted(((b, w) for b, w in ways[a] if parent.get(b) == a and b != root), key=lambda c: rank(a, *c), reverse=True)
        for b, _ in children:
            if b not in last:
                todo.append((a, True))
            todo.append((b, False))
    return walk, end


@dataclass
class Segment:
    entry: int
    virtual: bool
    walk: list[int]
    required: set[int]
    relays: set[int]
    areas: list[str]
    tree: list[tuple[str, str, float]]
    edges: list[tuple[int, int, float]]
    end: int
    why: str


def plan_scope(s: Scope, selected: set[int], dmax: float, primary: bool = True) -> tuple[str, list[Segment]]:
    """(status, segments) of a scope. A physical floor's primary scope must begin at a legal start, which may be a cluster of its
    own; a secondary scope without one begins with its best required target, as a virtual continuation."""
    if not selected:
        return "infeasible_no_routable_inspection_targets", []
    every = clusters_within(s.d, dmax)
    held = sorted((c for c in every if selected & set(c)), key=lambda c: (-sum(s.score[i] for i in sorted(selected & set(c))), min(selected & set(c))))
    begin = next(((k, i) for k, c in enumerate(held) if (i := start_of(s, c, selected & set(c))) is not None), None)
    if begin is None:
        alone = next(((c, i) for c in every if not selected & set(c) and (i := start_of(s, c, set())) is not None), None)
        if alone:
            held.append(alone[0])
            begin = len(held) - 1, alone[1]
    if begin is None and not primary:
        begin = 0, max(selected & set(held[0]), key=lambda i: (s.score[i], i))
    if begin is None:
        return "infeasible_route_start", []
    held.insert(0, held.pop(begin[0]))
    start, segments = begin[1], []
    for k, cluster in enumerate(held):
        required = selected & set(cluster)
        root = start if k == 0 else None
        planned = sorted(required | ({root} if root is not None else set()))
        links, values = area_links(s, planned), area_values(s, planned)
        top, tree, lost = area_tree(links, values, s.area[root] if root is not None else None)
        if lost:
            return "infeasible_area_value_graph", []
        areas, order = preorder(top, tree, values), []
        for a in areas:
            own = [i for i in planned if s.area[i] == a and i != root]
            if root is not None and not order:
                order = [root]
            order += local_order(s, own, order[-1] if order else None)
        root = order[0] if root is None else root
        edges, apart = relay_tree(s, required | {root}, cluster, root, dmax)
        if apart:
            return "infeasible_dmax", []
        walk, end = open_walk(root, edges, {i: n for n, i in enumerate(order)}, s.follows)
        virtual = k > 0 or not primary
        why = "" if not virtual else "building_scope_disconnected_from_physical_floor_route_start" if k == 0 else "dmax_disconnected_from_floor_route_start" if primary and np.isfinite(s.d[start, root]) else "physical_graph_disconnected_from_floor_route_start"
        support = {i for e in edges for i in e[:2]} | {root}
        segments.append(Segment(root, virtual, walk, required, support - required - ({root} if k == 0 else set()), areas, tree, edges, end, why))
    return "feasible", segments


def is_start(class_name: Column, raw_name: Column, layer: Column) -> Column:
    """Whether a route may begin at a target: of a legal class, and by none of its names a fire door."""
    fire = lambda c: E.key(c).rlike(E.one_of([*E.FIRE_DOORS])) | E.key(c).rlike(E.FIRE_DOOR_CODE)
    return class_name.isin(*STARTS) & ~fire(raw_name) & ~fire(layer)


def physical_floor(scope: Column, source: Column | None = None) -> Column:
    """The floor behind a building's scope: what is given, else the part before __."""
    named = F.element_at(F.split(scope, "__"), 1)
    return named if source is None else F.coalesce(F.nullif(F.trim(source), F.lit("")), named)


def rule_targets(targets: DataFrame, requirements: DataFrame) -> DataFrame:
    """(scope, target, reason): the targets that the rules ask for. requirements (scope, name, kind, category, target, quota, each):
    a row a target. All of mandatory_all; of others the best scores beside what is mandatory; of groups the best categories by the
    summed scores of their best `each`. Ties go to the smaller id or name."""
    known = targets.select("scope", "target", "score")
    rows = requirements.join(known, ["scope", "target"])
    fixed = rows.where("kind = 'mandatory_all'").select("scope", "target").distinct()
    marked = rows.where("kind not in ('mandatory_all', 'distinct_category_group')").join(fixed.withColumn("fixed", F.lit(True)), ["scope", "target"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    by = W("scope", "name")
    place = F.row_number().over(by.orderBy("fixed", F.desc("score"), "target"))
    quota = marked.withColumn("have", F.count_if("fixed").over(by)).withColumn("place", place).where("not fixed and place <= quota - have")
    group = rows.where("kind = 'distinct_category_group'").withColumn("k", F.row_number().over(W("scope", "name", "category").orderBy(F.desc("score"), "target"))).where("k <= each")
    sums = group.groupBy("scope", "name", "category", "each", "quota").agg(F.sum("score").alias("total"), F.count("*").alias("n")).where("n = each")
    best = sums.withColumn("place", F.row_number().over(W("scope", "name").orderBy(F.desc("total"), "category"))).where("place <= quota").select("scope", "name", "category")
    named = group.join(best, ["scope", "name", "category"], "left_semi").select("scope", "target", F.concat_ws(":", "name", "category").alias("reason"), F.lit(2).alias("rank"))
    every = fixed.select("scope", "target", F.lit("mandatory_all").alias("reason"), F.lit(0).alias("rank")).unionByName(quota.select("scope", "target", F.col("name").alias("reason"), F.lit(1).alias("rank"))).unionByName(named)
    return every.groupBy("scope", "target").agg(F.min(F.struct("rank", "reason")).alias("m")).select("scope", "target", F.col("m.reason").alias("reason"))


PLAN = "scope string, segment int, place int, target long, leg double, entry boolean, virtual boolean, role string, why string, dmax double, status string"
EMPTY = [c.split()[0] for c in PLAN.split(", ")]


def with_ways(targets: DataFrame, closure: DataFrame | None, run: Callable, schema: str) -> DataFrame:
    """run(key, targets, ids, d) for each scope's targets sorted by id, d being the distances of closure (scope, src, dst, distance), or
    straight ways (targets then have x, y) where there is none. Targets of no scope have no straight ways."""

    def sorted_ids(t: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        t = t.drop_duplicates("target").sort_values("target")
        return t, t["target"].to_numpy(np.int64)

    def given(key: tuple, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])
        t, ids = sorted_ids(t)
        return run(key, t, ids, matrix(ids, c["src"].to_numpy(np.int64), c["dst"].to_numpy(np.int64), c["distance"].to_numpy(float)))

    def straight(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t, ids = sorted_ids(t)
        known = 0.0 if not pd.isna(key[0]) else np.nan
        return run(key, t, ids, Straight(t["x"].to_numpy(float) + known, t["y"].to_numpy(float) + known))

    if closure is None:
        return by_key(targets, "scope").applyInPandas(straight, schema)
    return by_key(targets, "scope").cogroup(by_key(closure.select(F.col("scope").alias("s"), "src", "dst", "distance"), "s")).applyInPandas(given, schema)


def floor_plans(targets: DataFrame, selected: DataFrame, closure: DataFrame | None = None, successions: DataFrame | None = None, ratio: float = DMAX) -> DataFrame:
    """Plans of all scopes: a row a visit, and one row without a target for a scope that has no plan.

    targets (scope, target, area, x, y, score, mandatory, legal, scale, primary); selected (scope, target); closure (scope, src,
    dst, distance) of reachable pairs, or straight ways where it is missing, of which none is a row; successions (scope, src, dst,
    weight) are learned. The longest leg is ratio times the larger
    of the scope's scale and its targets' extent. A task holds one scope."""
    chosen = targets.join(selected.select("scope", "target", F.lit(True).alias("chosen")), ["scope", "target"], "left")
    if successions is not None:
        by = successions.groupBy("scope", F.col("src").alias("target")).agg(F.collect_list(F.struct("dst", "weight")).alias("next"))
        chosen = chosen.join(by, ["scope", "target"], "left")
    else:
        chosen = chosen.withColumn("next", F.lit(None).cast("array<struct<dst:bigint,weight:double>>"))

    def run(key: tuple, t: pd.DataFrame, ids: np.ndarray, d: np.ndarray | Straight) -> pd.DataFrame:
        follows = {}
        for i, row in enumerate(t["next"]):
            for step in row if row is not None else []:
                j = int(np.searchsorted(ids, step["dst"]))
                if j < len(ids) and ids[j] == step["dst"]:
                    follows[i, j] = step["weight"]
        area = [a if isinstance(a, str) and a else f"UNASSIGNED::{i}" for a, i in zip(t["area"], ids, strict=True)]
        s = Scope(d, Successions(len(ids), follows), t["score"].to_numpy(float), t["mandatory"].to_numpy(bool), area, t["legal"].to_numpy(bool))
        extent = max(float(t["x"].max() - t["x"].min()), float(t["y"].max() - t["y"].min()), 1.0)
        dmax = ratio * max(float(t["scale"].iloc[0]), extent)
        wanted = set(np.flatnonzero(t["chosen"].fillna(False).to_numpy(bool)).tolist())
        status, segments = plan_scope(s, wanted, dmax, bool(t["primary"].iloc[0]))
        rows = []
        for n, g in enumerate(segments, 1):
            for k, i in enumerate(g.walk):
                role = "required" if i in g.required else "relay" if i in g.relays else "start"
                rows.append((key[0], n, len(rows) + 1, int(ids[i]), float(d[g.walk[k - 1], i]) if k else 0.0, k == 0, g.virtual and k == 0, role, g.why if k == 0 else "", dmax, status))
        return pd.DataFrame(rows or [(key[0], 0, 0, None, None, False, False, "", "", dmax, status)], columns=EMPTY).astype({"target": "Int64"})

    return with_ways(chosen, closure, run, PLAN)


TREE = "scope string, source long, target long, distance double, step int"


def relay_trees(targets: DataFrame, closure: DataFrame | None, dmax: float) -> DataFrame:
    """Per scope a tree that joins its required targets from the smallest one on in legs of at most dmax, others being relays:
    targets (scope, target, score, required), closure (scope, src, dst, distance), or straight ways between targets' x, y where it is
    missing, of which none is a row. What can't be joined has no row."""

    def run(key: tuple, t: pd.DataFrame, ids: np.ndarray, d: np.ndarray | Straight) -> pd.DataFrame:
        need = np.flatnonzero(t["required"].to_numpy(bool)).tolist()
        if not need:
            return pd.DataFrame(columns=[x.split()[0] for x in TREE.split(", ")])
        s = Scope(d, Successions(len(ids), {}), t["score"].to_numpy(float), np.zeros(len(ids), bool), [""] * len(ids), np.zeros(len(ids), bool))
        edges, left = [], set(need)
        while left:  # what one tree can't reach begins another
            root = min(left)
            more, left = relay_tree(s, left, list(range(len(ids))), root, dmax)
            edges += more
        return pd.DataFrame([(key[0], int(ids[a]), int(ids[b]), w, k + 1) for k, (a, b, w) in enumerate(edges)], columns=[x.split()[0] for x in TREE.split(", ")])

    return with_ways(targets, closure, run, TREE)


AREAS = "scope string, parent string, child string, distance double, step int"


def area_trees(targets: DataFrame, closure: DataFrame) -> DataFrame:
    """Per scope the tree over its areas: targets (scope, target, area, score, mandatory), closure (scope, src, dst, distance); the
    root has no parent. Areas meet by their closest pairs, found before anything of a scope meets in a task."""
    near = area_pairs(targets, closure)
    values = targets.groupBy("scope", "area").agg(F.sum(F.col("score") + F.when(F.col("mandatory"), MANDATORY).otherwise(0.0)).alias("value"))

    def run(key: tuple, v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        links = {(a, b): (w, 0, 0) for a, b, w in zip(e["left"], e["right"], e["distance"], strict=True)}
        root, tree, _ = area_tree(links, dict(zip(v["area"], v["value"], strict=True)))
        rows = [(key[0], None, root, 0.0, 0), *((key[0], a, b, w, k + 1) for k, (a, b, w) in enumerate(tree))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in AREAS.split(", ")])

    return by_key(values, "scope").cogroup(by_key(near.select(F.col("scope").alias("s"), "left", "right", "distance"), "s")).applyInPandas(run, AREAS)


def area_pairs(targets: DataFrame, closure: DataFrame) -> DataFrame:
    """(scope, left, right, distance, left_target, right_target): of each two areas, in order of their names, the closest pair of
    targets, ties to the smaller ids; a partial aggregate over the closure's rows."""
    a = targets.select("scope", F.col("target").alias("src"), F.col("area").alias("left"))
    b = targets.select("scope", F.col("target").alias("dst"), F.col("area").alias("right"))
    j = closure.join(a, ["scope", "src"]).join(b, ["scope", "dst"]).where("left < right")
    best = j.groupBy("scope", "left", "right").agg(F.min(F.struct("distance", "src", "dst")).alias("m"))
    return best.select("scope", "left", "right", "m.distance", F.col("m.src").alias("left_target"), F.col("m.dst").alias("right_target"))


def closest_ways(targets: DataFrame, most: int = PAIRS) -> DataFrame:
    """What area_pairs needs of all straight ways between targets (scope, target, area, x, y): (scope, src, dst, distance) of those
    within 2e-9 of the least of their block and two areas, so that rounding to nine decimals changes nothing, and of equal ones the
    smallest ids. Every pair is looked at in blocks of about `most`; few leave the task."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["scope", "src", "dst", "distance"])
        a, b = a.sort_values(["area", "target"]), b.sort_values(["other_area", "other"])
        code = pd.factorize(pd.concat([a["area"], b["other_area"]]))[0]
        left, right = code[: len(a)], code[len(a) :]
        first = [np.flatnonzero(np.append(True, c[1:] != c[:-1])) for c in (left, right)]
        own = [np.cumsum(np.append(0, c[1:] != c[:-1])) for c in (left, right)]
        d = np.hypot(a["x"].to_numpy(float)[:, None] - b["ox"].to_numpy(float), a["y"].to_numpy(float)[:, None] - b["oy"].to_numpy(float))
        size = np.where(np.isnan(d), np.inf, d)
        least = np.minimum.reduceat(np.minimum.reduceat(size, first[0], axis=0), first[1], axis=1)
        i, j = np.nonzero((size <= least[own[0]][:, own[1]] + 2e-9) & (left[:, None] != right))
        out = pd.DataFrame({"scope": key[0], "src": a["target"].to_numpy()[i], "dst": b["other"].to_numpy()[j], "distance": d[i, j], "l": left[i], "r": right[j]})
        return out.sort_values(["distance", "src", "dst"]).drop_duplicates(["l", "r", "distance"])[["scope", "src", "dst", "distance"]]

    points = targets.where("area is not null").select("scope", "target", "area", "x", "y")
    return in_blocks(points, points.toDF("scope", "other", "other_area", "ox", "oy"), "scope", "target", run, "scope string, src long, dst long, distance double", most)


WALK = "scope string, place int, target long, final boolean"


def tree_walks(trees: DataFrame) -> DataFrame:
    """Open walks over trees (scope, source, target, distance): from the smallest target of each tree to the one farthest from it,
    one tree after the other."""

    def run(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(e["source"].tolist(), e["target"].tolist(), e["distance"].tolist(), strict=True))
        near: dict[int, set[int]] = {}
        for a, b, _ in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        left, rows = set(near), []
        while left:
            root, inside, todo = min(left), set(), [min(left)]
            while todo:
                if (a := todo.pop()) not in inside:
                    inside.add(a)
                    todo += near[a] - inside
            walk, end = open_walk(root, [x for x in edges if x[0] in inside], {})
            rows += [(key[0], len(rows) + k + 1, i, k == len(walk) - 1 and i == end) for k, i in enumerate(walk)]
            left -= inside
        return pd.DataFrame(rows, columns=[x.split()[0] for x in WALK.split(", ")])

    return by_key(trees, "scope").applyInPandas(run, WALK)


def locked_plan(plan: DataFrame, candidates: DataFrame) -> DataFrame:
    """A plan (scope, segment, place, target, entry, virtual) as it is, with each visit's ordinal in its segment and at its target.
    What doesn't fit raises when it is read: a target that isn't among the candidates (scope, target), an entry that isn't its
    segment's first visit."""
    j = plan.join(candidates.select("scope", "target", F.lit(True).alias("_known")), ["scope", "target"], "left")
    ordinal = F.row_number().over(W("scope", "segment").orderBy("place"))
    again = F.row_number().over(W("scope", "target").orderBy("place"))
    j = j.withColumns({"_in_segment": ordinal, "_at_target": again})
    wrong = F.when(F.col("_known").isNull(), F.concat_ws(" ", F.lit("a control target is no candidate:"), "scope", F.col("target").cast("string"))).when((F.col("_in_segment") == 1) != F.col("entry"), F.concat_ws(" ", F.lit("an entry isn't its segment's first visit:"), "scope", F.col("segment").cast("string")))
    sure = F.when(wrong.isNull(), F.col("target")).otherwise(F.raise_error(wrong))
    return j.select("scope", "segment", "place", sure.alias("target"), "entry", "virtual", F.col("_in_segment").alias("segment_ordinal"), F.col("_at_target").alias("target_ordinal"), (F.col("_at_target") > 1).alias("repeated"))


def W(*keys: str) -> WindowSpec:  # noqa: N802
    return Window.partitionBy(*keys)
