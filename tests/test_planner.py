"""Constrained routes and floor plans: pinned cases and brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import context, optimizer, planner, planning, spatial
from gridloom.operators.optimizer import Requirement
from gridloom.operators.routes import held_karp


def line(n):
    return np.abs(np.arange(n)[:, None] - np.arange(n)[None]).astype(float)


@pytest.mark.parametrize(("work", "solver", "reason"), [(20, "heuristic_greedy_2opt", "exact_work_budget_exceeded"), (100, "exact_enumeration_held_karp", "within_exact_limits_and_work_budget"), (None, "exact_enumeration_held_karp", "within_exact_limits_and_work_budget")])
def test_work_budget(work, solver, reason):
    needs = [Requirement("mandatory", "mandatory_all", (0, 1)), Requirement("quota", "quota_per_class", (2, 3, 4, 5, 6), 2)]
    out = optimizer.optimise(1.0 - np.eye(7), needs, work=work)
    assert (out["feasible"], out["combinations"], out["estimated_targets"], out["work_units"], out["exact_eligible"], out["over_budget"]) == (True, 10, 4, 40, True, work == 20)
    assert (out["solver"], out["reason"], len(out["order"]), out["length"]) == (solver, reason, 4, 3.0)
    assert [a[1] for a in out["audit"]] == ["satisfied", "satisfied"]


def brute(d, needs, cap=np.inf):
    best = np.inf
    fixed = frozenset(i for r in needs if r.kind == "mandatory_all" for i in r.items)
    for ways in itertools.product(*[r.ways(fixed) for r in needs if r.kind != "mandatory_all"]):
        for p in itertools.permutations(sorted(fixed.union(*ways))):
            legs = [d[a, b] for a, b in itertools.pairwise(p)]
            if all(w <= cap for w in legs):
                best = min(best, sum(legs))
    return best


def test_exact_routes_equal_all_orders():
    rng = np.random.default_rng(3)
    for k in range(40):
        xy = rng.normal(size=(8, 2))
        d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        needs = [Requirement("m", "mandatory_all", (0, 1)[: k % 3]), Requirement("q", "quota_total", (2, 3, 4), 2), Requirement("g", "distinct_category_group", count=2, categories={"a": (3, 5), "b": (6,), "c": (7, 0)})]
        cap = None if k % 2 else 1.5
        out = optimizer.optimise(d, needs, cap=cap)
        want = brute(d, needs, cap or np.inf)
        assert out["feasible"] == np.isfinite(want)
        if out["feasible"]:
            assert out["length"] == pytest.approx(want)
            loose = optimizer.optimise(d, needs, work=0, cap=cap)
            assert not loose["feasible"] or loose["length"] >= want - 1e-9
            # groups and quotas may overlap; a selection is legal where each is met by its own options
            assert not loose["feasible"] or set(loose["order"]) >= set(needs[0].items)


def test_values_win_within_the_tolerance():
    d, needs = line(6), [Requirement("m", "mandatory_all", (0,)), Requirement("q", "quota", (1, 2, 5), 1)]
    values = np.array([0, 1, 5, 100, 0, 9.0])
    assert optimizer.optimise(d, needs)["order"] == [1, 0]  # of equal routes the one that ends at the smallest target
    assert set(optimizer.optimise(d, needs, values=values, tolerance=1.0)["order"]) == {0, 2}
    assert set(optimizer.optimise(d, needs, values=values, tolerance=4.0)["order"]) == {0, 5}
    assert set(optimizer.optimise(d, needs, values=values, tolerance=4.0, work=0)["order"]) >= {0}


def test_gaps_caps_and_nothing_to_do():
    d, needs = line(5), [Requirement("m", "mandatory_all", (0, 2, 4))]
    out = optimizer.optimise(d, needs, soft_gap=1.5, gap_weight=1.0)
    assert (out["order"], out["length"], out["gap_excess"], out["long_gaps"], out["longest_leg"]) == ([4, 2, 0], 4.0, 1.0, 2, 2.0)
    assert not optimizer.optimise(d, needs, cap=1.0)["feasible"]
    assert optimizer.optimise(d, [Requirement("q", "quota", (), 0)])["status"] == "nothing_to_visit"
    assert optimizer.optimise(d, [Requirement("q", "quota", (1,), 2)])["reason"] == "invalid_or_empty_optional_requirement_options"
    assert optimizer.optimise(d, needs, known=np.array([1, 1, 0, 1, 1], bool))["status"] == "mandatory_target_unknown"
    far = np.where(line(4) > 1, np.inf, line(4))
    assert optimizer.optimise(far, [Requirement("m", "mandatory_all", (0, 3))])["feasible"] is False
    many = optimizer.optimise(line(40), [Requirement("m", "mandatory_all", tuple(range(40)))])
    assert (many["solver"], many["reason"], many["length"]) == ("heuristic_greedy_2opt", "mandatory_target_count_exceeds_exact_limit", 39.0)
    large = optimizer.optimise(line(100), [Requirement("m", "mandatory_all", tuple(range(100)))])
    assert large["length"] == 99.0


def test_shortest_orders():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        xy = rng.normal(size=(n, 2))
        d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        best = min(sum(d[a, b] for a, b in itertools.pairwise(p)) for p in itertools.permutations(range(n)))
        assert optimizer.path_length(d, held_karp(d)) == pytest.approx(best)
        assert best - 1e-9 <= optimizer.path_length(d, optimizer.ordered(d)) <= best * 1.5 + 1e-9
    split = np.where((np.arange(4)[:, None] < 2) == (np.arange(4)[None] < 2), 1.0, np.inf)
    assert held_karp(split) is None and optimizer.ordered(split) is None


def test_matrix_takes_either_way():
    ids = np.array([3, 5, 9])
    d = optimizer.matrix(ids, np.array([5, 3, 9, 9, 7]), np.array([3, 5, 3, 5, 3]), np.array([4.0, 2.0, np.nan, -1.0, 1.0]))
    assert d.tolist() == [[0, 2, np.inf], [4, 0, np.inf], [np.inf, np.inf, 0]]
    assert optimizer.matrix(ids, np.array([9]), np.array([3]), np.array([7.0]))[0, 2] == 7.0


CLOSURE = "scope string, src long, dst long, distance double"
TARGETS = "scope string, target long, area string, x double, y double, score double, mandatory boolean, legal boolean, scale double, primary boolean"


def planned(spark, targets, required, components, scope="F2", primary=True):
    """targets: id to (class, raw name, score); ways of 10 within a component."""
    rows = [(scope, i, f"A{components[i]}", 0.0 if legal[0] in planner.STARTS else 10.0, 0.0, legal[2], i in required, legal[0], legal[1]) for i, legal in targets.items()]
    t = spark.createDataFrame(rows, "scope string, target long, area string, x double, y double, score double, mandatory boolean, class string, raw string")
    t = t.withColumn("legal", planner.is_start(F.col("class"), F.col("raw"), F.lit(None).cast("string"))).withColumns({"scale": F.lit(100.0), "primary": F.lit(primary)}).drop("class", "raw")
    ways = [(scope, a, b, 0.0 if a == b else 10.0) for a in targets for b in targets if components[a] == components[b]]
    chosen = spark.createDataFrame([(scope, i) for i in required], "scope string, target long")
    return planner.floor_plans(t, chosen, spark.createDataFrame(ways, CLOSURE)).orderBy("place").collect()


SMOKE = ("火灾探测器", "感烟探测器", 0.9)


@pytest.mark.parametrize("start", [("安全出口", "STAIR", 0.8), ("消防电梯", "消防电梯", 0.8)])
def test_an_optional_exit_begins_the_route(spark, start):
    rows = planned(spark, {1: start, 2: SMOKE}, {2}, {1: 0, 2: 0})
    assert [(r.target, r.role, r.entry, r.virtual, r.status) for r in rows] == [(1, "start", True, False, "feasible"), (2, "required", False, False, "feasible")]
    assert rows[0].dmax == 80.0


def test_a_fire_door_begins_nothing(spark):
    rows = planned(spark, {1: ("安全出口", "FM乙12", 0.8), 2: SMOKE}, {2}, {1: 0, 2: 0})
    assert [(r.target, r.status) for r in rows] == [(None, "infeasible_route_start")]


def test_a_second_component_begins_virtually(spark):
    rows = planned(spark, {1: ("安全出口", "STAIR", 0.7), 2: SMOKE, 3: SMOKE}, {2, 3}, {1: 0, 2: 0, 3: 1})
    assert [(r.segment, r.target, r.virtual, r.why) for r in rows] == [(1, 1, False, ""), (1, 2, False, ""), (2, 3, True, "physical_graph_disconnected_from_floor_route_start")]


def test_an_exit_of_its_own_is_the_first_segment(spark):
    rows = planned(spark, {1: ("消防电梯", "消防电梯", 0.7), 2: SMOKE}, {2}, {1: 0, 2: 1})
    assert [(r.segment, r.target, r.role, r.virtual) for r in rows] == [(1, 1, "start", False), (2, 2, "required", True)]


def test_a_second_building_begins_virtually(spark):
    rows = planned(spark, {2: SMOKE}, {2}, {2: 0}, "F1__B02", primary=False)
    assert [(r.target, r.virtual, r.why) for r in rows] == [(2, True, "building_scope_disconnected_from_physical_floor_route_start")]
    assert [r.status for r in planned(spark, {2: SMOKE}, {2}, {2: 0})] == ["infeasible_route_start"]
    scopes = spark.createDataFrame([("F3__B02", None), ("F3", None), ("x", "F9")], "s string, f string").select(planner.physical_floor(F.col("s"), F.col("f")).alias("v"))
    assert [r.v for r in scopes.collect()] == ["F3", "F3", "F9"]


def test_nothing_required(spark):
    t = spark.createDataFrame([("F1", 1, "A", 0.0, 0.0, 0.5, False, True, 1.0, True)], TARGETS)
    none = spark.createDataFrame([], "scope string, target long")
    out = planner.floor_plans(t, none, spark.createDataFrame([], CLOSURE)).collect()
    assert [(r.status, r.target) for r in out] == [("infeasible_no_routable_inspection_targets", None)]


def scope(d, score=None, follows=None, area=None):
    n = len(d)
    return planner.Scope(d, np.zeros((n, n)) if follows is None else follows, np.zeros(n) if score is None else score, np.zeros(n, bool), area or ["A"] * n, np.zeros(n, bool))


def test_relays_discount_every_leg():
    d = np.full((4, 4), np.inf)
    for a, b, w in ((0, 1, 1.0), (1, 3, 1.0), (0, 2, 1.03), (2, 3, 1.03)):
        d[a, b] = d[b, a] = w
    np.fill_diagonal(d, 0)
    tree = lambda score, follows=None: [e[:2] for e in planner.relay_tree(scope(d, np.array(score), follows), {3}, [0, 1, 2, 3], 0, 2.0)[0]]
    assert tree([0, 0, 0, 0.0]) == [(0, 1), (1, 3)]
    assert tree([0, 0, 1.0, 0]) == [(0, 2), (2, 3)]
    learned = np.zeros((4, 4))
    learned[0, 2] = learned[2, 3] = 1.0
    assert tree([0, 0, 0, 0.0], learned) == [(0, 2), (2, 3)]
    edges, left = planner.relay_tree(scope(d), {3}, [0, 1, 2, 3], 0, 0.5)
    assert (edges, left) == ([], {3})


def test_relay_trees_equal_a_plain_search():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(2, 9)
        xy = [(rng.random(), rng.random()) for _ in range(n)]
        d = np.array([[np.hypot(a - c, b - e) for c, e in xy] for a, b in xy])
        score, dmax = np.array([rng.random() for _ in range(n)]), 0.6
        need = set(rng.sample(range(n), rng.randint(1, n)))
        edges, left = planner.relay_tree(scope(d, score), need, list(range(n)), min(need), dmax)
        cost = lambda a, b: d[a, b] * max(0.8, 1 - 0.08 * score[b]) if a != b and d[a, b] <= dmax + 1e-9 else np.inf  # noqa: B023, E731
        tree, todo = {min(need)}, need - {min(need)}
        for a, b, _ in edges:
            assert a in tree and b not in tree
            tree.add(b)
        far = {i: 0.0 if i == min(need) else np.inf for i in range(n)}
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    far[b] = min(far[b], far[a] + cost(a, b))
        assert left == {i for i in todo if not np.isfinite(far[i])}
        if edges and todo - left:
            nearest = min((i for i in todo - left), key=lambda i: far[i])
            assert nearest in tree


def test_area_trees_and_orders():
    links = {("A", "B"): (10.0, 0, 1), ("A", "C"): (11.0, 0, 2), ("B", "C"): (1.0, 1, 2)}
    assert planner.area_tree(links, {"A": 5.0, "B": 0.0, "C": 4.0}) == ("A", [("A", "C", 11.0), ("C", "B", 1.0)], [])  # 11 / 1.28 < 10
    assert planner.area_tree(links, {"A": 5.0, "B": 0.0, "C": 0.0}) == ("A", [("A", "B", 10.0), ("B", "C", 1.0)], [])
    assert planner.area_tree({}, {"A": 1.0, "B": 1.0}) == ("B", [], ["A"])
    assert planner.area_tree(links, {"A": 5.0, "B": 0.0, "C": 0.0}, "C")[0] == "C"
    assert planner.preorder("A", [("A", "B", 10.0), ("A", "C", 10.0), ("B", "D", 1.0)], {"A": 1, "B": 0.0, "C": 4.0, "D": 1}) == ["A", "C", "B", "D"]


def test_local_orders():
    d = line(6)
    assert planner.local_order(scope(d), [5, 3, 1, 2], 0) == [1, 2, 3, 5]
    assert planner.local_order(scope(d, np.array([0, 0, 9, 0, 0, 0.0])), [1, 2, 3], None)[0] in (1, 2, 3)
    follows = np.zeros((6, 6))
    follows[1, 3] = 40.0  # strong enough to be seen: 0.03 of the farthest way each
    path = planner.local_order(scope(d, follows=follows), [1, 2, 3], 0)
    assert sorted(path) == [1, 2, 3]
    assert planner.reversed_locally(d, [2, 1, 3, 4], 0) == [1, 2, 3, 4]


def test_walks_end_at_the_farthest_leaf():
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 3, 5.0), (1, 4, 0.5)]
    assert planner.open_walk(0, edges, {}) == ([0, 1, 4, 1, 2, 1, 0, 3], 3)
    assert planner.open_walk(0, edges, {2: 0, 4: 1}) == ([0, 1, 2, 1, 4, 1, 0, 3], 3)
    assert planner.open_walk(7, [], {}) == ([7], 7)
    rng = random.Random(2)
    for n in range(2, 12):
        edges = [(rng.randrange(k), k, rng.random()) for k in range(1, n)]
        walk, end = planner.open_walk(0, edges, {})
        ways = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
        assert set(walk) == set(range(n)) and walk[0] == 0 and walk[-1] == end
        assert all(p in ways for p in itertools.pairwise(walk))
        far = {0: 0.0}
        for a, b, w in edges:
            far[b] = far[a] + w
        assert far[end] == max(far.values())


def test_long_trees_need_no_deep_stack():
    walk, end = planner.open_walk(0, [(k, k + 1, 1.0) for k in range(5000)], {})
    assert walk == list(range(5001)) and end == 5000
    assert planner.preorder("0000", [(f"{k:04d}", f"{k + 1:04d}", 1.0) for k in range(5000)], {})[-1] == "5000"


def test_rules_choose_targets(spark):
    t = spark.createDataFrame([("F", i, i / 10) for i in range(10)], "scope string, target long, score double")
    rows = [("F", "all", "mandatory_all", "", i, 0, 1) for i in (0, 9)] + [("F", "q", "quota_per_class", "", i, 3, 1) for i in (1, 2, 3, 9)]
    rows += [("F", "g", "distinct_category_group", c, i, 2, 2) for c, i in (("a", 4), ("a", 5), ("b", 6), ("c", 7), ("c", 8), ("d", 1), ("d", 2), ("d", 3), ("z", 77))]
    r = spark.createDataFrame(rows, "scope string, name string, kind string, category string, target long, quota int, each int")
    got = {x.target: x.reason for x in planner.rule_targets(t, r).collect()}
    assert got == {0: "mandatory_all", 9: "mandatory_all", 3: "q", 2: "q", 7: "g:c", 8: "g:c", 4: "g:a", 5: "g:a"}


def test_locked_plans_raise_on_what_does_not_fit(spark):
    rows = [("F", 1, 1, 5, True, False), ("F", 1, 2, 6, False, False), ("F", 1, 3, 5, False, False), ("F", 2, 4, 7, True, True)]
    plan = spark.createDataFrame(rows, "scope string, segment int, place int, target long, entry boolean, virtual boolean")
    known = plan.select("scope", "target").distinct()
    got = [(r.target, r.segment_ordinal, r.target_ordinal, r.repeated, r.virtual) for r in planner.locked_plan(plan, known).orderBy("place").collect()]
    assert got == [(5, 1, 1, False, False), (6, 2, 1, False, False), (5, 3, 2, True, False), (7, 1, 1, False, True)]
    with pytest.raises(Exception, match="no candidate: F 7"):
        planner.locked_plan(plan, known.where("target < 7")).collect()
    with pytest.raises(Exception, match="first visit: F 1"):
        planner.locked_plan(plan.where("place > 1"), known).collect()


def test_walks_count_edges_and_avoid_banned_ones(spark):
    square = [(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 0, 3, 1.5)]
    edges = spark.createDataFrame(square, "floor int, a long, b long, w double")
    legs = spark.createDataFrame([(0, 1, 0, 2), (0, 2, 2, 0), (0, 3, 0, 9)], "floor int, place int, src long, dst long")
    paths = planning.shortest_paths(edges, legs)
    e = planning.edge_events(legs, paths).orderBy("event").collect()
    assert [(r.a, r.b, r["pass"], r.repeated) for r in e] == [(0, 1, 1, False), (1, 2, 1, False), (2, 1, 2, True), (1, 0, 2, True)]
    assert tuple(planning.walk_summary(legs, paths).first()) == (0, 3, 1, 4.0, 4, 2, 2, 0)
    banned = spark.createDataFrame([(0, 2, 1)], "floor int, a long, b long")
    assert {(r.src, r.dst): list(r.nodes) for r in planning.shortest_paths(edges, legs, banned).collect()} == {(0, 2): [0, 3, 2], (2, 0): [2, 3, 0]}


def test_counterfactual_savings(spark):
    inf = float("inf")
    t = spark.createDataFrame([(1, i, 0, False) for i in range(6)], "floor int, target long, rule int, mandatory boolean")
    d = spark.createDataFrame([(1, a, b, float(abs(a - b))) for a in range(6) for b in range(6)], "floor int, src long, dst long, distance double")
    known = spark.createDataFrame([(1, 0, 10.0, 7.0, 50.0), (1, 1, inf, 7.0, 50.0), (1, 2, 3.0, 9.0, 50.0), (1, 3, inf, inf, 50.0)], "floor int, target long, excluding double, forcing double, scale double")
    got = {r.target: (r.saving, r.source) for r in context.route_savings(t, d, known).collect()}
    assert [got[i][0] for i in range(4)] == [3.0, 50.0, 0.0, 0.0] and got[4][1] == "distance_proxy" and got[4][0] == pytest.approx(15 / 5 - 11 / 5)


def test_the_closest_ways_of_areas_are_enough(spark):
    rng = np.random.default_rng(7)
    at = [*rng.integers(0, 12, (90, 2)).tolist(), [3, 3], [3, 3], [3, 3]]  # many equal distances, and copies
    t = spark.createDataFrame([("s", k, f"A{k % 7}" if k % 11 else None, x / 10, y / 10) for k, (x, y) in enumerate(at)] + [("one", 1, "A", 0.0, 0.0)], "scope string, target long, area string, x double, y double")
    every = [("s", a, b, float(np.hypot(at[a][0] / 10 - at[b][0] / 10, at[a][1] / 10 - at[b][1] / 10))) for a in range(len(at)) for b in range(len(at))]
    whole = spark.createDataFrame(every, "scope string, src long, dst long, distance double")
    rounded = lambda df: sorted(map(tuple, planner.area_pairs(t, df.withColumn("distance", F.round("distance", 9))).collect()))
    few = planner.closest_ways(t, 500)
    assert rounded(few) == rounded(whole) and len(rounded(few)) == 21 and few.count() < len(every) / 4


def test_straight_counterfactuals_need_no_pairs(spark):
    at = np.random.default_rng(8).uniform(0, 3, (40, 2)).tolist()
    t = spark.createDataFrame([(f, k, *p) for f in (1, 2, 3) for k, p in enumerate(at)], "floor int, target long, x double, y double")
    r = spark.createDataFrame([(1, k, p) for p, k in enumerate((7, 3, 30, 12))] + [(2, 5, 1), (3, None, None)], "floor int, target long, place int")
    shown = lambda c: {(x.floor, x.target): (round(x.forcing, 9), round(x.scale, 9)) for x in c.collect()}
    assert shown(context.route_counterfactuals(t, r)) == shown(context.route_counterfactuals(t, r, optimizer.blocked_distances(t, 300)))


def test_only_asked_targets_go_into_the_search(spark):
    from gridloom.plans import planning_queries as Q

    t, rules, closure = Q.optimiser_input(spark, "/root/testdata/sf0.001")
    asked = {(r.floor, x) for r in rules.collect() for x in r["items"]}
    assert {(r.floor, r.target) for r in t.collect()} == asked
    assert sorted((r.floor, r.src, r.dst) for r in closure.collect()) == sorted((f, a, b) for f, a in asked for g, b in asked if f == g)


def test_straight_ways_are_read_like_a_matrix():
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 9, (2, 40)) / 10
    x[7] = np.nan
    with np.errstate(invalid="ignore"):
        d = np.round(np.hypot(x[:, None] - x, y[:, None] - y), 9)
    d = np.where(np.isnan(d), np.inf, d)
    np.fill_diagonal(d, 0)
    ways, near, plain = planner.Straight(x, y), planner.Straight(x, y).within(0.1), planner.near_in(d, 0.1)
    assert (ways[np.ix_(range(40), range(40))] == d).all() and ways[3, 7] == np.inf and ways[7, 7] == 0
    for i in set(range(40)) - {7}:
        assert [v.tolist() for v in near(i)] == [v.tolist() for v in plain(i)]
    assert planner.clusters_within(ways, 0.1) == planner.clusters_within(d, 0.1)


def test_trees_and_plans_need_no_row_a_pair(spark):
    rng = random.Random(9)
    rows = [("F1", i, rng.randint(0, 30) / 40, rng.randint(0, 30) / 40, f"A{i % 3}", rng.random(), i % 7 == 0, i % 5 == 3, 1.0, True, i % 3 == 0) for i in range(120)]
    t = spark.createDataFrame([*rows, (None, 500, 0.1, 0.1, "A0", 0.5, True, True, 1.0, True, True), (None, 501, 0.1, 0.1, "A0", 0.5, True, True, 1.0, True, True)], "scope string, target long, x double, y double, area string, score double, mandatory boolean, legal boolean, scale double, primary boolean, required boolean")
    ways = spark.createDataFrame([("F1", a[1], b[1], round(float(np.hypot(a[2] - b[2], a[3] - b[3])), 9)) for a in rows for b in rows], CLOSURE)
    got, want = (sorted(map(tuple, planner.relay_trees(t, c, 0.12).collect())) for c in (None, ways))
    assert got == want and len(got) > 30
    chosen = t.where("mandatory").select("scope", "target")
    follows = spark.createDataFrame([("F1", i, (i * 7 + 1) % 120, 0.5) for i in range(120)], "scope string, src long, dst long, weight double")
    got, want = (sorted(map(str, planner.floor_plans(t, chosen, c, follows, ratio=0.12).collect())) for c in (None, ways))
    assert got == want and len(got) > 20
    plan = planner.floor_plans(t, chosen, None, follows, ratio=0.12)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan


def test_walks_over_trees_of_straight_ways(spark):
    t = spark.createDataFrame([("F1", i, i * 0.1, 0.0, 0.0, True) for i in (0, 1, 2, 5, 6)], "scope string, target long, x double, y double, score double, required boolean")
    trees = planner.relay_trees(t, None, 0.12)
    assert [(r.place, r.target, r.final) for r in planner.tree_walks(trees).orderBy("place").collect()] == [(1, 0, False), (2, 1, False), (3, 2, True), (4, 5, False), (5, 6, True)]
    assert "FlatMapCoGroups" not in trees._jdf.queryExecution().optimizedPlan().toString()


def test_context_values_need_no_row_a_pair(spark):
    rng = random.Random(11)
    rows = [(1 + i % 2, i, rng.randint(0, 20) / 64, rng.randint(0, 20) / 64, i % 3, i % 4, 1 + i % 4, i % 9 == 0 and i % 2 == 1) for i in range(120)]
    t = spark.createDataFrame([*rows, (None, 900, 0.1, 0.1, 0, 0, 1, False)], "floor int, target long, x double, y double, area int, rule int, quota int, mandatory boolean")
    areas = t.select("floor", "area").distinct().selectExpr("floor", "area", "area + 1.0D as size", "area % 3 as portals")
    ways = spark.createDataFrame([(a[0], a[1], b[1], float(np.hypot(a[2] - b[2], a[3] - b[3]))) for a in rows for b in rows if a[0] == b[0]], "floor int, src long, dst long, distance double")
    rules = spark.createDataFrame([(1, "all", "mandatory_all", "", [9, 27], 0, 1), (1, "one", "quota_total", "", [1, 41, 81], 1, 1)], "floor int, name string, kind string, category string, items array<long>, count int, each int")
    for of in (lambda d: context.two_pass_values(t, areas, d, rules), lambda d: context.context_values(t, areas, d)):
        got, want = (sorted((r.target, round(r.n, 9), round(r.c, 9)) for r in of(d).collect()) for d in (None, ways))
        assert got == want and len({n for _, n, _ in got}) > 20
    points = t.selectExpr("floor", "target as target_id", "if(target = 5, null, x) as x", "y")
    got, want = (sorted((r.floor, r.target_id, r.other_id, round(r.distance, 9)) for r in df.collect()) for df in (spatial.nearest_within(points, 0.15, 8), spatial.nearest(spatial.near_pairs(points, 0.15), 8)))
    assert got == want and len(got) > 300


def all_routes(d, n, first=2):
    """(length, targets) of all choices of two beside the first ones, each by all orders from the smaller end."""
    orders = [p for p in itertools.permutations(range(first + 2)) if p[0] < p[-1]]
    for pair in itertools.combinations(range(first, n), 2):
        own = [*range(first), *pair]
        yield min(float(sum(d[own[a], own[b]] for a, b in itertools.pairwise(p))) for p in orders), own


def test_more_selections_than_the_limit_are_searched_exactly(spark):
    rng = np.random.default_rng(12)
    xy = rng.integers(0, 30, (324, 2)) / 100  # 51,681 selections; many places are held twice, so lengths tie
    d = np.round(np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)), 9)
    needs, values = [Requirement("m", "mandatory_all", (0, 1)), Requirement("q", "quota", tuple(range(2, 324)), 2)], np.arange(324) * 37 % 101 / 101
    every = list(all_routes(d, 324))
    best = min(every)
    short = optimizer.optimise(d, needs, most=None)
    assert (short["solver"], short["combinations"], short["length"], sorted(short["order"])) == ("exact_enumeration_held_karp", 51_681, *best)
    rich = optimizer.optimise(d, needs, values=values, tolerance=0.2, most=None)
    length, own = max(((w, x) for w, x in every if w <= best[0] * 1.2 + 1e-9), key=lambda r: (sum(values[r[1]].tolist()), -r[0], r[1]))
    assert (rich["length"], rich["shortest"], sorted(rich["order"])) == (length, best[0], own)
    t = spark.createDataFrame([(1, k, float(values[k]), *map(float, p)) for k, p in enumerate(xy)], "floor int, target long, value double, x double, y double")
    r = spark.createDataFrame([(1, "m", "mandatory_all", "", [0, 1], 0, 1), (1, "q", "quota", "", list(range(2, 324)), 2, 1)], "floor int, name string, kind string, category string, items array<long>, count int, each int")
    got = optimizer.optimised_routes(t, r, None, most=None).collect()
    assert sorted(x.target for x in got) == best[1] and {x.solver for x in got} == {"exact_enumeration_held_karp"}


def test_searches_in_blocks_equal_one_by_one():
    rng = np.random.default_rng(13)
    for k in range(30):
        d = rng.uniform(0.1, 1, (8, 8)) if k % 2 else np.abs(np.subtract.outer(x := rng.normal(size=8), x))  # ways back may differ
        needs = [Requirement("m", "mandatory_all", (0, 1)[: k % 3]), Requirement("q", "quota_total", (2, 3, 4), 2), Requirement("g", "distinct_category_group", count=2, categories={"a": (3, 5), "b": (6,), "c": (7, 0)})]
        cap = None if k % 4 else 0.9
        one, all_ = optimizer.optimise(d, needs, cap=cap), optimizer.optimise(d, needs, cap=cap, most=None)
        assert one["feasible"] == all_["feasible"] and (not one["feasible"] or all_["length"] == pytest.approx(one["length"]))


def test_floors_of_few_targets_have_no_route_as_in_the_sql(spark, tmp_path):
    from gridloom.plans import planning_queries as Q

    from .oracle import difference

    ids = {0: range(5), 1: (11, 12, 13), 2: (20,), 3: range(30, 60), 4: (61, 66, 71), 5: (81, 86, 91, 96)}
    rows = [(k, [float(np.float32(np.sin(k))), float(np.float32(np.cos(k * k))), 0.1, 0.1], f) for f, own in ids.items() for k in own] + [(500, [0.1, 0.2, 0.3, 0.4], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/e")
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    out = Q.route_optimizer(spark, str(tmp_path))
    assert difference(out, Q.ROUTE_OPTIMIZER, str(tmp_path)) == "" and {r.floor for r in out.collect()} == {3, 5}
