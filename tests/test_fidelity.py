"""Operators without SQL against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import boxes as B
from gridloom.functions.similarity import jaro_winkler
from gridloom.operators import clusters, matching, routes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_every_text_gets_a_class(spark):
    names = ["blue ring", "large bolt", "gear box", "widget"]
    texts = ["blue rings", "zzz", "bolt large", "WIDGET", "", "gear", "q"]
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    def cosine(a, b):
        x, y = grams(a), grams(b)
        dot = sum(x.count(g) * y.count(g) for g in set(x) & set(y))
        size = lambda v: sum(v.count(g) ** 2 for g in set(v)) ** 0.5
        return dot / (size(x) * size(y)) if x and y else 0.0

    def score(t, c):
        t, c = t.lower(), c.lower()
        if t == c:
            return 1.0
        edit = 0.0 if not t or not c else 1 - distance(t, c) / max(len(t), len(c))
        return round(0.35 * edit + 0.25 * jaro_winkler(t, c) + 0.4 * cosine(t, c), 6)

    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id int, t string")
    got = {r.id: (r["class"], r.score) for r in matching.fuzzy_class(items, spark.createDataFrame([(n,) for n in names], "class string"), "id", "t").collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        best = max(score(t, c) for c in names)
        assert got[i][1] == pytest.approx(best, abs=1e-6) and score(t, got[i][0]) == pytest.approx(best, abs=1e-6), t


def test_boxes_merge_until_none_is_near(spark):
    rng = random.Random(5)
    for gap in (0.5, 2.0):
        rows = [(1, i, x := rng.uniform(0, 40), y := rng.uniform(0, 40), x + 1, y + 1) for i in range(60)]
        plain = [([i], [x0, y0, x1, y1]) for _, i, x0, y0, x1, y1 in rows]
        near = lambda a, b: a[0] - gap <= b[2] and b[0] <= a[2] + gap and a[1] - gap <= b[3] and b[1] <= a[3] + gap  # noqa: B023, E731
        while pair := next(((a, b) for a in plain for b in plain if a is not b and near(a[1], b[1])), None):
            a, b = pair
            plain = [p for p in plain if p is not a and p is not b] + [(a[0] + b[0], [min(a[1][0], b[1][0]), min(a[1][1], b[1][1]), max(a[1][2], b[1][2]), max(a[1][3], b[1][3])])]
        df = spark.createDataFrame(rows, "floor int, id long, x0 double, y0 double, x1 double, y1 double").select("floor", "id", B.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
        got = {r.id: (r.members, tuple(r.b)) for r in clusters.merged_boxes(df, gap, 5.0).collect()}
        assert got == {min(ids): (len(ids), tuple(b)) for ids, b in plain}


def test_axis_clusters_run_on_over_gaps(spark):
    rng = random.Random(3)
    rows = [(f, rng.uniform(0, 3)) for f in (1, 2) for _ in range(200)] + [(1, 50.0), (1, 50.0), (3, 1.0)]
    want = {}
    for f in (1, 2, 3):
        out = []
        for v in sorted(x for g, x in rows if g == f):
            if out and abs(v - out[-1][0]) <= 0.05:
                out[-1][1] += 1
                out[-1][0] += (v - out[-1][0]) / out[-1][1]
            else:
                out.append([v, 1])
        want |= {(f, k): (pytest.approx(m), n) for k, (m, n) in enumerate(out)}
    got = {(r.floor, r.place): (r.mean, r.n) for r in clusters.axis_clusters(spark.createDataFrame(rows, "floor int, x double"), "x", 0.05).collect()}
    assert got == want


def test_insertion_costs(spark):
    rng = np.random.default_rng(1)
    route, others = rng.normal(size=(9, 2)), rng.normal(size=(50, 2))
    legs = [(1, *(route[k - 1].tolist() if k else (None, None)), *route[k].tolist()) for k in range(9)]
    far = lambda a, b: float(np.hypot(*(a - b)))
    want = [min([far(p, route[0])] + [far(route[k - 1], p) + far(p, route[k]) - far(route[k - 1], route[k]) for k in range(1, 9)]) for p in others]
    t = spark.createDataFrame([(1, i, *p.tolist()) for i, p in enumerate(others)], "floor int, target_id long, x double, y double")
    got = {r.target_id: r.saving for r in routes.insertion_costs(t, spark.createDataFrame(legs, "floor int, ax double, ay double, bx double, by double"), 7).collect()}
    assert [got[i] for i in range(50)] == pytest.approx(want)
