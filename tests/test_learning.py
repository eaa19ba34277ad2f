"""Graph layers, recommendations, walls and stages against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import stages
from gridloom.functions import polygons as P
from gridloom.functions import rows as R
from gridloom.operators import learning as L
from gridloom.operators import walls as W
from gridloom.operators.selection import greedy_matching
from gridloom.sources import artifacts, shared
from gridloom.streaming import visits

DIM = 3


def test_gated_layer_equals_plain_arrays(spark):
    rng = np.random.default_rng(1)
    h = rng.normal(size=(6, DIM))
    edges = [(0, 1, "A"), (0, 2, "A"), (3, 1, "B"), (4, 4, "A"), (5, 0, "C")]
    values, mask = rng.normal(size=(5, 2)), rng.integers(0, 2, (5, 2)).astype(float)
    w = {f"relation.{r}": rng.normal(size=(DIM, DIM)) for r in "AB"} | {f"gate.{r}.0.weight": rng.normal(size=(4, 1)) for r in "AB"} | {f"gate.{r}.0.bias": rng.normal(size=1) for r in "AB"}
    w |= {"self.0.weight": rng.normal(size=(DIM, DIM)), "self.0.bias": rng.normal(size=DIM), "norm.weight": rng.normal(size=DIM), "norm.bias": rng.normal(size=DIM)}
    got, total = np.zeros((6, DIM)), np.zeros(6)
    for k, (a, b, r) in enumerate(edges):
        if r in "AB":
            g = L.sigmoid(np.concatenate([values[k] * mask[k], mask[k]]) @ w[f"gate.{r}.0.weight"] + w[f"gate.{r}.0.bias"])[0]
            got[b] += g * (h[a] @ w[f"relation.{r}"])
            total[b] += g
    new = h + np.maximum(0, h @ w["self.0.weight"] + w["self.0.bias"] + got / np.maximum(total, 1)[:, None])
    want = (new - new.mean(1, keepdims=True)) / np.sqrt(new.var(1, keepdims=True) + 1e-5) * w["norm.weight"] + w["norm.bias"]
    nodes = spark.createDataFrame([("f", f"n{k}", x.tolist()) for k, x in enumerate(h)], "floor string, node string, h array<double>")
    links = spark.createDataFrame([("f", f"n{a}", f"n{b}", r, v.tolist(), m.tolist()) for (a, b, r), v, m in zip(edges, values, mask, strict=True)], "floor string, src string, dst string, relation string, values array<double>, mask array<double>")
    rows = {r.node: r.h for r in L.gated_layer(nodes, links, w, ["A", "B"], DIM).collect()}
    assert np.allclose([rows[f"n{k}"] for k in range(6)], want)
    with pytest.raises(ValueError, match="bytes of weights"):
        L.shipped(spark, {"big": np.zeros(10 << 20)})


def test_heads_and_features(spark):
    one = spark.createDataFrame([([1.0, 2.0], [3.0], 0.0, 0.0, 2.0, "a", "k", False)], "embedding array<double>, context array<double>, x double, y double, scale double, area string, component string, virtual boolean").select(F.struct("*").alias("a"))
    two = spark.createDataFrame([([4.0, 0.0], [1.0], 3.0, 4.0, 2.0, "a", "j", True)], "embedding array<double>, context array<double>, x double, y double, scale double, area string, component string, virtual boolean").select(F.struct("*").alias("b"))
    both = one.crossJoin(two)
    f = both.select(L.pair_features("a", "b").alias("f")).first().f
    assert f == [5, 2, 3, 2, 4, 0, 4, 2, 3, 2.5, 1.5, 2.0, 1, 0, 0, 1, 3.5]
    assert both.select(L.transition_features("a", "b").alias("f")).first().f == [1, 2, 4, 0, 3, 2, 4, 0, 3, 1]
    assert both.select(L.aligned(F.col("a.embedding"), ["p", "q"], ["q", "z", "p"]).alias("f")).first().f == [2, 0, 1]
    w = {"h.0.weight": np.array([[1.0], [-1.0]]), "h.0.bias": np.array([0.5]), "h.mean": np.array([1.0, 1.0]), "h.std": np.array([2.0, 0.0])}
    scored = L.head_scores(both.select(F.col("a.embedding").alias("e")), "e", w, "h", "s").first().s
    assert scored == pytest.approx(1 / (1 + np.exp(-(0 - 1e6 + 0.5)))) or scored == 0
    words = spark.createDataFrame([("a",), ("z",), (None,)], "w string").select(L.numbered_words(F.col("w"), ["b", "a"]).alias("n"))
    assert [r.n for r in words.collect()] == [2, 0, 0]


def test_node_groups(spark):
    nodes = spark.createDataFrame([("f", 1, 10, "skeleton"), ("f", 1, 11, "portal"), ("f", None, 12, "skeleton"), ("f", 2, 13, "target"), ("f", 2, 14, "skeleton")], "floor string, component int, node long, kind string")
    edges = spark.createDataFrame([("f", 10, 11), ("f", 12, 13)], "floor string, a long, b long")
    assert sorted(r.node for r in L.node_groups(nodes, edges).collect()) == [10, 11]


def test_faces_of_crossing_lines():
    cross = np.array([[0, 0, 4, 0], [4, 0, 4, 3], [4, 3, 0, 3], [0, 3, 0, 0], [2, -1, 2, 5], [-1, 1, 3, 1], [9, 9, 9, 9]], float)
    areas = sorted(round(P.signed_area(f), 6) for f in W.faces(cross))
    assert areas == [2.0, 4.0, 6.0] and W.faces(np.zeros((0, 4))) == []


def seg(k, ax, ay, bx, by):
    return ("f", k, float(ax), float(ay), float(bx), float(by), float(np.degrees(np.arctan2(by - ay, bx - ax)) % 180))


SEGMENT = "floor string, seg_id long, ax double, ay double, bx double, by double, angle double"


def test_hatches_are_no_walls(spark):
    hatch = [seg(k, 0, k, 20, k) for k in range(6)]
    wall = [seg(10, 40, 0, 40, 30), seg(11, 40.6, 0, 40.6, 30), seg(12, 60, 0, 90, 0), seg(13, 60, 0.5, 90, 0.5)]
    s = spark.createDataFrame(hatch + wall, SEGMENT)
    pairs = W.pair_bands(W.parallel_pairs(s), s)
    band = {(r.left_id, r.right_id): r for r in pairs.collect()}
    assert band[10, 11].width == pytest.approx(0.6) and band[10, 11].along_to - band[10, 11].along_from == pytest.approx(30)
    assert abs(P.signed_area(np.array(band[10, 11].ring).reshape(-1, 2))) == pytest.approx(18)
    arrays = {(r.left_id, r.right_id) for r in W.periodic_pairs(pairs.where("ring is not null"), s).collect()}
    assert arrays == {(k, k + 1) for k in range(5)}
    found = W.wall_obstacles(s).collect()
    assert {(r.left_id, r.right_id) for r in found} >= {(10, 11), (12, 13)} and not {(r.left_id, r.right_id) for r in found} & arrays


def test_walls_are_matched_without_a_row_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(11)
    lines = [(0.0, 0.02 * k, 1.0, 0.02 * k) for k in range(8)] + [(2.0, 0.1, 3.0, 0.1), (2.0, 0.25, 3.0, 0.25)] * 2 + [(5.0, 5.0, 5.0, 5.0)]
    lines += [(x, y, x + c * r, y + s * r) for x, y, r, t in zip(rng.random(160), rng.random(160), rng.random(160), rng.integers(0, 40, 160) * np.pi / 40, strict=True) for c, s in [(np.cos(t), np.sin(t))]]
    segments = spark.createDataFrame([seg(k, *map(float, x)) for k, x in enumerate(lines)], SEGMENT)
    some = segments.where("ax <> bx or ay <> by")
    pairs = W.pair_bands(W.parallel_pairs(some), some).where("ring is not null").localCheckpoint()
    arrays = W.periodic_pairs(pairs, some)
    alone = pairs.join(arrays, ["floor", "left_id", "right_id"], "left_anti").select("floor", "left_id", "right_id", *[F.round(c, 9).alias(c) for c in ("turned", "common", "apart")])
    wanted = {(r.left_id, r.right_id) for r in greedy_matching(alone, "floor").collect()}
    assert arrays.count() >= 7 and pairs.count() > len(lines) and len(wanted) > 20
    for held in (None, 50, 3):  # few pairs at a time give the same
        got = W.matched_pairs(segments, held=held).collect()
        assert {(r.left_id, r.right_id) for r in got} == wanted and len(got) == len(wanted)
    rows = []
    monkeypatch.setattr(W, "written", lambda df, tag, write=W.written: (rows.append((out := write(df, tag)).count()), out)[1])
    W.wall_obstacles(segments).collect()
    assert max(rows) <= len(lines) // 2


def test_a_turned_line_continues_an_array_far_from_its_middle(spark):
    turn = lambda u, v, at=np.radians(47): (u * np.cos(at) - v * np.sin(at), u * np.sin(at) + v * np.cos(at))
    c, s = 10 * np.cos(np.radians(6)), 10 * np.sin(np.radians(6))
    lines = [(0, 0, 0.4, 0), (0, 0.1, 0.4, 0.1), (0.4 - 2 * c, 0.2 - s, 0.4, 0.2 + s)]  # the third's middle lies two widths up
    rows = spark.createDataFrame([seg(k, *turn(*x[:2]), *turn(*x[2:])) for k, x in enumerate(lines)], SEGMENT)
    pairs = W.pair_bands(spark.createDataFrame([("f", 0, 1)], "floor string, left_id long, right_id long"), rows)
    assert [(r.left_id, r.right_id) for r in W.periodic_pairs(pairs, rows, 3, 0.25, 0.3).collect()] == [(0, 1)]


def test_tails_need_evidence(spark):
    pair = [("f", 1, 0.0, 0.0, 13.0, 0.0, 0.0, 10.0, 0.0, 2.0, 0.0, 13.0)]
    p = spark.createDataFrame(pair, "scope string, pair long, ax double, ay double, bx double, by double, along_from double, along_to double, across_from double, across_to double, low double, high double")
    got = lambda lines: [(r.side, r.evidence) for r in W.tails(p, spark.createDataFrame(lines, "scope string, ax double, ay double, bx double, by double")).collect()]
    assert got([("f", 13.0, 0.0, 13.0, 2.0)]) == [("behind", "end_cap")]
    assert got([("f", 11.0, 0.0, 11.0, 2.0), ("f", 12.0, -1.0, 12.0, 3.0)]) == [("behind", "perpendicular_bundle")]
    assert got([("f", 11.0, 0.0, 11.0, 2.0), ("f", 12.4, 0.0, 20.0, 0.1)]) == []


def test_rows_of_odd_cells(spark):
    cells = ["null", None, "", '{"lines": [[[1, 2], [1, "x"], [3]]]}', '{"lines": [[[0, 0], [1, 1]], [[5, 5]]], "polygons": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}']
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(R.geometry(F.col("c")).alias("g"))
    assert [(len(r.g.lines), len(r.g.polygons)) for r in df.collect()] == [(0, 0)] * 4 + [(1, 1)]


def test_closures_and_reports(spark, tmp_path):
    rows = [("F1", a, b, float(abs(a - b))) for a in (3, 5, 9) for b in (3, 5, 9)] + [("F2__B01", 7, 7, 0.0), ("F2__B01", 7, 8, 2.5)]
    folder = f"file://{tmp_path}/closure"
    manifest = artifacts.write_closures(spark.createDataFrame(rows, "scope string, src long, dst long, distance double"), folder)
    assert {r.scope: r.targets for r in manifest.collect()} == {"F1": 3, "F2__B01": 2}
    c = artifacts.Closures(spark, folder)
    assert c.distance("F1", 3, 9) == 6 and c.distance("F2__B01", 8, 7) == float("inf") and c.distance("F1", 3, 4) == float("inf") and c.distance("F2__B01", 7, 8) == 2.5
    with pytest.raises(KeyError):
        c.distance("F9", 1, 2)
    table = spark.createDataFrame([("a|b", 1.5, None)], "name string, x double, y string")
    artifacts.write_report([("Targets", table)], "Run", f"file://{tmp_path}/out/report.md")
    assert "| a\\|b | 1.5 |  |" in (tmp_path / "out/report.md").read_text()
    with pytest.raises(ValueError, match="rows at most"):
        artifacts.markdown_table(spark.range(5), "Many", 3)
    artifacts.write_csv_with_mark(table, f"{tmp_path}/marked")
    part = next((tmp_path / "marked").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfname,x,y")


def test_decisions_are_cached_by_key(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "term string, role string, class string"
    done = spark.createDataFrame([("泵", "inspection_object", "消防水泵"), ("注", "IGNORE", None)], schema)
    artifacts.write_decisions(done, ["term"], path)
    items = spark.createDataFrame([("泵",), ("井",)], "term string")
    known, missing = artifacts.cached_decisions(spark, items, ["term"], path, "role string, class string")
    assert [(r.term, r["class"]) for r in known.collect()] == [("泵", "消防水泵")] and [r.term for r in missing.collect()] == ["井"]
    samples = artifacts.training_samples(done, "term", "role")
    assert sorted((r.text, r.label) for r in samples.collect()) == [("注", 0), ("泵", 1)]


def test_loaders(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"properties": {"portal_id": "p1", "floor_id": "F1", "status": "accepted_for_segmentation", "confidence": 0.9, "width": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [2, 0]]}}\n{"properties": {"portal_id": "p2", "status": "rejected"}}\n')
    assert [(r.portal_id, r.line) for r in artifacts.accepted_portals(spark, str(tmp_path / "p.json")).collect()] == [("p1", [0.0, 0.0, 2.0, 0.0])]
    (tmp_path / "g.json").write_text('{"nodes": [{"floor_id": "F1", "node_id": "a", "kind": "skeleton", "x": 0, "y": 0}],\n "edges": [{"edge_id": "e", "node_a": "a", "node_b": "b", "geometry": {"coordinates": [[0, 0], [3, 4], [3, 5]]}}, {"edge_id": "f", "length": 2}]}')
    nodes, edges = artifacts.graph_tables(spark, str(tmp_path / "g.json"))
    assert nodes.first().node_id == "a" and {r.edge_id: r.length for r in edges.collect()} == {"e": 6.0, "f": 2.0}


def test_streams_drop_late_rows_and_keep_state(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, user_id long"
    path = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(r, "ts string, event_type string, value double, user_id long").select(F.to_timestamp("ts").alias("ts"), "event_type", "value", "user_id").coalesce(1).write.mode("append").parquet(str(path))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        return q

    rows(("2024-01-05 10:00:00", "a", 1.0, 1), ("2024-01-05 11:00:00", "b", 2.0, 1))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    late = run(visits.sliding_counts(source().select("ts", "event_type", "value")), "late", "append")
    state = run(visits.running_visits(source().select("ts", "user_id", "event_type")), "state", "update")
    rows(("2024-01-20 10:00:00", "a", 4.0, 1))
    late.processAllAvailable(), state.processAllAvailable()
    rows(("2024-01-05 12:00:00", "a", 8.0, 2), ("2024-01-20 11:00:00", "a", 1.0, 3))
    late.processAllAvailable(), state.processAllAvailable()
    late.stop(), state.stop()
    closed = {(r.start // 86400, r.event_type): r.value for r in spark.sql("SELECT * FROM late").collect()}
    assert set(closed.values()) == {1.0, 2.0} and len(closed) == 4  # the late row of user 2 counts nowhere
    said = [(r.user_id, r.visits, r.last_type, r.repeated) for r in spark.sql("SELECT * FROM state").collect()]
    assert (1, 2, "b", 0) in said and (3, 1, "a", 0) in said and all(u != 2 for u, *_ in said)


def test_stages_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    data = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = stages.run_stage(spark, "s", make, [data], str(tmp_path), width=1)
    again = stages.run_stage(spark, "s", make, [data.orderBy("v", ascending=False)], str(tmp_path), width=1)
    other = stages.run_stage(spark, "s", make, [data], str(tmp_path), width=2)
    more = stages.run_stage(spark, "s", make, [data.union(data.limit(1))], str(tmp_path), width=1)
    assert [x.reused for x in (first, again, other, more)] == [False, True, False, False] and len(made) == 3
    assert again.read(spark).count() == 3 and shared.content_key("a", 1) != shared.content_key("a", 2)


def test_a_run_of_all_stages(spark, tmp_path):
    from gridloom.plans import overlay_queries as Q
    from gridloom.plans.join_queries import segments
    from gridloom.sources import drawing
    from gridloom.sources import tables as T

    d = "/root/testdata/sf0.001"
    targets = T.targets(spark, d)
    e = drawing.entities(spark, d)
    aliases = spark.createDataFrame([("安全出口", "楼梯"), ("配电房", "配电")], "class string, alias string")
    decisions = stages.objects(e, aliases, [])
    rows = decisions.collect()
    assert sum(r["count"] for r in rows) == e.count()
    assert all(r["class"] != "IGNORE" for r in rows if r.role == "inspection_object") and {r.stage for r in rows} >= {"upper_floor_alias_rule", "short_word_rule", "empty_term", "undecided"}
    assert stages.object_catalog(decisions).count() == len({r["class"] for r in rows if r.role == "inspection_object"})
    free = Q.free(spark, d).select("scope", "rings").where("scope in ('F0', 'F1')")
    assert stages.navigation(free, 0.5).count() > 0 and stages.obstacles(segments(spark, d)).count() > 0
    assert targets.count() > 0


def test_a_second_run_makes_nothing(spark, tmp_path):
    from gridloom.plans import overlay_queries as Q
    from gridloom.plans import planning_queries as Y
    from gridloom.plans.join_queries import segments
    from gridloom.sources import drawing

    d = "/root/testdata/sf0.001"
    few = Y.scoped(spark, d).where("target < 60")
    required = few.where("target % 20 = 0").select("scope", F.lit("all").alias("name"), F.lit("mandatory_all").alias("kind"), F.lit("").alias("category"), "target", F.lit(0).alias("quota"), F.lit(1).alias("each"))
    tables = {
        "entities": drawing.entities(spark, d).where("object_id % 50 = 0"), "aliases": spark.createDataFrame([("安全出口", "楼梯")], "class string, alias string"), "segments": segments(spark, d),
        "domains": Q.domains(spark, d), "solids": Q.ringed(Q.obstacles(spark, d)), "targets": few, "requirements": required, "ways": Y.ways(spark, d).where("src < 60 and dst < 60"),
    }
    first, second = (stages.run(spark, tables, f"{tmp_path}/run", 1.0, 0.5) for _ in range(2))
    assert [*first] == ["inventory", "objects", "obstacles", "free", "navigation", "plan"] and not any(r.reused for r in first.values())
    assert all(r.reused for r in second.values()) and all(r.read(spark).count() for r in second.values())
    changed = stages.run(spark, tables | {"solids": tables["solids"].where("scope <> 'F0'")}, f"{tmp_path}/run", 1.0, 0.5)
    assert [n for n, r in changed.items() if not r.reused] == ["free", "navigation"]


def test_refinement_only_joins(spark):
    table = lambda parts: spark.createDataFrame([("s", k, p) for k, p in enumerate(parts)], "scope string, target int, component int")
    r = stages.refinement(table([1, 1, 2, 3]), table([1, 1, 1, 3])).first()
    assert (r.before, r.after) == (pytest.approx(1 / 6), 0.5)
    with pytest.raises(Exception, match="refinement parted"):
        stages.refinement(table([1, 1]), table([1, 2])).collect()


def test_registered_functions(spark):
    assert "edit_similarity" in stages.register_functions(spark)
    r = spark.sql("SELECT box_area(0, 0, 2, 3) AS a, box_common(0, 0, 2, 2, 1, 1, 3, 3) AS c, point_distance(5, 0, 0, 0, 2, 4) AS d, edit_similarity('abcd', 'abxd') AS s, physical_floor('F3__B01') AS f, jaro_winkler('martha', 'marhta') AS j").first()
    assert (r.a, r.c, r.d, r.s, r.f) == (6, 1, 3, 0.75, "F3") and r.j == pytest.approx(0.9611, abs=1e-4)


def test_shared_folders(spark):
    df = shared.written(spark.range(4), "numbers")
    path = df.inputFiles()[0]
    assert df.count() == 4
    shared.release(spark)
    from pathlib import Path

    assert not Path(path.removeprefix("file://")).exists()


def test_features_of_files(spark, tmp_path):
    import json

    square, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]
    feature = lambda props, kind, c: {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": c}}
    rows = [feature({"floor_id": "F1", "obstacle_type": "wall"}, "Polygon", [square, hole]), feature({"floor_id": "F1", "obstacle_type": "Column"}, "Polygon", [square]), feature({"floor_id": "F2", "obstacle_type": "filled_obstacle"}, "MultiPolygon", [[square], [hole]]), feature({"floor_id": "F2", "obstacle_type": "wall"}, "Point", [1, 2])]
    (tmp_path / "o.json").write_text(json.dumps({"type": "FeatureCollection", "features": rows}, indent=1))
    counts, rings = artifacts.obstacle_details(spark, str(tmp_path / "o.json"))
    assert {r.scope: (r.source, r.excluded, r.rendered) for r in counts.collect()} == {"F1": (2, 1, 1), "F2": (2, 0, 2)}
    assert sorted((r.scope, len(r.ring)) for r in rings.collect()) == [("F1", 8), ("F1", 10), ("F2", 8), ("F2", 10)]
    for bad in ({"obstacle_type": "wall"}, {"floor_id": "F1"}):
        (tmp_path / "bad.json").write_text(json.dumps({"features": [feature(bad, "Polygon", [square])]}))
        with pytest.raises(Exception, match="an obstacle without"):
            artifacts.obstacle_details(spark, str(tmp_path / "bad.json"))[0].collect()
    parts = spark.createDataFrame([("F1", [[0.0, 0.0, 4.0, 0.0, 4.0, 4.0], [1.0, 1.0, 2.0, 1.0, 2.0, 2.0]])], "scope string, rings array<array<double>>")
    artifacts.write_geojson(artifacts.polygon_features(parts, ["scope"]), str(tmp_path / "p"))
    back = artifacts.read_features(spark, str(tmp_path / "p")).first()
    assert json.loads(back.properties) == {"scope": "F1"} and back.rings[0] == [0, 0, 4, 0, 4, 4, 0, 0] and len(back.rings) == 2


def test_routes_keep_to_gaps_of_the_scale(spark):
    from gridloom.operators import optimizer as O

    t = spark.createDataFrame([(0, k, 0.0, 10.0) for k in range(3)], "floor int, target long, value double, scale double")
    d = spark.createDataFrame([(0, a, b, float(abs(x - y))) for a, x in enumerate((0, 5, 14)) for b, y in enumerate((0, 5, 14)) if a != b], "floor int, src long, dst long, distance double")
    r = spark.createDataFrame([(0, "all", "mandatory_all", "", [0, 1, 2], 0, 1)], "floor int, name string, kind string, category string, items array<long>, count int, each int")
    assert [x.target for x in O.optimised_routes(t, r, d, gap_ratios=(0.2, 0.95)).orderBy("place").collect()] in ([0, 1, 2], [2, 1, 0])
    assert O.optimised_routes(t, r, d, gap_ratios=(0.2, 0.8)).first().status == "infeasible"


def test_a_face_in_one_convex_core_needs_no_overlay(spark, monkeypatch):
    corner = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [1.0, 1.0], [1.0, 4.0], [0.0, 4.0]])
    assert W.is_convex(P.box_ring(0, 0, 4, 4)) and not W.is_convex(corner)
    cores = np.array([P.box_ring(0, 0, 4, 4), P.box_ring(2, 2, 6, 6)])
    assert W.in_one(cores, P.box_ring(3, 3, 6, 6)) and W.in_one(cores, corner) and not W.in_one(cores, P.box_ring(1, 1, 5, 5)) and not W.in_one(cores[:0], corner)
    boxes = [P.box_ring(x, y, x + 4, y + 4) for x, y in ((0, 0), (2, 2), (10, 0))]
    lines = spark.createDataFrame([("f", *map(float, e)) for e in P.segments([*boxes, P.box_ring(20, 0, 21, 1)])], "scope string, ax double, ay double, bx double, by double")
    cores = spark.createDataFrame([("f", r.ravel().tolist()) for r in [*boxes[:2], corner + [10, 0]]], "scope string, ring array<double>")
    got = W.wall_faces(lines, cores, 0.4).collect()
    assert sorted((r.area, round(r.share, 9)) for r in got) == [(4.0, 1.0), (12.0, 1.0), (12.0, 1.0), (16.0, 0.4375)]


def test_faces_of_many_crossing_lines():
    import time

    k, began = np.arange(200.0), time.process_time()
    level = np.stack([np.zeros(200), k, np.full(200, 199.0), k], 1)
    p, starts = W.face_rings(np.vstack([level, level[:, [1, 0, 3, 2]]]))
    assert len(starts) == 199 * 199 + 1 and (np.diff(starts) == 4).all() and p.shape == (199 * 199 * 4, 2)
    assert all(P.signed_area(p[a : a + 4]) == pytest.approx(1.0) for a in starts[:-1:1000])
    assert time.process_time() - began < 5


def test_periodic_arrays_make_no_rows_of_pairs(spark):
    from gridloom.operators import spatial
    from gridloom.plans import catalog
    from gridloom.plans.join_queries import segments

    small = "/root/testdata/sf0.001"
    s = segments(spark, small)
    pairs = W.pair_bands(spatial.parallel_pairs(s), s)
    expected = {tuple(r) for r in W.periodic_pairs(pairs, s, 3, 0.25, 0.3).collect()}
    assert {tuple(r) for r in W.periodic_arrays(s, 3, 0.25, 0.3, most=500).collect()} == expected and len(expected) > 20
    plan = catalog.QUERIES["periodic_arrays"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "left_id" in plan and "along_from" not in plan  # bands of pairs are no columns of a join
