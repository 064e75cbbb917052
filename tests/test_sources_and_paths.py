import json
import math
import random

import numpy as np
import pytest

from waymark.functions import values as V
from waymark.operators import network, selection, trajectory
from waymark.sources import features as S


def parsed(spark, *docs):
    return S.parse_documents(spark.createDataFrame([(json.dumps(d),) for d in docs], "value string"))


def test_kinds_of_documents(spark):
    line = {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}
    rows = parsed(spark, line).collect()
    assert (rows[0].id, rows[0].geom_type, rows[0].lon, rows[0].lat) == ("0", "LineString", 0.0, 0.0)
    row = parsed(spark, {"type": "Feature", "id": 7, "geometry": line, "properties": {"LAT": "3.5", "lng": 4}}).first()
    assert (row.id, row.lon, row.lat, row.properties["lng"]) == ("7", 4.0, 3.5, "4")
    polygon = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    row = parsed(spark, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": None}, {"type": "Feature", "geometry": polygon}]}).orderBy("seq").collect()
    assert row[0].geom_type is None and row[1].lon is None and len(row[1].parts[0]) == 4
    esri = {"features": [{"attributes": {"FID": 3}, "geometry": {"x": 1, "y": 2}}, {"attributes": {}, "geometry": None}, {"attributes": {}, "geometry": {"paths": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}}]}
    assert [(r.id, r.geom_type) for r in parsed(spark, esri).orderBy("seq").collect()] == [("3", "Point"), ("2", "MultiLineString")]
    with pytest.raises(Exception, match="neither"):
        parsed(spark, {"a": 1}).collect()


def test_file_import_and_export(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": 'q"1', "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 'a"b'}}]}))
    table = S.read_features(spark, str(path))
    out = json.loads(S.geojson(table).first().feature)
    assert out["id"] == 'q"1' and out["geometry"]["coordinates"] == [1, 2] and out["properties"]["n"] == 'a"b'
    S.write_geojson(S.export_selected(table, spark.createDataFrame([('q"1',)], "id string")), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["properties"]["geom_type"] == "Point"
    with pytest.raises(ValueError):
        S.read_features(spark, "a.csv")


def test_index_cases(spark):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    table = parsed(spark, {"type": "FeatureCollection", "features": [{"id": 1, "geometry": {"type": "Point", "coordinates": [0, 0]}}, {"id": 2, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"id": 3, "geometry": square}]})
    assert [r.id for r in selection.in_box(table, -1, -1, 2, 2, "polyline").collect()] == ["2"]
    assert [r.id for r in selection.in_circle(table, 0, 0, 0.5, "point").collect()] == ["1"]
    assert selection.boxes_of([[1, 2, 3], "x", None, [1, 2, 3, 4]]) == [(1.0, 2.0, 3.0, 4.0)]


def test_literals_and_wildcards():
    assert [V.sql_literal(x) for x in ("5", "5.", ".5", "1e5", "'a'", "None", "TRUE", "x")] == [5, "5.", 0.5, "1e5", "a", None, True, "x"]
    assert V.selection_literal("5.") == 5.0 and V.selection_literal("1-2") == "1-2"
    assert V.split_outside("1, 'a,b', f(2, 3)") == ["1", "'a,b'", "f(2, 3)"]
    import re

    for pattern, text, hit in (("a*c", "abbc", True), ("a%", "a\nb", True), ("a_c", "ac", False), ("a\\*c", "a*c", True), ("a\\*c", "abc", False), ("a.c", "abc", False)):
        assert bool(re.search(V.wildcard(pattern).replace(r"\z", r"\Z"), text)) == hit
    assert V.parse_point({"lng": "1", "latitude": 2}) == (1.0, 2.0) and V.parse_point("x") is None


def test_paths_against_brute_force():
    rnd = random.Random(1)
    for _ in range(40):
        n = 7
        links = [(a, b, rnd.randint(1, 9)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        g = network.Graph(iter(links))

        def walks(way, cost, g=g):
            if way[-1] == n - 1:
                yield cost, way
                return
            for v, w in g.out.get(way[-1], []):
                if v not in way:
                    yield from walks([*way, v], cost + w)

        want = sorted(walks([0], 0))[:2]
        got = g.paths(0, n - 1, 3)
        assert [c for c, _ in got] == [c for c, _ in want]
        for cost, way in got:
            assert cost == sum(g.weight[a, b] for a, b in zip(way, way[1:], strict=False))


def test_star_equals_dijkstra():
    places = {i: (0.001 * (i % 5), 0.001 * (i // 5)) for i in range(25)}
    g0 = network.Graph(iter([]), places)
    links = [(a, b, g0._left(a, b)) for a in range(25) for b in (a + 1, a + 5) if b < 25 and (b != a + 1 or b % 5)]
    g = network.Graph(iter(links), places)
    assert math.isclose(g.path(0, 24)[0], g.path(0, 24, True)[0], rel_tol=1e-9)


def test_viterbi_against_all_ways():
    rng = np.random.default_rng(2)
    for _ in range(20):
        emit, xs, ys, ox, oy = rng.random((5, 2)), rng.random((5, 2)) * 9, rng.random((5, 2)) * 9, rng.random(5) * 9, rng.random(5) * 9
        way, cost = trajectory.viterbi(emit, xs, ys, ox, oy, 1.5)
        best = math.inf
        for code in range(32):
            k = [code >> i & 1 for i in range(5)]
            total = emit[0][k[0]]
            for i in range(1, 5):
                jump = math.hypot(xs[i][k[i]] - xs[i - 1][k[i - 1]], ys[i][k[i]] - ys[i - 1][k[i - 1]]) - math.hypot(ox[i] - ox[i - 1], oy[i] - oy[i - 1])
                total += jump * jump / (2 * 1.5 * 1.5) + emit[i][k[i]]
            best = min(best, total)
        assert math.isclose(cost, best)


def test_kalman_against_matrices():
    rng = np.random.default_rng(3)
    t, x, y = np.cumsum(rng.random(30)), np.cumsum(rng.normal(5, 2, 30)), np.cumsum(rng.normal(-3, 2, 30))
    state = np.array([x[0], y[0], *(np.array([x[1] - x[0], y[1] - y[0]]) / (t[1] - t[0]))])
    p, h = np.diag([10.0, 10, 100, 100]), np.eye(2, 4)
    want = [np.hypot(*state[2:])]
    for i in range(1, 30):
        dt = t[i] - t[i - 1]
        f = np.eye(4)
        f[0, 2] = f[1, 3] = dt
        g = np.array([[dt * dt / 2, 0], [0, dt * dt / 2], [dt, 0], [0, dt]])
        state, p = f @ state, f @ p @ f.T + 4 * g @ g.T
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 64 * np.eye(2))
        state, p = state + k @ (np.array([x[i], y[i]]) - h @ state), p - k @ h @ p
        want.append(np.hypot(*state[2:]))
    speed, heading = trajectory.kalman(t, x, y)
    assert np.allclose(speed, want)
    assert ((heading >= 0) & (heading < 360)).all()


@pytest.mark.parametrize("by_cells", [False, True])
def test_distances_over_parts(spark, by_cells):
    rng = random.Random(6)
    links = [(a, b, float(rng.randint(1, 9))) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.05]
    places = spark.createDataFrame([(i, (i * 7 % 10) / 10, (i % 6) / 10) for i in range(60)], "node_id long, x double, y double")
    frame, starts = spark.createDataFrame(links, "u long, v long, w double"), [0, 7, 31]
    found = network.shortest_distances(frame, spark.createDataFrame([(s,) for s in starts], "start long"), 9, places if by_cells else None, 0.25)
    got = {(r.start, r.node): r.distance for r in found.collect()}
    graph = network.Graph(iter(links))
    want = {(s, n): graph.path(s, n)[0] for s in starts for n in graph.out if graph.path(s, n)}
    assert got == want


def test_steps_over_parts_follow_the_logarithm_of_their_number(spark, monkeypatch):
    """A long path of many parts: levels, not a round for each part."""
    links = [(i, i + 1, 1.0) for i in range(1200)] + [(i, i + 2, 1.5) for i in range(0, 1198, 3)]
    labels, plain = [], network.kept
    monkeypatch.setattr(network, "kept", lambda df, label: labels.append(label) or plain(df, label))
    found = network.shortest_distances(spark.createDataFrame(links, "u long, v long, w double"), spark.createDataFrame([(0,), (600,)], "start long"), 20)
    got = {(r.start, r.node): r.distance for r in found.collect()}
    assert len(labels) < 30
    graph = network.Graph(iter(links))
    assert len(got) == 2 * 1201
    for s in (0, 600):
        for n in range(0, 1201, 40):
            assert got[s, n] == graph.path(s, n)[0]
    asked = spark.createDataFrame([(7, 0, 5), (8, 600, 1200), (9, 0, 5000)], "request_id long, start long, goal long")
    lengths = {r.request_id: r.distance for r in network.path_lengths(spark.createDataFrame(links, "u long, v long, w double"), asked).collect()}
    assert lengths == {7: got[0, 5], 8: got[600, 1200]}


@pytest.mark.parametrize("star", [False, True])
def test_paths_hold_what_is_near_alone(spark, monkeypatch, star):
    """Requests on a long strip against the whole graph; a dead end, whose second path is a long way round; no way at all."""
    rng = random.Random(4)
    spots = {i: (0.001 * (i % 4), 0.001 * (i // 4)) for i in range(160)}
    plain = network.Graph(iter([]), spots)
    links = [(a, b, plain._left(a, b) * rng.choice([1.0, 1.0, 1.5])) for a in range(160) for b in (a + 1, a + 4) if b < 160 and (b != a + 1 or b % 4)]
    links += [(200, 201, 1.0), (201, 202, 1.0), (200, 203, 50.0), (203, 202, 50.0), (300, 301, 1.0)]
    spots |= {n: (1.0, 1.0) for n in (200, 201, 202, 203, 300, 301)}
    asked = [(1, 0, 6), (2, 0, 9), (3, 5, 5), (4, 200, 202), (5, 300, 301), (6, 300, 0), (7, 0, 159)]
    held, plain_kept = [], network.kept

    def counted(df, label):
        out = plain_kept(df, label)
        if label == "near":
            held.append({r.request_id: r["count"] for r in out.groupBy("request_id").count().collect()})
        return out

    monkeypatch.setattr(network, "kept", counted)
    places = spark.createDataFrame([(n, *p) for n, p in spots.items()], "node_id long, x double, y double")
    frame, ask = spark.createDataFrame(links, "u long, v long, w double"), spark.createDataFrame(asked, "request_id long, start long, goal long")
    found = network.shortest_paths(frame, ask, 2, "astar" if star else "dijkstra", places).collect()
    got = sorted((r.request_id, r["rank"], round(r.distance, 9), tuple(r.nodes)) for r in found)
    whole = network.Graph(iter(links), spots)
    assert held[0][1] < 20 and held[0][4] < 5
    assert got == sorted((r, i + 1, round(d, 9), tuple(way)) for r, s, g in asked for i, (d, way) in enumerate(whole.paths(s, g, 2, star)))
    once = sorted((r.request_id, r["rank"], tuple(r.nodes)) for r in network.shortest_paths(frame, ask, 1).collect())
    assert once == sorted((r, 1, tuple(whole.path(s, g)[1])) for r, s, g in asked if r != 6)
