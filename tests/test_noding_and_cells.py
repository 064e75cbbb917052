"""Work lists, adaptive cells and descents against plain versions of them."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import gridjoin as G
from waymark.operators import topology as T


def whole_layer_each_round(layer, digits=6):
    """Noding as it is defined: every round looks at the whole layer."""
    for i in range(1, 20):
        cuts = T.kept(T.nodes_on_lines(layer, T.crossings(layer, digits).select("ix", "iy"), digits), "cuts")
        if cuts.isEmpty():
            return layer, i
        layer = T.kept(T.split(layer, cuts, f"__split__it{i}__", digits).drop("new"), "layer")
    raise AssertionError


def pieces(layer):
    return sorted((r.fid, r.part, tuple((p.x, p.y) for p in r.pts)) for r in layer.collect())


def test_work_lists_give_what_whole_rounds_give(spark):
    rng = random.Random(8)
    at = lambda: (rng.randrange(300) / 1e4, rng.randrange(300) / 1e4)
    layer = T.lines_of(spark, [(f"l{i}", [at() for _ in range(rng.randint(2, 3))]) for i in range(14)])
    # a line of two parts: one is cut, and the other passes through an end that the first owned
    more = spark.createDataFrame([("a", 0, [(0.0, 0.05), (0.01, 0.05)]), ("a", 1, [(0.01, 0.04), (0.01, 0.06)]), ("b", 0, [(0.01, 0.05), (0.02, 0.05)]), ("c", 0, [(0.005, 0.04), (0.005, 0.06)])], T.LINE)
    layer = layer.unionByName(more)
    want, rounds = whole_layer_each_round(layer)
    assert rounds > 2
    assert pieces(T.noded(layer)) == pieces(want)


@pytest.mark.parametrize("crowd", [3, 20, 10_000])
def test_crowded_cells_lose_and_repeat_no_pair(spark, crowd):
    rng = random.Random(crowd)
    rows = [(i, *(rng.random() / 50 + (0.5 if i % 10 else 0) for _ in "xy"), rng.choice([0.0, 0.001, 0.01])) for i in range(150)] + [(i, 0.5, 0.5, 0.002) for i in range(150, 165)]
    table = spark.createDataFrame(rows, "k long, x double, y double, s double").select("k", F.struct(F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + F.col("s")).alias("maxx"), (F.col("y") + F.col("s")).alias("maxy")).alias("b"))
    left, right = table.toDF("k1", "b1"), table.toDF("k2", "b2")
    got = sorted(tuple(r) for r in G.box_join(left, right, "b1", "b2", 0.5, F.col("k1") < F.col("k2"), crowd=crowd).select("k1", "k2").collect())
    meet = lambda p, q: p[1] <= q[1] + q[3] and q[1] <= p[1] + p[3] and p[2] <= q[2] + q[3] and q[2] <= p[2] + p[3]
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and meet(p, q))
    if crowd == 20:  # no cell is over the bound on either side
        own, other = G.dealt(left, right, "b1", "b2", 0.5, crowd=crowd)
        for side in (own, other):
            assert side.groupBy("cell").count().agg(F.max("count")).first()[0] <= 2 * crowd  # tiles are dealt by a hash


def test_points_near_boxes_come_once(spark):
    rng = random.Random(3)
    boxes = [(i, rng.random(), rng.random() / 9) for i in range(60)]
    spots = [(i, rng.random() / 9, rng.random() / 9) for i in range(80)]
    left = spark.createDataFrame(boxes, "k long, x double, y double").select("k", F.struct(F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + 0.01).alias("maxx"), (F.col("y") + 0.01).alias("maxy")).alias("b"))
    near = G.near_points(left, spark.createDataFrame(spots, "p long, px double, py double"), "b", "px", "py", 0.3, 0.02, crowd=5)
    found = near.groupBy("k", "p").count().collect()
    assert all(r["count"] == 1 for r in found)
    want = {(k, p) for k, x, y in boxes for p, px, py in spots if x - 0.02 <= px <= x + 0.03 and y - 0.02 <= py <= y + 0.03}
    assert want <= {(r.k, r.p) for r in found}


@pytest.mark.parametrize("k", [1, 3])
def test_descent_is_exact(spark, k):
    rng = random.Random(k)
    # nodes crowded in one corner and on one line, and points far from all of them
    nodes = [(i, rng.random() / 1000, rng.random() / 1000) for i in range(300)] + [(300 + i, 5 + i / 10, 5.0) for i in range(40)]
    points = [(i, rng.uniform(-20, 30), rng.uniform(-20, 30)) for i in range(40)] + [(40, 0.0005, 0.0005)]
    d2 = (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))
    found = G.k_nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(nodes, "node_id long, nx double, ny double"), "x", "y", k, 0.01, d2, degrees=False, metric=F.sqrt(d2))
    got = {}
    for r in found.collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.node_id))
    for p, x, y in points:
        near = sorted(((nx - x) * (nx - x) + (ny - y) * (ny - y), n) for n, nx, ny in nodes)[:k]
        assert [n for _, n in sorted(got[p])] == [n for _, n in near], p


def test_statistics_of_the_check_itself(spark):
    layer = T.lines_of(spark, [("a", [(0, 0), (1, 1), (2, 2)]), ("b", [(0, 2), (2, 0)]), ("c", [(10, 10), (11, 10)])])
    seen = T.Statistics()
    assert T.check(layer, statistics=seen).count() == 7
    assert seen.values() == {"parts": 3, "segments": 4, "pairs": 2}
    row = T.statistics(layer).first()
    assert (row.lines, row.segments, row.pairs, row.issues) == (3, 4, 2, 7)
    assert T.statistics(layer.limit(0)).first().pairs == 0


def test_points_at_one_place_are_searched_once(spark, monkeypatch):
    seen, plain = [], G._descended
    monkeypatch.setattr(G, "_descended", lambda points, *more: seen.append(points.count()) or plain(points, *more))
    points = spark.createDataFrame([(i, 3.0 + i % 2, 4.0) for i in range(300)], "point_id long, x double, y double")
    nodes = spark.createDataFrame([(i, i / 1000, 0.0) for i in range(200)], "node_id long, nx double, ny double")
    d2 = (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))
    found = G.k_nearest(points, nodes, "x", "y", 2, 0.01, d2, degrees=False, metric=F.sqrt(d2)).collect()
    assert seen == [2]
    assert sorted((r.point_id, r["rank"], r.node_id) for r in found) == [(i, k, 200 - k) for i in range(300) for k in (1, 2)]
