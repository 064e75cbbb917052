"""Work that is done once for equal rows, and by all cores where the bytes are few."""

from pyspark.sql import functions as F

from waymark import queries
from waymark.functions import geometry
from waymark.operators import gridjoin as G
from waymark.operators import topology as T

DATA = "/root/testdata/sf0.001"


def test_copied_lines_are_held_against_nodes_once(spark, monkeypatch):
    near, seen = T.near_points, []
    monkeypatch.setattr(T, "near_points", lambda left, *more: (seen.append(left.count()), near(left, *more))[1])
    rows = [(f"{c}{i}", pts) for i in range(5) for c, pts in (("h", [(0.0, 0.01), (0.02, 0.01)]), ("v", [(0.01, 0.0), (0.01, 0.01), (0.01, 0.02)]))]
    cuts = T.nodes_on_lines(T.lines_of(spark, rows), spark.createDataFrame([(10000, 10000), (5000, 10000)], "ix long, iy long")).collect()
    assert seen == [3]
    # on the line of two segments the node is an inner vertex, and cuts at the start of the second
    want = [(f"h{i}", 0, x, 10000) for i in range(5) for x in (5000, 10000)] + [(f"v{i}", 1, 10000, 10000) for i in range(5)]
    assert sorted((r.fid, r.seg, r.ix, r.iy) for r in cuts) == sorted(want)
    assert all(r.t == 0 for r in cuts if r.fid[0] == "v")


def test_cells_are_dealt_to_all_cores(spark):
    rows = spark.range(40).select(F.struct(*[(F.col("id") / 100.0).alias(n) for n in ("minx", "miny", "maxx", "maxy")]).alias("b")).coalesce(1)
    least = 4 * spark.sparkContext.defaultParallelism
    assert all(side.rdd.getNumPartitions() >= least for side in G.dealt(rows, rows, "b", "b", 0.05))


def test_a_box_does_not_parse_lines_again(spark):
    table = queries.line_table(spark, DATA)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole, cut = (plan(T.lines(table, box)).count("from_json") for box in (None, geometry.box(0.01, 0.01, 0.05, 0.05)))
    assert 0 < cut <= whole
    assert table.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_crossings_are_found_once_a_round(spark, monkeypatch):
    looked = spark.sparkContext.accumulator(0)

    def seen(x):
        looked.add(1)
        return x

    found, on_lines, held = T.crossing_nodes, T.nodes_on_lines, []
    monkeypatch.setattr(T, "crossing_nodes", lambda *more: found(*more).withColumn("ix", F.udf(seen, "long")("ix")))
    monkeypatch.setattr(T, "nodes_on_lines", lambda *more: (held.append(1), on_lines(*more))[1])
    layer = T.lines_of(spark, [("h", [(0.0, 0.01), (0.02, 0.01)]), ("v", [(0.01, 0.0), (0.01, 0.02)])])
    assert T.repair_crossings(layer).count() == 4 and looked.value == 1
    # the second round finds no node, and holds none against the lines
    assert T.noded(layer).count() == 4 and looked.value == 2 and len(held) == 2
