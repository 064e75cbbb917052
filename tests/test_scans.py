"""Segmented scans over trajectories against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import trajectory as J


def plain(times, step=0.001, before=float("-inf")):
    out = []
    for t in times:
        before = t if t > before else before + step
        out.append(before)
    return out


def test_a_fold_is_what_its_times_do():
    rng = random.Random(1)
    for _ in range(3000):
        times = sorted(rng.choice([0, 1, 1.5, 2, 2.5, 3, 7]) + rng.choice([0, 0.25]) for _ in range(rng.randrange(1, 12)))
        fold = J.Fold(0.5)
        for t in times:
            fold.add(t)
        for x in [-5.0, *(times[0] + k * 0.25 for k in range(-6, 20))]:
            assert fold(x) == plain(times, 0.5, x)[-1], (times, x)


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_one_long_trajectory_in_many_tasks(spark, partitions):
    rng = random.Random(2)
    rows = [("long", i, float(rng.randrange(40)) + rng.choice([0, 0.0005, 0.001])) for i in range(600)] + [("b", i, 3.0) for i in range(5)] + [("c", 9, 1.0)]
    frame = spark.createDataFrame(rows, "traj_id string, seq long, t double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.traj_id, r.seq): r.t_adjusted for r in J.increasing_times(frame).collect()}
        if partitions == "40":
            assert J.in_ranges(frame).where("traj_id = 'long'").select("range").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {}
    for name in ("long", "b", "c"):
        own = sorted((t, s) for n, s, t in rows if n == name)
        want |= {(name, s): x for (_, s), x in zip(own, plain([t for t, _ in own]), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_matching_passes_times_on_and_reads_its_rows_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    rows = spark.createDataFrame([("a", i, float(i), i + 0.5, 0.001 * i, 0.0) for i in range(20)], "traj_id string, seq long, t double, t_adjusted double, lon double, lat double")
    nodes = spark.createDataFrame([(i, 0.001 * i, 0.0) for i in range(20)], "node_id long, x double, y double")
    got = J.matched(rows.mapInPandas(counted, rows.schema), nodes).orderBy("seq").collect()
    assert [(r.t, r.node_id) for r in got] == [(float(i), i) for i in range(20)]
    assert calls.value == 20


def test_all_observations_of_a_trajectory_are_read(spark):
    rows = spark.range(16_000).select(F.lit("Point").alias("geom_type"), F.lit("a").alias("traj"), F.col("id").alias("seq"), F.create_map(F.lit("when"), (20_000 - F.col("id")).cast("string")).alias("properties"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"))
    found = J.observations(rows, "when", "traj")
    assert found.count() == 16_000 and found.select("seq").distinct().count() == 16_000
