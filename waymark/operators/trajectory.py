"""Trajectories: time repair, map matching by a hidden Markov model, and Kalman speeds and headings."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import EARTH_M
from ..functions.values import epoch_seconds
from ..plans.steps import kept
from .gridjoin import k_nearest


def observations(features: DataFrame, time_field: str, traj: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """traj_id, seq, t, lon, lat of all point features whose time can be read; one trajectory, where ``traj`` names none."""
    from .selection import field

    key = F.col(traj) if traj else F.lit("all")
    raw = F.try_element_at("properties", F.lit(time_field)) if "properties" in features.columns else None
    time = F.coalesce(*[c for c in (raw, field(features, time_field)) if c is not None])
    rows = features.where("geom_type = 'Point'").select(key.cast("string").alias("traj_id"), "seq", epoch_seconds(time).alias("t"), "lon", "lat").where("t is not null and lon is not null and lat is not null")
    if box:
        rows = rows.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return rows


class Fold:
    """What a run of times does to the adjusted time before it: a step function, which composes with others.

    Each time t takes the adjusted time x before it to t if that is later, else to x and a step. A run of m times takes x
    to x + m steps, unless one of its times is later than what x has become by then: the first such time starts afresh, and what
    follows from it does not hang on x. ``at`` are the bounds below which x meets such a time (rising), ``to`` what comes out; bounds
    that lead to the same end are one, so that a run of many times is a few numbers.
    """

    def __init__(self, step: float):
        self.step, self.m, self.at, self.to = step, 0, [], []

    def add(self, t: float) -> None:
        bound = t - self.m * self.step  # what x must be below for the time to be later than x and m steps
        self.to = [t if t > y else y + self.step for y in self.to]
        if not self.at or bound > self.at[-1]:
            if self.to and self.to[-1] == t:
                self.at[-1] = bound
            else:
                self.at.append(bound)
                self.to.append(t)
        while len(self.to) > 1 and self.to[-1] == self.to[-2]:
            self.at[-2:], self.to[-2:] = self.at[-1:], self.to[-1:]
        self.m += 1

    def __call__(self, x: float) -> float:
        i = bisect.bisect_right(self.at, x)
        return self.to[i] if i < len(self.at) else x + self.m * self.step


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` by (traj_id, t, seq) in ranges of even size, written with the number of their range: a long trajectory has many."""
    ordered = rows.repartitionByRange("traj_id", "t", "seq").sortWithinPartitions("traj_id", "t", "seq")
    return kept(ordered.withColumn("range", F.spark_partition_id()), "ranges")


def _runs(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows with equal keys; those of one key may come in several frames."""
    for batch in batches:
        columns = [batch[k].to_numpy() for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(batch) else []
        for a, b in zip([0, *edges], [*edges, len(batch)], strict=True):
            if b > a:
                yield tuple(c[a] for c in columns), batch.iloc[a:b]


def increasing_times(rows: DataFrame, step: float = 0.001) -> DataFrame:
    """``rows`` (traj_id, t, seq) with ``t_adjusted``: by (t, seq), each at least ``step`` after the adjusted one before, if not later.

    A fold, not a running maximum: each time is held against the adjusted time before it. It runs as a segmented scan: rows are
    dealt out in ranges by (traj_id, t, seq), each range sums up what it does to a time (``Fold``), the sums of a trajectory are chained, a few numbers a
    range, and then each range is folded from its true start. No task holds a trajectory, however long.
    """
    ranged = in_ranges(rows)
    kind = dict(rows.dtypes)
    streamed = lambda df: df.repartition("range").sortWithinPartitions("range", "traj_id", "t", "seq")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold = None, None
        out = lambda: pd.DataFrame({"range": [key[0]], "traj_id": [key[1]], "m": [fold.m], "at": [fold.at], "to": [fold.to]})
        for now, part in _runs(batches, ("range", "traj_id")):
            if now != key:
                if fold:
                    yield out()
                key, fold = now, Fold(step)
            for t in part["t"].tolist():
                fold.add(t)
        if fold:
            yield out()

    sums = streamed(ranged.select("range", "traj_id", "t", "seq")).mapInPandas(summed, f"range int, traj_id {kind['traj_id']}, m long, at array<double>, to array<double>")
    # x of each range: the sums before it applied one after the other, in SQL over a row a range
    listed = kept(sums, "folds").groupBy("traj_id").agg(F.sort_array(F.collect_list(F.struct("range", "m", "at", "to"))).alias("folds"))
    after = lambda x, f: F.when(
        F.size(F.filter(f["at"], lambda b: b <= x)) < F.size(f["at"]), F.get(f["to"], F.size(F.filter(f["at"], lambda b: b <= x)))
    ).otherwise(x + f["m"] * F.lit(step))
    chain = F.aggregate("folds", F.struct(F.lit(float("-inf")).alias("x"), F.array().cast("array<double>").alias("all")), lambda s, f: F.struct(after(s["x"], f).alias("x"), F.concat(s["all"], F.array(s["x"])).alias("all")))
    starts = listed.select("traj_id", F.explode(F.arrays_zip(F.col("folds.range").alias("range"), chain["all"].alias("x"))).alias("z")).select("traj_id", F.col("z.range").alias("range"), F.col("z.x").alias("before"))

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x = None, 0.0
        for now, part in _runs(batches, ("range", "traj_id")):
            if now != key:
                key, x = now, float(part["before"].iloc[0])
            out = []
            for t in part["t"].tolist():
                x = t if t > x else x + step
                out.append(x)
            yield part.drop(columns=["before", "range"]).assign(t_adjusted=out)

    # a start for each range and trajectory: so many rows as ranges and trajectories
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", t_adjusted double"
    return streamed(ranged.join(starts, ["range", "traj_id"])).select(*rows.columns, "range", "before").mapInPandas(folded, schema)


def viterbi(emit: np.ndarray, xs: np.ndarray, ys: np.ndarray, ox: np.ndarray, oy: np.ndarray, sigma: float) -> tuple[np.ndarray, float]:
    """Cheapest sequence of candidates (n x k costs and places), and its cost; ties go to the lower candidate."""
    n, k = emit.shape
    cost, back = emit[0].copy(), np.zeros((n, k), np.int64)
    for i in range(1, n):
        seen = math.hypot(ox[i] - ox[i - 1], oy[i] - oy[i - 1])
        jump = np.hypot(xs[i][None, :] - xs[i - 1][:, None], ys[i][None, :] - ys[i - 1][:, None]) - seen
        total = cost[:, None] + jump * jump / (2 * sigma * sigma)
        back[i] = total.argmin(0)
        cost = total[back[i], np.arange(k)] + emit[i]
    way = np.zeros(n, np.int64)
    way[-1] = cost.argmin()
    for i in range(n - 1, 0, -1):
        way[i - 1] = back[i, way[i]]
    return way, float(cost.min())


def kalman(t: np.ndarray, x: np.ndarray, y: np.ndarray, sigma: float = 8.0, acceleration: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Speeds (m/s) and headings (degrees, 0 east, counter-clockwise) of a constant-velocity filter over metres.

    The axes share their covariance, so that of one is followed: places start with variance 10, speeds with 100.
    """
    n = len(t)
    speed, heading = np.zeros(n), np.zeros(n)
    if not n:
        return speed, heading
    place = np.array([x[0], y[0]])
    velocity = np.array([x[1] - x[0], y[1] - y[0]]) / max(1e-3, t[1] - t[0]) if n > 1 else np.zeros(2)
    pp, pv, vv, noise = 10.0, 0.0, 100.0, acceleration * acceleration
    for i in range(n):
        if i:
            dt = t[i] - t[i - 1]
            dt = dt if dt > 0 else 1e-3
            place = place + velocity * dt
            pp, pv, vv = pp + 2 * dt * pv + dt * dt * vv + noise * dt**4 / 4, pv + dt * vv + noise * dt**3 / 2, vv + noise * dt * dt
            total = pp + sigma * sigma
            gain_place, gain_velocity = pp / total, pv / total
            off = np.array([x[i], y[i]]) - place
            place, velocity = place + gain_place * off, velocity + gain_velocity * off
            pp, pv, vv = pp - gain_place * pp, pv - gain_place * pv, vv - gain_velocity * pv
        speed[i] = math.hypot(*velocity)
        heading[i] = math.degrees(math.atan2(velocity[1], velocity[0])) % 360 if speed[i] > 1e-6 else 0.0
    return speed, heading


def matched(rows: DataFrame, numbered: DataFrame, candidates: int = 2, cell_m: float = 50.0, emission_m: float = 15.0, transition_m: float = 80.0) -> DataFrame:
    """``rows`` (traj_id, seq, t_adjusted, lon, lat, and t if there) with node_id, matched_lon, matched_lat, speed_mps, heading_deg and cost.

    Candidates are each observation's nearest nodes, exact, found by grid cells over all trajectories at once (by squared degrees,
    rounded to 14 places, equal ones by the lower node); then
    each trajectory is one group of a Viterbi search and a Kalman filter. The plane's latitude is that of the first
    observation of the trajectory.
    """
    # written, as the points of the candidates and the trajectories are both taken from it
    rows = kept(rows.select("traj_id", "seq", *[c for c in ("t",) if c in rows.columns], "t_adjusted", "lon", "lat"), "observations")
    points = rows.withColumn("point_id", F.struct("traj_id", "seq")).select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    own = numbered.select("node_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    dx, dy = (F.col("nx") - F.col("x")) * F.cos(F.radians("y")), F.col("ny") - F.col("y")
    near = k_nearest(points, own, "x", "y", candidates, cell_m / 111_320.0, F.round(dx * dx + dy * dy, 14), metric=F.sqrt(dx * dx + dy * dy))
    listed = near.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("rank", "node_id", "nx", "ny"))).alias("near")).select("point_id.traj_id", "point_id.seq", "near")
    joined = rows.join(listed, ["traj_id", "seq"])

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t_adjusted", "seq"], kind="stable").reset_index(drop=True)
        scale = math.cos(math.radians(group["lat"].iloc[0]))
        east = lambda v: np.radians(np.asarray(v, float)) * EARTH_M * scale
        north = lambda v: np.radians(np.asarray(v, float)) * EARTH_M
        pick = lambda c: np.array([[near[min(k, len(near) - 1)][c] for k in range(candidates)] for near in group["near"]])
        lon, lat, node = pick("nx"), pick("ny"), pick("node_id")
        ox, oy, xs, ys = east(group["lon"]), north(group["lat"]), east(lon), north(lat)
        emit = ((xs - ox[:, None]) ** 2 + (ys - oy[:, None]) ** 2) / (2 * emission_m * emission_m)
        way, cost = viterbi(emit, xs, ys, ox, oy, transition_m)
        i = np.arange(len(group))
        speed, heading = kalman(group["t_adjusted"].to_numpy(float), xs[i, way], ys[i, way])
        return group.drop(columns="near").assign(node_id=node[i, way], matched_lon=lon[i, way], matched_lat=lat[i, way], speed_mps=speed, heading_deg=heading, cost=cost)

    kind = dict(rows.dtypes)
    time = f"t {kind['t']}, " if "t" in kind else ""
    schema = f"traj_id {kind['traj_id']}, seq {kind['seq']}, {time}t_adjusted double, lon double, lat double, node_id long, matched_lon double, matched_lat double, speed_mps double, heading_deg double, cost double"
    return joined.groupBy("traj_id").applyInPandas(one, schema)


def corrected(features: DataFrame, numbered: DataFrame, time_field: str, traj: str | None = None, box: tuple[float, float, float, float] | None = None, **options: float) -> DataFrame:
    """The whole correction; times of the result are the original ones."""
    rows = increasing_times(observations(features, time_field, traj, box))
    return matched(rows, numbered, **options).drop("t_adjusted")


