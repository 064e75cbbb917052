"""Geometry as Column expressions; x is longitude and y latitude, in degrees. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M, DEGREE_M = 6_371_000.0, 111_320.0
POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def haversine_m(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Great-circle metres between two points."""
    dy, dx = F.radians(by - ay) / 2, F.radians(bx - ax) / 2
    h = F.pow(F.sin(dy), F.lit(2.0)) + F.cos(F.radians(ay)) * F.cos(F.radians(by)) * F.pow(F.sin(dx), F.lit(2.0))
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def rounded(v: Column, digits: int = 6) -> Column:
    """``v`` in units of 10**-digits, halves away from zero, as a long: an exact key of a coordinate."""
    scaled = v * float(10**digits)
    return F.when(v >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)).cast("long")


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def bbox(points: Column) -> Column:
    """Least and greatest coordinates of an array of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def feature_bbox(parts: Column, most: int | None = None) -> Column:
    """The box of a feature's vertices, or of its first ``most``."""
    return bbox(F.flatten(parts) if most is None else F.slice(F.flatten(parts), 1, most))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes overlap; boxes that only touch do."""
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def box(minx: float, miny: float, maxx: float, maxy: float) -> Column:
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in (("minx", minx), ("miny", miny), ("maxx", maxx), ("maxy", maxy))])


def metres_to_degrees(lat: Column, metres: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that ``metres`` span at a latitude."""
    return metres / (DEGREE_M * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-6))), metres / DEGREE_M


def box_within_m(b: Column, cx: Column, cy: Column, metres: Column) -> Column:
    """Whether the nearest point of a box lies within ``metres`` of a centre, on a plane scaled at the centre's latitude."""
    nx, ny = F.least(F.greatest(cx, b["minx"]), b["maxx"]), F.least(F.greatest(cy, b["miny"]), b["maxy"])
    dx = (nx - cx) * DEGREE_M * F.greatest(F.abs(F.cos(F.radians(cy))), F.lit(1e-6))
    dy = (ny - cy) * DEGREE_M
    return dx * dx + dy * dy <= metres * metres


def box_within_degrees(b: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """The same on the plane of degrees."""
    dx = F.least(F.greatest(cx, b["minx"]), b["maxx"]) - cx
    dy = F.least(F.greatest(cy, b["miny"]), b["maxy"]) - cy
    return dx * dx + dy * dy <= radius * radius


def pairs(points: Column) -> Column:
    """Consecutive pairs (a, b) of an array of points."""
    n = F.size(points)
    return F.when(n < 2, F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")).otherwise(
        F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(1))), F.slice(points, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    )


def length_m(points: Column) -> Column:
    """Great-circle length of a polyline."""
    return F.aggregate(pairs(points), F.lit(0.0), lambda s, p: s + haversine_m(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def nearest_on_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    """(x, y, t, d2): the point of a segment that is nearest to p, its place from a to b, and the squared distance."""
    vx, vy = b["x"] - a["x"], b["y"] - a["y"]
    c2 = vx * vx + vy * vy
    t = F.when(c2 > 0, F.least(F.greatest((vx * (px - a["x"]) + vy * (py - a["y"])) / c2, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    x, y = a["x"] + t * vx, a["y"] + t * vy
    return F.struct(x.alias("x"), y.alias("y"), t.alias("t"), ((px - x) * (px - x) + (py - y) * (py - y)).alias("d2"))


def nearest_on_line(px: Column, py: Column, points: Column) -> Column:
    """(d2, seg, t, x, y): the point of a polyline that is nearest to p, on its first segment of those equally near."""
    each = F.transform(pairs(points), lambda ab, i: F.struct(nearest_on_segment(px, py, ab["a"], ab["b"]).alias("n"), i.alias("seg")))
    return F.array_min(F.transform(each, lambda s: F.struct(s["n"]["d2"].alias("d2"), s["seg"].alias("seg"), s["n"]["t"].alias("t"), s["n"]["x"].alias("x"), s["n"]["y"].alias("y"))))


def projected(x: Column, y: Column, lat0: Column) -> Column:
    """Local equirectangular metres at a latitude of origin."""
    return point(F.radians(x) * EARTH_M * F.cos(F.radians(lat0)), F.radians(y) * EARTH_M)


def unprojected(x: Column, y: Column, lat0: Column) -> Column:
    return point(F.degrees(x / (EARTH_M * F.greatest(F.cos(F.radians(lat0)), F.lit(1e-9)))), F.degrees(y / EARTH_M))


def on_segment(a: Column, b: Column, p: Column, eps: float) -> Column:
    """Whether p lies within ``eps`` of a segment's line, and of its box."""
    inside = p["x"].between(F.least(a["x"], b["x"]) - eps, F.greatest(a["x"], b["x"]) + eps) & p["y"].between(F.least(a["y"], b["y"]) - eps, F.greatest(a["y"], b["y"]) + eps)
    vx, vy = b["x"] - a["x"], b["y"] - a["y"]
    size = F.sqrt(vx * vx + vy * vy)
    wx, wy = p["x"] - a["x"], p["y"] - a["y"]
    off = F.when(size <= 1e-18, F.sqrt(wx * wx + wy * wy)).otherwise(F.abs(cross(vx, vy, wx, wy)) / size)
    return inside & (off <= eps)


def with_steps(df: DataFrame, **steps: Column) -> DataFrame:
    """``df`` with ``steps`` as columns that are computed once for each row.

    A generator of one row: Spark writes no step out wherever it is used, and moves no filter on one before it, which plain columns
    don't prevent, and which makes code so long that the virtual machine only interprets it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in steps.items()]))))


def with_intersection(df: DataFrame, out: str, names: tuple[str, str, str, str], eps: float) -> DataFrame:
    """``df`` with ``out``: the point where segments ab and cd (point columns ``names``) meet, or null.

    Parallel ones meet only where an end of one lies on the other (the first of c, d, a, b that does); what is
    within ``eps`` of an end is that end, so that its key is the end's. Steps are computed once each (``with_steps``).
    """
    a, b, c, d = (F.col(n) for n in names)
    v = {n: f"{out}_{n}" for n in ("rx", "ry", "sx", "sy", "qx", "qy", "area", "t", "u", "x", "y")}
    rx, ry, sx, sy, qx, qy, area, t, u, x, y = (F.col(n) for n in v.values())
    df = with_steps(df, **{v["rx"]: b["x"] - a["x"], v["ry"]: b["y"] - a["y"], v["sx"]: d["x"] - c["x"], v["sy"]: d["y"] - c["y"], v["qx"]: c["x"] - a["x"], v["qy"]: c["y"] - a["y"]})
    df = with_steps(df, **{v["area"]: cross(rx, ry, sx, sy)})
    safe = F.when(F.abs(area) >= 1e-12, area)
    df = with_steps(df, **{v["t"]: cross(qx, qy, sx, sy) / safe, v["u"]: cross(qx, qy, rx, ry) / safe})
    df = with_steps(df, **{v["x"]: a["x"] + t * rx, v["y"]: a["y"] + t * ry})
    meets = t.between(-1e-12, 1 + 1e-12) & u.between(-1e-12, 1 + 1e-12)
    close = lambda p: (x - p["x"]) * (x - p["x"]) + (y - p["y"]) * (y - p["y"]) <= eps * eps
    proper = F.coalesce(*[F.when(close(p), p) for p in (d, c, b, a)], point(x, y))
    touch = F.coalesce(*[F.when(on_segment(p, q, e, eps), e) for p, q, e in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))])
    df = with_steps(df, **{f"{out}_touch": F.when(F.abs(area) < 1e-12, touch)})
    return with_steps(df, **{out: F.when(F.abs(area) < 1e-12, F.col(f"{out}_touch")).when(meets, proper)}).drop(*v.values(), f"{out}_touch")


def cell_size(minx: float, miny: float, maxx: float, maxy: float) -> float:
    """Side of a grid cell for a layer's box."""
    return min(0.05, max(0.001, max(maxx - minx, maxy - miny) / 50))


def heading_degrees(vx: Column, vy: Column) -> Column:
    """0 is east, counter-clockwise, below 360; 0 when standing."""
    return F.when(vx * vx + vy * vy <= 1e-12, 0.0).otherwise(F.pmod(F.degrees(F.atan2(vy, vx)), F.lit(360.0)))
