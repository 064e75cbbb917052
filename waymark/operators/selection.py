"""Selection by attribute and by place."""

from __future__ import annotations

import functools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, box_within_degrees, box_within_m, boxes_meet, feature_bbox, metres_to_degrees
from ..functions.values import number, selection_literal, wildcard
from .gridjoin import box_join

#: What the index calls kinds of geometry. Fixed values.
KINDS = {"point": ("Point", "MultiPoint"), "polyline": ("LineString", "MultiLineString"), "polygon": ("Polygon", "MultiPolygon")}


def field(table: DataFrame, name: str) -> Column | None:
    """A column (any case), else a property (``properties.k`` or ``k``, any case); null where there is neither."""
    by_lower = {c.lower(): c for c in table.columns}
    if name.lower() in by_lower:
        return F.col(f"`{by_lower[name.lower()]}`")
    key = name.split(".", 1)[1] if name.lower().startswith("properties.") else name
    if "properties" in table.columns:
        lower = F.transform_keys("properties", lambda k, v: F.lower(k))
        return F.try_element_at(lower, F.lit(key.lower()))
    return None


def _same(table: DataFrame, name: str, value: Column, literal: Any) -> Column:
    """Null-safe equality without coercion between text and numbers: other types are never equal."""
    kind = next((t for c, t in table.dtypes if c.lower() == name.lower()), "string")
    if literal is None:
        return value.isNull()
    if isinstance(literal, bool):
        fits = kind == "boolean"
    elif isinstance(literal, (int, float)):
        fits = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    else:
        fits = kind == "string"
    return value.eqNullSafe(F.lit(literal)) if fits else F.lit(False)


def condition(table: DataFrame, name: str, op: str, literal: Any) -> Column:
    """One condition, true or false but never null."""
    value = field(table, name)
    if value is None:
        value = F.lit(None).cast("string")
    op = op.strip().lower()
    text = value.cast("string")
    if op in ("=", "==", "eq"):
        return _same(table, name, value, selection_literal(literal))
    if op in ("!=", "<>", "ne"):
        return ~_same(table, name, value, selection_literal(literal))
    if op == "contains":
        return F.coalesce(text.contains(str(literal)), F.lit(False))
    if op in ("not_contains", "notcontains"):
        return F.coalesce(~text.contains(str(literal)), F.lit(False))
    if op in ("wildcard", "like"):
        return F.coalesce(text.rlike(wildcard(str(literal))), F.lit(False))
    if op in (">", "<", ">=", "<="):
        try:
            bound = float(literal)
        except (TypeError, ValueError):
            return F.lit(False)
        n = number(value)
        return F.coalesce({">": n > bound, "<": n < bound, ">=": n >= bound, "<=": n <= bound}[op], F.lit(False))
    return F.lit(False)


def by_attribute(table: DataFrame, conditions: list[dict[str, Any]], strict_ids: bool = True) -> DataFrame:
    """Rows that meet ``conditions`` ({field, op, value, join}), folded from the left: a OR b AND c is (a OR b) AND c.

    No conditions: all rows. With ``strict_ids`` rows whose id is no integer are left out.
    """
    rows = table.where("id_long is not null") if strict_ids and "id_long" in table.columns else table
    if not conditions:
        return rows
    each = [(str(c.get("join") or "and").lower(), condition(table, c["field"], c["op"], c.get("value"))) for c in conditions]
    return rows.where(functools.reduce(lambda a, b: (b[0], a[1] | b[1]) if b[0] == "or" else (b[0], a[1] & b[1]), each)[1])


def _kind(kind: str | None) -> Column:
    return F.col("geom_type").isin(*KINDS[kind]) if kind in KINDS else F.lit(True)


def in_box(table: DataFrame, minx: float, miny: float, maxx: float, maxy: float, kind: str | None = None) -> DataFrame:
    return table.where(_kind(kind) & boxes_meet(feature_bbox(F.col("parts")), box(minx, miny, maxx, maxy)))


def in_circle(table: DataFrame, x: float, y: float, radius: float, kind: str | None = None) -> DataFrame:
    """Rows whose box comes within ``radius`` degrees of a point, on the plane."""
    return table.where(_kind(kind) & box_within_degrees(feature_bbox(F.col("parts")), F.lit(float(x)), F.lit(float(y)), F.lit(float(radius))))


def in_circle_m(table: DataFrame, x: float, y: float, metres: float, kind: str | None = None) -> DataFrame:
    """Rows whose box comes within ``metres`` of a point; a candidate box is tested first."""
    if not metres > 0:
        raise ValueError("the radius must be above 0")
    b, cx, cy = feature_bbox(F.col("parts")), F.lit(float(x)), F.lit(float(y))
    dx, dy = metres_to_degrees(cy, F.lit(float(metres)))
    around = F.struct((cx - dx).alias("minx"), (cy - dy).alias("miny"), (cx + dx).alias("maxx"), (cy + dy).alias("maxy"))
    return table.where(_kind(kind) & boxes_meet(b, around) & box_within_m(b, cx, cy, F.lit(float(metres))))


def boxes_of(refs: list[Any]) -> list[tuple[float, float, float, float]]:
    """Reference boxes of dicts or lists; bad ones are skipped."""
    out = []
    for r in refs:
        try:
            v = [r[k] for k in ("minx", "miny", "maxx", "maxy")] if isinstance(r, dict) else list(r)[:4]
            out.append(tuple(float(x) for x in v))
        except (KeyError, TypeError, ValueError):
            continue
    return [b for b in out if len(b) == 4]


def _refs(table: DataFrame, refs: list[Any]) -> DataFrame:
    """Reference boxes as rows. They are parameters of a call, so their number is the caller's."""
    return table.sparkSession.createDataFrame(boxes_of(refs), "minx double, miny double, maxx double, maxy double").select(F.struct("minx", "miny", "maxx", "maxy").alias("ref"))


def _side(refs: list[Any]) -> float:
    """A grid cell as wide as the reference boxes are on average, so that each covers a few cells."""
    spans = [max(b[2] - b[0], b[3] - b[1]) for b in boxes_of(refs)]
    return min(1.0, max(0.001, sum(spans) / max(1, len(spans))))


def meeting_boxes(table: DataFrame, refs: list[Any]) -> DataFrame:
    """Ids (id_long, distinct, ascending) of the features that meet any of the reference boxes; a join on grid cells."""
    own = table.where("id_long is not null").select("id_long", feature_bbox(F.col("parts")).alias("own")).where("own.minx is not null")
    return box_join(own, _refs(table, refs), "own", "ref", _side(refs)).select("id_long").distinct().orderBy("id_long")


def around_boxes(table: DataFrame, refs: list[Any], metres: float) -> DataFrame:
    """Ids (id_long, distinct, ascending) of the features within ``metres`` of the centre of any reference box."""
    own = table.where("id_long is not null").select("id_long", feature_bbox(F.col("parts")).alias("own")).where("own.minx is not null")
    cx, cy = (F.col("ref.minx") + F.col("ref.maxx")) / 2, (F.col("ref.miny") + F.col("ref.maxy")) / 2
    dx, dy = metres_to_degrees(F.col("cy"), F.lit(float(metres)))
    # a little wider than the circle, which alone decides
    around = _refs(table, refs).select(cx.alias("cx"), cy.alias("cy")).withColumn("around", F.struct((F.col("cx") - dx * 1.001).alias("minx"), (F.col("cy") - dy * 1.001).alias("miny"), (F.col("cx") + dx * 1.001).alias("maxx"), (F.col("cy") + dy * 1.001).alias("maxy")))
    met = box_join(own, around, "own", "around", min(1.0, max(0.001, metres / 50_000)))
    return met.where(box_within_m(F.col("own"), F.col("cx"), F.col("cy"), F.lit(float(metres)))).select("id_long").distinct().orderBy("id_long")


def difference(table: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """``key`` of the rows of ``table``, less one for each row of ``other`` with the same."""
    return table.select(key).exceptAll(other.select(key))


def delete_first(table: DataFrame, rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``table`` without the first of ``rows`` (a selection from it) by ``order``; all of it where nothing is selected."""
    return table.join(F.broadcast(rows.agg(F.min_by(key, order).alias(key))), key, "left_anti")  # one row


def in_box_points(points: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    return points.where(F.col("lon").between(minx, maxx) & F.col("lat").between(miny, maxy))
