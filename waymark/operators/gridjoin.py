"""Spatial joins by grid cells: an equi-join that Spark can shuffle, instead of a nested loop over all pairs.

A box is exploded to the cells that it covers. A pair is kept only in the cell of its reference point (the lower left
corner of where the two boxes overlap), so no pair comes twice and no distinct is needed. Cells are a quadtree: one that holds
too many rows is split in four, again and again while that tells rows apart; what lies too close even then is dealt out in tiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import boxes_meet
from ..plans.steps import kept

#: Rows of either side in one cell before it is split, and how often a cell is split at most.
CROWD, DEEPEST = 4096, 16
#: Rows of both sides that a task compares, where there are more than the cores' tasks would have.
TASK = 100_000
#: Ids in one list of equal rows.
LIST = 256


def with_cells(df: DataFrame, box: str, size: float, reach: float = 0.0) -> DataFrame:
    """A row for each cell (gx, gy) that ``box``, widened by ``reach``, covers."""
    at = lambda v: F.floor(v / size).cast("long")
    return df.withColumn("gx", F.explode(F.sequence(at(F.col(box)["minx"] - reach), at(F.col(box)["maxx"] + reach)))).withColumn("gy", F.explode(F.sequence(at(F.col(box)["miny"] - reach), at(F.col(box)["maxy"] + reach))))


def _children(df: DataFrame, box: str, size: float, reach: float) -> DataFrame:
    """The quarters (of side ``size``) of each row's cell that its box covers."""
    at = lambda v: F.floor(v / size).cast("long")
    out = df
    for g, low, high in (("gx", "minx", "maxx"), ("gy", "miny", "maxy")):
        first, last = F.greatest(2 * F.col(g), at(F.col(box)[low] - reach)), F.least(2 * F.col(g) + 1, at(F.col(box)[high] + reach))
        out = out.withColumn(g, F.explode(F.sequence(first, last)))
    return out


def dealt(left: DataFrame, right: DataFrame, left_box: str, right_box: str, size: float, reach: float = 0.0, crowd: int = 0) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``cell`` (level, gx, gy, l, r), on which they are joined.

    Level 0 has cells of ``size``, each next level cells of half that. The cells of a level that hold over ``crowd`` rows of
    a side are split if that gives no more than twice the rows; those that are not are dealt out in tiles of ``crowd`` rows of each side. ``reach`` widens
    the left boxes. Both sides are dealt to tasks by cell. What is known of cells are the crowded ones alone: one for ``crowd`` rows at most.
    """
    crowd = crowd or CROWD
    sides = [(with_cells(left, left_box, size, reach), left_box, reach), (with_cells(right, right_box, size), right_box, 0.0)]
    found: list[list[DataFrame]] = [[], []]
    tasks = 0
    plain = lambda rows, level: rows.withColumn("cell", F.struct(F.lit(level).alias("level"), "gx", "gy", F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"))).drop("gx", "gy")

    def counted(rows: list[DataFrame], up: int = 0) -> DataFrame:
        each = [r.select(F.shiftright("gx", up).alias("gx"), F.shiftright("gy", up).alias("gy"), F.lit(1 - k).alias("a"), F.lit(k).alias("b")) for k, r in enumerate(rows)]
        return each[0].unionByName(each[1]).groupBy("gx", "gy").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    for level in range(DEEPEST + 1):
        rows = [r for r, _, _ in sides]
        most, total = counted(rows).agg(F.max(F.greatest("a", "b")), F.sum(F.col("a") + F.col("b"))).first()
        tasks = tasks or max(4 * left.sparkSession.sparkContext.defaultParallelism, (total or 0) // TASK)
        if (most or 0) <= crowd:
            for k in (0, 1):
                found[k].append(plain(rows[k], level))
            break
        full = kept(counted(rows).where(F.greatest("a", "b") > crowd), "crowded")
        names = F.broadcast(full.select("gx", "gy"))
        split = [_children(r.join(names, ["gx", "gy"], "left_semi"), box, size / 2 ** (level + 1), wide) for r, box, wide in sides]
        if level < DEEPEST:
            after = counted(split, 1).withColumnsRenamed({"a": "a2", "b": "b2"})
            judged = kept(full.join(after, ["gx", "gy"]).select("gx", "gy", "a", "b", (F.col("a2") + F.col("b2") <= 2 * (F.col("a") + F.col("b"))).alias("useful")), "judged")
        else:
            judged = full.withColumn("useful", F.lit(False))
        tiles = judged.where("not useful").select("gx", "gy", F.ceil(F.col("a") / crowd).alias("ls"), F.ceil(F.greatest("b", F.lit(1)) / crowd).alias("rs"))
        useful = F.broadcast(judged.where("useful").select("gx", "gy"))
        for k, r in enumerate(rows):
            found[k].append(plain(r.join(names, ["gx", "gy"], "left_anti"), level))
            own, other = ("ls", "rs") if k == 0 else ("rs", "ls")
            tiled = r.join(F.broadcast(tiles), ["gx", "gy"])
            mine = F.pmod(F.xxhash64(*[c for c in r.columns if c not in ("gx", "gy")]), F.greatest(own, F.lit(1)))
            tiled = tiled.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(other), F.lit(1)) - 1)))
            l, r_ = ("_mine", "_other") if k == 0 else ("_other", "_mine")
            found[k].append(tiled.withColumn("cell", F.struct(F.lit(level).alias("level"), "gx", "gy", F.col(l).cast("long").alias("l"), F.col(r_).cast("long").alias("r"))).drop("gx", "gy", "ls", "rs", "_mine", "_other"))
        sides = [(_children(r.join(useful, ["gx", "gy"], "left_semi"), box, size / 2 ** (level + 1), wide), box, wide) for r, box, wide in sides]
    out = []
    for parts in found:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        # few bytes, but much work to compare: not to be put together in one task
        out.append(whole.repartition(tasks, "cell"))
    return out[0], out[1]


def listed(rows: DataFrame, id: str, most: int = 0) -> DataFrame:
    """Rows that are equal in all but ``id`` as one, with their ids in a list; more than some ``most`` ids make more rows.

    So equal rows are compared once, and the pairs that they make are written out where they are found, without a shuffle.
    """
    most, keys = most or LIST, [c for c in rows.columns if c != id]
    crowded = kept(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "many")
    if crowded.isEmpty():
        return rows.groupBy(*keys).agg(F.collect_list(id).alias(id))
    same = None
    for c in keys:
        equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = equal if same is None else same & equal
    told = rows.join(crowded.withColumnsRenamed({c: f"_{c}" for c in keys}), same, "left").drop(*[f"_{c}" for c in keys])
    piece = F.pmod(F.xxhash64(id), F.ceil(F.coalesce("_n", F.lit(1)) / most))
    return told.withColumn("_piece", piece).groupBy(*keys, "_piece").agg(F.collect_list(id).alias(id)).drop("_piece")


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, size: float, condition: Column | None = None, crowd: int = 0) -> DataFrame:
    """Pairs of rows whose boxes meet; column names of the two sides must differ. ``size`` is the side of the widest cells."""
    a, b = F.col(left_box), F.col(right_box)
    side = F.lit(size) / F.pow(F.lit(2.0), F.col("cell.level"))
    at = lambda v: F.floor(v / side).cast("long")
    reference = (F.col("cell.gx") == at(F.greatest(a["minx"], b["minx"]))) & (F.col("cell.gy") == at(F.greatest(a["miny"], b["miny"])))
    own, other = dealt(left, right, left_box, right_box, size, crowd=crowd)
    joined = own.join(other, "cell").where(reference & boxes_meet(a, b))
    return (joined.where(condition) if condition is not None else joined).drop("cell")


def self_pairs(rows: DataFrame, id: str, box: str, size: float) -> DataFrame:
    """a, b (a < b): the ids of rows whose boxes meet. Equal boxes are one row, and their pairs are written out where they are found."""
    once = listed(rows.select(id, box), id)
    once = kept(once.select(F.monotonically_increasing_id().alias("row"), id, box), "boxes")
    left, right = (once.toDF(f"row{i}", f"id{i}", f"box{i}") for i in (1, 2))
    met = box_join(left, right, "box1", "box2", size, F.col("row1") <= F.col("row2")).select((F.col("row1") == F.col("row2")).alias("same"), "id1", "id2")
    met = met.withColumn("x", F.explode("id1")).withColumn("y", F.explode("id2")).where("case when same then x < y else x <> y end")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_points(left: DataFrame, points: DataFrame, left_box: str, x: str, y: str, size: float, reach: float = 0.0, crowd: int = 0) -> DataFrame:
    """Rows of ``left`` with each of ``points`` in a cell that their box, widened by ``reach``, covers: candidates, each pair once."""
    spot = F.struct(F.col(x).alias("minx"), F.col(y).alias("miny"), F.col(x).alias("maxx"), F.col(y).alias("maxy"))
    own, other = dealt(left, points.withColumn("_spot", spot), left_box, "_spot", size, reach, crowd)
    return own.join(other, "cell").drop("cell", "_spot")


#: Nodes of a cell at which the descent of ``k_nearest`` ends, where nodes lie evenly; rows that may go to every executor.
LEAF, SMALL = 8, 100_000


def k_nearest(points: DataFrame, nodes: DataFrame, x: str, y: str, k: int, size: float, rank: Column, degrees: bool = True, metric: Column | None = None, unit: float = 1.0) -> DataFrame:
    """For each of ``points`` (point_id, x, y) its ``k`` nearest ``nodes`` (node_id, nx, ny), by ``rank`` (a distance), exact.

    Points at one place are searched once. First the cells around each place are searched; a point is done when its k-th distance, in units of ``x`` and
    ``y`` (with ``degrees``, of those at the point's latitude), lies well within what was searched whole. Points that
    are left lie off the nodes, and descend a pyramid of cells (see ``_descended``). ``metric`` is a distance that rises with ``rank`` (default: itself) and is at most ``unit`` times that in ``x`` and
    ``y``. Ties go to the lower node_id.
    """
    nodes = kept(nodes, "nodes")
    bounds = nodes.agg(F.min("nx"), F.max("nx"), F.min("ny"), F.max("ny"), F.count("*")).first()
    if bounds[0] is None:
        return points.crossJoin(nodes.limit(0)).withColumns({"distance": F.lit(0.0), "rank": F.lit(1)})
    every, points = points, kept(points.select(x, y).distinct().select(F.struct(x, y).alias("point_id"), x, y), "places")
    width, height = max(bounds[1] - bounds[0], size), max(bounds[3] - bounds[2], size)
    # so wide that the cells around a point hold enough nodes where they lie evenly
    reach = max(size, 2.5 * math.sqrt(width * height * k / bounds[4]))
    order = Window.partitionBy("point_id").orderBy("distance", "node_id")

    def celled(side: float) -> DataFrame:
        return nodes.withColumns({"gx": F.floor(F.col("nx") / side).cast("long"), "gy": F.floor(F.col("ny") / side).cast("long")})

    def ranked(near: DataFrame, side: float) -> DataFrame:
        return near.join(celled(side), ["gx", "gy"]).drop("gx", "gy").withColumn("distance", rank).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    own_box = F.struct(F.col(x).alias("minx"), F.col(y).alias("miny"), F.col(x).alias("maxx"), F.col(y).alias("maxy"))
    found = ranked(with_cells(points.withColumn("own_box", own_box), "own_box", reach, reach).drop("own_box"), reach)
    flat = F.sqrt((F.col("nx") - F.col(x)) * (F.col("nx") - F.col(x)) + (F.col("ny") - F.col(y)) * (F.col("ny") - F.col(y)))
    flat = flat / F.greatest(F.abs(F.cos(F.radians(F.col(y)))), F.lit(1e-6)) if degrees else flat
    # what lies outside the searched ring is farther than ``reach``, so with k inside it nothing was missed
    settled = found.groupBy("point_id").agg(F.count("*").alias("n"), F.max(flat).alias("far")).where((F.col("n") >= k) & (F.col("far") <= reach / 2)).select("point_id")
    done = kept(found.join(settled, "point_id", "left_semi"), "nearest")
    left = kept(points.join(done.select("point_id").distinct(), "point_id", "left_anti"), "left")
    if left.isEmpty():
        return _at_places(every, done, points.count(), x, y)
    # cells of the lowest level hold some LEAF nodes, in long and narrow networks too
    depth = max(1, math.ceil(math.log2(max(width, height) / math.sqrt(width * height * LEAF / max(LEAF, bounds[4])))))
    side = max(width, height) * (1 + 1e-9) / 2**depth
    found = done.unionByName(kept(ranked(_descended(left, celled(side), depth, k, metric if metric is not None else rank, unit), side), "descended"))
    return _at_places(every, found, points.count(), x, y)


def _at_places(points: DataFrame, found: DataFrame, places: int, x: str, y: str) -> DataFrame:
    """Each of ``points`` with what was found for its place."""
    own = found.drop("point_id").withColumnsRenamed({x: "_x", y: "_y"})
    own = F.broadcast(own) if places <= SMALL else own
    return points.join(own, F.col(x).eqNullSafe(F.col("_x")) & F.col(y).eqNullSafe(F.col("_y"))).drop("_x", "_y")


def _descended(points: DataFrame, celled: DataFrame, depth: int, k: int, far: Column, unit: float) -> DataFrame:
    """``points`` with each cell (gx, gy) of the pyramid's lowest level that may hold one of its ``k`` nearest nodes.

    The pyramid: cells of the lowest level with their nodes' centre, radius and number, and level by level four of them in one.
    A point starts at the top and goes down best first: of the cells below those it holds, the nearest that together have ``k`` nodes
    bound its k-th distance by the triangle inequality, and only cells that come nearer are held. So a point reads a few cells a
    level, and no cell of many nodes is read whole. Levels of ``SMALL`` cells at most go to every executor.
    """
    box = [F.min("nx").alias("x0"), F.max("nx").alias("x1"), F.min("ny").alias("y0"), F.max("ny").alias("y1"), F.count("*").alias("n")]
    levels = [kept(celled.groupBy("gx", "gy").agg(*box), "pyramid")]
    for _ in range(depth):
        up = levels[-1].groupBy(F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy"))
        levels.append(up.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.sum("n").alias("n")))
        if depth - len(levels) >= 6:  # the upper levels are small, and follow from this one
            levels[-1] = kept(levels[-1], "pyramid")
    half = lambda a, b: (F.col(b) - F.col(a)) / 2
    names = points.columns
    # few bytes, but much work: not to be put together in one task
    held = points.repartition(4 * points.sparkSession.sparkContext.defaultParallelism, "point_id")
    by = Window.partitionBy("point_id")
    for up, cells in enumerate(reversed(levels)):
        middle = cells.select("gx", "gy", "n", (F.col("x0") + half("x0", "x1")).alias("nx"), (F.col("y0") + half("y0", "y1")).alias("ny"), (F.sqrt(half("x0", "x1") * half("x0", "x1") + half("y0", "y1") * half("y0", "y1")) * unit).alias("radius"))
        if up == 0:  # nodes lie around the origin of the grid, in four cells of the top at most
            near = held.join(F.broadcast(middle))
        else:
            middle = middle.withColumns({"ux": F.shiftright("gx", 1), "uy": F.shiftright("gy", 1)})
            middle = F.broadcast(middle) if 4 ** (up + 1) <= SMALL else middle
            near = held.withColumnsRenamed({"gx": "ux", "gy": "uy"}).join(middle, ["ux", "uy"]).drop("ux", "uy")
        near = near.withColumns({"low": far - F.col("radius"), "high": far + F.col("radius")})
        gathered = F.sum("n").over(by.orderBy("high", "gx", "gy"))
        near = near.withColumn("gathered", gathered).withColumn("most", F.min(F.when(F.col("gathered") >= k, F.col("high"))).over(by))
        held = near.where(F.col("most").isNull() | (F.col("low") <= F.col("most") * (1 + 1e-9) + 1e-12)).select(*names, "gx", "gy")
        if up % 5 == 4:
            held = kept(held, "held")
    return held
