"""Spatial joins as equi-joins on grid cells.

Boxes are dealt to the cells they touch, one side widened by the search radius. A pair that meets in
several cells is given out only in the cell with the larger of the two sides' first cell numbers, so
nothing has to be made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rowloom.functions.scalar import angle_difference, axial_bearing, project_on_segment
from rowloom.operators.durable import cut, dealt, partitions, settled, written


def _cells(df: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    x0, y0, x1, y1 = (F.floor(c / size).cast("long") for c in box)
    df = df.withColumns({"_fx": x0, "_fy": y0})
    return df.withColumn("_cx", F.explode(F.sequence(x0, x1))).withColumn("_cy", F.explode(F.sequence(y0, y1)))


def grid_join(left: DataFrame, right: DataFrame, box: tuple[str, str, str, str], radius: float, cell: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes come within radius of each other in x and in y.

    left and right have the four box columns (least x, least y, largest x, largest y); their columns
    come back as structs l and r. cell: the side of a cell, at least radius if boxes are small.
    """
    size = float(cell or max(radius, 1e-9))
    a, b, c, d = (F.col(n) for n in box)
    ls = _cells(left, (a, b, c, d), size)
    rs = _cells(right, (a - radius, b - radius, c + radius, d + radius), size)
    # structs are built above the explode: Catalyst would otherwise prune their fields through it
    ls = ls.select(F.struct(*left.columns).alias("l"), "_cx", "_cy", F.col("_fx").alias("_lx"), F.col("_fy").alias("_ly"))
    rs = rs.select(F.struct(*right.columns).alias("r"), "_cx", "_cy", F.col("_fx").alias("_rx"), F.col("_fy").alias("_ry"))
    met = ls.join(dealt(rs), ["_cx", "_cy"]).where((F.col("_cx") == F.greatest("_lx", "_rx")) & (F.col("_cy") == F.greatest("_ly", "_ry")))
    near = (
        (F.col(f"l.{box[0]}") <= F.col(f"r.{box[2]}") + radius) & (F.col(f"r.{box[0]}") <= F.col(f"l.{box[2]}") + radius)
        & (F.col(f"l.{box[1]}") <= F.col(f"r.{box[3]}") + radius) & (F.col(f"r.{box[1]}") <= F.col(f"l.{box[3]}") + radius)
    )
    return met.where(near).select("l", "r")


BOX = ("bx0", "by0", "bx1", "by1")


def boxed(rows: DataFrame) -> DataFrame:
    """Straight rows (id, x0, y0, x1, y1) with their boxes and lengths."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return rows.withColumns(
        {
            "bx0": F.least("x0", "x1"), "by0": F.least("y0", "y1"), "bx1": F.greatest("x0", "x1"), "by1": F.greatest("y0", "y1"),
            "length": F.sqrt(dx * dx + dy * dy),  # as in SQL: hypot rounds otherwise, and of two equal rows the other would be the shorter
        }
    )


def _ends(s: str) -> list[Column]:
    return [F.col(f"{s}.{c}") for c in ("x0", "y0", "x1", "y1")]


def cross(s: str, t: str) -> Column:
    """Whether two segments meet in a point inside both or at an end (parallel overlaps apart)."""
    ax, ay, bx, by = _ends(s)
    cx, cy, dx, dy = _ends(t)
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    d1, d2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    d3, d4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & ((d1 != 0) | (d2 != 0))


def _apart(px: np.ndarray, py: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Distances of points from segments, which may be points themselves; a root of squares, as in SQL."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = np.where(size > 0, np.clip(((px - x0) * dx + (py - y0) * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0), 0.0)
    ex, ey = px - x0 - t * dx, py - y0 - t * dy
    return np.sqrt(ex * ex + ey * ey)


def _segments_apart(*ends: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        ax, ay, bx, by, cx, cy, dx, dy = (e.to_numpy(dtype=float, na_value=np.nan) for e in ends)
        side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
        d1, d2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
        d3, d4 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
        near = _apart(ax, ay, cx, cy, dx, dy)
        for other in ((bx, by, cx, cy, dx, dy), (cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by)):
            near = np.fmin(near, _apart(*other))
        return pd.Series(np.where((d1 * d2 <= 0) & (d3 * d4 <= 0) & ((d1 != 0) | (d2 != 0)), 0.0, near))


def segment_distance(s: str, t: str) -> Column:
    """Least distance of two segments.

    In numpy: as an expression it outgrows the methods that the JVM compiles and is interpreted for every pair.
    """
    return F.pandas_udf(_segments_apart, DoubleType())(*_ends(s), *_ends(t))


def _median_apart(samples: int) -> Callable[..., Column]:
    """Column of the median distance of even points, at most samples, of segments (four ends, then their length) from others (four ends)."""

    def median(*columns: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            sx0, sy0, sx1, sy1, length, *t = (c.to_numpy(dtype=float, na_value=np.nan)[:, None] for c in columns)
            n = np.clip(np.floor(np.nan_to_num(length, nan=2.0)), 2, samples).astype(int)
            k = np.arange(samples)[None, :]
            f = k / (n - 1)
            d = np.sort(np.where(k < n, _apart(sx0 + f * (sx1 - sx0), sy0 + f * (sy1 - sy0), *t), np.nan), axis=1)
            middle = lambda at: np.take_along_axis(d, at, axis=1)[:, 0]
            return pd.Series((middle((n - 1) // 2) + middle(n // 2)) / 2)

    return F.pandas_udf(median, DoubleType())


def pair_measures(pairs: DataFrame, samples: int = 20) -> DataFrame:
    """(i, j, distance, angle, overlap, nearest) of pairs of boxed straight rows l and r (with id).

    distance: the median over points of the shorter row of their distances from the longer one;
    overlap: the shorter row's ends projected on the longer one, over its length.
    """
    first = F.col("l.length") <= F.col("r.length")
    c = ("x0", "y0", "x1", "y1")
    choice = lambda n: (F.when(first, F.col(f"l.{n}")).otherwise(F.col(f"r.{n}")), F.when(first, F.col(f"r.{n}")).otherwise(F.col(f"l.{n}")))
    own = [v.alias(f"{side}{n}") for n in c for side, v in zip("st", choice(n), strict=True)]
    # settled as one flat row: an end read through a choice of structs would build both structs wherever it is read
    p = settled(pairs.select(F.col("l.id").alias("i"), F.col("r.id").alias("j"), F.struct(*own, choice("length")[0].alias("length")).alias("_e"), *[F.col(f"{s}.{n}").alias(f"_{s}{n}") for s in "lr" for n in c]), "_e")
    sx0, sy0, sx1, sy1 = (F.col(f"_e.s{n}") for n in c)
    t = [F.col(f"_e.t{n}") for n in c]
    # settled: a condition on a measure would otherwise go below it, and the measure be taken twice
    p = settled(p.withColumn("_d", _median_apart(samples)(sx0, sy0, sx1, sy1, F.col("_e.length"), *t)), "_d")
    span = F.abs(project_on_segment(sx1, sy1, *t) - project_on_segment(sx0, sy0, *t))
    ends = {s: [F.col(f"_{s}{n}") for n in c] for s in "lr"}
    bearing = lambda e: axial_bearing(e[2] - e[0], e[3] - e[1])
    measured = F.struct(
        F.col("_d").alias("distance"), angle_difference(bearing(ends["l"]), bearing(ends["r"])).alias("angle"),
        F.when(F.col("_e.length") > 1e-6, span / F.col("_e.length")).otherwise(F.lit(0.0)).alias("overlap"),
    )
    p = settled(p.withColumn("_m", measured), "_m").withColumns({s: F.struct(*[F.col(f"_{s}{n}").alias(n) for n in c]) for s in "lr"})
    return p.select("i", "j", "_m.distance", "_m.angle", "_m.overlap", segment_distance("l", "r").alias("nearest"))


def near_pairs(rows: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """Unordered pairs l, r (l.id < r.id) of straight rows that come within radius of each other."""
    b = boxed(rows)
    return grid_join(b, b, BOX, radius, cell).where("l.id < r.id").where(segment_distance("l", "r") <= radius)


def knn(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(i, j, rank, gap): up to k nearest other points (id, x, y) within radius of each, by distance and id."""
    b = points.select("id", "x", "y", F.col("x").alias("bx0"), F.col("y").alias("by0"), F.col("x").alias("bx1"), F.col("y").alias("by1"))
    # a root of squares, as in SQL: hypot rounds otherwise, and equal gaps would be ranked apart
    dx, dy = F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")
    p = grid_join(b, b, BOX, radius).where("l.id <> r.id").select(F.col("l.id").alias("i"), F.col("r.id").alias("j"), F.sqrt(dx * dx + dy * dy).alias("gap"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("gap", "j"))
    return p.where(F.col("gap") <= radius).withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", "rank", "gap")


#: Into so many parts a side of a cell is cut, again and again, to bound a point's nearest distance.
FINER = 16


def nearest(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """(id, other, d): the nearest point of right for each of left (id, x, y), ties by id; no rows if right has none.

    Cells around a point are searched, the radius growing fourfold for points that have found nothing near
    enough, until all have. For points far from all of right a cell would hold much of it, so they first
    meet one point of each sixteenth of a cell, which bounds their distance; sixteenths that lie within
    the bound are parted again, down to those of the first radius, and only their points are met.
    """
    found = None
    open_ = cut(left.select("id", "x", "y"))
    size = cell
    # read twice a radius and part: in as many files as a join has tasks
    right = written(right.select("id", "x", "y").repartition(partitions(right.sparkSession)))
    if right.isEmpty():
        return left.select("id", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("d")).limit(0)
    while True:
        fine = size / FINER
        q = open_.withColumn("cx", _around("x", size)).withColumn("cy", _around("y", size))
        near = _within(q, right, fine, size)
        while fine > cell / FINER:  # a far point's cells hold much of right, so they are parted again
            fine /= FINER
            near = _within(near.withColumnsRenamed({"fx": "cx", "fy": "cy"}), right, fine, size)
        r = right.select(F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"), *_place("x", "y", fine, "fx", "fy"))
        near = near.join(dealt(r), ["fx", "fy"]).withColumn("d", F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))).where(F.col("d") <= size)
        got = cut(near.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", F.col("m.other").alias("other"), F.col("m.d").alias("d")))
        found = got if found is None else found.unionByName(got)
        open_ = cut(open_.join(dealt(got), "id", "left_anti"))
        if open_.isEmpty():
            break
        size *= 4
    return found


def _place(x: str, y: str, side: float, *names: str) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("long").alias(n) for c, n in zip((x, y), names, strict=True)]


def _around(c: str, size: float) -> Column:
    return F.explode(F.expr(f"transform(sequence(-1, 1), o -> floor({c} / {size!r}D) + o)"))


def _within(points: DataFrame, right: DataFrame, fine: float, reach: float) -> DataFrame:
    """(id, x, y, fx, fy): the cells of side fine, among those in cells (cx, cy) FINER times as wide, that may hold a point's nearest of right.

    One place of each occupied cell bounds a point's distance; cells further off than that, or than reach, go.
    """
    r = right.select("id", "x", "y", *_place("x", "y", fine, "fx", "fy"))
    one = r.groupBy("fx", "fy").agg(F.min(F.struct("id", "x", "y")).alias("p"))
    one = one.select("fx", "fy", F.col("p.x").alias("rx"), F.col("p.y").alias("ry"), F.floor(F.col("fx") / FINER).alias("cx"), F.floor(F.col("fy") / FINER).alias("cy"))
    met = points.join(dealt(one), ["cx", "cy"])
    bound = met.groupBy("id", "x", "y").agg(F.min(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))).alias("bound"), F.collect_list(F.struct("fx", "fy")).alias("cells"))
    # a cell's nearest place, against the bound (or the radius that is safe, if smaller)
    gap = lambda c, k: F.greatest(k * fine - F.col(c), F.col(c) - (k + 1) * fine, F.lit(0.0))
    least = F.least(F.col("bound"), F.lit(float(reach))) * (1 + 1e-9)
    kept = F.filter("cells", lambda k: F.hypot(gap("x", k["fx"]), gap("y", k["fy"])) <= least)
    return bound.select("id", "x", "y", F.explode(kept).alias("k")).select("id", "x", "y", "k.fx", "k.fy")
