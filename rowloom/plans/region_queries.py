"""Queries over regions: a star of the nations, its area, points, tiles and clipped lines; and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import regions
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.views import v_bent, v_points, with_views
from rowloom.sources.tables import table

STEP = 2 * math.pi / 25
#: Lines are this much smaller than their views, to lie around the star.
SHRINK_X, SHRINK_Y, SHIFT_X, SHIFT_Y = 0.5, 0.5, -8.0, -8.0


def star(s: SparkSession, d: str) -> DataFrame:
    """Edges of a ring with a corner for each nation, every third one further out."""
    k, r = F.col("n_nationkey"), 5 + (F.col("n_nationkey") % 3) * 1.5
    ring = table(s, d, "nation").select(F.lit(1).alias("region_id"), F.lit(0).alias("ring"), k.alias("pos"), (r * F.cos(k * STEP)).alias("x"), (r * F.sin(k * STEP)).alias("y"))
    return regions.edges(ring)


def crossed(s: SparkSession, d: str) -> DataFrame:
    """The bent rows moved to the star, each eighth turned upright."""
    v = v_bent(s, d)
    x, y = F.col("x") * SHRINK_X + SHIFT_X, (F.col("y") % 32) * SHRINK_Y + SHIFT_Y
    upright = F.col("line_id") % 8 == 3
    return v.select("line_id", "pos", F.when(upright, y).otherwise(x).alias("x"), F.when(upright, x).otherwise(y).alias("y"))


def region_area(s: SparkSession, d: str) -> DataFrame:
    e = star(s, d)
    b = regions.bounds(e.select(F.col("x0").alias("x"), F.col("y0").alias("y")))
    return rounded(regions.area_centroid(e).join(F.broadcast(b), F.lit(True)), "area", "cx", "cy", "x0", "y0", "x1", "y1")  # one row each


def region_points(s: SparkSession, d: str) -> DataFrame:
    p = v_points(s, d).select("id", (F.col("x") * 40).alias("x"), (F.col("y") * 40).alias("y"))
    return regions.inside(p, star(s, d), 1.0).select("id", "inside")


def region_tiles(s: SparkSession, d: str) -> DataFrame:
    """How much of each tile of a grid over the star lies inside it; a tile for each customer of the first 400 numbers' places."""
    t = table(s, d, "customer").select(F.col("c_custkey").alias("tile_id"))
    x, y = (F.col("tile_id") % 20) - 10.0, F.floor(F.col("tile_id") / 20) % 20 - 10.0
    tiles = t.select("tile_id", x.alias("x0"), y.cast("double").alias("y0"), (x + 1.5).alias("x1"), (y + 1.25).cast("double").alias("y1"))
    return rounded(regions.covered_fraction(tiles, star(s, d), 1.0), "fraction")


def region_clip(s: SparkSession, d: str) -> DataFrame:
    """Stretches of lines inside the star and their lengths, and the longest of each line."""
    v, e = crossed(s, d), star(s, d)
    got = regions.longest_inside(v, e)
    parts = regions.clip(v, e).groupBy("line_id").agg((F.max("part") + 1).alias("n_parts"))
    return rounded(got.join(parts, "line_id", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(0)).cast("long")), "inside_length")


_ALL = (region_area, region_points, region_tiles, region_clip)
QUERIES = {f.__name__: f for f in _ALL}

_STAR = f"""rg AS (SELECT n_nationkey AS k, (5 + (n_nationkey % 3) * 1.5::DOUBLE) * cos(n_nationkey * {STEP!r}::DOUBLE) AS x, (5 + (n_nationkey % 3) * 1.5::DOUBLE) * sin(n_nationkey * {STEP!r}::DOUBLE) AS y FROM nation),
e AS MATERIALIZED (SELECT x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM rg WINDOW w AS (ORDER BY k))"""
_CLAMP = "greatest(ty0, least(ty1, {0}))"
_BELOW = "(greatest(0.0, least({0}, ty1) - ty0) ** 2 / 2 + (ty1 - ty0) * greatest(0.0, {0} - ty1))"
ORACLES = {
    "region_area": f"""WITH {_STAR}, a AS (SELECT sum(x0 * y1 - x1 * y0) / 2 AS a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / 6 AS mx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / 6 AS my, min(x0) AS x0, min(y0) AS y0, max(x0) AS x1, max(y0) AS y1 FROM e)
        SELECT {_r('abs(a)', 'area')}, {_r('mx / a', 'cx')}, {_r('my / a', 'cy')}, {_r('x0')}, {_r('y0')}, {_r('x1')}, {_r('y1')} FROM a""",
    "region_points": with_views(
        f"""WITH {_STAR}, p AS (SELECT id, x * 40 AS px, y * 40 AS py FROM v_points)
        SELECT id, coalesce((SELECT count(*) % 2 = 1 FROM e WHERE py >= least(y0, y1) AND py < greatest(y0, y1) AND x0 + (py - y0) / (y1 - y0) * (x1 - x0) > px), false) AS inside FROM p""",
        "v_points",
    ),
    "region_tiles": f"""WITH {_STAR}, t AS (SELECT c_custkey AS tile_id, c_custkey % 20 - 10.0::DOUBLE AS tx0, c_custkey // 20 % 20 - 10.0::DOUBLE AS ty0, c_custkey % 20 - 10.0::DOUBLE + 1.5 AS tx1, c_custkey // 20 % 20 - 10.0::DOUBLE + 1.25 AS ty1 FROM customer),
        m AS (SELECT *, greatest(least(x0, x1), tx0) AS a, least(greatest(x0, x1), tx1) AS b, (y1 - y0) / (x1 - x0) AS k FROM t, e WHERE x0 <> x1),
        q AS (SELECT *, y0 + (a - x0) * k AS ya, y0 + (b - x0) * k AS yb FROM m WHERE b > a),
        s AS (SELECT tile_id, abs(sum(sign(x1 - x0) * CASE WHEN abs(yb - ya) > 1e-12 THEN ({_BELOW.format('yb')} - {_BELOW.format('ya')}) / (yb - ya) * (b - a) ELSE ({_CLAMP.format('ya')} - ty0) * (b - a) END)) AS area FROM q GROUP BY tile_id)
        SELECT tile_id, {_r('least(1.0, coalesce(area, 0) / ((tx1 - tx0) * (ty1 - ty0)))', 'fraction')} FROM t LEFT JOIN s USING (tile_id)""",
    "region_clip": with_views(
        f"""WITH {_STAR}, w AS (SELECT line_id, pos, x * 0.5 + -8.0 AS a, (y % 32) * 0.5 + -8.0 AS b FROM v_bent),
        v AS (SELECT line_id, pos, CASE WHEN line_id % 8 = 3 THEN b ELSE a END AS x, CASE WHEN line_id % 8 = 3 THEN a ELSE b END AS y FROM w),
        s AS (SELECT * FROM (SELECT line_id, pos, x AS ax, y AS ay, lead(x) OVER q AS bx, lead(y) OVER q AS by_ FROM v WINDOW q AS (PARTITION BY line_id ORDER BY pos)) WHERE bx IS NOT NULL),
        h AS (SELECT line_id, pos, ((x0 - ax) * (y1 - y0) - (y0 - ay) * (x1 - x0)) / det AS t, ((x0 - ax) * (by_ - ay) - (y0 - ay) * (bx - ax)) / det AS u FROM (SELECT *, (bx - ax) * (y1 - y0) - (by_ - ay) * (x1 - x0) AS det FROM s, e) WHERE det <> 0),
        k AS (SELECT line_id, pos, list(DISTINCT round(t, 12)) AS ts FROM h WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 GROUP BY 1, 2),
        f AS (SELECT s.*, list_sort(list_concat([0.0::DOUBLE], coalesce(ts, []::DOUBLE[]), [1.0::DOUBLE])) AS ts FROM s LEFT JOIN k USING (line_id, pos)),
        g AS (SELECT *, unnest(range(1, len(ts))) AS i FROM f),
        p AS (SELECT line_id, pos, i, (ts[i + 1] - ts[i]) * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS n, ax + (ts[i] + ts[i + 1]) / 2 * (bx - ax) AS px, ay + (ts[i] + ts[i + 1]) / 2 * (by_ - ay) AS py FROM g WHERE ts[i + 1] > ts[i]),
        c AS (SELECT *, coalesce((SELECT count(*) % 2 = 1 FROM e WHERE py >= least(y0, y1) AND py < greatest(y0, y1) AND x0 + (py - y0) / (y1 - y0) * (x1 - x0) > px), false) AS inside FROM p),
        r AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY line_id ORDER BY pos, i), false) THEN 1 ELSE 0 END AS fresh FROM c),
        z AS (SELECT *, sum(fresh) OVER (PARTITION BY line_id ORDER BY pos, i) AS part FROM r), l AS (SELECT line_id, part, sum(n) AS n FROM z WHERE inside GROUP BY 1, 2)
        SELECT line_id, {_r('coalesce(max(l.n), 0)', 'inside_length')}, count(part) AS n_parts FROM (SELECT DISTINCT line_id FROM v) LEFT JOIN l USING (line_id) GROUP BY line_id""",
        "v_bent",
    ),
}
