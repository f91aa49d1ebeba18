"""Operators along a line: windows over its vertices in order, no vertex leaves its line's partition.

A line is rows (line_id, pos, x, y), pos counted from 0. Every operator shuffles once, by line_id, and
those that take the output of another keep that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rowloom.functions.scalar import axial_bearing, pca_bearing, signed_turn, turn_degrees


def _line() -> WindowSpec:
    return Window.partitionBy("line_id")


def _path() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy("pos")


def drop_repeated(v: DataFrame) -> DataFrame:
    """Vertices without those that equal the one before; pos is counted anew."""
    before = F.lag(F.struct("x", "y")).over(_path())
    kept = v.withColumn("_before", before).where("_before IS NULL OR _before.x <> x OR _before.y <> y").drop("_before")
    return kept.withColumn("pos", F.row_number().over(_path()) - 1)


def along(v: DataFrame) -> DataFrame:
    """v with step, the length of the segment that ends in a vertex, and dist, the arc length so far."""
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(_path()), F.col("y") - F.lag("y").over(_path())), F.lit(0.0))
    return v.withColumn("step", step).withColumn("dist", F.sum("step").over(_path().rowsBetween(Window.unboundedPreceding, 0)))


def turns(v: DataFrame, k: int = 1) -> DataFrame:
    """v with turn (degrees) and bend (signed, degrees) between the vertices k before and k after."""
    px, py, nx, ny = F.lag("x", k).over(_path()), F.lag("y", k).over(_path()), F.lead("x", k).over(_path()), F.lead("y", k).over(_path())
    at = v.select("*", (F.col("x") - px).alias("_ax"), (F.col("y") - py).alias("_ay"), (nx - F.col("x")).alias("_bx"), (ny - F.col("y")).alias("_by"))
    a = [F.col(c) for c in ("_ax", "_ay", "_bx", "_by")]
    return at.withColumn("turn", turn_degrees(*a)).withColumn("bend", F.when(F.col("turn").isNotNull(), F.degrees(signed_turn(*a)))).drop("_ax", "_ay", "_bx", "_by")


def quality(
    v: DataFrame, good_length: float = 4.0, least_length: float = 1.0, max_turn: float = 10.0, max_p95: float = 6.0, kink: float = 12.0, max_kinks: float = 0.02,
    knotted: DataFrame | None = None, probability: DataFrame | None = None, least_probability: float = 0.20,
) -> DataFrame:
    """A row for each line: sizes, turn statistics and class GOOD, SUSPECT or INVALID.

    knotted (line_id): lines that meet themselves, which are not GOOD. probability (line_id, median): a line is GOOD only
    if its median is unknown or least_probability at least.
    """
    m = turns(along(v)).groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.sum("step").alias("length"),
        F.hypot(F.max_by("x", "pos") - F.min_by("x", "pos"), F.max_by("y", "pos") - F.min_by("y", "pos")).alias("chord"),
        F.coalesce(F.max("turn"), F.lit(0.0)).alias("max_turn"),
        F.coalesce(F.percentile("turn", F.lit(0.95)), F.lit(0.0)).alias("p95_turn"),
        F.coalesce(F.avg(F.when(F.col("turn").isNotNull(), (F.col("turn") > kink).cast("double"))), F.lit(0.0)).alias("kink_fraction"),
    )
    good = (F.col("length") >= good_length) & (F.col("max_turn") <= max_turn) & (F.col("p95_turn") <= max_p95) & (F.col("kink_fraction") <= max_kinks)
    if knotted is not None:
        m = m.join(knotted.select("line_id", F.lit(True).alias("_knot")).distinct(), "line_id", "left")
        good = good & F.col("_knot").isNull()
    if probability is not None:
        m = m.join(probability.select("line_id", F.col("median").alias("_median")), "line_id", "left")
        good = good & (F.col("_median").isNull() | F.isnan("_median") | (F.col("_median") >= least_probability))
    cls = F.when(good, "GOOD").when((F.col("n_vertices") >= 2) & (F.col("length") >= least_length), "SUSPECT").otherwise("INVALID")
    ratio = F.when(F.col("length") > 0, F.col("chord") / F.col("length")).otherwise(F.lit(0.0))
    return m.select("line_id", "n_vertices", "length", ratio.alias("chord_ratio"), "max_turn", "p95_turn", "kink_fraction", cls.alias("quality"))


#: A vertex sample of a line has at most so many points.
SAMPLES = 20


def vertex_samples(v: DataFrame, most: int = SAMPLES) -> DataFrame:
    """(line_id, pos, x, y): at most most vertices of each line, even by number, the ends included."""
    n = v.select("*", F.count(F.lit(1)).over(Window.partitionBy("line_id")).alias("n"))
    m = F.least(F.lit(most), F.col("n"))
    # the vertex at pos is the sample of the k whose index it is: k is one of two whole numbers beside pos * (m - 1) / (n - 1)
    gap = (F.col("n") - 1) / F.greatest(m - 1, F.lit(1))
    k = F.ceil(F.col("pos") / F.greatest(gap, F.lit(1e-9)) - 1e-9)
    hit = lambda q: (q >= 0) & (q < m - 1) & (F.floor(q * gap) == F.col("pos"))
    return n.where((F.col("n") <= most) | hit(k) | hit(k + 1) | (F.col("pos") == F.col("n") - 1)).select("line_id", "pos", "x", "y")


def bearing_pca(v: DataFrame, most: int = SAMPLES) -> DataFrame:
    """Bearing of each line's main axis over at most most of its vertices, even by number."""
    m = vertex_samples(v, most).groupBy("line_id").agg(F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    return m.select("line_id", pca_bearing(F.col("sxx"), F.col("syy"), F.col("sxy")).alias("bearing_deg"))


def bearing_chord(v: DataFrame) -> DataFrame:
    """Bearing from the first to the last vertex of each line of two or more."""
    m = v.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), *[f(c, "pos").alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min_by), ("b", F.max_by))])
    return m.where("n >= 2").select("line_id", axial_bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("bearing_deg"))


def sign_inversions(v: DataFrame, least_turn: float = 0.5) -> DataFrame:
    """How often the bends of each line change side, bends below least_turn degrees apart."""
    t = turns(along(v))
    total = t.groupBy("line_id").agg(F.sum("step").alias("length"))
    bends = t.where(F.abs("bend") >= least_turn).select("line_id", "pos", F.signum("bend").alias("s"))
    flips = bends.withColumn("flip", (F.col("s") * F.lag("s").over(_path()) < 0).cast("long")).groupBy("line_id").agg(F.sum(F.coalesce("flip", F.lit(0))).alias("n"))
    count = F.coalesce("n", F.lit(0)).cast("long")
    return total.join(flips, "line_id", "left").select("line_id", count.alias("inversions"), F.when(F.col("length") > 0, count / F.col("length")).otherwise(F.lit(0.0)).alias("inversions_per_m"))


def segments(v: DataFrame) -> DataFrame:
    """(line_id, pos, x0, y0, x1, y1, d0, d1, length): each segment by its first vertex, with arc lengths."""
    a = along(v)
    s = a.select(
        "line_id", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(_path()).alias("x1"), F.lead("y").over(_path()).alias("y1"),
        F.col("dist").alias("d0"), F.lead("dist").over(_path()).alias("d1"), F.max("dist").over(_line()).alias("length"),
    )
    return s.where("x1 IS NOT NULL")


def resample(v: DataFrame, spacing: float, with_direction: bool = False) -> DataFrame:
    """(line_id, k, dist, x, y): points at even arc lengths, at most spacing apart, ends included.

    Each segment makes the points that fall on it, so nothing is joined. Lines without length have none.
    """
    s = segments(v).where("length > 0 AND d1 > d0")
    n = F.greatest(F.lit(2), F.ceil(F.col("length") / spacing).cast("int") + 1)
    s = s.withColumn("n", n).withColumn("gap", F.col("length") / (F.col("n") - 1))
    ends = F.col("d1") == F.col("length")
    first = F.ceil(F.col("d0") / F.col("gap")).cast("int")
    last = F.when(ends, F.col("n") - 1).otherwise(F.ceil(F.col("d1") / F.col("gap")).cast("int") - 1)
    s = s.withColumn("first", first).withColumn("last", F.least(last, F.col("n") - 1)).where("first <= last")
    p = s.withColumn("k", F.explode(F.sequence("first", "last")))
    dist = F.col("k") * F.col("gap")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dist - F.col("d0")) / (F.col("d1") - F.col("d0"))))
    more = [(F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy")] if with_direction else []
    return p.select("line_id", "k", dist.alias("dist"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"), *more)


def tangents(v: DataFrame, spacing: float) -> DataFrame:
    """(line_id, k, sin2, cos2): doubled-angle direction at even arc lengths."""
    a = 2 * F.atan2("dy", "dx")
    return resample(v, spacing, with_direction=True).select("line_id", "k", F.sin(a).alias("sin2"), F.cos(a).alias("cos2"))


def turn_rate(v: DataFrame, window: float) -> DataFrame:
    """(line_id, pos, rate): signed degrees a metre from the samples half a window before and after.

    The nearest vertices at or beyond the half window count; vertices that lack one side take the value
    interpolated by position between vertices that have both, or the nearest such value.
    """
    a = along(v)
    half = f"{window / 2!r}D"
    here = F.struct("pos", "x", "y", "dist")
    # both frames begin at the far end of the line and grow, so a vertex enters an aggregate once
    over = "(struct(pos, x, y, dist), pos) OVER (PARTITION BY line_id ORDER BY dist"
    a = a.withColumn("_l", F.expr(f"max_by{over} RANGE BETWEEN UNBOUNDED PRECEDING AND {half} PRECEDING)"))
    a = a.withColumn("_r", F.expr(f"min_by{over} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {half} PRECEDING)"))
    first, last = F.min_by(here, "pos").over(_line()), F.max_by(here, "pos").over(_line())
    a = a.withColumn("_l", F.coalesce("_l", first)).withColumn("_r", F.coalesce("_r", last))
    ax, ay, bx, by = F.col("x") - F.col("_l.x"), F.col("y") - F.col("_l.y"), F.col("_r.x") - F.col("x"), F.col("_r.y") - F.col("y")
    valid = (F.col("_l.pos") < F.col("pos")) & (F.col("_r.pos") > F.col("pos")) & (F.hypot(ax, ay) > 1e-9) & (F.hypot(bx, by) > 1e-9)
    gap = F.greatest(0.5 * (F.col("_r.dist") - F.col("_l.dist")), F.lit(1e-9))
    a = a.withColumn("_rate", F.when(valid, F.degrees(signed_turn(ax, ay, bx, by)) / gap))
    known = F.when(F.col("_rate").isNotNull(), F.struct("pos", F.col("_rate").alias("r")))
    before = F.last(known, True).over(_path().rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, True).over(_line().orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    a = a.withColumn("_p", before).withColumn("_q", after)
    mid = F.col("_p.r") + (F.col("_q.r") - F.col("_p.r")) * (F.col("pos") - F.col("_p.pos")) / (F.col("_q.pos") - F.col("_p.pos"))
    rate = F.when(F.col("_rate").isNotNull(), F.col("_rate")).when(F.col("_p").isNull(), F.col("_q.r")).when(F.col("_q").isNull(), F.col("_p.r")).otherwise(mid)
    return a.select("line_id", "pos", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def persistent_turn_rate(v: DataFrame, short: float, long: float) -> DataFrame:
    """(line_id, pos, rate): the smaller of two windows' rates where they do not disagree in sign, else 0."""
    a, b = turn_rate(v, short).withColumnRenamed("rate", "a"), turn_rate(v, long).withColumnRenamed("rate", "b")
    agree = (F.col("a") * F.col("b") >= 0) | (F.abs("a") < 1e-9) | (F.abs("b") < 1e-9)
    return a.join(b, ["line_id", "pos"]).select("line_id", "pos", F.when(agree, F.least(F.abs("a"), F.abs("b"))).otherwise(F.lit(0.0)).alias("rate"))


def weighted_filter(v: DataFrame, column: str, weights: list[float]) -> DataFrame:
    """(line_id, pos, smooth): a centred filter; weights are those of offsets 0, 1, ..., and the ends repeat."""
    total = weights[0] + 2 * sum(weights[1:])
    first, last = F.first(column).over(_path()), F.max_by(column, "pos").over(_line())
    value: Column = F.col(column) * weights[0]
    for k, w in enumerate(weights[1:], 1):
        value = value + F.coalesce(F.lag(column, k).over(_path()), first) * w + F.coalesce(F.lead(column, k).over(_path()), last) * w
    return v.select("line_id", "pos", (value / total).alias("smooth"))


def moving_average(v: DataFrame, column: str, width: int) -> DataFrame:
    """Mean over an odd number of vertices, the ends repeated."""
    return weighted_filter(v, column, [1.0] * (max(1, width) // 2 + 1))


def gaussian(v: DataFrame, column: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter with nearest padding."""
    radius = int(truncate * sigma + 0.5)
    return weighted_filter(v, column, [math.exp(-0.5 * (k / sigma) ** 2) for k in range(radius + 1)])


def dilate(v: DataFrame, flag: str, k: int) -> DataFrame:
    """v with a boolean column spread to k vertices on either side."""
    return v.withColumn(flag, F.max(F.col(flag)).over(_path().rowsBetween(-k, k)))


def runs(v: DataFrame, column: str) -> DataFrame:
    """(line_id, run_id, value, start_pos, end_pos): stretches of equal values."""
    start = F.when(F.lag(column).over(_path()).eqNullSafe(F.col(column)) & F.lag("pos").over(_path()).isNotNull(), 0).otherwise(1)
    marked = v.select("line_id", "pos", column, start.alias("_new"))
    numbered = marked.withColumn("run_id", F.sum("_new").over(_path().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("line_id", "run_id").agg(F.first(column).alias("value"), F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"))


def curve_class(v: DataFrame, tolerance: float) -> DataFrame:
    """(line_id, max_dev, class): the largest distance from the chord; GOOD up to tolerance or below four vertices."""
    ends = v.select("line_id", "pos", "x", "y", F.min_by(F.struct("x", "y"), "pos").over(_line()).alias("a"), F.max_by(F.struct("x", "y"), "pos").over(_line()).alias("b"))
    from rowloom.functions.scalar import point_segment_distance

    d = point_segment_distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    m = ends.groupBy("line_id").agg(F.max(d).alias("max_dev"), F.count(F.lit(1)).alias("n"))
    return m.where("n >= 2").select("line_id", "max_dev", F.when((F.col("max_dev") <= tolerance) | (F.col("n") < 4), "GOOD").otherwise("SUSPECT").alias("class"))


def chaikin(v: DataFrame, rounds: int = 1) -> DataFrame:
    """Corner cutting that keeps both ends; each round turns a segment into its quarter points."""
    for _ in range(rounds):
        nx, ny, n = F.lead("x").over(_path()), F.lead("y").over(_path()), F.max("pos").over(_line())
        s = v.select("line_id", "pos", "x", "y", nx.alias("nx"), ny.alias("ny"), n.alias("n"))
        x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
        here = F.struct(x.alias("x"), y.alias("y"))
        quarter = F.struct((0.75 * x + 0.25 * nx).alias("x"), (0.75 * y + 0.25 * ny).alias("y"))
        three = F.struct((0.25 * x + 0.75 * nx).alias("x"), (0.25 * y + 0.75 * ny).alias("y"))
        made = F.when(F.col("nx").isNull(), F.array(here)).when(F.col("pos") == 0, F.array(here, quarter, three)).otherwise(F.array(quarter, three))
        p = s.select("line_id", "pos", F.posexplode(made).alias("i", "p"))
        v = p.select("line_id", (F.when(F.col("pos") == 0, F.col("i")).otherwise(2 * F.col("pos") + 1 + F.col("i"))).alias("pos"), "p.x", "p.y")
    return v


def hairpins(v: DataFrame, least_length: float = 1.0, max_ratio: float = 0.35, least_turn: float = 120.0) -> DataFrame:
    """(line_id, endpoint_ratio, total_turn, has_hairpin)."""
    m = turns(along(v)).groupBy("line_id").agg(
        F.sum("step").alias("length"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("total_turn"),
        F.hypot(F.max_by("x", "pos") - F.min_by("x", "pos"), F.max_by("y", "pos") - F.min_by("y", "pos")).alias("chord"),
    )
    ratio = F.when(F.col("length") > 0, F.col("chord") / F.col("length")).otherwise(F.lit(1.0))
    return m.select("line_id", ratio.alias("endpoint_ratio"), "total_turn", ((F.col("length") >= least_length) & (ratio <= max_ratio) & (F.col("total_turn") >= least_turn)).alias("has_hairpin"))
