"""Queries along lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import lines as ops
from rowloom.plans.views import v_lines, v_polys, with_views

#: Spacing of resampled points; half width and threshold of the class runs; tolerance of the curve class.
SPACING, LEVEL, TOLERANCE = 7.5, 50.0, 3.0


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def line_quality_report(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.quality(v_lines(s, d)), "length", "chord_ratio", "max_turn", "p95_turn", "kink_fraction")


def line_bearing_pca(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.bearing_pca(v_lines(s, d)), "bearing_deg")


def line_bearing_chord(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.bearing_chord(v_polys(s, d)), "bearing_deg")


def line_sign_inversions(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.sign_inversions(v_lines(s, d)), "inversions_per_m", digits=9)


def line_resample(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.resample(v_polys(s, d), SPACING), "dist", "x", "y")


def line_turn_rate_window(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.persistent_turn_rate(v_lines(s, d), 200.0, 400.0), "rate")


def line_moving_average(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.moving_average(v_lines(s, d), "y", 5).withColumnRenamed("smooth", "y_smooth"), "y_smooth")


def line_gaussian(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.gaussian(v_lines(s, d), "y", 1.0, 3.0).withColumnRenamed("smooth", "y_smooth"), "y_smooth")


def line_class_runs(s: SparkSession, d: str) -> DataFrame:
    v = ops.dilate(v_lines(s, d).withColumn("high", F.col("y") > LEVEL), "high", 1)
    return ops.runs(v.withColumn("class", F.col("high").cast("int")), "class").withColumnRenamed("value", "class")


def line_curve_class(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.curve_class(v_polys(s, d), TOLERANCE), "max_dev")


def line_chaikin(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.chaikin(v_polys(s, d), 2), "x", "y")


def line_hairpin(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.hairpins(v_lines(s, d)), "endpoint_ratio", "total_turn")


def line_tangents(s: SparkSession, d: str) -> DataFrame:
    return rounded(ops.tangents(v_polys(s, d), SPACING), "sin2", "cos2")


def dedupe_vertices(s: SparkSession, d: str) -> DataFrame:
    v = v_polys(s, d).withColumn("x", F.floor(F.col("x") / 40)).withColumn("y", F.floor(F.col("y") / 6))
    before = v.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_before"))
    after = ops.drop_repeated(v).groupBy("line_id").agg(F.count(F.lit(1)).alias("n_after"))
    return before.join(after, "line_id")


_ALL = (
    line_quality_report, line_bearing_pca, line_bearing_chord, line_sign_inversions, line_resample, line_turn_rate_window, line_moving_average,
    line_gaussian, line_class_runs, line_curve_class, line_chaikin, line_hairpin, line_tangents, dedupe_vertices,
)
QUERIES = {f.__name__: f for f in _ALL}


def _r(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 AS {name or c}"


def _segments(view: str) -> str:
    """DuckDB: steps, arc lengths and turns of a view's lines."""
    return f"""a AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {view} WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
b AS (SELECT *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS step,
        sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) AS sizes, (x - px) * (nx - x) + (y - py) * (ny - y) AS dot,
        (x - px) * (ny - y) - (y - py) * (nx - x) AS crs FROM a),
t AS (SELECT *, CASE WHEN sizes > 0 THEN degrees(acos(greatest(-1.0, least(1.0, dot / sizes)))) END AS turn, CASE WHEN sizes > 0 THEN degrees(atan2(crs, dot)) END AS bend FROM b)"""


def _rate(window: float) -> str:
    h = window / 2
    return f"""SELECT line_id, pos, CASE WHEN r IS NOT NULL THEN r WHEN p IS NULL THEN coalesce(q.r, 0) WHEN q IS NULL THEN p.r
          ELSE p.r + (q.r - p.r) * (pos - p.pos) / (q.pos - p.pos) END AS rate FROM (
        SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
                  first_value(k IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM (
        SELECT *, CASE WHEN r IS NOT NULL THEN {{'pos': pos, 'r': r}} END AS k FROM (
        SELECT *, CASE WHEN l.pos < pos AND g.pos > pos AND sqrt((x - l.x) ** 2 + (y - l.y) ** 2) > 1e-9 AND sqrt((g.x - x) ** 2 + (g.y - y) ** 2) > 1e-9
          THEN degrees(atan2((x - l.x) * (g.y - y) - (y - l.y) * (g.x - x), (x - l.x) * (g.x - x) + (y - l.y) * (g.y - y))) / greatest(0.5 * (g.dist - l.dist), 1e-9) END AS r FROM (
        SELECT line_id, pos, x, y, coalesce(arg_max(h, pos) OVER (PARTITION BY line_id ORDER BY dist RANGE BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING), arg_min(h, pos) OVER (PARTITION BY line_id)) AS l,
               coalesce(arg_min(h, pos) OVER (PARTITION BY line_id ORDER BY dist RANGE BETWEEN {h} FOLLOWING AND UNBOUNDED FOLLOWING), arg_max(h, pos) OVER (PARTITION BY line_id)) AS g FROM (
        SELECT *, {{'pos': pos, 'x': x, 'y': y, 'dist': dist}} AS h FROM c)))))"""


_DIST = "c AS (SELECT *, sum(step) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS dist FROM t)"


def points_sql(view: str, spacing: float) -> str:
    """DuckDB: p(line_id, k, dist, x0, y0, x1, y1, u), the even samples of a view's lines; begins a WITH clause."""
    return f"""WITH {_segments(view)}, {_DIST},
s AS (SELECT line_id, pos, x AS x0, y AS y0, nx AS x1, ny AS y1, dist AS d0, lead(dist) OVER (PARTITION BY line_id ORDER BY pos) AS d1, max(dist) OVER (PARTITION BY line_id) AS length FROM c),
n AS (SELECT *, greatest(2, ceil(length / {spacing!r}::DOUBLE)::INT + 1) AS n FROM s WHERE length > 0 AND d1 > d0),
g AS (SELECT *, length / (n - 1) AS gap FROM n),
f AS (SELECT *, unnest(range(ceil(d0 / gap)::INT, least(CASE WHEN d1 = length THEN n - 1 ELSE ceil(d1 / gap)::INT - 1 END, n - 1) + 1))::INT AS k FROM g),
p AS (SELECT line_id, k, k * gap AS dist, x0, y0, x1, y1, greatest(0.0, least(1.0, (k * gap - d0) / (d1 - d0))) AS u FROM f) """


_POINTS = points_sql("v_polys", SPACING)


def _filter(weights: list[float]) -> str:
    first = "first_value(y) OVER (PARTITION BY line_id ORDER BY pos)"
    last = "last_value(y) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    w = "OVER (PARTITION BY line_id ORDER BY pos)"
    terms = [f"y * {weights[0]!r}::DOUBLE"] + [f"coalesce(lag(y, {k}) {w}, {first}) * {c!r}::DOUBLE + coalesce(lead(y, {k}) {w}, {last}) * {c!r}::DOUBLE" for k, c in enumerate(weights[1:], 1)]
    return f"SELECT line_id, pos, {_r(f'({' + '.join(terms)}) / {weights[0] + 2 * sum(weights[1:])!r}::DOUBLE', 'y_smooth')} FROM v_lines"


def _chaikin(source: str) -> str:
    return f"""SELECT line_id, CASE WHEN pos = 0 THEN i - 1 ELSE 2 * pos + i END AS pos, p.x AS x, p.y AS y FROM (
        SELECT line_id, pos, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS p FROM (
        SELECT line_id, pos, CASE WHEN nx IS NULL THEN [{{'x': x, 'y': y}}] WHEN pos = 0 THEN [{{'x': x, 'y': y}}, {{'x': 0.75::DOUBLE * x + 0.25::DOUBLE * nx, 'y': 0.75::DOUBLE * y + 0.25::DOUBLE * ny}}, {{'x': 0.25::DOUBLE * x + 0.75::DOUBLE * nx, 'y': 0.25::DOUBLE * y + 0.75::DOUBLE * ny}}]
          ELSE [{{'x': 0.75::DOUBLE * x + 0.25::DOUBLE * nx, 'y': 0.75::DOUBLE * y + 0.25::DOUBLE * ny}}, {{'x': 0.25::DOUBLE * x + 0.75::DOUBLE * nx, 'y': 0.25::DOUBLE * y + 0.75::DOUBLE * ny}}] END AS m FROM (
        SELECT *, lead(x) OVER (PARTITION BY line_id ORDER BY pos) AS nx, lead(y) OVER (PARTITION BY line_id ORDER BY pos) AS ny FROM ({source}))))"""


import math as _math  # noqa: E402

_CHORD = "sqrt((arg_max(x, pos) - arg_min(x, pos)) ** 2 + (arg_max(y, pos) - arg_min(y, pos)) ** 2)"
ORACLES = {
    "line_quality_report": with_views(
        f"""WITH {_segments("v_lines")}, m AS (SELECT line_id, count(*) AS n_vertices, sum(step) AS length, {_CHORD} AS chord, coalesce(max(turn), 0) AS max_turn,
        coalesce(quantile_cont(turn, 0.95), 0) AS p95_turn, coalesce(avg(CASE WHEN turn > 12 THEN 1.0 WHEN turn IS NOT NULL THEN 0.0 END), 0) AS kink_fraction FROM t GROUP BY line_id)
        SELECT line_id, n_vertices, {_r("length")}, {_r("CASE WHEN length > 0 THEN chord / length ELSE 0 END", "chord_ratio")}, {_r("max_turn")}, {_r("p95_turn")}, {_r("kink_fraction")},
        CASE WHEN length >= 4 AND max_turn <= 10 AND p95_turn <= 6 AND kink_fraction <= 0.02 THEN 'GOOD' WHEN n_vertices >= 2 AND length >= 1 THEN 'SUSPECT' ELSE 'INVALID' END AS quality FROM m""",
        "v_lines",
    ),
    "line_bearing_pca": with_views(
        f"""SELECT line_id, {_r("(degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) + 180) % 180", "bearing_deg")} FROM (
        SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM v_lines) WHERE n <= 20 OR pos = n - 1 OR pos IN (SELECT floor(k * ((n - 1) / 19.0::DOUBLE))::BIGINT FROM (SELECT unnest(range(0, 19)) AS k)) GROUP BY line_id""", "v_lines"
    ),
    "line_bearing_chord": with_views(
        f"""SELECT line_id, {_r("(degrees(atan2(arg_max(y, pos) - arg_min(y, pos), arg_max(x, pos) - arg_min(x, pos))) + 360) % 180", "bearing_deg")}
        FROM v_polys GROUP BY line_id HAVING count(*) >= 2""",
        "v_polys",
    ),
    "line_sign_inversions": with_views(
        f"""WITH {_segments("v_lines")}, l AS (SELECT line_id, sum(step) AS length FROM t GROUP BY line_id),
        f AS (SELECT line_id, sum((s * ps < 0)::INT) AS n FROM (SELECT line_id, sign(bend) AS s, lag(sign(bend)) OVER (PARTITION BY line_id ORDER BY pos) AS ps FROM t WHERE abs(bend) >= 0.5) GROUP BY line_id)
        SELECT line_id, coalesce(n, 0)::BIGINT AS inversions, {_r("CASE WHEN length > 0 THEN coalesce(n, 0) / length ELSE 0 END", "inversions_per_m", 9)} FROM l LEFT JOIN f USING (line_id)""",
        "v_lines",
    ),
    "line_resample": with_views(_POINTS + f"SELECT line_id, k, {_r('dist')}, {_r('x0 + u * (x1 - x0)', 'x')}, {_r('y0 + u * (y1 - y0)', 'y')} FROM p", "v_polys"),
    "line_tangents": with_views(_POINTS + f"SELECT line_id, k, {_r('sin(2 * atan2(y1 - y0, x1 - x0))', 'sin2')}, {_r('cos(2 * atan2(y1 - y0, x1 - x0))', 'cos2')} FROM p", "v_polys"),
    "line_turn_rate_window": with_views(
        f"""WITH {_segments("v_lines")}, {_DIST}, ra AS ({_rate(200.0)}), rb AS ({_rate(400.0)})
        SELECT line_id, pos, {_r("CASE WHEN ra.rate * rb.rate >= 0 OR abs(ra.rate) < 1e-9 OR abs(rb.rate) < 1e-9 THEN least(abs(ra.rate), abs(rb.rate)) ELSE 0 END", "rate")} FROM ra JOIN rb USING (line_id, pos)""",
        "v_lines",
    ),
    "line_moving_average": with_views(_filter([1.0, 1.0, 1.0]), "v_lines"),
    "line_gaussian": with_views(_filter([_math.exp(-0.5 * k**2) for k in range(4)]), "v_lines"),
    "line_class_runs": with_views(
        f"""WITH d AS (SELECT line_id, pos, max((y > {LEVEL})::INT) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS class FROM v_lines),
        n AS (SELECT *, CASE WHEN lag(class) OVER (PARTITION BY line_id ORDER BY pos) = class THEN 0 ELSE 1 END AS fresh FROM d),
        r AS (SELECT *, (sum(fresh) OVER (PARTITION BY line_id ORDER BY pos) - 1)::BIGINT AS run_id FROM n)
        SELECT line_id, run_id, any_value(class) AS class, min(pos) AS start_pos, max(pos) AS end_pos FROM r GROUP BY line_id, run_id""",
        "v_lines",
    ),
    "line_curve_class": with_views(
        f"""WITH e AS (SELECT *, first_value(x) OVER w AS ax, first_value(y) OVER w AS ay, last_value(x) OVER w AS ex, last_value(y) OVER w AS ey
        FROM v_polys WINDOW w AS (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        u AS (SELECT *, (ex - ax) ** 2 + (ey - ay) ** 2 AS size FROM e),
        q AS (SELECT *, CASE WHEN size > 0 THEN greatest(0.0, least(1.0, ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / size)) ELSE 0 END AS f FROM u),
        m AS (SELECT line_id, count(*) AS n, max(sqrt((x - ax - f * (ex - ax)) ** 2 + (y - ay - f * (ey - ay)) ** 2)) AS d FROM q GROUP BY line_id)
        SELECT line_id, {_r("d", "max_dev")}, CASE WHEN d <= {TOLERANCE} OR n < 4 THEN 'GOOD' ELSE 'SUSPECT' END AS class FROM m WHERE n >= 2""",
        "v_polys",
    ),
    "line_chaikin": with_views(f"SELECT line_id, pos, {_r('x')}, {_r('y')} FROM ({_chaikin(_chaikin('SELECT * FROM v_polys'))})", "v_polys"),
    "line_hairpin": with_views(
        f"""WITH {_segments("v_lines")}, m AS (SELECT line_id, sum(step) AS length, coalesce(sum(turn), 0) AS total_turn, {_CHORD} AS chord FROM t GROUP BY line_id),
        r AS (SELECT *, CASE WHEN length > 0 THEN chord / length ELSE 1 END AS ratio FROM m)
        SELECT line_id, {_r("ratio", "endpoint_ratio")}, {_r("total_turn")}, length >= 1 AND ratio <= 0.35 AND total_turn >= 120 AS has_hairpin FROM r""",
        "v_lines",
    ),
    "dedupe_vertices": with_views(
        """WITH g AS (SELECT line_id, pos, floor(x / 40) AS x, floor(y / 6) AS y FROM v_polys),
        r AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, pos = 0 AS f FROM g WINDOW w AS (PARTITION BY line_id ORDER BY pos))
        SELECT line_id, count(*) AS n_before, count(*) FILTER (f OR px <> x OR py <> y) AS n_after FROM r GROUP BY line_id""",
        "v_polys",
    ),
}
