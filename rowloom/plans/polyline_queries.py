"""Queries over networks of polylines, and their SQL by brute force in a band of y."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import lines, polylines
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.network_queries import _MATCH, _SC, SPACING, _psd, _two_medians
from rowloom.plans.views import v_bent, v_parts, v_polys, with_views

RANGES = ("intra_center", "inter_center", "intra_min", "intra_max", "inter_min", "inter_max")


def rows_only(s: SparkSession, d: str) -> DataFrame:
    return v_bent(s, d).where("line_id < 1000000")


def polyline_pair_candidates(s: SparkSession, d: str) -> DataFrame:
    found = polylines.pair_scores(rows_only(s, d), SPACING).where("ok").select("i", "j", "distance", "angle", "overlap", "confidence")
    return rounded(found, "distance", "angle", "overlap", "confidence")


def polyline_pairs(s: SparkSession, d: str) -> DataFrame:
    return polylines.pair_lines(rows_only(s, d), SPACING).select("row_id", "pair_id", "pair_status", "inter_status")


def polyline_spacing(s: SparkSession, d: str) -> DataFrame:
    """Spacing clusters of at most 300 lines, even by number."""
    from rowloom.operators import network

    return rounded(network.spacing_clusters(polylines.spacing_samples(rows_only(s, d), most=300)), *RANGES)


def polyline_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Which lines stay, and the line that tells a dropped one."""
    return rounded(polylines.drop_duplicates(v_bent(s, d)), "distance")


def polyline_tracks(s: SparkSession, d: str) -> DataFrame:
    found = polylines.build_tracks(v_parts(s, d), lines.quality(v_parts(s, d)).select("line_id", "quality"))
    return rounded(found, "bearing", "total_length")


def polyline_quality(s: SparkSession, d: str) -> DataFrame:
    """Quality of the orders' lines; one that meets itself is not GOOD."""
    v = v_polys(s, d).withColumns({"x": F.col("x") * 0.2 * (1 + F.col("pos") % 2), "y": F.col("y") * 0.2})
    q = lines.quality(v, max_turn=170.0, max_p95=170.0, kink=170.0, knotted=polylines.self_contacts(v, 4.0))
    return rounded(q.select("line_id", "length", "max_turn", "quality"), "length", "max_turn", digits=4)


def _tracks(s: SparkSession, d: str) -> DataFrame:
    return polylines.build_tracks(v_parts(s, d))


def polyline_bridges(s: SparkSession, d: str) -> DataFrame:
    """Vertices of the lines that the parts of each track make."""
    return rounded(polylines.bridge_tracks(v_parts(s, d), _tracks(s, d), max_gap=3.0, max_lateral=0.5), "x", "y")


def polyline_contacts(s: SparkSession, d: str) -> DataFrame:
    """Lines that touch another once all are moved half a metre up, and did not before."""
    from rowloom.operators import network

    v = v_bent(s, d)
    moved = v.withColumn("y", F.col("y") + 0.5 * (F.col("line_id") % 3))
    return network.contacts_added(polylines.contacts(v, v), polylines.contacts(moved, v))


def polyline_lineage(s: SparkSession, d: str) -> DataFrame:
    """The lines within .3 of each original row, all copies among them; the nearest one elsewhere."""
    v = v_bent(s, d)
    far = v.where("line_id < 1000000").withColumn("y", F.col("y") + F.when(F.col("line_id") % 5 == 0, 0.4).otherwise(0.0))
    return polylines.attach_lineage(far, v.where("line_id >= 1000000"), 0.3).select("line_id", F.array_join("raw_ids", ",").alias("raw_ids"))


def polyline_displacement(s: SparkSession, d: str) -> DataFrame:
    v = v_bent(s, d)
    lineage = v.where("line_id >= 2000000").select("line_id", (F.col("line_id") - 2000000).alias("raw_id")).distinct()
    return rounded(polylines.displacement(lineage, v.where("line_id >= 2000000"), v.where("line_id < 1000000"), 0.5), "displacement")


_ALL = (
    polyline_pair_candidates, polyline_pairs, polyline_spacing, polyline_duplicates, polyline_quality, polyline_tracks, polyline_bridges, polyline_contacts, polyline_lineage, polyline_displacement,
)
QUERIES = {f.__name__: f for f in _ALL}


def _lines(source: str, p: str = "") -> str:
    """DuckDB: segments psg and lines pln of a source of vertices."""
    return f"""{p}vx AS MATERIALIZED (SELECT * FROM ({source})),
{p}st AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM {p}vx WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
{p}di AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS d0, sum(coalesce(step, 0)) OVER (PARTITION BY line_id) AS length FROM {p}st),
{p}sg AS MATERIALIZED (SELECT line_id, pos, x AS x0, y AS y0, nx AS x1, ny AS y1, d0, d0 + sqrt((nx - x) ** 2 + (ny - y) ** 2) AS d1, length FROM {p}di WHERE nx IS NOT NULL),
{p}ln AS MATERIALIZED (SELECT line_id, any_value(length) AS length, (degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) + 180) % 180 AS bearing, count(*) AS n FROM {p}di GROUP BY line_id)"""


def _gap(l: str, r: str) -> str:  # noqa: E741
    near = f"least({_psd(f'{l}.x0', f'{l}.y0', r)}, {_psd(f'{l}.x1', f'{l}.y1', r)}, {_psd(f'{r}.x0', f'{r}.y0', l)}, {_psd(f'{r}.x1', f'{r}.y1', l)})"
    side = lambda s, x, y: f"(({s}.x1 - {s}.x0) * ({y} - {s}.y0) - ({s}.y1 - {s}.y0) * ({x} - {s}.x0))"
    d1, d2, d3, d4 = side(l, f"{r}.x0", f"{r}.y0"), side(l, f"{r}.x1", f"{r}.y1"), side(r, f"{l}.x0", f"{l}.y0"), side(r, f"{l}.x1", f"{l}.y1")
    return f"CASE WHEN {d1} * {d2} <= 0 AND {d3} * {d4} <= 0 AND ({d1} <> 0 OR {d2} <> 0) THEN 0 ELSE {near} END"


def _near(radius: float, on: str = "l.line_id < r.line_id", a: str = "", b: str = "") -> str:
    """DuckDB: nr(i, j, nearest) of lines within radius."""
    return f"""nr AS MATERIALIZED (SELECT i, j, min(g) AS nearest FROM (SELECT l.line_id AS i, r.line_id AS j, {_gap('l', 'r')} AS g FROM {a}sg l JOIN {b}sg r ON {on} AND r.y0 BETWEEN l.y0 - {radius + 1} AND l.y0 + {radius + 1}
        AND r.x0 BETWEEN l.x0 - {radius + 30} AND l.x0 + {radius + 30}) WHERE g <= {radius!r}::DOUBLE GROUP BY i, j)"""


_EVEN = """ev AS MATERIALIZED (SELECT e.line_id, k, x0 + greatest(0.0, least(1.0, (a - d0) / (d1 - d0))) * (x1 - x0) AS x, y0 + greatest(0.0, least(1.0, (a - d0) / (d1 - d0))) * (y1 - y0) AS y FROM (
  SELECT line_id, n, length, unnest(range(0, n)) AS k, unnest(range(0, n)) * length / (n - 1) AS a FROM (SELECT line_id, length, greatest(2, least(20, floor(length)))::INT AS n FROM ln WHERE length > 0)) e
  JOIN sg s ON s.line_id = e.line_id AND ((a >= d0 AND a < d1 AND k < n - 1) OR (k = n - 1 AND d1 >= e.length - 1e-9 AND d0 < d1)))"""


def _measured(points: str) -> str:
    """DuckDB: m(i, j, distance, mean, angle, overlap) of the pairs nr, from points (line_id, k, x, y)."""
    t = f"greatest(0.0, least(1.0, ((q.x - s.x0) * (s.x1 - s.x0) + (q.y - s.y0) * (s.y1 - s.y0)) / ((s.x1 - s.x0) ** 2 + (s.y1 - s.y0) ** 2)))"
    return f"""bo AS (SELECT i, j, CASE WHEN round(a.length, 9) <= round(b.length, 9) THEN i ELSE j END AS p, CASE WHEN round(a.length, 9) <= round(b.length, 9) THEN j ELSE i END AS t, least(a.length, b.length) AS short,
  least(abs(a.bearing - b.bearing) % 180, 180 - abs(a.bearing - b.bearing) % 180) AS angle FROM nr JOIN ln a ON a.line_id = i JOIN ln b ON b.line_id = j),
ag AS (SELECT i, j, k, min({{'d': round({_psd('q.x', 'q.y', 's')}, 12), 'sp': s.pos, 'at': s.d0 + {t} * (s.d1 - s.d0)}}) AS m FROM bo JOIN {points} q ON q.line_id = p JOIN sg s ON s.line_id = t GROUP BY i, j, k),
mm AS (SELECT i, j, median(m.d) AS distance, avg(m.d) AS mean, abs(arg_max(m.at, k) - arg_min(m.at, k)) AS span FROM ag GROUP BY i, j),
m AS MATERIALIZED (SELECT i, j, distance, mean, angle, span / short AS overlap FROM bo JOIN mm USING (i, j))"""


_ROWS = "SELECT * FROM v_bent WHERE line_id < 1000000"
_SCORED = f"{_lines(_ROWS)}, {_near(SPACING.reach)}, {_EVEN}, {_measured('ev')}, {_SC}"
_ENDS = """pe AS (SELECT line_id, first(x ORDER BY pos) AS ax, first(y ORDER BY pos) AS ay, first(x - nx ORDER BY pos) AS aux, first(y - ny ORDER BY pos) AS auy,
  last(x ORDER BY pos) AS bx, last(y ORDER BY pos) AS by_, last(x - px ORDER BY pos) AS bux, last(y - py ORDER BY pos) AS buy FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM di WINDOW w AS (PARTITION BY line_id ORDER BY pos)) GROUP BY line_id)"""
_TRACKS = f"""{_lines('SELECT * FROM v_parts')}, {_near(6.0)}, {_ENDS},
ee AS (SELECT line_id, 0 AS e, ax AS x, ay AS y, aux AS ux, auy AS uy FROM pe UNION ALL SELECT line_id, 1, bx, by_, bux, buy FROM pe),
pq AS (SELECT i, j, a.e AS ae, b.e AS be, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS gap, b.x - a.x AS cx, b.y - a.y AS cy, a.ux AS aux, a.uy AS auy, b.ux AS bux, b.uy AS buy FROM nr JOIN ee a ON a.line_id = i JOIN ee b ON b.line_id = j),
bq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY gap, ae, be) AS k FROM pq) WHERE k = 1 AND gap > 1e-9 AND gap <= 6),
lk AS MATERIALIZED (SELECT i AS a, j AS b FROM (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (aux * cx + auy * cy) / (sqrt(aux ** 2 + auy ** 2) * gap))))) AS u, degrees(acos(greatest(-1.0, least(1.0, (-bux * cx - buy * cy) / (sqrt(bux ** 2 + buy ** 2) * gap))))) AS w FROM bq)
  JOIN ln a ON a.line_id = i JOIN ln b ON b.line_id = j WHERE u <= 10 AND w <= 10 AND least(abs(a.bearing - b.bearing) % 180, 180 - abs(a.bearing - b.bearing) % 180) <= 8 AND gap * sin(radians(least(u, w))) <= 0.18::DOUBLE),
bi AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
rc(v, root) AS (SELECT line_id, line_id FROM ln UNION SELECT bi.b, root FROM rc JOIN bi ON bi.a = rc.v),
tk AS MATERIALIZED (SELECT v AS line_id, min(root) AS track_id FROM rc GROUP BY v)"""
_QUALITY = f"""tn AS (SELECT line_id, sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) AS sizes, (x - px) * (nx - x) + (y - py) * (ny - y) AS dot FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM di WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE px IS NOT NULL AND nx IS NOT NULL),
qa AS (SELECT line_id, length >= 4 AND mt <= 10 AND p95 <= 6 AND kf <= 0.02 AS good FROM ln JOIN (SELECT line_id, max(t) AS mt, quantile_cont(t, 0.95) AS p95, avg((t > 12)::INT) AS kf FROM (SELECT line_id, degrees(acos(greatest(-1.0, least(1.0, dot / sizes)))) AS t FROM tn) GROUP BY line_id) USING (line_id))"""

ORACLES = {
    "polyline_pair_candidates": with_views(f"WITH {_SCORED} SELECT i, j, {_r('distance')}, {_r('angle')}, {_r('overlap')}, {_r('confidence')} FROM sc WHERE ok", "v_bent"),
    "polyline_pairs": with_views(f"WITH RECURSIVE {_SCORED}, {_MATCH} SELECT * FROM asg", "v_bent"),
    "polyline_spacing": with_views(
        f"""WITH {_lines(_ROWS)}, od AS (SELECT line_id, row_number() OVER (ORDER BY line_id) - 1 AS p, count(*) OVER () AS c FROM ln),
        ch AS (SELECT line_id FROM od WHERE c <= 300 OR p = c - 1 OR p IN (SELECT floor(k * ((c - 1) / 299.0::DOUBLE))::BIGINT FROM (SELECT unnest(range(0, 299)) AS k), (SELECT any_value(c) AS c FROM od))),
        {_near(2.5)}, {_EVEN}, {_measured('ev')}, ok AS (SELECT i, j, distance FROM m WHERE angle <= 10 AND overlap >= 0.35 AND distance > 0 AND distance <= 2.5),
        bt AS (SELECT * FROM ok UNION ALL SELECT j, i, distance FROM ok), top AS (SELECT distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS k FROM bt WHERE i IN (FROM ch)) WHERE k <= 2),
        qs AS (SELECT quantile_cont(distance, 0.02) AS lo, quantile_cont(distance, 0.98) AS hi FROM top), v AS MATERIALIZED (SELECT distance AS v FROM top, qs WHERE distance BETWEEN lo AND hi), {_two_medians(10)},
        s AS (SELECT any_value(a) AS a, any_value(b) AS b, count(*) AS n, median(abs(v - a)) FILTER (abs(v - a) <= abs(v - b)) AS ma, median(abs(v - b)) FILTER (abs(v - a) > abs(v - b)) AS mb FROM v, c10),
        h AS (SELECT *, greatest(0.05, 0.10 * a, 3 * 1.4826 * ma) AS ha, greatest(0.05, 0.10 * b, 3 * 1.4826 * mb) AS hb FROM s)
        SELECT {_r('a', 'intra_center')}, {_r('b', 'inter_center')}, {_r('a - ha', 'intra_min')}, {_r('least(a + ha, (a + b) / 2 - 0.01)', 'intra_max')},
        {_r('greatest(b - hb, (a + b) / 2 + 0.01)', 'inter_min')}, {_r('b + hb', 'inter_max')}, n AS n_samples FROM h WHERE a - ha > 0""",
        "v_bent",
    ),
    "polyline_duplicates": with_views(
        f"""WITH RECURSIVE {_lines('SELECT * FROM v_bent')}, {_near(0.20)}, pt AS (SELECT line_id, pos AS k, x, y FROM vx), {_measured('pt')},
        lk AS MATERIALIZED (SELECT i, j, mean FROM m WHERE mean < 0.20 AND angle <= 5 AND overlap >= 0.70),
        nd AS MATERIALIZED (SELECT line_id AS id, row_number() OVER (ORDER BY round(-length, 6), line_id) AS k FROM ln),
        ar AS MATERIALIZED (SELECT greatest(a.k, b.k) AS k, list(least(a.k, b.k)) AS before FROM lk JOIN nd a ON a.id = i JOIN nd b ON b.id = j GROUP BY 1),
        touched AS MATERIALIZED (SELECT k, before, row_number() OVER (ORDER BY k) AS n FROM ar),
        walk(n, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
          SELECT t.n, CASE WHEN len(list_filter(t.before, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, t.k) ELSE dropped END FROM walk w JOIN touched t ON t.n = w.n + 1),
        fin AS (SELECT dropped FROM walk ORDER BY n DESC LIMIT 1), kp AS (SELECT id, NOT list_contains(dropped, k) AS kept FROM nd, fin),
        bl AS (SELECT i AS a, j AS b, mean FROM lk UNION ALL SELECT j, i, mean FROM lk), bs AS (SELECT a, min({{'m': round(mean, 9), 'b': b}}) AS s FROM bl JOIN kp ON kp.id = b AND kept GROUP BY a)
        SELECT id AS line_id, kept, CASE WHEN kept THEN id ELSE s.b END AS kept_by, round(CASE WHEN NOT kept THEN s.m END, 6) + 0.0 AS distance FROM kp LEFT JOIN bs ON a = id""",
        "v_bent",
    ),
    "polyline_tracks": with_views(
        f"""WITH RECURSIVE {_TRACKS}, {_QUALITY}, w AS (SELECT track_id, (round(degrees(0.5 * atan2(sum(length * sin(radians(2 * bearing))), sum(length * cos(radians(2 * bearing))))), 9) + 180) % 180 AS bearing, sum(length) AS total_length,
          CASE WHEN count(*) = 1 AND bool_and(good) THEN 'GOOD' ELSE 'SUSPECT' END AS track_quality FROM tk JOIN ln USING (line_id) LEFT JOIN qa USING (line_id) GROUP BY track_id)
        SELECT line_id, track_id, {_r('bearing')}, {_r('total_length')}, track_quality FROM tk JOIN w USING (track_id)""",
        "v_parts",
    ),
    "polyline_bridges": with_views(
        f"""WITH RECURSIVE {_TRACKS}, ch AS (SELECT line_id, first(x ORDER BY pos) AS ax, first(y ORDER BY pos) AS ay, last(x ORDER BY pos) AS bx, last(y ORDER BY pos) AS by_, max(pos) AS last FROM vx GROUP BY line_id),
        cq AS (SELECT *, (degrees(atan2(by_ - ay, bx - ax)) + 360) % 180 AS q FROM ch JOIN tk USING (line_id)), mn AS (SELECT track_id, degrees(0.5 * atan2(sum(sin(radians(2 * q))), sum(cos(radians(2 * q))))) AS mean FROM cq GROUP BY track_id),
        md AS (SELECT track_id, radians(((any_value(mean) + median((q - mean + 90 + 360) % 180 - 90)) + 360) % 180) AS t FROM cq JOIN mn USING (track_id) GROUP BY track_id),
        tn AS (SELECT *, (bx - ax) * cos(t) + (by_ - ay) * sin(t) < 0 AS back FROM cq JOIN md USING (track_id)),
        pp AS (SELECT v.line_id, track_id, CASE WHEN back THEN last - pos ELSE pos END AS pos, x, y, x * cos(t) + y * sin(t) AS s, y * cos(t) - x * sin(t) AS o FROM vx v JOIN tn USING (line_id)),
        en AS (SELECT track_id, line_id, arg_min({{'x': x, 'y': y, 's': s, 'o': o}}, pos) AS a, arg_max({{'x': x, 'y': y, 's': s, 'o': o}}, pos) AS b FROM pp GROUP BY 1, 2),
        lg AS (SELECT *, lag(b) OVER (PARTITION BY track_id ORDER BY a.s, line_id) AS f, row_number() OVER (PARTITION BY track_id ORDER BY a.s, line_id) AS place FROM en),
        jn AS (SELECT *, coalesce(a.s - f.s BETWEEN -0.5 AND 3 AND abs(a.o - f.o) <= 0.5, false) AS j FROM lg), rn AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY track_id ORDER BY place) AS run FROM jn),
        ci AS (SELECT *, min(line_id) OVER (PARTITION BY track_id, run) AS chain, count(*) OVER (PARTITION BY track_id, run) AS n_parts FROM rn),
        br AS (SELECT *, sqrt((a.x - f.x) ** 2 + (a.y - f.y) ** 2) AS size FROM ci WHERE j), bk AS (SELECT *, greatest(2, ceil(size / 0.5)::INT + 1) AS k FROM br WHERE size > 0.05), bp AS (SELECT *, unnest(range(1, k - 1)) AS i FROM bk),
        al AS (SELECT chain, n_parts, place, 1 AS own, pos, x, y FROM pp JOIN ci USING (track_id, line_id) UNION ALL SELECT chain, n_parts, place, 0, i, f.x + i / (k - 1) * (a.x - f.x), f.y + i / (k - 1) * (a.y - f.y) FROM bp),
        mv AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS mv FROM al WINDOW w AS (PARTITION BY chain ORDER BY place, own, pos))
        SELECT chain AS line_id, row_number() OVER (PARTITION BY chain ORDER BY place, own, pos) - 1 AS pos, {_r('x')}, {_r('y')}, n_parts FROM mv WHERE mv IS NULL OR mv > 1e-4""",
        "v_parts",
    ),
    "polyline_quality": with_views(
        f"""WITH {_lines('SELECT line_id, pos, x * 0.2::DOUBLE * (1 + pos % 2) AS x, y * 0.2::DOUBLE AS y FROM v_polys')},
        tn AS (SELECT line_id, CASE WHEN sizes > 0 THEN degrees(acos(greatest(-1.0, least(1.0, dot / sizes)))) END AS t FROM (SELECT line_id, sqrt((x - px) ** 2 + (y - py) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) AS sizes, (x - px) * (nx - x) + (y - py) * (ny - y) AS dot
          FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM di WINDOW w AS (PARTITION BY line_id ORDER BY pos)))),
        tm AS (SELECT line_id, coalesce(max(t), 0) AS mt, coalesce(quantile_cont(t, 0.95), 0) AS p95, coalesce(avg((t > 170)::INT), 0) AS kf FROM tn GROUP BY line_id),
        kn AS (SELECT DISTINCT l.line_id FROM sg l JOIN sg r ON l.line_id = r.line_id AND l.pos + 1 < r.pos AND {_gap('l', 'r')} <= 1e-12 AND NOT (l.pos = 0 AND r.pos = (SELECT max(pos) FROM sg z WHERE z.line_id = l.line_id) AND l.x0 = r.x1 AND l.y0 = r.y1))
        SELECT line_id, {_r('length', digits=4)}, {_r('mt', 'max_turn', 4)}, CASE WHEN length >= 4 AND mt <= 170 AND p95 <= 170 AND kf <= 0.02 AND line_id NOT IN (FROM kn) THEN 'GOOD' WHEN n >= 2 AND length >= 1 THEN 'SUSPECT' ELSE 'INVALID' END AS quality FROM ln JOIN tm USING (line_id)""",
        "v_polys",
    ),
    "polyline_contacts": with_views(
        f"""WITH {_lines('SELECT * FROM v_bent')}, {_lines('SELECT line_id, pos, x, y + 0.5::DOUBLE * (line_id % 3) AS y FROM v_bent', 'm')},
        {_near(1e-9, 'l.line_id <> r.line_id', 'm').replace('nr AS', 'na AS')}, {_near(1e-9, 'l.line_id <> r.line_id')} SELECT i AS a, j AS b FROM na EXCEPT SELECT i, j FROM nr""",
        "v_bent",
    ),
    "polyline_lineage": with_views(
        f"""WITH {_lines('SELECT line_id, pos, x, y + CASE WHEN line_id % 5 = 0 THEN 0.4::DOUBLE ELSE 0 END AS y FROM v_bent WHERE line_id < 1000000', 'm')}, {_lines('SELECT * FROM v_bent WHERE line_id >= 1000000')},
        g AS MATERIALIZED (SELECT l.line_id AS i, r.line_id AS j, min({_gap('l', 'r')}) AS d FROM msg l JOIN sg r ON true GROUP BY 1, 2),
        n AS (SELECT i, string_agg(j::VARCHAR, ',' ORDER BY j) AS ids FROM g WHERE d <= 0.3 GROUP BY i), f AS (SELECT i, min({{'d': round(d, 9), 'j': j}}) AS m FROM g GROUP BY i)
        SELECT f.i AS line_id, coalesce(ids, m.j::VARCHAR) AS raw_ids FROM f LEFT JOIN n USING (i)""",
        "v_bent",
    ),
    "polyline_displacement": with_views(
        f"""WITH {_lines('SELECT * FROM v_bent WHERE line_id >= 2000000', 'm')}, {_lines(_ROWS)},
        e AS (SELECT line_id, length, unnest(range(0, n)) AS k, n FROM (SELECT line_id, length, greatest(2, ceil(length / 0.5)::INT + 1) AS n FROM mln)),
        q AS (SELECT e.line_id, k, x0 + greatest(0.0, least(1.0, (k * e.length / (n - 1) - d0) / (d1 - d0))) * (x1 - x0) AS x, y0 + greatest(0.0, least(1.0, (k * e.length / (n - 1) - d0) / (d1 - d0))) * (y1 - y0) AS y
          FROM e JOIN msg s ON s.line_id = e.line_id AND ((k * e.length / (n - 1) >= d0 AND k * e.length / (n - 1) < d1 AND k < n - 1) OR (k = n - 1 AND d1 >= e.length - 1e-9)))
        SELECT line_id, {_r('max(d)', 'displacement')} FROM (SELECT q.line_id, k, min({_psd('q.x', 'q.y', 's')}) AS d FROM q JOIN sg s ON s.line_id = q.line_id - 2000000 GROUP BY 1, 2) GROUP BY line_id""",
        "v_bent",
    ),
}
