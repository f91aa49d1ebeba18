"""Queries over networks of rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import lines, network, spatial
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.views import v_fragments, v_points, v_polys, v_rows, with_views

SPACING = network.Spacing()


def rows(s: SparkSession, d: str) -> DataFrame:
    return v_rows(s, d).withColumnRenamed("row_id", "id")


def doubled_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows, every fourth again .05 aside and every eighth .12 aside and shorter."""
    r = rows(s, d)
    near = r.where("id % 4 = 0").select((F.col("id") + 1000000).alias("id"), "x0", (F.col("y0") + 0.05).alias("y0"), (F.col("x1") - 0.5).alias("x1"), (F.col("y1") + 0.05).alias("y1"))
    far = r.where("id % 8 = 0").select((F.col("id") + 2000000).alias("id"), (F.col("x0") + 1.0).alias("x0"), (F.col("y0") + 0.21).alias("y0"), "x1", (F.col("y1") + 0.21).alias("y1"))
    return r.unionByName(near).unionByName(far)


def fragments(s: SparkSession, d: str) -> DataFrame:
    return v_fragments(s, d).withColumnRenamed("fragment_id", "id")


def pair_candidates(s: SparkSession, d: str) -> DataFrame:
    return rounded(network.pair_scores(rows(s, d), SPACING).where("ok").select("i", "j", "distance", "angle", "overlap", "confidence"), "distance", "angle", "overlap", "confidence")


def spacing_samples_top2(s: SparkSession, d: str) -> DataFrame:
    return rounded(network.spacing_samples(rows(s, d), 4.0), "distance")


def spacing_clusters(s: SparkSession, d: str) -> DataFrame:
    c = network.spacing_clusters(network.spacing_samples(rows(s, d), 4.0))
    return rounded(c, "intra_center", "inter_center", "intra_min", "intra_max", "inter_min", "inter_max")


def pair_assignment(s: SparkSession, d: str) -> DataFrame:
    return network.pair_rows(rows(s, d), SPACING).select("row_id", "pair_id", "pair_status", "inter_status")


def pair_status_histogram(s: SparkSession, d: str) -> DataFrame:
    return pair_assignment(s, d).groupBy("pair_status").agg(F.count(F.lit(1)).alias("n"))


def pair_sides(s: SparkSession, d: str) -> DataFrame:
    r = rows(s, d)
    return network.pair_sides(r, network.pair_rows(r, SPACING))


def pair_completion_audit(s: SparkSession, d: str) -> DataFrame:
    return network.pair_completion(network.pair_rows(rows(s, d), SPACING))


def duplicate_lines(s: SparkSession, d: str) -> DataFrame:
    return network.drop_duplicates(doubled_rows(s, d))


def endpoint_knn(s: SparkSession, d: str) -> DataFrame:
    return rounded(network.endpoint_neighbours(rows(s, d), 4, 2.0), "gap")


def row_tracks(s: SparkSession, d: str) -> DataFrame:
    return rounded(network.build_tracks(fragments(s, d)), "bearing", "total_length")


def track_bridge_chains(s: SparkSession, d: str) -> DataFrame:
    f = fragments(s, d)
    return network.bridge_chains(f, network.build_tracks(f))


def nn_distance_metrics(s: SparkSession, d: str) -> DataFrame:
    """Symmetric mean, largest and 95th percentile of nearest distances between two point sets."""
    p = v_points(s, d)
    a, b = p.where("grp = 0").select("id", "x", "y"), p.where("grp <> 0").select("id", "x", "y")
    both = spatial.nearest(a, b, 0.05).select("d").unionByName(spatial.nearest(b, a, 0.05).select("d"))
    return rounded(both.agg(F.avg("d").alias("mean_sym"), F.max("d").alias("hausdorff"), F.percentile("d", F.lit(0.95)).alias("hd95")), "mean_sym", "hausdorff", "hd95")


def network_crossings(s: SparkSession, d: str) -> DataFrame:
    seg = lines.segments(v_polys(s, d)).select("line_id", "x0", "y0", "x1", "y1")
    found = network.segment_contacts(seg, 12.0).agg(F.count(F.lit(1)).alias("n_crossings"))
    return seg.agg(F.count_distinct("line_id").alias("n_lines")).join(F.broadcast(found), F.lit(True))


def network_node_degree(s: SparkSession, d: str) -> DataFrame:
    v = v_polys(s, d)
    m = v.groupBy("line_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    ends = m.where("n >= 2").select(F.explode(F.array("a", "b")).alias("e")).select("e.x", "e.y")
    return network.node_degrees(ends).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def network_summary(s: SparkSession, d: str) -> DataFrame:
    r = rows(s, d)
    return rounded(network.network_summary(r, network.pair_rows(r, SPACING)), "total_length_m", digits=4)


_ALL = (
    pair_candidates, spacing_samples_top2, spacing_clusters, pair_assignment, pair_status_histogram, pair_sides, pair_completion_audit, duplicate_lines,
    endpoint_knn, row_tracks, track_bridge_chains, nn_distance_metrics, network_crossings, network_node_degree, network_summary,
)
QUERIES = {f.__name__: f for f in _ALL}


def _psd(px: str, py: str, s: str) -> str:
    """DuckDB: distance of a point from segment s.x0 .. s.y1."""
    dx, dy = f"({s}.x1 - {s}.x0)", f"({s}.y1 - {s}.y0)"
    t = f"greatest(0.0, least(1.0, (({px} - {s}.x0) * {dx} + ({py} - {s}.y0) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt((({px}) - {s}.x0 - {t} * {dx}) ** 2 + (({py}) - {s}.y0 - {t} * {dy}) ** 2)"


def _proj(px: str, py: str, s: str) -> str:
    dx, dy = f"({s}.x1 - {s}.x0)", f"({s}.y1 - {s}.y0)"
    size = f"sqrt({dx} ** 2 + {dy} ** 2)"
    return f"greatest(0.0, least({size}, (({px} - {s}.x0) * {dx} + ({py} - {s}.y0) * {dy}) / {size}))"


def _bearing(s: str) -> str:
    return f"((degrees(atan2({s}.y1 - {s}.y0, {s}.x1 - {s}.x0)) + 360) % 180)"


def _side(p: str, q: str, x: str, y: str) -> str:
    return f"(({q}x - {p}x) * ({y} - {p}y) - ({q}y - {p}y) * ({x} - {p}x))"


def _measures(source: str, radius: float) -> str:
    """DuckDB: m(i, j, distance, angle, overlap) of rows of source nearer than radius, by brute force in a band of y."""
    near = f"least({_psd('l.x0', 'l.y0', 'r')}, {_psd('l.x1', 'l.y1', 'r')}, {_psd('r.x0', 'r.y0', 'l')}, {_psd('r.x1', 'r.y1', 'l')})"
    d = {n: f"(({a}.x1 - {a}.x0) * ({c} - {a}.y0) - ({a}.y1 - {a}.y0) * ({b} - {a}.x0))" for n, a, b, c in (("1", "l", "r.x0", "r.y0"), ("2", "l", "r.x1", "r.y1"), ("3", "r", "l.x0", "l.y0"), ("4", "r", "l.x1", "l.y1"))}
    cross = f"({d['1']} * {d['2']} <= 0 AND {d['3']} * {d['4']} <= 0 AND ({d['1']} <> 0 OR {d['2']} <> 0))"
    angle = f"least(abs({_bearing('l')} - {_bearing('r')}) % 180, 180 - abs({_bearing('l')} - {_bearing('r')}) % 180)"
    return f"""src AS MATERIALIZED (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len FROM ({source})),
pr AS (SELECT l, r, CASE WHEN l.len <= r.len THEN l ELSE r END AS s, CASE WHEN l.len <= r.len THEN r ELSE l END AS t FROM src l JOIN src r
        ON l.id < r.id AND r.y0 BETWEEN l.y0 - {radius + 1} AND l.y0 + {radius + 1} AND (CASE WHEN {cross} THEN 0 ELSE {near} END) <= {radius}),
sm AS (SELECT l, r, s, t, greatest(2, least(20, floor(s.len)))::INT AS n FROM pr),
ds AS (SELECT l, r, s, t, list_sort(list_transform(range(0, n), lambda k: {_psd('s.x0 + k / (n - 1) * (s.x1 - s.x0)', 's.y0 + k / (n - 1) * (s.y1 - s.y0)', 't')})) AS q FROM sm),
m AS (SELECT l.id AS i, r.id AS j, (q[(len(q) - 1) // 2 + 1] + q[len(q) // 2 + 1]) / 2 AS distance, {angle} AS angle,
        abs({_proj('s.x1', 's.y1', 't')} - {_proj('s.x0', 's.y0', 't')}) / s.len AS overlap, l, r, s, t FROM ds)"""


_ROWS = "SELECT row_id AS id, x0, y0, x1, y1 FROM v_rows"
_DOUBLED = f"""SELECT * FROM ({_ROWS}) UNION ALL SELECT row_id + 1000000, x0, y0 + 0.05::DOUBLE, x1 - 0.5::DOUBLE, y1 + 0.05::DOUBLE FROM v_rows WHERE row_id % 4 = 0
UNION ALL SELECT row_id + 2000000, x0 + 1, y0 + 0.21::DOUBLE, x1, y1 + 0.21::DOUBLE FROM v_rows WHERE row_id % 8 = 0"""
_S = SPACING
_MID, _HALF = (_S.intra_min + _S.intra_max) / 2, (_S.intra_max - _S.intra_min) / 2 + _S.tolerance
_SC = f"""sc AS MATERIALIZED (SELECT i, j, distance, angle, overlap, distance BETWEEN {_S.inter_min - _S.tolerance!r}::DOUBLE AND {_S.inter_max + _S.tolerance!r}::DOUBLE AS inter,
        ins AND angle <= {_S.max_angle} AND overlap >= {_S.min_overlap} AS ok,
        round(CASE WHEN ins THEN 0.40::DOUBLE * (1 - least(1.0, abs(distance - {_MID!r}::DOUBLE) / {_HALF!r}::DOUBLE)) + 0.25::DOUBLE * (1 - least(1.0, angle / {_S.max_angle})) + 0.35::DOUBLE * least(1.0, overlap) ELSE 0 END, 9) AS confidence
        FROM (SELECT *, distance BETWEEN {_S.intra_min - _S.tolerance!r}::DOUBLE AND {_S.intra_max + _S.tolerance!r}::DOUBLE AS ins FROM m))"""
_SCORES = f"{_measures(_ROWS, _S.reach)}, {_SC}"
# a greedy pass over sc, one candidate a step; the rows matched so far are kept in a list
_MATCH = f"""cand AS MATERIALIZED (SELECT i, j, row_number() OVER (ORDER BY confidence DESC, i, j) AS k FROM sc WHERE ok),
walk(k, used, pair_id) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT
  UNION ALL SELECT c.k, CASE WHEN list_contains(used, c.i) OR list_contains(used, c.j) THEN used ELSE list_concat(used, [c.i, c.j]) END,
         CASE WHEN list_contains(used, c.i) OR list_contains(used, c.j) THEN pair_id ELSE pair_id + 1 END FROM walk w JOIN cand c ON c.k = w.k + 1),
fin AS (SELECT used FROM walk ORDER BY k DESC LIMIT 1),
ends AS (SELECT unnest(used) AS row_id, (unnest(range(0, len(used))) // 2 + 1)::BIGINT AS pair_id FROM fin),
bt AS (SELECT i AS row_id, j AS o, * FROM sc UNION ALL SELECT j, i, * FROM sc),
fl AS (SELECT row_id, min({{'c': -confidence, 'o': o, 'd': distance, 'a': angle, 'v': overlap}}) AS f FROM bt WHERE NOT ok GROUP BY row_id),
ct AS (SELECT row_id, bool_or(inter) AS inter FROM bt GROUP BY row_id),
asg AS (SELECT v.row_id, pair_id, CASE WHEN pair_id IS NOT NULL THEN 'valid_pair' WHEN f IS NULL THEN 'unmatched' WHEN f.d < {_S.intra_min - _S.tolerance!r}::DOUBLE THEN 'invalid_distance'
        WHEN f.d > {_S.intra_max + _S.tolerance!r}::DOUBLE THEN 'unmatched' WHEN f.v < {_S.min_overlap} THEN 'insufficient_overlap' WHEN f.a > {_S.max_angle} THEN 'invalid_angle' ELSE 'possible_pair' END AS pair_status,
        CASE WHEN coalesce(inter, false) THEN 'neighbor_found' ELSE 'no_neighbor' END AS inter_status
        FROM v_rows v LEFT JOIN ends USING (row_id) LEFT JOIN fl USING (row_id) LEFT JOIN ct USING (row_id))"""
_GREEDY = f"{_SCORES}, {_MATCH}"
_TOP2 = f"""{_measures(_ROWS, 4.0)}, ok AS (SELECT i, j, distance FROM m WHERE angle <= 10 AND overlap >= 0.35), bo AS (SELECT * FROM ok UNION ALL SELECT j, i, distance FROM ok),
top AS (SELECT i, rank::INT AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS rank FROM bo) WHERE rank <= 2)"""


def _two_medians(rounds: int) -> str:
    out = ["c0 AS (SELECT quantile_cont(v, 0.30) AS a, quantile_cont(v, 0.75) AS b FROM v)"]
    for k in range(rounds):
        out.append(f"c{k + 1} AS (SELECT coalesce(median(v) FILTER (abs(v - a) <= abs(v - b)), any_value(a)) AS a, coalesce(median(v) FILTER (abs(v - a) > abs(v - b)), any_value(b)) AS b FROM v, c{k})")
    return ", ".join(out)


# links of fragments: the nearest of four pairs of ends, ties by the first row's end
_LINKS = f"""fr AS (SELECT fragment_id AS id, x0, y0, x1, y1 FROM v_fragments),
ea AS (SELECT id, 0 AS e, x0 AS x, y0 AS y, x0 - x1 AS ux, y0 - y1 AS uy, {_bearing('fr')} AS br FROM fr UNION ALL SELECT id, 1, x1, y1, x1 - x0, y1 - y0, {_bearing('fr')} FROM fr),
pe AS (SELECT l.id AS a, r.id AS b, l.e AS le, r.e AS re, sqrt((r.x - l.x) ** 2 + (r.y - l.y) ** 2) AS gap, r.x - l.x AS cx, r.y - l.y AS cy, l.ux AS lx, l.uy AS ly, r.ux AS rx, r.uy AS ry,
       least(abs(l.br - r.br) % 180, 180 - abs(l.br - r.br) % 180) AS turn FROM ea l JOIN ea r ON l.id < r.id AND r.y BETWEEN l.y - 6.1 AND l.y + 6.1 AND r.x BETWEEN l.x - 50 AND l.x + 50),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY gap, le, re) AS k FROM pe) WHERE k = 1 AND gap <= 6 AND gap > 1e-9),
an AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (lx * cx + ly * cy) / (sqrt(lx ** 2 + ly ** 2) * gap))))) AS p, degrees(acos(greatest(-1.0, least(1.0, (-rx * cx - ry * cy) / (sqrt(rx ** 2 + ry ** 2) * gap))))) AS q FROM be),
ln AS MATERIALIZED (SELECT a, b FROM an WHERE p <= 10 AND q <= 10 AND turn <= 8 AND gap * sin(radians(least(p, q))) <= 0.18::DOUBLE),
bi AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
rc(v, root) AS (SELECT id, id FROM fr UNION SELECT bi.b, root FROM rc JOIN bi ON bi.a = rc.v),
rt AS (SELECT v AS id, min(root) AS track_id FROM rc GROUP BY v),
tk AS (SELECT id, track_id, (round(degrees(0.5 * atan2(sum(len * sin(t)) OVER w, sum(len * cos(t)) OVER w)), 9) + 180) % 180 AS bearing, sum(len) OVER w AS total_length, x0, y0, x1, y1
       FROM (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len, 2 * atan2(y1 - y0, x1 - x0) AS t FROM fr JOIN rt USING (id)) WINDOW w AS (PARTITION BY track_id))"""

ORACLES = {
    "pair_candidates": with_views(f"WITH {_SCORES} SELECT i, j, {_r('distance')}, {_r('angle')}, {_r('overlap')}, {_r('confidence')} FROM sc WHERE ok", "v_rows"),
    "spacing_samples_top2": with_views(f"WITH {_TOP2} SELECT i, rank, {_r('distance')} FROM top", "v_rows"),
    "spacing_clusters": with_views(
        f"""WITH {_TOP2}, p AS (SELECT distance AS v FROM top WHERE distance > 0), qs AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM p),
        v AS MATERIALIZED (SELECT v FROM p, qs WHERE v BETWEEN lo AND hi), {_two_medians(10)},
        s AS (SELECT any_value(a) AS a, any_value(b) AS b, count(*) AS n, median(abs(v - a)) FILTER (abs(v - a) <= abs(v - b)) AS ma, median(abs(v - b)) FILTER (abs(v - a) > abs(v - b)) AS mb FROM v, c10),
        h AS (SELECT *, greatest(0.05, 0.10 * a, 3 * 1.4826 * ma) AS ha, greatest(0.05, 0.10 * b, 3 * 1.4826 * mb) AS hb FROM s)
        SELECT {_r('a', 'intra_center')}, {_r('b', 'inter_center')}, {_r('a - ha', 'intra_min')}, {_r('least(a + ha, (a + b) / 2 - 0.01)', 'intra_max')},
        {_r('greatest(b - hb, (a + b) / 2 + 0.01)', 'inter_min')}, {_r('b + hb', 'inter_max')}, n AS n_samples FROM h""",
        "v_rows",
    ),
    "pair_assignment": with_views(f"WITH RECURSIVE {_GREEDY} SELECT * FROM asg", "v_rows"),
    "pair_status_histogram": with_views(f"WITH RECURSIVE {_GREEDY} SELECT pair_status, count(*) AS n FROM asg GROUP BY pair_status", "v_rows"),
    "pair_sides": with_views(
        f"""WITH RECURSIVE {_GREEDY}, e AS (SELECT v.*, pair_id, x1 - x0 AS dx, y1 - y0 AS dy, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM v_rows v JOIN asg USING (row_id)),
        g AS (SELECT a.pair_id, a.row_id AS ra, b.row_id AS rb, (CASE WHEN a.dx < 0 OR (abs(a.dx) <= 1e-9 AND a.dy < 0) THEN -1 ELSE 1 END) * (a.dx * (b.my - a.my) - a.dy * (b.mx - a.mx)) AS side,
              sqrt(a.dx ** 2 + a.dy ** 2) AS len FROM e a JOIN e b ON a.pair_id = b.pair_id AND a.row_id < b.row_id)
        SELECT row_id, e.pair_id, CASE WHEN e.pair_id IS NULL THEN 'unpaired' WHEN len <= 1e-9 OR abs(side) <= 1e-9 THEN 'unknown' WHEN (row_id = ra) = (side > 0) THEN 'right' ELSE 'left' END AS side
        FROM e LEFT JOIN g USING (pair_id)""",
        "v_rows",
    ),
    "pair_completion_audit": with_views(
        f"""WITH RECURSIVE {_GREEDY} SELECT count(*) FILTER (pair_status = 'valid_pair' AND n = 2) AS valid, count(*) FILTER (NOT (pair_status = 'valid_pair' AND n = 2)) AS incomplete
        FROM (SELECT *, count(pair_id) OVER (PARTITION BY pair_id) AS n FROM asg)""",
        "v_rows",
    ),
    "duplicate_lines": with_views(
        f"""WITH RECURSIVE {_measures(_DOUBLED, 0.20)},
        lk AS MATERIALIZED (SELECT i, j FROM m WHERE angle <= 5 AND overlap >= 0.70 AND ({_psd('s.x0', 's.y0', 't')} + {_psd('s.x1', 's.y1', 't')}) / 2 < 0.20),
        nd AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY round(-len, 6), id) AS k FROM src),
        ar AS MATERIALIZED (SELECT greatest(a.k, b.k) AS k, list(least(a.k, b.k)) AS before FROM lk JOIN nd a ON a.id = i JOIN nd b ON b.id = j GROUP BY 1),
        wd AS MATERIALIZED (SELECT nd.k, coalesce(before, []) AS before FROM nd LEFT JOIN ar USING (k)),
        touched AS MATERIALIZED (SELECT k, before, row_number() OVER (ORDER BY k) AS n FROM ar),
        walk(n, dropped) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
          SELECT t.n, CASE WHEN len(list_filter(t.before, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, t.k) ELSE dropped END FROM walk w JOIN touched t ON t.n = w.n + 1),
        fin AS (SELECT dropped FROM walk ORDER BY n DESC LIMIT 1)
        SELECT id AS row_id, NOT list_contains(dropped, k) AS kept FROM nd, fin""",
        "v_rows",
    ),
    "endpoint_knn": with_views(
        f"""WITH e AS (SELECT row_id * 2 AS id, x0 AS x, y0 AS y FROM v_rows UNION ALL SELECT row_id * 2 + 1, x1, y1 FROM v_rows),
        p AS (SELECT l.id AS i, r.id AS j, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2) AS gap FROM e l JOIN e r ON l.id <> r.id AND r.y BETWEEN l.y - 2 AND l.y + 2 AND r.x BETWEEN l.x - 2 AND l.x + 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY gap, j)::INT AS rank FROM p WHERE gap <= 2)
        SELECT i AS endpoint_i, j AS endpoint_j, rank, {_r('gap')} FROM k WHERE rank <= 4""",
        "v_rows",
    ),
    "row_tracks": with_views(f"WITH RECURSIVE {_LINKS} SELECT id AS fragment_id, track_id, {_r('bearing')}, {_r('total_length')} FROM tk", "v_fragments"),
    "track_bridge_chains": with_views(
        f"""WITH RECURSIVE {_LINKS}, pj AS (SELECT id, track_id, least(x0 * ux + y0 * uy, x1 * ux + y1 * uy) AS s, greatest(x0 * ux + y0 * uy, x1 * ux + y1 * uy) AS e,
          (y0 + y1) / 2 * ux - (x0 + x1) / 2 * uy AS o FROM (SELECT *, cos(radians(bearing)) AS ux, sin(radians(bearing)) AS uy FROM tk)),
        fl AS (SELECT *, CASE WHEN lag(e) OVER w IS NULL OR s - lag(e) OVER w < -0.5 OR s - lag(e) OVER w > 3 OR abs(o - lag(o) OVER w) > 0.5 THEN 1 ELSE 0 END AS fresh FROM pj WINDOW w AS (PARTITION BY track_id ORDER BY s, id)),
        nb AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY s, id) AS n FROM fl)
        SELECT id AS fragment_id, min(id) OVER (PARTITION BY track_id, n) AS chain_id FROM nb""",
        "v_fragments",
    ),
    "nn_distance_metrics": with_views(
        f"""WITH d AS (SELECT (SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) FROM v_points b WHERE (b.grp = 0) <> (a.grp = 0)) AS d FROM v_points a)
        SELECT {_r('avg(d)', 'mean_sym')}, {_r('max(d)', 'hausdorff')}, {_r('quantile_cont(d, 0.95)', 'hd95')} FROM d""",
        "v_points",
    ),
    "network_crossings": with_views(
        """WITH s AS MATERIALIZED (SELECT line_id, x AS x0, y AS y0, nx AS x1, ny AS y1 FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v_polys WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE nx IS NOT NULL),
        b AS (SELECT *, line_id // 8 AS lane FROM s),
        p AS (SELECT l.line_id AS a, r.line_id AS b, l.x0, l.y0, l.x1 - l.x0 AS rx, l.y1 - l.y0 AS ry, r.x1 - r.x0 AS sx, r.y1 - r.y0 AS sy, r.x0 - l.x0 AS qx, r.y0 - l.y0 AS qy, r.x1 - l.x0 AS ex, r.y1 - l.y0 AS ey, l.x1 AS lx1, l.y1 AS ly1, r.x0 AS cx, r.y0 AS cy
              FROM b l JOIN b r ON l.lane = r.lane AND l.line_id < r.line_id),
        c AS (SELECT *, rx * qy - ry * qx AS d1, rx * ey - ry * ex AS d2, sx * (y0 - cy) - sy * (x0 - cx) AS d3, sx * (ly1 - cy) - sy * (lx1 - cx) AS d4, rx * sy - ry * sx AS det FROM p),
        k AS (SELECT DISTINCT a, b, round(x0 + (qx * sy - qy * sx) / det * rx, 6) + 0.0 AS x, round(y0 + (qx * sy - qy * sx) / det * ry, 6) + 0.0 AS y FROM c WHERE d1 * d2 <= 0 AND d3 * d4 <= 0 AND (d1 <> 0 OR d2 <> 0) AND det <> 0
          UNION SELECT a, b, NULL, NULL FROM c WHERE det = 0 AND d1 = 0 AND greatest(0.0, least(rx * qx + ry * qy, rx * ex + ry * ey)) < least(rx * rx + ry * ry, greatest(rx * qx + ry * qy, rx * ex + ry * ey)))
        SELECT (SELECT count(DISTINCT line_id) FROM s) AS n_lines, (SELECT count(*) FROM k) AS n_crossings""",
        "v_polys",
    ),
    "network_node_degree": with_views(
        """WITH e AS (SELECT line_id, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS ex, arg_max(y, pos) AS ey FROM v_polys GROUP BY line_id HAVING count(*) >= 2),
        p AS (SELECT ax AS x, ay AS y FROM e UNION ALL SELECT ex, ey FROM e), n AS (SELECT round(x, 7) AS x, round(y, 7) AS y, count(*) AS degree FROM p GROUP BY 1, 2)
        SELECT degree, count(*) AS n_nodes FROM n GROUP BY degree""",
        "v_polys",
    ),
    "network_summary": with_views(
        f"""WITH RECURSIVE {_GREEDY}, dg AS (SELECT count(*) AS k FROM (SELECT x0 AS x, y0 AS y FROM v_rows UNION ALL SELECT x1, y1 FROM v_rows) GROUP BY round(x, 7), round(y, 7))
        SELECT count(*) AS line_count, {_r('sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2))', 'total_length_m', 4)}, count(*) FILTER (x0 = x1 AND y0 = y1) AS closed_loop_count,
        (SELECT count(*) FROM dg WHERE k = 1) AS unique_endpoint_count, (SELECT count(*) FROM dg WHERE k = 3) AS degree_3_node_count, (SELECT count(*) FROM dg WHERE k >= 4) AS degree_4_plus_node_count,
        (SELECT count(*) FROM (SELECT pair_id FROM asg WHERE pair_status = 'valid_pair' GROUP BY pair_id HAVING count(*) = 2)) AS valid_pair_count,
        (SELECT count(*) FROM asg WHERE pair_status <> 'valid_pair') AS unmatched_line_count, (SELECT count(*) FROM asg WHERE pair_status = 'valid_pair') AS valid_pair_line_count FROM v_rows""",
        "v_rows",
    ),
}
