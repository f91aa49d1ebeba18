"""Queries on pixels, tiles, ends and merges with their SQL, and on what numpy kernels make of whole lines (tested against plain versions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import bridging, fairing, inputs, lines, polylines, postprocess, raster, repair, topology
from rowloom.operators.durable import dealt
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.network_queries import SPACING
from rowloom.plans.polyline_queries import _gap, _lines, rows_only
from rowloom.plans.raster_queries import HIGH, LOW, TRANSFORM, mask
from rowloom.plans.shape_queries import small
from rowloom.plans.views import v_bent, v_parts, v_pixels, with_views
from rowloom.sources.tables import table

#: Side of the tiles over the rows, and the grid of the spurs' nodes.
TILE, SNAP = 4.0, 0.5


def pixel_values(s: SparkSession, d: str) -> DataFrame:
    """Quantities as an eight-bit band with 7 for nodata."""
    p = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("v"))
    return rounded(inputs.normalised_pixels(p, "uint8", 7.0), "v")


def turned_average(s: SparkSession, d: str) -> DataFrame:
    """Mean of a prediction and two mirrored ones, probabilities and directions, on a square raster."""
    p = v_pixels(s, d).where("col < 50").withColumns({"sin2": F.sin(F.col("p") * 3), "cos2": F.cos(F.col("p") * 3)})
    across = inputs.turned(p, 50, "across").withColumn("p", F.col("p") * 0.9)
    diagonal = inputs.turned(p, 50, "transpose").withColumn("p", F.col("p") * 0.8)
    return rounded(inputs.averaged_turns({"none": p, "across": across, "transpose": diagonal}, 50), "p", "sin2", "cos2")


def _row_tiles(s: SparkSession, d: str) -> DataFrame:
    """Tiles of 4 over the rows' field, one for each part and step."""
    t = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("c"))
    x, y = F.col("c") * TILE, F.floor(F.col("k") / 4) * TILE
    return t.where("k % 4 = 0").select((F.col("k") * 10 + F.col("c")).alias("tile_id"), x.alias("x0"), y.alias("y0"), (x + TILE).alias("x1"), (y + TILE).alias("y1"))


def line_tiles(s: SparkSession, d: str) -> DataFrame:
    """Tiles with every sixteenth row in them, and among the others those that zones cover."""
    v = v_bent(s, d).where("line_id % 16 = 5")
    zones = table(s, d, "supplier").select(F.lit(0.0).alias("x0"), (F.col("s_suppkey") * 20.0).alias("y0"), F.lit(18.5).alias("x1"), (F.col("s_suppkey") * 20.0 + 9.0).alias("y1"))
    return inputs.tile_classes(_row_tiles(s, d), v, zones, margin=0.1)


def distinct_geometries(s: SparkSession, d: str) -> DataFrame:
    """Which of the rows and their exact copies stay."""
    v = rows_only(s, d)
    copies = v.where("line_id % 3 = 0").withColumn("line_id", F.col("line_id") + 5000000)
    return inputs.distinct_lines(v.unionByName(copies)).select("line_id").distinct()


def pruned_spurs(s: SparkSession, d: str) -> DataFrame:
    """Orders' lines, made small, without short ones that end alone."""
    return bridging.prune_spurs(small(s, d), 2.0, SNAP).select("line_id").distinct()


def merged_pieces(s: SparkSession, d: str) -> DataFrame:
    """The bent rows cut at their vertices, every other piece turned, and merged again."""
    v = rows_only(s, d)
    seg = lines.segments(v)
    back = (F.col("pos") % 2 == 1) & (F.col("line_id") % 2 == 0)
    ends = [F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))]
    p = seg.select((F.col("line_id") * 10 + F.col("pos")).alias("line_id"), F.posexplode(F.when(back, F.array(ends[1], ends[0])).otherwise(F.array(*ends))).alias("pos", "p"))
    return rounded(inputs.merged_lines(p.select("line_id", F.col("pos").cast("long").alias("pos"), "p.x", "p.y")), "x", "y")


def stretches(s: SparkSession, d: str) -> DataFrame:
    """The stretch of each row from 2.5 to 9 along it."""
    v = rows_only(s, d)
    spans = v.select(F.col("line_id").alias("span_id"), "line_id").distinct().withColumns({"a": F.lit(2.5), "b": F.lit(9.0)})
    return rounded(inputs.chords_between(v, spans), "x", "y")


def run_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", inputs.run_id(F.col("o_orderdate").cast("timestamp")).alias("run_id"))


def raw_contract(s: SparkSession, d: str) -> DataFrame:
    got = inputs.raw_contract(rows_only(s, d), "run_1", "best.pt", "0" * 64, "2024-01-01T00:00:00Z")
    return rounded(got.select("line_id", "run_id", "raw_line_id", "source_stage", "length_m", "geometry_status", "source_raw_ids"), "length_m", digits=5)


def gap_candidates(s: SparkSession, d: str) -> DataFrame:
    """Ends of parts that face each other across a gap, with their scores."""
    found = bridging.candidates(v_parts(s, d), bridging.Gap(max_gap=8.0, max_angle=20.0, max_offset=0.5, neighbours=4, most_pairs=None))
    return rounded(found.select("i", "j", "score"), "score")


# --- without SQL: rows of numpy kernels and of loops of joins -------------------------------------


def topology_report(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with each order's line, the lines made small."""
    return rounded(topology.analyze(small(s, d)).drop("length"), "endpoint_length_ratio", "total_turn_deg", digits=4)


def network_overview(s: SparkSession, d: str) -> DataFrame:
    """Counts and sums of the bent rows' network and their pairs."""
    v = rows_only(s, d)
    pairs = polylines.pair_lines(v, SPACING).select(F.col("row_id").alias("line_id"), "pair_id", "pair_status")
    return rounded(topology.summary(v, pairs), "total_length_m", digits=4)


def cleared_junctions(s: SparkSession, d: str) -> DataFrame:
    return bridging.clear_junctions(small(s, d), snap=0.2).select("line_id").distinct()


def track_merges(s: SparkSession, d: str) -> DataFrame:
    """How many vertices and parts each merged track has, the parts moved together so that they meet."""
    v = v_parts(s, d)
    k = F.col("line_id") % 3
    first = v.groupBy("line_id").agg(F.min("x").alias("x0"))
    closed = v.join(dealt(first), "line_id").select("line_id", "pos", (F.col("x") - F.col("x0") + k * 12.0).alias("x"), (F.floor(F.col("line_id") / 3) * 5.0).alias("y"))
    tracks = closed.select("line_id", F.floor(F.col("line_id") / 3).alias("track_id")).distinct()
    pairs = tracks.select("line_id", F.when(F.col("track_id") % 5 == 0, F.col("line_id")).alias("pair_id"))
    return polylines.merge_tracks(closed, tracks, pairs).groupBy("line_id").agg(F.max("track_fragment_count").alias("n_parts"), F.count(F.lit(1)).alias("n_vertices"))


def fair_lines(s: SparkSession, d: str) -> DataFrame:
    """How each part of a track was smoothed, tracks bridged first."""
    v = v_parts(s, d)
    return fairing.fair_tracks(v, polylines.build_tracks(v))[1]


def adaptive_points(s: SparkSession, d: str) -> DataFrame:
    got = fairing.resample_adaptively(small(s, d), wide=1.0, tight=0.1, chord=0.02)
    return got.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_points"))


def twice_smoothed(s: SparkSession, d: str) -> DataFrame:
    """Largest shift of each line by two Gaussians in turn."""
    v = small(s, d)
    moved = fairing.smooth_twice(v, 0.1, 0.2, 0.4, 0.12).withColumnRenamed("pos", "k")
    even = lines.resample(v, 0.1).select("line_id", F.col("k").cast("long").alias("k"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    return rounded(moved.join(even, ["line_id", "k"]).groupBy("line_id").agg(F.max(F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"))).alias("shift")), "shift")


def mended_tracks(s: SparkSession, d: str) -> DataFrame:
    """Rows of a pair with a stretch cut out, completed beside their sisters."""
    v = rows_only(s, d)
    even = v.where("line_id % 2 = 0")
    seg = lines.segments(v.where("line_id % 2 = 1"))
    ends = F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))
    parts = seg.where("pos <> 1").select((F.col("line_id") * 10 + F.col("pos")).alias("id"), F.posexplode(ends).alias("pos", "p")).select(F.col("id").alias("line_id"), F.col("pos").cast("long").alias("pos"), "p.x", "p.y")
    every = parts.unionByName(even.withColumn("line_id", F.col("line_id") * 10))
    tracks = every.select("line_id", F.floor(F.col("line_id") / 10).alias("track_id")).distinct()
    refs = tracks.where("track_id % 2 = 1").select("track_id", (F.col("track_id") - 1).alias("reference")).distinct()
    return rounded(repair.complete_tracks(every, tracks, refs, limits=repair.Limits(most_gap=10.0))[1], "offset", "completed_m")


def ridge_shift(s: SparkSession, d: str) -> DataFrame:
    """How far each row is drawn to likely pixels at most."""
    v = rows_only(s, d)
    got = repair.drawn_to_ridge(v, v_pixels(s, d), TRANSFORM, spacing=1.0, reach=0.3, step=0.1)
    even = lines.resample(v, 1.0).select("line_id", F.col("k").cast("long").alias("pos"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    return rounded(got.join(dealt(even), ["line_id", "pos"]).groupBy("line_id").agg(F.max(F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey"))).alias("shift")), "shift")


def faired_centerlines(s: SparkSession, d: str) -> DataFrame:
    """Which form of each order's line is the best safe one."""
    return rounded(repair.fair_centerlines(small(s, d), 0.05)[1], "shift", "score_before", "score_after")


def roi_diagnostics(s: SparkSession, d: str) -> DataFrame:
    m = mask(s, d, HIGH)
    got = inputs.diagnostics(v_pixels(s, d), raster.close(m), raster.thinned(raster.close(m)), (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), LOW, HIGH)
    return rounded(got, *[f.name for f in got.schema if f.dataType.simpleString() == "double"])


def postprocessed_lines(s: SparkSession, d: str) -> DataFrame:
    """The whole way from the bent rows and their copies to finished lines."""
    done = postprocess.run(v_bent(s, d), settings=postprocess.Settings(spacing=SPACING, estimate_spacing=False))
    return rounded(done.final.select("final_line_id", "line_id", "pair_id", "pair_status", "source_raw_ids", "was_smoothed", "review_required", "postprocess_status", "length_m"), "length_m", digits=4)


_ALL = (
    pixel_values, turned_average, line_tiles, distinct_geometries, pruned_spurs, merged_pieces, stretches, run_ids, raw_contract, gap_candidates, topology_report, network_overview,
    cleared_junctions, track_merges, fair_lines, adaptive_points, twice_smoothed, mended_tracks, ridge_shift, faired_centerlines, roi_diagnostics, postprocessed_lines,
)
QUERIES = {f.__name__: f for f in _ALL}

_ROWS = "SELECT * FROM v_bent WHERE line_id < 1000000"
_SMALL = "SELECT line_id, pos, x * 0.1::DOUBLE AS x, y * 0.1::DOUBLE AS y FROM v_polys"
ORACLES = {
    "pixel_values": f"SELECT l_orderkey, l_linenumber, l_partkey, {_r('CASE WHEN l_quantity = 7 THEN 0 ELSE l_quantity / 255 END', 'v')} FROM lineitem",
    "turned_average": with_views(
        f"""WITH p AS (SELECT row, col, p, sin(p * 3) AS s, cos(p * 3) AS c FROM v_pixels WHERE col < 50), a AS (SELECT * FROM p UNION ALL SELECT row, col, p * 0.9::DOUBLE, s, c FROM p UNION ALL SELECT row, col, p * 0.8::DOUBLE, s, c FROM p)
        SELECT row, col, {_r('avg(p)', 'p')}, {_r('avg(s)', 'sin2')}, {_r('avg(c)', 'cos2')} FROM a GROUP BY row, col""",
        "v_pixels",
    ),
    "line_tiles": with_views(
        f"""WITH t AS (SELECT p_partkey * 10 + c AS tile_id, c * 4.0::DOUBLE AS tx, p_partkey // 4 * 4.0::DOUBLE AS ty FROM part, (SELECT unnest(range(0, 10)) AS c) WHERE p_partkey % 4 = 0),
        {_lines('SELECT * FROM v_bent WHERE line_id % 16 = 5')}, z AS (SELECT 0.0::DOUBLE AS zx0, s_suppkey * 20.0::DOUBLE AS zy0, 18.5::DOUBLE AS zx1, s_suppkey * 20.0::DOUBLE + 9 AS zy1 FROM supplier),
        h AS (SELECT DISTINCT tile_id FROM (SELECT tile_id, greatest(0.0, CASE WHEN x1 <> x0 THEN least((tx - 0.1 - x0) / (x1 - x0), (tx + 4.1 - x0) / (x1 - x0)) ELSE 0 END, CASE WHEN y1 <> y0 THEN least((ty - 0.1 - y0) / (y1 - y0), (ty + 4.1 - y0) / (y1 - y0)) ELSE 0 END) AS lo,
            least(1.0, CASE WHEN x1 <> x0 THEN greatest((tx - 0.1 - x0) / (x1 - x0), (tx + 4.1 - x0) / (x1 - x0)) ELSE 1 END, CASE WHEN y1 <> y0 THEN greatest((ty - 0.1 - y0) / (y1 - y0), (ty + 4.1 - y0) / (y1 - y0)) ELSE 1 END) AS hi
          FROM t JOIN sg ON least(x0, x1) <= tx + 4.1 AND greatest(x0, x1) >= tx - 0.1 AND least(y0, y1) <= ty + 4.1 AND greatest(y0, y1) >= ty - 0.1) WHERE lo <= hi),
        c AS (SELECT tile_id, sum(greatest(0.0, least(tx + 4, zx1) - greatest(tx, zx0)) * greatest(0.0, least(ty + 4, zy1) - greatest(ty, zy0))) / 16 AS share FROM t, z GROUP BY tile_id)
        SELECT tile_id, CASE WHEN tile_id IN (FROM h) THEN 'positive' WHEN share >= 0.8 THEN 'hard_negative' ELSE 'negative' END AS sampling_class FROM t JOIN c USING (tile_id)""",
        "v_bent",
    ),
    "distinct_geometries": with_views("SELECT DISTINCT CASE WHEN line_id % 3 = 0 THEN line_id + 5000000 ELSE line_id END AS line_id FROM v_bent WHERE line_id < 1000000", "v_bent"),
    "pruned_spurs": with_views(
        f"""WITH {_lines(_SMALL)}, e AS (SELECT line_id, first(x ORDER BY pos) AS ax, first(y ORDER BY pos) AS ay, last(x ORDER BY pos) AS bx, last(y ORDER BY pos) AS by_ FROM vx GROUP BY line_id HAVING count(*) >= 2),
        n AS (SELECT line_id, floor(ax / {SNAP}::DOUBLE) AS nx, floor(ay / {SNAP}::DOUBLE) AS ny FROM e UNION ALL SELECT line_id, floor(bx / {SNAP}::DOUBLE), floor(by_ / {SNAP}::DOUBLE) FROM e), g AS (SELECT nx, ny, count(*) AS k FROM n GROUP BY nx, ny),
        s AS (SELECT line_id FROM n JOIN g USING (nx, ny) JOIN ln USING (line_id) WHERE k = 1 AND length < 2) SELECT DISTINCT line_id FROM v_polys WHERE line_id NOT IN (FROM s)""",
        "v_polys",
    ),
    "merged_pieces": with_views(f"SELECT line_id * 10 AS line_id, pos, {_r('x')}, {_r('y')}, 3::BIGINT AS n_parts FROM ({_ROWS})", "v_bent"),
    "stretches": with_views(
        f"""WITH {_lines(_ROWS)}, q AS (SELECT line_id, d0 AS d, x0 AS x, y0 AS y FROM sg WHERE d0 > 2.5 AND d0 < 9 UNION ALL
          SELECT line_id, a, x0 + (a - d0) / (d1 - d0) * (x1 - x0), y0 + (a - d0) / (d1 - d0) * (y1 - y0) FROM sg, (SELECT unnest([2.5, 9.0])::DOUBLE AS a) WHERE a >= d0 AND a < d1)
        SELECT line_id AS span_id, row_number() OVER (PARTITION BY line_id ORDER BY d) - 1 AS pos, {_r('x')}, {_r('y')} FROM q""",
        "v_bent",
    ),
    "run_ids": "SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y%m%d_%H%M%S') AS run_id FROM orders",
    "raw_contract": with_views(
        f"""WITH {_lines(_ROWS)}, k AS (SELECT *, printf('raw_%06d', row_number() OVER (ORDER BY line_id) - 1) AS raw_line_id FROM ln)
        SELECT line_id, 'run_1' AS run_id, raw_line_id, 'post_inference' AS source_stage, {_r('length', 'length_m', 5)}, 'valid_simple' AS geometry_status, '["' || raw_line_id || '"]' AS source_raw_ids FROM k""",
        "v_bent",
    ),
    "gap_candidates": with_views(
        f"""WITH {_lines('SELECT * FROM v_parts')}, e AS (SELECT line_id * 2 + k AS id, line_id, CASE WHEN k = 0 THEN ax ELSE bx END AS x, CASE WHEN k = 0 THEN ay ELSE by_ END AS y, CASE WHEN k = 0 THEN ax - bx ELSE bx - ax END AS vx, CASE WHEN k = 0 THEN ay - by_ ELSE by_ - ay END AS vy
          FROM (SELECT line_id, first(x ORDER BY pos) AS ax, first(y ORDER BY pos) AS ay, last(x ORDER BY pos) AS bx, last(y ORDER BY pos) AS by_ FROM vx GROUP BY line_id), (SELECT unnest([0, 1]) AS k)),
        u AS MATERIALIZED (SELECT id, line_id, x, y, vx / sqrt(vx ** 2 + vy ** 2) AS tx, vy / sqrt(vx ** 2 + vy ** 2) AS ty FROM e),
        kn AS (SELECT l.id AS i, r.id AS j, sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2) AS gap FROM u l JOIN u r ON l.id <> r.id AND r.y BETWEEN l.y - 8 AND l.y + 8 AND r.x BETWEEN l.x - 8 AND l.x + 8),
        k4 AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY gap, j) AS k FROM kn WHERE gap <= 8) WHERE k <= 4),
        p AS (SELECT i, j, a.line_id AS li, b.line_id AS lj, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, a.tx AS ax, a.ty AS ay, b.tx AS bx, b.ty AS by_, b.x - a.x AS gx, b.y - a.y AS gy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS gap FROM k4 JOIN u a ON a.id = i JOIN u b ON b.id = j WHERE a.line_id <> b.line_id),
        m AS (SELECT *, (ax * gx + ay * gy) / gap AS di, -(bx * gx + by_ * gy) / gap AS dj, -(ax * bx + ay * by_) AS al, abs(gy * ax - gx * ay) AS oi, abs(gy * bx - gx * by_) AS oj FROM p WHERE gap >= 1e-3),
        f AS MATERIALIZED (SELECT * FROM m WHERE di >= cos(radians(20)) AND dj >= cos(radians(20)) AND al >= cos(radians(20)) AND oi <= 0.5 AND oj <= 0.5),
        b AS (SELECT DISTINCT l.i, l.j FROM f l JOIN sg r ON r.line_id <> l.li AND r.line_id <> l.lj AND r.y0 BETWEEN least(l.y0, l.y1) - 5 AND greatest(l.y0, l.y1) + 5 AND {_gap('l', 'r')} <= 1e-9)
        SELECT i, j, round(round(di + dj - (oi + oj) / 0.5, 9), 6) + 0.0 AS score FROM f WHERE (i, j) NOT IN (FROM b)""",
        "v_parts",
    ),
}
