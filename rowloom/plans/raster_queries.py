"""Queries over rasters and tiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import raster, spatial
from rowloom.operators.durable import dealt
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.network_queries import rows
from rowloom.plans.views import v_pixels, v_points, v_tiles, with_views
from rowloom.sources.tables import table

#: World to raster: pixels of .025 by 40.
TRANSFORM = (0.025, 0.0, 0.0, 0.0, 40.0, 0.0)
LOW, HIGH = 0.65, 0.95


def mask(s: SparkSession, d: str, least: float) -> DataFrame:
    return v_pixels(s, d).where(F.col("p") >= least).select("row", "col")


def pixel_degree(s: SparkSession, d: str) -> DataFrame:
    return raster.degrees(mask(s, d, HIGH))


def hysteresis_mask(s: SparkSession, d: str) -> DataFrame:
    return raster.hysteresis(v_pixels(s, d), LOW, HIGH)


def morphology_close(s: SparkSession, d: str) -> DataFrame:
    return raster.close(mask(s, d, HIGH))


def roi_probability_stats(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p")
    stats = v_pixels(s, d).agg(
        F.avg("p").alias("mean"), F.median("p").alias("median"), F.percentile("p", F.lit(0.2)).alias("p20"),
        F.avg((p >= 0.25).cast("double")).alias("frac_low"), F.avg((p >= LOW).cast("double")).alias("frac_high"),
    )
    return rounded(stats, "mean", "median", "p20", "frac_low", "frac_high")


def raster_sample_line(s: SparkSession, d: str) -> DataFrame:
    got = raster.row_probabilities(rows(s, d), v_pixels(s, d), TRANSFORM, 1.0).withColumnRenamed("id", "line_id")
    return rounded(got, "mean", "median", "p20")


def raster_bilinear(s: SparkSession, d: str) -> DataFrame:
    places = v_points(s, d).select("id", ((F.col("y") + 1) * 20).alias("row_f"), ((F.col("x") + 1) * 500).alias("col_f"))
    return rounded(raster.bilinear(places, v_pixels(s, d)), "value")


def tile_grid(s: SparkSession, d: str) -> DataFrame:
    side = (F.col("c_custkey") % 900 + 200).cast("int")
    r = table(s, d, "customer").select(F.col("c_custkey").alias("raster_id"), side.alias("height"), (side + 77).alias("width"), F.lit(40).alias("row_lo"), (side - 30).alias("row_hi"), F.lit(25).alias("col_lo"), side.alias("col_hi"))
    return rounded(raster.tile_grid(r, 256, 192), "valid_fraction")


def tile_classes(s: SparkSession, d: str) -> DataFrame:
    """positive: a tile with a point of the second group; hard_negative: one with points of the first only."""
    t = v_tiles(s, d).select("tile_id", F.col("row_off").cast("double").alias("by0"), F.col("col_off").cast("double").alias("bx0"), (F.col("row_off") + 20.0).alias("by1"), (F.col("col_off") + 20.0).alias("bx1"))
    x, y = (F.col("x") + 1) * 500, (F.col("y") + 1) * 20
    p = v_points(s, d).select("id", "grp", x.alias("bx0"), y.alias("by0"), x.alias("bx1"), y.alias("by1"))
    met = spatial.grid_join(t, p, spatial.BOX, 0.0, cell=20.0).groupBy(F.col("l.tile_id").alias("tile_id")).agg(F.max(F.col("r.grp")).alias("g"))
    name = F.when(F.col("g").isNull(), "negative").when(F.col("g") == 1, "positive").otherwise("hard_negative")
    return t.select("tile_id").join(met, "tile_id", "left").select("tile_id", name.alias("sampling_class"))


def _last_col(s: SparkSession, d: str) -> DataFrame:
    return F.broadcast(table(s, d, "part").agg((F.floor((F.max("p_partkey") + 1 - 20) / 10) * 10).cast("int").alias("last_col"), (F.max("p_partkey")).cast("int").alias("col_end")))


def mosaic_blend(s: SparkSession, d: str) -> DataFrame:
    pixels = v_pixels(s, d).join(_last_col(s, d), F.lit(True))
    covered = raster.covering_tiles(pixels, 20, 10, F.lit(30), F.col("last_col"))
    wrong = 1 + ((F.col("row_off") + F.col("col_off")) % 3) * 0.0123456789123
    return rounded(raster.blend(covered.select("row", "col", "row_off", "col_off", (F.col("p") * wrong).alias("p")), 20), "p")


def tta_average(s: SparkSession, d: str) -> DataFrame:
    """Mean of a prediction and of those of the mirrored rasters, turned back."""
    p = v_pixels(s, d).join(_last_col(s, d), F.lit(True))
    across = p.select("row", (F.col("col_end") - F.col("col")).alias("col"), (F.col("p") * 0.9).alias("p"))
    down = p.select((49 - F.col("row")).alias("row"), "col", (F.col("p") * 0.8).alias("p"))
    every = p.select("row", "col", "p").unionByName(across).unionByName(down)
    return rounded(every.groupBy("row", "col").agg(F.avg("p").alias("p")), "p")


def pixel_orientation_transfer(s: SparkSession, d: str) -> DataFrame:
    """(row, col, sin2, cos2) of the row sample nearest to each bright pixel's centre."""
    r = rows(s, d)
    samples = raster.sample_rows(r, 5.0).select((F.col("id") * 100 + F.col("k")).alias("id"), F.col("x"), F.col("y"))
    bright = mask(s, d, HIGH).select(raster.pixel_id(F.col("row"), F.col("col")).alias("id"), ((F.col("col") + 0.5) * 0.025).alias("x"), ((F.col("row") + 0.5) * 40.0).alias("y"))
    got = spatial.nearest(bright, samples, 4.0)
    a = 2 * F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    angle = r.select(F.col("id").alias("row_id"), F.sin(a).alias("sin2"), F.cos(a).alias("cos2"))
    out = got.withColumn("row_id", F.floor(F.col("other") / 100)).join(dealt(angle), "row_id")
    return rounded(out.select(F.shiftright("id", 32).cast("int").alias("row"), (F.col("id") % (1 << 32)).cast("int").alias("col"), "sin2", "cos2"), "sin2", "cos2")


_ALL = (
    pixel_degree, hysteresis_mask, morphology_close, roi_probability_stats, raster_sample_line, raster_bilinear, tile_grid, tile_classes,
    mosaic_blend, tta_average, pixel_orientation_transfer,
)
QUERIES = {f.__name__: f for f in _ALL}

_NINE = "(SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)"
_OFFS = "list_sort(list_distinct(list_append(range(0, greatest(0, {0} - 256) + 1, 192), greatest(0, {0} - 256)::BIGINT)))"
_SAMPLES = """sp AS (SELECT row_id, k, x0 + k / (n - 1) * (x1 - x0) AS x, y0 + k / (n - 1) * (y1 - y0) AS y, x0, y0, x1, y1 FROM (SELECT *, unnest(range(0, n)) AS k FROM (
SELECT *, greatest(2, ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / {0})::INT + 1) AS n FROM v_rows)))"""

ORACLES = {
    "pixel_degree": with_views(
        f"""WITH m AS (SELECT row, col FROM v_pixels WHERE p >= {HIGH}), n AS (SELECT a.row, a.col, count(b.row)::INT AS degree FROM (SELECT * FROM m, {_NINE} WHERE dr <> 0 OR dc <> 0) a
        LEFT JOIN m b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY a.row, a.col)
        SELECT *, CASE degree WHEN 0 THEN 'isolated' WHEN 1 THEN 'endpoint' WHEN 2 THEN 'path' ELSE 'junction' END AS kind FROM n""",
        "v_pixels",
    ),
    "hysteresis_mask": with_views(
        f"""WITH RECURSIVE c AS MATERIALIZED (SELECT row, col FROM v_pixels WHERE p >= {LOW}), g(row, col) AS (SELECT row, col FROM v_pixels WHERE p >= {HIGH}
        UNION SELECT c.row, c.col FROM g, {_NINE}, c WHERE c.row = g.row + dr AND c.col = g.col + dc) SELECT row, col FROM g""",
        "v_pixels",
    ),
    "morphology_close": with_views(
        f"""WITH m AS (SELECT row, col FROM v_pixels WHERE p >= {HIGH}), d AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM m, {_NINE}),
        e AS (SELECT row + dr AS row, col + dc AS col, count(*) AS n FROM d, {_NINE} GROUP BY 1, 2) SELECT row::INT AS row, col::INT AS col FROM e WHERE n = 9""",
        "v_pixels",
    ),
    "roi_probability_stats": with_views(
        f"""SELECT {_r('avg(p)', 'mean')}, {_r('median(p)', 'median')}, {_r('quantile_cont(p, 0.2)', 'p20')}, {_r('avg((p >= 0.25)::INT)', 'frac_low')}, {_r(f'avg((p >= {LOW})::INT)', 'frac_high')} FROM v_pixels""", "v_pixels"
    ),
    "raster_sample_line": with_views(
        f"""WITH {_SAMPLES.format(1.0)}, g AS (SELECT row_id, p FROM sp LEFT JOIN v_pixels q ON q.row = floor((sp.y - 0.0) * 0.025::DOUBLE / (0.025::DOUBLE * 40.0::DOUBLE))::INT AND q.col = floor((40.0::DOUBLE * sp.x) / (0.025::DOUBLE * 40.0::DOUBLE))::INT),
        m AS (SELECT row_id, avg(p) AS mean, median(p) AS median, quantile_cont(p, 0.2) AS p20 FROM g GROUP BY row_id)
        SELECT row_id AS line_id, {_r('mean')}, {_r('median')}, {_r('p20')}, CASE WHEN mean IS NULL THEN 'unknown' WHEN round(mean, 9) >= 0.7::DOUBLE THEN 'high' WHEN round(mean, 9) >= 0.5 THEN 'medium' ELSE 'low' END AS quality_flag FROM m""",
        "v_rows", "v_pixels",
    ),
    "raster_bilinear": with_views(
        f"""WITH q AS (SELECT id, (y + 1) * 20 AS rf, (x + 1) * 500 AS cf FROM v_points), k AS (SELECT id, floor(rf)::INT + i AS row, floor(cf)::INT + j AS col,
        (CASE WHEN i = 1 THEN rf - floor(rf) ELSE 1 - (rf - floor(rf)) END) * (CASE WHEN j = 1 THEN cf - floor(cf) ELSE 1 - (cf - floor(cf)) END) AS w FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
        SELECT id, {_r('sum(coalesce(p * w, 0))', 'value')} FROM k LEFT JOIN v_pixels USING (row, col) GROUP BY id""",
        "v_points", "v_pixels",
    ),
    "tile_grid": f"""WITH r AS (SELECT c_custkey AS raster_id, (c_custkey % 900 + 200)::INT AS side FROM customer),
        g AS (SELECT raster_id, side, unnest({_OFFS.format('side')})::INT AS row_off FROM r), h AS (SELECT *, unnest({_OFFS.format('(side + 77)')})::INT AS col_off FROM g)
        SELECT raster_id, row_off, col_off, {_r('greatest(0, least(row_off + 256, side - 30) - greatest(row_off, 40)) * greatest(0, least(col_off + 256, side) - greatest(col_off, 25)) / 65536', 'valid_fraction')} FROM h""",
    "tile_classes": with_views(
        """WITH q AS (SELECT grp, (x + 1) * 500 AS px, (y + 1) * 20 AS py FROM v_points),
        m AS (SELECT tile_id, max(grp) AS g FROM v_tiles JOIN q ON px BETWEEN col_off AND col_off + 20 AND py BETWEEN row_off AND row_off + 20 GROUP BY tile_id)
        SELECT tile_id, CASE WHEN g IS NULL THEN 'negative' WHEN g = 1 THEN 'positive' ELSE 'hard_negative' END AS sampling_class FROM v_tiles LEFT JOIN m USING (tile_id)""",
        "v_tiles", "v_points",
    ),
    "mosaic_blend": with_views(
        f"""WITH c AS (SELECT row, col, p * (1 + ((row_off + col_off) % 3) * 0.0123456789123::DOUBLE) AS q,
          greatest(1e-4::DOUBLE, (1 - abs((2 * (row - row_off) + 1) / 20.0::DOUBLE - 1)) * (1 - abs((2 * (col - col_off) + 1) / 20.0::DOUBLE - 1))) AS w
          FROM v_pixels JOIN v_tiles ON row >= row_off AND row < row_off + 20 AND col >= col_off AND col < col_off + 20)
        SELECT row, col, {_r('least(1.0, greatest(0.0, sum(q * w) / greatest(sum(w), 1e-8)))', 'p')} FROM c GROUP BY row, col""",
        "v_pixels", "v_tiles",
    ),
    "tta_average": with_views(
        f"""WITH e AS (SELECT max(p_partkey)::INT AS ce FROM part), a AS (SELECT row, col, p FROM v_pixels UNION ALL SELECT row, ce - col, p * 0.9::DOUBLE FROM v_pixels, e UNION ALL SELECT 49 - row, col, p * 0.8::DOUBLE FROM v_pixels)
        SELECT row, col, {_r('avg(p)', 'p')} FROM a GROUP BY row, col""",
        "v_pixels",
    ),
    "pixel_orientation_transfer": with_views(
        f"""WITH {_SAMPLES.format(5.0)}, b AS (SELECT row, col, (col + 0.5::DOUBLE) * 0.025::DOUBLE AS x, (row + 0.5::DOUBLE) * 40.0::DOUBLE AS y FROM v_pixels WHERE p >= {HIGH}),
        n AS (SELECT b.row, b.col, arg_min({{'a': x1 - x0, 'b': y1 - y0}}, {{'d': sqrt((b.x - sp.x) ** 2 + (b.y - sp.y) ** 2), 'i': row_id * 100 + k}}) AS v FROM b, sp GROUP BY b.row, b.col)
        SELECT row, col, {_r('sin(2 * atan2(v.b, v.a))', 'sin2')}, {_r('cos(2 * atan2(v.b, v.a))', 'cos2')} FROM n""",
        "v_rows", "v_pixels",
    ),
}
