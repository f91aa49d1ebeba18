"""Queries on datasets, gates, provenance, losses and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators import metrics, polylines, products, raster
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.raster_queries import HIGH, mask
from rowloom.plans.raster_queries import tile_classes as classes
from rowloom.plans.raster_queries import ORACLES as RASTER_SQL
from rowloom.plans.views import v_pixels, v_rows, v_tiles, with_views
from rowloom.sources import vectors
from rowloom.sources.tables import table


def _finished(s: SparkSession, d: str) -> DataFrame:
    """A finished line for each customer, with what was done to it."""
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("line_id"), (k % 11 == 0).alias("track_merged"), F.when(k % 13 != 1, k % 7 == 0).alias("kink_repair"), F.when(k % 5 == 0, F.lit("0.3")).when(k % 5 == 1, "none").alias("terminal_extended_m"),
        (k % 97 == 0).alias("pair_reconstructed"), F.when(k % 3 == 0, "unmatched").otherwise("valid_pair").alias("pair_status"), (k % 41 == 0).alias("has_crossing"), F.when(k % 29 == 0, "failed").otherwise("clean").alias("serration_status"),
    )


def provenance_flags(s: SparkSession, d: str) -> DataFrame:
    names = ["line_id", "postprocess_version", "was_merged", "was_repaired", "was_reconstructed", "was_terminal_extended", "source_type"]
    return metrics.provenance(_finished(s, d), "1.2.0").select(*names)


def production_gate(s: SparkSession, d: str) -> DataFrame:
    final = metrics.provenance(_finished(s, d), "1.2.0")
    return metrics.production_gate(final.where("line_id % 10 <> 0"), final.where("line_id % 10 = 0"))


def schema_union(s: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers under the columns of both."""
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal", 2).alias("balance"))
    return metrics.concat_rows(a, b)


def even_sample(s: SparkSession, d: str) -> DataFrame:
    """Fifty orders, even by number."""
    return polylines.evenly(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 50)


def gsd_report(s: SparkSession, d: str) -> DataFrame:
    inputs = table(s, d, "part").select((F.col("p_size") / 100.0 + 0.01).alias("gsd"))
    return rounded(metrics.gsd_report(inputs), "gsd_min", "gsd_max", "gsd_median", "variation")


def _tiles(s: SparkSession, d: str) -> DataFrame:
    """A tile for each line item: split by order, class by flag."""
    flag, k = F.col("l_returnflag"), F.col("l_orderkey")
    return table(s, d, "lineitem").select(
        F.when(k % 10 < 7, "train").when(k % 10 < 9, "val").otherwise("test").alias("split"), (F.col("l_suppkey") % 5).cast("string").alias("input_name"), k.alias("group_id"), (flag == "R").alias("positive"),
        F.when(flag == "A", "hard_negative").otherwise("random").alias("sampling_class"), F.lit(0).cast("long").alias("n_bad"), F.lit(400).cast("long").alias("valid_pixels"), F.col("l_quantity").cast("long").alias("positive_pixels"),
    )


def dataset_inspection(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.inspect_tiles(_tiles(s, d), {"train": 100, "val": 100, "test": 10**9}, sources=3, hard_negatives=10, background=0.5), "background_fraction")


def bad_values(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "events").select(F.when(F.col("event_id") % 17 == 0, float("nan")).when(F.col("event_id") % 19 == 0, float("inf")).otherwise(F.col("value")).alias("a"), F.when(F.col("event_id") % 23 != 0, -F.col("value")).alias("b"))
    return metrics.bad_values(v, ["a", "b"])


def orientation_losses(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_quantity") * 0.1, F.col("l_quantity") * 0.1 + F.col("l_discount") * 20
    p = table(s, d, "lineitem").select(F.sin(b).alias("ps"), (F.cos(b) * 0.9).alias("pc"), F.sin(a).alias("ts"), F.cos(a).alias("tc"), (F.col("l_returnflag") == "R").cast("double").alias("weight"))
    return rounded(metrics.combined_loss(metrics.orientation_losses(p), {"mse": 1.0, "cosine": 0.5}), "mse", "smooth_l1", "cosine", "total")


def early_stopping(s: SparkSession, d: str) -> DataFrame:
    """A score for each nation's number of suppliers as if they were epochs."""
    runs = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("epoch")).agg(F.round(F.avg("s_acctbal"), 2).alias("score"))
    return metrics.early_stopping(runs, 4, 10.0)


def tile_names(s: SparkSession, d: str) -> DataFrame:
    t = v_tiles(s, d)
    return t.select("tile_id", products.tile_name(F.concat(F.lit("input"), (F.col("group_id") % 3).cast("string")), F.col("tile_id") % 100000, F.col("row_off"), F.col("col_off")).alias("name"))


def negative_tiles(s: SparkSession, d: str) -> DataFrame:
    """Positive tiles, and half as many others, hard ones first."""
    return raster.keep_negatives(classes(s, d), 0.5)


def file_catalogue(s: SparkSession, d: str) -> DataFrame:
    """A file for each part, told by its ending and by what excludes it."""
    ending = F.element_at(F.array(*[F.lit(x) for x in ("tif", "GPKG", "npz", "csv", "yaml", "py", "xyz")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    files = table(s, d, "part").select(F.concat(F.lit("run"), (F.col("p_size") % 4).cast("string"), F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit("."), ending).alias("path"), F.col("p_size").cast("long").alias("size"))
    return vectors.categorised(files, {"old run": "^run0/", "large": "7[.]csv$"})


def sampled_files(s: SparkSession, d: str) -> DataFrame:
    files = file_catalogue(s, d).where("excluded_by IS NULL").withColumn("run", F.substring("path", 1, 4))
    return vectors.first_of_each(files, "run", {"run1": 20, "run2": 12, "run3": 12}).select("path", "run")


def mask_components(s: SparkSession, d: str) -> DataFrame:
    """Pixels of the bright mask's components, by size and by how many there are."""
    sizes = raster.pixel_components(mask(s, d, HIGH)).groupBy("root").agg(F.count(F.lit(1)).alias("n_pixels"))
    return sizes.groupBy("n_pixels").agg(F.count(F.lit(1)).alias("n"))


def mask_branches(s: SparkSession, d: str) -> DataFrame:
    """Branches of the bright mask read as a skeleton, by size and form."""
    found, _ = raster.branches(mask(s, d, HIGH))
    return found.groupBy("n_pixels", "closed").agg(F.count(F.lit(1)).alias("n"))


def morphology_open(s: SparkSession, d: str) -> DataFrame:
    return raster.open_(raster.dilate(mask(s, d, HIGH)))


def directional_close(s: SparkSession, d: str) -> DataFrame:
    return raster.directional_close(mask(s, d, HIGH))


def small_components(s: SparkSession, d: str) -> DataFrame:
    """The bright mask without components below three pixels that do not touch the first or last row."""
    width = table(s, d, "part").agg(F.max("p_partkey").cast("int").alias("m")).first()["m"] + 2
    return raster.drop_small(mask(s, d, HIGH), 3, 50, width)


def soft_cldice(s: SparkSession, d: str) -> DataFrame:
    """Soft clDice of the raster's values against its bright ones, two rounds."""
    p = v_pixels(s, d).select("row", "col", "p", (F.col("p") >= 0.6).cast("double").alias("y"))
    return rounded(raster.soft_cldice(p, 2), "precision", "recall", "loss")


def evaluation_means(s: SparkSession, d: str) -> DataFrame:
    """Means over shipping days as if they were batches."""
    b = table(s, d, "lineitem").groupBy("l_shipdate").agg(F.avg("l_discount").alias("loss"), F.avg("l_tax").alias("row_dice"), (F.avg("l_quantity") / 100).alias("center_cldice"))
    return rounded(metrics.evaluation(b.drop("l_shipdate")), "val_loss", "val_row_dice", "val_center_cldice")


def mask_agreement(s: SparkSession, d: str) -> DataFrame:
    """clDice of two masks whose every other row stands for their skeletons."""
    a, b = mask(s, d, HIGH), mask(s, d, 0.85)
    return rounded(raster.skeleton_agreement(a, b, a.where("row % 2 = 0"), b.where("row % 2 = 0")), "precision", "recall", "cldice")


def burnt_rows(s: SparkSession, d: str) -> DataFrame:
    """The row that each pixel near one belongs to, and its direction; pixels of 1 by 2."""
    rows = v_rows(s, d).withColumnRenamed("row_id", "id")
    top = int(rows.agg(F.max("y1").alias("m")).first()["m"] / 2) + 2
    return rounded(raster.burn(rows, (1.0, 0.0, 0.0, 0.0, 2.0, 0.0), top, 40, 0.6), "sin2", "cos2")


_ALL = (
    provenance_flags, production_gate, schema_union, even_sample, gsd_report, dataset_inspection, bad_values, orientation_losses, early_stopping, tile_names, negative_tiles,
    file_catalogue, sampled_files, mask_components, mask_branches, morphology_open, directional_close, small_components, mask_agreement, soft_cldice, evaluation_means, burnt_rows,
)
QUERIES = {f.__name__: f for f in _ALL}

_FLAGS = """fl AS (SELECT c_custkey AS line_id, c_custkey % 11 = 0 AS m, coalesce(c_custkey % 13 <> 1 AND c_custkey % 7 = 0, false) AS r, c_custkey % 97 = 0 AS c, c_custkey % 5 = 0 AS t, c_custkey % 3 = 0 AS un, c_custkey % 41 = 0 AS x, c_custkey % 29 = 0 AS f FROM customer)"""
_FILES = """fc AS (SELECT 'run' || (p_size % 4)::VARCHAR || '/part_' || p_partkey::VARCHAR || '.' || ['tif', 'GPKG', 'npz', 'csv', 'yaml', 'py', 'xyz'][p_partkey % 7 + 1] AS path, p_size::BIGINT AS size,
  'part_' || p_partkey::VARCHAR || '.' || ['tif', 'GPKG', 'npz', 'csv', 'yaml', 'py', 'xyz'][p_partkey % 7 + 1] AS name, 'part_' || p_partkey::VARCHAR AS stem, ['image', 'vector', 'array', 'table', 'config', 'code', 'other'][p_partkey % 7 + 1] AS kind,
  CASE WHEN p_size % 4 = 0 THEN 'old run' WHEN p_partkey % 7 = 3 AND p_partkey % 10 = 7 THEN 'large' END AS excluded_by FROM part)"""
_MASK = f"mk AS MATERIALIZED (SELECT row, col FROM v_pixels WHERE p >= {HIGH})"
_NINE = "(SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)"


def _components(source: str, name: str) -> str:
    """DuckDB: name(row, col, root) of the 8-connected components of a table of pixels, each named by its least pixel."""
    return f"""{name}r(row, col, root) AS (SELECT row, col, row::BIGINT * 4294967296 + col FROM {source} UNION SELECT m.row, m.col, g.root FROM {name}r g, {_NINE}, {source} m WHERE m.row = g.row + dr AND m.col = g.col + dc),
{name} AS MATERIALIZED (SELECT row, col, min(root) AS root FROM {name}r GROUP BY row, col)"""


def _moved(source: str, steps: list[tuple[int, int]], full: bool) -> str:
    """DuckDB: pixels of a source moved by steps; full: only places that all of them reach."""
    every = ", ".join(f"({r}, {c})" for r, c in steps)
    end = f" GROUP BY 1, 2 HAVING count(*) = {len(steps)}" if full else ""
    return f"SELECT {'' if full else 'DISTINCT '}row + dr AS row, col + dc AS col FROM {source}, (VALUES {every}) st(dr, dc){end}"


def _pool(source: str, best: str) -> str:
    return f"SELECT m.row, m.col, {best}(n.a) AS a, {best}(n.b) AS b FROM {source} m, {_NINE}, {source} n WHERE n.row = m.row + dr AND n.col = m.col + dc GROUP BY m.row, m.col"


def _soft(rounds: int) -> str:
    """DuckDB: s0 .. with a and b eroded and sa and sb, their soft skeletons, after each round."""
    out = ["s0 AS MATERIALIZED (SELECT row, col, p AS a, (p >= 0.6)::INT::DOUBLE AS b, 0.0::DOUBLE AS sa, 0.0::DOUBLE AS sb FROM v_pixels)"]
    for k in range(rounds):
        out.append(f"e{k} AS MATERIALIZED ({_pool(f's{k}', 'min')}), o{k} AS MATERIALIZED ({_pool(f'e{k}', 'max')})")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT s.row, s.col, e.a, e.b, greatest(sa, s.a - o.a) AS sa, greatest(sb, s.b - o.b) AS sb FROM s{k} s JOIN e{k} e ON e.row = s.row AND e.col = s.col JOIN o{k} o ON o.row = s.row AND o.col = s.col)")
    return ", ".join(out)


_LINES = [[(-k * r, -k * c) for k in (-1, 0, 1)] for r, c in ((0, 1), (1, 0), (1, 1), (1, -1))]
_SQUARE = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
ORACLES = {
    "provenance_flags": f"""WITH {_FLAGS} SELECT line_id, '1.2.0' AS postprocess_version, m AS was_merged, r AS was_repaired, c AS was_reconstructed, t AS was_terminal_extended,
        CASE WHEN c THEN 'reconstructed' WHEN m::INT + r::INT + t::INT = 0 THEN 'original' WHEN m::INT + r::INT + t::INT > 1 THEN 'mixed' WHEN m THEN 'was_merged' WHEN r THEN 'was_repaired' ELSE 'was_terminal_extended' END AS source_type FROM fl""",
    "production_gate": f"""WITH {_FLAGS}, a AS (SELECT count(*) AS final_line_count, count(*) FILTER (un) AS unmatched_count, count(*) FILTER (x) AS final_crossing_count, count(*) FILTER (f) AS serration_failed_count, count(*) FILTER (un OR f) AS manual_review_count,
          count(*) FILTER (NOT (un OR f)) AS production_line_count, count(*) FILTER (r) AS repaired_count, count(*) FILTER (c) AS reconstructed_count, count(*) FILTER (t) AS terminal_extended_count FROM fl WHERE line_id % 10 <> 0),
        b AS (SELECT count(*) AS rejected_count, count(*) FILTER (x) AS rejected_crossing_count FROM fl WHERE line_id % 10 = 0), g AS (SELECT *, final_crossing_count + rejected_crossing_count AS crossing_count FROM a, b),
        h AS (SELECT *, array_to_string(list_filter([CASE WHEN unmatched_count > 0 THEN 'unmatched_lines' END, CASE WHEN crossing_count > 0 THEN 'crossings' END, CASE WHEN serration_failed_count > 0 THEN 'residual_serration' END], lambda z: z IS NOT NULL), ';') AS production_gate_reasons FROM g)
        SELECT *, production_gate_reasons = '' AS production_gate_passed, CASE WHEN production_gate_reasons = '' THEN 'completed' ELSE 'manual_review' END AS status FROM h""",
    "schema_union": "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, round(s_acctbal, 2) FROM supplier",
    "even_sample": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey FROM o WHERE n <= 50 OR p = n - 1 OR p IN (SELECT floor(k * (((SELECT any_value(n) FROM o) - 1) / 49.0::DOUBLE))::BIGINT FROM (SELECT unnest(range(0, 49)) AS k))""",
    "gsd_report": f"""WITH g AS (SELECT p_size / 100.0::DOUBLE + 0.01::DOUBLE AS gsd FROM part), m AS (SELECT min(gsd) AS a, max(gsd) AS b, median(gsd) AS c FROM g)
        SELECT {_r('a', 'gsd_min')}, {_r('b', 'gsd_max')}, {_r('c', 'gsd_median')}, {_r('(b - a) / c', 'variation')}, (b - a) / c > 0.25 AS warn FROM m""",
    "dataset_inspection": f"""WITH t AS (SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'val' ELSE 'test' END AS split, l_suppkey % 5 AS i, l_orderkey AS g, l_returnflag = 'R' AS pos, l_returnflag = 'A' AS hard, l_quantity::BIGINT AS q FROM lineitem),
        m AS (SELECT count(*) FILTER (split = 'train') AS train_tiles, count(*) FILTER (split = 'val') AS val_tiles, count(*) FILTER (split = 'test') AS test_tiles, count(*) FILTER (pos) AS positive_tiles, count(*) FILTER (NOT pos) AS empty_tiles,
          count(*) FILTER (NOT pos AND hard) AS hard_negative_tiles, count(DISTINCT i) AS sources, 0::BIGINT AS bad_values, 1 - sum(q) / (400.0 * count(*)) AS bg, 0::BIGINT AS leaking_groups FROM t)
        SELECT * EXCLUDE (bg), {_r('bg', 'background_fraction')}, array_to_string(list_filter([CASE WHEN train_tiles < 100 THEN 'train_tiles' END, CASE WHEN val_tiles < 100 THEN 'val_tiles' END, CASE WHEN test_tiles < 1000000000 THEN 'test_tiles' END,
          CASE WHEN sources < 3 THEN 'sources' END, CASE WHEN hard_negative_tiles < 10 THEN 'hard_negative_tiles' END, CASE WHEN bg < 0.5 THEN 'background' END], lambda z: z IS NOT NULL), ';') AS failures, 'rejected' AS status FROM m""",
    "bad_values": """SELECT count(*) FILTER (event_id % 17 = 0) AS n_nan, count(*) FILTER (event_id % 17 <> 0 AND event_id % 19 = 0) AS n_inf, count(*) FILTER (event_id % 23 = 0 OR value IS NULL) + count(*) FILTER (value IS NULL AND event_id % 17 <> 0 AND event_id % 19 <> 0) AS n_null FROM events""",
    "orientation_losses": f"""WITH p AS (SELECT sin(l_quantity * 0.1::DOUBLE + l_discount * 20) AS ps, cos(l_quantity * 0.1::DOUBLE + l_discount * 20) * 0.9::DOUBLE AS pc, sin(l_quantity * 0.1::DOUBLE) AS ts, cos(l_quantity * 0.1::DOUBLE) AS tc, (l_returnflag = 'R')::INT::DOUBLE AS w FROM lineitem),
        q AS (SELECT sum(w) AS w, sum(((ps - ts) ** 2 + (pc - tc) ** 2) * w) AS a, sum((CASE WHEN abs(ps - ts) < 1 THEN 0.5 * (ps - ts) ** 2 ELSE abs(ps - ts) - 0.5 END + CASE WHEN abs(pc - tc) < 1 THEN 0.5 * (pc - tc) ** 2 ELSE abs(pc - tc) - 0.5 END) * w) AS b,
          sum((1 - (ps * ts + pc * tc) / (sqrt(ps ** 2 + pc ** 2 + 1e-8) * sqrt(ts ** 2 + tc ** 2 + 1e-8))) * w) AS c FROM p), r AS (SELECT a / (w + 1e-8) AS mse, b / (w + 1e-8) AS smooth_l1, c / (w + 1e-8) AS cosine FROM q)
        SELECT {_r('mse')}, {_r('smooth_l1')}, {_r('cosine')}, {_r('r.mse + 0.5 * r.cosine', 'total')} FROM r""",
    "early_stopping": """WITH e AS (SELECT s_nationkey AS epoch, round(avg(s_acctbal), 2) AS score FROM supplier GROUP BY 1), b AS (SELECT *, max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM e),
        i AS (SELECT *, bf IS NULL OR score > bf + 10.0::DOUBLE AS improved, max(score) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM b), l AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS waited FROM i)
        SELECT epoch, score, best, improved, waited, bool_or(waited >= 4) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS stopped FROM l""",
    "tile_names": with_views("SELECT tile_id, 'input' || (group_id % 3)::VARCHAR || printf('_tile_%05d_r%05d_c%05d', tile_id % 100000, row_off, col_off) AS name FROM v_tiles", "v_tiles"),
    "negative_tiles": f"""WITH c AS ({RASTER_SQL['tile_classes']}), n AS (SELECT floor(count(*) FILTER (sampling_class = 'positive') * 0.5) AS n FROM c),
        o AS (SELECT *, row_number() OVER (ORDER BY (sampling_class <> 'hard_negative')::INT, md5('42:' || tile_id::VARCHAR), tile_id) - 1 AS p FROM c WHERE sampling_class <> 'positive')
        SELECT tile_id, sampling_class FROM c WHERE sampling_class = 'positive' UNION ALL SELECT tile_id, sampling_class FROM o, n WHERE p < n""",
    "file_catalogue": f"WITH {_FILES} SELECT * FROM fc",
    "sampled_files": f"WITH {_FILES}, k AS (SELECT path, path[1:4] AS run, row_number() OVER (PARTITION BY path[1:4] ORDER BY path) AS k FROM fc WHERE excluded_by IS NULL) SELECT path, run FROM k WHERE k <= CASE run WHEN 'run1' THEN 20 ELSE 12 END",
    "mask_components": with_views(f"WITH RECURSIVE {_MASK}, {_components('mk', 'cp')}, z AS (SELECT root, count(*) AS n_pixels FROM cp GROUP BY root) SELECT n_pixels, count(*) AS n FROM z GROUP BY n_pixels", "v_pixels"),
    "mask_branches": with_views(
        f"""WITH RECURSIVE {_MASK}, dg AS MATERIALIZED (SELECT a.row, a.col, count(b.row) AS k FROM (SELECT * FROM mk, {_NINE} WHERE dr <> 0 OR dc <> 0) a LEFT JOIN mk b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY a.row, a.col),
        nd AS MATERIALIZED (SELECT row, col FROM dg WHERE k <> 2), pt AS MATERIALIZED (SELECT row, col FROM dg WHERE k = 2), {_components('pt', 'cp')},
        tc AS (SELECT root, list(nd.row::BIGINT * 4294967296 + nd.col) AS ends FROM cp, {_NINE}, nd WHERE nd.row = cp.row + dr AND nd.col = cp.col + dc GROUP BY root),
        br AS (SELECT c.n + CASE WHEN ends IS NULL THEN 1 ELSE 2 END AS n_pixels, coalesce(ends[1] = ends[2], true) AS closed FROM (SELECT root, count(*) AS n FROM cp GROUP BY root) c LEFT JOIN tc USING (root)
          UNION ALL SELECT 2, false FROM nd a, {_NINE}, nd b WHERE b.row = a.row + dr AND b.col = a.col + dc AND (a.row, a.col) < (b.row, b.col))
        SELECT n_pixels, closed, count(*) AS n FROM br GROUP BY 1, 2""",
        "v_pixels",
    ),
    "morphology_open": with_views(f"WITH {_MASK}, d AS ({_moved('mk', _SQUARE, False)}), e AS ({_moved('d', _SQUARE, True)}) SELECT row::INT AS row, col::INT AS col FROM ({_moved('e', _SQUARE, False)})", "v_pixels"),
    "directional_close": with_views(
        f"WITH {_MASK}, " + ", ".join(f"g{i} AS ({_moved('mk', line, False)}), h{i} AS ({_moved(f'g{i}', line, True)})" for i, line in enumerate(_LINES)) + " SELECT DISTINCT row::INT AS row, col::INT AS col FROM (SELECT * FROM mk UNION ALL " + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(4)) + ")",
        "v_pixels",
    ),
    "small_components": with_views(
        f"""WITH RECURSIVE {_MASK}, {_components('mk', 'cp')}, kp AS (SELECT root FROM cp GROUP BY root HAVING count(*) >= 3 OR bool_or(row IN (0, 49)) OR bool_or(col = 0 OR col = (SELECT max(p_partkey) + 1 FROM part)))
        SELECT row, col FROM cp WHERE root IN (FROM kp)""",
        "v_pixels",
    ),
    "mask_agreement": with_views(
        f"""WITH a AS (SELECT row, col FROM v_pixels WHERE p >= {HIGH}), b AS (SELECT row, col FROM v_pixels WHERE p >= 0.85), m AS (SELECT (SELECT count(*) FROM a WHERE row % 2 = 0) AS pn, (SELECT count(*) FROM a JOIN b USING (row, col) WHERE row % 2 = 0) AS pk, (SELECT count(*) FROM b WHERE row % 2 = 0) AS tn),
        q AS (SELECT pk / (pn + 1e-8) AS p, pk / (tn + 1e-8) AS t FROM m) SELECT {_r('p', 'precision')}, {_r('t', 'recall')}, {_r('2 * p * t / (p + t + 1e-8)', 'cldice')} FROM q""",
        "v_pixels",
    ),
    "soft_cldice": with_views(
        f"""WITH {_soft(2)}, m AS (SELECT sum(sa * b0) / (sum(sa) + 1e-6) AS p, sum(sb * a0) / (sum(sb) + 1e-6) AS r FROM s2 JOIN (SELECT row, col, a AS a0, b AS b0 FROM s0) USING (row, col))
        SELECT {_r('p', 'precision')}, {_r('r', 'recall')}, {_r('1 - 2 * p * r / (p + r + 1e-6)', 'loss')} FROM m""",
        "v_pixels",
    ),
    "evaluation_means": f"""WITH b AS (SELECT avg(l_discount) AS x, avg(l_tax) AS y, avg(l_quantity) / 100 AS z FROM lineitem GROUP BY l_shipdate) SELECT {_r('avg(x)', 'val_loss')}, {_r('1 - avg(y)', 'val_row_dice')}, {_r('1 - avg(z)', 'val_center_cldice')} FROM b""",
    "burnt_rows": with_views(
        f"""WITH c AS (SELECT unnest(range(0, 40))::INT AS col), n AS (SELECT (max(y1) / 2)::INT + 3 AS n FROM v_rows),
        k AS (SELECT v.*, col, col + 0.5::DOUBLE AS px, unnest(range(greatest(0, floor(least(y0, y1) / 2)::INT - 2), floor(greatest(y0, y1) / 2)::INT + 3))::INT AS row FROM v_rows v, c),
        d AS (SELECT *, 2 * (row + 0.5::DOUBLE) AS py, greatest(0.0, least(1.0, ((px - x0) * (x1 - x0) + (2 * (row + 0.5::DOUBLE) - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM k),
        e AS (SELECT row, col, row_id, x1 - x0 AS dx, y1 - y0 AS dy, sqrt((px - x0 - t * (x1 - x0)) ** 2 + (py - y0 - t * (y1 - y0)) ** 2) AS d FROM d),
        b AS (SELECT row, col, min({{'d': round(d, 9), 'i': row_id, 'dx': dx, 'dy': dy}}) AS m FROM e WHERE d <= 0.6::DOUBLE GROUP BY row, col)
        SELECT row, col, m.i AS id, {_r('sin(2 * atan2(m.dy, m.dx))', 'sin2')}, {_r('cos(2 * atan2(m.dy, m.dx))', 'cos2')} FROM b""",
        "v_rows",
    ),
}
