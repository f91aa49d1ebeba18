"""Queries for metrics, calibration, splits and lineage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.scalar import utm_epsg
from rowloom.operators import lines, metrics
from rowloom.plans.line_queries import ORACLES as LINE_SQL
from rowloom.plans.line_queries import _r, rounded
from rowloom.plans.views import v_inputs, v_lineage, v_lines, v_points, v_pred, v_scores, v_tiles, with_views
from rowloom.sources.tables import table

THRESHOLDS = list(range(30, 91, 2))


def binary_metrics(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.binary_metrics(v_pred(s, d)), "precision", "recall", "f1", "iou", "dice")


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.threshold_sweep(v_scores(s, d), THRESHOLDS), "dice")


def threshold_choice(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.choose_threshold(metrics.threshold_sweep(v_scores(s, d), THRESHOLDS)), "dice")


def pixel_losses(s: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pixel_losses(v_scores(s, d).select((F.col("p") / 100).alias("p"), "y")), "focal", "dice", "fp")


def duplicate_inputs(s: SparkSession, d: str) -> DataFrame:
    return metrics.keep_best_input(v_inputs(s, d), ["c_nationkey", "c_mktsegment"], "n_lines", "input_id")


def _groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_nationkey").alias("group_id"), (F.col("c_acctbal") > 0).alias("positive"))


def split_allocation(s: SparkSession, d: str) -> DataFrame:
    return metrics.split_groups(_groups(s, d), 42)


def split_report(s: SparkSession, d: str) -> DataFrame:
    split = F.broadcast(metrics.split_groups(_groups(s, d), 42))  # a row for each of the nations
    return _groups(s, d).join(split, "group_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("positives"))


def leakage_check(s: SparkSession, d: str) -> DataFrame:
    """A split by tile number leaks groups; the count of those it leaks."""
    split = F.when(F.col("tile_id") % 4 == 0, "val").otherwise("train")
    return metrics.leaks(v_tiles(s, d).withColumn("split", split))


def lineage_normalise(s: SparkSession, d: str) -> DataFrame:
    return v_lineage(s, d).select("line_id", metrics.ids_json(metrics.parse_ids(F.col("ids"))).alias("ids_json"))


def lineage_union(s: SparkSession, d: str) -> DataFrame:
    return metrics.union_ids(v_lineage(s, d), "grp").select("grp", metrics.ids_json(F.col("ids")).alias("ids_json"))


def lineage_orphans(s: SparkSession, d: str) -> DataFrame:
    known = table(s, d, "nation").select(F.concat(F.lit("raw_"), F.col("n_nationkey").cast("string")).alias("id"))
    return metrics.orphans(v_lineage(s, d), known)


def unique_suffix_ids(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, F.lit("-1")).otherwise(F.col("c_mktsegment")).alias("name"))
    return metrics.unique_ids(c, "name", "c_custkey").select("c_custkey", "unique_id")


def utm_zone(s: SparkSession, d: str) -> DataFrame:
    return v_points(s, d).select("id", utm_epsg(F.col("x") * 170, F.col("y") * 80).alias("epsg"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    q = lines.quality(v_lines(s, d))
    return q.select(
        "line_id", (F.col("quality") == "INVALID").alias("review_required"), F.when(F.col("line_id") % 3 == 0, "unmatched").otherwise("valid_pair").alias("pair_status"),
        F.when(F.col("line_id") % 10 == 1, "failed").otherwise("clean").alias("serration_status"),
    )


def review_gate(s: SparkSession, d: str) -> DataFrame:
    j = _judged(s, d)
    return j.select("line_id", F.when(metrics.review(j), "manual_review").otherwise("approved").alias("status"))


def production_lines(s: SparkSession, d: str) -> DataFrame:
    j = _judged(s, d)
    j = j.withColumn("postprocess_status", F.when(metrics.review(j), "manual_review").otherwise("approved"))
    return metrics.production(j).select("line_id")


_ALL = (
    binary_metrics, threshold_sweep, threshold_choice, pixel_losses, duplicate_inputs, split_allocation, split_report, leakage_check,
    lineage_normalise, lineage_union, lineage_orphans, unique_suffix_ids, utm_zone, review_gate, production_lines,
)
QUERIES = {f.__name__: f for f in _ALL}

_SWEEP = f"""sw AS (SELECT threshold, tp, pp, tgt, 2 * tp / greatest(pp + tgt, 1) AS dice, pp / n <= 0.25 AND pp / greatest(tgt, 1) >= 0.25 AND pp / greatest(tgt, 1) <= 3 AS eligible FROM (
SELECT threshold, sum(CASE WHEN p >= threshold THEN y ELSE 0 END)::BIGINT AS tp, count(*) FILTER (p >= threshold) AS pp, sum(y)::BIGINT AS tgt, count(*) AS n FROM v_scores, (SELECT unnest({THRESHOLDS}) AS threshold) GROUP BY threshold))"""
_SPLIT = """g AS (SELECT DISTINCT c_nationkey AS group_id FROM customer), r AS (SELECT group_id, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || group_id::VARCHAR)) AS k FROM g),
v AS (SELECT *, greatest(1, round_even(n * 0.15, 0)) AS q FROM r),
o AS (SELECT *, greatest(0, 2 * q - (n - 1)) AS over FROM v), t AS (SELECT *, least(over, q - 1) AS less FROM o),
w AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE q - (over - less) END AS val, CASE WHEN n <= 2 THEN 0 ELSE q - less END AS test FROM t),
sp AS (SELECT group_id, CASE WHEN k <= n - val - test THEN 'train' WHEN k <= n - test THEN 'val' ELSE 'test' END AS split FROM w)"""
_PARSED = """list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(ids, '[\\[\\]"]', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')))"""
_JSON = """'["' || array_to_string({0}, '","') || '"]'"""
_QUALITY = LINE_SQL["line_quality_report"]
_JUDGED = f"""j AS (SELECT line_id, quality = 'INVALID' AS rr, line_id % 3 = 0 AS un, line_id % 10 = 1 AS fl FROM ({_QUALITY}))"""

ORACLES = {
    "binary_metrics": with_views(
        f"""WITH c AS (SELECT count(*) FILTER (pred = 1 AND target = 1) AS tp, count(*) FILTER (pred = 1 AND target = 0) AS fp, count(*) FILTER (pred = 0 AND target = 1) AS fn FROM v_pred),
        m AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c)
        SELECT {_r('p', 'precision')}, {_r('r', 'recall')}, {_r('2 * p * r / (p + r + 1e-8)', 'f1')}, {_r('tp / (tp + fp + fn + 1e-8)', 'iou')}, {_r('2 * tp / (2 * tp + fp + fn + 1e-8)', 'dice')} FROM m""",
        "v_pred",
    ),
    "threshold_sweep": with_views(f"WITH {_SWEEP} SELECT threshold, tp, pp, tgt, {_r('dice')}, eligible FROM sw", "v_scores"),
    "threshold_choice": with_views(
        f"""WITH {_SWEEP} SELECT threshold, {_r('dice')}, CASE WHEN eligible AND dice >= 0.3 THEN 'approved' WHEN eligible THEN 'below_minimum' ELSE 'no_eligible_threshold' END AS status
        FROM sw ORDER BY eligible DESC, round(sw.dice, 12) DESC, threshold LIMIT 1""",
        "v_scores",
    ),
    "pixel_losses": with_views(
        f"""WITH q AS (SELECT p / 100 AS p, y, least(greatest(p / 100, 1e-6), 1 - 1e-6) AS c FROM v_scores), t AS (SELECT *, CASE WHEN y = 1 THEN c ELSE 1 - c END AS pt FROM q)
        SELECT {_r('avg(-(CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END) * (1 - pt) ** 2 * ln(pt))', 'focal')}, {_r('1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1)', 'dice')}, {_r('sum(p * (1 - y)) / greatest(sum(1 - y), 1)', 'fp')} FROM t""",
        "v_scores",
    ),
    "duplicate_inputs": with_views("SELECT c_nationkey, c_mktsegment, arg_max(input_id, {'l': n_lines, 'i': -input_id}) AS kept_id, min(input_id) AS slot, count(*) AS n FROM v_inputs GROUP BY 1, 2", "v_inputs"),
    "split_allocation": f"WITH {_SPLIT} SELECT group_id, split FROM sp",
    "split_report": f"WITH {_SPLIT} SELECT split, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS positives FROM customer JOIN sp ON c_nationkey = group_id GROUP BY split",
    "leakage_check": with_views("SELECT count(*) AS n_leaks FROM (SELECT group_id FROM v_tiles GROUP BY group_id HAVING count(DISTINCT tile_id % 4 = 0) > 1)", "v_tiles"),
    "lineage_normalise": with_views(f"SELECT line_id, {_JSON.format(_PARSED)} AS ids_json FROM v_lineage", "v_lineage"),
    "lineage_union": with_views(f"WITH e AS (SELECT DISTINCT grp, unnest({_PARSED}) AS i FROM v_lineage) SELECT grp, {_JSON.format('list(i ORDER BY i)')} AS ids_json FROM e GROUP BY grp", "v_lineage"),
    "lineage_orphans": with_views(f"WITH e AS (SELECT DISTINCT unnest({_PARSED}) AS orphan FROM v_lineage) SELECT orphan FROM e WHERE orphan NOT IN (SELECT 'raw_' || n_nationkey::VARCHAR FROM nation)", "v_lineage"),
    "unique_suffix_ids": """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'generated' ELSE c_mktsegment END AS name FROM customer),
        k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1 AS k FROM n) SELECT c_custkey, CASE WHEN k = 0 THEN name ELSE name || '_' || k::VARCHAR END AS unique_id FROM k""",
    "utm_zone": with_views("SELECT id, (CASE WHEN y * 80 >= 0 THEN 32600 ELSE 32700 END + floor((x * 170 + 180) / 6)::INT + 1)::INT AS epsg FROM v_points", "v_points"),
    "review_gate": f"WITH {_JUDGED} SELECT line_id, CASE WHEN rr OR un OR fl THEN 'manual_review' ELSE 'approved' END AS status FROM j",
    "production_lines": f"WITH {_JUDGED} SELECT line_id FROM j WHERE NOT (rr OR un OR fl)",
}
