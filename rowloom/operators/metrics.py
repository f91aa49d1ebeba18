"""Metrics, calibration, splits and lineage: plain aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.durable import numbered


def binary_metrics(pairs: DataFrame) -> DataFrame:
    """One row: precision, recall, f1, iou and dice of (pred, target) rows of 0 and 1."""
    both = lambda p, t: F.sum(((F.col("pred") == p) & (F.col("target") == t)).cast("long"))
    c = pairs.agg(both(1, 1).alias("tp"), both(1, 0).alias("fp"), both(0, 1).alias("fn"))
    e, tp, fp, fn = 1e-8, F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = tp / (tp + fp + e), tp / (tp + fn + e)
    c = c.select("*", precision.alias("precision"), recall.alias("recall"))
    return c.select("precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + e)).alias("f1"), (tp / (tp + fp + fn + e)).alias("iou"), (2 * tp / (2 * tp + fp + fn + e)).alias("dice"))


def threshold_sweep(scores: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, tp, pp, tgt, n, dice, eligible) of (p, y) rows, p and thresholds in whole units.

    Rows are first counted by p, so the thresholds, a fixed short list, meet counts and not rows.
    """
    counts = scores.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("y"))
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    over = F.col("p") >= F.col("threshold")
    zero = F.lit(0)
    s = counts.select("p", "n", "y", t.alias("threshold")).groupBy("threshold").agg(
        F.sum(F.when(over, F.col("y")).otherwise(zero)).alias("tp"), F.sum(F.when(over, F.col("n")).otherwise(zero)).alias("pp"), F.sum("y").alias("tgt"), F.sum("n").alias("n")
    )
    dice = 2 * F.col("tp") / F.greatest(F.col("pp") + F.col("tgt"), F.lit(1))
    ratio = F.col("pp") / F.greatest(F.col("tgt"), F.lit(1))
    return s.select("threshold", "tp", "pp", "tgt", dice.alias("dice"), ((F.col("pp") / F.col("n") <= 0.25) & (ratio >= 0.25) & (ratio <= 3.0)).alias("eligible"))


def choose_threshold(sweep: DataFrame, least_dice: float = 0.30) -> DataFrame:
    """One row (threshold, dice, status): the best eligible threshold, the lowest of equals, else the best of all."""
    best = sweep.agg(F.max_by(F.struct("threshold", "dice", "eligible"), F.struct("eligible", F.round("dice", 12), -F.col("threshold"))).alias("b"))
    ok = F.col("b.eligible") & (F.col("b.dice") >= least_dice)
    return best.select("b.threshold", "b.dice", F.when(ok, "approved").when(F.col("b.eligible"), "below_minimum").otherwise("no_eligible_threshold").alias("status"))


def pixel_losses(scores: DataFrame, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """One row (focal, dice, fp): evaluation losses of probabilities p and targets y."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    pt = F.when(F.col("y") == 1, p).otherwise(1 - p)
    weight = F.when(F.col("y") == 1, alpha).otherwise(1 - alpha)
    y = F.col("y").cast("double")
    return scores.agg(
        F.avg(-weight * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)).alias("focal"),
        (1 - (2 * F.sum(F.col("p") * y) + 1) / (F.sum("p") + F.sum(y) + 1)).alias("dice"),
        (F.sum(F.col("p") * (1 - y)) / F.greatest(F.sum(1 - y), F.lit(1.0))).alias("fp"),
    )


def keep_best_input(inputs: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """(keys, kept_id, slot, n): of inputs with equal keys the one with the largest score, at the first one's place."""
    return inputs.groupBy(*keys).agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("kept_id"), F.min(order).alias("slot"), F.count(F.lit(1)).alias("n"))


def allocate(n: Column, ratios: tuple[float, float] = (0.15, 0.15)) -> tuple[Column, Column, Column]:
    """Groups for train, validation and test: none lost, at least one each from three on; halves round to even."""
    val, test = (F.greatest(F.lit(1), F.bround(n * r, 0).cast("long")) for r in ratios)
    over = F.greatest(F.lit(0), val + test - (n - 1))
    less = F.least(over, test - 1)
    test = test - less
    val = val - (over - less)
    val = F.when(n <= 1, 0).when(n == 2, 1).otherwise(val)
    test = F.when(n <= 2, 0).otherwise(test)
    return n - val - test, val, test


def split_groups(groups: DataFrame, seed: int) -> DataFrame:
    """(group_id, split): whole groups, in the order of a hash of seed and group, to train, val and test."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")))
    distinct = groups.select("group_id").distinct().withColumn("_key", key)
    placed = numbered(distinct, "_k", F.col("_key"), F.col("group_id"))
    sizes = distinct.agg(F.count(F.lit(1)).alias("_n"))
    ranked = placed.join(F.broadcast(sizes), F.lit(True)).withColumn("_k", F.col("_k") + 1)  # one row
    train, val, _ = allocate(F.col("_n"))
    return ranked.select("group_id", F.when(F.col("_k") <= train, "train").when(F.col("_k") <= train + val, "val").otherwise("test").alias("split"))


def leaks(tiles: DataFrame) -> DataFrame:
    """One row (n_leaks): groups that are in more than one split."""
    return tiles.groupBy("group_id").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("n_leaks"))


def parse_ids(text: Column) -> Column:
    """Sorted distinct ids written as a JSON array, joined by commas, or alone; null gives none."""
    plain = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r'[\[\]"]', ""), ",")
    return F.array_sort(F.array_distinct(F.filter(F.transform(plain, lambda x: F.trim(x)), lambda x: x != "")))


def ids_json(ids: Column) -> Column:
    return F.to_json(ids)


def union_ids(lines: DataFrame, key: str) -> DataFrame:
    """(key, ids): the sorted distinct ids of each key's lines; ids combine before the shuffle."""
    each = lines.select(key, F.explode(parse_ids(F.col("ids"))).alias("i")).distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("ids"))


def orphans(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(orphan): ids that lines refer to and known (id) does not hold."""
    return lines.select(F.explode(parse_ids(F.col("ids"))).alias("orphan")).distinct().join(known.select(F.col("id").alias("orphan")), "orphan", "left_anti")


def unique_ids(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """rows with unique_id: the id, then id_1, id_2, ... for its repeats; null or -1 is generated."""
    named = F.when(F.col(id_col).isNull() | (F.col(id_col) == "-1"), "generated").otherwise(F.col(id_col))
    k = F.row_number().over(Window.partitionBy("_id").orderBy(order)) - 1
    return rows.withColumn("_id", named).withColumn("_k", k).withColumn("unique_id", F.when(F.col("_k") == 0, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_k").cast("string")))).drop("_id", "_k")


def review(lines: DataFrame) -> Column:
    """Whether a line needs review: flagged, not in a valid pair, or failed for serration; absent columns do not count."""
    from rowloom.functions.scalar import is_true

    parts = [F.lit(False)]
    if "review_required" in lines.columns:
        parts.append(is_true(F.col("review_required")))
    if "pair_status" in lines.columns:
        parts.append(F.coalesce(F.col("pair_status") != "valid_pair", F.lit(True)))
    if "serration_status" in lines.columns:
        parts.append(F.coalesce(F.col("serration_status") == "failed", F.lit(False)))
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def production(lines: DataFrame) -> DataFrame:
    """Lines that are not under review, approved and clean; absent columns count as such."""
    from rowloom.functions.scalar import is_true

    ok = F.lit(True)
    if "review_required" in lines.columns:
        ok = ok & ~is_true(F.col("review_required"))
    if "postprocess_status" in lines.columns:
        ok = ok & (F.coalesce("postprocess_status", F.lit("approved")) == "approved")
    if "serration_status" in lines.columns:
        ok = ok & (F.coalesce("serration_status", F.lit("clean")) == "clean")
    return lines.where(ok)


# --- flags, provenance, gates --------------------------------------------------------------------


def any_true(lines: DataFrame, names: list[str]) -> Column:
    """Whether any of the named columns that are there is explicitly true."""
    from rowloom.functions.scalar import is_true

    return reduce(lambda a, b: a | b, [is_true(F.col(n)) for n in names if n in lines.columns], F.lit(False))


def any_positive(lines: DataFrame, names: list[str]) -> Column:
    """Whether any of the named columns that are there reads as a number above 0."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(n).try_cast("double") > 0, F.lit(False)) for n in names if n in lines.columns], F.lit(False))


#: The columns that tell of each change.
CHANGES = {"was_merged": ["track_merged"], "was_repaired": ["reference_repair", "kink_repair", "splice_repaired"], "was_reconstructed": ["was_reconstructed", "pair_reconstructed", "reconstructed_pair"]}
EXTENSIONS = ["terminal_extended_m", "fairing_terminal_extended_m"]


def provenance(lines: DataFrame, version: str) -> DataFrame:
    """lines with postprocess_version, was_merged, was_repaired, was_reconstructed, was_terminal_extended and source_type."""
    from rowloom.functions.scalar import refinement_source

    flags = {name: any_true(lines, names) for name, names in CHANGES.items()} | {"was_terminal_extended": any_positive(lines, EXTENSIONS)}
    out = lines.withColumns({"postprocess_version": F.lit(version)} | flags)
    told = F.coalesce("refinement_source", F.lit("original")) if "refinement_source" in lines.columns else refinement_source(*[(n, F.col(n)) for n in ("was_merged", "was_repaired", "was_terminal_extended")])
    return out.withColumn("source_type", F.when(F.col("was_reconstructed"), "reconstructed").otherwise(told))


def concat_rows(*frames: DataFrame) -> DataFrame:
    """The rows of all frames under all their columns, null where a frame lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def production_gate(final: DataFrame, rejected: DataFrame, on_unmatched: bool = True, on_crossing: bool = True, on_serration: bool = True) -> DataFrame:
    """One row of the counts of a finished network and whether it may go to production, with the reasons if not."""
    crossing = lambda df: F.count_if(any_true(df, ["has_crossing"]))
    unmatched = F.count_if(F.coalesce(F.col("pair_status") != "valid_pair", F.lit(True))) if "pair_status" in final.columns else F.count(F.lit(1))
    clean = ~review(final) & (F.coalesce("serration_status", F.lit("")) == "clean")
    flags = {f"{n}_count": F.count_if(any_true(final, [c])) for n, c in (("repaired", "was_repaired"), ("reconstructed", "was_reconstructed"), ("terminal_extended", "was_terminal_extended"))}
    own = final.agg(
        F.count(F.lit(1)).alias("final_line_count"), unmatched.alias("unmatched_count"), crossing(final).alias("final_crossing_count"), F.count_if(F.col("serration_status") == "failed").alias("serration_failed_count"),
        F.count_if(review(final)).alias("manual_review_count"), F.count_if(clean).alias("production_line_count"), *[c.alias(n) for n, c in flags.items()],
    )
    lost = rejected.agg(F.count(F.lit(1)).alias("rejected_count"), crossing(rejected).alias("rejected_crossing_count"))
    both = own.join(F.broadcast(lost), F.lit(True)).withColumn("crossing_count", F.col("final_crossing_count") + F.col("rejected_crossing_count"))  # one row each
    rules = (("unmatched_lines", on_unmatched, "unmatched_count"), ("crossings", on_crossing, "crossing_count"), ("residual_serration", on_serration, "serration_failed_count"))
    reasons = F.filter(F.array(*[F.when(F.lit(on) & (F.col(c) > 0), F.lit(n)) for n, on, c in rules]), lambda r: r.isNotNull())
    out = both.withColumn("production_gate_reasons", F.array_join(reasons, ";"))
    return out.withColumns({"production_gate_passed": F.col("production_gate_reasons") == "", "status": F.when(F.col("production_gate_reasons") == "", "completed").otherwise("manual_review")})


# --- datasets ------------------------------------------------------------------------------------


def gsd_report(inputs: DataFrame, most: float = 0.25) -> DataFrame:
    """One row (gsd_min, gsd_max, gsd_median, variation, warn) of inputs (gsd): the spread over the median, and whether it exceeds most."""
    m = inputs.agg(F.min("gsd").alias("gsd_min"), F.max("gsd").alias("gsd_max"), F.median("gsd").alias("gsd_median"))
    v = F.when(F.col("gsd_median") > 0, (F.col("gsd_max") - F.col("gsd_min")) / F.col("gsd_median"))
    return m.withColumn("variation", v).withColumn("warn", F.coalesce(F.col("variation") > most, F.lit(False)))


def inspect_tiles(tiles: DataFrame, minimums: dict[str, int], sources: int = 1, hard_negatives: int = 0, background: float = 0.0) -> DataFrame:
    """One row: counts of tiles (split, input_name, group_id, positive, sampling_class, n_bad, valid_pixels, positive_pixels), leakage, and
    status approved, or rejected with the failures joined by ;."""
    split = {s: F.count_if(F.col("split") == s) for s in ("train", "val", "test")}
    shared = tiles.groupBy("input_name", "group_id").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("leaking_groups"))
    m = tiles.agg(
        *[c.alias(f"{s}_tiles") for s, c in split.items()], F.count_if("positive").alias("positive_tiles"), F.count_if(~F.col("positive")).alias("empty_tiles"),
        F.count_if(~F.col("positive") & (F.col("sampling_class") == "hard_negative")).alias("hard_negative_tiles"), F.count_distinct("input_name").alias("sources"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad_values"),
        (1 - F.coalesce(F.try_divide(F.sum("positive_pixels"), F.sum("valid_pixels")), F.lit(0.0))).alias("background_fraction"),
    )
    both = m.join(F.broadcast(shared), F.lit(True))  # one row each
    rules = [F.when(F.col(f"{s}_tiles") < max(1, minimums.get(s, 1)), F.lit(f"{s}_tiles")) for s in split]
    rules += [F.when(F.col("sources") < sources, F.lit("sources")), F.when(F.col("hard_negative_tiles") < hard_negatives, F.lit("hard_negative_tiles")), F.when(F.col("background_fraction") < background, F.lit("background"))]
    rules += [F.when(F.col("bad_values") > 0, F.lit("bad_values")), F.when(F.col("leaking_groups") > 0, F.lit("leakage"))]
    failures = F.array_join(F.filter(F.array(*rules), lambda r: r.isNotNull()), ";")
    return both.withColumn("failures", failures).withColumn("status", F.when(F.col("failures") == "", "approved").otherwise("rejected"))


def bad_values(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n_nan, n_inf, n_null) over columns of numbers."""
    count = lambda f: reduce(lambda a, b: a + b, [f(F.col(c).cast("double")).cast("long") for c in columns])
    nan, inf = count(lambda c: F.coalesce(F.isnan(c), F.lit(False))), count(lambda c: F.coalesce(F.abs(c) == float("inf"), F.lit(False)))
    null = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns])
    return rows.agg(F.sum(nan).alias("n_nan"), F.sum(inf).alias("n_inf"), F.sum(null).alias("n_null"))


def orientation_losses(pixels: DataFrame) -> DataFrame:
    """One row (mse, smooth_l1, cosine) of (ps, pc, ts, tc, weight): predicted and true sine and cosine; 0 where nothing has weight."""
    ps, pc, ts, tc, w = (F.col(c) for c in ("ps", "pc", "ts", "tc", "weight"))
    square = F.pow(ps - ts, 2) + F.pow(pc - tc, 2)
    bent = lambda d: F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)
    size = lambda s, c: F.sqrt(s * s + c * c + 1e-8)
    cosine = 1 - (ps * ts + pc * tc) / (size(ps, pc) * size(ts, tc))
    sums = pixels.agg(F.sum(w).alias("w"), F.sum(square * w).alias("mse"), F.sum((bent(ps - ts) + bent(pc - tc)) * w).alias("smooth_l1"), F.sum(cosine * w).alias("cosine"))
    return sums.select(*[F.when(F.col("w") < 1e-5, 0.0).otherwise(F.col(c) / (F.col("w") + 1e-8)).alias(c) for c in ("mse", "smooth_l1", "cosine")])


def combined_loss(losses: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row of losses with total, their weighted sum."""
    return losses.withColumn("total", reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()], F.lit(0.0)))


def early_stopping(epochs: DataFrame, patience: int, least: float = 0.0) -> DataFrame:
    """(epoch, score, best, improved, waited, stopped): the best score so far, how many epochs ago it was reached, and whether a run that waits
    patience epochs has ended. A score improves if it exceeds the best so far by more than least."""
    w = Window.orderBy("epoch")
    # epochs are few: one window partition holds a run's history
    before = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = epochs.withColumn("improved", before.isNull() | (F.col("score") > before + least))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumns({"best": F.max("score").over(w.rowsBetween(Window.unboundedPreceding, 0)), "waited": F.col("epoch") - last})
    stopped = F.coalesce(F.max(F.col("waited") >= patience).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    return m.select("epoch", "score", "best", "improved", "waited", stopped.alias("stopped"))


def cluster_tiles(tiles: DataFrame, seed: int = 42) -> DataFrame:
    """(tile_id, group_id): tiles (tile_id, x, y) grouped by place: a tenth as many groups as tiles, 5 to 30, never more than tiles."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = tiles.count()
    k = min(n, max(1, min(max(5, n // 10), 30)))
    if k <= 1:
        return tiles.select("tile_id", F.lit(0).alias("group_id"))
    placed = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(tiles)
    return KMeans(k=k, seed=seed).fit(placed).transform(placed).select("tile_id", F.col("prediction").alias("group_id"))


#: Losses that are reported as one minus their mean.
COEFFICIENTS = ("row_dice", "center_dice", "center_cldice")


def evaluation(batches: DataFrame, prefix: str = "val_") -> DataFrame:
    """One row of the means of batches' losses, Dice and clDice turned to coefficients; no row without batches."""
    means = batches.agg(F.count(F.lit(1)).alias("_n"), *[(1 - F.avg(c) if c in COEFFICIENTS else F.avg(c)).alias(f"{prefix}{c}") for c in batches.columns])
    return means.where("_n > 0").drop("_n")
