"""Rasters as pixel rows (row, col, p) and tiles as boxes of pixels; neighbourhoods by explode and sum, without joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scalar import pixel_to_world, point_segment_distance, quality_flag, world_to_pixel
from rowloom.operators import kernels
from rowloom.operators.durable import cut, dealt, numbered, settled
from rowloom.operators.graph import connected_components

EIGHT = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]


def _spread(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(row, col): each pixel's place moved by each offset."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    return pixels.select("row", "col", F.explode(steps).alias("o")).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))


def degrees(mask: DataFrame) -> DataFrame:
    """(row, col, degree, kind): how many of its eight neighbours each pixel of a mask has."""
    own = mask.select("row", "col", F.lit(1).alias("own"), F.lit(0).alias("n"))
    near = _spread(mask, EIGHT).select("row", "col", F.lit(0).alias("own"), F.lit(1).alias("n"))
    d = own.unionByName(near).groupBy("row", "col").agg(F.max("own").alias("own"), F.sum("n").alias("degree")).where("own = 1")
    kind = F.when(F.col("degree") == 0, "isolated").when(F.col("degree") == 1, "endpoint").when(F.col("degree") == 2, "path").otherwise("junction")
    return d.select("row", "col", F.col("degree").cast("int").alias("degree"), kind.alias("kind"))


def dilate(mask: DataFrame) -> DataFrame:
    return _spread(mask, [*EIGHT, (0, 0)]).distinct()


def erode(mask: DataFrame) -> DataFrame:
    return _spread(mask, [*EIGHT, (0, 0)]).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where("n = 9").select("row", "col")


def close(mask: DataFrame) -> DataFrame:
    """Dilation, then erosion, by a square of three."""
    return erode(dilate(mask))


def open_(mask: DataFrame) -> DataFrame:
    return dilate(erode(mask))


def pixel_id(row: Column, col: Column) -> Column:
    return row.cast("long") * (1 << 32) + col.cast("long")


def _block(at: str, size: int) -> Column:
    return F.floor(F.col(at) / size).cast("int")


def pixel_components(mask: DataFrame, block: int = 2048) -> DataFrame:
    """(row, col, root, and the other columns of mask): 8-connected components, named by their smallest pixel.

    Blocks are labelled by themselves; then only labels that touch across a block's edge are joined, so
    that the rounds of the graph run over edge contacts and not over pixels.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mask.schema)
    dealt = mask.withColumns({"_br": _block("row", block), "_bc": _block("col", block)})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        return frame.drop(columns=["_br", "_bc"]).assign(_label=kernels.labels(rows, cols))

    local = cut(dealt.groupBy("_br", "_bc").applyInPandas(run, f"{kind}, _label long"))
    first_row, first_col = F.pmod("row", F.lit(block)), F.pmod("col", F.lit(block))
    edge = local.where((first_row == 0) | (first_row == block - 1) | (first_col == 0) | (first_col == block - 1))
    edge = edge.select("row", "col", F.col("_label").alias("a"), _block("row", block).alias("br"), _block("col", block).alias("bc"))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    ahead = edge.select("a", "row", "col", "br", "bc", F.explode(steps).alias("o")).select("a", "br", "bc", (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    ahead = ahead.where((_block("row", block) != F.col("br")) | (_block("col", block) != F.col("bc"))).select("a", "row", "col")
    links = cut(ahead.join(edge.select("row", "col", F.col("a").alias("b")), ["row", "col"]).select("a", "b").distinct())
    if links.isEmpty():
        return local.withColumnRenamed("_label", "root")
    roots = connected_components(links)
    return local.join(roots, F.col("_label") == F.col("v"), "left").select(*mask.columns, F.coalesce("root", "_label").alias("root"))


def hysteresis(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """(row, col): components of pixels at low or above that hold one at high or above."""
    parts = pixel_components(pixels.where(F.col("p") >= low).select("row", "col", (F.col("p") >= high).alias("seed")))
    kept = parts.where("seed").select("root").distinct()
    return parts.join(kept, "root", "left_semi").select("row", "col")


def drop_small(mask: DataFrame, least: int, rows: int, cols: int) -> DataFrame:
    """A mask without components below least pixels; those that touch the border stay."""
    parts = pixel_components(mask.select("row", "col"))
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1)
    kept = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max(edge).alias("edge")).where((F.col("n") >= least) | F.col("edge"))
    return parts.join(kept.select("root"), "root", "left_semi").select("row", "col")


def lookup(points: DataFrame, pixels: DataFrame, transform: tuple[float, ...]) -> DataFrame:
    """points (with x, y) and p of the pixel that holds each; null where there is none."""
    row, col = world_to_pixel(F.col("x"), F.col("y"), *transform)
    return points.withColumns({"row": row, "col": col}).join(pixels.select("row", "col", "p"), ["row", "col"], "left")


def _corners(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, col, w): the four pixels around fractional places (keys, row_f, col_f), and their shares."""
    r, c = F.floor("row_f").cast("int"), F.floor("col_f").cast("int")
    fr, fc = F.col("row_f") - r, F.col("col_f") - c
    corners = F.array(*[F.struct((r + i).alias("row"), (c + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    return points.select(*keys, F.explode(corners).alias("_c")).select(*keys, "_c.row", "_c.col", "_c.w")


def bilinear(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """(id, value) at fractional pixel places (id, row_f, col_f); a missing corner counts as 0."""
    found = _corners(points, "id").join(pixels.select("row", "col", "p"), ["row", "col"], "left")
    return found.groupBy("id").agg(F.sum(F.coalesce(F.col("p") * F.col("w"), F.lit(0.0))).alias("value"))


def bilinear_found(points: DataFrame, pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, value) as bilinear, of the places (keys, row_f, col_f) with a pixel at a corner; corners off the pixels' box are not looked for."""
    box = pixels.agg(*[f(c).alias(f"_{n}_{c}") for c in ("row", "col") for n, f in (("lo", F.min), ("hi", F.max))])
    near = points.join(F.broadcast(box), (F.col("row_f") > F.col("_lo_row") - 1) & (F.col("row_f") < F.col("_hi_row") + 1) & (F.col("col_f") > F.col("_lo_col") - 1) & (F.col("col_f") < F.col("_hi_col") + 1))  # one row
    return _corners(near, *keys).join(dealt(pixels.select("row", "col", "p")), ["row", "col"]).groupBy(*keys).agg(F.sum(F.coalesce(F.col("p") * F.col("w"), F.lit(0.0))).alias("value"))


def sample_rows(rows: DataFrame, spacing: float) -> DataFrame:
    """(id, k, x, y): points at even steps of at most spacing along straight rows, ends included."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    n = F.greatest(F.lit(2), F.ceil(length / spacing).cast("int") + 1)
    k = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / (F.col("n") - 1)
    return k.select("id", "k", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def row_probabilities(rows: DataFrame, pixels: DataFrame, transform: tuple[float, ...], spacing: float) -> DataFrame:
    """(id, mean, median, p20, quality_flag) of the pixels under each row; places off the raster are skipped."""
    got = lookup(sample_rows(rows, spacing), pixels, transform)
    m = got.groupBy("id").agg(F.avg("p").alias("mean"), F.median("p").alias("median"), F.percentile("p", F.lit(0.2)).alias("p20"))
    return m.withColumn("quality_flag", quality_flag(F.round("mean", 9)))


def offsets(size: Column, tile: int, step: int) -> Column:
    """Starts of tiles along a side: every step, the last one snapped to the end."""
    last = F.greatest(F.lit(0), size - tile)
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))))


def tile_grid(rasters: DataFrame, tile: int, step: int) -> DataFrame:
    """(raster_id, row_off, col_off, valid_fraction) of rasters (raster_id, height, width, and a valid box)."""
    g = rasters.withColumn("row_off", F.explode(offsets(F.col("height"), tile, step))).withColumn("col_off", F.explode(offsets(F.col("width"), tile, step)))
    span = lambda o, lo, hi: F.greatest(F.lit(0), F.least(F.col(o) + tile, F.col(hi)) - F.greatest(F.col(o), F.col(lo)))
    return g.select("raster_id", "row_off", "col_off", (span("row_off", "row_lo", "row_hi") * span("col_off", "col_lo", "col_hi") / (tile * tile)).alias("valid_fraction"))


def covering_tiles(pixels: DataFrame, size: int, step: int, last_row: Column, last_col: Column) -> DataFrame:
    """pixels with row_off and col_off of each regular tile that covers them, by arithmetic."""
    def starts(at: Column, last: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step).cast("int") * step)
        to = F.least(F.floor(at / step).cast("int") * step, last)
        return F.when(first <= to, F.sequence(first, to, F.lit(step))).otherwise(F.array().cast("array<int>"))

    return pixels.withColumn("row_off", F.explode(starts(F.col("row"), last_row))).withColumn("col_off", F.explode(starts(F.col("col"), last_col)))


def triangle_weight(at: Column, size: int) -> Column:
    return 1 - F.abs((2 * at + 1) / F.lit(float(size)) - 1)


def blend(predicted: DataFrame, size: int) -> DataFrame:
    """(row, col, p): tile predictions (row, col, row_off, col_off, p) weighted towards each tile's middle."""
    w = F.greatest(F.lit(1e-4), triangle_weight(F.col("row") - F.col("row_off"), size) * triangle_weight(F.col("col") - F.col("col_off"), size))
    s = predicted.withColumn("w", w).groupBy("row", "col").agg(F.sum(F.col("p") * F.col("w")).alias("a"), F.sum("w").alias("b"))
    return s.select("row", "col", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("a") / F.greatest("b", F.lit(1e-8)))).alias("p"))


def largest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def directional_close(mask: DataFrame, reach: int = 1) -> DataFrame:
    """A mask closed along rows, columns and both diagonals: a gap of up to 2 * reach pixels between two set pixels of a direction is filled.

    Closing by a segment of 2 * reach + 1 pixels; the union over the four directions.
    """
    out = mask.select("row", "col")
    for r, c in ((0, 1), (1, 0), (1, 1), (1, -1)):
        line = [(k * r, k * c) for k in range(-reach, reach + 1)]
        grown = _spread(mask, line).distinct()
        shrunk = _spread(grown, line).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2 * reach + 1)
        out = out.unionByName(shrunk.select("row", "col"))
    return out.distinct()


def thinned(mask: DataFrame, block: int = 512, halo: int = 64) -> DataFrame:
    """(row, col): a mask thinned by Guo and Hall's rule, the same for any block and halo (an even number).

    A pixel's fate in a pass rests on its neighbours alone. So a block with a halo takes halo passes that
    are right for the block's own pixels; then halos are exchanged, until no pixel goes.
    """
    if halo < 2 or halo % 2:
        raise ValueError("halo must be an even number of pixels")
    state, count = cut(mask.select("row", "col").distinct()), None
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block))
    side = block + 2 * halo

    def run(f: pd.DataFrame) -> pd.DataFrame:
        top, left = int(f["br"].iloc[0]) * block - halo, int(f["bc"].iloc[0]) * block - halo
        image = np.zeros((side, side), bool)
        image[f["row"].to_numpy() - top, f["col"].to_numpy() - left] = True
        r, c = np.nonzero(kernels.thin(image, halo // 2)[halo : halo + block, halo : halo + block])
        return pd.DataFrame({"row": (r + top + halo).astype("int32"), "col": (c + left + halo).astype("int32")})

    while (now := state.count()) != count:
        count = now
        dealt = state.select("row", "col", F.explode(span("row")).alias("br")).select("row", "col", "br", F.explode(span("col")).alias("bc"))
        state = cut(dealt.groupBy("br", "bc").applyInPandas(run, "row int, col int"))
    return state


def branches(mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The branches of a skeleton: (branch, n_pixels, closed, end_a, end_b) and their pixels (branch, row, col, node).

    Nodes are the pixels that have not two neighbours. Two nodes side by side are a branch; so is a component of
    other pixels with the nodes that it touches, or by itself if it touches none. A branch is named
    by its smallest inner pixel, or by its first node and a negative number; closed: it begins where it ends.
    """
    marked = cut(degrees(mask).select("row", "col", pixel_id(F.col("row"), F.col("col")).alias("v"), (F.col("degree") != 2).alias("node")))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in EIGHT])
    nodes = marked.where("node").select("row", "col", "v")
    near = nodes.select("v", F.explode(steps).alias("o"), "row", "col").select(F.col("v").alias("at"), (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"))
    inner = pixel_components(marked.where("NOT node").select("row", "col")).withColumnRenamed("root", "branch")
    touches = near.join(inner, ["row", "col"]).select("branch", "at")
    size = inner.groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
    ends = touches.groupBy("branch").agg(F.array_sort(F.collect_list("at")).alias("ends"))  # two at most
    runs = size.join(ends, "branch", "left").select(
        "branch", (F.col("n") + F.when(F.col("ends").isNull(), 1).otherwise(2)).alias("n_pixels"),
        (F.col("ends").isNull() | (F.get("ends", F.lit(0)) == F.get("ends", F.lit(1)))).alias("closed"), F.get("ends", F.lit(0)).alias("end_a"), F.get("ends", F.lit(1)).alias("end_b"),
    )
    pairs = near.join(nodes, ["row", "col"]).where("at < v").select((-F.xxhash64("at", "v") % (1 << 62)).alias("h"), "at", "v")
    pairs = pairs.select((-F.abs("h") - 1).alias("branch"), F.lit(2).cast("long").alias("n_pixels"), F.lit(False).alias("closed"), F.col("at").alias("end_a"), F.col("v").alias("end_b"))
    every = runs.unionByName(pairs)
    place = lambda v: [F.shiftright(v, 32).cast("int").alias("row"), (F.col(v) % (1 << 32)).cast("int").alias("col")]
    at_ends = every.where("end_a IS NOT NULL").select("branch", F.explode(F.array_distinct(F.array("end_a", "end_b"))).alias("v")).select("branch", *place("v"), F.lit(True).alias("node"))
    return every, inner.select("branch", "row", "col", F.lit(False).alias("node")).unionByName(at_ends)


def vectorize(pixels: DataFrame, transform: tuple[float, ...], least: int = 2) -> DataFrame:
    """(line_id, pos, x, y): branches of least pixels or more (branch, row, col, node) as lines through pixel centres, in order."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        order = kernels.chain(f["row"].to_numpy(np.int64), f["col"].to_numpy(np.int64), f["node"].to_numpy(bool))
        if len(order) < least:
            order = order[:0]
        return pd.DataFrame({"line_id": f["branch"].iloc[0], "pos": np.arange(len(order)), "row": f["row"].to_numpy()[order], "col": f["col"].to_numpy()[order]})

    ordered = pixels.groupBy("branch").applyInPandas(run, "line_id long, pos long, row int, col int")
    x, y = pixel_to_world(F.col("row"), F.col("col"), *transform)
    return ordered.select("line_id", "pos", x.alias("x"), y.alias("y"))


def skeleton_agreement(predicted: DataFrame, target: DataFrame, predicted_lines: DataFrame, target_lines: DataFrame) -> DataFrame:
    """One row: precision, recall and cldice of two masks (row, col) and their skeletons; 1 if all are empty, 0 if one side is."""
    inside = lambda lines, mask: lines.join(mask.withColumn("hit", F.lit(1)), ["row", "col"], "left").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("k"))
    p = inside(predicted_lines.select("row", "col"), target.select("row", "col").distinct()).select(F.col("n").alias("pn"), F.coalesce("k", F.lit(0)).alias("pk"))
    t = inside(target_lines.select("row", "col"), predicted.select("row", "col").distinct()).select(F.col("n").alias("tn"), F.coalesce("k", F.lit(0)).alias("tk"))
    both = p.join(F.broadcast(t), F.lit(True))  # one row each
    share = lambda k, n: (F.col(k) / (F.col(n) + 1e-8))
    a, b = share("pk", "pn"), share("tk", "tn")
    value = F.when((F.col("pn") == 0) & (F.col("tn") == 0), 1.0).when((F.col("pn") == 0) | (F.col("tn") == 0), 0.0).otherwise(2 * a * b / (a + b + 1e-8))
    return both.select(a.alias("precision"), b.alias("recall"), value.alias("cldice"))


def burn(rows: DataFrame, transform: tuple[float, ...], height: int, width: int, reach: float) -> DataFrame:
    """(row, col, id, sin2, cos2): pixels whose centres lie within reach of a straight row (id, x0, y0, x1, y1), with the
    doubled-angle direction of the nearest one (ties by id). The transform has no rotation."""
    a, _, c, _, e, f = transform
    lo = lambda p, q, o, s: F.floor(F.least((F.least(p, q) - reach - o) / s, (F.greatest(p, q) + reach - o) / s)).cast("int")
    hi = lambda p, q, o, s: F.ceil(F.greatest((F.least(p, q) - reach - o) / s, (F.greatest(p, q) + reach - o) / s)).cast("int")
    x0, y0, x1, y1 = (F.col(n) for n in ("x0", "y0", "x1", "y1"))
    span = lambda low, high, n: F.sequence(F.greatest(F.lit(0), low), F.greatest(F.lit(0), F.least(F.lit(n - 1), high)))
    cells = rows.withColumn("col", F.explode(span(lo(x0, x1, c, a), hi(x0, x1, c, a), width)))
    # within a column only the rows that the segment passes there, widened by reach and by its slope
    px = a * (F.col("col") + 0.5) + c
    t = lambda x: F.when(x1 != x0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x0) / (x1 - x0))))
    ya, yb = F.coalesce(y0 + t(px - reach) * (y1 - y0), y0), F.coalesce(y0 + t(px + reach) * (y1 - y0), y1)
    cells = cells.withColumns({"_ya": ya, "_yb": yb})
    cells = cells.withColumn("row", F.explode(span(lo(F.col("_ya"), F.col("_yb"), f, e), hi(F.col("_ya"), F.col("_yb"), f, e), height)))
    py = e * (F.col("row") + 0.5) + f
    d = point_segment_distance(a * (F.col("col") + 0.5) + c, py, x0, y0, x1, y1)
    near = settled(cells.withColumn("_d", d), "_d").where(F.col("_d") <= reach)
    best = near.groupBy("row", "col").agg(F.min(F.struct(F.round("_d", 9).alias("d"), F.col("id").alias("id"), (x1 - x0).alias("dx"), (y1 - y0).alias("dy"))).alias("b"))
    angle = 2 * F.atan2(F.col("b.dy"), F.col("b.dx"))
    return best.select("row", "col", F.col("b.id").alias("id"), F.sin(angle).alias("sin2"), F.cos(angle).alias("cos2"))


def keep_negatives(tiles: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """tiles (tile_id, sampling_class): all positive ones, and of the others, in the order of a seeded hash, at most
    floor(ratio * number of positive ones); hard negatives first."""
    n = tiles.agg(F.floor(F.count_if(F.col("sampling_class") == "positive") * ratio).alias("n"))
    others = tiles.where("sampling_class <> 'positive'").withColumns({"_hard": (F.col("sampling_class") != "hard_negative").cast("int"), "_key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("tile_id").cast("string")))})
    placed = numbered(others, "_place", F.col("_hard"), F.col("_key"), F.col("tile_id"))
    kept = placed.join(F.broadcast(n), F.lit(True)).where(F.col("_place") < F.col("n"))  # one row
    return tiles.where("sampling_class = 'positive'").unionByName(kept.select(tiles.columns))


def _pooled(df: DataFrame, columns: list[str], best) -> DataFrame:
    """(row, col, columns): the least or largest value of each column among a pixel and its neighbours in df."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in [*EIGHT, (0, 0)]])
    near = df.select("row", "col", *columns, F.explode(steps).alias("o")).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), *columns, (F.col("o.r").eqNullSafe(0) & F.col("o.c").eqNullSafe(0)).alias("own"))
    return near.groupBy("row", "col").agg(*[best(c).alias(c) for c in columns], F.max("own").alias("own")).where("own").drop("own")


def soft_skeletons(df: DataFrame, columns: list[str], rounds: int = 5) -> DataFrame:
    """(row, col, columns, skeleton_ and each column): what opening takes off values from 0 to 1, over rounds of erosion.

    Pixels that df lacks are outside and count in no neighbourhood.
    """
    state = cut(df.select("row", "col", *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))).alias(f"_{c}") for c in columns], *[F.col(c) for c in columns], *[F.lit(0.0).alias(f"skeleton_{c}") for c in columns]))
    work = [f"_{c}" for c in columns]
    for _ in range(rounds):
        eroded = cut(_pooled(state, work, F.min))
        opened = _pooled(eroded, work, F.max).withColumnsRenamed({c: f"{c}_o" for c in work})
        both = state.join(eroded.withColumnsRenamed({c: f"{c}_e" for c in work}), ["row", "col"]).join(opened, ["row", "col"])
        taken = {f"skeleton{c}": F.greatest(F.col(f"skeleton{c}"), F.col(c) - F.col(f"{c}_o")) for c in work}
        state = cut(both.withColumns(taken).withColumns({c: F.col(f"{c}_e") for c in work}).drop(*[f"{c}_{k}" for c in work for k in "eo"]))
    return state.drop(*work)


def soft_cldice(df: DataFrame, rounds: int = 5) -> DataFrame:
    """One row (precision, recall, loss) of probabilities p and targets y (row, col, p, y) by their soft skeletons."""
    s = soft_skeletons(df, ["p", "y"], rounds)
    m = s.agg(F.sum(F.col("skeleton_p") * F.col("y")).alias("a"), F.sum("skeleton_p").alias("b"), F.sum(F.col("skeleton_y") * F.col("p")).alias("c"), F.sum("skeleton_y").alias("d"))
    m = m.select((F.col("a") / (F.col("b") + 1e-6)).alias("precision"), (F.col("c") / (F.col("d") + 1e-6)).alias("recall"))
    return m.withColumn("loss", 1 - 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-6))
