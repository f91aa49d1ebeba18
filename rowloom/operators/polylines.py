"""Networks of polylines (line_id, pos, x, y): measures of neighbours, duplicates, tracks, references, merges.

Lines meet by their segments on grid cells. What a pair is measured by comes from points of the shorter
line against the segments of the longer one, as rows that aggregate before they are shuffled; no line is
gathered with its neighbours in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scalar import angle_difference, axial_bearing, pca_bearing, point_segment_distance, project_on_segment, turn_degrees
from rowloom.operators import graph, lines, network, spatial
from rowloom.operators.durable import cut, dealt, numbered, settled

def shapes(v: DataFrame) -> DataFrame:
    """A row for each line of two vertices or more: n, length, its ends a and b, the outward vectors there, and the bearing
    of the main axis of its vertices (all, and a sample)."""
    path = Window.partitionBy("line_id").orderBy("pos")
    step = F.hypot(F.col("x") - F.lag("x").over(path), F.col("y") - F.lag("y").over(path))
    m = v.withColumns({"step": step, "nx": F.lead("x").over(path), "ny": F.lead("y").over(path), "px": F.lag("x").over(path), "py": F.lag("y").over(path)})
    first = F.min_by(F.struct("x", "y", (F.col("x") - F.col("nx")).alias("ux"), (F.col("y") - F.col("ny")).alias("uy")), "pos")
    last = F.max_by(F.struct("x", "y", (F.col("x") - F.col("px")).alias("ux"), (F.col("y") - F.col("py")).alias("uy")), "pos")
    own = m.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), first.alias("a"), last.alias("b"),
        pca_bearing(F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")).alias("bearing"),
    )
    axis = lines.vertex_samples(v).groupBy("line_id").agg(pca_bearing(F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")).alias("bearing20"))
    return own.where("n >= 2").join(dealt(axis), "line_id")


def _boxes(s: DataFrame) -> DataFrame:
    """Segments with no more than their line's number, ends and boxes: a grid join sends each column to every cell."""
    return spatial.boxed(s.select(F.col("line_id").alias("id"), "x0", "y0", "x1", "y1")).drop("length")


def near_lines(v: DataFrame, radius: float, cell: float, others: DataFrame | None = None) -> DataFrame:
    """(i, j, nearest): lines within radius of each other, i < j; or of v and others, whatever their numbers."""
    a = _boxes(lines.segments(v))
    b = a if others is None else _boxes(lines.segments(others))
    p = spatial.grid_join(a, b, spatial.BOX, radius, cell)
    if others is None:
        p = p.where("l.id < r.id")
    p = settled(p.withColumn("_d", spatial.segment_distance("l", "r")), "_d").where(F.col("_d") <= radius)
    return p.groupBy(F.col("l.id").alias("i"), F.col("r.id").alias("j")).agg(F.min("_d").alias("nearest"))


def even_points(v: DataFrame, most: int = lines.SAMPLES) -> DataFrame:
    """(line_id, k, x, y): points at even arc lengths, as many as whole metres but two at least and most at most; the ends included."""
    s = lines.segments(v).where("length > 0 AND d1 > d0")
    n = F.greatest(F.lit(2), F.least(F.lit(most), F.floor("length").cast("int")))
    s = s.withColumn("n", n).withColumn("gap", F.col("length") / (F.col("n") - 1))
    last = F.when(F.col("d1") == F.col("length"), F.col("n") - 1).otherwise(F.ceil(F.col("d1") / F.col("gap")).cast("int") - 1)
    s = s.withColumn("first", F.ceil(F.col("d0") / F.col("gap")).cast("int")).withColumn("last", F.least(last, F.col("n") - 1)).where("first <= last")
    p = s.withColumn("k", F.explode(F.sequence("first", "last")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") * F.col("gap") - F.col("d0")) / (F.col("d1") - F.col("d0"))))
    return p.select("line_id", F.col("k").cast("long").alias("k"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def against(points: DataFrame, targets: DataFrame, v: DataFrame) -> DataFrame:
    """(p, t, k, d, at): for the points (line_id, k, x, y) of p, with targets (p, t), the distance d from line t and the arc
    length at of the nearest place on it (the first of several)."""
    s = lines.segments(v).select(F.col("line_id").alias("t"), F.col("pos").alias("sp"), "x0", "y0", "x1", "y1", "d0")
    met = targets.join(dealt(points.withColumnRenamed("line_id", "p")), "p").join(dealt(s), "t")
    e = [F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]
    one = F.struct(F.round(point_segment_distance(*e), 12).alias("d"), "sp", (F.col("d0") + project_on_segment(*e)).alias("at"))
    return met.groupBy("p", "t", "k").agg(F.min(one).alias("m")).select("p", "t", "k", F.col("m.d").alias("d"), F.col("m.at").alias("at"))


def measures(v: DataFrame, pairs: DataFrame, by_vertices: bool = False) -> DataFrame:
    """(i, j, distance, mean, angle, overlap) of pairs (i, j) of lines.

    distance and mean: median and mean of the distances of the shorter line's points (even ones, or a sample of its
    vertices; of equal lines i's) from the other; angle: between the main axes; overlap: the shorter line's
    ends projected on the other, over its length.
    """
    s = shapes(v).select(F.col("line_id").alias("id"), F.round("length", 9).alias("len"), "length", "bearing20")
    both = pairs.select("i", "j")
    for side in "ij":
        both = both.join(dealt(s.select(*[F.col(c).alias(f"{side}{c}") for c in ("id", "len", "length", "bearing20")])), F.col(side) == F.col(f"{side}id")).drop(f"{side}id")
    first = F.col("ilen") <= F.col("jlen")
    both = both.withColumns({"p": F.when(first, F.col("i")).otherwise(F.col("j")), "t": F.when(first, F.col("j")).otherwise(F.col("i")), "short": F.when(first, F.col("ilength")).otherwise(F.col("jlength"))})
    # settled: conditions on the measures stay above the joins
    both = settled(both.withColumn("angle", angle_difference(F.col("ibearing20"), F.col("jbearing20"))), "angle")
    targets = both.select("p", "t")
    points = lines.vertex_samples(v).withColumnRenamed("pos", "k") if by_vertices else even_points(v)
    d = against(points, targets, v).groupBy("p", "t").agg(
        F.median("d").alias("distance"), F.avg("d").alias("mean"), F.abs(F.max_by("at", "k") - F.min_by("at", "k")).alias("span")
    )
    out = both.join(dealt(d), ["p", "t"]).withColumn("overlap", F.when(F.col("short") >= 1e-6, F.col("span") / F.col("short")).otherwise(F.lit(0.0)))
    return out.select("i", "j", "distance", "mean", "angle", "overlap")


# --- pairs, duplicates, tracks -------------------------------------------------------------------


def pair_scores(v: DataFrame, spacing: network.Spacing, preliminary: bool = False, cell: float = 8.0) -> DataFrame:
    """Measures of neighbouring lines, as network.scores gives them for straight rows."""
    reach = spacing.intra_max + spacing.tolerance if preliminary else spacing.reach
    return network.scores(measures(v, near_lines(v, reach, max(cell, reach))), spacing, preliminary)


def pair_lines(v: DataFrame, spacing: network.Spacing, preliminary: bool = False) -> DataFrame:
    """A row for each line of two vertices or more: its pair, status and neighbour measures (network.assign)."""
    ids = shapes(v).select(F.col("line_id").alias("id"))
    return network.assign(ids, pair_scores(v, spacing, preliminary), spacing)


def spacing_samples(v: DataFrame, reach: float = 2.5, max_angle: float = 10.0, min_overlap: float = 0.35, most: int = 2000, cell: float = 8.0) -> DataFrame:
    """(i, rank, distance): the two nearest parallel, overlapping neighbours of at most most lines, even by number."""
    ids = shapes(v).select("line_id")
    chosen = evenly(ids, "line_id", most)
    near = cut(near_lines(v, reach, cell))
    both = near.select("i", "j").unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"))).join(chosen.withColumnRenamed("line_id", "i"), "i", "left_semi")
    m = cut(measures(v, both.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()))
    m = m.where((F.col("angle") <= max_angle) & (F.col("overlap") >= min_overlap) & (F.col("distance") > 0) & (F.col("distance") <= reach))
    each = m.select("i", "j", "distance").unionByName(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")).join(chosen.withColumnRenamed("line_id", "i"), "i", "left_semi")
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    return each.withColumn("rank", rank).where("rank <= 2").select("i", "rank", "distance")


def evenly(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most most rows, even by their place in the order of a unique key, the first and last included."""
    n = rows.count()
    if n <= most:
        return rows
    placed = numbered(rows, "_place", F.col(key))
    gap = (n - 1) / (most - 1)
    k = F.ceil(F.col("_place") / gap - 1e-9)
    hit = lambda q: (q >= 0) & (q < most - 1) & (F.floor(q * gap) == F.col("_place"))
    return placed.where(hit(k) | hit(k + 1) | (F.col("_place") == n - 1)).drop("_place")


def duplicate_links(v: DataFrame, max_distance: float = 0.20, max_angle: float = 5.0, min_overlap: float = 0.70, cell: float = 8.0) -> DataFrame:
    """(a, b, mean): lines that lie on one another, by the mean distance of the shorter one's vertex sample."""
    m = measures(v, near_lines(v, max_distance, cell), by_vertices=True)
    return m.where((F.col("mean") < max_distance) & (F.col("angle") <= max_angle) & (F.col("overlap") >= min_overlap)).select(F.col("i").alias("a"), F.col("j").alias("b"), "mean")


def drop_duplicates(v: DataFrame, **limits: float) -> DataFrame:
    """(line_id, kept, kept_by, distance): longest lines first, a line goes if it lies on one that stays; ties by number.

    kept_by: the kept line that a line is told by, itself if it stays, else the one at the least mean distance.
    """
    links = cut(duplicate_links(v, **limits))
    nodes = shapes(v).select(F.col("line_id").alias("id"), F.struct(F.round(-F.col("length"), 6).alias("l"), F.col("line_id").alias("id")).alias("rank"))
    kept = cut(graph.greedy_independent_set(nodes, links.select("a", "b")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean"))
    best = both.join(kept.where("kept").select(F.col("id").alias("b")), "b").groupBy("a").agg(F.min(F.struct(F.round("mean", 9).alias("m"), "b")).alias("s"))
    told = kept.join(best, F.col("id") == F.col("a"), "left")
    return told.select(F.col("id").alias("line_id"), "kept", F.when(F.col("kept"), F.col("id")).otherwise(F.col("s.b")).alias("kept_by"), F.when(~F.col("kept"), F.col("s.m")).alias("distance"))


def track_links(v: DataFrame, max_gap: float = 6.0, max_angle: float = 8.0, max_connector: float = 10.0, max_lateral: float = 0.18, cell: float = 16.0) -> DataFrame:
    """(a, b): lines whose nearest ends continue each other; lines that share an end have no connector and no link."""
    s = shapes(v).select("line_id", "a", "b", "bearing")
    p = near_lines(v, max_gap, cell)
    for side in "ij":
        p = p.join(dealt(s.select(F.col("line_id").alias(side), F.col("bearing").alias(f"{side}q"), F.array("a", "b").alias(f"{side}e"))), side)
    four = [F.struct(F.hypot(F.col("je")[b]["x"] - F.col("ie")[a]["x"], F.col("je")[b]["y"] - F.col("ie")[a]["y"]).alias("gap"), F.col("ie")[a].alias("p"), F.col("je")[b].alias("q")) for a in (0, 1) for b in (0, 1)]
    best = four[0]
    for other in four[1:]:
        best = F.when(other["gap"] < best["gap"], other).otherwise(best)
    q = settled(p.withColumn("m", best), "m").where((F.col("m.gap") > 1e-9) & (F.col("m.gap") <= max_gap))
    cx, cy = F.col("m.q.x") - F.col("m.p.x"), F.col("m.q.y") - F.col("m.p.y")
    q = q.withColumns({"u": F.coalesce(turn_degrees(F.col("m.p.ux"), F.col("m.p.uy"), cx, cy), F.lit(90.0)), "w": F.coalesce(turn_degrees(F.col("m.q.ux"), F.col("m.q.uy"), -cx, -cy), F.lit(90.0))})
    q = settled(q, "u", "w")
    lateral = F.col("m.gap") * F.sin(F.radians(F.least("u", "w")))
    ok = (F.col("u") <= max_connector) & (F.col("w") <= max_connector) & (angle_difference(F.col("iq"), F.col("jq")) <= max_angle) & (lateral <= max_lateral)
    return q.where(ok).select(F.col("i").alias("a"), F.col("j").alias("b"))


def build_tracks(v: DataFrame, quality: DataFrame | None = None, **limits: float) -> DataFrame:
    """(line_id, track_id, bearing, total_length, quality): connected lines, a track named by its smallest line.

    bearing: mean of the axial bearings weighted by length; quality GOOD for one line that is GOOD
    in quality (line_id, quality), else SUSPECT.
    """
    s = shapes(v).select("line_id", "length", F.radians(2 * F.col("bearing")).alias("t"))
    roots = graph.connected_components(track_links(v, **limits)).select(F.col("v").alias("line_id"), F.col("root").alias("_root"))
    s = s.join(dealt(roots), "line_id", "left").withColumn("track_id", F.coalesce("_root", "line_id"))
    if quality is not None:
        s = s.join(dealt(quality.select("line_id", "quality")), "line_id", "left")
    good = F.lit(False) if quality is None else F.coalesce(F.max("quality") == "GOOD", F.lit(False)) & (F.count(F.lit(1)) == 1)
    weight = F.greatest(F.col("length"), F.lit(1e-9))
    sums = s.groupBy("track_id").agg(F.sum(weight * F.sin("t")).alias("s"), F.sum(weight * F.cos("t")).alias("c"), F.sum("length").alias("total_length"), F.when(good, "GOOD").otherwise("SUSPECT").alias("track_quality"))
    bearing = F.pmod(F.round(F.degrees(0.5 * F.atan2("s", "c")), 9) + 180.0, F.lit(180.0))
    return s.select("line_id", "track_id").join(dealt(sums.select("track_id", bearing.alias("bearing"), "total_length", "track_quality")), "track_id").select("line_id", "track_id", "bearing", "total_length", "track_quality")


def choose_references(v: DataFrame, tracks: DataFrame, pairs: DataFrame, reach: float = 4.0, max_angle: float = 10.0, neighbours: bool = False, cell: float = 8.0) -> DataFrame:
    """(track_id, reference, score): for each track the GOOD other track that scores best within reach of its longest line.

    tracks: as build_tracks; pairs: (line_id, pair_id). The score falls with angle and distance; a track that shares a
    pair number, a sister, counts one more, and without one there is a reference only if neighbours are allowed. Ties by number.
    """
    member = tracks.join(shapes(v).select("line_id", "length"), "line_id")
    longest = member.groupBy("track_id").agg(F.max_by("line_id", F.struct(F.round("length", 9).alias("l"), (-F.col("line_id")).alias("i"))).alias("line_id"), F.max("bearing").alias("bearing"))
    good = tracks.where("track_quality = 'GOOD'").select(F.col("track_id").alias("reference"), F.col("line_id").alias("other"), F.col("bearing").alias("other_bearing"))
    near = near_lines(v, reach, cell)
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "nearest"))
    met = both.join(longest, F.col("i") == F.col("line_id")).join(good, F.col("j") == F.col("other")).where("track_id <> reference")
    angle = angle_difference(F.col("bearing"), F.col("other_bearing"))
    met = met.where(angle <= max_angle).select("track_id", "reference", (1 - F.least(angle / max_angle, F.lit(1.0)) - 0.1 * F.col("nearest")).alias("score"))
    numbered_ = tracks.select("line_id", "track_id").join(pairs.where("pair_id IS NOT NULL").select("line_id", "pair_id"), "line_id")
    of = numbered_.select("track_id", "pair_id").distinct()
    sister = of.join(of.withColumnRenamed("track_id", "reference"), "pair_id").where("track_id <> reference").select("track_id", "reference", F.lit(1.0).alias("sister")).distinct()
    scored = met.join(sister, ["track_id", "reference"], "left")
    if not neighbours:
        scored = scored.where("sister IS NOT NULL")
    rank = F.struct(F.coalesce("sister", F.lit(0.0)).alias("s"), F.round("score", 9).alias("v"), (-F.col("reference")).alias("r"))
    best = scored.groupBy("track_id").agg(F.max_by(F.struct("reference", (F.col("score") + F.coalesce("sister", F.lit(0.0))).alias("score")), rank).alias("b"))
    return best.select("track_id", "b.reference", "b.score")


# --- chains and merges ---------------------------------------------------------------------------


def oriented(v: DataFrame, tracks: DataFrame) -> DataFrame:
    """(line_id, track_id, pos, x, y, s, o): lines turned to run along their track, whose direction is the median of the
    lines' chord bearings, with the places s along it and o across it.

    Bearings are taken from their axial mean, so that those around 0 and 180 degrees are neighbours.
    """
    chord = v.groupBy("line_id").agg(*[f(c, "pos").alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min_by), ("b", F.max_by))], F.max("pos").alias("last"))
    chord = chord.join(dealt(tracks.select("line_id", "track_id")), "line_id").withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")})
    chord = chord.withColumn("q", axial_bearing(F.col("dx"), F.col("dy")))
    mean = chord.groupBy("track_id").agg(F.degrees(0.5 * F.atan2(F.sum(F.sin(F.radians(2 * F.col("q")))), F.sum(F.cos(F.radians(2 * F.col("q")))))).alias("mean"))
    aside = F.pmod(F.col("q") - F.col("mean") + 90.0, F.lit(180.0)) - 90.0
    middle = chord.join(dealt(mean), "track_id").groupBy("track_id").agg(F.radians(F.pmod(F.max("mean") + F.median(aside), F.lit(180.0))).alias("t"))
    turned = chord.join(dealt(middle), "track_id").select("line_id", "track_id", "t", "last", (F.col("dx") * F.cos("t") + F.col("dy") * F.sin("t") < 0).alias("back"))
    p = v.join(dealt(turned), "line_id").withColumn("pos", F.when(F.col("back"), F.col("last") - F.col("pos")).otherwise(F.col("pos")))
    return p.select("line_id", "track_id", "pos", "x", "y", (F.col("x") * F.cos("t") + F.col("y") * F.sin("t")).alias("s"), (F.col("y") * F.cos("t") - F.col("x") * F.sin("t")).alias("o"))


def _chained(p: DataFrame, max_gap: float, max_lateral: float) -> DataFrame:
    """(line_id, chain, place, n_parts, a, from) of oriented lines: the chain that each belongs to, its start a, and the end that it is joined to."""
    ends = p.groupBy("track_id", "line_id").agg(*[f(F.struct("x", "y", "s", "o"), "pos").alias(n) for n, f in (("a", F.min_by), ("b", F.max_by))])
    w = Window.partitionBy("track_id").orderBy(F.col("a.s"), "line_id")
    before = F.lag("b").over(w)
    gap, off = F.col("a.s") - before["s"], F.abs(F.col("a.o") - before["o"])
    joins = F.coalesce(gap.between(-0.5, max_gap) & (off <= max_lateral), F.lit(False))
    m = ends.select("track_id", "line_id", "a", F.when(joins, before).alias("from"), F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(w).alias("place"))
    chain = Window.partitionBy("track_id", "run")
    return m.select("line_id", "a", "from", "place", F.min("line_id").over(chain).alias("chain"), F.count(F.lit(1)).over(chain).alias("n_parts"))


def track_chains(v: DataFrame, tracks: DataFrame, max_gap: float = 6.0, max_lateral: float = 0.25) -> DataFrame:
    """(line_id, chain): the line of bridge_tracks that each line becomes part of."""
    return _chained(oriented(v, tracks), max_gap, max_lateral).select("line_id", "chain")


def bridge_tracks(v: DataFrame, tracks: DataFrame, max_gap: float = 6.0, max_lateral: float = 0.25, step: float = 0.5) -> DataFrame:
    """(line_id, pos, x, y, n_parts): lines of a track joined end to start where the gap allows, named by their smallest line.

    Lines of a track follow each other by the place of their starts along it (ties by number); a line joins the one before
    if it starts at most half a metre before that one's end and max_gap behind, and max_lateral aside.
    Bridges get points at most step apart; vertices that repeat the one before are dropped.
    """
    p = oriented(v, tracks)
    m = _chained(p, max_gap, max_lateral)
    own = p.select("line_id", "pos", "x", "y").join(dealt(m.select("line_id", "chain", "place", "n_parts")), "line_id").select("chain", "n_parts", F.struct("place", F.lit(1).alias("own"), "pos").alias("at"), "x", "y")
    size = F.hypot(F.col("a.x") - F.col("from.x"), F.col("a.y") - F.col("from.y"))
    k = F.greatest(F.lit(2), F.ceil(size / step).cast("int") + 1)
    b = m.where(F.col("from").isNotNull() & (size > 0.05)).withColumn("k", k).where("k > 2").withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("k") - 2))).withColumn("pos", F.col("pos").cast("long"))
    t = F.col("pos") / (F.col("k") - 1)
    made = b.select("chain", "n_parts", F.struct("place", F.lit(0).alias("own"), "pos").alias("at"), (F.col("from.x") + t * (F.col("a.x") - F.col("from.x"))).alias("x"), (F.col("from.y") + t * (F.col("a.y") - F.col("from.y"))).alias("y"))
    path = Window.partitionBy("line_id").orderBy("at")
    every = own.unionByName(made).withColumnRenamed("chain", "line_id")
    moved = F.hypot(F.col("x") - F.lag("x").over(path), F.col("y") - F.lag("y").over(path))
    kept = every.withColumn("_moved", moved).where("_moved IS NULL OR _moved > 1e-4")
    return kept.select("line_id", (F.row_number().over(path) - 1).cast("long").alias("pos"), "x", "y", "n_parts")


def merge_tracks(v: DataFrame, tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line_id, pos, x, y, track_fragment_count): the lines of a track as one where they end on each other's ends and form one
    simple way without a branch, and have at most one pair number; other lines stay as they are (count 1).

    A merged line has the number of its longest part (ties: the smallest) and runs as its smallest part does.
    """
    s = shapes(v).select("line_id", "length", F.struct(F.round("a.x", 9).alias("x"), F.round("a.y", 9).alias("y")).alias("a"), F.struct(F.round("b.x", 9).alias("x"), F.round("b.y", 9).alias("y")).alias("b"))
    m = s.join(dealt(tracks.select("line_id", "track_id")), "line_id").join(dealt(pairs.select("line_id", "pair_id")), "line_id", "left")
    ends = m.select("track_id", "line_id", F.explode(F.array("a", "b")).alias("e")).groupBy("track_id", "e").agg(F.count(F.lit(1)).alias("degree"))
    shape = ends.groupBy("track_id").agg(F.max("degree").alias("most"), F.count_if(F.col("degree") == 1).alias("loose"), F.count(F.lit(1)).alias("nodes"))
    group = m.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("rings"), F.size(F.collect_set("pair_id")).alias("pairs"), F.max_by("line_id", F.struct(F.round("length", 9).alias("l"), (-F.col("line_id")).alias("i"))).alias("name"))
    # a way of n lines has n + 1 nodes, two of them loose, none of more than two lines
    way = group.join(dealt(shape), "track_id").where("n > 1 AND rings = 0 AND pairs <= 1 AND most <= 2 AND loose = 2 AND nodes = n + 1")
    # connected: a way with as many nodes could also be a way and rings apart
    joint = m.join(dealt(way.select("track_id", "name")), "track_id").select("track_id", "name", "line_id", F.explode(F.array("a", "b")).alias("e"))
    links = joint.groupBy("track_id", "name", "e").agg(F.min("line_id").alias("a"), F.max("line_id").alias("b")).where("a <> b")
    roots = graph.connected_components(links.select("a", "b"))
    whole = joint.select("track_id", "name", "line_id").distinct().join(dealt(roots), F.col("line_id") == F.col("v"), "left").groupBy("track_id", "name").agg(F.count_distinct(F.coalesce("root", "line_id")).alias("parts"), F.count(F.lit(1)).alias("n"))
    whole = cut(whole.where("parts = 1").select("track_id", "name"))
    from rowloom.operators import bridging

    members = m.join(dealt(whole), "track_id").select("line_id", F.col("track_id").alias("root"), F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    order = cut(bridging.way_order(members).join(dealt(whole.withColumnRenamed("track_id", "root")), "root").drop("root").withColumnRenamed("name", "root"))
    made = cut(bridging.joined(v, order))
    good = _simple(made.where("n_parts > 1")).select("line_id")
    kept = order.join(dealt(good.withColumnRenamed("line_id", "root")), "root", "left_semi")
    return bridging.joined(v, kept).withColumnRenamed("n_parts", "track_fragment_count")


def _simple(v: DataFrame) -> DataFrame:
    """(line_id) of lines none of whose segments meet but at the vertex that two successive ones share."""
    again = self_contacts(v).select("line_id").distinct()
    return v.select("line_id").distinct().join(dealt(again), "line_id", "left_anti")


def self_contacts(v: DataFrame, cell: float = 8.0) -> DataFrame:
    """(line_id, p, q): segments of one line that meet although they do not follow each other, the closing vertex of a ring apart."""
    path = Window.partitionBy("line_id").orderBy("pos")
    ranked = v.withColumn("pos", F.row_number().over(path) - 1)
    s = lines.segments(ranked).withColumn("n", F.max("pos").over(Window.partitionBy("line_id")))
    b = spatial.boxed(s.select(F.col("line_id").alias("id"), "pos", "n", "x0", "y0", "x1", "y1"))
    p = spatial.grid_join(b, b, spatial.BOX, 0.0, cell).where("l.id = r.id AND l.pos + 1 < r.pos")
    ring = (F.col("l.pos") == 0) & (F.col("r.pos") == F.col("r.n")) & (F.col("l.x0") == F.col("r.x1")) & (F.col("l.y0") == F.col("r.y1"))
    return p.where(~ring).where(spatial.segment_distance("l", "r") <= 1e-12).select(F.col("l.id").alias("line_id"), F.col("l.pos").alias("p"), F.col("r.pos").alias("q"))


# --- what a changed line may not do --------------------------------------------------------------


def contacts(changed: DataFrame, others: DataFrame, cell: float = 8.0) -> DataFrame:
    """(a, b): changed lines a that touch a line b of another number, in a point or along a stretch."""
    near = near_lines(changed, 1e-9, cell, others)
    return near.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))


def crosses_others(changed: DataFrame, others: DataFrame, ignored: DataFrame, clearance: float = 0.0, cell: float = 8.0) -> DataFrame:
    """(line_id): changed lines that touch, or come closer than clearance to, a line of others that ignored (line_id, other) does not name."""
    near = near_lines(changed, max(clearance, 1e-9), cell, others).where("i <> j").select(F.col("i").alias("line_id"), F.col("j").alias("other"))
    return near.join(ignored, ["line_id", "other"], "left_anti").select("line_id").distinct()


def spacing_to(v: DataFrame, other: DataFrame, targets: DataFrame, spacing: float = 0.25) -> DataFrame:
    """(p, distance): the median distance of even samples of lines p of v from the lines t of other; targets: (p, t)."""
    points = lines.resample(v, spacing).select("line_id", F.col("k").cast("long").alias("k"), "x", "y")
    return against(points, targets, other).groupBy("p").agg(F.median("d").alias("distance"))


def farthest_sample(p: np.ndarray, targets: np.ndarray, spacing: float, few: int = 4096) -> float:
    """The largest distance of the even samples of a line (as lines.resample makes them) from the nearest of targets, segments (x0, y0, x1, y1); nan without samples.

    From sample to sample the distance changes by no more than their gap, so of many samples only those are
    asked that may lie further off than the furthest so far: stretches are halved until none may.
    """
    steps = np.hypot(*np.diff(p, axis=0).T)
    ends = np.concatenate(([0.0], np.cumsum(steps)))
    long = np.flatnonzero(ends[1:] > ends[:-1])
    if not len(long) or not len(targets):
        return math.nan
    n = max(2, math.ceil(ends[-1] / spacing) + 1)
    gap = ends[-1] / (n - 1)
    first = np.ceil(ends[long] / gap)

    def apart(k: np.ndarray) -> np.ndarray:
        i = long[np.searchsorted(first, k, "right") - 1]
        t = np.clip((k * gap - ends[i]) / (ends[i + 1] - ends[i]), 0, 1)
        q = p[i] + t[:, None] * (p[i + 1] - p[i])
        most = max(1, (1 << 20) // len(targets))
        return np.concatenate([spatial._apart(q[j : j + most, :1], q[j : j + most, 1:], *targets.T).min(1) for j in range(0, len(q), most)])

    k = np.unique(np.linspace(0, n - 1, min(n, few)).astype(np.int64))
    d = apart(k)
    best = d.max()
    lo, hi, dlo, dhi = k[:-1], k[1:], d[:-1], d[1:]
    while True:
        open_ = (hi - lo > 1) & ((dlo + dhi + (hi - lo) * gap) / 2 > best)
        if not open_.any():
            return float(best)
        lo, hi, dlo, dhi = lo[open_], hi[open_], dlo[open_], dhi[open_]
        middle = (lo + hi) // 2
        d = apart(middle)
        best = max(best, d.max())
        lo, hi, dlo, dhi = np.concatenate((lo, middle)), np.concatenate((middle, hi)), np.concatenate((dlo, d)), np.concatenate((d, dhi))


def displacement(lineage: DataFrame, final: DataFrame, raw: DataFrame, spacing: float = 0.10) -> DataFrame:
    """(line_id, displacement): the largest distance of even samples of a final line from the raw lines that lineage (line_id, raw_id) names.

    A line's vertices and its raw lines' segments are one numpy group; its samples never leave the task (farthest_sample).
    """
    own = final.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    s = lines.segments(raw).select(F.col("line_id").alias("raw_id"), "x0", "y0", "x1", "y1")
    ends = ("x0", "y0", "x1", "y1")
    beside = lineage.select("line_id", "raw_id").join(dealt(s), "raw_id").groupBy("line_id").agg(F.collect_list(F.struct(*ends)).alias("s"))
    both = own.join(dealt(beside), "line_id").select("line_id", F.col("p.x").alias("x"), F.col("p.y").alias("y"), *[F.col(f"s.{c}").alias(c) for c in ends])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            d = [farthest_sample(np.column_stack(r[:2]), np.column_stack(r[2:]), spacing) for r in zip(*[f[c] for c in ("x", "y", *ends)], strict=True)]
            got = pd.DataFrame({"line_id": f["line_id"], "displacement": np.round(d, 12)})
            yield got[got["displacement"].notna()]

    return both.mapInPandas(run, "line_id long, displacement double")


def attach_lineage(cleaned: DataFrame, raw: DataFrame, tolerance: float, cell: float = 8.0) -> DataFrame:
    """(line_id, raw_ids): the raw lines within tolerance of each cleaned line, sorted; the nearest one where there is none."""
    near = cut(near_lines(cleaned, tolerance, max(cell, tolerance), raw))
    got = near.groupBy(F.col("i").alias("line_id")).agg(F.array_sort(F.collect_set("j")).alias("raw_ids"))
    rest = cut(cleaned.join(dealt(got.select("line_id")), "line_id", "left_anti"))
    found, reach = got, max(cell, tolerance)
    limit = raw.unionByName(cleaned.select(raw.columns)).agg((F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("d")).first()["d"]
    while not rest.isEmpty():  # the reach doubles for lines that found nothing, up to the extent of all lines
        near = cut(near_lines(rest, reach, reach, raw))
        one = near.groupBy(F.col("i").alias("line_id")).agg(F.min_by("j", F.struct(F.round("nearest", 9).alias("d"), "j")).alias("j"))
        found = found.unionByName(one.select("line_id", F.array("j").alias("raw_ids")))
        rest = cut(rest.join(dealt(one.select("line_id")), "line_id", "left_anti"))
        if limit is None or reach > limit:
            break
        reach *= 2
    return found
