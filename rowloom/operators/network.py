"""Networks of near-parallel straight rows (id, x0, y0, x1, y1): pairs, duplicates, tracks, chains, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scalar import angle_difference, axial_bearing, point_segment_distance, turn_degrees
from rowloom.operators import graph, spatial
from rowloom.operators.durable import cut, dealt, numbered, settled


@dataclass(frozen=True)
class Spacing:
    """Distances inside a pair and between pairs, and what a pair may deviate by."""

    intra_min: float = 0.60
    intra_max: float = 0.90
    inter_min: float = 1.0
    inter_max: float = 1.5
    tolerance: float = 0.08
    max_angle: float = 8.0
    min_overlap: float = 0.5

    @property
    def reach(self) -> float:
        return max(self.intra_max, self.inter_max) + self.tolerance


def pair_scores(rows: DataFrame, spacing: Spacing, preliminary: bool = False) -> DataFrame:
    """scores() of neighbouring straight rows."""
    reach = spacing.intra_max + spacing.tolerance if preliminary else spacing.reach
    return scores(spatial.pair_measures(spatial.near_pairs(rows, reach, cell=max(8.0, reach))), spacing, preliminary)


def scores(measures: DataFrame, spacing: Spacing, preliminary: bool = False) -> DataFrame:
    """Measures (i, j, distance, angle, overlap) with inter, ok and confidence (9 digits)."""
    d, a, o = F.col("distance"), F.col("angle"), F.col("overlap")
    inside = d.between(spacing.intra_min - spacing.tolerance, spacing.intra_max + spacing.tolerance)
    inter = d.between(spacing.inter_min - spacing.tolerance, spacing.inter_max + spacing.tolerance) if not preliminary else F.lit(False)
    middle, half = (spacing.intra_min + spacing.intra_max) / 2, (spacing.intra_max - spacing.intra_min) / 2 + spacing.tolerance
    one = F.lit(1.0)
    score = 0.40 * (1 - F.least(one, F.abs(d - middle) / half)) + 0.25 * (1 - F.least(one, a / spacing.max_angle)) + 0.35 * F.least(one, o)
    ok = inside & (a <= spacing.max_angle) & (o >= spacing.min_overlap)
    return measures.select("i", "j", "distance", "angle", "overlap", inter.alias("inter"), ok.alias("ok"), F.round(F.when(inside, score).otherwise(0.0), 9).alias("confidence"))


def pair_rows(rows: DataFrame, spacing: Spacing, preliminary: bool = False) -> DataFrame:
    """assign() for straight rows."""
    return assign(rows.select("id"), pair_scores(rows, spacing, preliminary), spacing)


def assign(ids: DataFrame, scored: DataFrame, spacing: Spacing) -> DataFrame:
    """A row for each id: row_id, pair_id, pair_status, inter_status, neighbour measures.

    Valid candidates are matched greedily by confidence, then i and j; pair numbers follow that order
    from 1. Others get the reason of their best failed candidate (of equal confidence the first by j).
    """
    scores = cut(scored)
    order = (F.desc("confidence"), F.asc("i"), F.asc("j"))
    matched = graph.greedy_matching(scores.where("ok"), -F.col("confidence"), F.col("i"), F.col("j"))
    pairs = cut(numbered(matched, "pair_id", *order).withColumn("pair_id", F.col("pair_id") + 1))
    ends = pairs.select(F.explode(F.array("i", "j")).alias("row_id"), "pair_id", "distance", "angle", "overlap", "confidence")
    both = scores.select(F.col("i").alias("row_id"), F.col("j").alias("other"), "*").unionByName(scores.select(F.col("j").alias("row_id"), F.col("i").alias("other"), "*"))
    failed = (
        both.where("NOT ok").groupBy("row_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "other", "distance", "angle", "overlap")).alias("f"))
    )
    contact = both.groupBy("row_id").agg(F.max("inter").alias("inter"))
    every = ids.select(F.col("id").alias("row_id")).join(dealt(ends), "row_id", "left").join(dealt(failed), "row_id", "left").join(dealt(contact), "row_id", "left")
    d, o, a = F.col("f.distance"), F.col("f.overlap"), F.col("f.angle")
    reason = (
        F.when(F.col("f").isNull(), "unmatched")
        .when(d < spacing.intra_min - spacing.tolerance, "invalid_distance")
        .when(d > spacing.intra_max + spacing.tolerance, "unmatched")
        .when(o < spacing.min_overlap, "insufficient_overlap")
        .when(a > spacing.max_angle, "invalid_angle")
        .otherwise("possible_pair")
    )
    found = F.col("pair_id").isNotNull()
    return every.select(
        "row_id", "pair_id", F.when(found, "valid_pair").otherwise(reason).alias("pair_status"),
        F.when(F.coalesce("inter", F.lit(False)), "neighbor_found").otherwise("no_neighbor").alias("inter_status"),
        F.when(found, F.col("distance")).otherwise(d).alias("distance"), F.when(found, F.col("confidence")).otherwise(F.coalesce(-F.col("f.c"), F.lit(0.0))).alias("confidence"),
    )


def keep_for_output(pairs: DataFrame) -> DataFrame:
    """Filter mode: without rows whose distance, angle, overlap or doubling rules them out."""
    return pairs.where(~F.col("pair_status").isin("invalid_distance", "invalid_angle", "insufficient_overlap", "confirmed_duplicate"))


def spacing_samples(rows: DataFrame, reach: float, max_angle: float = 10.0, min_overlap: float = 0.35) -> DataFrame:
    """(i, rank, distance): the two nearest parallel, overlapping neighbours of each row."""
    m = spatial.pair_measures(spatial.near_pairs(rows, reach, cell=max(8.0, reach))).where((F.col("angle") <= max_angle) & (F.col("overlap") >= min_overlap))
    both = m.select("i", "j", "distance").unionByName(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    return both.withColumn("rank", rank).where("rank <= 2").select("i", "rank", "distance")


def spacing_clusters(samples: DataFrame, least: int = 30, rounds: int = 30) -> DataFrame:
    """One row: centres and ranges of the two clusters of distances, or no row if they do not part.

    Two-medians on the values between the 2nd and 98th percentile, from the 30th and 75th; each round
    is one aggregation of two medians.
    """
    v = samples.select(F.col("distance").alias("v")).where("v > 0")
    q = v.agg(F.percentile("v", F.lit(0.02)).alias("lo"), F.percentile("v", F.lit(0.98)).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    empty = "intra_center double, inter_center double, intra_min double, intra_max double, inter_min double, inter_max double, n_samples long"
    spark = samples.sparkSession
    if q.n < least:
        return spark.createDataFrame([], empty)
    v = cut(v.where(F.col("v").between(q.lo, q.hi)))
    c = v.agg(F.percentile("v", F.lit(0.30)).alias("a"), F.percentile("v", F.lit(0.75)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    a, b, n = c.a, c.b, c.n
    first = lambda: F.abs(F.col("v") - a) <= F.abs(F.col("v") - b)
    for _ in range(rounds):
        m = v.agg(F.median(F.when(first(), F.col("v"))).alias("a"), F.median(F.when(~first(), F.col("v"))).alias("b")).first()
        na, nb = (m.a if m.a is not None else a), (m.b if m.b is not None else b)
        same = abs(na - a) <= 1e-5 and abs(nb - b) <= 1e-5
        a, b = na, nb
        if same:
            break
    a, b = min(a, b), max(a, b)
    s = v.agg(
        F.count_if(first()).alias("na"), F.count_if(~first()).alias("nb"),
        F.median(F.when(first(), F.abs(F.col("v") - a))).alias("ma"), F.median(F.when(~first(), F.abs(F.col("v") - b))).alias("mb"),
    ).first()
    if n < least or min(s.na, s.nb) < max(5, least // 5):
        return spark.createDataFrame([], empty)
    ha, hb = (max(0.05, 0.10 * x, 3 * 1.4826 * m) for x, m in ((a, s.ma), (b, s.mb)))
    middle = (a + b) / 2
    intra, inter = (a - ha, min(a + ha, middle - 0.01)), (max(b - hb, middle + 0.01), b + hb)
    rows = [(a, b, *intra, *inter, n)] if intra[0] > 0 and intra[1] < inter[0] else []
    return spark.createDataFrame(rows, empty)


def pair_sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_id, pair_id, side): left and right of the first row's direction, turned to growing x.

    Groups of a pair number that are not two rows, or do not part, are unknown; rows without one unpaired.
    """
    r = rows.join(dealt(pairs.select(F.col("row_id").alias("id"), "pair_id")), "id")
    r = r.select("id", "pair_id", F.struct("id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my")).alias("s"))
    w = Window.partitionBy("pair_id")
    paired = r.where("pair_id IS NOT NULL").select("id", "pair_id", F.count(F.lit(1)).over(w).alias("n"), F.min("s").over(w).alias("a"), F.max("s").over(w).alias("b"))
    turned = F.when((F.col("a.dx") < 0) | ((F.abs("a.dx") <= 1e-9) & (F.col("a.dy") < 0)), -1.0).otherwise(1.0)
    side = turned * (F.col("a.dx") * (F.col("b.my") - F.col("a.my")) - F.col("a.dy") * (F.col("b.mx") - F.col("a.mx")))
    is_first = F.col("id") == F.col("a.id")
    name = (
        F.when((F.col("n") != 2) | (F.hypot("a.dx", "a.dy") <= 1e-9) | (F.abs(side) <= 1e-9), "unknown")
        .when(is_first == (side > 0), "right").otherwise("left")
    )
    alone = r.where("pair_id IS NULL").select(F.col("id").alias("row_id"), "pair_id", F.lit("unpaired").alias("side"))
    return paired.select(F.col("id").alias("row_id"), "pair_id", name.alias("side")).unionByName(alone)


def pair_completion(pairs: DataFrame) -> DataFrame:
    """(valid, incomplete): rows of valid pairs of exactly two, and the others."""
    size = F.count(F.col("pair_id")).over(Window.partitionBy("pair_id"))
    whole = (F.col("pair_status") == "valid_pair") & (F.col("n") == 2) & F.col("pair_id").isNotNull()
    # rows without a pair number are not gathered in one window partition
    counted = pairs.where("pair_id IS NOT NULL").withColumn("n", size).select(F.when(whole, 1).otherwise(0).alias("v"))
    every = counted.unionByName(pairs.where("pair_id IS NULL").select(F.lit(0).alias("v")))
    return every.agg(F.sum("v").cast("long").alias("valid"), F.sum(1 - F.col("v")).cast("long").alias("incomplete"))


def duplicate_links(rows: DataFrame, max_distance: float = 0.20, max_angle: float = 5.0, min_overlap: float = 0.70) -> DataFrame:
    """(a, b): rows that lie on one another: mean distance of the shorter's ends, angle and overlap."""
    p = spatial.near_pairs(rows, max_distance, cell=8.0)
    first = F.col("l.length") <= F.col("r.length")
    s, t = F.when(first, F.col("l")).otherwise(F.col("r")), F.when(first, F.col("r")).otherwise(F.col("l"))
    m = spatial.pair_measures(p).select(F.col("i"), F.col("j"), "angle", "overlap")
    ends = p.select(F.col("l.id").alias("i"), F.col("r.id").alias("j"), s.alias("s"), t.alias("t"))
    d = (
        point_segment_distance(*(F.col(c) for c in ("s.x0", "s.y0", "t.x0", "t.y0", "t.x1", "t.y1")))
        + point_segment_distance(*(F.col(c) for c in ("s.x1", "s.y1", "t.x0", "t.y0", "t.x1", "t.y1")))
    ) / 2
    near = ends.where(d < max_distance).select("i", "j")
    return m.where((F.col("angle") <= max_angle) & (F.col("overlap") >= min_overlap)).join(dealt(near), ["i", "j"]).select(F.col("i").alias("a"), F.col("j").alias("b"))


def drop_duplicates(rows: DataFrame) -> DataFrame:
    """(row_id, kept): longest rows first, a row goes if it lies on one that stays; ties by id."""
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    nodes = rows.select("id", F.struct(F.round(-length, 6).alias("l"), "id").alias("rank"))
    return graph.greedy_independent_set(nodes, duplicate_links(rows)).select(F.col("id").alias("row_id"), "kept")


def endpoints(rows: DataFrame) -> DataFrame:
    """(id, row_id, x, y): both ends of each row, numbered 2 * id and 2 * id + 1."""
    e = F.explode(F.array(F.struct((F.col("id") * 2).alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct((F.col("id") * 2 + 1).alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    return rows.select(F.col("id").alias("row_id"), e.alias("e")).select("e.id", "row_id", "e.x", "e.y")


def endpoint_neighbours(rows: DataFrame, k: int = 8, radius: float = 6.0) -> DataFrame:
    """(endpoint_i, endpoint_j, rank, gap): the k nearest ends of each end within radius."""
    return spatial.knn(endpoints(rows), k, radius).select(F.col("i").alias("endpoint_i"), F.col("j").alias("endpoint_j"), F.col("rank").cast("int").alias("rank"), "gap")


def track_links(fragments: DataFrame, max_gap: float = 6.0, max_angle: float = 8.0, max_connector: float = 10.0, max_lateral: float = 0.18) -> DataFrame:
    """(a, b): fragments whose nearest ends continue each other."""
    p = spatial.near_pairs(fragments, max_gap, cell=16.0)
    ends = lambda s: F.array(F.struct(F.col(f"{s}.x0").alias("x"), F.col(f"{s}.y0").alias("y")), F.struct(F.col(f"{s}.x1").alias("x"), F.col(f"{s}.y1").alias("y")))
    q = p.select("l", "r", ends("l").alias("le"), ends("r").alias("re"))
    four = [F.struct(F.hypot(F.col("re")[b]["x"] - F.col("le")[a]["x"], F.col("re")[b]["y"] - F.col("le")[a]["y"]).alias("gap"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]
    q = settled(q.withColumn("m", F.least(*four)), "m")
    def out(s: str, at: Column) -> tuple[Column, Column]:
        sign = F.when(at == 0, -1.0).otherwise(1.0)
        return sign * (F.col(f"{s}.x1") - F.col(f"{s}.x0")), sign * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))

    cx, cy = F.col("re")[F.col("m.b")]["x"] - F.col("le")[F.col("m.a")]["x"], F.col("re")[F.col("m.b")]["y"] - F.col("le")[F.col("m.a")]["y"]
    first, second = turn_degrees(*out("l", F.col("m.a")), cx, cy), turn_degrees(*out("r", F.col("m.b")), -cx, -cy)
    bearing = lambda s: axial_bearing(F.col(f"{s}.x1") - F.col(f"{s}.x0"), F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    q = q.where(F.col("m.gap") <= max_gap)
    q = q.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("m.gap").alias("gap"), first.alias("p"), second.alias("q"), angle_difference(bearing("l"), bearing("r")).alias("turn"))
    lateral = F.col("gap") * F.sin(F.radians(F.least("p", "q")))
    ok = (F.col("gap") > 1e-9) & (F.col("gap") <= max_gap) & (F.col("p") <= max_connector) & (F.col("q") <= max_connector) & (F.col("turn") <= max_angle)
    return q.where(ok & (lateral <= max_lateral)).select("a", "b")


def build_tracks(fragments: DataFrame, **limits: float) -> DataFrame:
    """(fragment_id, track_id, bearing, total_length): connected fragments, named by their smallest id.

    bearing is the length-weighted mean of the axial bearings.
    """
    roots = graph.connected_components(track_links(fragments, **limits))
    f = fragments.withColumns({"length": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "t": 2 * F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))})
    f = f.join(dealt(roots), F.col("id") == F.col("v"), "left").withColumn("track_id", F.coalesce("root", "id"))
    w = Window.partitionBy("track_id")
    s, c = F.sum(F.col("length") * F.sin("t")).over(w), F.sum(F.col("length") * F.cos("t")).over(w)
    return f.select(F.col("id").alias("fragment_id"), "track_id", F.pmod(F.round(F.degrees(0.5 * F.atan2(s, c)), 9) + 180.0, F.lit(180.0)).alias("bearing"), F.sum("length").over(w).alias("total_length"))


def bridge_chains(fragments: DataFrame, tracks: DataFrame, max_gap: float = 3.0, max_lateral: float = 0.5) -> DataFrame:
    """(fragment_id, chain_id): along its track a fragment joins the one before unless the gap or offset is too large."""
    f = fragments.join(dealt(tracks.select(F.col("fragment_id").alias("id"), "track_id", "bearing")), "id")
    ux, uy = F.cos(F.radians("bearing")), F.sin(F.radians("bearing"))
    a, b = F.col("x0") * ux + F.col("y0") * uy, F.col("x1") * ux + F.col("y1") * uy
    f = f.select("id", "track_id", F.least(a, b).alias("s"), F.greatest(a, b).alias("e"), ((F.col("y0") + F.col("y1")) / 2 * ux - (F.col("x0") + F.col("x1")) / 2 * uy).alias("o"))
    w = Window.partitionBy("track_id").orderBy("s", "id")
    gap, off = F.col("s") - F.lag("e").over(w), F.abs(F.col("o") - F.lag("o").over(w))
    new = F.when(gap.isNull() | (gap < -0.5) | (gap > max_gap) | (off > max_lateral), 1).otherwise(0)
    marked = f.withColumn("new", new).withColumn("n", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.select(F.col("id").alias("fragment_id"), F.min("id").over(Window.partitionBy("track_id", "n")).alias("chain_id"))


def segment_contacts(segments: DataFrame, cell: float) -> DataFrame:
    """(line_a, line_b, x, y): points where segments (line_id, x0, y0, x1, y1) of different lines meet; one row without a place
    for two lines that lie on each other along a stretch.

    A point is rounded to six digits, so that one at a vertex comes once.
    """
    b = spatial.boxed(segments.withColumn("id", F.col("line_id")))
    p = spatial.grid_join(b, b, spatial.BOX, 0.0, cell).where("l.line_id < r.line_id")
    rx, ry = F.col("l.x1") - F.col("l.x0"), F.col("l.y1") - F.col("l.y0")
    sx, sy = F.col("r.x1") - F.col("r.x0"), F.col("r.y1") - F.col("r.y0")
    det = rx * sy - ry * sx
    t = ((F.col("r.x0") - F.col("l.x0")) * sy - (F.col("r.y0") - F.col("l.y0")) * sx) / F.when(det != 0, det)
    # on one straight line: the part that both cover has a length
    one = (det == 0) & (rx * (F.col("r.y0") - F.col("l.y0")) - ry * (F.col("r.x0") - F.col("l.x0")) == 0)
    on = lambda c: rx * (F.col(f"r.x{c}") - F.col("l.x0")) + ry * (F.col(f"r.y{c}") - F.col("l.y0"))
    shared = one & (F.greatest(F.lit(0.0), F.least(on(0), on(1))) < F.least(rx * rx + ry * ry, F.greatest(on(0), on(1))))
    place = lambda c, d: F.when(det != 0, F.round(F.col(f"l.{c}0") + t * d, 6) + F.lit(0.0))
    return p.where(shared | (spatial.cross("l", "r") & (det != 0))).select(F.col("l.line_id").alias("line_a"), F.col("r.line_id").alias("line_b"), place("x", rx).alias("x"), place("y", ry).alias("y")).distinct()


def node_degrees(ends: DataFrame) -> DataFrame:
    """(x, y, degree): segment ends (x, y) at each place, rounded to seven digits."""
    return ends.groupBy(F.round("x", 7).alias("x"), F.round("y", 7).alias("y")).agg(F.count(F.lit(1)).alias("degree"))


def network_summary(rows: DataFrame, pairs: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """One row of counts and sums over a network of straight rows and its pairs."""
    degrees = node_degrees(endpoints(rows)).agg(
        F.count_if(F.col("degree") == 1).alias("unique_endpoint_count"), F.count_if(F.col("degree") == 3).alias("degree_3_node_count"), F.count_if(F.col("degree") >= 4).alias("degree_4_plus_node_count")
    )
    lengths = rows.agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("total_length_m"),
        F.count_if((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))).alias("closed_loop_count"),
    )
    whole = pairs.where("pair_status = 'valid_pair' AND pair_id IS NOT NULL").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") == 2).alias("valid_pair_count"))
    status = pairs.agg(F.count_if(F.col("pair_status") != "valid_pair").alias("unmatched_line_count"), F.count_if(F.col("pair_status") == "valid_pair").alias("valid_pair_line_count"))
    out = lengths
    for part in (degrees, whole, status, *([] if probabilities is None else [probabilities.agg(F.median("median_probability").alias("median_of_line_median_probability"))])):
        out = out.join(F.broadcast(part), F.lit(True))  # each side is one row
    return out


def contacts_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs of lines (a, b) that touch after a change and did not before."""
    return after.select("a", "b").join(dealt(before.select("a", "b")), ["a", "b"], "left_anti")

