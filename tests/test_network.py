import math
import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import graph, metrics, network, products, raster, spatial


def rows(spark, *items):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(items)], "id long, x0 double, y0 double, x1 double, y1 double")


def test_pairing_is_mutual(spark):
    r = rows(spark, (0, 0, 10, 0), (0, 0.9, 10, 0.9), (0, 2.2, 10, 2.2))
    got = {x.row_id: x for x in network.pair_rows(r, network.Spacing(0.85, 1.0, 1.15, 1.4)).collect()}
    assert got[0].pair_id == got[1].pair_id == 1 and got[2].pair_id is None
    assert [got[i].inter_status for i in range(3)] == ["no_neighbor", "neighbor_found", "neighbor_found"]


def test_filter_mode(spark):
    r = rows(spark, (0, 0, 10, 0), (0, 0.9, 10, 0.9), (0, 2.2, 10, 2.2), (0, 0.5, 10, 0.5))
    kept = network.keep_for_output(network.pair_rows(r, network.Spacing(0.85, 1.0, 1.15, 1.4)))
    assert sorted(x.row_id for x in kept.collect()) == [0, 1, 2]


def test_spacing_calibration(spark):
    r = rows(spark, *[(0, (k // 2) * 1.98 + (k % 2) * 0.74, 20, (k // 2) * 1.98 + (k % 2) * 0.74) for k in range(40)])
    c = network.spacing_clusters(network.spacing_samples(r, 3.0), least=20).first()
    assert abs(c.intra_center - 0.74) < 0.05 and abs(c.inter_center - 1.24) < 0.08


def test_matching_and_independent_set_equal_the_greedy_pass(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)})
    scored = [(i, j, rng.randint(1, 5)) for i, j in edges]
    used, want = set(), set()
    for i, j, _ in sorted(scored, key=lambda e: (-e[2], e[0], e[1])):
        if i not in used and j not in used:
            used |= {i, j}
            want.add((i, j))
    df = spark.createDataFrame(scored, "i long, j long, s int")
    got = graph.greedy_matching(df, -F.col("s"), F.col("i"), F.col("j"))
    assert {(r.i, r.j) for r in got.collect()} == want
    rank = {v: (rng.randint(1, 4), v) for v in range(40)}
    kept = set()
    near = {v: {a + b - v for a, b in edges if v in (a, b)} for v in range(40)}
    for v in sorted(rank, key=rank.get):
        if not near[v] & kept:
            kept.add(v)
    nodes = spark.createDataFrame([(v, *rank[v]) for v in rank], "id long, a int, b long").select("id", F.struct("a", "b").alias("rank"))
    got = graph.greedy_independent_set(nodes, spark.createDataFrame(edges, "a long, b long"))
    assert {r.id for r in got.collect() if r.kept} == kept


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (7, 8), (1, 1)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.v: r.root for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7} | {100 + i: 100 for i in range(31)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(5)
    r = rows(spark, *[(x, y, x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)) for x, y in ((rng.uniform(0, 60), rng.uniform(-30, 30)) for _ in range(80))])
    b = spatial.boxed(r)
    fast = {(p.l.id, p.r.id) for p in spatial.grid_join(b, b, spatial.BOX, 2.0, 5.0).collect()}
    near = lambda s, t: s.bx0 <= t.bx1 + 2 and t.bx0 <= s.bx1 + 2 and s.by0 <= t.by1 + 2 and t.by0 <= s.by1 + 2
    every = b.collect()
    assert fast == {(s.id, t.id) for s in every for t in every if near(s, t)}


def test_tracks_and_chains(spark):
    f = rows(spark, (0, 0, 10, 0), (11.5, 0, 25, 0), (0, 0.9, 10, 0.9))
    t = network.build_tracks(f, max_gap=3.0)
    assert {r.fragment_id: r.track_id for r in t.collect()} == {0: 0, 1: 0, 2: 2}
    assert {r.fragment_id: r.chain_id for r in network.bridge_chains(f, t).collect()} == {0: 0, 1: 0, 2: 2}


def test_hysteresis_keeps_seeded_blocks(spark):
    weak = [(r, c, 0.2) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(7, 7, 0.2), (7, 8, 0.2), (8, 7, 0.2), (8, 8, 0.2)]
    df = spark.createDataFrame([*weak, (1, 1, 0.35)], "row int, col int, p double")
    assert {(r.row, r.col) for r in raster.hysteresis(df, 0.15, 0.3).collect()} == {(r, c) for r in range(3) for c in range(3)}


def test_offsets(spark):
    cases = [(896, 512, 384, [0, 384]), (400, 512, 100, [0]), (1024, 512, 256, [0, 256, 512]), (600, 512, 100, [0, 88])]
    for size, tile, step, want in cases:
        assert spark.range(1).select(raster.offsets(F.lit(size), tile, step).alias("o")).first().o == want


def test_split_allocation(spark):
    want = {0: (0, 0, 0), 1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 10: (6, 2, 2)}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    got = df.select("n", *[c.alias(k) for k, c in zip("abc", metrics.allocate(F.col("n")), strict=True)]).collect()
    assert {r.n: (r.a, r.b, r.c) for r in got} == want


def test_calibration(spark):
    df = spark.createDataFrame([(85, 1)] * 4 + [(10, 0)] * 12, "p int, y int")
    best = metrics.choose_threshold(metrics.threshold_sweep(df, [30, 40, 50, 60, 70, 80, 90])).first()
    assert (best.threshold, best.dice, best.status) == (30, 1.0, "approved")


def test_products(spark, tmp_path):
    lines = spark.createDataFrame([(3.0, 1, '["a","b"]'), (9.0, 2, "c")], "length_m double, k long, source_raw_ids string")
    named = products.with_ids(lines, "final", F.desc("length_m"), F.asc("k"))
    assert [r.final_line_id for r in named.orderBy("k").collect()] == ["final_000001", "final_000000"]
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert products.violations(named, ["final_line_id"], "final_line_id", known) == ["unknown source ids: c"]
    assert products.violations(named, ["nope"], "final_line_id") == ["missing columns: nope"]
    assert products.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_a_failed_second_stage_keeps_the_first(spark, tmp_path):
    raw = spark.createDataFrame([(1,)], "k int")

    def broken(_):
        raise RuntimeError("no")

    try:
        products.write_two_stages(raw, broken, f"{tmp_path}/raw", f"{tmp_path}/final")
    except RuntimeError:
        pass
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 1
    assert spark.read.json(f"{tmp_path}/final_failure").first().status == "postprocessing_failed"


def test_mosaic_stream_equals_batch(spark, tmp_path):
    from rowloom.streaming import mosaic, windows

    tiles = [(r0 + r, c0 + c, r0, c0, ((r * 7 + c * 3 + r0) % 10) / 10) for r0 in (0, 3) for c0 in (0, 5) for r in range(8) for c in range(8)]
    df = spark.createDataFrame(tiles, "row int, col int, row_off int, col_off int, p double")
    df.repartition(2).write.parquet(f"{tmp_path}/tiles")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/tiles")
    got = {(r.row, r.col): round(r.p, 9) for r in windows.run_to_end(mosaic.blend_stream(stream, 8)).collect()}
    assert got == {(r.row, r.col): round(r.p, 9) for r in raster.blend(df, 8).collect()}


def test_utm(spark):
    from rowloom.functions.scalar import utm_epsg

    df = spark.createDataFrame([(-0.1, 51.5), (-46.6, -23.5)], "lon double, lat double")
    assert [r.e for r in df.select(utm_epsg(F.col("lon"), F.col("lat")).alias("e")).collect()] == [32630, 32723]


def test_rows_of_cells_are_not_broadcast(spark):
    # Spark sizes both sides by the tables they come from, not by the cells that rows are dealt to
    r = spark.range(1000).selectExpr("id", "0.0D AS x0", "id * 2.0D AS y0", "400.0D AS x1", "id * 2.0D AS y1")
    p = spatial.near_pairs(r, 1.0, cell=1.0)
    assert "BroadcastHashJoin" not in p._jdf.queryExecution().executedPlan().toString()
    links = spark.range(50).selectExpr("id AS i", "id + 1 AS j")
    assert graph.greedy_matching(links, F.col("i")).count() == 25


def test_equal_gaps_are_ranked_by_root_of_squares(spark):
    p = spark.createDataFrame([(53622, 4.1000000000000005, 26542.680000000004), (53626, 4.0, 26544.640000000003), (53630, 3.9000000000000004, 26546.600000000002)], "id long, x double, y double")
    assert [x.j for x in spatial.knn(p, 2, 2.0).where("i = 53626").orderBy("rank").collect()] == [53630, 53622]


def test_distances_of_rows_are_roots_of_squares(spark):
    rng = random.Random(27)
    rows = [(k, rng.random() * 5, k * 0.9 + rng.random() * 0.1, 26 + rng.random() * 9, k * 0.9 + rng.random() * 0.1) for k in range(60)]
    r = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    size = {k: math.sqrt((c - a) * (c - a) + (d - b) * (d - b)) for k, a, b, c, d in rows}
    assert {x.id: x.length for x in spatial.boxed(r).collect()} == size

    def apart(px, py, x0, y0, x1, y1):
        dx, dy = x1 - x0, y1 - y0
        t = max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)))
        ex, ey = px - x0 - t * dx, py - y0 - t * dy
        return math.sqrt(ex * ex + ey * ey)

    def median(p, q):
        (_, x0, y0, x1, y1), t = p, q[1:]
        d = sorted(apart(x0 + k / 19 * (x1 - x0), y0 + k / 19 * (y1 - y0), *t) for k in range(20))
        return (d[9] + d[10]) / 2

    got = spatial.pair_measures(spatial.near_pairs(r, 2.5, 8.0)).collect()
    assert len(got) > 60
    for m in got:
        p, q = rows[m.i], rows[m.j]
        assert m.distance == (median(p, q) if size[m.i] <= size[m.j] else median(q, p))


def test_nearest_of_far_points_meets_few(spark):
    """A far point's cells are parted down to the first radius: it keeps a few cells of a long column, not those of its distance."""
    right = spark.range(4000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS x", "id * 0.9D AS y")
    left = spark.createDataFrame([(k, 40.0 * 3**k, 37.0 * k) for k in range(3)], "id long, x double, y double")
    places = [(r.id, r.x, r.y) for r in right.collect()]
    want = {p.id: min((math.hypot(p.x - x, p.y - y), i) for i, x, y in places) for p in left.collect()}
    got = {r.id: (r.d, r.other) for r in spatial.nearest(left, right, 4.0).collect()}
    assert {i: o for i, (_, o) in got.items()} == {i: o for i, (_, o) in want.items()}
    assert [got[i][0] for i in sorted(got)] == pytest.approx([want[i][0] for i in sorted(want)])
    point = left.where("id = 2").selectExpr("id", "x", "y", "0L AS cx", "0L AS cy")
    wide = spatial._within(point, right, 1024.0, 16384.0)
    parted = spatial._within(wide.withColumnsRenamed({"fx": "cx", "fy": "cy"}), right, 64.0, 16384.0)
    assert 0 < parted.count() * 64 < wide.count() * 1024


def test_orientation_transfer_does_not_broadcast_rows(spark):
    from rowloom.plans import raster_queries

    got = raster_queries.pixel_orientation_transfer(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
