import math

import pytest

from rowloom.operators import kernels, lines, serration


def line(spark, *points, line_id=1):
    return spark.createDataFrame([(line_id, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "line_id long, pos long, x double, y double")


def test_quality_of_a_straight_line(spark):
    r = lines.quality(line(spark, (0, 0), (2, 0), (5, 0))).first()
    assert (r.length, r.max_turn, r.chord_ratio, r.quality) == (5.0, 0.0, 1.0, "GOOD")


def test_quality_of_one_vertex(spark):
    assert lines.quality(line(spark, (0, 0))).first().quality == "INVALID"


def test_resample_keeps_ends(spark):
    rows = lines.resample(line(spark, (0, 0), (1, 0), (1, 1)), 0.3).orderBy("k").collect()
    assert (rows[0].x, rows[0].y, rows[-1].x, rows[-1].y) == (0, 0, 1, 1)
    assert len(rows) == math.ceil(2 / 0.3) + 1
    assert [r.k for r in rows] == list(range(len(rows)))


def test_hairpin(spark):
    v = line(spark, (0, 0), (2, 0), (3, 1), (2, 2), (0.25, 2), (0.1, 0.15))
    assert lines.hairpins(v).first().has_hairpin


def test_tangents(spark):
    flat = lines.tangents(line(spark, (0, 0), (2, 0)), 1.0).first()
    up = lines.tangents(line(spark, (0, 0), (0, 2)), 1.0).first()
    assert (round(flat.sin2, 9), flat.cos2) == (0, 1) and (round(up.sin2, 9), up.cos2) == (0, -1)


def test_moving_average_repeats_ends(spark):
    rows = lines.moving_average(line(spark, (0, 3), (1, 0), (2, 0)), "y", 3).orderBy("pos").collect()
    assert [round(r.smooth, 9) for r in rows] == [2.0, 1.0, 0.0]


def test_repeated_vertices(spark):
    assert lines.drop_repeated(line(spark, (0, 0), (0, 0), (1, 0), (0, 0))).count() == 3


def staircase(slope=0.37, n=210, step=0.035):
    out, x, y = [], 0.0, 0.0
    for _ in range(n):
        out += [(x, y), (x + step, y)]
        x += step
        if slope * x > y + step:
            y += step
    return out


def test_serration_marks_stairs_not_arcs(spark):
    stairs = line(spark, *staircase())
    arc = line(spark, *[(12 * math.sin(a / 100), 12 * math.cos(a / 100)) for a in range(150)], line_id=2)
    got = {r.line_id: r.failed for r in serration.diagnostics(stairs.unionByName(arc), 0.035).collect()}
    assert got == {1: True, 2: False}


def test_savgol_keeps_polynomials():
    import numpy as np

    x = np.arange(20.0)
    assert np.allclose(kernels.savgol(x**3 - 2 * x, 7, 3), x**3 - 2 * x)


def test_thinning_and_tracing():
    import numpy as np

    img = np.zeros((7, 20), bool)
    img[2:5, 2:18] = True
    thin = kernels.thin(img)
    assert 10 <= thin.sum() <= 18 and thin[3, 5:15].all()


def test_diamond_is_a_short_cycle():
    edges = [(0, 1, 1.1, 10), (1, 2, 1.1, 11), (2, 3, 1.1, 12), (3, 0, 1.1, 13), (2, 9, 1.0, 14)]
    assert kernels.short_cycles(edges, 5.0) == {10, 11, 12, 13}
    assert kernels.short_cycles(edges, 4.0) == set()


def test_offsets_follow_a_cheap_course():
    import numpy as np

    cost = np.ones((9, 5))
    cost[2:7, 3] = 0
    got = kernels.best_offsets(cost, 0.05, 0.02)
    assert got[0] == got[-1] == 2 and (got[3:6] == 3).all()


@pytest.mark.parametrize("least,want", [(0.5, [0, 0, 1, 1, 0, 0]), (1.5, [1, 1, 1, 1, 1, 1])])
def test_short_runs(least, want):
    import numpy as np

    assert kernels.absorb_short_runs(np.array([0, 0, 1, 1, 0, 0]), np.arange(6) * 0.5, least).tolist() == want
