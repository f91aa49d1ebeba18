"""Neighbours of polylines: what is found, and that a grid join carries no column that its measures do not read."""

import numpy as np

from rowloom.operators import lines, polylines, spatial


def test_near_lines_carry_ends_and_boxes_only(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 5.0, 0.0), (1, 2, 40.0, 0.0), (2, 0, 39.0, 1.5), (2, 1, 45.0, 1.5), (3, 0, 0.0, 9.0), (3, 1, 5.0, 9.0), (4, 0, 1.0, 1.0)]
    v = spark.createDataFrame(rows, "line_id long, pos long, x double, y double")
    assert polylines._boxes(lines.segments(v)).columns == ["id", "x0", "y0", "x1", "y1", *spatial.BOX]
    assert sorted(map(tuple, polylines.near_lines(v, 2.0, 8.0).collect())) == [(1, 2, 1.5)]
    assert sorted(map(tuple, polylines.near_lines(v, 9.0, 9.0).collect())) == [(1, 2, 1.5), (1, 3, 9.0)]


def test_the_farthest_sample_of_a_long_zigzag_is_found_without_making_all():
    rng = np.random.default_rng(2)
    for far, spacing in ((30, 0.01), (3, 0.001), (5, 0.5)):
        p, q = rng.normal(size=(7, 2)) * far, rng.normal(size=(5, 2))
        targets = np.column_stack((q[:-1], q[1:]))
        ends = np.concatenate(([0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))))
        at = np.linspace(0, ends[-1], int(np.ceil(ends[-1] / spacing)) + 1)
        every = np.stack([np.interp(at, ends, p[:, c]) for c in (0, 1)], 1)
        want = spatial._apart(every[:, :1], every[:, 1:], *targets.T).min(1).max()
        assert abs(polylines.farthest_sample(p, targets, spacing, 16) - want) < 1e-9
    million = np.array([(0, 0), (1, 990000.0), (7, 1), (8, 990001), (20, 0)])
    assert polylines.farthest_sample(million, np.array([(0, 0, 20, 0.0)]), 0.5) > 990000.49
