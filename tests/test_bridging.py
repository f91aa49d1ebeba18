"""Gaps, spurs, junctions and merges against plain sequential versions, on the cases that matter."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rowloom.operators import bridging, kernels, polylines


def frame(spark, lines):
    rows = [(i, k, float(x), float(y)) for i, p in lines.items() for k, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "line_id long, pos long, x double, y double")


def read(df, key="line_id"):
    out = {}
    for r in df.orderBy(key, "pos").collect():
        out.setdefault(r[key], []).append((round(r.x, 6), round(r.y, 6)))
    return out


def field(seed, rows=7, parts=5):
    """Broken rows, some beside each other, some shifted or turned."""
    rng = random.Random(seed)
    out = {}
    for r in range(rows):
        x = rng.uniform(0, 2)
        for _ in range(parts):
            n, y = rng.uniform(2, 6), r * 0.9 + rng.gauss(0, 0.06)
            turn = rng.choice([0, 0, 0, 0.3]) * rng.choice([-1, 1])
            p = [(x + n * t, y + turn * n * t) for t in (0, 0.25, 0.5, 0.75, 1)]
            out[len(out) + 1] = p[::-1] if rng.random() < 0.4 else p
            x += n + rng.uniform(0.3, 5)
    return out


def unit(a, b):
    n = math.hypot(a[0] - b[0], a[1] - b[1])
    return ((a[0] - b[0]) / n, (a[1] - b[1]) / n)


def meets(a, b, c, d, strict=False):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    s, t = side(a, b, c) * side(a, b, d), side(c, d, a) * side(c, d, b)
    return (s < 0 and t < 0) if strict else (s <= 0 and t <= 0)


def sequential(lines, limits):
    """The greedy pass, one candidate after the other."""
    ends = {}
    for i, p in lines.items():
        step = min(5, len(p) - 1)
        ends[2 * i] = (i, p[0], unit(p[0], p[step]))
        ends[2 * i + 1] = (i, p[-1], unit(p[-1], p[-1 - step]))
    near = lambda e: sorted((math.dist(ends[e][1], ends[f][1]), f) for f in ends if f != e)[: limits.neighbours]
    least, found = math.cos(math.radians(limits.max_angle)), {}
    for e in ends:
        for gap, f in near(e):
            i, j = sorted((e, f))
            (li, p, t), (lj, q, u) = ends[i], ends[j]
            if gap > limits.max_gap or gap < 1e-3 or li == lj:
                continue
            g = ((q[0] - p[0]) / gap, (q[1] - p[1]) / gap)
            di, dj, along = t[0] * g[0] + t[1] * g[1], -u[0] * g[0] - u[1] * g[1], -t[0] * u[0] - t[1] * u[1]
            oi, oj = abs(g[1] * t[0] - g[0] * t[1]) * gap, abs(g[1] * u[0] - g[0] * u[1]) * gap
            if min(di, dj, along) < least or max(oi, oj) > limits.max_offset:
                continue
            if any(meets(p, q, a, b) for k, line in lines.items() if k not in (li, lj) for a, b in zip(line, line[1:], strict=False)):
                continue
            found[i, j] = round(di + dj - (oi + oj) / limits.max_offset, 9)
    taken, used, root = [], set(), {i: i for i in lines}
    top = lambda i: i if root[i] == i else top(root[i])
    for (i, j), _ in sorted(found.items(), key=lambda c: (-c[1], c[0])):
        a, b = top(ends[i][0]), top(ends[j][0])
        if i in used or j in used or a == b or any(meets(ends[i][1], ends[j][1], ends[k][1], ends[m][1], True) for k, m in taken):
            continue
        taken.append((i, j))
        used |= {i, j}
        root[a] = b
    return sorted(taken)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bridging_equals_the_sequential_pass(spark, seed):
    lines, limits = field(seed), bridging.Gap()
    v = frame(spark, lines)
    taken = bridging.choose(bridging.candidates(v, limits))
    want = sequential(lines, limits)
    assert sorted((r.i, r.j) for r in taken.collect()) == want and want
    made = read(bridging.join_lines(v, taken))
    assert len(made) == len(lines) - len(want)
    assert sorted(p for line in made.values() for p in line) == sorted((round(x, 6), round(y, 6)) for p in lines.values() for x, y in p)
    for i, line in made.items():  # the smallest part gives number and direction
        first = [(round(x, 6), round(y, 6)) for x, y in lines[i]]
        at = line.index(first[0])
        assert line[at : at + len(first)] == first


def test_a_way_is_not_closed(spark):
    # four quarter arcs of a ring: three gaps are bridged, the worst stays
    arcs = {}
    for k, gap in enumerate((0.10, 0.12, 0.14, 0.16)):
        start = sum((0.10, 0.12, 0.14, 0.16)[:k]) + k * 1.4
        arcs[k + 1] = [(10 * math.cos(start + t / 20), 10 * math.sin(start + t / 20)) for t in range(29)]
    taken = bridging.choose(bridging.candidates(frame(spark, arcs), bridging.Gap(max_offset=1.0)))
    assert taken.count() == 3


def test_probability_along_the_gap(spark):
    v = frame(spark, {1: [(0, 0.5), (2, 0.5)], 2: [(4, 0.5), (6, 0.5)], 3: [(0, 5.5), (2, 5.5)], 4: [(4, 5.5), (6, 5.5)]})
    pixels = spark.createDataFrame([(0, c, 0.9) for c in range(8)] + [(5, c, 0.05) for c in range(8)], "row int, col int, p double")
    taken = bridging.choose(bridging.candidates(v, bridging.Gap(), (pixels, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 8, 8)))
    assert [(r.i, r.j) for r in taken.collect()] == [(3, 4)]


def test_way_order():
    order, back = kernels.way([5, 3, 9], ["q", "r", "p"], ["p", "q", "s"])  # r-3-q, q-5-p, p-9-s
    assert (order, back) == ([3, 5, 9], [False, False, False])
    order, back = kernels.way([5, 3, 9], ["q", "q", "p"], ["p", "r", "s"])  # 3 runs from q to r: what leads to it comes before
    assert (order, back) == ([9, 5, 3], [True, True, False])


def test_ways_are_dealt_out(spark):
    """Many short ways, a few bytes each, are put in order by more than one task, and each as kernels.way does."""
    members = spark.range(6000).selectExpr("id AS line_id", "id - id % 3 AS root", "id - (id % 3) * 2 AS a", "id + 1 - (id % 3) * 2 AS b")
    rows = bridging.way_order(members).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1
    ways = {}
    for r in sorted(rows, key=lambda r: (r.root, r.place)):
        ways.setdefault(r.root, []).append((r.line_id, r.back, r.n))
    assert len(ways) == 2000
    for root, got in ways.items():
        own = [root, root + 1, root + 2]
        order, back = kernels.way(own, [i - (i % 3) * 2 for i in own], [i + 1 - (i % 3) * 2 for i in own])
        assert got == [(i, k, len(order)) for i, k in zip(order, back, strict=True)]


def test_gap_bridging_takes_every_candidate(monkeypatch):
    from rowloom.plans import audit_queries

    asked = []
    monkeypatch.setattr(audit_queries, "v_parts", lambda s, d: None)
    monkeypatch.setattr(audit_queries.bridging, "bridge", lambda v, limits: asked.append(limits) or (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        audit_queries.gap_bridging(None, "")
    assert asked[0].most_pairs is None


def test_spurs(spark):
    v = frame(spark, {1: [(0, 0), (5, 0)], 2: [(5, 0), (9, 0)], 3: [(5, 0), (5, 0.3)], 4: [(9, 0), (9, 0.4)], 5: [(9, 0.4), (9, 4)], 6: [(20, 20), (20.2, 20)]})
    assert sorted(read(bridging.prune_spurs(v))) == [1, 2, 4, 5]


def test_junctions_and_short_cycles(spark):
    v = frame(
        spark,
        {
            1: [(0, 0), (5, 0)], 2: [(5, 0), (10, 0.1)], 3: [(5, 0), (6, 3)],  # two go straight on, one branches off
            4: [(30, 0), (31, 0)], 5: [(31, 0), (31, 1.1)], 6: [(31, 1.1), (30, 0)],  # a triangle of 3.6
            7: [(50, 0), (51, 0), (51, 1), (50, 0)], 8: [(70, 0), (80, 0)],
        },
    )
    assert sorted(read(bridging.clear_junctions(v))) == [1, 2, 5, 6, 8]
    assert sorted(read(bridging.clear_junctions(v, reject_degree=False, max_cycle=1.0))) == [1, 2, 3, 4, 5, 6, 7, 8]


def test_merge_of_tracks(spark):
    v = frame(
        spark,
        {
            1: [(4, 0), (2, 0)], 2: [(4, 0), (9, 1)], 3: [(2, 0), (0, 0)],  # one way of three
            4: [(0, 9), (2, 9)], 5: [(2, 9), (4, 9)],  # two pair numbers
            6: [(0, 20), (4, 20)], 7: [(6, 20), (8, 20)],  # apart
            8: [(0, 30), (4, 30), (4, 33)], 9: [(4, 33), (2, 33), (2, 28)],  # not simple
        },
    )
    tracks = spark.createDataFrame([(i, t) for t, ids in {1: (1, 2, 3), 4: (4, 5), 6: (6, 7), 8: (8, 9)}.items() for i in ids], "line_id long, track_id long")
    pairs = spark.createDataFrame([(1, 7), (2, None), (3, 7), (4, 1), (5, 2)], "line_id long, pair_id long")
    got = polylines.merge_tracks(v, tracks, pairs)
    assert {r.line_id: r.track_fragment_count for r in got.collect()} == {2: 3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    assert read(got)[2] == [(9, 1), (4, 0), (2, 0), (0, 0)]  # as line 1 runs


def test_bridges_of_tracks(spark):
    v = frame(spark, {1: [(0, 0), (4, 0)], 2: [(9, 0.1), (6, 0.1)], 3: [(30, 0), (33, 0)], 4: [(9.3, 0.1), (12, 0.1)]})
    tracks = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "line_id long, track_id long")
    got = read(polylines.bridge_tracks(v, tracks))
    assert sorted(got) == [1, 3] and got[1][:3] == [(0, 0), (4, 0), (4.4, 0.02)] and got[1][-4:] == [(6, 0.1), (9, 0.1), (9.3, 0.1), (12, 0.1)]


def test_references(spark):
    v = frame(spark, {1: [(0, 0), (10, 0)], 2: [(0, 0.8), (10, 0.8)], 3: [(0, 3), (10, 3)], 4: [(0, 30), (10, 30)]})
    rows = [(1, 1, 0.0, "SUSPECT"), (2, 2, 0.0, "GOOD"), (3, 3, 0.0, "GOOD"), (4, 4, 0.0, "GOOD")]
    tracks = spark.createDataFrame(rows, "line_id long, track_id long, bearing double, track_quality string")
    pairs = spark.createDataFrame([(1, 5), (3, 5)], "line_id long, pair_id long")
    sisters = {r.track_id: r.reference for r in polylines.choose_references(v, tracks, pairs).collect()}
    assert sisters == {1: 3}  # track 1 is not GOOD, so 3 has no sister to go by
    near = {r.track_id: (r.reference, round(r.score, 6)) for r in polylines.choose_references(v, tracks, pairs, neighbours=True).collect()}
    assert near == {1: (3, 1.7), 2: (3, 0.78), 3: (2, 0.78)}
    none = pairs.limit(0)
    assert polylines.choose_references(v, tracks, none).count() == 0


def test_contacts_self_contacts_and_ignored(spark):
    v = frame(spark, {1: [(0, 0), (10, 0)], 2: [(5, -1), (5, 1)], 3: [(10, 0), (12, 0)], 4: [(3, 0), (4, 0)], 5: [(0, 5), (4, 5), (4, 7), (2, 7), (2, 3)], 6: [(20, 0), (22, 0), (21, 2), (20, 0)]})
    got = sorted((r.a, r.b) for r in polylines.contacts(v, v).collect() if r.a < r.b)
    assert got == [(1, 2), (1, 3), (1, 4)]
    assert {r.line_id for r in polylines.self_contacts(v).collect()} == {5}
    ignored = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1)], "line_id long, other long")
    assert sorted(r.line_id for r in polylines.crosses_others(v, v, ignored).collect()) == [3, 4]
    assert sorted(r.line_id for r in polylines.crosses_others(v, v, ignored, clearance=1.5).collect()) == [2, 3, 4]


def test_the_query_gives_every_candidate(spark):
    from rowloom.plans import finishing_queries

    found = finishing_queries.gap_candidates(spark, "/root/testdata/sf0.001")
    assert "GlobalLimit" not in found._jdf.queryExecution().optimizedPlan().toString()
