"""Components, thinning, branches and burnt rows against plain whole-image versions."""

import numpy as np
import pytest

from rowloom.operators import kernels, raster


def frame(spark, image):
    return spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(image)], "row int, col int")


def places(df):
    return {(r.row, r.col) for r in df.collect()}


def blobs(seed, shape=(90, 70), share=0.42):
    return np.random.default_rng(seed).random(shape) < share


def brute_roots(image):
    left = {tuple(p) for p in np.argwhere(image).tolist()}
    out = {}
    while left:
        first = min(left)
        left.discard(first)
        todo, part = [first], [first]
        while todo:
            r, c = todo.pop()
            for p in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    todo.append(p)
                    part.append(p)
        out |= {p: first[0] * 2**32 + first[1] for p in part}
    return out


@pytest.mark.parametrize("block", [5, 32, 1024])
def test_components_do_not_depend_on_blocks(spark, block):
    image = blobs(1)
    got = {(r.row, r.col): r.root for r in raster.pixel_components(frame(spark, image), block).collect()}
    assert got == brute_roots(image)


def test_hysteresis_and_small_components(spark):
    image = blobs(2, share=0.3)
    p = np.random.default_rng(3).random(image.shape)
    rows = [(int(r), int(c), float(p[r, c])) for r, c in np.argwhere(image)]
    roots = brute_roots(image)
    strong = {roots[(r, c)] for r, c, v in rows if v >= 0.9}
    assert places(raster.hysteresis(spark.createDataFrame(rows, "row int, col int, p double"), 0.0, 0.9)) == {q for q, root in roots.items() if root in strong}
    size = {root: list(roots.values()).count(root) for root in set(roots.values())}
    edge = {root for (r, c), root in roots.items() if r in (0, image.shape[0] - 1) or c in (0, image.shape[1] - 1)}
    want = {q for q, root in roots.items() if size[root] >= 6 or root in edge}
    assert places(raster.drop_small(frame(spark, image), 6, *image.shape)) == want


@pytest.mark.parametrize("block,halo", [(40, 8), (64, 16), (512, 64)])
def test_thinning_equals_the_whole_image(spark, block, halo):
    image = np.zeros((130, 110), bool)
    image[5:100, 8:100] = True
    image[30:50, 40:60] = False
    image |= blobs(4, image.shape, 0.1)
    assert places(raster.thinned(frame(spark, image), block, halo)) == {tuple(p) for p in np.argwhere(kernels.thin(image)).tolist()}


def brute_branches(pixels):
    """(sorted ends, pixels) of each way between pixels that have not two neighbours, and of cycles without any."""
    near = {p: [q for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) if q in pixels] for p in pixels}
    nodes = {p for p in pixels if len(near[p]) != 2}
    out, used = [], set()
    for a in sorted(nodes):
        for b in near[a]:
            if b in nodes:
                if a < b:
                    out.append(((a, b), 2))
                continue
            path = [a, b]
            while path[-1] not in nodes:
                path.append(next(q for q in near[path[-1]] if q != path[-2]) if len(path) < 2 or near[path[-1]][0] != path[-2] or near[path[-1]][1] == path[-2] else near[path[-1]][1])
            key = frozenset(path[1:-1])
            if key not in used:
                used.add(key)
                out.append((tuple(sorted((a, path[-1]))), len(path)))
    left = pixels - nodes - set().union(*used) if used else pixels - nodes
    while left:
        first = min(left)
        path = [first, near[first][0]]
        while path[-1] != first:
            path.append(near[path[-1]][1] if near[path[-1]][0] == path[-2] else near[path[-1]][0])
        out.append(((), len(path)))
        left = left - set(path)
    return sorted(out)


def test_branches_and_lines(spark):
    image = np.zeros((40, 40), bool)
    image[5, 3:30] = True  # a way with a side branch
    image[5:15, 12] = True
    image[20:30, 20] = image[20:30, 29] = image[20, 20:30] = image[29, 20:30] = True  # a ring
    image[20, 20] = image[20, 29] = image[29, 20] = image[29, 29] = False
    image[35, 35] = image[36, 36] = True
    pixels = {tuple(p) for p in np.argwhere(image).tolist()}
    found, parts = raster.branches(frame(spark, image))
    name = lambda v: None if v is None else (v >> 32, v % 2**32)
    got = sorted((tuple(sorted(name(e) for e in (r.end_a, r.end_b) if e is not None)), r.n_pixels) for r in found.collect())
    assert got == brute_branches(pixels)
    sizes = {r.branch: r.n_pixels for r in found.collect()}
    lines = {}
    for r in raster.vectorize(parts, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)).orderBy("line_id", "pos").collect():
        lines.setdefault(r.line_id, []).append((r.x, r.y))
    assert {k: len(v) for k, v in lines.items()} == sizes
    for v in lines.values():
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(v, v[1:], strict=False))


def test_directional_close_fills_gaps_of_a_line(spark):
    image = np.zeros((9, 9), bool)
    image[4, [1, 3, 7]] = True
    assert places(raster.directional_close(frame(spark, image))) == {(4, 1), (4, 2), (4, 3), (4, 7)}


def test_burnt_rows(spark):
    rows = [(1, 1.0, 1.2, 8.5, 3.7), (2, 2.0, 9.0, 2.0, 4.0), (3, 6.0, 6.0, 6.0, 6.0)]
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    transform, reach = (0.5, 0.0, 0.0, 0.0, -0.5, 10.0), 0.6
    want = {}
    for r in range(20):
        for c in range(20):
            x, y = 0.5 * (c + 0.5), 10 - 0.5 * (r + 0.5)
            best = []
            for i, x0, y0, x1, y1 in rows:
                d = np.array([x1 - x0, y1 - y0])
                t = np.clip(((x - x0) * d[0] + (y - y0) * d[1]) / (d @ d), 0, 1) if d.any() else 0
                best.append((round(float(np.hypot(x - x0 - t * d[0], y - y0 - t * d[1])), 9), i))
            if min(best)[0] <= reach:
                want[(r, c)] = min(best)[1]
    got = raster.burn(df, transform, 20, 20, reach).collect()
    assert {(r.row, r.col): r.id for r in got} == want
    assert all(abs(r.sin2**2 + r.cos2**2 - 1) < 1e-9 for r in got)


def test_skeleton_agreement(spark):
    a, b, none = (frame(spark, x) for x in (np.eye(4, dtype=bool), np.ones((4, 2), bool), np.zeros((2, 2), bool)))
    r = raster.skeleton_agreement(a, b, a, b).first()
    assert (round(r.precision, 6), round(r.recall, 6)) == (0.5, 0.25) and abs(r.cldice - 1 / 3) < 1e-6
    assert raster.skeleton_agreement(none, none, none, none).first().cldice == 1.0
    assert raster.skeleton_agreement(a, none, a, none).first().cldice == 0.0
