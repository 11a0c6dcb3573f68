"""Triangulation by levels with exact signs, and hulls in two to four dimensions, by brute force."""

import itertools

import numpy as np
import pytest

from pyspark.sql import functions as F

from alidade.operators import hull, hull_nd


def frame(spark, p, names):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(p)], f"point_id long, {', '.join(n + ' double' for n in names)}").repartition(5)


def cocircular():
    """A lattice, a ring of points on one circle (in whole numbers), and a column far away."""
    ring = [(x, y) for x in range(-65, 66) for y in range(-65, 66) if x * x + y * y == 65 * 65]
    return np.array([(i, j) for i in range(100, 120) for j in range(20)] + ring + [(1000, k) for k in range(12)], float)


@pytest.mark.parametrize("make", [lambda rng: rng.normal(size=(700, 2)), lambda rng: cocircular(), lambda rng: np.vstack([rng.normal(size=(400, 2)) * 1e-3, rng.normal(size=(200, 2))])])
def test_levels_give_the_one_triangulation(make, spark):
    """Tiles of few points in several levels, also of one dense cluster: the same triangles as in one piece."""
    xy = make(np.random.default_rng(7))
    p = frame(spark, xy, "xy")
    got = hull.delaunay(p, tile_points=90)
    key = {tuple(sorted((r.p1, r.p2, r.p3))) for r in got.collect()}
    assert key == {tuple(sorted(t)) for t in hull.triangulate(xy).tolist()}
    checks = hull.triangulation_checks(p, got).first()
    n, h = len(xy), checks.outer_edges
    assert (checks.points, checks.faces, checks.edges, checks.in_circle) == (n, 2 * n - 2 - h, 3 * n - 3 - h, 0)


def test_order_of_points_does_not_matter():
    xy, rng = cocircular(), np.random.default_rng(1)
    key = lambda p: {tuple(sorted(map(tuple, p[t]))) for t in hull.triangulate(p)}
    assert all(key(xy[rng.permutation(len(xy))]) == key(xy) for _ in range(3))


@pytest.mark.parametrize("name", ["columns", "even", "lattice", "finer", "clusters", "ring", "far"])
def test_stars_give_the_one_triangulation(name, monkeypatch):
    """Triangles found for many points at once are those of the points inserted one by one, and few points are left for that where they lie evenly."""
    rng, unit = np.random.default_rng(11), np.arange(30)
    xy = {
        "columns": rng.integers(0, [60, 180], (3000, 2)),
        "even": rng.random((3000, 2)),
        "lattice": np.array(list(itertools.product(unit, unit))),
        "finer": np.array(list(itertools.product(unit, unit))) * 0.1,
        "clusters": np.vstack([rng.normal(size=(900, 2)) * 1e-3, rng.normal(size=(900, 2))]),
        "ring": np.vstack([cocircular(), rng.integers(-40, 40, (900, 2))]),
        "far": rng.integers(0, 50, (2000, 2)) + 1e9,
    }[name].astype(float)
    xy = rng.permutation(np.unique(xy, axis=0))
    left, kept = [], hull.inserted
    monkeypatch.setattr(hull, "inserted", lambda p: left.append(len(p)) or kept(p))
    got = hull.triangulate(xy)
    assert sorted(tuple(sorted(t)) for t in got.tolist()) == sorted(tuple(sorted(t)) for t in kept(xy).tolist())
    a, b, c = (xy[got[:, k]] for k in range(3))
    assert ((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) > (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).all()
    assert name not in ("columns", "even", "lattice", "far") or sum(left) < 0.2 * len(xy)


def test_signs_where_doubles_fail():
    """Points that are a unit of the last place off a line or a circle, far from the origin."""
    up = np.nextafter(0.5, 1)
    s = hull.Signs(np.array([(0.5, 0.5), (12, 12), (24, 24), (0.5, up)]))
    assert s.orient(0, 1, 2) == 0 and s.orient(3, 1, 2) == -s.orient(3, 2, 1) != 0
    big = 2.0**40
    square = np.array([(big, big), (big + 1, big), (big + 1, big + 1), (big, big + 1 + 2.0**-12), (big, big + 1 - 2.0**-12)])
    s = hull.Signs(square)
    assert not s.inside(0, 1, 2, 3) and s.inside(0, 1, 2, 4)


def test_few_points_and_lines(spark):
    line = np.array([(k, 2 * k) for k in range(30)], float)
    assert hull.delaunay(frame(spark, line, "xy"), tile_points=8).count() == 0
    assert hull.delaunay(frame(spark, np.vstack([line, [(5, 0)]]), "xy"), tile_points=8).count() == 29
    assert len(hull.triangulate(np.zeros((0, 2)))) == len(hull.triangulate(np.zeros((2, 2)))) == 0


@pytest.mark.parametrize("d,n", [(2, 60), (3, 40), (4, 25)])
def test_facets_by_brute_force(d, n, spark):
    p = np.random.default_rng(d).normal(size=(n, d))
    want = set()
    for some in itertools.combinations(range(n), d):
        normal = np.linalg.svd(p[list(some)][1:] - p[some[0]])[2][-1]
        side = np.delete((p - p[some[0]]) @ normal, some)
        if (side > 0).all() or (side < 0).all():
            want.add(some)
    assert {f.vertices for f in hull_nd.facets(p)} == want
    names = list("xyzw"[:d])
    df = frame(spark, np.vstack([p, p[:7]]), names)
    got = hull_nd.convex_hull_nd(df, names, fan=2)
    assert {tuple(r.vertices) for r in got.collect()} == want
    assert hull_nd.hull_checks(df, names).first() == (n + 7, 0 if d % 2 == 0 else 2, 0, 0)


def test_hulls_of_flats_nulls_and_a_cube(spark):
    cube = np.array(list(itertools.product((0, 1), repeat=3)) + [(0.5, 0.5, 0.5), (0.5, 0.5, 0)], float)
    assert {v for f in hull_nd.facets(cube) for v in f.vertices} >= set(range(8)) and sum(1 for _ in hull_nd.facets(cube)) >= 12
    flat = frame(spark, np.column_stack([np.random.default_rng(0).normal(size=(20, 2)), np.zeros(20)]), "xyz")
    assert hull_nd.convex_hull_nd(flat, list("xyz")).count() == 0
    assert hull_nd.convex_hull_nd(flat.where("false"), list("xyz")).count() == 0
    some = flat.unionByName(spark.createDataFrame([(99, None, 1.0, 1.0), (98, 0.0, 0.0, 5.0)], flat.schema))
    assert {v for r in hull_nd.convex_hull_nd(some, list("xyz")).collect() for v in r.vertices} >= {98} and hull_nd.outside(some, hull_nd.convex_hull_nd(some, list("xyz")), list("xyz")).count() == 0
    beyond = hull_nd.outside(frame(spark, [(9, 9, 9)], "xyz"), hull_nd.convex_hull_nd(some, list("xyz")), list("xyz"))
    assert beyond.count() > 0


def test_only_corners_along_borders_leave_a_tile(spark, monkeypatch):
    """Corners of points that a tile closes are not written; the check finds a broken edge, with coordinates and without."""
    rows, kept = [], hull.written

    def counted(df, tag="round"):
        table = kept(df, tag)
        if tag == "corners":
            rows.append(table.count())
        return table

    monkeypatch.setattr(hull, "written", counted)
    p = frame(spark, np.random.default_rng(5).random((4000, 2)), "xy")
    got = kept(hull.delaunay(p, tile_points=3000, coordinates=True))
    n = got.count()
    assert 0 < max(rows) < n  # of 3 * n
    good = hull.triangulation_checks(p, got).first()
    assert good == hull.triangulation_checks(p, got.select("tri_id", "p1", "p2", "p3")).first()
    assert good["in_circle"] == 0 and good["faces"] == n == 2 * 4000 - 2 - good["outer_edges"]
    # one point put elsewhere breaks circles
    moved = got
    for i in "123":
        at = moved[f"p{i}"] == 7
        moved = moved.withColumns({f"x{i}": F.when(at, 0.5).otherwise(moved[f"x{i}"]), f"y{i}": F.when(at, 0.5).otherwise(moved[f"y{i}"])})
    assert hull.triangulation_checks(p, moved).first()["in_circle"] > 0
