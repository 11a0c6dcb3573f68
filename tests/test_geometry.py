"""Scalars, kernels and operators against values worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alidade.functions import angles as a
from alidade.functions import vectors as v
from alidade.operators import alignment as al
from alidade.operators import decimate, grids, hull, profile, stats
from alidade.operators import surface as s


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_angles(spark):
    L = lambda x: F.lit(float(x))
    got = one(
        spark,
        north=a.azimuth(L(0), L(1)), east=a.azimuth(L(1), L(0)), west=a.azimuth(L(-1), L(0)), low=a.into_range(L(-380), 0.0, 360.0), top=a.into_range(L(360), 0.0, 360.0),
        right=a.deflection(L(350), L(10)), left=a.deflection(L(10), L(350)), dms=a.dms_to_degrees(L(-10), L(30), L(36)), r=a.radius(L(5)), straight=a.radius(L(0)), back=a.degree_of_curve(a.radius(L(5))),
        quad=a.quadrant(L(271)), diff=a.azimuth_difference(L(10), L(20)), text=a.slope_text(L(0.025)), steep=a.slope_text(L(0.5)), up=a.slope_text(a.slope(L(0), L(1))),
    )
    assert (got["north"], got["east"], got["west"], got["low"], got["top"], got["right"], got["left"]) == (0, 90, 270, 340, 360, 20, -20)
    assert got["dms"] == pytest.approx(-10.51) and got["r"] == pytest.approx(1145.916, abs=1e-3) and got["straight"] is None and got["back"] == pytest.approx(5)
    assert (got["quad"], got["diff"], got["text"], got["steep"], got["up"]) == (4, -10, "2.50%", "2.0:1", "Vertical")


def test_ray_intersection(spark):
    L = lambda x: F.lit(float(x))
    r = v.ray_intersection(L(0), L(0), L(45), L(10), L(0), L(315))
    got = one(spark, **r)
    assert got["status"] == "ok" and got["x"] == pytest.approx(5) and got["y"] == pytest.approx(5)
    assert one(spark, **v.ray_intersection(L(0), L(0), L(45), L(10), L(0), L(45)))["status"] == "parallel"
    assert one(spark, **v.ray_intersection(L(0), L(0), L(225), L(10), L(0), L(315)))["status"] == "behind"


def test_single_triangle(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 10.0, 0.0, 0.0), (2, 0.0, 10.0, 1.0)], "point_id long, x double, y double, z double")
    tv = s.with_vertices(spark.createDataFrame([(0, 1, 0, 2), (1, 1, 1, 2)], "tri_id long, p1 long, p2 long, p3 long"), p)
    assert tv.count() == 1  # the degenerate one is gone
    q = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0)], "qid long, px double, py double")
    got = {r["qid"]: r for r in s.point_results(q, tv).collect()}
    assert got[1]["elevation"] == pytest.approx(0.1) and got[1]["slope_pct"] == pytest.approx(10) and got[1]["aspect"] == pytest.approx(270) and got[1]["compass_aspect"] == pytest.approx(180)
    assert got[2]["elevation"] is None and got[2]["tri_id"] is None
    assert tv.select(s.slope_double().alias("v")).first()["v"] == pytest.approx(10)


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 60), st.integers(0, 10**6))
def test_triangulation_is_delaunay(n, seed):
    xy = np.random.default_rng(seed).normal(size=(n, 2))
    t = hull.triangulate(xy)
    a_, b, c = xy[t[:, 0]], xy[t[:, 1]], xy[t[:, 2]]
    assert (((b - a_)[:, 0] * (c - a_)[:, 1] - (b - a_)[:, 1] * (c - a_)[:, 0]) > 0).all()
    cx, cy, r = hull._circles(xy, t)
    d = np.hypot(xy[:, 0][None] - cx[:, None], xy[:, 1][None] - cy[:, None])
    assert (d >= r[:, None] * (1 - 1e-7)).all()


def test_tiled_triangulation_equals_whole(spark):
    xy = np.random.default_rng(5).random((600, 2)) * 10
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double")
    key = lambda d: {tuple(sorted((r.p1, r.p2, r.p3))) for r in d.collect()}
    whole = hull.triangulate(xy)
    want = {tuple(sorted(t)) for t in whole.tolist()}
    tiled = key(hull.delaunay(p, tile_points=120))
    area = lambda ts: sum(abs((xy[b][0] - xy[a_][0]) * (xy[c][1] - xy[a_][1]) - (xy[b][1] - xy[a_][1]) * (xy[c][0] - xy[a_][0])) / 2 for a_, b, c in ts)
    assert key(hull.delaunay(p)) == want
    assert area(tiled) == pytest.approx(area(want), rel=1e-6)
    assert len(tiled ^ want) <= 0.02 * len(want)


def test_hull_of_few_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.5, 0.2), (4, 0.5, 1.0), (5, 0.5, 0.0)], "point_id long, x double, y double")
    assert [r.point_id for r in hull.convex_hull(p).orderBy("place").collect()] == [1, 2, 4]
    assert hull.delaunay(p.limit(2)).count() == 0


def test_editor():
    e = al.Editor(0, 0, 0, 100)
    e.append_arc(50, 150)
    assert e.parts[-1]["radius"] == pytest.approx(50) and e.parts[-1]["turn"] == pytest.approx(90)
    e.append_tangent(200, 150)
    assert e.parts[1]["turn"] == pytest.approx(90) and e.parts[2]["length"] == pytest.approx(150)
    e.append_arc(250, 100)
    e.append_tangent(250, 0)
    assert e.rows()[-1]["end_sta"] == pytest.approx(100 + 25 * math.pi + 150 + 25 * math.pi + 100)
    e.remove_last()
    assert len(e.parts) == 4
    with pytest.raises(ValueError):
        al.Editor(0, 0, 0, 1).append_arc(0, 5)


def test_spiral_out_is_the_mirror_of_spiral_in(spark):
    el = spark.createDataFrame([("a", 0, 0.0, 100.0, 0.0), ("a", 1, 0.0, 150.0, 4.0), ("a", 2, 4.0, 200.0, 4.0), ("a", 3, 4.0, 150.0, 0.0), ("a", 4, 0.0, 100.0, 0.0)], "align_id string, seq int, degree_in double, length double, degree_out double")
    head = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0)], "align_id string, x double, y double, station double, azimuth_deg double")
    seg = al.chain(el, head)
    r = {x.seq: x for x in seg.collect()}
    chord = lambda x: math.hypot(x.x1 - x.x0, x.y1 - x.y0)
    assert chord(r[1]) == pytest.approx(chord(r[3]), abs=1e-9) and r[4].az1 == pytest.approx(14)
    q = [(x.seq, x.begin_sta + f * (x.end_sta - x.begin_sta)) for x in r.values() for f in (0.0, 0.999999999)]
    st_ = spark.createDataFrame([("a", i, float(t), 0.0) for i, (_, t) in enumerate(q)], "align_id string, sid long, sta double, offset double")
    got = {x.sid: x for x in al.station_to_xy(st_, seg).collect()}
    for i, (k, _) in enumerate(q):
        want = (r[k].x0, r[k].y0) if i % 2 == 0 else (r[k].x1, r[k].y1)
        assert (got[i].x, got[i].y) == pytest.approx(want, abs=1e-4)


def test_round_trip_of_stations(spark):
    el = spark.createDataFrame([("a", 0, 0.0, 100.0, 0.0), ("a", 1, 6.0, 300.0, 6.0), ("a", 2, -8.0, 250.0, -8.0)], "align_id string, seq int, degree_in double, length double, degree_out double")
    seg = al.chain(el, spark.createDataFrame([("a", 500.0, 100.0, 1000.0, 33.0)], "align_id string, x double, y double, station double, azimuth_deg double"))
    st_ = spark.createDataFrame([("a", i, 1005.0 + 40.0 * i, 7.0 - i) for i in range(16)], "align_id string, sid long, sta double, offset double")
    xy = al.station_to_xy(st_, seg)
    back = al.xy_to_station(xy.select("align_id", F.col("sid").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("seq").alias("want")).drop("want"), seg)
    j = back.join(xy.select("align_id", F.col("sid").alias("pid"), "seq", F.col("sta").alias("s0"), "offset"), ["align_id", "pid", "seq"]).collect()
    assert len(j) == 16 and all(r.sta == pytest.approx(r.s0, abs=1e-6) and r.off == pytest.approx(r.offset, abs=1e-6) for r in j)


def test_station_text(spark):
    got = one(spark, t=al.station_text(F.lit(1234.56), F.lit(2), F.lit(1.5)), n=al.station_text(F.lit(-5.5)), b=al.station_value(F.lit("12+34.56 R 2")), bad=al.station_value(F.lit("x")))
    assert got == {"t": "12+34.56 R 2 [ext.]", "n": "-0+05.50", "b": 1234.56, "bad": None}


def test_pieces_that_do_not_join(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 5.0, 0.0, 6.0, 0.0)], "pid long, x0 double, y0 double, x1 double, y1 double")
    with pytest.raises(ValueError):
        al.ordered_pieces(p)


def test_profile_edges(spark):
    vp = spark.createDataFrame([(1, 0.0, 100.0, 0.0), (1, 500.0, 110.0, 200.0), (1, 1000.0, 95.0, 0.0)], "profile_id long, station double, elevation double, vc_length double")
    c = profile.curves(vp)
    assert [(r.begin_sta, r.end_sta) for r in c.orderBy("seq").collect()] == [(0, 400), (400, 600), (600, 1000)]
    q = spark.createDataFrame([(1, i, t) for i, t in enumerate((-1.0, 0.0, 400.0, 500.0, 1000.0, 1001.0))], "profile_id long, sid long, sta double")
    el = {r.sid: r.elevation for r in profile.elevations(q, c).collect()}
    assert el[0] is None and el[5] is None and el[1] == 100 and el[2] == 108 and el[3] == pytest.approx(108.75) and el[4] == pytest.approx(95)
    ext = {r.sid: r.elevation for r in profile.elevations(q, c, extend=True).collect()}
    assert ext[0] == 100 and ext[5] == pytest.approx(95)
    with pytest.raises(ValueError):
        profile.to_vpis(c)
    with pytest.raises(ValueError):
        profile.with_vpi(vp, 1, 500.0, 1.0)
    assert profile.with_vpi(vp, 1, 250.0, 1.0).count() == 4
    assert profile.constant(spark, 3).count() == 1


def test_fit_and_odds(spark):
    d = spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 12)], "x double, y double")
    got = stats.fit(d, lambda x, a_, b: a_ * x + b * 0, (0.0, 4.0), (0.0, 1.0), parts=21)
    assert got["a"] == pytest.approx(2.0, abs=0.01)
    sc = spark.range(1000).select((F.col("id") / 1000.0).alias("score"))
    k = decimate.solve_factor(sc, 0.2)
    assert sc.agg(F.avg(decimate.odds_scaled(F.col("score"), k))).first()[0] == pytest.approx(0.2, abs=1e-5)


def test_numbering_and_sampling(spark):
    p = spark.range(1000).select((F.col("id") * 7 % 1009).alias("seq"), F.col("id").alias("point_id"))
    got = decimate.numbered(p, "seq").orderBy("seq").collect()
    assert [r.place for r in got] == list(range(1000))
    assert decimate.random_sample(p, 10, 3).count() == 10
    assert grids.sample_grid(spark, (0.0, 0.0, 10.0, 5.0), 2.5).count() == 15


def test_histogram_cap_and_empty(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 1, 2, 3, 100)], "v double")
    h = stats.histogram(d, "v", 4, cap=1.0).orderBy("bin").collect()
    assert len(h) == 3 and sum(r.n for r in h) == 5
    assert sum(r.n for r in stats.histogram(d.limit(0), "v", 4).collect()) == 0


def test_helpers(spark):
    L = lambda x: F.lit(float(x))
    got = one(
        spark, root=a.root_by_false_position(lambda x: x * x, L(0), L(3), L(2)), none=a.root_by_false_position(lambda x: x * x, L(0), L(1), L(2)),
        x=a.x_from_y(L(5), L(0), L(0), L(4), L(10)), level=a.x_from_y(L(5), L(0), L(1), L(4), L(1)), same=v.same_truncated(L(1.2), L(3.9), L(5), L(1.8), L(3), L(5.5)),
    )
    assert got["root"] == pytest.approx(2**0.5) and got["none"] is None and got["x"] == 2 and got["level"] is None and got["same"]


def test_sections_and_chords(spark):
    seg = al.lines_from_points(spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.0, 100.0)], "align_id string, seq int, x double, y double"))
    st_ = spark.createDataFrame([("a", 1, 40.0)], "align_id string, sid long, sta double")
    c = al.cross_sections(st_, seg, 5.0, 7.0).first()
    assert (c.lx, c.ly, c.rx, c.ry) == pytest.approx((-5, 40, 7, 40))
    assert al.moved(seg, 3, 4).first()["x0"] == 3 and al.long_chords(seg).first()["chord"] == pytest.approx(100)
    arc = al.chain(spark.createDataFrame([("a", 0, 90.0, 100.0, 90.0)], "align_id string, seq int, degree_in double, length double, degree_out double"), spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0)], "align_id string, x double, y double, station double, azimuth_deg double"))
    assert [r[0] for r in arc.select(al.in_sweep(F.lit(0.0), F.lit(500.0))).collect()] in ([True], [False])
    box = arc.select(*[e.alias(n) for n, e in al.arc_box().items()]).first()
    assert box.xmin == pytest.approx(0) and box.ymax == pytest.approx(arc.first()["radius"])


def test_repeated_probes_come_back_each_time(spark, sf_dir):
    from alidade.operators import surface
    from alidade.plans import fixtures

    _, tv = fixtures.lattice(spark, sf_dir)
    probes = [(1, 2.0, 2.0), (1, 2.0, 2.0), (1, 2.0, 2.0), (2, 4.0, 4.0), (2, 4.0, 4.0), (3, -50.0, 0.0), (3, -50.0, 0.0), (4, 5.3, 7.1)]
    got = surface.point_results(spark.createDataFrame(probes, "qid long, px double, py double"), tv).collect()
    assert sorted((r.qid, r.px, r.py) for r in got) == sorted(probes)
    assert len({r.tri_id for r in got if r.qid == 2}) == 1 and all(r.tri_id is None for r in got if r.qid == 3)


def test_cut_of_spirals_and_arcs_by_sampling(spark, sf_dir):
    """Crossings of a chain with spirals lie on it and on the surface, and there is one wherever the chain changes triangles."""
    from alidade.operators import alignment as al
    from alidade.operators import profile as pr
    from alidade.operators import surface as s
    from alidade.plans import fixtures as x

    points, tv = x.lattice(spark, sf_dir)
    parts = [(1, 0, 0.0, 8.3, 0.0), (1, 1, 0.0, 14.0, 180.0), (1, 2, 180.0, 11.0, 180.0), (1, 3, 180.0, 14.0, 0.0)]
    elements = spark.createDataFrame(parts, "align_id long, seq int, degree_in double, length double, degree_out double")
    heads = spark.createDataFrame([(1, 9.3, 7.7, 0.0, 13.0)], "align_id long, x double, y double, station double, azimuth_deg double")
    seg = al.chain(elements, heads).cache()
    got = sorted((r.station, r.elevation) for r in pr.cut(tv, points, seg, 8.0).collect())
    fine = spark.range(4731).select(F.lit(1).cast("long").alias("align_id"), F.col("id").alias("sid"), (F.col("id") / 100).alias("sta"), F.lit(0.0).alias("offset"))
    xy = al.station_to_xy(fine, seg)
    q = xy.select(F.col("sid").alias("qid"), F.col("x").alias("px"), F.col("y").alias("py"))
    rows = sorted((r.qid, r.tri_id, r.el) for r in s.locate(q, tv).select("qid", "tri_id", s.elevation(F.col("px"), F.col("py")).alias("el")).collect())
    assert len(rows) == 4731
    steps = [(a[0] / 100, b[0] / 100, a[2]) for a, b in zip(rows, rows[1:]) if a[1] != b[1]]
    assert len(steps) > 10
    for lo, hi, el in steps:
        near = [e for t, e in got if lo - 0.02 <= t <= hi + 0.02]
        assert near and min(abs(e - el) for e in near) < 0.3
    for t, _ in got:
        assert any(lo - 0.02 <= t <= hi + 0.02 for lo, hi, _ in steps)


def test_editing_refuses_what_it_cannot_place(spark):
    from alidade.operators import profile as pr

    v = "profile_id long, station double, elevation double, vc_length double"
    plain, curved = spark.createDataFrame([(1, 0.0, 5.0, 0.0), (1, 10.0, 6.0, 0.0)], v), spark.createDataFrame([(1, 5.0, 5.0, 4.0)], v)
    more = spark.createDataFrame([(1, 10.00001, 7.0)], "profile_id long, station double, elevation double")
    for own in (plain, curved):
        with pytest.raises(ValueError):
            pr.with_points(own, more)


def test_dxf_alignments(spark, tmp_path):
    """A line and a polyline with a half circle to the left."""
    from alidade.sources import texts

    line = "0\nLINE\n8\nA\n10\n1\n20\n2\n11\n4\n21\n6\n"
    poly = "0\nLWPOLYLINE\n8\nA\n70\n0\n10\n0\n20\n0\n42\n1\n10\n0\n20\n10\n10\n5\n20\n10\n"
    (tmp_path / "a.dxf").write_text(f"0\nSECTION\n2\nENTITIES\n{line}{poly}0\nENDSEC\n0\nEOF\n")
    got = texts.read_dxf_alignments(spark, f"{tmp_path}/a.dxf").orderBy("align_id", "seq").collect()
    assert [(r.align_id, r.kind) for r in got] == [(0, "line"), (1, "arc"), (1, "line")]
    assert abs(got[0].length - 5) < 1e-9 and abs(got[1].length - 5 * 3.141592653589793) < 1e-9 and abs(got[1].turn + 180) < 1e-9
    assert abs(got[1].cx) < 1e-9 and abs(got[1].cy - 5) < 1e-9 and abs(got[2].begin_sta - got[1].length) < 1e-9


def test_walks_grow_with_length(spark):
    """Lines in all directions pass the cells that brute force finds, and few more than their length in cells."""
    import math

    from alidade.operators import profile as pr

    rows = [(k, 0.3, -1.7, 0.3 + 400 * math.cos(k), -1.7 + 400 * math.sin(k)) for k in range(12)] + [(20, 1.0, 1.0, 1.0, 301.0), (21, 8.0, 8.0, -296.0, 8.0), (22, 0.0, 0.0, 320.0, 320.0), (23, 5.0, 5.0, 5.0, 5.0)]
    got = {}
    for r in pr._walk(spark.createDataFrame(rows, "k int, wx0 double, wy0 double, wx1 double, wy1 double"), 8.0).collect():
        got.setdefault(r.k, []).append((r.gx, r.gy))
    for k, x0, y0, x1, y1 in rows:
        want = {(math.floor((x0 + t / 4000 * (x1 - x0)) / 8), math.floor((y0 + t / 4000 * (y1 - y0)) / 8)) for t in range(4001)}
        assert want <= set(got[k]) and len(got[k]) == len(set(got[k])) <= 3 * 400 / 8 + 4


def test_crossings_of_a_spiral_with_a_line_by_sampling(spark):
    """A spiral of more than half a turn crosses a long edge several times, each found once and to the last digits."""
    from alidade.operators import alignment as al
    from alidade.operators import profile as pr

    for deg_in, deg_out in ((0.0, 500.0), (-500.0, 0.0)):
        e = spark.createDataFrame([(1, 0, deg_in, 60.0, deg_out)], "align_id long, seq int, degree_in double, length double, degree_out double")
        h = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 20.0)], "align_id long, x double, y double, station double, azimuth_deg double")
        seg = al.chain(e, h)
        xy = al.station_to_xy(spark.range(60001).selectExpr("1L as align_id", "id as sid", "100 + id / 1000 as sta", "0D as offset"), seg).orderBy("sid").select("x", "y").collect()
        want, rows = [], []
        for a, b in ((10, 35), (20, 55), (5, 58), (30, 33)):  # edges through two places on it, and on
            p, q = xy[a * 1000 + 1], xy[b * 1000 + 1]
            ex, ey = q.x - p.x, q.y - p.y
            rows.append((p.x - 0.1 * ex, p.y - 0.1 * ey, 0.0, q.x + 0.1 * ex, q.y + 0.1 * ey, 1.0))
            side = [(r.x - p.x) * ey - (r.y - p.y) * ex for r in xy]
            on = [-0.1 < ((r.x - p.x) * ex + (r.y - p.y) * ey) / (ex * ex + ey * ey) < 1.1 for r in xy]
            want += [100 + (k + c / (c - d)) / 1000 for k, (c, d) in enumerate(zip(side, side[1:])) if on[k] and (c < 0) != (d < 0)]
        edges = spark.createDataFrame(rows, "xa double, ya double, za double, xb double, yb double, zb double")
        walked = pr._walk(edges.selectExpr("*", "xa wx0", "ya wy0", "xb wx1", "yb wy1"), 5.0)
        got = sorted({round(r.station, 8) for r in pr._crossings("spiral", seg, walked, 5.0).collect()})
        assert len(want) == 8 and got == pytest.approx(sorted(want), abs=1e-6)


def test_ordered_pieces_broadcast_nothing(spark):
    """Rows of a round that were broadcast would all pass through the driver."""
    p = spark.createDataFrame([(k, float(k), 0.0, float(k + 1), 0.0) for k in range(9)], "pid long, x0 double, y0 double, x1 double, y1 double")
    got = al.ordered_pieces(p)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.pid: r.place for r in got.collect()} == {k: k for k in range(9)}


def test_stations_are_dealt_by_the_number_of_orders(spark, sf_dir, monkeypatch):
    """Tasks grow with the rows, whatever their bytes."""
    from alidade import tables
    from alidade.plans import alignment_queries as q

    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert q.vpis(spark, sf_dir).rdd.getNumPartitions() == -(-n // 100)
    assert q.Q["u01_union_stations"](spark, sf_dir).rdd.getNumPartitions() == -(-4 * n // 100)
