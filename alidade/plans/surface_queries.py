"""Registered surface queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from alidade.functions.angles import rounded as R
from alidade.operators import surface as s
from alidade.operators import stats, decimate, grids, hull, hull_nd
from alidade.plans import fixtures as x
from alidade.tables import written
from alidade.plans.fixtures import ANG2, BAD, CLOUD, DIH, EDGES, GONE, HULL, LOC, LP, LT, QP, SIDES, SURF, TV, VE, r6

Q: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@add("s05_cells_as_points", "SELECT rid AS cell, CAST(100 + c*2 AS DOUBLE) + 1 AS x, CAST(200 + 16*2 AS DOUBLE) - 1 - r*2 AS y, z FROM (SELECT point_id AS rid, point_id//16 AS r, point_id%16 AS c, z FROM lp)".join([f"WITH {LP} ", ""]))
def _s05(spark, d):
    cells = x.lattice_points(spark, d).select("point_id", F.floor(F.col("point_id") / 16).alias("row"), (F.col("point_id") % 16).alias("col"), "z")
    return grids.cell_centres(cells, {"ncols": 16, "nrows": 16, "cellsize": 2.0, "xll": 100.0, "yll": 200.0}).select(F.col("point_id").alias("cell"), "x", "y", "z")


@add("s10_class_count", f"WITH {CLOUD} SELECT count(*) AS n FROM cloud WHERE classification IN (2, 5)")
def _s10(spark, d):
    return x.cloud(spark, d).where(F.col("classification").isin(2, 5)).agg(F.count("*").alias("n"))


@add("s11_tile_bucket", f"WITH {CLOUD} SELECT CAST(floor(x*1000/500) AS BIGINT) AS tx, CAST(floor(y*1000/500) AS BIGINT) AS ty, count(*) AS n FROM cloud GROUP BY 1,2")
def _s11(spark, d):
    return grids.tiled(x.cloud(spark, d).withColumns({"x": F.col("x") * 1000, "y": F.col("y") * 1000})).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@add("f01_class_filter", f"WITH {CLOUD} SELECT seq, classification FROM cloud WHERE classification IN (2, 3)")
def _f01(spark, d):
    return x.cloud(spark, d).where(F.col("classification").isin(2, 3)).select("seq", "classification")


@add("f02_bbox_filter", f"WITH {CLOUD} SELECT seq, x, y FROM cloud WHERE x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1")
def _f02(spark, d):
    from alidade.functions.vectors import in_box

    return x.cloud(spark, d).where(in_box(F.col("x"), F.col("y"), (-1, -1, 1, 1))).select("seq", "x", "y")


@add("f04_systematic_skip", f"WITH {CLOUD} SELECT seq, (row_number() OVER (ORDER BY seq) - 1) % 3 = 0 AS used FROM cloud")
def _f04(spark, d):
    return decimate.every_nth(x.cloud(spark, d), 2).select("seq", "used")


@add("t02_dedup_key", f"WITH {CLOUD} SELECT CAST(round_even(x*10,0) AS BIGINT) AS kx, CAST(round_even(y*10,0) AS BIGINT) AS ky, max(seq) AS seq FROM cloud GROUP BY 1,2")
def _t02(spark, d):
    return s.deduplicated(x.cloud(spark, d).withColumn("point_id", F.col("seq"))).select("kx", "ky", F.col("point_id").alias("seq"))


@add("j03_grid_index", f"WITH {SURF}, n AS (SELECT CAST(ceil(sqrt(sqrt(count(*)))) AS BIGINT) AS k FROM tv) SELECT cx, cy, count(*) AS n FROM (SELECT unnest(range(CAST(floor(xmin/60*k) AS BIGINT), least(CAST(floor(xmax/60*k) AS BIGINT), k-1)+1)) AS cx, CAST(floor(ymin/60*k) AS BIGINT) AS y0, least(CAST(floor(ymax/60*k) AS BIGINT), k-1) AS y1 FROM tv, n), LATERAL (SELECT unnest(range(y0, y1+1)) AS cy) GROUP BY 1,2")
def _j03(spark, d):
    _, tv = x.lattice(spark, d)
    return grids.grid_index(tv, (0.0, 0.0, 60.0, 60.0)).groupBy("cx", "cy").agg(F.count("*").alias("n"))


@add("j02_covering_boxes", f"WITH {SURF}, {QP} SELECT qid, count(*) AS n FROM qp JOIN tv ON px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax GROUP BY qid")
def _j02(spark, d):
    _, tv = x.lattice(spark, d)
    return s.covering_boxes(x.query_points(spark, d), tv).groupBy("qid").agg(F.count("*").alias("n"))


@add("j07_adjacency", f"WITH {LT}, {EDGES} SELECT pa, pb, tri_a, tri_b FROM e")
def _j07(spark, d):
    return s.edges(x.lattice_triangles(spark))


@add("j08_edge_triangle", f"WITH {LT}, {EDGES} SELECT pa, pb, coalesce(tri_b, tri_a) AS far_tri FROM e")
def _j08(spark, d):
    return s.edges(x.lattice_triangles(spark)).select("pa", "pb", F.coalesce("tri_b", "tri_a").alias("far_tri"))


@add("j09_incident", f"WITH {LT} SELECT point_id, count(*) AS n_triangles, min(tri_id) AS first_tri FROM (SELECT unnest([p1,p2,p3]) AS point_id, tri_id FROM lt) GROUP BY 1")
def _j09(spark, d):
    return s.incident(x.lattice_triangles(spark)).groupBy("point_id").agg(F.count("*").alias("n_triangles"), F.min("tri_id").alias("first_tri"))


@add("j10_vertices", f"WITH {SURF} SELECT tri_id, x1, y1, z1, x2, y2, z2, x3, y3, z3 FROM tv")
def _j10(spark, d):
    _, tv = x.lattice(spark, d)
    return tv.select("tri_id", *[f"{a}{k}" for k in (1, 2, 3) for a in "xyz"])


@add("f07_valid_edges", f"WITH {SURF}, {GONE}, {VE} SELECT pa, pb, tri_a, tri_b FROM ve WHERE tri_b IS NOT NULL AND (va OR vb)")
def _f07(spark, d):
    _, tv = x.pruned_lattice(spark, d)
    return s.edges_with_validity(tv).where(s.is_valid_edge()).select("pa", "pb", "tri_a", "tri_b")


@add("f06_valid_triangles", f"WITH {SURF}, {GONE} SELECT count(*) AS n FROM tv WHERE tri_id NOT IN (SELECT tri_id FROM gone)")
def _f06(spark, d):
    _, tv = x.pruned_lattice(spark, d)
    return tv.where("is_valid").agg(F.count("*").alias("n"))


@add("f08_hull_edges", f"WITH {SURF}, {GONE}, {VE} SELECT pa, pb FROM ve WHERE CAST(va AS INT)+coalesce(CAST(vb AS INT),0)=1")
def _f08(spark, d):
    _, tv = x.pruned_lattice(spark, d)
    return s.edges_with_validity(tv).where(s.is_hull_edge()).select("pa", "pb")


@add("f09_hull_points", f"WITH {SURF}, {GONE}, {VE}, {HULL} SELECT point_id FROM hull")
def _f09(spark, d):
    _, tv = x.pruned_lattice(spark, d)
    return s.hull_points(tv)


@add("f10_exterior", f"WITH {LT}, {EDGES} SELECT DISTINCT tri_a AS tri_id FROM e WHERE tri_b IS NULL")
def _f10(spark, d):
    return s.exterior(x.lattice_triangles(spark))


@add("f11_long_edges", f"WITH {SURF}, {EDGES} SELECT pa, pb, {r6('sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))')} AS len2d FROM e JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb WHERE sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) > 5")
def _f11(spark, d):
    p, tv = x.lattice(spark, d)
    return s.edge_lengths(s.edges(tv), p).where("len2d > 5").select("pa", "pb", R(F.col("len2d")).alias("len2d"))


@add("f12_flawed", f"WITH {SURF}, {BAD} SELECT tri_id FROM bad")
def _f12(spark, d):
    _, tv = x.lattice(spark, d)
    return s.flawed(tv).where("bad").select("tri_id")


@add("f13_sharp_edges", f"WITH {SURF}, {EDGES}, {DIH} SELECT pa, pb, {r6('dihedral')} AS dihedral FROM dih WHERE dihedral > 2.0")
def _f13(spark, d):
    _, tv = x.lattice(spark, d)
    return s.dihedrals(s.edges(tv), tv).where("dihedral > 2.0").select("pa", "pb", R(F.col("dihedral")).alias("dihedral"))


@add("f14_vertex_member", f"WITH {LT} SELECT tri_id FROM lt WHERE p1=17 OR p2=17 OR p3=17")
def _f14(spark, d):
    return x.lattice_triangles(spark).where(F.array_contains(F.array("p1", "p2", "p3"), F.lit(17).cast("long"))).select("tri_id")


@add("t13_prune", f"WITH {SURF}, {GONE} SELECT tri_id FROM gone")
def _t13(spark, d):
    _, tv = x.lattice(spark, d)
    return s.pruned(tv)


@add("t14_dissolve", f"""WITH {SURF}, {EDGES}, le AS (SELECT e.* FROM e JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb WHERE sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) > 3.9 AND a.y < 8 AND b.y < 8),
gone AS (WITH RECURSIVE r(t) AS (SELECT tri_a FROM le WHERE tri_b IS NULL UNION SELECT CASE WHEN le.tri_a=r.t THEN le.tri_b ELSE le.tri_a END FROM r JOIN le ON le.tri_b IS NOT NULL AND (le.tri_a=r.t OR le.tri_b=r.t)) SELECT t AS tri_id FROM r) SELECT tri_id FROM gone""")
def _t14(spark, d):
    p, tv = x.lattice(spark, d)
    return s.dissolved(tv, p, 3.9, where=F.expr("ya < 8 and yb < 8"))


@add("t06_dual_edges", f"WITH {LT}, {EDGES} SELECT tri_a, tri_b FROM e WHERE tri_b IS NOT NULL")
def _t06(spark, d):
    return s.edges(x.lattice_triangles(spark)).where("tri_b is not null").select("tri_a", "tri_b")


@add("t11_flip", f"WITH {SURF} SELECT tri_id, p1, p2, p3 FROM tv")
def _t11(spark, d):
    p = x.lattice_points(spark, d)
    upside = x.lattice_triangles(spark).select("tri_id", F.col("p2").alias("p1"), F.col("p1").alias("p2"), "p3")
    return s.with_vertices(upside, p).select("tri_id", "p1", "p2", "p3")


@add("j01_locate", f"WITH {SURF}, {QP}, {LOC} SELECT qp.qid, tri_id FROM qp LEFT JOIN loc USING (qid)")
def _j01(spark, d):
    _, tv = x.lattice(spark, d)
    return s.locate(x.query_points(spark, d), tv).select("qid", "tri_id")


_EL = r6("z1-(nx*(px-x1)+ny*(py-y1))/nz")
_SL = r6("abs(100.0::DOUBLE*sqrt(nx*nx+ny*ny)/nz)")
_PM = "(CASE WHEN {0} < 0 THEN {0} + 360 ELSE {0} END)"
_AS = r6(_PM.format("degrees(atan2(ny,nx))"))
_CA = r6(_PM.format("degrees(atan2(nx,ny))"))
_FROM = "FROM qp LEFT JOIN loc USING (qid) LEFT JOIN tv USING (tri_id)"


def _located(spark, d):
    _, tv = x.lattice(spark, d)
    return s.point_results(x.query_points(spark, d), tv)


for _name, _col, _sql in (("q01_elevation", "elevation", _EL), ("q02_slope", "slope_pct", _SL), ("q03_aspect", "aspect", _AS)):
    add(_name, f"WITH {SURF}, {QP}, {LOC} SELECT qp.qid, {_sql} AS {_col} {_FROM}")(lambda spark, d, c=_col: _located(spark, d).select("qid", R(F.col(c)).alias(c)))


@add("q04_locate", f"WITH {SURF}, {QP}, {LOC} SELECT qp.qid, tri_id, {_EL} AS elevation, {_SL} AS slope_pct, {_AS} AS aspect, {_CA} AS compass_aspect {_FROM}")
def _q04(spark, d):
    return _located(spark, d).select("qid", "tri_id", *[R(F.col(c)).alias(c) for c in ("elevation", "slope_pct", "aspect", "compass_aspect")])


@add("q05_normals", f"WITH {SURF} SELECT tri_id, nx, ny, nz, {r6('atan2(sqrt(nx*nx+ny*ny), nz)')} AS theta, {r6('(x1+x2+x3)/3')} AS cx, {r6('(y1+y2+y3)/3')} AS cy, {r6('(z1+z2+z3)/3')} AS cz, {r6('CASE WHEN nx*nx+ny*ny > 0 THEN nz/sqrt(nx*nx+ny*ny) END')} AS slope_double FROM tv")
def _q05(spark, d):
    from alidade.functions.vectors import theta

    _, tv = x.lattice(spark, d)
    centre = {f"c{a}": R((F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 3) for a in "xyz"}
    return tv.select("tri_id", "nx", "ny", "nz", R(theta(s.normal())).alias("theta"), *[e.alias(n) for n, e in centre.items()], R(s.slope_double()).alias("slope_double"))


@add("q06_area", f"WITH {SURF} SELECT tri_id, abs((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1))/2 AS area FROM tv")
def _q06(spark, d):
    _, tv = x.lattice(spark, d)
    return tv.select("tri_id", s.area2d().alias("area"))


@add("q07_angles2d", f"WITH {SURF}, {ANG2} SELECT tri_id, {r6('a1')} AS a1, {r6('a2')} AS a2, {r6('a3')} AS a3 FROM ang2")
def _q07(spark, d):
    _, tv = x.lattice(spark, d)
    return tv.select("tri_id", *[R(a).alias(f"a{k}") for k, a in enumerate(s.interior_angles_2d(), 1)])


def _ang3(k, i, j):
    dots = "+".join(f"({a}{i}-{a}{k})*({a}{j}-{a}{k})" for a in "xyz")
    la = "sqrt(" + "+".join(f"({a}{i}-{a}{k})*({a}{i}-{a}{k})" for a in "xyz") + ")"
    lb = "sqrt(" + "+".join(f"({a}{j}-{a}{k})*({a}{j}-{a}{k})" for a in "xyz") + ")"
    return f"acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, ({dots})/({la}*{lb}))))"


_A3 = f"ang3 AS (SELECT unnest([p1,p2,p3]) AS point_id, unnest([{_ang3(1, 2, 3)}, {_ang3(2, 3, 1)}, {_ang3(3, 1, 2)}]) AS angle, abs(nz)/2 AS area FROM tv)"
_PM3 = f"{_A3}, pm AS (SELECT point_id, sum(angle) AS angle_sum, sum(area)/3 AS sparsity FROM ang3 GROUP BY 1)"


def _measures(spark, d):
    _, tv = x.pruned_lattice(spark, d)
    return s.point_measures(tv, s.hull_points(tv))


@add("q08_angles3d", f"WITH {SURF}, {_PM3} SELECT point_id, {r6('angle_sum')} AS angle_sum FROM pm")
def _q08(spark, d):
    _, tv = x.lattice(spark, d)
    return s.point_measures(tv, spark.createDataFrame([], "point_id long")).select("point_id", R(F.col("angle_sum")).alias("angle_sum"))


@add("q09_curvature", f"WITH {SURF}, {GONE}, {VE}, {HULL}, {_PM3} SELECT point_id, CASE WHEN point_id NOT IN (SELECT point_id FROM hull) THEN {r6('2*pi()-angle_sum')} END AS curvature FROM pm")
def _q09(spark, d):
    return _measures(spark, d).select("point_id", R(F.col("curvature")).alias("curvature"))


@add("q10_sparsity", f"WITH {SURF}, {_PM3} SELECT point_id, {r6('sparsity')} AS sparsity FROM pm")
def _q10(spark, d):
    return _measures(spark, d).select("point_id", R(F.col("sparsity")).alias("sparsity"))


@add("q11_edge_length", f"WITH {SURF}, {EDGES} SELECT pa, pb, {r6('sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))')} AS len2d FROM e JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb")
def _q11(spark, d):
    p, tv = x.lattice(spark, d)
    return s.edge_lengths(s.edges(tv), p).select("pa", "pb", R(F.col("len2d")).alias("len2d"))


@add("q12_longest_edge", f"WITH {SURF} SELECT tri_id, {r6('greatest(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)), sqrt((x1-x3)*(x1-x3)+(y1-y3)*(y1-y3)))')} AS longest FROM tv")
def _q12(spark, d):
    from alidade.functions.vectors import base_length

    _, tv = x.lattice(spark, d)
    side = lambda a, b: base_length(F.col(f"x{b}") - F.col(f"x{a}"), F.col(f"y{b}") - F.col(f"y{a}"))
    return tv.select("tri_id", R(F.greatest(side(1, 2), side(2, 3), side(3, 1))).alias("longest"))


@add("q13_dihedral", f"WITH {SURF}, {EDGES}, {DIH} SELECT pa, pb, {r6('dihedral')} AS dihedral FROM dih")
def _q13(spark, d):
    _, tv = x.lattice(spark, d)
    return s.dihedrals(s.edges(tv), tv).select("pa", "pb", R(F.col("dihedral")).alias("dihedral"))


@add("g01_xyz_stats", f"WITH {LP} SELECT axis, {r6('min(v)')} AS low, {r6('max(v)')} AS high, {r6('max(v)-min(v)')} AS width, {r6('(max(v)+min(v))/2')} AS centre, {r6('avg(v)')} AS mean, {r6('median(v)')} AS median FROM (SELECT 'x' AS axis, x AS v FROM lp UNION ALL SELECT 'y', y FROM lp UNION ALL SELECT 'z', z FROM lp) GROUP BY axis")
def _g01(spark, d):
    return stats.xyz_stats(x.lattice_points(spark, d))


@add("g02_edge_stats", f"WITH {SURF}, {GONE}, {VE}, l AS (SELECT sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS len FROM ve JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb WHERE tri_b IS NOT NULL AND (va OR vb)) SELECT {r6('min(len)')} AS shortest, {r6('list_sort(list(len))[count(*)//2+1]')} AS median, {r6('max(len)')} AS longest FROM l")
def _g02(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    e = s.edge_lengths(s.edges_with_validity(tv).where(s.is_valid_edge()), p)
    return stats.edge_stats(e)


@add("g03_density", f"WITH {LP}, {LT} SELECT (SELECT count(*) FROM lp) AS n_points, (SELECT count(*) FROM lt) AS n_triangles, {r6('(max(x)-min(x))*(max(y)-min(y))')} AS area, {r6('count(*)/((max(x)-min(x))*(max(y)-min(y)))')} AS density, {r6('((max(x)-min(x))*(max(y)-min(y)))/count(*)')} AS per_point FROM lp")
def _g03(spark, d):
    return stats.density(x.lattice_points(spark, d), x.lattice_triangles(spark))


_SP = f"{LP}, {LT}, {TV}, {_PM3}"
_HB = "b AS (SELECT min(sparsity) AS lo, max(sparsity) AS hi FROM pm)"


@add("g08_sparsity_hist", f"WITH {_SP}, {_HB} SELECT bin, {r6('lo+(hi-lo)*bin/10')} AS min_x, {r6('lo+(hi-lo)*(bin+1)/10')} AS max_x, count(sparsity) AS n FROM range(10) r(bin) CROSS JOIN b LEFT JOIN pm ON least(CAST(floor(10*(sparsity-lo)/(hi-lo)) AS BIGINT), 9)=bin GROUP BY bin, lo, hi")
def _g08(spark, d):
    _, tv = x.lattice(spark, d)
    m = s.point_measures(tv, spark.createDataFrame([], "point_id long"))
    return stats.histogram(m, "sparsity", 10).select("bin", R(F.col("min_x")).alias("min_x"), R(F.col("max_x")).alias("max_x"), "n")


@add("g09_prob_hist", f"WITH {LP}, b AS (SELECT min(z) AS lo, (max(z)+0.00001::DOUBLE-min(z))/9 AS w FROM lp) SELECT bin, {r6('lo+w*bin')} AS min_x, {r6('lo+w*(bin+1)')} AS max_x, count(z) AS n FROM range(10) r(bin) CROSS JOIN b LEFT JOIN lp ON CAST(floor((z-lo)/w) AS BIGINT)=bin GROUP BY bin, lo, w")
def _g09(spark, d):
    return stats.probability_bins(x.lattice_points(spark, d), "z", 10).select("bin", R(F.col("min_x")).alias("min_x"), R(F.col("max_x")).alias("max_x"), "n")


_CT = "lt AS (SELECT 2*(7*i+j) AS tri_id, 32*i+2*j AS p1, 32*(i+1)+2*j AS p2, 32*(i+1)+2*(j+1) AS p3 FROM range(7) a(i), range(7) b(j) UNION ALL SELECT 2*(7*i+j)+1, 32*i+2*j, 32*(i+1)+2*(j+1), 32*i+2*(j+1) FROM range(7) a(i), range(7) b(j))"


@add("g07_error_stats", f"""WITH {LP}, {_CT}, {TV}, qp AS (SELECT point_id AS qid, x AS px, y AS py, z AS pz FROM lp WHERE point_id NOT IN (SELECT unnest([p1,p2,p3]) FROM lt)), {LOC},
er AS (SELECT abs(z1-(nx*(px-x1)+ny*(py-y1))/nz-pz) AS e FROM qp JOIN loc USING (qid) JOIN tv USING (tri_id)), k AS (SELECT list_sort(list(e)) AS l, count(*) AS n, avg(e) AS mean, max(e) AS mx, sqrt(avg(e*e)) AS rmse FROM er)
SELECT n, {r6('l[CAST(floor(0.25*n) AS BIGINT)+1]')} AS p25, {r6('l[CAST(floor(0.75*n) AS BIGINT)+1]')} AS p75, {r6('l[CAST(floor(0.95*n) AS BIGINT)+1]')} AS p95, {r6('mean')} AS mean, {r6('mx')} AS greatest, {r6('rmse')} AS rmse FROM k""")
def _g07(spark, d):
    p = x.lattice_points(spark, d)
    coarse = x.lattice_triangles(spark, 16, 2)
    used = s.incident(coarse).select("point_id").distinct()
    rest = p.join(used, "point_id", "left_anti").select(F.col("point_id").alias("qid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return stats.error_stats(rest, s.with_vertices(coarse, p))


@add("t16_sample_grid", f"WITH {LP}, b AS (SELECT min(x) AS x0, min(y) AS y0, CAST(floor((max(x)-min(x))/7) AS BIGINT)+1 AS nc, CAST(floor((max(y)-min(y))/7) AS BIGINT)+1 AS nr FROM lp) SELECT r.r AS row, c.c AS col, x0+7.0::DOUBLE*c AS x, y0+7.0::DOUBLE*r AS y FROM b, range(nr) r(r), range(nc) c(c)")
def _t16(spark, d):
    return grids.sample_grid(spark, grids.box_of(x.lattice_points(spark, d)), 7.0)


@add("t17_grid_raster", f"""WITH {SURF}, b AS (SELECT min(x) AS x0, min(y) AS y0, CAST(floor((max(x)-min(x))/7) AS BIGINT)+1 AS nc, CAST(floor((max(y)-min(y))/7) AS BIGINT)+1 AS nr FROM lp),
g AS (SELECT r.r AS row, c.c AS col, r.r*1000+c.c AS qid, x0+7.0::DOUBLE*c AS px, y0+7.0::DOUBLE*r AS py FROM b, range(nr) r(r), range(nc) c(c)), qp AS (SELECT * FROM g), {LOC}
SELECT row, col, {_EL} AS z {_FROM}""")
def _t17(spark, d):
    p, tv = x.lattice(spark, d)
    g = grids.sample_grid(spark, grids.box_of(p), 7.0)
    q = g.select((F.col("row") * 1000 + F.col("col")).alias("qid"), "row", "col", F.col("x").alias("px"), F.col("y").alias("py"))
    hit = s.locate(q, tv)
    return hit.select("row", "col", R(s.elevation(F.col("px"), F.col("py"))).alias("z"))


@add("t18_bbox", f"WITH {LP} SELECT min(x)-5 AS xmin, min(y)-5 AS ymin, max(x)+5 AS xmax, max(y)+5 AS ymax, min(z) AS zmin, max(z) AS zmax FROM lp")
def _t18(spark, d):
    return grids.bounding_box(x.lattice_points(spark, d), margin=5.0)


@add("t19_affine", f"WITH {LP}, b AS (SELECT (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy, (min(z)+max(z))/2 AS cz FROM lp) SELECT point_id, x-cx AS x, y-cy AS y, z-cz AS z FROM lp, b")
def _t19(spark, d):
    return grids.centred(x.lattice_points(spark, d))


@add("t03_delaunay_cloud", None)
def _t03b(spark, d):
    pts = s.deduplicated(x.cloud(spark, d)).withColumn("point_id", F.monotonically_increasing_id())
    return hull.delaunay(pts.select("point_id", "x", "y", "z"))


#: Hull points among ex(x, hi, lo), one row for each x: the least slope from the left against the greatest to the right.
_CHAINS = """lefts AS (SELECT p.x, min((p.hi-q.hi)/(p.x-q.x)) AS ul, max((p.lo-q.lo)/(p.x-q.x)) AS ll FROM ex p JOIN ex q ON q.x < p.x GROUP BY p.x),
rights AS (SELECT p.x, max((q.hi-p.hi)/(q.x-p.x)) AS ur, min((q.lo-p.lo)/(q.x-p.x)) AS lr FROM ex p JOIN ex q ON q.x > p.x GROUP BY p.x),
chains AS (SELECT ex.*, ul IS NULL OR ur IS NULL AS is_end, coalesce(ul-ur, 1) AS up, coalesce(lr-ll, 1) AS down
 FROM ex LEFT JOIN lefts USING (x) LEFT JOIN rights USING (x))"""


@add("t05_hull2d_cloud", f"""WITH {CLOUD}, ex AS (SELECT x, max(y) AS hi, min(y) AS lo FROM cloud GROUP BY x), {_CHAINS}
 SELECT min(seq) AS point_id FROM cloud JOIN chains USING (x) WHERE (y = hi AND up > 0) OR (y = lo AND down > 0) GROUP BY x, y""")
def _t05b(spark, d):
    return hull.convex_hull(x.cloud(spark, d).select(F.col("seq").alias("point_id"), "x", "y")).select("point_id")


@add("t03_delaunay_columns", f"""WITH pts AS (SELECT DISTINCT CAST(l_partkey AS DOUBLE) AS x, CAST(floor(l_extendedprice/50) AS DOUBLE) AS y FROM lineitem),
ex AS (SELECT x, max(y) AS hi, min(y) AS lo FROM pts GROUP BY x), {_CHAINS},
rim AS (SELECT sum(CASE WHEN is_end THEN c ELSE CAST(up >= 0 AS INT) + CAST(down >= 0 AND (hi > lo OR up < 0) AS INT) END) AS h
 FROM chains JOIN (SELECT x, count(*) AS c FROM pts GROUP BY x) USING (x)),
above AS (SELECT sum((x - px) * (hi + phi) / 2) AS a FROM (SELECT x, hi, lag(x) OVER (ORDER BY x) AS px, lag(hi) OVER (ORDER BY x) AS phi FROM chains WHERE is_end OR up >= 0)),
below AS (SELECT sum((x - px) * (lo + plo) / 2) AS a FROM (SELECT x, lo, lag(x) OVER (ORDER BY x) AS px, lag(lo) OVER (ORDER BY x) AS plo FROM chains WHERE is_end OR down >= 0))
SELECT n AS points, CAST(3*n-3-h AS BIGINT) AS edges, CAST(2*n-2-h AS BIGINT) AS faces, CAST(h AS BIGINT) AS outer_edges, round(above.a - below.a, 4) AS area, CAST(0 AS BIGINT) AS in_circle
 FROM (SELECT count(*) AS n FROM pts), rim, above, below""")
def _t03c(spark, d):
    pts = x.table(spark, d, "lineitem").select(F.col("l_partkey").cast("double").alias("x"), F.floor(F.col("l_extendedprice") / 50).cast("double").alias("y")).distinct()
    pts = written(pts.withColumn("point_id", F.monotonically_increasing_id()))
    return hull.triangulation_checks(pts, hull.delaunay(pts, coordinates=True))


@add("t03_delaunay_cloud_checks", f"""WITH {CLOUD}, pts AS (SELECT DISTINCT x, y FROM cloud), ex AS (SELECT x, max(y) AS hi, min(y) AS lo FROM pts GROUP BY x), {_CHAINS},
rim AS (SELECT sum(CASE WHEN is_end THEN CASE WHEN hi > lo THEN 2 ELSE 1 END ELSE CAST(up >= 0 AS INT) + CAST(down >= 0 AND (hi > lo OR up < 0) AS INT) END) AS h FROM chains),
above AS (SELECT sum((x - px) * (hi + phi) / 2) AS a FROM (SELECT x, hi, lag(x) OVER (ORDER BY x) AS px, lag(hi) OVER (ORDER BY x) AS phi FROM chains WHERE is_end OR up >= 0)),
below AS (SELECT sum((x - px) * (lo + plo) / 2) AS a FROM (SELECT x, lo, lag(x) OVER (ORDER BY x) AS px, lag(lo) OVER (ORDER BY x) AS plo FROM chains WHERE is_end OR down >= 0))
SELECT n AS points, CAST(3*n-3-h AS BIGINT) AS edges, CAST(2*n-2-h AS BIGINT) AS faces, CAST(h AS BIGINT) AS outer_edges, round(above.a - below.a, 4) AS area, CAST(0 AS BIGINT) AS in_circle
 FROM (SELECT count(*) AS n FROM pts), rim, above, below""")
def _t03d(spark, d):
    pts = x.cloud(spark, d).select(F.col("seq").alias("point_id"), "x", "y")
    return hull.triangulation_checks(pts, hull.delaunay(pts, tile_points=100, coordinates=True))


@add("t04_hull3d_checks", f"WITH {CLOUD} SELECT count(*) AS points, CAST(2 AS BIGINT) AS euler, CAST(0 AS BIGINT) AS open_ridges, CAST(0 AS BIGINT) AS outside FROM cloud")
def _t04(spark, d):
    return hull_nd.hull_checks(x.cloud(spark, d).withColumnRenamed("seq", "point_id"), ["x", "y", "z"])


@add("t04_hull3d_facets", None)
def _t04b(spark, d):
    return hull_nd.convex_hull_nd(x.cloud(spark, d).withColumnRenamed("seq", "point_id"), ["x", "y", "z"]).select("vertices")


_DEC = f"{SURF}, {GONE}, {VE}, {HULL}, cnt AS (SELECT (SELECT count(*) FROM lp) AS n, (SELECT count(*) FROM hull) AS h)"


@add("m02_targets", f"WITH {_DEC} SELECT n, h, CAST(floor(0.5*n) AS BIGINT) AS target, CAST(floor(0.5*n) AS BIGINT)-h AS remaining FROM cnt")
def _m02(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    return decimate.targets(p, s.hull_points(tv), 0.5)


_PICK = """q AS (SELECT CAST(trunc((CAST(t-h AS DOUBLE)/n)*0.5::DOUBLE*(t-2*h)) AS BIGINT) AS quota FROM (SELECT n, h, CAST(floor(0.5*n) AS BIGINT) AS t FROM cnt)),
ranked AS (SELECT pa, pb, row_number() OVER (ORDER BY dr DESC NULLS LAST, pa, pb) AS rk FROM (SELECT pa, pb, floor(dihedral*1000000+0.5) AS dr FROM dih)),
ends AS (SELECT unnest([pa,pb]) AS point_id, rk FROM ranked), firsts AS (SELECT point_id, min(rk) AS rk FROM ends WHERE point_id NOT IN (SELECT point_id FROM hull) GROUP BY 1),
pick AS (SELECT f.point_id FROM firsts f, q WHERE (SELECT count(*) FROM firsts g WHERE g.rk < f.rk) <= q.quota AND q.quota >= 0)"""


@add("m03_dihedral_pick", f"WITH {_DEC}, {_PICK} SELECT point_id FROM pick")
def _m03(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    return decimate.dihedral_pick(p, tv, s.hull_points(tv), 0.5, 0.5)


_SCORE = f"{_PM3}, sc AS (SELECT point_id, sparsity*abs(2*pi()-angle_sum) AS s FROM pm WHERE point_id NOT IN (SELECT point_id FROM hull))"


@add("m04_score", f"WITH {_DEC}, {_SCORE} SELECT point_id, {r6('s/(SELECT max(s) FROM sc)')} AS score FROM sc")
def _m04(spark, d):
    return decimate.scores(_measures(spark, d)).select("point_id", R(F.col("score")).alias("score"))


@add("m05_reweight", f"WITH {_DEC}, {_SCORE}, pr AS (SELECT point_id, s/(SELECT max(s) FROM sc) AS p FROM sc) SELECT point_id, {r6('0.25*p/(0.25*p+1-p)')} AS p FROM pr")
def _m05(spark, d):
    sc = decimate.scores(_measures(spark, d))
    return sc.select("point_id", R(decimate.odds_scaled(F.col("score"), 0.25)).alias("p"))


@add("m06_assign", None)
def _m06(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    return decimate.smart(p, tv, s.hull_points(tv), 0.6, 0.3)


@add("m07_random_p", f"WITH {_DEC} SELECT point_id, CASE WHEN point_id IN (SELECT point_id FROM hull) THEN 1.0::DOUBLE ELSE {r6('(CAST(floor(0.5*n) AS BIGINT)-h)/CAST(n AS DOUBLE)')} END AS p FROM lp, cnt")
def _m07(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    return decimate.random_p(p, s.hull_points(tv), 0.5).select("point_id", R(F.col("p")).alias("p"))


@add("m08_keep", None)
def _m08(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    return decimate.kept(decimate.random_p(p, s.hull_points(tv), 0.5), seed=3).select("point_id", "used")


@add("k02_xyz_text", f"WITH {LP} SELECT printf('%.2f,%.2f,%.2f', x, y, z) AS value FROM lp")
def _k02(spark, d):
    from alidade.sources import sinks

    return sinks.xyz_lines(x.lattice_points(spark, d))


@add("k03_obj_text", f"WITH {LP}, {LT} SELECT 'v '||printf('%.3f', x)||' '||printf('%.3f', y)||' '||printf('%.3f', z) AS value FROM lp UNION ALL SELECT 'f '||(p1+1)||' '||(p2+1)||' '||(p3+1) FROM lt")
def _k03(spark, d):
    from alidade.sources import sinks

    p, tv = x.lattice(spark, d)
    return sinks.obj_lines(p.withColumn("seq", F.col("point_id")), tv).where("kind > 0").select("value")


@add("k06_lines", f"WITH {SURF}, {EDGES}, {DIH} SELECT a.x AS xa, a.y AS ya, a.z AS za, b.x AS xb, b.y AS yb, b.z AS zb FROM dih JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb WHERE dihedral > 2.2")
def _k06(spark, d):
    p, tv = x.lattice(spark, d)
    e = s.edge_lengths(s.dihedrals(s.edges(tv), tv).where("dihedral > 2.2"), p)
    return e.select("xa", "ya", "za", "xb", "yb", "zb")


@add("k11_asc_text", f"WITH {LP} SELECT 15 - point_id%16 AS row, string_agg(regexp_replace(regexp_replace(printf('%.3f', z), '0+$', ''), '[.]$', ''), ' ' ORDER BY point_id//16) AS value FROM lp GROUP BY 1")
def _k11(spark, d):
    from alidade.sources import sinks

    cells = x.lattice_points(spark, d).select((F.lit(15) - F.col("point_id") % 16).alias("row"), F.floor(F.col("point_id") / 16).alias("col"), "z")
    return sinks.asc_rows(cells)


@add("u04_pool_minus_used", f"WITH {_DEC}, {_PICK} SELECT point_id FROM lp WHERE point_id NOT IN (SELECT point_id FROM hull) AND point_id NOT IN (SELECT point_id FROM pick)")
def _u04(spark, d):
    p, tv = x.pruned_lattice(spark, d)
    h = s.hull_points(tv)
    return p.select("point_id").join(h, "point_id", "left_anti").join(decimate.dihedral_pick(p, tv, h, 0.5, 0.5), "point_id", "left_anti")


@add("l04_edges_by_dihedral", f"WITH {SURF}, {EDGES}, {DIH} SELECT pa, pb, row_number() OVER (ORDER BY floor(dihedral*1000000+0.5) DESC NULLS LAST, pa, pb) AS place FROM dih")
def _l04(spark, d):
    _, tv = x.lattice(spark, d)
    e = s.dihedrals(s.edges(tv), tv).select("pa", "pb", F.coalesce(-F.floor(F.col("dihedral") * 1000000 + 0.5), F.lit(1)).alias("key"))
    return decimate.placed(e, "key", ["pa", "pb"]).select("pa", "pb", "place")


@add("l01_triangles_by_corner", f"WITH {SURF} SELECT tri_id, row_number() OVER (ORDER BY xmin, ymin, tri_id) AS place FROM tv")
def _l01(spark, d):
    _, tv = x.lattice(spark, d)
    return decimate.placed(tv, "xmin", ["ymin", "tri_id"]).select("tri_id", "place")


@add("u02_concat_points", f"WITH {CLOUD} SELECT seq FROM cloud")
def _u02(spark, d):
    c = decimate.every_nth(x.cloud(spark, d), 2)
    return c.where("used").select("seq").unionByName(c.where("not used").select("seq"))

