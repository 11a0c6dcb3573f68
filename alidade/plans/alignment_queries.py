"""Registered alignment, angle and profile queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.functions import angles as a
from alidade.functions import vectors as v
from alidade.functions.angles import rounded as R
from alidade.operators import alignment as al
from alidade.operators import hull
from alidade.operators import profile as pr
from alidade.operators import stats
from alidade.plans import fixtures as x
from alidade.plans.fixtures import r6
from alidade.sources import sinks
from alidade.tables import tasks_for

Q: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def elements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = x.table(spark, d, "nation")
    seq = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    deg = (F.col("n_nationkey") % 5 + 2).cast("double")
    k = F.col("n_nationkey") % 4
    e = n.select(
        F.col("n_regionkey").cast("long").alias("align_id"), seq.alias("seq"),
        F.when(k == 1, deg).when(k == 2, -deg).otherwise(0.0).alias("degree_in"), (F.col("n_nationkey") * 3 + 50).cast("double").alias("length"),
        F.when(k == 1, deg).when(k == 2, -deg).when(k == 3, deg).otherwise(0.0).alias("degree_out"),
    )
    r = x.table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("align_id"), (F.col("r_regionkey") * 1000).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1000.0).alias("station"), (F.col("r_regionkey") * 30 + 7).cast("double").alias("azimuth_deg"))
    return e, r


def segments(spark: SparkSession, d: str) -> DataFrame:
    return al.chain(*elements(spark, d))


_EL = """el AS (SELECT CAST(n_regionkey AS BIGINT) AS align_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)-1 AS INT) AS seq,
 CASE n_nationkey%4 WHEN 1 THEN CAST(n_nationkey%5+2 AS DOUBLE) WHEN 2 THEN -CAST(n_nationkey%5+2 AS DOUBLE) ELSE 0.0::DOUBLE END AS d_in, CAST(n_nationkey*3+50 AS DOUBLE) AS len,
 CASE n_nationkey%4 WHEN 1 THEN CAST(n_nationkey%5+2 AS DOUBLE) WHEN 2 THEN -CAST(n_nationkey%5+2 AS DOUBLE) WHEN 3 THEN CAST(n_nationkey%5+2 AS DOUBLE) ELSE 0.0::DOUBLE END AS d_out FROM nation)"""
_SPX = "l*(1-t*t/10+pow(t,4)/216-pow(t,6)/9360+pow(t,8)/685440)"
_SPY = "l*(t/3-pow(t,3)/42+pow(t,5)/1320-pow(t,7)/75600+pow(t,9)/6894720)"
#: The same chain by recursion over elements, each from the ray at which the one before ends.
_CH = f"""{_EL}, kd AS (SELECT *, CASE WHEN abs(d_in-d_out)<5e-5 THEN CASE WHEN abs(d_in)<5e-5 THEN 'line' ELSE 'arc' END ELSE 'spiral' END AS kind FROM el),
tn AS (SELECT *, CASE kind WHEN 'line' THEN 0.0::DOUBLE WHEN 'arc' THEN len*d_in/100 ELSE len*d_out/200 END AS turn FROM kd),
ch AS (WITH RECURSIVE r(align_id, seq, kind, len, d_in, turn, az0, x0, y0, x1, y1, s0) AS (
 SELECT align_id, -1, '', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 30.0::DOUBLE*align_id+7, 1000.0::DOUBLE*align_id, 0.0::DOUBLE, 1000.0::DOUBLE*align_id, 0.0::DOUBLE, 1000.0::DOUBLE FROM (SELECT DISTINCT align_id FROM tn)
 UNION ALL SELECT n.align_id, n.seq, n.kind, n.len, n.d_in, n.turn, n.az, n.x1, n.y1, n.x1 + n.al*sin(radians(n.az)) + n.rt*cos(radians(n.az)), n.y1 + n.al*cos(radians(n.az)) - n.rt*sin(radians(n.az)), n.s0+n.plen FROM (
  SELECT t.align_id, t.seq, t.kind, t.len, t.d_in, t.turn, r.az0+r.turn AS az, r.x1, r.y1, r.s0, r.len AS plen,
   CASE t.kind WHEN 'line' THEN t.len WHEN 'arc' THEN 18000/(pi()*abs(t.d_in))*sin(radians(abs(t.turn))) ELSE {_SPX.replace('l*', 't.len*').replace('t*t', 'radians(t.turn)*radians(t.turn)').replace('pow(t,', 'pow(radians(t.turn),')} END AS al,
   CASE t.kind WHEN 'line' THEN 0 WHEN 'arc' THEN sign(t.d_in)*18000/(pi()*abs(t.d_in))*(1-cos(radians(abs(t.turn)))) ELSE {_SPY.replace('l*(t/3', 't.len*(radians(t.turn)/3').replace('pow(t,', 'pow(radians(t.turn),')} END AS rt
  FROM r JOIN tn t ON t.align_id=r.align_id AND t.seq=r.seq+1) n) SELECT * FROM r WHERE seq>=0),
sg AS (SELECT *, s0+len AS s1, az0-floor(az0/360)*360 AS az, seq=max(seq) OVER (PARTITION BY align_id) AS is_last,
 CASE WHEN kind='arc' THEN 18000/(pi()*abs(d_in)) END AS rad, sign(turn) AS dir FROM ch)"""


@add("a01_kind", f"WITH {_EL} SELECT align_id, seq, CASE WHEN abs(d_in-d_out)<5e-5 THEN CASE WHEN abs(d_in)<5e-5 THEN 'line' ELSE 'arc' END ELSE 'spiral' END AS kind FROM el")
def _a01(spark, d):
    e, _ = elements(spark, d)
    return e.select("align_id", "seq", al.kind(F.col("degree_in"), F.col("degree_out")).alias("kind"))


@add("a02_chain", f"WITH {_CH} SELECT align_id, seq, {r6('az')} AS az0, {r6('x0')} AS x0, {r6('y0')} AS y0, {r6('x1')} AS x1, {r6('y1')} AS y1 FROM sg")
def _a02(spark, d):
    return segments(spark, d).select("align_id", "seq", *[R(F.col(c)).alias(c) for c in ("az0", "x0", "y0", "x1", "y1")])


@add("a03_station", f"WITH {_CH} SELECT align_id, seq, s0 AS begin_sta, s1 AS end_sta FROM sg")
def _a03(spark, d):
    return segments(spark, d).select("align_id", "seq", "begin_sta", "end_sta")


@add("a04_line_points", f"WITH p AS (SELECT c_nationkey AS align_id, c_custkey AS seq, CAST(c_custkey*37%6400 AS DOUBLE) AS x, CAST(c_custkey*91%6400 AS DOUBLE) AS y FROM customer), n AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM p WINDOW w AS (PARTITION BY align_id ORDER BY seq)) SELECT align_id, seq, {r6('sqrt(dx*dx+dy*dy)')} AS length, {r6('CASE WHEN degrees(atan2(dx,dy))<0 THEN degrees(atan2(dx,dy))+360 ELSE degrees(atan2(dx,dy)) END')} AS azimuth FROM n WHERE dx IS NOT NULL")
def _a04(spark, d):
    c = x.table(spark, d, "customer").select(F.col("c_nationkey").alias("align_id"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") * 37 % 6400).cast("double").alias("x"), (F.col("c_custkey") * 91 % 6400).cast("double").alias("y"))
    return al.lines_from_points(c).select("align_id", "seq", R(F.col("length")).alias("length"), R(F.col("az0")).alias("azimuth"))


@add("a05_arc", f"WITH {_CH} SELECT align_id, seq, {r6('turn')} AS turn, {r6('len')} AS length FROM sg WHERE kind='arc'")
def _a05(spark, d):
    s = segments(spark, d).where("kind = 'arc'")
    arc = al.arc_from_points(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "az0", "radius")])
    return s.select("align_id", "seq", R(arc["turn"]).alias("turn"), R(arc["length"]).alias("length"))


@add("a07_arc_ray", f"WITH {_CH} SELECT align_id, seq, {r6('rad')} AS radius, {r6('x0+rad*dir*cos(radians(az0))')} AS cx, {r6('y0-rad*dir*sin(radians(az0))')} AS cy FROM sg WHERE kind='arc'")
def _a07(spark, d):
    return segments(spark, d).where("kind = 'arc'").select("align_id", "seq", *[R(F.col(c)).alias(c) for c in ("radius", "cx", "cy")])


@add("a08_bulge", f"WITH {_CH} SELECT align_id, seq, {r6('turn')} AS turn, {r6('rad')} AS radius, {r6('len')} AS length FROM sg WHERE kind='arc'")
def _a08(spark, d):
    s = segments(spark, d).where("kind = 'arc'")
    b = -F.tan(F.radians(F.col("turn")) / 4)
    arc = al.arc_from_bulge(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], b)
    return s.select("align_id", "seq", *[R(arc[c]).alias(c) for c in ("turn", "radius", "length")])


_HITC = "(kind='arc' AND (({c}-a0)*dir)-floor((({c}-a0)*dir)/360)*360 <= abs(turn))"


@add("a10_arc_bbox", f"""WITH {_CH}, c AS (SELECT *, x0+rad*dir*cos(radians(az0)) AS cx, y0-rad*dir*sin(radians(az0)) AS cy, az0-90*dir AS a0 FROM sg)
SELECT align_id, seq, {r6(f"least(x0,x1,coalesce(CASE WHEN {_HITC.format(c=270)} THEN cx-rad END, x0))")} AS xmin, {r6(f"greatest(x0,x1,coalesce(CASE WHEN {_HITC.format(c=90)} THEN cx+rad END, x0))")} AS xmax,
{r6(f"least(y0,y1,coalesce(CASE WHEN {_HITC.format(c=180)} THEN cy-rad END, y0))")} AS ymin, {r6(f"greatest(y0,y1,coalesce(CASE WHEN {_HITC.format(c=0)} THEN cy+rad END, y0))")} AS ymax FROM c WHERE kind <> 'spiral'""")
def _a10(spark, d):
    s = segments(spark, d).where("kind <> 'spiral'")
    return s.select("align_id", "seq", *[R(e).alias(n) for n, e in al.arc_box().items()])


@add("a11_spiral", f"WITH {_EL}, s AS (SELECT align_id, seq, len AS l, radians(len*d_out/200) AS t FROM el WHERE abs(d_in-d_out)>=5e-5), q AS (SELECT *, {_SPX} AS sx, {_SPY} AS sy FROM s) SELECT align_id, seq, {r6('degrees(t)')} AS theta, {r6('sx')} AS x, {r6('sy')} AS y, {r6('sx-sy/tan(t)')} AS u, {r6('sy/sin(t)')} AS v FROM q")
def _a11(spark, d):
    e, _ = elements(spark, d)
    e = e.where(al.kind(F.col("degree_in"), F.col("degree_out")) == "spiral")
    s = al.spiral_elements(F.col("length"), F.col("degree_out"))
    return e.select("align_id", "seq", *[R(s[c]).alias(c) for c in ("theta", "x", "y", "u", "v")])


@add("a13_station_list", f"WITH {_CH}, b AS (SELECT align_id, min(s0) AS b, max(s1) AS e FROM sg GROUP BY 1) SELECT align_id, k AS sid, least(b+25.0::DOUBLE*k, e) AS sta FROM b, LATERAL (SELECT unnest(range(CAST(ceil((e-b)/25) AS BIGINT)+1)) AS k)")
def _a13(spark, d):
    return al.stations_at(segments(spark, d), 25.0)


_ST = "st AS (SELECT align_id, k AS sid, b+(k*(e-b))/7 AS sta, CAST(k-3 AS DOUBLE) AS off FROM (SELECT align_id, min(s0) AS b, max(s1) AS e FROM sg GROUP BY 1), range(9) r(k))"
_PT = f"""pt AS (SELECT st.align_id, st.sid, g.seq, kind, st.sta-s0 AS l, off, az0, x0, y0, rad, dir, turn, len, d_in FROM st JOIN sg g ON g.align_id=st.align_id AND sta>=s0 AND (sta<s1 OR (is_last AND sta=s1))),
p2 AS (SELECT *, radians(turn)*(l/len)*(l/len) AS t, x0+rad*dir*cos(radians(az0)) AS cx, y0-rad*dir*sin(radians(az0)) AS cy FROM pt),
p3 AS (SELECT *, {_SPX} AS sx, {_SPY} AS sy FROM p2),
xy AS (SELECT align_id, sid, seq, CASE kind WHEN 'line' THEN x0+l*sin(radians(az0))+off*cos(radians(az0)) WHEN 'arc' THEN cx+(rad-dir*off)*sin(radians(az0-90*dir+turn*l/len))
 ELSE x0+sx*sin(radians(az0))+sy*cos(radians(az0))+off*cos(radians(az0)+t) END AS x, CASE kind WHEN 'line' THEN y0+l*cos(radians(az0))-off*sin(radians(az0)) WHEN 'arc' THEN cy+(rad-dir*off)*cos(radians(az0-90*dir+turn*l/len))
 ELSE y0+sx*cos(radians(az0))-sy*sin(radians(az0))-off*sin(radians(az0)+t) END AS y FROM p3)"""


def stations(spark, d):
    per = segments(spark, d).groupBy("align_id").agg(F.min("begin_sta").alias("b"), F.max("end_sta").alias("e"))
    k = F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")).alias("sid")
    rows = per.select("align_id", "b", "e", k)
    return rows.select("align_id", "sid", (F.col("b") + (F.col("sid") * (F.col("e") - F.col("b"))) / 7).alias("sta"), (F.col("sid") - 3).cast("double").alias("offset"))


@add("a17_station_to_xy", f"WITH {_CH}, {_ST}, {_PT} SELECT st.align_id, st.sid, seq, {r6('x')} AS x, {r6('y')} AS y FROM st LEFT JOIN xy USING (align_id, sid)")
def _a17(spark, d):
    s = al.station_to_xy(stations(spark, d), segments(spark, d))
    return s.select("align_id", "sid", "seq", R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


@add("j11_station_segment", f"WITH {_CH}, {_ST} SELECT st.align_id, sid, seq FROM st LEFT JOIN sg ON sg.align_id=st.align_id AND sta>=s0 AND (sta<s1 OR (is_last AND sta=s1))")
def _j11(spark, d):
    return al.station_to_xy(stations(spark, d), segments(spark, d)).select("align_id", "sid", "seq")


_PP = "pp AS (SELECT r AS align_id, c_custkey AS pid, 1000.0::DOUBLE*r+CAST(c_custkey*37%400 AS DOUBLE)+0.25::DOUBLE AS px, CAST(c_custkey*91%400 AS DOUBLE)-50+0.125::DOUBLE AS py FROM customer, range(5) t(r))"
_AZ = "CASE WHEN {0}<-180 THEN {0}+360 WHEN {0}>180 THEN {0}-360 ELSE {0} END"


_A21 = f"""WITH {_CH}, {_PP}, m AS (SELECT pp.*, seq, kind, s0, len, turn, dir, rad, (px-x0)*sin(radians(az0))+(py-y0)*cos(radians(az0)) AS ll, (px-x0)*cos(radians(az0))-(py-y0)*sin(radians(az0)) AS lo,
 x0+rad*dir*cos(radians(az0)) AS cx, y0-rad*dir*sin(radians(az0)) AS cy, az0-90*dir AS a0 FROM pp JOIN sg USING (align_id)),
n AS (SELECT *, degrees(atan2(px-cx,py-cy))-a0 AS w0, sqrt((px-cx)*(px-cx)+(py-cy)*(py-cy)) AS dist FROM m), o AS (SELECT *, w0-floor(w0/360)*360 AS w1 FROM n), q AS (SELECT *, CASE WHEN w1>180 THEN w1-360 ELSE w1 END AS w FROM o),
h AS (SELECT align_id, pid, seq, CASE kind WHEN 'line' THEN ll WHEN 'arc' THEN len*w/turn END AS l, CASE kind WHEN 'line' THEN lo WHEN 'arc' THEN dir*(rad-dist) END AS off, s0, len FROM q)
SELECT align_id, pid, seq, {r6('s0+l')} AS sta, {r6('off')} AS off, CAST(row_number() OVER (PARTITION BY align_id, pid ORDER BY floor(abs(off)*1e6+0.5), seq) AS INT) AS place FROM h WHERE l>=0 AND l<=len"""


@add("a21_xy_to_station", _A21)
def _a21(spark, d):
    c = x.table(spark, d, "customer")
    p = c.withColumn("align_id", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>"))).select("align_id", F.col("c_custkey").alias("pid"), (F.col("align_id") * 1000.0 + (F.col("c_custkey") * 37 % 400).cast("double") + 0.25).alias("px"), ((F.col("c_custkey") * 91 % 400).cast("double") - 50 + 0.125).alias("py"))
    h = al.xy_to_station(p, segments(spark, d))
    return h.select("align_id", "pid", "seq", R(F.col("sta")).alias("sta"), R(F.col("off")).alias("off"), "place")


_RG = "rg AS (SELECT align_id, CAST(row_number() OVER (PARTITION BY align_id ORDER BY seq) AS INT) AS region, 100.0::DOUBLE*seq AS b, 100.0::DOUBLE*seq+len AS e FROM el)"


@add("a26_regions", f"""WITH {_EL}, {_RG}, t AS (SELECT *, coalesce(sum(e-b) OVER (PARTITION BY align_id ORDER BY region ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS tb FROM rg),
z AS (SELECT align_id, max(tb+e-b) AS te, arg_max(region, region) AS zr, arg_max(e, region) AS ze FROM t GROUP BY 1), ts AS (SELECT DISTINCT align_id, k AS sid, 61.5::DOUBLE*k AS s FROM rg, range(9) q(k))
SELECT ts.align_id, sid, s AS true_sta, coalesce(t.region, CASE WHEN s>=te THEN zr END) AS region, coalesce(t.b+s-tb, CASE WHEN s>=te THEN ze END) AS sta, CASE WHEN t.region IS NULL AND s>=te THEN s-te ELSE 0.0::DOUBLE END AS extended
FROM ts JOIN z USING (align_id) LEFT JOIN t ON t.align_id=ts.align_id AND s>=tb AND s<tb+e-b""")
def _a26(spark, d):
    e, _ = elements(spark, d)
    rg = e.select("align_id", (F.col("seq") + 1).alias("region"), (F.col("seq") * 100.0).alias("begin_sta"), (F.col("seq") * 100.0 + F.col("length")).alias("end_sta"))
    ts = rg.select("align_id").distinct().select("align_id", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")).alias("sid"))
    return al.to_region_station(ts.withColumn("true_sta", F.col("sid") * 61.5), rg)


@add("a27_station_text", "SELECT c_custkey, CAST(CAST(floor(c*1.0/10000) AS BIGINT) AS VARCHAR)||'+'||printf('%05.2f', (c%10000)/100.0::DOUBLE) AS text, c/100.0::DOUBLE AS back FROM (SELECT c_custkey, CAST(c_custkey*137 AS BIGINT) AS c FROM customer)")
def _a27(spark, d):
    c = x.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 137 / 100.0).alias("s"))
    t = al.station_text(F.col("s"))
    return c.select("c_custkey", t.alias("text"), al.station_value(t).alias("back"))


@add("k08_event_points", f"WITH {_CH} SELECT align_id, -1 AS place, {r6('x0')} AS x, {r6('y0')} AS y FROM sg WHERE seq=0 UNION ALL SELECT align_id, seq, {r6('x1')}, {r6('y1')} FROM sg")
def _k08(spark, d):
    return al.event_points(segments(spark, d)).select("align_id", F.col("place").cast("int").alias("place"), R(F.col("x")).alias("x"), R(F.col("y")).alias("y"))


@add("g11_rollup", f"WITH {_CH} SELECT align_id, min(s0) AS begin_sta, max(s1) AS end_sta, sum(len) AS length, count(*) AS n, {r6('arg_max(turn, seq) FILTER (WHERE kind=' + chr(39) + 'arc' + chr(39) + ')')} AS last_arc_turn FROM sg GROUP BY 1")
def _g11(spark, d):
    return al.rollup(segments(spark, d)).withColumn("last_arc_turn", R(F.col("last_arc_turn")))


@add("a09_order_pieces", f"WITH {_CH} SELECT align_id, seq AS pid, CAST(seq AS BIGINT) AS place FROM sg")
def _a09(spark, d):
    s = segments(spark, d).select("align_id", F.col("seq").alias("pid"), "x0", "y0", "x1", "y1")
    return al.ordered_pieces(s, by="align_id").select("align_id", "pid", "place")


@add("x_angles", f"""WITH q AS (SELECT c_custkey AS k, CAST(c_custkey*37%1440-720 AS DOUBLE) AS g FROM customer)
SELECT k, {r6('degrees(atan2(sin(radians(g)),cos(radians(g))))')} AS norm, {r6('(90-g)-floor((90-g)/360)*360')} AS az, CAST(floor((g-floor(g/360)*360)/90)+1 AS INT) AS quad, {r6('18000/(pi()*(abs(g)+1))')} AS radius FROM q""")
def _xa(spark, d):
    q = x.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 37 % 1440 - 720).cast("double").alias("g"))
    g = F.col("g")
    return q.select("k", R(F.degrees(a.normalised(F.radians(g)))).alias("norm"), R(a.pmod(90.0 - g, 360.0)).alias("az"), a.quadrant(g).alias("quad"), R(a.radius(F.abs(g) + 1)).alias("radius"))


@add("j06_ray_ray", f"""WITH q AS (SELECT c_custkey AS k, CAST(c_custkey%7 AS DOUBLE) AS ax, 0.0::DOUBLE AS ay, CAST(c_custkey*13%360 AS DOUBLE) AS aa, CAST(c_custkey%11 AS DOUBLE)+20 AS bx, 5.0::DOUBLE AS b2, CAST(c_custkey*29%360 AS DOUBLE) AS ba FROM customer),
w AS (SELECT *, sin(radians(ba))*cos(radians(aa))-cos(radians(ba))*sin(radians(aa)) AS det FROM q),
z AS (SELECT *, ((b2-ay)*sin(radians(ba))-(bx-ax)*cos(radians(ba)))/det AS u, ((b2-ay)*sin(radians(aa))-(bx-ax)*cos(radians(aa)))/det AS w FROM w),
s AS (SELECT *, CASE WHEN abs(det)<1e-12 THEN 'parallel' WHEN u < -1e-9 OR w < -1e-9 THEN 'behind' ELSE 'ok' END AS status FROM z)
SELECT k, status, CASE WHEN status='ok' THEN {r6('ax+u*sin(radians(aa))')} END AS x, CASE WHEN status='ok' THEN {r6('ay+u*cos(radians(aa))')} END AS y FROM s""")
def _j06(spark, d):
    k = F.col("c_custkey")
    r = v.ray_intersection((k % 7).cast("double"), F.lit(0.0), (k * 13 % 360).cast("double"), (k % 11).cast("double") + 20, F.lit(5.0), (k * 29 % 360).cast("double"))
    return x.table(spark, d, "customer").select(k.alias("k"), r["status"].alias("status"), R(r["x"]).alias("x"), R(r["y"]).alias("y"))


# --- vertical profiles -------------------------------------------------------------------------------------------


def vpis(spark, d):
    o = x.table(spark, d, "orders").select(F.col("o_custkey").alias("profile_id"), F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double").alias("station"), (F.floor(F.col("o_totalprice")) / 4).cast("double").alias("elevation"))
    # dealt once by profile, which is what the windows over its stations need too
    o = o.repartition(tasks_for(x.table(spark, d, "orders").count()), "profile_id")
    o = o.groupBy("profile_id", "station").agg(F.max("elevation").alias("elevation"))
    w = Window.partitionBy("profile_id").orderBy("station")
    gap = F.least(F.col("station") - F.lag("station").over(w), F.lead("station").over(w) - F.col("station"))
    ends = F.lag("station").over(w).isNull() | F.lead("station").over(w).isNull()
    return o.withColumn("vc_length", F.when(ends, 0.0).otherwise((F.col("profile_id") % 2) * gap / 2))


_VP = """vp0 AS (SELECT o_custkey AS profile_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS station, max(floor(o_totalprice)/4) AS elevation FROM orders GROUP BY 1,2),
vp AS (SELECT *, CASE WHEN lag(station) OVER w IS NULL OR lead(station) OVER w IS NULL THEN 0.0::DOUBLE ELSE (profile_id%2)*least(station-lag(station) OVER w, lead(station) OVER w-station)/2 END AS l FROM vp0 WINDOW w AS (PARTITION BY profile_id ORDER BY station))"""
_CV = f"""{_VP}, g AS (SELECT *, (lead(elevation) OVER w-elevation)/(lead(station) OVER w-station) AS go, (elevation-lag(elevation) OVER w)/(station-lag(station) OVER w) AS gi, lead(station) OVER w AS s2, coalesce(lead(l) OVER w,0) AS l2 FROM vp WINDOW w AS (PARTITION BY profile_id ORDER BY station)),
cu AS (SELECT profile_id, station-l/2 AS b, station+l/2 AS e, elevation-gi*l/2 AS el, gi AS g1, go AS g2 FROM g WHERE l>0 AND gi IS NOT NULL AND go IS NOT NULL UNION ALL SELECT profile_id, station+l/2, s2-l2/2, elevation+go*l/2, go, go FROM g WHERE s2 IS NOT NULL AND s2-l2/2 > station+l/2),
cv AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY b) AS seq FROM cu)"""


def curves(spark, d):
    return pr.curves(vpis(spark, d))


@add("p01_curves", f"WITH {_CV} SELECT profile_id, CAST(seq AS INT) AS seq, b AS begin_sta, e AS end_sta, {r6('el')} AS begin_el, {r6('g1')} AS g1, {r6('g2')} AS g2 FROM cv")
def _p01(spark, d):
    return curves(spark, d).select("profile_id", "seq", "begin_sta", "end_sta", *[R(F.col(c)).alias(c) for c in ("begin_el", "g1", "g2")])


@add("p02_polyline", f"WITH {_VP}, n AS (SELECT profile_id, station, elevation, (lead(elevation) OVER w-elevation)/(lead(station) OVER w-station) AS g FROM vp WINDOW w AS (PARTITION BY profile_id ORDER BY station)) SELECT profile_id, station AS begin_sta, elevation AS begin_el, {r6('g')} AS g1 FROM n WHERE g IS NOT NULL")
def _p02(spark, d):
    return pr.polyline(vpis(spark, d).select("profile_id", "station", "elevation")).select("profile_id", "begin_sta", "begin_el", R(F.col("g1")).alias("g1"))


_PS = "ps AS (SELECT profile_id, k AS sid, b0+floor(k*(e0-b0)/7) AS sta FROM (SELECT profile_id, min(b) AS b0, max(e) AS e0 FROM cv GROUP BY 1), range(9) r(k))"


def profile_stations(spark, d):
    per = curves(spark, d).groupBy("profile_id").agg(F.min("begin_sta").alias("b"), F.max("end_sta").alias("e"))
    rows = per.select("profile_id", "b", "e", F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")).alias("sid"))
    return rows.select("profile_id", "sid", (F.col("b") + F.floor(F.col("sid") * (F.col("e") - F.col("b")) / 7)).alias("sta"))


_EV = "el+g1*(sta-b)+(sta-b)*(sta-b)*(g2-g1)/(e-b)/2"
_BA = f"""bk AS (SELECT ps.profile_id, sid, {_EV} AS v, g1+(g2-g1)/(e-b)*(sta-b) AS g FROM ps JOIN cv ON cv.profile_id=ps.profile_id AND sta>b AND sta<=e),
ah AS (SELECT ps.profile_id, sid, {_EV} AS v, g1+(g2-g1)/(e-b)*(sta-b) AS g FROM ps JOIN cv ON cv.profile_id=ps.profile_id AND sta>=b AND sta<e)"""


@add("p06_back_ahead", f"WITH {_CV}, {_PS}, {_BA} SELECT ps.profile_id, ps.sid, sta, {r6('bk.v')} AS el_back, {r6('ah.v')} AS el_ahead, {r6('bk.g')} AS g_back, {r6('ah.g')} AS g_ahead, coalesce(abs(bk.v-ah.v)<5e-5, false) AS is_single FROM ps LEFT JOIN bk USING (profile_id, sid) LEFT JOIN ah USING (profile_id, sid)")
def _p06(spark, d):
    b = pr.back_ahead(profile_stations(spark, d), curves(spark, d))
    return b.select("profile_id", "sid", "sta", *[R(F.col(c)).alias(c) for c in ("el_back", "el_ahead", "g_back", "g_ahead")], "is_single")


@add("p07_elevation", f"WITH {_CV}, {_PS}, {_BA} SELECT ps.profile_id, ps.sid, {r6('coalesce(ah.v, bk.v)')} AS elevation FROM ps LEFT JOIN bk USING (profile_id, sid) LEFT JOIN ah USING (profile_id, sid)")
def _p07(spark, d):
    return pr.elevations(profile_stations(spark, d), curves(spark, d)).select("profile_id", "sid", R(F.col("elevation")).alias("elevation"))


@add("p08_scale", f"WITH {_CV} SELECT profile_id, CAST(seq AS INT) AS seq, {r6('el*0.5')} AS begin_el, {r6('g1*0.5')} AS g1, {r6('g2*0.5')} AS g2 FROM cv")
def _p08(spark, d):
    return pr.scaled(curves(spark, d), 0.5).select("profile_id", "seq", *[R(F.col(c)).alias(c) for c in ("begin_el", "g1", "g2")])


_CV2 = "c2 AS (SELECT profile_id, b+100 AS b, e+100 AS e, el, g1, g2 FROM cv)"
_EVA = "{0}.el+{0}.g1*({1}-{0}.b)+({1}-{0}.b)*({1}-{0}.b)*({0}.g2-{0}.g1)/({0}.e-{0}.b)/2"
_SLA = "{0}.g1+({0}.g2-{0}.g1)/({0}.e-{0}.b)*({1}-{0}.b)"


def _sum2(f):
    return f"CASE WHEN cv.b IS NULL AND c2.b IS NULL THEN NULL ELSE coalesce({f.format('cv', '%s')},0)+0.5::DOUBLE*coalesce({f.format('c2', '%s')},0) END"


def joint_tasks(spark, d) -> int:
    """Tasks for the joints of the curves and of the moved ones: four an order at the most."""
    return tasks_for(4 * x.table(spark, d, "orders").count())


@add("p09_add", f"""WITH {_CV}, {_CV2}, j AS (SELECT DISTINCT profile_id, s FROM (SELECT profile_id, unnest([b,e]) AS s FROM cv UNION ALL SELECT profile_id, unnest([b,e]) FROM c2)),
pt AS (SELECT * FROM (SELECT profile_id, s, lead(s) OVER (PARTITION BY profile_id ORDER BY s) AS t FROM j) WHERE t IS NOT NULL)
SELECT pt.profile_id, s AS begin_sta, t AS end_sta, {r6(_sum2(_EVA).replace('%s', 's'))} AS begin_el, {r6(_sum2(_SLA).replace('%s', 's'))} AS g1, {r6(_sum2(_SLA).replace('%s', 't'))} AS g2, cv.b IS NULL AND c2.b IS NULL AS is_gap
FROM pt LEFT JOIN cv ON cv.profile_id=pt.profile_id AND (s+t)/2>=cv.b AND (s+t)/2<cv.e LEFT JOIN c2 ON c2.profile_id=pt.profile_id AND (s+t)/2>=c2.b AND (s+t)/2<c2.e""")
def _p09(spark, d):
    c = curves(spark, d)
    moved = c.withColumns({"begin_sta": F.col("begin_sta") + 100, "end_sta": F.col("end_sta") + 100})
    s = pr.added(c, moved, 0.5, joint_tasks(spark, d))
    return s.select("profile_id", "begin_sta", "end_sta", *[R(F.col(k)).alias(k) for k in ("begin_el", "g1", "g2")], "is_gap")


@add("p12_to_vpi", f"WITH {_VP} SELECT profile_id, station, {r6('elevation')} AS elevation FROM vp WHERE profile_id IN (SELECT profile_id FROM vp GROUP BY 1 HAVING count(*)>1)")
def _p12(spark, d):
    v_ = pr.to_vpis(pr.polyline(vpis(spark, d).select("profile_id", "station", "elevation")))
    return v_.select("profile_id", "station", R(F.col("elevation")).alias("elevation"))


@add("p14_ray", f"""WITH {_CV}, ry AS (SELECT profile_id, min(b) AS s0, min_by(el, b)+100 AS e0, 3.0::DOUBLE AS m FROM cv GROUP BY 1),
q AS (SELECT cv.profile_id, s0, e0, m, b, e, (g2-g1)/(e-b)/2 AS qa, g1-m AS qb, el-(e0+m*(b-s0)) AS qc FROM cv JOIN ry USING (profile_id)),
h AS (SELECT *, CASE WHEN abs(qa)<1e-15 THEN CASE WHEN qb<>0 THEN [-qc/qb] ELSE []::DOUBLE[] END WHEN qb*qb-4*qa*qc>=0 THEN list_distinct([(-qb-sqrt(qb*qb-4*qa*qc))/(2*qa), (-qb+sqrt(qb*qb-4*qa*qc))/(2*qa)]) ELSE []::DOUBLE[] END AS ds FROM q),
z AS (SELECT profile_id, s0, e0, m, b+d AS sta FROM (SELECT *, unnest(ds) AS d FROM h) WHERE d>=0 AND d<e-b AND b+d>=s0)
SELECT profile_id, {r6('sta')} AS sta, {r6('e0+m*(sta-s0)')} AS el FROM z""")
def _p14(spark, d):
    c = curves(spark, d)
    rays = c.groupBy("profile_id").agg(F.min("begin_sta").alias("s0"), (F.min_by("begin_el", "begin_sta") + 100).alias("e0"))
    h = pr.ray_hits(rays.select("profile_id", F.lit(1).alias("ray_id"), "s0", "e0", F.lit(3.0).alias("m"), F.lit(1).alias("advance")), c)
    return h.select("profile_id", R(F.col("sta")).alias("sta"), R(F.col("el")).alias("el"))


@add("p15_two_slopes", f"SELECT c_custkey AS k, CASE WHEN c_custkey%5 <> c_custkey%3 THEN {r6('(7.0::DOUBLE-1+(c_custkey%5)*2.0::DOUBLE-(c_custkey%3)*9.0::DOUBLE)/((c_custkey%5)-(c_custkey%3))')} END AS x FROM customer")
def _p15(spark, d):
    k = F.col("c_custkey")
    return x.table(spark, d, "customer").select(k.alias("k"), R(pr.two_slopes_x(F.lit(2.0), F.lit(1.0), (k % 5).cast("double"), F.lit(9.0), F.lit(7.0), (k % 3).cast("double"))).alias("x"))


@add("p10_nullable_sums", f"SELECT c_custkey AS k, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a,0)+coalesce(b,0) END AS total, {r6('CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a*b/(a+b) END')} AS harmonic FROM (SELECT c_custkey, CASE WHEN c_custkey%3>0 THEN CAST(c_custkey%7+1 AS DOUBLE) END AS a, CASE WHEN c_custkey%4>1 THEN CAST(c_custkey%5+1 AS DOUBLE) END AS b FROM customer)")
def _p10(spark, d):
    k = F.col("c_custkey")
    p, q = F.when(k % 3 > 0, (k % 7 + 1).cast("double")), F.when(k % 4 > 1, (k % 5 + 1).cast("double"))
    return x.table(spark, d, "customer").select(k.alias("k"), a.nullable_sum(p, q).alias("total"), R(a.reciprocal_sum(p, q)).alias("harmonic"))


@add("u01_union_stations", f"WITH {_CV}, {_CV2} SELECT DISTINCT profile_id, s AS station FROM (SELECT profile_id, unnest([b,e]) AS s FROM cv UNION ALL SELECT profile_id, unnest([b,e]) FROM c2)")
def _u01(spark, d):
    c = curves(spark, d)
    moved = c.select("profile_id", (F.col("begin_sta") + 100).alias("begin_sta"), (F.col("end_sta") + 100).alias("end_sta"))
    both = c.select("profile_id", "begin_sta", "end_sta").union(moved)
    # dealt by profile before the stations are told apart
    return both.repartition(joint_tasks(spark, d), "profile_id").select("profile_id", F.explode(F.array("begin_sta", "end_sta")).alias("station")).distinct()


# --- surface and alignment ---------------------------------------------------------------------------------------

_PL = "pl AS (SELECT align_id, CAST(seq AS BIGINT) AS seq, px, py FROM (VALUES (1,0,1.5,2.25),(1,1,30.5,20.75),(1,2,58.25,51.5),(2,0,3.25,57.5),(2,1,50.75,5.125)) t(align_id, seq, px, py))"
_PL = _PL.replace("px, py FROM", "px::DOUBLE AS px, py::DOUBLE AS py FROM")
_PG = "pg AS (SELECT * FROM (SELECT align_id, seq, px AS x0, py AS y0, lead(px) OVER w AS x1, lead(py) OVER w AS y1 FROM pl WINDOW w AS (PARTITION BY align_id ORDER BY seq)) WHERE x1 IS NOT NULL), pk AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM pg), ps AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY align_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS s0 FROM pk)"


def route(spark):
    rows = [(1, 0, 1.5, 2.25), (1, 1, 30.5, 20.75), (1, 2, 58.25, 51.5), (2, 0, 3.25, 57.5), (2, 1, 50.75, 5.125)]
    return al.lines_from_points(spark.createDataFrame(rows, "align_id int, seq long, x double, y double"))


@add("p16_cut", f"""WITH {x.SURF}, {x.EDGES}, {_PL}, {_PG}, ed AS (SELECT a.x AS xa, a.y AS ya, a.z AS za, b.x AS xb, b.y AS yb, b.z AS zb FROM e JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb),
m AS (SELECT align_id, s0, len, za, zb, (x1-x0)*(yb-ya)-(y1-y0)*(xb-xa) AS det, (xa-x0)*(yb-ya)-(ya-y0)*(xb-xa) AS tn, (xa-x0)*(y1-y0)-(ya-y0)*(x1-x0) AS un FROM ps, ed),
h AS (SELECT align_id, s0+tn/det*len AS station, za+un/det*(zb-za) AS elevation FROM m WHERE det<>0 AND tn/det BETWEEN 0 AND 1 AND un/det BETWEEN 0 AND 1),
b AS (SELECT align_id, floor(station*10000+1e-6) AS k, min(station) AS station, arg_min(elevation, station) AS elevation FROM h GROUP BY 1,2) SELECT align_id, {r6('station')} AS station, {r6('elevation')} AS elevation FROM b""")
def _p16(spark, d):
    p, tv = x.lattice(spark, d)
    c = pr.cut(tv, p, route(spark), 8.0)
    return c.select("align_id", R(F.col("station")).alias("station"), R(F.col("elevation")).alias("elevation"))


@add("p17_cut_increment", f"""WITH {x.SURF}, {_PL}, {_PG}, rg AS (SELECT align_id, max(s0+len) AS e FROM ps GROUP BY 1), st AS (SELECT align_id, k AS sid, least(5.0::DOUBLE*k, e) AS sta, e FROM rg, LATERAL (SELECT unnest(range(CAST(ceil(e/5-1e-9) AS BIGINT)+1)) AS k)),
q AS (SELECT st.align_id, sid, sta, x0+(sta-s0)*(x1-x0)/len AS px, y0+(sta-s0)*(y1-y0)/len AS py FROM st JOIN ps ON ps.align_id=st.align_id AND sta>=s0 AND (sta<s0+len OR (sta=e AND s0+len=e))), qp AS (SELECT align_id*1000+sid AS qid, q.* FROM q), {x.LOC}
SELECT align_id, sid, {r6('sta')} AS sta, {r6('z1-(nx*(px-x1)+ny*(py-y1))/nz')} AS elevation FROM qp LEFT JOIN loc USING (qid) LEFT JOIN tv USING (tri_id)""")
def _p17(spark, d):
    _, tv = x.lattice(spark, d)
    g = route(spark)
    xy = al.station_to_xy(al.stations_at(g, 5.0).withColumn("offset", F.lit(0.0)), g)
    return pr.cut_at(tv, xy).select("align_id", "sid", R(F.col("sta")).alias("sta"), R(F.col("elevation")).alias("elevation"))


# --- fits --------------------------------------------------------------------------------------------------------


def _fit_data(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select((F.col("l_extendedprice").cast("double") / 10000).alias("x"), F.col("l_quantity").cast("double").alias("y"))


_FD = "fd AS (SELECT l_extendedprice::DOUBLE/10000 AS x, l_quantity::DOUBLE AS y FROM lineitem), fl AS (SELECT *, coalesce(lag(x) OVER (ORDER BY x, y),0) AS xp, lag(y) OVER (ORDER BY x, y) AS yp FROM fd)"
_FE = "sum((x-xp)*(a*x+b*x*x-y+CASE WHEN yp IS NULL THEN 0 ELSE a*xp+b*xp*xp-yp END)/2)/sum(x-xp)"


@add("g13_fit_error", f"WITH {_FD}, c AS (SELECT i*0.25::DOUBLE AS a, j*0.5::DOUBLE AS b FROM range(5) r(i), range(5) q(j)) SELECT a, b, {r6(_FE)} AS error FROM fl, c GROUP BY a, b")
def _g13(spark, d):
    model = lambda x_, p, q: p * x_ + q * x_ * x_
    e = stats.fit_errors(_fit_data(spark, d), stats.fit_grid(spark, (0.0, 1.0), (0.0, 2.0), 5), model)
    return e.select("a", "b", R(F.col("error")).alias("error"))


@add("g14_fit_level", f"WITH {_FD}, c AS (SELECT i*0.125::DOUBLE AS a, j*0.125::DOUBLE AS b FROM range(9) r(i), range(9) q(j)), e AS (SELECT a, b, {_FE} AS error FROM fl, c GROUP BY a, b) SELECT a, b, {r6('error')} AS error FROM e ORDER BY abs(error), a, b LIMIT 1")
def _g14(spark, d):
    model = lambda x_, p, q: p * x_ + q * x_ * x_
    return stats.fit_best(stats.fit_errors(_fit_data(spark, d), stats.fit_grid(spark, (0.0, 1.0), (0.0, 1.0), 9), model)).select("a", "b", R(F.col("error")).alias("error"))


# --- rays, arcs by centre, pieces, editing, text sinks ---------------------------------------------------------------


@add("x_ray_line", f"""WITH q AS (SELECT c_custkey AS k, CAST(c_custkey*37%640 AS DOUBLE)/10-32 AS px, CAST(c_custkey*91%640 AS DOUBLE)/10-32 AS py, radians(CAST(c_custkey*13%360 AS DOUBLE)) AS az,
 CASE WHEN c_custkey%11<>0 THEN CAST(c_custkey%7-3 AS DOUBLE)/4 END AS m, CASE WHEN c_custkey%2=0 THEN 1 ELSE -1 END AS adv FROM customer)
 SELECT k, {r6('(px-1)*cos(az)-(py-2)*sin(az)')} AS off, m*adv AS m, 5-m*adv AS b, CASE WHEN sign(px-1)=sign(m) THEN {r6('5+(px-1)*m')} END AS el FROM q""")
def _x_ray(spark, d):
    key = F.col("c_custkey")
    q = x.table(spark, d, "customer").select(key.alias("k"), ((key * 37 % 640).cast("double") / 10 - 32).alias("px"), ((key * 91 % 640).cast("double") / 10 - 32).alias("py"), (key * 13 % 360).cast("double").alias("az"), F.when(key % 11 != 0, (key % 7 - 3).cast("double") / 4).alias("m"), F.when(key % 2 == 0, 1).otherwise(-1).alias("adv"))
    one, two, five = (F.lit(float(n)) for n in (1, 2, 5))
    line = v.ray_line(one, five, F.col("m"), F.col("adv"))
    return q.select("k", R(v.ray_offset(F.col("px"), F.col("py"), one, two, F.col("az"))).alias("off"), line["m"].alias("m"), line["b"].alias("b"), R(v.ray_elevation(F.col("px"), one, five, F.col("m"))).alias("el"))


@add("f03_box3", f"WITH {x.CLOUD} SELECT seq, x BETWEEN -5 AND 5 AND y BETWEEN -4 AND 6 AND z BETWEEN 0 AND 9 AS inside FROM cloud")
def _f03(spark, d):
    return x.cloud(spark, d).select("seq", v.in_box3(F.col("x"), F.col("y"), F.col("z"), (-5, -4, 5, 6, 0, 9)).alias("inside"))


@add("a06_arc_centre", f"""WITH {_CH}, q AS (SELECT *, seq%2=1 AS outside FROM sg WHERE kind='arc')
 SELECT align_id, seq, {r6('rad')} AS radius, {r6('CASE WHEN outside THEN turn-360*dir ELSE turn END')} AS turn, {r6('CASE WHEN outside THEN rad*radians(360-abs(turn)) ELSE len END')} AS length,
 {r6('sin(radians(az0))*CASE WHEN outside THEN -1 ELSE 1 END')} AS sin_az0 FROM q""")
def _a06(spark, d):
    arcs = segments(spark, d).where("kind = 'arc'")
    at = al.arc_from_centre(*[F.col(c) for c in ("x0", "y0", "cx", "cy", "x1", "y1")], -F.col("dir"), F.col("seq") % 2 == 1)
    return arcs.select("align_id", "seq", *[R(at[c]).alias(c) for c in ("radius", "turn", "length")], R(F.sin(F.radians(at["az0"]))).alias("sin_az0"))


@add("a12_spiral_anchor", f"WITH {_CH} SELECT align_id, seq, CASE WHEN kind='spiral' AND abs(d_in)<5e-5 THEN s0 WHEN kind='spiral' AND abs(d_in-turn*200/len)<5e-5 THEN s1 END AS anchor FROM sg")
def _a12(spark, d):
    return segments(spark, d).select("align_id", "seq", al.spiral_anchor().alias("anchor"))


@add("a20_spiral_station", f"WITH {_CH}, {_ST}, {_PT} SELECT align_id, sid AS pid, seq, {r6('s0_+l')} AS sta, {r6('off')} AS off FROM (SELECT pt.*, sg.s0 AS s0_ FROM pt JOIN sg USING (align_id, seq)) WHERE kind='spiral'")
def _a20(spark, d):
    seg = segments(spark, d)
    xy = al.station_to_xy(stations(spark, d), seg).select("align_id", F.col("sid").alias("pid"), F.col("seq").alias("own"), F.col("x").alias("px"), F.col("y").alias("py"))
    hit = al.spiral_to_station(xy, seg).join(xy.select("align_id", "pid", "own"), ["align_id", "pid"]).where("seq = own")
    return hit.select("align_id", "pid", "seq", R(F.col("sta")).alias("sta"), R(F.col("off")).alias("off"))


@add("g12_alignments_box", f"""WITH {_CH}, c AS (SELECT *, x0+rad*dir*cos(radians(az0)) AS cx, y0-rad*dir*sin(radians(az0)) AS cy, az0-90*dir AS a0 FROM sg),
 p AS (SELECT x0 AS x, y0 AS y FROM sg UNION ALL SELECT x1, y1 FROM sg UNION ALL SELECT cx+rad*sin(radians(k*90)), cy+rad*cos(radians(k*90)) FROM c, range(4) t(k)
 WHERE kind='arc' AND (k*90-a0)*dir - floor((k*90-a0)*dir/360)*360 <= abs(turn)) SELECT {r6('min(x)')} AS xmin, {r6('min(y)')} AS ymin, {r6('max(x)')} AS xmax, {r6('max(y)')} AS ymax FROM p""")
def _g12(spark, d):
    return al.alignments_box(segments(spark, d)).select(*[R(F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_BS = """bp AS (SELECT CAST(c_nationkey AS BIGINT) AS align_id, CAST(c_custkey AS BIGINT) AS seq, c_custkey*2.0::DOUBLE+(c_custkey%3)/2.0::DOUBLE AS x0, CAST(c_custkey*91%640 AS DOUBLE)/4 AS y0, CAST(c_custkey%5-2 AS DOUBLE)/4 AS b FROM customer),
 bs AS (SELECT * FROM (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM bp WINDOW w AS (PARTITION BY align_id ORDER BY seq)) WHERE x1 IS NOT NULL),
 bc AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS ch, 4*atan(abs(b)) AS sw FROM bs),
 bt AS (SELECT *, CASE WHEN b=0 THEN ch ELSE ch/(2*sin(sw/2))*sw END AS len, -sign(b)*degrees(sw) AS turn, CASE WHEN b<>0 THEN ch/(2*sin(sw/2)) END AS rad FROM bc),
 bo AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY align_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS s0, row_number() OVER (PARTITION BY align_id ORDER BY seq)-1 AS place FROM bt)"""


def sides(spark, d):
    """A polyline per nation through its customers, with bulges."""
    key = F.col("c_custkey")
    p = x.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("align_id"), key.cast("long").alias("seq"), (key * 2.0 + (key % 3) / 2.0).alias("x0"), ((key * 91 % 640).cast("double") / 4).alias("y0"), ((key % 5 - 2).cast("double") / 4).alias("bulge"))
    w = Window.partitionBy("align_id").orderBy("seq")
    return p.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w)}).where("x1 is not null")


@add("s18_bulge_segments", f"WITH {_BS} SELECT align_id, seq, CASE WHEN b=0 THEN 'line' ELSE 'arc' END AS kind, {r6('turn')} AS turn, {r6('len')} AS length, {r6('s0')} AS begin_sta, {r6('rad')} AS radius FROM bo")
def _s18(spark, d):
    return al.from_bulges(sides(spark, d)).select("align_id", "seq", "kind", *[R(F.col(c)).alias(c) for c in ("turn", "length", "begin_sta", "radius")])


@add("s20_piece_segments", f"WITH {_BS} SELECT align_id, place AS seq, CASE WHEN b=0 THEN 'line' ELSE 'arc' END AS kind, {r6('turn')} AS turn, {r6('len')} AS length, {r6('s0')} AS begin_sta, {r6('rad')} AS radius FROM bo")
def _s20(spark, d):
    p = al.from_bulges(sides(spark, d)).select("align_id", F.col("seq").alias("pid"), "x0", "y0", "x1", "y1", "cx", "cy", F.col("dir").alias("d"), F.lit(False).alias("outside"))
    return al.from_pieces(p).select("align_id", "seq", "kind", *[R(F.col(c)).alias(c) for c in ("turn", "length", "begin_sta", "radius")])


_MORE = """sp AS (SELECT profile_id, min(station) AS lo, max(station) AS hi, min(elevation) AS el FROM vp0 GROUP BY 1),
 nv AS (SELECT profile_id, station, elevation FROM vp0 UNION ALL SELECT profile_id, lo-10, el+1 FROM sp UNION ALL SELECT profile_id, lo+0.5, el+2 FROM sp UNION ALL SELECT profile_id, hi+10, el+3 FROM sp)"""


@add("p11_with_points", f"""WITH {_VP}, {_MORE}, n AS (SELECT profile_id, station, elevation, (lead(elevation) OVER w-elevation)/(lead(station) OVER w-station) AS g, row_number() OVER w AS seq FROM nv WINDOW w AS (PARTITION BY profile_id ORDER BY station))
 SELECT profile_id, CAST(seq AS INT) AS seq, station AS begin_sta, elevation AS begin_el, {r6('g')} AS g1 FROM n WHERE g IS NOT NULL""")
def _p11(spark, d):
    own = vpis(spark, d).select("profile_id", "station", "elevation", F.lit(0.0).alias("vc_length"))
    per = own.groupBy("profile_id").agg(F.min("station").alias("lo"), F.max("station").alias("hi"), F.min("elevation").alias("el"))
    at = [F.struct((F.col(c) + s).alias("station"), (F.col("el") + e).alias("elevation")) for c, s, e in (("lo", -10.0, 1), ("lo", 0.5, 2), ("hi", 10.0, 3))]
    more = per.select("profile_id", F.explode(F.array(*at)).alias("p")).select("profile_id", "p.*")
    return pr.curves(pr.with_points(own, more)).select("profile_id", "seq", "begin_sta", "begin_el", R(F.col("g1")).alias("g1"))


@add("p13_with_segments", f"""WITH {_CV}, z AS (SELECT profile_id, max(e) AS e FROM cv GROUP BY 1), u AS (SELECT profile_id, b, e, el, g1, false AS is_gap FROM cv UNION ALL SELECT profile_id, e, e+10, NULL, NULL, true FROM z UNION ALL SELECT profile_id, e+10, e+30, 100, 0.25, false FROM z)
 SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY b) AS INT) AS seq, b AS begin_sta, e AS end_sta, {r6('el')} AS begin_el, {r6('g1')} AS g1, is_gap FROM u""")
def _p13(spark, d):
    own = curves(spark, d)
    end = own.groupBy("profile_id").agg(F.max("end_sta").alias("e"))
    piece = lambda a, b, gap: F.struct((F.col("e") + a).alias("begin_sta"), (F.col("e") + b).alias("end_sta"), F.lit(100.0).alias("begin_el"), F.lit(0.25).alias("g1"), F.lit(0.5).alias("g2"), F.lit(gap).alias("is_gap"))
    more = end.select("profile_id", F.explode(F.array(piece(0, 10, True), piece(10, 30, False))).alias("p")).select("profile_id", "p.*")
    return pr.with_segments(own, more).select("profile_id", "seq", "begin_sta", "end_sta", R(F.col("begin_el")).alias("begin_el"), R(F.col("g1")).alias("g1"), "is_gap")


def _plain(e: str) -> str:
    return f"rtrim(rtrim(printf('%.6f', {e}), '0'), '.')"


@add("k09_station_points", f"WITH {_CH}, {_ST}, {_PT} SELECT align_id, sid, {_plain('x')}||','||{_plain('y')} AS value FROM xy")
def _k09(spark, d):
    return sinks.station_points(al.station_to_xy(stations(spark, d), segments(spark, d)))


@add("k10_profile_lines", f"""WITH {_CV}, c AS (SELECT *, CAST(floor(b*100+0.5) AS BIGINT) AS c FROM cv)
 SELECT profile_id, CAST(seq AS INT) AS seq, {_plain('b')}||','||{_plain(r6('el'))}||','||{_plain(r6('e-b'))} AS value, CAST(c//10000 AS VARCHAR)||'+'||printf('%05.2f', (c%10000)/100.0::DOUBLE)||','||{_plain(r6('el'))}||','||{_plain(r6('e-b'))} AS text FROM c""")
def _k10(spark, d):
    c = curves(spark, d)
    return sinks.profile_lines(c, True).join(sinks.profile_lines(c).withColumnRenamed("value", "text"), ["profile_id", "seq"])


@add("k14_probability_lines", """WITH b AS (SELECT min(CAST(l_extendedprice AS DOUBLE)) AS lo, (max(CAST(l_extendedprice AS DOUBLE))+0.00001::DOUBLE-min(CAST(l_extendedprice AS DOUBLE)))/19 AS w FROM lineitem),
 n AS (SELECT CAST(floor((CAST(l_extendedprice AS DOUBLE)-lo)/w) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
 SELECT r.bin, printf('%.4f', lo+w*(r.bin+1))||','||coalesce(n, 0) AS value FROM range(20) r(bin), b LEFT JOIN n ON n.bin=r.bin""")
def _k14(spark, d):
    price = x.table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("v"))
    return sinks.probability_lines(stats.probability_bins(price, "v", 20))


@add("t08_input_outcomes", """WITH q AS (SELECT n_nationkey AS g, i, CASE WHEN n_nationkey%5=0 AND i=1 THEN NULL ELSE CAST(i AS DOUBLE) END AS x, CAST(CASE WHEN n_nationkey%5=1 THEN 3*i ELSE i*i END AS DOUBLE) AS y FROM nation, range(5) t(i) WHERE n_nationkey%5<>2 OR i<2)
 SELECT g, CASE WHEN count(*)>count(x) THEN 'null_coordinate' WHEN count(*)<3 THEN 'too_few' WHEN min((y-3*x)=0) THEN 'collinear' ELSE 'ok' END AS outcome FROM q GROUP BY g""")
def _t08(spark, d):
    g = x.table(spark, d, "nation").select(F.col("n_nationkey").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    k = F.col("g") % 5  # nations of one kind each: a NULL, all on a line, two points only, fine
    p = g.where((k != 2) | (F.col("i") < 2)).select("g", F.when((k != 0) | (F.col("i") != 1), F.col("i").cast("double")).alias("x"), F.when(k == 1, F.col("i") * 3).otherwise(F.col("i") * F.col("i")).cast("double").alias("y"))
    return hull.input_outcomes(p, "g")


@add("q15_tolerance", "SELECT k, c AS \"column\" FROM (SELECT c_custkey AS k, CASE WHEN c_custkey%4>1 THEN 'el' END AS e, CASE WHEN c_custkey%3=0 THEN 'slope' END AS s FROM customer) UNPIVOT (c FOR n IN (e, s))")
def _q15(spark, d):
    key = F.col("c_custkey")
    c = x.table(spark, d, "customer").select(key.alias("k"), (key * 0.5).alias("el"), F.when(key % 3 != 0, key * 0.25).alias("slope"))
    return stats.tolerance_misses(c, c.select("k", (F.col("el") + F.col("k") % 4 * 0.1).alias("el"), (F.col("k") * 0.25).alias("slope")), "k", ["el", "slope"])


#: A line and an arc per region over the lattice; direction and azimuth follow the region.
_RT = """rt AS (SELECT CAST(r_regionkey AS BIGINT) AS align_id, r_regionkey*6.3::DOUBLE+5.1 AS x0, 4.7::DOUBLE AS y0, radians(r_regionkey*9.0::DOUBLE+11) AS az, CASE WHEN r_regionkey%2=0 THEN 1 ELSE -1 END AS dir, 18000/(pi()*250) AS rad FROM region),
 ru AS (SELECT *, x0+12.5*sin(az) AS x1, y0+12.5*cos(az) AS y1 FROM rt), rc AS (SELECT *, x1+dir*rad*cos(az) AS cx, y1-dir*rad*sin(az) AS cy FROM ru)"""


def curved_route(spark, d):
    r = x.table(spark, d, "region")
    heads = r.select(F.col("r_regionkey").cast("long").alias("align_id"), (F.col("r_regionkey") * 6.3 + 5.1).alias("x"), F.lit(4.7).alias("y"), F.lit(0.0).alias("station"), (F.col("r_regionkey") * 9.0 + 11).alias("azimuth_deg"))
    deg = F.when(F.col("r_regionkey") % 2 == 0, 250.0).otherwise(-250.0)
    part = lambda k, g, n: F.struct(F.lit(k).alias("seq"), g.alias("degree_in"), F.lit(n).alias("length"), g.alias("degree_out"))
    e = r.select(F.col("r_regionkey").cast("long").alias("align_id"), F.explode(F.array(part(0, F.lit(0.0), 12.5), part(1, deg, 30.0))).alias("e")).select("align_id", "e.*")
    return al.chain(e, heads)


@add("p16_cut_arcs", f"""WITH {x.SURF}, {x.EDGES}, {_RT}, ed AS (SELECT a.x AS xa, a.y AS ya, a.z AS za, b.x-a.x AS ex, b.y-a.y AS ey, b.z-a.z AS ez FROM e JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb),
 ml AS (SELECT align_id, za, ez, (x1-x0)*ey-(y1-y0)*ex AS det, (xa-x0)*ey-(ya-y0)*ex AS tn, (xa-x0)*(y1-y0)-(ya-y0)*(x1-x0) AS un FROM rc, ed),
 ma AS (SELECT *, ex*ex+ey*ey AS qa, ex*(xa-cx)+ey*(ya-cy) AS qb, (xa-cx)*(xa-cx)+(ya-cy)*(ya-cy)-rad*rad AS qc FROM rc, ed),
 mu AS (SELECT *, (-qb+s*sqrt(qb*qb-qa*qc))/qa AS u FROM (SELECT * FROM ma WHERE qb*qb-qa*qc>=0), (VALUES (1),(-1)) t(s)),
 mw AS (SELECT *, (degrees(atan2(xa+u*ex-cx, ya+u*ey-cy))-degrees(az)+90*dir)*dir AS w FROM mu WHERE u BETWEEN 0 AND 1),
 h AS (SELECT align_id, tn/det*12.5 AS station, za+un/det*ez AS elevation FROM ml WHERE det<>0 AND tn/det BETWEEN 0 AND 1 AND un/det BETWEEN 0 AND 1
 UNION ALL SELECT align_id, 12.5+30*(w-floor(w/360)*360)/75, za+u*ez FROM mw WHERE w-floor(w/360)*360<=75),
 b AS (SELECT align_id, floor(station*10000+1e-6) AS k, min(station) AS station, arg_min(elevation, station) AS elevation FROM h GROUP BY 1,2) SELECT align_id, {r6('station')} AS station, {r6('elevation')} AS elevation FROM b""")
def _p16_arcs(spark, d):
    p, tv = x.lattice(spark, d)
    c = pr.cut(tv, p, curved_route(spark, d), 8.0)
    return c.select("align_id", R(F.col("station")).alias("station"), R(F.col("elevation")).alias("elevation"))


def spiral_route(spark, d):
    """A spiral into an arc and one out of it, in each region."""
    r = x.table(spark, d, "region")
    heads = r.select(F.col("r_regionkey").cast("long").alias("align_id"), (F.col("r_regionkey") * 9.3 + 2.1).alias("x"), F.lit(3.7).alias("y"), F.lit(0.0).alias("station"), (F.col("r_regionkey") * 8.0 + 7).alias("azimuth_deg"))
    deg = F.when(F.col("r_regionkey") % 2 == 0, 200.0).otherwise(-200.0)
    part = lambda k, g, n, o: F.struct(F.lit(k).alias("seq"), g.alias("degree_in"), F.lit(n).alias("length"), o.alias("degree_out"))
    e = r.select(F.col("r_regionkey").cast("long").alias("align_id"), F.explode(F.array(part(0, F.lit(0.0), 40.0, deg), part(1, deg, 24.0, F.lit(0.0)))).alias("e")).select("align_id", "e.*")
    return al.chain(e, heads)


def _spiral_at(l: str) -> str:
    """x and y at l of the first spiral (40 long) or, from 40 on, of the second (24 long), seen from its own flat end."""
    th = lambda v, n, t: f"(radians({t}*dir)*({v})*({v})/{n * n}.0)"
    sx = lambda v, t: f"(({v})*(1-{t}**2/10+{t}**4/216-{t}**6/9360+{t}**8/685440))"
    sy = lambda v, t: f"(({v})*{t}*(1/3.0-{t}**2/42+{t}**4/1320-{t}**6/75600+{t}**8/6894720))"
    one, two = (l, th(l, 40, 40)), (f"(64-{l})", th(f"(64-{l})", 24, 24))
    x1, y1, x2, y2 = sx(*one), sy(*one), sx(*two), sy(*two)
    return f"CASE WHEN {l}<40 THEN x0+{x1}*sin(az)+{y1}*cos(az) ELSE x2-{x2}*sin(az2)+{y2}*cos(az2) END AS x, CASE WHEN {l}<40 THEN y0+{x1}*cos(az)-{y1}*sin(az) ELSE y2-{x2}*cos(az2)-{y2}*sin(az2) END AS y"


_NEXT = "SELECT align_id, k, za, ez, xa, ya, ex, ey, x0, y0, az, dir, x2, y2, az2, CASE WHEN f*fa<=0 THEN a ELSE m END AS a, CASE WHEN f*fa<=0 THEN fa ELSE f END AS fa, CASE WHEN f*fa<=0 THEN m ELSE b END AS b, CASE WHEN f*fa<=0 THEN f ELSE fb END AS fb"
_ZERO = "(SELECT *, CASE WHEN fb=fa THEN a ELSE (a*fb-b*fa)/(fb-fa) END AS m FROM {})"


def _refined(n: int) -> str:
    """n steps of false position, each a table."""
    out = []
    for i in range(n):
        out.append(f"z{i + 1} AS ({_NEXT} FROM (SELECT *, (x-xa)*ey-(y-ya)*ex AS f FROM (SELECT *, {_spiral_at('m')} FROM {_ZERO.format(f'z{i}')})))")
    return ", ".join(out)


@add("p16_cut_spirals", f"""WITH {x.SURF}, {x.EDGES}, ed AS (SELECT a.x AS xa, a.y AS ya, a.z AS za, b.x-a.x AS ex, b.y-a.y AS ey, b.z-a.z AS ez FROM e JOIN lp a ON a.point_id=pa JOIN lp b ON b.point_id=pb),
 sa AS (SELECT CAST(r_regionkey AS BIGINT) AS align_id, r_regionkey*9.3::DOUBLE+2.1 AS x0, 3.7::DOUBLE AS y0, radians(r_regionkey*8.0::DOUBLE+7) AS az, CASE WHEN r_regionkey%2=0 THEN 1 ELSE -1 END AS dir, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y2, 0.0::DOUBLE AS az2 FROM region),
 sb AS (SELECT align_id, x0, y0, az, dir, x AS xm, y AS ym, az+radians(40*dir) AS azm, az+radians(64*dir) AS az2 FROM (SELECT *, {_spiral_at('39.999999999999')} FROM sa)),
 sc AS (SELECT align_id, x0, y0, az, dir, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y2, az2, xm, ym FROM sb),
 so AS (SELECT * FROM (SELECT *, {_spiral_at('40.0')} FROM sc)),
 sp AS (SELECT align_id, x0, y0, az, dir, xm-x AS x2, ym-y AS y2, az2 FROM so),
 pp AS (SELECT *, k*0.05::DOUBLE AS l FROM sp, range(1281) r(k)), pt2 AS (SELECT *, {_spiral_at('l')} FROM pp),
 bx AS (SELECT *, lead(l) OVER w AS lb, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM pt2 WINDOW w AS (PARTITION BY align_id ORDER BY k)),
 z0 AS (SELECT * FROM (SELECT bx.align_id, bx.k, za, ez, xa, ya, ex, ey, x0, y0, az, dir, x2, y2, az2, l AS a, (x-xa)*ey-(y-ya)*ex AS fa, lb AS b, (xb-xa)*ey-(yb-ya)*ex AS fb FROM bx, ed
   WHERE lb IS NOT NULL AND abs(x-xa-ex/2) <= abs(ex)/2+1 AND abs(y-ya-ey/2) <= abs(ey)/2+1) WHERE fa*fb<=0),
 {_refined(4)}, h AS (SELECT align_id, m AS station, ((x-xa)*ex+(y-ya)*ey)/(ex*ex+ey*ey) AS u, za, ez FROM (SELECT *, {_spiral_at('m')} FROM {_ZERO.format('z4')})),
 b AS (SELECT align_id, floor(station*10000+1e-6) AS k, min(station) AS station, arg_min(za+u*ez, station) AS elevation FROM h WHERE u BETWEEN 0 AND 1 GROUP BY 1,2) SELECT align_id, {r6('station')} AS station, {r6('elevation')} AS elevation FROM b""")
def _p16_spirals(spark, d):
    p, tv = x.lattice(spark, d)
    c = pr.cut(tv, p, spiral_route(spark, d), 8.0)
    return c.select("align_id", R(F.col("station")).alias("station"), R(F.col("elevation")).alias("elevation"))
