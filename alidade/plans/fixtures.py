"""Geometry derived from the star-schema tables, with values that are exact in binary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.operators import surface as s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lattice_points(spark: SparkSession, d: str, m: int = 16) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % m).alias("i"), (F.col("l_orderkey") % m).alias("j"), "l_quantity")
    g = li.groupBy("i", "j").agg(F.sum("l_quantity").alias("q"))
    return g.select((F.col("i") * m + F.col("j")).alias("point_id"), (F.col("i") * 4).cast("double").alias("x"), (F.col("j") * 4).cast("double").alias("y"), ((F.col("q") % 97) / 4).alias("z"))


def lattice_triangles(spark: SparkSession, m: int = 16, step: int = 1) -> DataFrame:
    n = (m - 1) // step
    c = spark.range(n * n).select((F.floor(F.col("id") / n) * step).alias("i"), (F.col("id") % n * step).alias("j"), F.col("id"))
    p = lambda di, dj: ((F.col("i") + di * step) * m + F.col("j") + dj * step).cast("long")
    t = F.array(F.struct((F.col("id") * 2).alias("tri_id"), p(0, 0).alias("p1"), p(1, 0).alias("p2"), p(1, 1).alias("p3")), F.struct((F.col("id") * 2 + 1).alias("tri_id"), p(0, 0).alias("p1"), p(1, 1).alias("p2"), p(0, 1).alias("p3")))
    return c.select(F.explode(t).alias("t")).select("t.*")


def lattice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(points, triangles with vertices)."""
    p = lattice_points(spark, d)
    return p, s.with_vertices(lattice_triangles(spark), p)


def pruned_lattice(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, tv = lattice(spark, d)
    return p, s.marked(tv, s.pruned(tv))


def query_points(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") * 37 % 6400 / 100.0 + 0.003).alias("px"), (F.col("c_custkey") * 91 % 6400 / 100.0 + 0.0017).alias("py"))


def cloud(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), *[(F.col("embedding")[k].cast("double") * 10.0).alias(a) for k, a in enumerate("xyz")], F.col("label").alias("classification"))


#: The same adapters as DuckDB common table expressions.
LP = """lp AS (SELECT CAST(16*i+j AS BIGINT) AS point_id, CAST(4*i AS DOUBLE) AS x, CAST(4*j AS DOUBLE) AS y, (q % 97)/4 AS z
 FROM (SELECT l_partkey%16 AS i, l_orderkey%16 AS j, sum(l_quantity) AS q FROM lineitem GROUP BY 1,2))"""
LT = """lt AS (SELECT 2*(15*i+j) AS tri_id, 16*i+j AS p1, 16*(i+1)+j AS p2, 16*(i+1)+j+1 AS p3 FROM range(15) a(i), range(15) b(j)
 UNION ALL SELECT 2*(15*i+j)+1, 16*i+j, 16*(i+1)+j+1, 16*i+j+1 FROM range(15) a(i), range(15) b(j))"""
TV = """tv0 AS (SELECT tri_id, p1, p2, p3, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, c.x AS x3, c.y AS y3, c.z AS z3
 FROM lt JOIN lp a ON a.point_id=p1 JOIN lp b ON b.point_id=p2 JOIN lp c ON c.point_id=p3),
tv AS (SELECT *, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) AS nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) AS ny, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) AS nz,
 least(x1,x2,x3) AS xmin, greatest(x1,x2,x3) AS xmax, least(y1,y2,y3) AS ymin, greatest(y1,y2,y3) AS ymax FROM tv0)"""
SURF = f"{LP}, {LT}, {TV}"
SIDES = """sides AS (SELECT tri_id, least(a,b) AS pa, greatest(a,b) AS pb FROM
 (SELECT tri_id, p1 AS a, p2 AS b FROM lt UNION ALL SELECT tri_id, p2, p3 FROM lt UNION ALL SELECT tri_id, p3, p1 FROM lt))"""
EDGES = f"""{SIDES}, e AS (SELECT s.pa, s.pb, s.tri_id AS tri_a, o.tri_id AS tri_b FROM sides s LEFT JOIN sides o ON s.pa=o.pa AND s.pb=o.pb AND s.tri_id<>o.tri_id
 WHERE o.tri_id IS NULL OR s.tri_id<o.tri_id)"""
DIH = """dih AS (SELECT e.*, CASE WHEN tri_b IS NOT NULL THEN CASE WHEN cs > 1 OR cs < -1 THEN 0 ELSE acos(cs) END END AS dihedral FROM (SELECT e.*,
 (a.nx*b.nx+a.ny*b.ny+a.nz*b.nz)/(sqrt(a.nx*a.nx+a.ny*a.ny+a.nz*a.nz)*sqrt(b.nx*b.nx+b.ny*b.ny+b.nz*b.nz)) AS cs
 FROM e JOIN tv a ON a.tri_id=tri_a LEFT JOIN tv b ON b.tri_id=tri_b) e)"""
ANG2 = """ang2 AS (SELECT tri_id,
 degrees(atan2(abs((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1)), (x2-x1)*(x3-x1)+(y2-y1)*(y3-y1))) AS a1,
 degrees(atan2(abs((x3-x2)*(y1-y2)-(y3-y2)*(x1-x2)), (x3-x2)*(x1-x2)+(y3-y2)*(y1-y2))) AS a2,
 degrees(atan2(abs((x1-x3)*(y2-y3)-(y1-y3)*(x2-x3)), (x1-x3)*(x2-x3)+(y1-y3)*(y2-y3))) AS a3 FROM tv)"""
BAD = f"""{EDGES}, {DIH}, {ANG2}, bad AS (SELECT tv.tri_id FROM tv JOIN ang2 USING (tri_id)
 LEFT JOIN (SELECT t, max(dihedral) AS fold FROM (SELECT tri_a AS t, dihedral FROM dih UNION ALL SELECT tri_b, dihedral FROM dih) GROUP BY t) f ON f.t=tv.tri_id
 WHERE atan2(sqrt(nx*nx+ny*ny), nz) > radians(79.5) OR greatest(a1,a2,a3) > 157 OR coalesce(fold,0) > 3.0)"""
GONE = f"""{BAD}, gone AS (WITH RECURSIVE r(t) AS (SELECT tri_a FROM e WHERE tri_b IS NULL AND tri_a IN (SELECT tri_id FROM bad)
 UNION SELECT CASE WHEN e.tri_a=r.t THEN e.tri_b ELSE e.tri_a END FROM r JOIN e ON e.tri_b IS NOT NULL AND (e.tri_a=r.t OR e.tri_b=r.t)
 WHERE CASE WHEN e.tri_a=r.t THEN e.tri_b ELSE e.tri_a END IN (SELECT tri_id FROM bad)) SELECT t AS tri_id FROM r)"""
VE = "ve AS (SELECT e.*, tri_a NOT IN (SELECT tri_id FROM gone) AS va, CASE WHEN tri_b IS NOT NULL THEN tri_b NOT IN (SELECT tri_id FROM gone) END AS vb FROM e)"
HULL = "hull AS (SELECT DISTINCT unnest([pa,pb]) AS point_id FROM ve WHERE CAST(va AS INT)+coalesce(CAST(vb AS INT),0)=1)"
QP = "qp AS (SELECT c_custkey AS qid, CAST(c_custkey*37%6400 AS DOUBLE)/100.0::DOUBLE+0.003::DOUBLE AS px, CAST(c_custkey*91%6400 AS DOUBLE)/100.0::DOUBLE+0.0017::DOUBLE AS py FROM customer)"
LOC = """loc AS (SELECT qid, min(tri_id) AS tri_id FROM qp JOIN tv ON px BETWEEN xmin AND xmax AND py BETWEEN ymin AND ymax WHERE
 ((px-x2)*(y1-y2)-(x1-x2)*(py-y2) < 0) = ((px-x3)*(y2-y3)-(x2-x3)*(py-y3) < 0) AND ((px-x3)*(y2-y3)-(x2-x3)*(py-y3) < 0) = ((px-x1)*(y3-y1)-(x3-x1)*(py-y1) < 0) GROUP BY qid)"""
CLOUD = "cloud AS (SELECT vec_id AS seq, CAST(embedding[1] AS DOUBLE)*10 AS x, CAST(embedding[2] AS DOUBLE)*10 AS y, CAST(embedding[3] AS DOUBLE)*10 AS z, label AS classification FROM embeddings)"


def r6(e: str) -> str:
    return f"floor(({e})*1000000.0::DOUBLE+0.5::DOUBLE)/1000000.0::DOUBLE"
