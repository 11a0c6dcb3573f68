"""Registered queries that write whole tables in a format and read them back, and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.operators import alignment as al
from alidade.operators.alignment import station_text
from alidade.plans import fixtures as x
from alidade.plans.fixtures import CLOUD, LOC, LP, LT, QP, SURF
from alidade.plans.session import raster_surface
from alidade.sources import las, rasters, sinks, texts
from alidade.streaming import located
from alidade.tables import shared_dir

Q: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str):
    def keep(f):
        Q[name] = f
        SQL[name] = sql
        return f

    return keep


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    path = f"{shared_dir(spark).removeprefix('file:')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


_LAS = f"""WITH {CLOUD}, las AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, round_even(x/0.001::DOUBLE, 0)*0.001::DOUBLE AS x,
 round_even(y/0.001::DOUBLE, 0)*0.001::DOUBLE AS y, round_even(z/0.001::DOUBLE, 0)*0.001::DOUBLE AS z, classification FROM cloud)"""


def _las_file(spark: SparkSession, d: str) -> str:
    path = f"{folder(spark)}/cloud.las"
    las.write_cloud(x.cloud(spark, d), path, 0.001)
    return path


@add("s01_las_read", f"{_LAS} SELECT * FROM las")
def _s01(spark, d):
    return las.read_las(spark, _las_file(spark, d), rows_per_split=5000)


@add("s02_las_classes", f"{_LAS} SELECT * FROM las WHERE classification IN (1, 3)")
def _s02(spark, d):
    return las.read_las(spark, _las_file(spark, d), [1, 3])


@add("s10_las_point_count", f"{_LAS} SELECT count(*) AS n FROM las WHERE classification IN (2, 5)")
def _s10(spark, d):
    return las.read_las(spark, _las_file(spark, d), [2, 5]).agg(F.count("*").alias("n"))


@add("k01_las_subset", f"{_LAS} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, x, y, z, classification FROM las WHERE classification <> 2")
def _k01(spark, d):
    path = _las_file(spark, d)
    las.write_las(las.read_las(spark, path).where("classification <> 2"), path, f"{path}.part.las")
    return las.read_las(spark, f"{path}.part.las")


#: The lattice as a raster: row 0 lies at the top, cells over 20 have no value.
_CELLS = "cells AS (SELECT point_id//16 AS row, point_id%16 AS col, CASE WHEN z <= 20 THEN z END AS z FROM lp)"
_HEAD = {"ncols": 16, "nrows": 16, "xll": 100.0, "yll": 200.0, "cellsize": 2.0}


def _cells(spark: SparkSession, d: str) -> DataFrame:
    p = x.lattice_points(spark, d)
    return p.select(F.floor(F.col("point_id") / 16).alias("row"), (F.col("point_id") % 16).alias("col"), F.when(F.col("z") <= 20, F.col("z")).alias("z"))


def _asc_file(spark: SparkSession, d: str) -> str:
    path = f"{folder(spark)}/lattice.asc"
    sinks.write_text(sinks.asc_rows(_cells(spark, d)), path, ["row"], sinks.asc_head(_HEAD))
    return path


@add("s04_asc_read", f"WITH {LP}, {_CELLS} SELECT * FROM cells")
def _s04(spark, d):
    return rasters.read_cells(spark, _asc_file(spark, d))


@add("s06_raster_header", f"WITH {LP}, s AS (SELECT 100.0 + max(z) AS x0, 200.0 + min(z) AS y0, (1 + max(z) - min(z))::DOUBLE AS c FROM lp) SELECT (x0 + c/2)::DOUBLE AS xmin, (y0 + c/2)::DOUBLE AS ymin, (x0 + 15*c + c/2)::DOUBLE AS xmax, (y0 + 15*c + c/2)::DOUBLE AS ymax, c AS cellsize FROM s")
def _s06(spark, d):
    """The corner and the cell size are taken from the elevations."""
    low, high = x.lattice_points(spark, d).agg(F.min("z"), F.max("z")).first()
    path = f"{folder(spark)}/lattice.asc"
    sinks.write_text(sinks.asc_rows(_cells(spark, d)), path, ["row"], sinks.asc_head({**_HEAD, "xll": 100.0 + high, "yll": 200.0 + low, "cellsize": 1.0 + high - low}))
    head = rasters.read_header(spark, path)
    return spark.createDataFrame([(*rasters.header_box(head), head["cellsize"])], "xmin double, ymin double, xmax double, ymax double, cellsize double")


@add("s07_raster_folder", f"WITH {LP}, {_CELLS} SELECT 101.0::DOUBLE + 2*col AS x, 231.0::DOUBLE - 2*row AS y, z FROM cells WHERE z IS NOT NULL AND 101 + 2*col BETWEEN 103 AND 113 AND 231 - 2*row BETWEEN 208 AND 224")
def _s07(spark, d):
    """Four files of eight columns and rows; the box, wider by a cell, meets the two on the left."""
    out, cells = folder(spark), _cells(spark, d)
    for r in (0, 8):
        for c in (0, 8):
            part = cells.where(f"row >= {r} and row < {r + 8} and col >= {c} and col < {c + 8}")
            head = {**_HEAD, "ncols": 8, "nrows": 8, "xll": 100.0 + 2 * c, "yll": 216.0 - 2 * r}
            sinks.write_text(sinks.asc_rows(part), f"{out}/tile {r} {c}.asc", ["row"], sinks.asc_head(head))
    return rasters.read_folder(spark, out, (105, 210, 111, 222))


@add(
    "s08_raster_surface",
    f"""WITH {LP}, {_CELLS}, c AS (SELECT row*16+col AS id, col FROM cells WHERE z IS NOT NULL),
t AS (SELECT 2*id AS tri_id, id AS p1, id+16 AS p2, id+17 AS p3 FROM c WHERE col < 15 UNION ALL SELECT 2*id+1, id, id+17, id+1 FROM c WHERE col < 15)
SELECT * FROM t WHERE p2 IN (SELECT id FROM c) AND p3 IN (SELECT id FROM c)""",
)
def _s08(spark, d):
    return raster_surface(spark, _asc_file(spark, d)).tv.select("tri_id", "p1", "p2", "p3")


@add("s11_xyz_read", f"WITH {LP} SELECT x, y, z FROM lp")
def _s11(spark, d):
    path = f"{folder(spark)}/lattice.xyz"
    lines = sinks.xyz_lines(x.lattice_points(spark, d))
    lines.union(spark.createDataFrame([("four,numbers,are,skipped",), ("1,2,3,4",)], "value string")).write.text(path)
    return texts.read_xyz(spark, path)


_MESH = f"WITH {LP}, {LT}, tri AS (SELECT p1, p2, p3 FROM lt)"


@add("s12_landxml_points", f"WITH {LP} SELECT point_id + 1 AS point_id, x, y, z FROM lp")
def _s12p(spark, d):
    return texts.read_landxml(spark, _xml_file(spark, d))[0]


@add("s12_landxml_faces", f"{_MESH} SELECT p1 + 1 AS p1, p2 + 1 AS p2, p3 + 1 AS p3 FROM tri")
def _s12f(spark, d):
    return texts.read_landxml(spark, _xml_file(spark, d))[1].select("p1", "p2", "p3")


def _xml_file(spark: SparkSession, d: str) -> str:
    """The lattice as LandXML, whose ids begin at 1."""
    path = f"{folder(spark)}/lattice.xml"
    p = x.lattice_points(spark, d).select(F.lit(0).alias("kind"), F.col("point_id").alias("place"), F.format_string('<P id="%d">%s %s %s</P>', F.col("point_id") + 1, *[F.col(a).cast("string") for a in "xyz"]).alias("value"))
    f = x.lattice_triangles(spark).select(F.lit(2).alias("kind"), F.col("tri_id").alias("place"), F.format_string("<F>%d %d %d</F>", *[F.col(f"p{k}") + 1 for k in (1, 2, 3)]).alias("value"))
    between = spark.range(1).select(F.lit(1).alias("kind"), F.col("id").alias("place"), F.lit("</Pnts><Faces>").alias("value"))
    sinks.write_text(p.union(between).union(f), path, ["kind", "place"], ["<LandXML><Surfaces><Surface><Definition><Pnts>"], ["</Faces></Definition></Surface></Surfaces></LandXML>"])
    return path


def _wrl_file(spark: SparkSession, d: str) -> str:
    """The lattice as VRML, whose indices begin at 0."""
    path = f"{folder(spark)}/lattice.wrl"
    p = x.lattice_points(spark, d).select(F.lit(0).alias("kind"), F.col("point_id").alias("place"), F.concat(F.concat_ws(" ", "x", "y", "z"), F.lit(",")).alias("value"))
    f = x.lattice_triangles(spark).select(F.lit(2).alias("kind"), F.col("tri_id").alias("place"), F.concat(F.concat_ws(",", "p1", "p2", "p3"), F.lit(",-1,")).alias("value"))
    between = spark.range(1).select(F.lit(1).alias("kind"), F.col("id").alias("place"), F.lit("] } coordIndex [").alias("value"))
    sinks.write_text(p.union(between).union(f), path, ["kind", "place"], ["#VRML V2.0 utf8", "Shape { geometry IndexedFaceSet { coord Coordinate { point ["], ["] } }"])
    return path


@add("s13_vrml_points", f"WITH {LP} SELECT point_id, x, y, z FROM lp")
def _s13p(spark, d):
    return texts.read_vrml(spark, _wrl_file(spark, d))[0]


@add("s13_vrml_faces", f"{_MESH} SELECT CAST(p1 AS BIGINT) AS p1, CAST(p2 AS BIGINT) AS p2, CAST(p3 AS BIGINT) AS p3 FROM tri")
def _s13f(spark, d):
    return texts.read_vrml(spark, _wrl_file(spark, d))[1].select("p1", "p2", "p3")


def _alignment_file(spark: SparkSession, d: str) -> str:
    """Each nation is a tangent and a region; the alignment runs north-east from (100, 200) and station 1000."""
    path = f"{folder(spark)}/nations.csv"
    n = x.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    total = n.agg(F.sum(F.col("k") + 10).alias("t"))
    text = lambda section, place, value: F.struct(F.lit(section).alias("section"), place.cast("long").alias("place"), value.alias("value"))
    row = lambda *cells: F.concat_ws(",", *[c if isinstance(c, Column) else F.lit(c) for c in cells])
    titles = [(0, "StartHA:,,,,"), (1, "Northing,Easting,Station,Region,Azimuth"), (2, "100,200,1000,1,45"), (3, ",,,,"), (4, "Elements:,,,,"), (5, "DegreeIn,Length,DegreeOut,TypeTag,"), (7, ",,,,"), (8, "Regions:,,,,"), (9, "StartStation,RegionNo,EndStation,,"), (11, ",,,,"), (12, "EndHA:,,,,"), (13, "Northing,Easting,Station,Region,Azimuth")]
    fixed = spark.createDataFrame([(a, 0, t) for a, t in titles], "section int, place long, value string")
    own = n.select(F.explode(F.array(text(6, F.col("k"), row("0", (F.col("k") + 10).cast("string"), "0", "", "")), text(10, F.col("k"), row((F.col("k") * 1000).cast("string"), (F.col("k") + 1).cast("string"), (F.col("k") * 1001 + 10).cast("string"), "", "")))).alias("r")).select("r.*")
    way = F.col("t") / F.sqrt(F.lit(2.0))
    end = total.select(text(14, F.lit(0), row((way + 100).cast("string"), (way + 200).cast("string"), "", "25", "45")).alias("r")).select("r.*")
    sinks.write_text(fixed.unionByName(own).unionByName(end), path, ["section", "place"])
    return path


@add("s16_alignment_regions", """SELECT CAST(n_nationkey + 1 AS INT) AS region, n_nationkey * 1000.0::DOUBLE AS begin_sta, n_nationkey * 1001.0::DOUBLE + 10 AS end_sta,
 CAST(coalesce(sum(n_nationkey + 10) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS true_begin FROM nation""")
def _s16(spark, d):
    regions, _ = texts.read_alignment_regions(spark, _alignment_file(spark, d))
    return al.with_true_stations(regions).select("region", "begin_sta", "end_sta", "true_begin")


@add("s16_alignment_end", "SELECT CAST(count(*) AS BIGINT) AS segments, 0.0::DOUBLE AS miss, 0.0::DOUBLE AS azimuth_miss, 1000.0::DOUBLE + sum(n_nationkey + 10) AS end_sta FROM nation")
def _s16e(spark, d):
    """The chain of the elements ends where the file says."""
    path = _alignment_file(spark, d)
    seg = al.chain(*texts.read_alignment_csv(spark, path))
    off = al.end_checks(seg, texts.read_alignment_regions(spark, path)[1])
    per = seg.groupBy("align_id").agg(F.count("*").alias("segments"), F.max("end_sta").alias("end_sta"))
    return per.join(off, "align_id").select("segments", F.round("miss", 6).alias("miss"), F.round("azimuth_miss", 6).alias("azimuth_miss"), "end_sta")


@add("s16_region_stations", """SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey + 1 AS INT) AS region, n_nationkey * 1000.0::DOUBLE + 2.5 AS sta, 0.0::DOUBLE AS extended FROM nation""")
def _s16s(spark, d):
    """2.5 behind the begin of each tangent, as the region's own station."""
    path = _alignment_file(spark, d)
    seg = al.chain(*texts.read_alignment_csv(spark, path))
    rows = seg.select("align_id", F.col("seq").cast("long").alias("k"), (F.col("begin_sta") + 2.5).alias("station"))
    return al.region_stations(rows, seg, texts.read_alignment_regions(spark, path)[0]).select("k", "region", "sta", "extended")


@add("s17_alignments", """SELECT align_id, seq, round(first_sta + coalesce(sum(length) OVER (PARTITION BY align_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS begin_sta,
 round(length, 6) AS length
 FROM (SELECT 'route ' || c_nationkey AS align_id, CAST(c_nationkey AS DOUBLE) AS first_sta, CAST(row_number() OVER w - 1 AS BIGINT) AS seq,
 sqrt((lead(c_custkey) OVER w - c_custkey)::DOUBLE**2 + (lead(c_custkey % 97) OVER w - c_custkey % 97)::DOUBLE**2) AS length
 FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)) WHERE length IS NOT NULL""")
def _s17a(spark, d):
    """Segments of the features' paths, whose stations begin at minus CLDIST."""
    seg = al.lines_from_points(texts.read_esri_json(spark, _esri_file(spark, d))[0])
    return seg.select("align_id", "seq", F.round("begin_sta", 6).alias("begin_sta"), F.round("length", 6).alias("length"))


@add(
    "s17_esri_json",
    """SELECT 'route ' || c_nationkey AS align_id, CAST(c_nationkey AS DOUBLE) AS begin_sta,
CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS seq, CAST(c_custkey AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer""",
)
def _s17(spark, d):
    return texts.read_esri_json(spark, _esri_file(spark, d))[0].select("align_id", "begin_sta", "seq", "x", "y")


def _esri_file(spark: SparkSession, d: str) -> str:
    """Each nation's customers are a feature of one path."""
    path = f"{folder(spark)}/routes.json"
    xy = F.array(F.col("c_custkey").cast("double"), (F.col("c_custkey") % 97).cast("double"))
    per = x.table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(xy)).alias("path"))
    attr = F.struct(F.concat(F.lit("route "), "c_nationkey").alias("NAME"), (-F.col("c_nationkey")).alias("CLDIST"))
    feature = F.to_json(F.struct(attr.alias("attributes"), F.struct(F.array("path").alias("paths")).alias("geometry")))
    # a comma after each feature but the last
    rows = per.select("c_nationkey", F.concat(F.when(F.lag("c_nationkey").over(Window.orderBy("c_nationkey")).isNull(), F.lit("")).otherwise(F.lit(",")), feature).alias("value"))
    head = '{"geometryType": "esriGeometryPolyline", "spatialReference": {"latestWkid": 2264}, "fields": [{"name": "NAME"}], "features": ['
    sinks.write_text(rows, path, ["c_nationkey"], [head], ["]}"])
    return path


@add("s21_profile_csv", "SELECT CAST(1 AS BIGINT) AS profile_id, c_custkey * 50.0::DOUBLE AS station, CAST(c_custkey % 31 AS DOUBLE) AS elevation, CASE WHEN c_custkey % 2 = 0 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS vc_length FROM customer")
def _s21(spark, d):
    """Every second line has no curve length; the titles are skipped."""
    path = f"{folder(spark)}/profile.csv"
    key = F.col("c_custkey")
    line = F.concat_ws(",", station_text((key * 50).cast("double")), (key % 31).cast("string"), F.when(key % 2 == 0, F.lit("20")))
    sinks.write_text(x.table(spark, d, "customer").select(key, line.alias("value")), path, ["c_custkey"], ["station,elevation,length"])
    return texts.read_profile_csv(spark, path)


@add("k04_dxf_points", f"WITH {LP} SELECT point_id AS place, '0|POINT|8|POINTS|10|' || printf('%.4f', x) || '|20|' || printf('%.4f', y) || '|30|' || printf('%.4f', z) AS value FROM lp")
def _k04(spark, d):
    return sinks.dxf_points(x.lattice_points(spark, d)).select("place", F.replace("value", F.lit("\n"), F.lit("|")).alias("value"))


@add("k05_dxf_faces", f"WITH {SURF} SELECT tri_id AS place, '0|3DFACE|8|TIN' || " + " || ".join(f"'|{(i + 1) * 10 + m}|' || printf('%.4f', {a}{k})" for m, k in enumerate((1, 2, 3, 3)) for i, a in enumerate("xyz")) + " AS value FROM tv")
def _k05(spark, d):
    return sinks.dxf_faces(x.lattice(spark, d)[1]).select("place", F.replace("value", F.lit("\n"), F.lit("|")).alias("value"))


@add("s15_saved_surface", f"WITH {SURF} SELECT tri_id, p1, p2, p3, nz FROM tv")
def _s15(spark, d):
    from alidade.plans.session import Surface, load, save

    p, tv = x.lattice(spark, d)
    out = f"{folder(spark)}/surface"
    save(Surface(p.withColumn("seq", F.col("point_id")), tv), out)
    return load(spark, out).tv.select("tri_id", "p1", "p2", "p3", "nz")


@add("stream_located", f"WITH {SURF}, {QP}, {LOC} SELECT qid, tri_id FROM loc")
def _stream(spark, d):
    """The query points as a stream, looked up in all that is there; the first triangle of a point on a border."""
    out = folder(spark)
    x.query_points(spark, d).write.parquet(f"{out}/in")
    stream = spark.readStream.schema("qid long, px double, py double").parquet(f"{out}/in")
    q = located(stream, x.lattice(spark, d)[1]).writeStream.format("parquet").option("path", f"{out}/hits").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/hits").groupBy("qid").agg(F.min("tri_id").alias("tri_id"))
