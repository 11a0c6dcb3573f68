"""Formats by round trip, and the command session from file to export."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from alidade.operators import surface as s
from alidade.plans.session import Session, load, save
from alidade.sources import las, rasters, sinks, texts


@pytest.fixture(scope="module")
def cloud(tmp_path_factory):
    r = np.random.default_rng(2)
    x, y = r.integers(0, 10000, (2, 300)) / 100
    z = np.round(5 + 0.05 * x + np.sin(y / 10), 2)
    cls = r.choice([2, 5, 13], 300)
    path = tmp_path_factory.mktemp("las") / "t.las"
    las.make_las(str(path), x, y, z, cls, vlr=b"\0" * 54)
    return str(path), x, y, z, cls


def test_las(spark, cloud, tmp_path):
    path, x, y, z, cls = cloud
    rows = las.read_las(spark, path, rows_per_split=100).orderBy("seq").collect()
    assert len(rows) == 300 and np.allclose([r.x for r in rows], x) and np.allclose([r.z for r in rows], z)
    some = las.read_las(spark, path, [2, 13])
    assert some.count() == int(np.isin(cls, [2, 13]).sum())
    n = las.write_las(some, path, str(tmp_path / "o.las"))
    again = las.read_las(spark, str(tmp_path / "o.las"))
    assert again.count() == n and {round(r.x, 2) for r in again.collect()} == {round(float(v), 2) for v, c in zip(x, cls) if c in (2, 13)}
    with pytest.raises(ValueError):
        las.read_header(b"nope" * 100)


def test_asc(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    (tmp_path / "b.asc").write_text("ncols 1\nnrows 1\nxllcorner 1000\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n7\n")
    got = {(r.x, r.y): r.z for r in rasters.read_points(spark, str(tmp_path / "a.asc")).collect()}
    assert got == {(11.0, 23.0): 1.0, (13.0, 23.0): 2.0, (15.0, 23.0): 3.0, (11.0, 21.0): 4.0, (15.0, 21.0): 6.0}
    assert rasters.read_folder(spark, str(tmp_path), (10, 20, 16, 24)).count() == 5
    assert rasters.read_folder(spark, str(tmp_path)).count() == 6 and rasters.peak_cell_size(spark, str(tmp_path)) == 2
    cells = rasters.read_cells(spark, str(tmp_path / "a.asc"))
    assert [r.value for r in sinks.asc_rows(cells).orderBy("row").collect()] == ["1 2 3", "4 -9999 6"]


def test_text_surfaces(spark, tmp_path):
    (tmp_path / "s.xyz").write_text("1,2,3\nbad\n4,5,6,7\n8,9,x\n1.5,2.5,3.5\n")
    assert texts.read_xyz(spark, str(tmp_path / "s.xyz")).count() == 2
    (tmp_path / "s.xml").write_text('<LandXML><Surface><Pnts><P id="1">0 0 1</P><P id="2">4 0 1</P><P id="3">0 4 2</P></Pnts><Faces><F>1 2 3</F></Faces></Surface></LandXML>')
    p, t = texts.read_landxml(spark, str(tmp_path / "s.xml"))
    assert p.count() == 3 and s.with_vertices(t, p).first()["nz"] == 16
    (tmp_path / "s.wrl").write_text("#VRML V2.0 utf8\nShape { coord Coordinate { point [ 0 0 1, 4 0 1, 0 4 2 ] } coordIndex [ 0, 1, 2, -1 ] }")
    p, t = texts.read_vrml(spark, str(tmp_path / "s.wrl"))
    assert p.count() == 3 and t.first()["p3"] == 2


def test_alignment_files(spark, tmp_path):
    (tmp_path / "a.dxf").write_text("\n".join("0 SECTION 2 ENTITIES 0 LINE 10 0 20 0 11 5 21 5 0 LWPOLYLINE 70 0 10 0 20 0 42 1 10 4 20 0 10 8 20 0 0 ENDSEC".split()))
    d = texts.read_dxf(spark, str(tmp_path / "a.dxf")).orderBy("align_id", "seq").collect()
    assert [(r.align_id, r.seq, r.x1, r.bulge) for r in d] == [(0, 0, 5, 0), (1, 0, 4, 1), (1, 1, 8, 0)]
    doc = {"geometryType": "esriGeometryPolyline", "spatialReference": {"latestWkid": 2264}, "fields": [{"name": "NAME"}], "features": [{"attributes": {"NAME": "r1", "CLDIST": -50.0}, "geometry": {"paths": [[[0, 0], [3, 4]], [[3, 8]]]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    pts, wkid = texts.read_esri_json(spark, str(tmp_path / "a.json"))
    assert wkid == 2264 and [(r.align_id, r.begin_sta, r.x, r.y) for r in pts.orderBy("seq").collect()] == [("r1", 50.0, 0, 0), ("r1", 50.0, 3, 4), ("r1", 50.0, 3, 8)]
    (tmp_path / "a.csv").write_text("StartHA:,,,,\nNorthing,Easting,Station,Region,Azimuth\n10,20,1000,1,45\nElements:,,,\nDegreeIn,Length,DegreeOut,\n0,100,0,\n5,200,5,\n,,,\nRegions:\n1000,1,1300\n")
    e, h = texts.read_alignment_csv(spark, str(tmp_path / "a.csv"))
    assert e.count() == 2 and h.first()["azimuth_deg"] == 45
    (tmp_path / "p.csv").write_text("sta,el\n0,10\n10+00,12,100\n")
    assert [tuple(r)[1:] for r in texts.read_profile_csv(spark, str(tmp_path / "p.csv")).orderBy("station").collect()] == [(0, 10, 0), (1000, 12, 100)]
    assert texts.list_files(spark, str(tmp_path), "*.csv").count() == 2 and texts.folder_sizes(spark, str(tmp_path)).count() == 1


def test_commands():
    assert texts.parse_commands('# all\nload "my file.las" 2 # two\n\nexit') == [["load", "my file.las", "2"], ["exit"]]


def test_session(spark, cloud, tmp_path):
    (tmp_path / "a.csv").write_text("StartHA:\n5,5,0,1,45\nElements:\n0,100,0,\n,,,\n")
    done = Session(spark).run(f"""
        set_outdir {tmp_path}
        set_filter 2 5 13
        point_count {cloud[0]}
        load {cloud[0]}
        summarize
        to_xyz o.xyz -zipped
        to_obj o.obj
        points_to_dxf o.dxf
        tin_to_dxf t.dxf
        histogram sparsity 5 h.csv
        set_sample_grid 20
        save_grid_to_raster g.asc
        load_alignment {tmp_path}/a.csv
        profile_to_csv p.csv
        profile_to_csv q.csv -inc=10 -truestation
        save_stats {tmp_path}/stats
        decimate 0.5
        nonsense
        load missing.las
        performance_test 1000
        exit
    """)
    assert done[2] == "300" and "unknown command: nonsense" in done
    assert not [d for d in done if d.startswith(("to_", "points_", "tin_", "hist", "save", "profile", "decimate", "summ"))], done
    assert (tmp_path / "o.xyz.zip").exists() and (tmp_path / "h.csv").read_text().count("\n") == 5
    assert (tmp_path / "o.obj").read_text().splitlines()[1].startswith("v ") and "3DFACE" in (tmp_path / "t.dxf").read_text()
    assert (tmp_path / "g.asc").read_text().startswith("ncols") and (tmp_path / "p.csv").read_text().startswith("0+")
    assert spark.read.option("header", True).csv(f"{tmp_path}/stats").count() == 1


def test_save_and_load(spark, cloud, tmp_path):
    from alidade.plans.session import build

    f = build(las.read_las(spark, cloud[0]), 1)
    save(f, str(tmp_path / "f"))
    g = load(spark, str(tmp_path / "f"))
    assert g.points.count() == f.points.count() and g.tv.count() == f.tv.count() and g.unused.count() == 150


def test_stream(spark, tmp_path):
    from alidade.plans import fixtures as x
    from alidade.streaming import located

    _, tv = x.lattice(spark, "/root/testdata/sf0.001")
    x.query_points(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, px double, py double").parquet(str(tmp_path / "in"))
    q = located(stream, tv, 6.0).writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    want = s.locate(x.query_points(spark, "/root/testdata/sf0.001"), tv).where("tri_id is not null").count()
    assert spark.table("hits").select("qid").distinct().count() == want


def test_empty_export(spark):
    with pytest.raises(ValueError):
        sinks.dxf_lines(spark.createDataFrame([], "xa double, ya double, za double, xb double, yb double, zb double").withColumn("k", F.lit(1)))


def test_empty_and_gapped_files(spark, cloud, tmp_path):
    empty = spark.createDataFrame([], las.SCHEMA)
    assert las.write_cloud(empty, str(tmp_path / "none.las")) == 0 and las.read_las(spark, str(tmp_path / "none.las")).count() == 0
    wanted = [0, 1, 2, 7, 9, 10, 299]
    rows = spark.createDataFrame([(k,) for k in reversed(wanted)], "seq long")
    assert las.write_las(rows, cloud[0], str(tmp_path / "some.las"), block=2) == 7
    got = [r.x for r in las.read_las(spark, str(tmp_path / "some.las")).orderBy("seq").collect()]
    assert np.allclose(got, [cloud[1][k] for k in wanted])
    assert las.write_las(rows.where("false"), cloud[0], str(tmp_path / "none.las")) == 0
    assert rasters.read_folder(spark, str(tmp_path)).count() == 0 and rasters.peak_cell_size(spark, str(tmp_path)) == 0


def test_grids_in_many_splits(spark, tmp_path):
    """Rows broken over lines, files in several splits and a blank in a name; each file has its own NODATA."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, xll, none in (("a", 0, "-9999"), ("b c", 100, "7")):
        lines = [" ".join(str(v) for v in range(k, k + 5)) for k in range(0, 60, 5)]
        (tmp_path / f"{name}.asc").write_text(f"ncols 6\nnrows 10\nxllcorner {xll}\nyllcorner 0\ncellsize 1\nNODATA_value {none}\n" + "\n".join(lines) + "\n")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        got = {(r.x, r.y): r.z for r in rasters.read_folder(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {(x + k % 6 + 0.5, 9.5 - k // 6): float(k) for x in (0, 100) for k in range(60) if (x, k) != (100, 7)}
    assert got == want


def test_regions_and_end_of_an_alignment_file(spark, tmp_path):
    """Sections in the file's own order, titles and blank lines between; an empty station; regions number the stations."""
    from alidade.operators import alignment as al
    from alidade.sources import texts

    text = """StartHA:,,,,
Northing,Easting,Station,Region,Azimuth
10,20,500,1,90
,,,,
Elements:,,,,
DegreeIn,Length,DegreeOut,TypeTag,
0,30,0,,
0,70,0,,
,,,,
9,9,9,,
Regions:,,,,
StartStation,RegionNo,EndStation,,
,,,,
1000,1,1040,,
2000,2,2050,,
,,,,
Other:,,,,
1,2,3,,
EndHA:,,,,
Northing,Easting,Station,Region,Azimuth
110,20,,2,90
"""
    (tmp_path / "a.csv").write_text(text)
    seg = al.chain(*texts.read_alignment_csv(spark, f"{tmp_path}/a.csv"))
    regions, ends = texts.read_alignment_regions(spark, f"{tmp_path}/a.csv")
    assert seg.count() == 2 and [tuple(r)[1:] for r in regions.orderBy("region").collect()] == [(1, 1000, 1040), (2, 2000, 2050)]
    off = al.end_checks(seg, ends).first()
    assert off.miss == pytest.approx(0, abs=1e-9) and off.azimuth_miss == pytest.approx(0, abs=1e-9) and off.station_miss is None
    rows = spark.createDataFrame([("alignment", s) for s in (500.0, 539.0, 541.0, 595.0)], "align_id string, station double")
    got = {r.station: (r.region, r.sta, r.extended) for r in al.region_stations(rows, seg, regions).collect()}
    assert got == {500: (1, 1000, 0), 539: (1, 1039, 0), 541: (2, 2001, 0), 595: (2, 2050, 5)}
    (tmp_path / "b.csv").write_text(text.replace("110,20,,2,90", "113,24,590,2,91").replace("1000,1,1040,,\n2000,2,2050,,\n", ""))
    regions, ends = texts.read_alignment_regions(spark, f"{tmp_path}/b.csv")
    off = al.end_checks(seg, ends).first()
    assert regions.count() == 0 and (off.miss, off.azimuth_miss, off.station_miss) == pytest.approx((5, -1, 10))
    assert {(r.region, r.sta) for r in al.region_stations(rows, seg, regions).collect()} == {(None, s) for s in (500, 539, 541, 595)}
