"""Text surfaces and alignments: XYZ, LandXML, VRML, DXF, ESRI JSON, alignment and profile CSV, command files, folders."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.operators.alignment import from_bulges

SURFACE = "kind string, a double, b double, c double, id long"


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z): comma-separated lines of three numbers; other lines are skipped."""
    p = F.split("value", ",")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") == 3)
    return rows.select(*[F.trim(F.col("p")[k]).try_cast("double").alias(a) for k, a in enumerate("xyz")]).dropna()


def read_landxml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, triangles) of a LandXML surface: P elements with an id, F elements of point ids."""
    p = spark.read.format("xml").option("rowTag", "P").schema("_id long, _VALUE string").load(path)
    n = F.split(F.trim("_VALUE"), r"\s+")
    points = p.select(F.col("_id").alias("point_id"), *[n[k].try_cast("double").alias(a) for k, a in enumerate("xyz")])
    f = spark.read.format("xml").option("rowTag", "F").schema("_VALUE string, _i string").load(path)
    f = f.where("coalesce(_i, '0') <> '1'")
    ids = F.split(F.trim("_VALUE"), r"\s+")
    tri = f.select(*[ids[k].try_cast("long").alias(f"p{k + 1}") for k in range(3)]).dropna()
    # the same id at every reading
    return points, tri.withColumn("tri_id", F.xxhash64("p1", "p2", "p3"))


def parse_vrml(text: str) -> Iterator[tuple]:
    """Rows ('p', x, y, z, index) and ('t', i, j, k, index), 0-based."""
    if not text.lstrip().startswith("#VRML V2.0"):
        raise ValueError("not a VRML 2 file")
    block = re.search(r"\bpoint\s*\[([^\]]*)\]", text)
    for k, row in enumerate(r for r in (block[1] if block else "").split(",") if r.strip()):
        x, y, z = map(float, row.split()[:3])
        yield "p", x, y, z, k
    block = re.search(r"\bcoordIndex\s*\[([^\]]*)\]", text)
    face, k = [], 0
    for t in re.split(r"[\s,]+", (block[1] if block else "").strip()):
        if not t:
            continue
        if int(t) >= 0:
            face.append(int(t))
            continue
        if len(face) == 3:
            yield "t", *map(float, face), k
            k += 1
        face = []


def read_vrml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    def parse(batches):
        for pdf in batches:
            for text in pdf["value"]:
                yield pd.DataFrame(list(parse_vrml(text)), columns=["kind", "a", "b", "c", "id"]).astype({"id": "int64"})

    rows = spark.read.text(path, wholetext=True).mapInPandas(parse, SURFACE)
    points = rows.where("kind = 'p'").select(F.col("id").alias("point_id"), F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    return points, rows.where("kind = 't'").select(F.col("id").alias("tri_id"), *[F.col(c).cast("long").alias(f"p{k}") for k, c in enumerate("abc", 1)])


def dxf_entities(text: str) -> Iterator[dict]:
    """LINE and LWPOLYLINE entities as {'type', 'vertices': [(x, y, bulge)], 'closed'} from DXF group codes."""
    lines = text.splitlines()
    pairs = [(lines[k].strip(), lines[k + 1].strip()) for k in range(0, len(lines) - 1, 2)]
    cur: dict | None = None

    def done(e):
        if e and e["type"] == "LINE":
            v = e["codes"]
            e["vertices"] = [(v.get("10", 0.0), v.get("20", 0.0), 0.0), (v.get("11", 0.0), v.get("21", 0.0), 0.0)]
        return e

    for code, value in pairs:
        if code == "0":
            if cur:
                yield done(cur)
            cur = {"type": value, "vertices": [], "codes": {}, "closed": False} if value in ("LINE", "LWPOLYLINE") else None
        elif cur is None:
            continue
        elif cur["type"] == "LINE":
            if code in ("10", "20", "11", "21"):
                cur["codes"][code] = float(value)
        elif code == "10":
            cur["vertices"].append([float(value), 0.0, 0.0])
        elif code == "20" and cur["vertices"]:
            cur["vertices"][-1][1] = float(value)
        elif code == "42" and cur["vertices"]:
            cur["vertices"][-1][2] = float(value)
        elif code == "70":
            cur["closed"] = bool(int(value) & 1)
    if cur:
        yield done(cur)


def read_dxf(spark: SparkSession, path: str) -> DataFrame:
    """(align_id, seq, x0, y0, x1, y1, bulge): each LINE is an alignment, so is each LWPOLYLINE with a row per side."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                for k, e in enumerate(dxf_entities(text)):
                    v = e["vertices"] + (e["vertices"][:1] if e["closed"] else [])
                    rows += [(k, i, p[0], p[1], q[0], q[1], p[2]) for i, (p, q) in enumerate(zip(v, v[1:]))]
            yield pd.DataFrame(rows, columns=["align_id", "seq", "x0", "y0", "x1", "y1", "bulge"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "align_id long, seq long, x0 double, y0 double, x1 double, y1 double, bulge double")


def read_dxf_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of the LINE and LWPOLYLINE entities of DXF files, an alignment each."""
    return from_bulges(read_dxf(spark, path))


def read_esri_json(spark: SparkSession, path: str, name_field: str = "Name") -> tuple[DataFrame, int]:
    """((align_id, begin_sta, path_idx, seq, x, y), wkid): one alignment per feature, its paths joined in order.

    The name is looked up in any letter case, and is the feature's place if absent; CLDIST, where given, is minus the begin station.
    """
    schema = "geometryType string, spatialReference struct<latestWkid:int>, fields array<struct<name:string>>, features array<struct<attributes:map<string,string>,geometry:struct<paths:array<array<array<double>>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    head = doc.select("geometryType", "spatialReference.latestWkid").first()
    if head["geometryType"] != "esriGeometryPolyline":
        raise ValueError("polylines are expected")
    f = doc.select(F.posexplode("features").alias("k", "f"))
    attr = F.map_from_entries(F.transform(F.map_entries("f.attributes"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    f = f.withColumn("attr", attr)
    name = F.coalesce(F.try_element_at("attr", F.lit(name_field.lower())), F.concat(F.lit("unnamed-"), F.col("k")))
    begin = F.coalesce(-F.try_element_at("attr", F.lit("cldist")).try_cast("double"), F.lit(0.0))
    p = f.select(name.alias("align_id"), begin.alias("begin_sta"), F.posexplode("f.geometry.paths").alias("path_idx", "path"))
    p = p.select("align_id", "begin_sta", "path_idx", F.posexplode("path").alias("i", "xy"))
    return p.select("align_id", "begin_sta", "path_idx", (F.col("path_idx").cast("long") * 2**32 + F.col("i")).alias("seq"), F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y")), head["latestWkid"]


#: Sections of the alignment file and what their cells are: numbers, whole numbers, or numbers that may be left out.
SECTIONS = {
    "StartHA": (float, float, float, int, float),  # x, y, station, region, azimuth
    "Elements": (float, float, float),  # degree in, length, degree out
    "Regions": (float, int, float),  # begin station, region, end station
    "EndHA": (float, float, None, int, float),  # as StartHA; the station may be empty
}


def alignment_sections(text: str) -> dict[str, list[tuple]]:
    """Rows of each section. A line 'Name:' opens a section; lines that are not its numbers (titles, blanks) are skipped,
    but a blank line behind rows ends it."""
    found: dict[str, list[tuple]] = {name: [] for name in SECTIONS}
    section = None
    for line in text.splitlines():
        cells = [c.strip() for c in line.split(",")]
        if cells[0].endswith(":"):
            section = cells[0].rstrip(":") if cells[0].rstrip(":") in SECTIONS else None
        elif section and not cells[0]:
            section = None if found[section] else section
        elif section:
            try:
                kinds = SECTIONS[section]
                found[section].append(tuple((float(c) if c else None) if kind is None else kind(c) for kind, c in zip(kinds, cells[: len(kinds)], strict=True)))
            except ValueError:
                continue
    return found


def parse_alignment_csv(text: str) -> tuple[list[tuple], list[tuple]]:
    """(heads, elements): StartHA gives x, y, station, region, azimuth; Elements give degree in, length, degree out."""
    found = alignment_sections(text)
    return found["StartHA"], found["Elements"]


def _sections(spark: SparkSession, path: str) -> dict[str, list[tuple]]:
    return alignment_sections(spark.read.text(path, wholetext=True).first()["value"])


def read_alignment_csv(spark: SparkSession, path: str, align_id: str = "alignment") -> tuple[DataFrame, DataFrame]:
    """(elements, heads) in the shape that the chain operator takes; an alignment is a small file."""
    found = _sections(spark, path)
    e = spark.createDataFrame([(align_id, k, *row) for k, row in enumerate(found["Elements"])], "align_id string, seq int, degree_in double, length double, degree_out double")
    h = spark.createDataFrame([(align_id, x, y, s, a, r) for x, y, s, r, a in found["StartHA"][:1]], "align_id string, x double, y double, station double, azimuth_deg double, region int")
    return e, h


def read_alignment_regions(spark: SparkSession, path: str, align_id: str = "alignment") -> tuple[DataFrame, DataFrame]:
    """(regions, ends) of the same file: (align_id, region, begin_sta, end_sta), by which stations are numbered, and
    (align_id, x, y, station, region, azimuth_deg), where the alignment should end; a station left out is NULL."""
    found = _sections(spark, path)
    r = spark.createDataFrame([(align_id, n, b, e) for b, n, e in found["Regions"]], "align_id string, region int, begin_sta double, end_sta double")
    z = spark.createDataFrame([(align_id, x, y, s, n, a) for x, y, s, n, a in found["EndHA"][:1]], "align_id string, x double, y double, station double, region int, azimuth_deg double")
    return r, z


def read_profile_csv(spark: SparkSession, path: str, profile_id: int = 1) -> DataFrame:
    """VPIs (profile_id, station, elevation, vc_length); lines without numbers are skipped."""
    p = F.split("value", ",")
    num = lambda k: F.regexp_replace(F.trim(F.get(p, F.lit(k))), r"\+", "").try_cast("double")
    rows = spark.read.text(path).select(F.lit(profile_id).cast("long").alias("profile_id"), num(0).alias("station"), num(1).alias("elevation"), F.coalesce(num(2), F.lit(0.0)).alias("vc_length"))
    return rows.where("station is not null and elevation is not null")


def parse_commands(text: str) -> list[list[str]]:
    """Words of each command line; # starts a comment, quotes hold words together."""
    found = []
    for line in text.splitlines():
        words = shlex.split(line, comments=True, posix=True)
        if words:
            found.append(words)
    return found


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, parent, length) of all files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return f.select("path", F.regexp_extract("path", "^(.*)/", 1).alias("parent"), "length")


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder).groupBy("parent").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
