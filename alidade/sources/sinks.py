"""Text of exported surfaces as rows, and writers that keep a global order."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alidade.functions.angles import rounded
from alidade.operators.alignment import station_text


def trimmed(v: Column, places: int = 3) -> Column:
    """Up to `places` decimals, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", v), "0+$", ""), "[.]$", "")


def xyz_lines(points: DataFrame) -> DataFrame:
    return points.select(F.format_string("%.2f,%.2f,%.2f", "x", "y", "z").alias("value"))


def obj_lines(points: DataFrame, triangles: DataFrame, seq: str = "seq") -> DataFrame:
    """(kind, place, value): a comment, `v` rows by seq, `f` rows with 1-based indices; order by kind and place."""
    head = points.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit("# transform: identity").alias("value"))
    v = points.select(F.lit(1).alias("kind"), F.col(seq).cast("long").alias("place"), F.format_string("v %.3f %.3f %.3f", "x", "y", "z").alias("value"))
    f = triangles.select(F.lit(2).alias("kind"), F.col("tri_id").cast("long").alias("place"), F.concat_ws(" ", F.lit("f"), F.col("p1") + 1, F.col("p2") + 1, F.col("p3") + 1).alias("value"))
    return head.unionByName(v).unionByName(f)


def asc_rows(cells: DataFrame, nodata: str = "-9999") -> DataFrame:
    """(row, value): one text line per raster row, columns in order, NULL as NODATA."""
    one = F.struct("col", F.when(F.col("z").isNull(), nodata).otherwise(trimmed(F.col("z"))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda c: c["t"]), " ")
    return cells.groupBy("row").agg(joined.alias("value"))


def asc_head(head: dict, nodata: str = "-9999") -> list[str]:
    names = (("ncols", "ncols"), ("nrows", "nrows"), ("xllcorner", "xll"), ("yllcorner", "yll"), ("cellsize", "cellsize"))
    return [f"{k} {head[v]}" for k, v in names] + [f"NODATA_value {nodata}"]


def dxf_points(points: DataFrame, layer: str = "POINTS") -> DataFrame:
    text = F.concat_ws("\n", F.lit("0\nPOINT\n8\n" + layer), *[F.concat(F.lit(f"{c}\n"), F.format_string("%.4f", a)) for c, a in ((10, "x"), (20, "y"), (30, "z"))])
    return points.select(F.col("point_id").alias("place"), text.alias("value"))


def dxf_faces(tv: DataFrame, layer: str = "TIN") -> DataFrame:
    """Triangles as 3DFACE entities, the third corner repeated."""
    parts = [F.concat(F.lit(f"{(i + 1) * 10 + m}\n"), F.format_string("%.4f", f"{a}{k}")) for m, k in enumerate((1, 2, 3, 3)) for i, a in enumerate("xyz")]
    return tv.select(F.col("tri_id").alias("place"), F.concat_ws("\n", F.lit("0\n3DFACE\n8\n" + layer), *parts).alias("value"))


def dxf_lines(edges: DataFrame, layer: str = "EDGES") -> DataFrame:
    """Edges (xa..zb) as LINE entities; ValueError when there are none."""
    if edges.isEmpty():
        raise ValueError("no edge meets the condition")
    codes = ((10, "xa"), (20, "ya"), (30, "za"), (11, "xb"), (21, "yb"), (31, "zb"))
    return edges.select(F.monotonically_increasing_id().alias("place"), F.concat_ws("\n", F.lit("0\nLINE\n8\n" + layer), *[F.concat(F.lit(f"{c}\n"), F.format_string("%.4f", a)) for c, a in codes]).alias("value"))


def dxf_alignment(segments: DataFrame, layer: str = "ALIGNMENT") -> DataFrame:
    """Lines as LINE, arcs as ARC (counter-clockwise, so right-hand arcs swap their ends); spirals are left out."""
    line = F.concat_ws("\n", F.lit("0\nLINE\n8\n" + layer), *[F.concat(F.lit(f"{c}\n"), F.format_string("%.6f", a)) for c, a in ((10, "x0"), (20, "y0"), (11, "x1"), (21, "y1"))])
    ang = lambda x, y: F.pmod(F.degrees(F.atan2(F.col(y) - F.col("cy"), F.col(x) - F.col("cx"))) + 360.0, F.lit(360.0))
    right = F.col("dir") > 0
    a0, a1 = F.when(right, ang("x1", "y1")).otherwise(ang("x0", "y0")), F.when(right, ang("x0", "y0")).otherwise(ang("x1", "y1"))
    arc = F.concat_ws("\n", F.lit("0\nARC\n8\n" + layer), *[F.concat(F.lit(f"{c}\n"), F.format_string("%.6f", v)) for c, v in ((10, F.col("cx")), (20, F.col("cy")), (40, F.col("radius")), (50, a0), (51, a1))])
    rows = segments.where("kind in ('line', 'arc')")
    return rows.select("align_id", "seq", F.when(F.col("kind") == "line", line).otherwise(arc).alias("value"))


def station_points(xy: DataFrame) -> DataFrame:
    """(align_id, sid, value): `x,y` lines of stations on alignments."""
    return xy.where("x is not null").select("align_id", "sid", F.concat_ws(",", trimmed(F.col("x"), 6), trimmed(F.col("y"), 6)).alias("value"))


def profile_lines(vcurves: DataFrame, true_stations: bool = False) -> DataFrame:
    """(profile_id, seq, value): `station,elevation,length` at the begin of each piece; stations as text or as numbers."""
    sta = trimmed(F.col("begin_sta"), 6) if true_stations else station_text(F.col("begin_sta"))
    el = F.coalesce(trimmed(rounded(F.col("begin_el")), 6), F.lit(""))
    return vcurves.select("profile_id", "seq", F.concat_ws(",", sta, el, trimmed(rounded(F.col("end_sta") - F.col("begin_sta")), 6)).alias("value"))


def probability_lines(bins: DataFrame) -> DataFrame:
    """(bin, value): `upper end,count` of each bin."""
    return bins.select("bin", F.format_string("%.4f,%d", "max_x", "n").alias("value"))


def write_text(rows: DataFrame, path: str, order: list[str], head: list[str] = (), tail: list[str] = ()) -> None:
    """One text file in order. The order is made by a range sort in parallel; rows then stream to the driver one
    partition at a time, so neither a task nor the driver holds the file."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(h + "\n" for h in head)
        for r in rows.orderBy(*order).select("value").toLocalIterator():
            f.write(r["value"] + "\n")
        f.writelines(t + "\n" for t in tail)


def write_dxf(rows: DataFrame, path: str, order: list[str]) -> None:
    write_text(rows, path, order, ["0", "SECTION", "2", "ENTITIES"], ["0", "ENDSEC", "0", "EOF"])


def append_csv(rows: DataFrame, path: str) -> None:
    """A directory of CSV files with headers, added to."""
    rows.write.mode("append").option("header", True).csv(path)


def zip_and_delete(path: str) -> str:
    out = f"{path}.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(path, Path(path).name)
    Path(path).unlink()
    return out
