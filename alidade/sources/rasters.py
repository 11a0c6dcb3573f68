"""ASCII grids: headers, cells, folders of grids pruned by box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.operators import grids

KEYS = {"ncols": "ncols", "nrows": "nrows", "xllcorner": "xll", "yllcorner": "yll", "cellsize": "cellsize", "nodata_value": "nodata"}


def _store(spark: SparkSession, path: str):
    """The Hadoop path and its file system, so that any store the cluster reads will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def grid_files(spark: SparkSession, folder: str) -> list[str]:
    """The .asc files of a folder, by name."""
    at, fs = _store(spark, f"{folder}/*.asc")
    return sorted(f.getPath().toString() for f in fs.globStatus(at) or [])


def read_header(spark: SparkSession, path: str) -> dict:
    """The six header values, from the file's first 4096 bytes alone."""
    head: dict = {"nodata": "-9999"}
    at, fs = _store(spark, path)
    f = fs.open(at)
    try:
        start = bytes(f.readNBytes(4096)).decode("utf-8", "replace")
    finally:
        f.close()
    for line in start.splitlines():
        parts = line.split()
        if len(parts) != 2 or parts[0].lower() not in KEYS:
            break
        name = KEYS[parts[0].lower()]
        head[name] = parts[1] if name == "nodata" else int(parts[1]) if name in ("ncols", "nrows") else float(parts[1])
    return head


def header_box(head: dict, contracted: bool = True) -> tuple[float, float, float, float]:
    """Box of the cell centres (half a cell in from the edges), or of the cells."""
    m = head["cellsize"] / 2 if contracted else 0.0
    return head["xll"] + m, head["yll"] + m, head["xll"] + head["ncols"] * head["cellsize"] - m, head["yll"] + head["nrows"] * head["cellsize"] - m


def _uri(path: Column) -> Column:
    """Local paths are told as file:/ or file:///; both become the first."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def cells_of_files(spark: SparkSession, heads: dict[str, dict]) -> DataFrame:
    """(row, col, z, and the header's values) of the cells of all files, NODATA as NULL, by one scan.

    heads: the header of each path. A split's first value number comes from a first pass that only counts the values of
    each split, so that large files are split and rows may be broken over lines.
    """
    schema = "file string, ncols long, nrows long, xll double, yll double, cellsize double, nodata string"
    uri = lambda p: _store(spark, p)[1].makeQualified(_store(spark, p)[0]).toUri().toString()
    head = spark.createDataFrame([(uri(p), h["ncols"], h["nrows"], h["xll"], h["yll"], h["cellsize"], h["nodata"]) for p, h in heads.items()], schema)
    if not heads:
        return head.select(*[F.lit(None).cast("long").alias(c) for c in ("row", "col")], F.lit(None).cast("double").alias("z"), *head.columns)
    lines = spark.read.text(list(heads)).select("value", _uri(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    values = F.filter(F.split(F.trim("value"), r"\s+"), lambda v: v != "")
    lines = lines.where(~F.col("value").rlike(r"^\s*[A-Za-z_]")).select("file", "split", "id", values.alias("v"))
    # a row for each split of each file
    per = lines.groupBy("file", "split").agg(F.sum(F.size("v")).alias("n"))
    ahead = lambda keys, order: F.coalesce(F.sum(F.col("n")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "split", ahead(["file"], "split").alias("base"))
    lines = lines.withColumn("n", F.size("v")).withColumn("before", ahead(["file", "split"], "id"))
    cells = lines.join(per, ["file", "split"]).select("file", (F.col("base") + F.col("before")).alias("at"), F.posexplode("v").alias("k", "t"))
    cells = cells.join(head.withColumn("file", _uri(F.col("file"))), "file")
    n = F.col("at") + F.col("k")
    z = F.when(F.col("t") != F.col("nodata"), F.col("t").try_cast("double"))
    return cells.select(F.floor(n / F.col("ncols")).alias("row"), (n % F.col("ncols")).alias("col"), z.alias("z"), *head.columns)


def _centred(cells: DataFrame) -> DataFrame:
    head = {name: F.col(name) for name in ("ncols", "nrows", "xll", "yll", "cellsize")}
    return grids.cell_centres(cells, head).where("z is not null")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, z) with NODATA as NULL."""
    return cells_of_files(spark, {path: read_header(spark, path)}).select("row", "col", "z")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Cell centres with a value, as (row, col, x, y, z)."""
    return _centred(cells_of_files(spark, {path: read_header(spark, path)})).select("row", "col", "x", "y", "z")


def read_folder(spark: SparkSession, folder: str, box: tuple | None = None) -> DataFrame:
    """Points (x, y, z) of all .asc files whose box, widened by a cell, meets `box`, within `box` widened by a cell.

    Other files are not opened beyond the header. A folder without such files gives no rows.
    """
    heads = {path: read_header(spark, path) for path in grid_files(spark, folder)}
    if box is None:
        return _centred(cells_of_files(spark, heads)).select("x", "y", "z")

    def meets(head: dict) -> bool:
        b, m = header_box(head), head["cellsize"]
        return b[0] - m <= box[2] and box[0] <= b[2] + m and b[1] - m <= box[3] and box[1] <= b[3] + m

    pts = _centred(cells_of_files(spark, {path: h for path, h in heads.items() if meets(h)}))
    m = F.col("cellsize")
    return pts.where(F.col("x").between(box[0] - m, box[2] + m) & F.col("y").between(box[1] - m, box[3] + m)).select("x", "y", "z")


def peak_cell_size(spark: SparkSession, folder: str) -> float:
    return max((read_header(spark, p)["cellsize"] for p in grid_files(spark, folder)), default=0.0)
