"""LAS point clouds: a Spark data source with record-range partitions, and a writer for selected records."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "seq long, x double, y double, z double, classification int"
#: Bytes of a point record by format, up to which this reader looks (fixed values).
LEAST_RECORD = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


def read_header(data: bytes) -> dict:
    """The public header block of a LAS 1.2 to 1.4 file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    size, offset = struct.unpack_from("<HI", data, 94)
    fmt, length, legacy = struct.unpack_from("<BHI", data, 104)
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack_from("<6d", data, 179)
    count = struct.unpack_from("<Q", data, 247)[0] if size >= 375 else legacy
    return {"version": (major, minor), "header_size": size, "offset": offset, "format": fmt & 0x3F, "record": length, "count": count or legacy, "scale": scale, "shift": shift, "low": (xmin, ymin, zmin), "high": (xmax, ymax, zmax)}


def read_records(f, head: dict, first: int, n: int) -> np.ndarray:
    """Columns (x, y, z, class) of n records from the first; the data offset is honoured, so VLRs may come before."""
    f.seek(head["offset"] + first * head["record"])
    at = 15 if head["format"] < 6 else 16
    kind = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, at], "itemsize": head["record"]})
    raw = np.frombuffer(f.read(n * head["record"]), dtype=kind)
    return raw


class _Slice(InputPartition):
    def __init__(self, path: str, first: int, n: int):
        self.path, self.first, self.n = path, first, n


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        wanted = options.get("classes", "")
        self.classes = [int(c) for c in wanted.replace(",", " ").split()]
        self.rows = int(options.get("rowspersplit", "1000000"))

    def partitions(self):
        with open(self.path, "rb") as f:
            self.head = read_header(f.read(400))
        n = self.head["count"]
        return [_Slice(self.path, k, min(self.rows, n - k)) for k in range(0, n, self.rows)] or [_Slice(self.path, 0, 0)]

    def read(self, part):
        with open(part.path, "rb") as f:
            head = read_header(f.read(400))
            for k in range(part.first, part.first + part.n, 65536):
                raw = read_records(f, head, k, min(65536, part.first + part.n - k))
                seq = np.arange(k, k + len(raw))
                cls = raw["c"] & 0x1F if head["format"] < 6 else raw["c"]
                xyz = [raw[a] * s + o for a, s, o in zip("xyz", head["scale"], head["shift"])]
                keep = np.isin(cls, self.classes) if self.classes else np.ones(len(raw), bool)
                arrays = [pa.array(seq[keep], pa.int64()), *[pa.array(v[keep], pa.float64()) for v in xyz], pa.array(cls[keep].astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["seq", "x", "y", "z", "classification"])


class LasDataSource(DataSource):
    """spark.read.format("las").option("classes", "2,13").load(path): points with the class filter in the reader."""

    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(self.options)


def read_las(spark: SparkSession, path: str, classes: list[int] | None = None, rows_per_split: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").option("classes", " ".join(map(str, classes or []))).option("rowsPerSplit", rows_per_split).load(path)


def _runs(batches):
    """Sorted record numbers as runs (first, n) of neighbours."""
    for pdf in batches:
        seq = pdf["seq"].to_numpy()
        if len(seq):
            cut = np.flatnonzero(np.diff(seq) != 1) + 1
            yield pd.DataFrame({"first": seq[np.r_[0, cut]], "n": np.diff(np.r_[0, cut, len(seq)])})


def write_las(points: DataFrame, template: str, out: str, block: int = 65536) -> int:
    """A LAS file with the template's header, VLRs and the records whose seq is in points, in order; returns the count.

    The numbers are sorted and joined to runs of neighbours in parallel; the runs stream to the writer, one partition
    at a time, which copies up to `block` records at once.
    """
    with open(template, "rb") as src, open(out, "wb") as dst:
        head = read_header(src.read(400))
        src.seek(0)
        dst.write(src.read(head["offset"]))
        n = 0
        for run in points.select("seq").orderBy("seq").mapInPandas(_runs, "first long, n long").toLocalIterator():
            src.seek(head["offset"] + run["first"] * head["record"])
            for k in range(0, run["n"], block):
                dst.write(src.read(min(block, run["n"] - k) * head["record"]))
            n += run["n"]
        dst.seek(107)
        dst.write(struct.pack("<I", n if head["format"] < 6 and n < 2**32 else 0))
        if head["header_size"] >= 375:
            dst.seek(247)
            dst.write(struct.pack("<Q", n))
    return n


def header_bytes(n: int, low: list[float], high: list[float], scale: float, fmt: int = 6, vlr: int = 0) -> bytes:
    """A LAS 1.4 header for n records within low and high, after which come so many bytes of VLRs."""
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24], head[25] = 1, 4
    struct.pack_into("<HI", head, 94, 375, 375 + vlr)
    struct.pack_into("<BHI", head, 104, fmt, LEAST_RECORD[fmt], 0)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<6d", head, 179, *[v for pair in zip(high, low) for v in pair])
    struct.pack_into("<Q", head, 247, n)
    return bytes(head)


def record_bytes(x, y, z, classes, scale: float, fmt: int = 6) -> bytes:
    """Point records: scaled coordinates and the class, the rest zero."""
    kind = np.dtype({"names": ["x", "y", "z", "c"], "formats": ["<i4", "<i4", "<i4", "u1"], "offsets": [0, 4, 8, 15 if fmt < 6 else 16], "itemsize": LEAST_RECORD[fmt]})
    rec = np.zeros(len(x), dtype=kind)
    for a, v in zip("xyz", (x, y, z)):
        rec[a] = np.round(np.asarray(v) / scale)
    rec["c"] = classes
    return rec.tobytes()


def make_las(path: str, x, y, z, classes, scale: float = 0.01, fmt: int = 6, vlr: bytes = b"") -> None:
    """A small LAS 1.4 file (for tests and examples)."""
    with open(path, "wb") as f:
        f.write(header_bytes(len(x), [min(x), min(y), min(z)], [max(x), max(y), max(z)], scale, fmt, len(vlr)) + vlr + record_bytes(x, y, z, classes, scale, fmt))


def write_cloud(points: DataFrame, out: str, scale: float = 0.01) -> int:
    """A new LAS 1.4 file of points (seq, x, y, z, classification) in order of seq; returns the count.

    Coordinates are rounded to `scale`. Records are encoded in Arrow batches in parallel and stream to the writer one
    partition at a time. An empty table gives a file without records.
    """
    box = points.agg(F.count("*"), *[f(a) for f in (F.min, F.max) for a in "xyz"]).first()

    def pack(batches):
        for b in batches:
            x, y, z, c = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array([record_bytes(x, y, z, c, scale)], pa.binary())], ["data"])

    rows = points.orderBy("seq").select("x", "y", "z", "classification").mapInArrow(pack, "data binary")
    with open(out, "wb") as f:
        f.write(header_bytes(box[0], [v or 0.0 for v in box[1:4]], [v or 0.0 for v in box[4:7]], scale))
        for r in rows.toLocalIterator():
            f.write(r["data"])
    return box[0]
