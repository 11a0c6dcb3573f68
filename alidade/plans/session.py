"""The command language: a session whose commands load, query, thin and export surfaces and alignments."""

from __future__ import annotations

import logging
import shutil
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.functions.vectors import in_box
from alidade.operators import alignment as al
from alidade.operators import decimate, grids, hull, profile, stats
from alidade.operators import surface as s
from alidade.sources import las, rasters, sinks, texts
from alidade.tables import written

log = logging.getLogger("alidade")


@dataclass
class Surface:
    """Points (point_id, seq, x, y, z, classification), triangles with vertices, and points that thinning set aside."""

    points: DataFrame
    tv: DataFrame
    unused: DataFrame | None = None
    source: str = ""

    def elevations(self, queries: DataFrame) -> DataFrame:
        return s.point_results(queries, self.tv)


def build(points: DataFrame, skip: int = 0, prune: bool = True) -> Surface:
    """Points (seq, x, y, z, classification) to a surface: sample, collapse near-duplicates, triangulate, prune, mark."""
    pts = decimate.every_nth(points, skip)
    used = s.deduplicated(pts.where("used").drop("used")).drop("kx", "ky")
    used = written(decimate.numbered(used.withColumn("seq", F.xxhash64("x", "y", "z")), "seq", "point_id"), "points")
    tri = hull.delaunay(used.select("point_id", "x", "y", "z"))
    tv = written(s.with_vertices(tri, used), "triangles")
    tv = s.marked(tv, s.pruned(tv)) if prune else tv.withColumn("is_valid", F.lit(True))
    return Surface(used, written(tv.where("is_valid"), "valid"), pts.where("not used").drop("used"))


def save(surface: Surface, folder: str) -> None:
    """Three Parquet tables."""
    surface.points.write.mode("overwrite").parquet(f"{folder}/points")
    surface.tv.write.mode("overwrite").parquet(f"{folder}/triangles")
    if surface.unused is not None:
        surface.unused.write.mode("overwrite").parquet(f"{folder}/unused")


def load(spark: SparkSession, folder: str) -> Surface:
    unused = spark.read.parquet(f"{folder}/unused") if Path(folder, "unused").exists() else None
    return Surface(spark.read.parquet(f"{folder}/points"), spark.read.parquet(f"{folder}/triangles"), unused, folder)


def from_file(spark: SparkSession, path: str) -> Surface:
    """A surface by its file's extension: .las, .asc, .xyz, .txt, .xml, .wrl, or a folder of Parquet tables."""
    kind = Path(path).suffix.lower()
    if kind in (".xml", ".wrl"):
        p, t = texts.read_landxml(spark, path) if kind == ".xml" else texts.read_vrml(spark, path)
        return Surface(p, written(s.with_vertices(t, p).withColumn("is_valid", F.lit(True))), None, path)
    if kind == ".las":
        return build(las.read_las(spark, path, [2, 13]))
    if kind == ".asc":
        return raster_surface(spark, path)
    if kind in (".xyz", ".txt"):
        return build(texts.read_xyz(spark, path).withColumns({"seq": F.monotonically_increasing_id(), "classification": F.lit(0)}))
    if kind == "":
        return load(spark, path)
    raise ValueError(f"no reader for {kind}")


def raster_surface(spark: SparkSession, path: str) -> Surface:
    """Two triangles per cell square, always on the same diagonal; squares with a missing corner are left out."""
    head = rasters.read_header(spark, path)
    n = head["ncols"]
    p = written(rasters.read_points(spark, path).select((F.col("row") * n + F.col("col")).alias("point_id"), "x", "y", "z"))
    ids = F.col("point_id")
    c = p.where(ids % n < n - 1).select(F.explode(F.array(F.struct((ids * 2).alias("tri_id"), ids.alias("p1"), (ids + n).alias("p2"), (ids + n + 1).alias("p3")), F.struct((ids * 2 + 1).alias("tri_id"), ids.alias("p1"), (ids + n + 1).alias("p2"), (ids + 1).alias("p3")))).alias("t")).select("t.*")
    tv = s.with_vertices(c, p).withColumn("is_valid", F.lit(True))
    return Surface(p.withColumn("seq", F.col("point_id")), written(tv), None, path)


def _times(flags) -> int:
    return next((int(x[2:]) for x in flags if x.startswith("-x")), 1)


@dataclass
class Session:
    """State between commands, and the commands by name."""

    spark: SparkSession
    directory: str = "."
    out: str = "."
    classes: list[int] = field(default_factory=lambda: [2, 11])
    box: tuple | None = None
    surface: Surface | None = None
    derived: Surface | None = None
    segments: DataFrame | None = None
    regions: DataFrame | None = None
    stats_path: str | None = None
    #: What `decimate` makes likelihoods of, from point measures.
    likelihood: Callable[[DataFrame], DataFrame] = decimate.scores
    grid_spacing: float | None = None
    zero: bool = False
    done: bool = False

    def _in(self, name: str) -> str:
        return name if Path(name).is_absolute() else str(Path(self.directory, name))

    def _out(self, name: str) -> str:
        return name if Path(name).is_absolute() else str(Path(self.out, name))

    def _surface(self) -> Surface:
        found = self.derived or self.surface
        if found is None:
            raise ValueError("no surface is loaded")
        return found

    def _moved(self, points: DataFrame) -> DataFrame:
        return grids.centred(points) if self.zero else points

    def run(self, text: str) -> list[str]:
        """Runs command lines; returns what they print. An unknown verb or a failing command is told, and the next runs."""
        said = []
        for verb, *args in texts.parse_commands(text):
            f = getattr(self, f"do_{verb.lower()}", None)
            if f is None:
                said.append(f"unknown command: {verb}")
                continue
            try:
                said.append(str(f(*args) or ""))
            except Exception as e:  # a console tells what failed and goes on
                said.append(f"{verb}: {str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__}")
            log.info("%s: %s", verb, said[-1])
            if self.done:
                break
        return said

    def do_exit(self):
        self.done = True

    do_quit = do_exit

    def do_print(self, *words):
        return " ".join(words)

    def do_log(self, path: str = "stop", *_):
        for h in list(log.handlers):
            log.removeHandler(h)
        if path not in ("stop", "reset"):
            log.addHandler(logging.FileHandler(self._out(path)))
            log.setLevel(logging.INFO)

    def do_set_dir(self, folder: str):
        self.directory = folder

    def do_set_outdir(self, folder: str):
        self.out = folder

    def do_set_bounding_box(self, *numbers):
        self.box = tuple(map(float, numbers)) if numbers else None

    def do_set_filter(self, *classes):
        self.classes = [int(c) for c in classes]

    def do_transform_to_zero(self, flag: str):
        self.zero = flag.lower() == "true"

    def _las(self, name: str) -> DataFrame:
        p = las.read_las(self.spark, self._in(name), self.classes)
        return p.where(in_box(F.col("x"), F.col("y"), self.box))

    def do_point_count(self, name: str):
        return self._las(name).count()

    def do_load(self, name: str, skip: str = "0"):
        if name.lower().endswith(".las"):
            self.surface, self.derived = build(self._las(name), int(skip)), None
        else:
            self.surface, self.derived = from_file(self.spark, self._in(name)), None

    do_load_las = do_load
    do_reload = do_load

    def do_load_raster(self, name: str):
        self.surface, self.derived = raster_surface(self.spark, self._in(name)), None

    def do_load_rasters(self, folder: str, *flags):
        box = self.box
        if "-bb" in flags and self.segments is not None:
            b = al.alignments_box(self.segments).first()
            box = tuple(b)
        pts = rasters.read_folder(self.spark, self._in(folder), box)
        self.surface, self.derived = build(pts.withColumns({"seq": F.xxhash64("x", "y"), "classification": F.lit(0)})), None
        # raster neighbours that lie far apart are no neighbours: long outer edges go
        longest = 1.8 * rasters.peak_cell_size(self.spark, self._in(folder))
        gone = s.dissolved(self.surface.tv, self.surface.points, longest)
        self.surface.tv = written(self.surface.tv.join(gone, "tri_id", "left_anti"))

    def do_summarize(self):
        f = self._surface()
        return stats.summary(f.points, f.tv)

    def do_to_las(self, template: str, name: str):
        return las.write_las(self._surface().points, self._in(template), self._out(name))

    def do_to_xyz(self, name: str, *flags):
        rows = self._moved(self._surface().points)
        sinks.write_text(rows.select("point_id", sinks.F.format_string("%.2f,%.2f,%.2f", "x", "y", "z").alias("value")), self._out(name), ["point_id"])
        return self._zipped(name, flags)

    def _zipped(self, name: str, flags):
        return sinks.zip_and_delete(self._out(name)) if "-zipped" in flags else self._out(name)

    def do_to_obj(self, name: str, *flags):
        f = self._surface()
        pts = f.points.withColumn("seq", F.col("point_id"))
        ranked = decimate.numbered(pts, "point_id", "place")
        rows = sinks.obj_lines(self._moved(ranked.withColumn("seq", F.col("place"))), self._renumbered(f, ranked))
        sinks.write_text(rows, self._out(name), ["kind", "place"])
        return self._zipped(name, flags)

    def _renumbered(self, f: Surface, ranked: DataFrame) -> DataFrame:
        t = f.tv.select("tri_id", "p1", "p2", "p3")
        for k in (1, 2, 3):
            t = t.join(ranked.select(F.col("point_id").alias(f"p{k}"), F.col("place").alias(f"q{k}")), f"p{k}")
        return t.select("tri_id", *[F.col(f"q{k}").alias(f"p{k}") for k in (1, 2, 3)])

    def do_points_to_dxf(self, name: str, *flags):
        sinks.write_dxf(sinks.dxf_points(self._moved(self._surface().points)), self._out(name), ["place"])
        return self._zipped(name, flags)

    def do_tin_to_dxf(self, name: str, *flags):
        sinks.write_dxf(sinks.dxf_faces(self._surface().tv), self._out(name), ["place"])
        return self._zipped(name, flags)

    def do_output_lines(self, name: str = "lines.dxf", least: str = "3.05"):
        f = self._surface()
        e = s.dihedrals(s.edges(f.tv), f.tv).where(F.col("dihedral") > float(least))
        sinks.write_dxf(sinks.dxf_lines(s.edge_lengths(e, f.points)), self._out(name), ["place"])

    def do_save_stats(self, name: str, *flags):
        """Statistics of later thinnings are appended here; `reset` starts anew."""
        self.stats_path = self._out(name)
        if "reset" in flags:
            shutil.rmtree(self.stats_path, ignore_errors=True)

    def _main(self) -> Surface:
        """The loaded surface: thinnings start from it, not from an earlier thinning."""
        if self.surface is None:
            raise ValueError("no surface is loaded")
        return self.surface

    def _thin(self, probability: DataFrame, seed: int):
        kept = decimate.kept(probability.select("point_id", "p"), seed=seed)
        rows = self._main().points.join(kept.select("point_id", "used"), "point_id")
        cols = ["seq", "x", "y", "z", "classification"]
        pts = rows.withColumn("classification", F.lit(0)) if "classification" not in rows.columns else rows
        self.derived = build(pts.where("used").select(*cols))
        self.derived.unused = written(pts.where("not used").select("point_id", *cols))
        if self.stats_path:
            sinks.append_csv(self.errors(), self.stats_path)

    def do_decimate(self, share: str, *flags):
        """-sN is the share that folds decide, -xN thins N times with other draws."""
        f = self._main()
        split = next((float(x[2:]) for x in flags if x.startswith("-s")), 0.5)
        p = decimate.smart(f.points, f.tv, s.hull_points(f.tv.withColumn("is_valid", F.lit(True))), float(share), split, self.likelihood)
        for k in range(_times(flags)):
            self._thin(p, k + 1)

    def do_decimate_random(self, share: str, *flags):
        f = self._main()
        p = decimate.random_p(f.points, s.hull_points(f.tv.withColumn("is_valid", F.lit(True))), float(share))
        for k in range(_times(flags)):
            self._thin(p, k + 1)

    def do_decimate_multiple(self, name: str, *skips):
        """The same file at several skips; statistics are appended for each."""
        for k in skips or ("1", "2", "3"):
            self.do_load(name, k)
            if self.stats_path:
                sinks.append_csv(self.errors().withColumn("skip", F.lit(int(k))), self.stats_path)

    def errors(self) -> DataFrame:
        f = self._surface()
        if f.unused is None:
            raise ValueError("no points were set aside")
        q = f.unused.select(F.monotonically_increasing_id().alias("qid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
        return stats.error_stats(written(q), f.tv)

    def do_histogram(self, what: str, bins: str, name: str, cap: str | None = None):
        if what != "sparsity":
            raise ValueError("only sparsity is counted")
        f = self._surface()
        m = s.point_measures(f.tv, s.hull_points(f.tv.withColumn("is_valid", F.lit(True))))
        h = stats.histogram(m, "sparsity", int(bins), float(cap) if cap else None)
        rows = h.select("bin", F.format_string("%.5f,%.5f,%d", "min_x", "max_x", "n").alias("value"))
        sinks.write_text(rows, self._out(name), ["bin"])

    def do_set_sample_grid(self, spacing: str):
        self.grid_spacing = float(spacing)

    def do_save_grid_to_raster(self, name: str):
        f = self._surface()
        if not self.grid_spacing:
            raise ValueError("set_sample_grid comes first")
        box = grids.box_of(f.points)
        g = grids.sample_grid(self.spark, box, self.grid_spacing)
        hit = s.locate(g.select(F.struct("row", "col").alias("qid"), F.col("x").alias("px"), F.col("y").alias("py")), f.tv)
        cells = hit.select("qid.row", "qid.col", s.elevation(F.col("px"), F.col("py")).alias("z"))
        size = g.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
        head = {"ncols": size["c"] + 1, "nrows": size["r"] + 1, "xll": box[0] - self.grid_spacing / 2, "yll": box[1] - self.grid_spacing / 2, "cellsize": self.grid_spacing}
        rows = sinks.asc_rows(cells).withColumn("row", -F.col("row"))
        sinks.write_text(rows, self._out(name), ["row"], sinks.asc_head(head))

    def do_load_alignment(self, name: str):
        """Segments of one file, and its regions, by which stations are then numbered. Says how far the end is off, if it is."""
        self.segments = written(al.chain(*texts.read_alignment_csv(self.spark, self._in(name), Path(name).stem)))
        regions, ends = texts.read_alignment_regions(self.spark, self._in(name), Path(name).stem)
        self.regions = regions if regions.count() else None
        off = al.end_checks(self.segments, ends).where("miss > 0.01 or abs(azimuth_miss) > 0.001 or abs(station_miss) > 0.01").first()
        if off:
            return f"the end is {off['miss']:.3f} off, its azimuth {off['azimuth_miss']:.4f}"

    def do_load_alignments(self, name: str, *flags):
        """Alignments of a feature file; their stations run from what CLDIST says."""
        pts, _ = texts.read_esri_json(self.spark, self._in(name))
        self.segments, self.regions = written(al.lines_from_points(pts)), None
        if "-list" in flags:
            return "\n".join(r["align_id"] for r in self.segments.select("align_id").distinct().orderBy("align_id").collect())

    def do_profile_to_csv(self, name: str, *flags):
        """Where the alignments cross surface edges, or at increments (-inc=d); -truestation writes plain numbers."""
        f = self._surface()
        if self.segments is None:
            raise ValueError("no alignment is loaded")
        step = next((float(x[5:]) for x in flags if x.startswith("-inc=")), None)
        if step:
            xy = al.station_to_xy(al.stations_at(self.segments, step).withColumn("offset", F.lit(0.0)), self.segments)
            rows = profile.cut_at(f.tv, xy).select("align_id", F.col("sta").alias("station"), "elevation").where("elevation is not null")
        else:
            rows = profile.cut(f.tv, f.points, self.segments, s.cell_size(f.tv))
        sta = F.format_string("%.3f", "station") if "-truestation" in flags else al.station_text(F.col("station"))
        if self.regions is not None and "-truestation" not in flags:
            rows = al.region_stations(rows, self.segments, self.regions)
            sta = al.station_text(F.col("sta"), F.col("region"), F.col("extended"))
        out = rows.select("align_id", "station", F.concat_ws(",", sta, F.format_string("%.3f", "elevation")).alias("value"))
        sinks.write_text(out, self._out(name), ["align_id", "station"])

    def do_profiles_to_csvs(self, infix: str = "-nameInfix="):
        """One file per alignment."""
        tag = infix.split("=", 1)[-1]
        every = self.segments
        for r in every.select("align_id").distinct().orderBy("align_id").toLocalIterator():
            self.segments = every.where(F.col("align_id") == F.lit(r["align_id"]))
            self.do_profile_to_csv(f"{r['align_id']}{tag}.csv")
        self.segments = every

    def do_alignment_to_dxf(self, name: str):
        sinks.write_dxf(sinks.dxf_alignment(self.segments), self._out(name), ["align_id", "seq"])

    def do_performance_test(self, n: str = "1000000"):
        """Random elevation look-ups inside the surface's box."""
        f = self._surface()
        b = grids.box_of(f.points)
        q = self.spark.range(int(n)).select(F.col("id").alias("qid"), (F.lit(b[0]) + F.rand(12345) * (b[2] - b[0])).alias("px"), (F.lit(b[1]) + F.rand(54321) * (b[3] - b[1])).alias("py"))
        began = time.time()
        hits = f.elevations(q).where("elevation is not null").count()
        return f"{hits} of {n} in {time.time() - began:.2f} s"
