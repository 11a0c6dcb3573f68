"""Headline queries, warm second run: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.operators import decimate, hull, profile, stats
from alidade.operators import surface as s
from alidade.plans import alignment_queries as aq
from alidade.plans import fixtures as x
from alidade.tables import written

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Side of the bench lattice: the fixture's 16 points squared grow with the tables.
SIDE = 160


def sink(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    points = written(x.lattice_points(spark, SF_DIR, SIDE))
    tv = written(s.with_vertices(x.lattice_triangles(spark, SIDE), points))
    probes = spark.range(2_000_000).select(F.col("id").alias("qid"), (F.rand(1) * 4 * SIDE).alias("px"), (F.rand(2) * 4 * SIDE).alias("py"))
    cloud = x.cloud(spark, SF_DIR).withColumn("point_id", F.col("seq"))
    spread = written(spark.range(60_000).select(F.col("id").alias("point_id"), F.rand(3).alias("x"), F.rand(4).alias("y")))
    none = spark.createDataFrame([], "point_id long")
    queries = {
        "q04_locate_2m": lambda: s.point_results(probes, tv),
        "j07_adjacency": lambda: s.edges(tv),
        "q10_point_measures": lambda: s.point_measures(tv, none),
        "g08_histogram": lambda: stats.histogram(s.point_measures(tv, none), "sparsity", 50),
        "p16_cut": lambda: profile.cut(tv, points, aq.route(spark), 8.0),
        "t03_delaunay": lambda: hull.delaunay(cloud.select("point_id", "x", "y", "z")),
        "t03_levels_60k": lambda: hull.delaunay(spread, tile_points=10_000),
        "m07_random_thinning": lambda: decimate.kept(decimate.random_p(points, none, 0.5)),
        "p06_back_ahead": lambda: aq.Q["p06_back_ahead"](spark, SF_DIR),
        "a17_station_to_xy": lambda: aq.Q["a17_station_to_xy"](spark, SF_DIR),
    }
    took = {}
    for name, q in queries.items():
        sink(q())
        began = time.perf_counter()
        sink(q())
        took[name] = round(time.perf_counter() - began, 3)
    rate = round(2_000_000 / took["q04_locate_2m"])
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "locate_rows_per_s": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
