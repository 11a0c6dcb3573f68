"""Shared plumbing: tables written to the cluster's shared folder, connected components, column hygiene."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java / RE2 / Python class of a word: everything but blank and the controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Join keys up to this many rows are broadcast (a few tens of MB); more of them are joined by a shuffle.
BROADCAST_KEYS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may go without one and gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="alidade-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Set while a table is written: the shuffles of a finished write are removed at once, as nothing reads them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written"] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.__dict__.pop("_written"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words in text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside a lambda, a plain column expression is evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sized(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def semi_by_size(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose key is in keys: keys of a counted, bounded size are broadcast, others are joined by a shuffle."""
    return df.join(_sized(keys), on, "left_semi")


def join_by_size(df: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in the same way; a row of `rows` is small (a few numbers per wanted line of one document)."""
    return df.join(_sized(rows), on)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): one row (id, root) per vertex, root the least id.

    Alternates large-star and small-star steps; each is a partial minimum per vertex and an equi-join that AQE can
    split, and each round is written to the shared folder in place of the one before, so no component is ever gathered
    in one place. Null ends and self-loops link nothing; no edges give no rows.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(e.distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("u", F.col("m").alias("v")))
        before, e = e, written(small.distinct(), "edges")
        drop(before)
    rows = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return rows.union(rows.select(F.col("root").alias("id"), "root").distinct())
