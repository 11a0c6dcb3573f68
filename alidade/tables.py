"""Tables written to the cluster's shared folder between rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="alidade-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str = "round") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written"] = path
    return table


#: Rows of a task where few bytes make a large hash table.
TASK_ROWS = 200_000


def tasks_for(rows: int) -> int:
    """Tasks for so many rows; dealt by a stated number, they are not joined again by their bytes."""
    return max(1, -(-rows // TASK_ROWS))


def drop(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing will read again, also not a plan that was not run yet."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.__dict__.pop("_written"))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
