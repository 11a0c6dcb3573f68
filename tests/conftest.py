import math
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.fixture(scope="session")
def matches():
    """Checks a query's rows against SQL over the same tables."""
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")

    def check(df, sql):
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        want = got.fetchall()
        assert sorted(df.columns) == sorted(names)
        rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        at = sorted(range(len(names)), key=lambda i: names[i])
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want)

    return check
