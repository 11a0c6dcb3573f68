"""Order, fits and reachability where distributions are far from even, and the hook for likelihoods."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alidade.operators import components as co
from alidade.operators import decimate, slices, stats
from alidade.operators import surface as s
from alidade.plans import fixtures as x


@pytest.fixture(scope="module")
def outlying(spark):
    """20,000 values close together and one far off."""
    rnd = random.Random(3)
    values = [rnd.gauss(0, 1) for _ in range(20_000)] + [1e12]
    return values, spark.createDataFrame([(k, v) for k, v in enumerate(values)], "point_id long, v double").repartition(7)


def test_an_outlier_leaves_no_large_slice(outlying):
    values, rows = outlying
    splits = slices.splitters(rows, "v")
    sizes = [r["count"] for r in rows.groupBy(slices.slice_of(F.col("v"), splits)).count().collect()]
    assert max(sizes) <= 2 * len(values) / slices.SLICES + 2
    cells = [r.cell for r in rows.orderBy("v").select(slices.slice_of(F.col("v"), splits).alias("cell")).collect()]
    assert cells == [int(c) for c in np.searchsorted(splits, sorted(values), side="right")]


def test_places_and_ranks_with_an_outlier(outlying):
    values, rows = outlying
    assert [r.place for r in decimate.numbered(rows, "v").orderBy("v").collect()] == list(range(len(values)))
    n = F.col("n")
    got = stats.order_statistic(rows, "v", {"least": n * 0, "middle": F.floor(n / 2), "most": n - 1}).first()
    want = sorted(values)
    assert (got.n, got.least, got.middle, got.most) == (len(want), want[0], want[len(want) // 2], 1e12)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "v double, k string")
    assert stats.order_statistic(none, "v", {"least": F.col("n") * 0}).first().least is None
    assert stats.order_statistic(none, "v", {"least": F.col("n") * 0}, ["k"]).count() == 0
    assert decimate.numbered(none, "v").count() == 0


def test_fit_over_slices(spark):
    """More rows than a fit took once, repeated ones among them; signed areas by NumPy."""
    rnd = random.Random(4)
    xy = sorted((rnd.randint(0, 60_000) / 100, rnd.randint(0, 50) / 10) for _ in range(110_000))
    rows = spark.createDataFrame(xy, "x double, y double").repartition(6)
    model = lambda x, a, b: a * x + b
    got = {(r.a, r.b): r.error for r in stats.fit_errors(rows, stats.fit_grid(spark, (0.0, 1.0), (0.0, 2.0), 3), model).collect()}
    x, y = np.array(xy).T
    assert len(got) == 9
    for (a, b), error in got.items():
        e = a * x + b - y
        dx, before = np.diff(x, prepend=0.0), np.concatenate([[0.0], e[:-1]])
        assert math.isclose(error, (dx * (e + before) / 2).sum() / dx.sum(), rel_tol=1e-9, abs_tol=1e-9)


def test_a_long_chain_in_few_rounds(spark, monkeypatch):
    """A chain of 3,000 nodes in random order, reached from one end; another chain without a seed stays."""
    rnd = random.Random(5)
    ids = rnd.sample(range(10**9), 3_100)
    links = [(a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if k != 2_999]
    rounds = []
    write = co.written
    monkeypatch.setattr(co, "written", lambda df, tag="round": rounds.append(tag) or write(df, tag))
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node for r in s.reached(spark.createDataFrame([(ids[0],), (-7,)], "node long"), table).collect()}
    assert got == set(ids[:3_000]) | {-7} and len(rounds) < 20
    assert s.reached(table.select(F.col("a").alias("node")).limit(0), table).count() == 0
    assert s.reached(spark.createDataFrame([(1,)], "node long"), table.limit(0)).collect()[0].node == 1


def test_a_likelihood_of_the_callers(spark, sf_dir):
    """Any table of scores from measures steers the thinning: all points the same here, and the mean meets the share."""
    p, tv = x.lattice(spark, sf_dir)
    tv = tv.withColumn("is_valid", F.lit(True))
    hull = s.hull_points(tv)
    even = lambda measures: measures.select("point_id", F.lit(0.5).alias("score"))
    rows = decimate.smart(p, tv, hull, 0.6, 0.3, even).collect()
    rest = {r.p for r in rows if r.p < 1}
    assert len(rest) == 1 and len(rows) == p.count()
    assert sum(r.p for r in rows) == pytest.approx(math.floor(0.6 * len(rows)), abs=0.1)
