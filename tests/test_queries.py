"""Every registered query against its SQL on the smallest tables."""

import pytest

from alidade.plans import alignment_queries, source_queries, surface_queries

ALL = surface_queries.Q | alignment_queries.Q | source_queries.Q
SQL = surface_queries.SQL | alignment_queries.SQL | source_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, matches):
    matches(ALL[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_rows_only(name, spark, sf_dir):
    assert ALL[name](spark, sf_dir).count() > 0


def test_hull_and_triangles_of_the_whole_cloud(spark, sf_dir, tmp_path):
    """The hull over more than 400 points by brute force: a point is on it if it ends an edge with all others to the left."""
    import numpy as np

    rng = np.random.default_rng(5)
    xyz = rng.normal(size=(600, 3))
    xyz[500] = (9, 9, 0)  # an outer point behind the first 400
    rows = [(k, [float(v) for v in p], 0) for k, p in enumerate(xyz)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    xy = xyz.astype("float32").astype(float)[:, :2] * 10
    want = set()
    for a in range(len(xy)):
        e, t = xy - xy[a], xy - xy[a]
        side = e[:, :1] * t[:, 1] - e[:, 1:] * t[:, 0]
        side[:, a] = 0
        ends = [b for b in np.flatnonzero((side >= 0).all(axis=1)) if b != a]
        want |= {a, *ends} if ends else set()
    assert {r.point_id for r in ALL["t05_hull2d_cloud"](spark, str(tmp_path)).collect()} == want and 500 in want
