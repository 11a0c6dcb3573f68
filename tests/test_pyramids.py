"""Descents and look-ups that must not meet every row: against all pairs, and by what they touch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from alidade.operators import alignment as al
from alidade.operators import profile as pr
from alidade.operators import pyramid
from alidade.operators.ranges import lookup


def test_intervals_of_all_lengths(spark):
    """One interval of 1e12 among 20,000 short ones: all pairs are found, and no cell holds more than a few intervals."""
    rng = random.Random(2)
    rows = [(1, k, float(k), k + rng.choice([0.0, 0.25, 1.0, 3.0])) for k in range(20000)] + [(1, -1, -1e9, 1e12 - 1e9), (2, -2, 0.0, 1e-9), (2, -3, 5.0, 4.0)]
    probes = [(1, k, rng.uniform(-10, 20010)) for k in range(300)] + [(1, 900, 7.0), (2, 901, 0.0), (2, 902, 4.5), (3, 903, 1.0), (1, 904, 5e11)]
    i = spark.createDataFrame(rows, "g int, i int, lo double, hi double")
    p = spark.createDataFrame(probes, "g int, p int, at double")
    got = {(r.p, r.i) for r in lookup(p, "at", i, "lo", "hi", ["g"], F.expr("at >= lo and at <= hi")).collect()}
    assert got == {(q, k) for g, q, at in probes for h, k, lo, hi in rows if g == h and lo <= at <= hi}
    met = lookup(p, "at", i, "lo", "hi", ["g"], F.lit(True)).groupBy("p").count().agg(F.max("count")).first()[0]
    assert met <= 30


def wiggly(spark, n, turn):
    """n elements: lines, arcs to both sides and spirals by turns."""
    rows = []
    for k in range(n):
        d = turn * (1 if k % 8 < 4 else -1)
        rows.append((1, k, *[(0.0, 7.0, 0.0), (0.0, 9.0, d), (d, 11.0, d), (d, 9.0, 0.0)][k % 4]))
    e = spark.createDataFrame(rows, "align_id long, seq int, degree_in double, length double, degree_out double")
    h = spark.createDataFrame([(1, 10.0, -5.0, 0.0, 70.0)], "align_id long, x double, y double, station double, azimuth_deg double")
    return al.chain(e, h).cache()


@pytest.mark.parametrize("turn", [0.0, 300.0])
def test_projection_meets_few_segments(turn, spark, monkeypatch):
    rng = random.Random(5)
    seg = wiggly(spark, 400, turn)
    ends = [(r.x1, r.y1) for r in seg.collect()]
    pts = [(1, k, x + rng.gauss(0, 15), y + rng.gauss(0, 15)) for k, (x, y) in enumerate(rng.sample(ends, 120))]
    p = spark.createDataFrame(pts, "align_id long, pid int, px double, py double").cache()
    key = lambda df: sorted((r.pid, r.seq, round(r.sta, 6), round(r.off, 6)) for r in df.collect())
    found = key(al.xy_to_station(p, seg)), key(al.spiral_to_station(p, seg))
    met = al._projecting(p, seg).count()
    monkeypatch.setattr(pyramid, "FAN", 1 << 30)  # one level: every point meets every segment
    assert found == (key(al.xy_to_station(p, seg)), key(al.spiral_to_station(p, seg)))
    feet = sum(map(len, found))
    assert feet >= 100 and met <= 4 * feet + 120 and al._projecting(p, seg).count() >= met


def test_rays_meet_few_curves(spark, monkeypatch):
    rng = random.Random(6)
    vpis = [(1, 100.0 * k, 50 * math.sin(k / 25) + rng.uniform(-1, 1), 40.0 if 0 < k < 599 else 0.0) for k in range(600)]
    c = pr.curves(spark.createDataFrame(vpis, "profile_id long, station double, elevation double, vc_length double")).cache()
    rays = [(1, k, rng.uniform(0, 60000), rng.uniform(-80, 80), rng.choice([0.0, 0.001, -0.002, 0.05]), rng.choice([1, -1])) for k in range(80)]
    r = spark.createDataFrame(rays, "profile_id long, ray_id int, s0 double, e0 double, m double, advance int")
    key = lambda: sorted((x.ray_id, x.place, round(x.sta, 5), round(x.el, 6)) for x in pr.ray_hits(r, c).collect())
    found = key()
    monkeypatch.setattr(pyramid, "FAN", 1 << 30)
    assert found == key() and len(found) > 80


def test_pyramids_of_nothing(spark):
    seg = wiggly(spark, 4, 300.0)
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (9, 2, 0.0, 0.0)], "align_id long, pid int, px double, py double")
    assert al.xy_to_station(p, seg.where("false")).count() == 0 and al.xy_to_station(p.where("false"), seg).count() == 0
    assert al.xy_to_station(p.where("align_id = 9"), seg).count() == 0
