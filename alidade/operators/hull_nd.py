"""Convex hull in any number of dimensions: beneath-beyond with conflict lists, hulls of hulls merged in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alidade.tables import drop, written

#: Hulls that one task merges.
FAN = 16
#: Facets that one half-space test takes at a time; more are taken in blocks.
BLOCK = 4096


class Facet:
    """A simplex of the hull, its outward unit normal, its neighbours by ridge and the points that see it from outside."""

    __slots__ = ("vertices", "normal", "offset", "beside", "seen_by")

    def __init__(self, vertices: tuple[int, ...], p: np.ndarray, inner: np.ndarray) -> None:
        base = p[list(vertices)]
        self.vertices = vertices
        self.normal = np.linalg.svd(base[1:] - base[0], full_matrices=True)[2][-1]
        self.offset = float(self.normal @ base[0])
        if self.normal @ inner > self.offset:
            self.normal, self.offset = -self.normal, -self.offset
        self.beside: dict[tuple[int, ...], Facet] = {}
        self.seen_by = np.empty(0, np.int64)

    def ridges(self) -> Iterator[tuple[int, ...]]:
        for i in range(len(self.vertices)):
            yield self.vertices[:i] + self.vertices[i + 1 :]


def _simplex(p: np.ndarray, slack: float) -> list[int] | None:
    """d + 1 points that span the space, each the farthest from the span of those before; None if all lie in a flat."""
    first = int(np.lexsort(p.T[::-1])[0])
    chosen, rest = [first], p - p[first]
    for _ in range(p.shape[1]):
        length = np.linalg.norm(rest, axis=1)
        far = int(length.argmax())
        if length[far] <= slack:
            return None
        chosen.append(far)
        axis = rest[far] / length[far]
        rest = rest - np.outer(rest @ axis, axis)
    return chosen


def facets(p: np.ndarray) -> list[Facet]:
    """The hull's facets, all of them simplices; a point within rounding of a facet lies on it. None if the points lie in a flat.

    Each point outside is kept with one facet that it sees. The farthest of a facet's points takes the place of all facets
    that it sees; their points go to the new ones.
    """
    n, d = p.shape
    slack = 1e-12 * d * float(np.abs(p).max(initial=0.0)) + 1e-300
    start = _simplex(p, slack) if n > d else None
    if start is None:
        return []
    inner = p[start].mean(axis=0)

    def deal(points: np.ndarray, to: list[Facet]) -> None:
        for f in to:
            above = p[points] @ f.normal - f.offset > slack
            f.seen_by, points = points[above], points[~above]

    def join(some: list[Facet], open_ridges: dict) -> None:
        for f in some:
            for r in f.ridges():
                other = open_ridges.pop(r, None)
                if other is None:
                    open_ridges[r] = f
                else:
                    f.beside[r], other.beside[r] = other, f

    alive = [Facet(tuple(sorted(start[:i] + start[i + 1 :])), p, inner) for i in range(d + 1)]
    join(alive, {})
    deal(np.setdiff1d(np.arange(n), start), alive)
    hull, todo = set(alive), [f for f in alive if len(f.seen_by)]
    while todo:
        f = todo.pop()
        if f not in hull or not len(f.seen_by):
            continue
        apex = int(f.seen_by[(p[f.seen_by] @ f.normal).argmax()])
        visible, stack, horizon = {f}, [f], []
        while stack:
            g = stack.pop()
            for ridge, other in g.beside.items():
                if other in visible:
                    continue
                if p[apex] @ other.normal - other.offset > slack:
                    visible.add(other)
                    stack.append(other)
                else:
                    horizon.append((ridge, other))
        fresh, open_ridges = [], {}
        for ridge, other in horizon:
            if other in visible:
                continue
            new = Facet(tuple(sorted((*ridge, apex))), p, inner)
            new.beside[ridge], other.beside[ridge] = other, new
            fresh.append(new)
            for r in new.ridges():
                if r != ridge:
                    mate = open_ridges.pop(r, None)
                    if mate is None:
                        open_ridges[r] = new
                    else:
                        new.beside[r], mate.beside[r] = mate, new
        points = np.unique(np.concatenate([g.seen_by for g in visible]))
        deal(points[points != apex], fresh)
        hull -= visible
        hull |= set(fresh)
        todo += [g for g in fresh if len(g.seen_by)]
    return list(hull)


def tree(points: DataFrame, reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str, fan: int = FAN) -> DataFrame:
    """The rows that `reduce` leaves of all points: first of each partition, batch by batch, then of `fan` results at a time
    until one is left. reduce(rows) must keep all that matters of any union it is part of."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            best = reduce(pdf if best is None else pd.concat([best, pdf]))
        if best is not None:
            yield best

    parts = points.mapInPandas(local, schema).withColumn("k", F.spark_partition_id())
    before = None
    while True:
        parts = written(parts, "hulls")
        if before is not None:
            drop(before)
        before = parts
        n = parts.agg(F.max("k")).first()[0]
        if not n:
            return parts.drop("k")
        names = [c for c in parts.columns if c != "k"]

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            return reduce(pdf[names]).assign(k=pdf["k"].iloc[0])

        parts = parts.withColumn("k", F.floor(F.col("k") / fan).cast("int")).groupBy("k").applyInPandas(merge, schema + ", k int")


def _vertices(pdf: pd.DataFrame) -> pd.DataFrame:
    """The hull's vertices; all rows if they lie in a flat, of which a hull may yet be made with others."""
    pdf = pdf.sort_values("point_id").drop_duplicates("point_id")
    p = np.stack(pdf["at"].to_list()) if len(pdf) else np.empty((0, 1))
    p, first = np.unique(p, axis=0, return_index=True)
    found = facets(p)
    keep = np.unique([v for f in found for v in f.vertices]) if found else np.arange(len(p))
    return pdf.iloc[np.sort(first[keep])]


def convex_hull_nd(points: DataFrame, axes: list[str], fan: int = FAN) -> DataFrame:
    """(facet_id, vertices, normal, offset): the facets of the hull of points (point_id, axes...) in len(axes) dimensions.

    Rows with a null are left out; of equal points the least id stays. Points in a flat have no facets. Only vertices of
    partial hulls travel; with the dimension their share grows, up to all points.
    """
    at = F.array(*[F.col(a).cast("double") for a in axes])
    thin = points.select(F.col("point_id").cast("long").alias("point_id"), at.alias("at")).where(" and ".join(f"`{a}` is not null" for a in axes)) if axes else points
    best = tree(thin, _vertices, "point_id long, at array<double>", fan)

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # one row with all vertices
            for row in pdf["rows"]:
                ids = np.array([r["point_id"] for r in row])
                found = facets(np.array([r["at"] for r in row], float))
                if not found:
                    continue
                yield pd.DataFrame({"facet_id": np.arange(len(found)), "vertices": [sorted(ids[list(f.vertices)].tolist()) for f in found], "normal": [f.normal.tolist() for f in found], "offset": [f.offset for f in found]})

    rows = best.agg(F.sort_array(F.collect_list(F.struct("point_id", "at"))).alias("rows")).where(F.size("rows") > 0)
    return rows.mapInPandas(last, "facet_id long, vertices array<long>, normal array<double>, offset double")


def outside(points: DataFrame, hull: DataFrame, axes: list[str], slack: float = 1e-9) -> DataFrame:
    """(point_id, facet_id) of points more than slack beyond a facet: the half-space test, block by block of facets."""
    found = None
    n = hull.count()
    for low in range(0, max(n, 1), BLOCK):
        block = hull.where((F.col("facet_id") >= low) & (F.col("facet_id") < low + BLOCK)).select("facet_id", "normal", "offset").collect()
        ids, normals, offsets = np.array([r[0] for r in block]), np.array([r[1] for r in block]).reshape(len(block), -1), np.array([r[2] for r in block])

        def test(batches: Iterator[pd.DataFrame], ids=ids, normals=normals, offsets=offsets) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(ids):
                    beyond = pdf[axes].to_numpy(float) @ normals.T - offsets
                    row, facet = np.nonzero(beyond > slack)
                    yield pd.DataFrame({"point_id": pdf["point_id"].to_numpy()[row], "facet_id": ids[facet]})

        part = points.select("point_id", *axes).dropna().mapInPandas(test, "point_id long, facet_id long")
        found = part if found is None else found.unionByName(part)
    return found


def hull_checks(points: DataFrame, axes: list[str]) -> DataFrame:
    """One row: points, euler (of the hull's boundary), open ridges, points outside a facet, and whether each facet has as
    many vertices as dimensions. In three dimensions euler is 2, in two 0."""
    hull = written(convex_hull_nd(points, axes), "facets")
    d = len(axes)
    faces = hull
    for k in range(d, 0, -1):  # all faces of the simplices, of k vertices each
        faces = faces.select("vertices") if k == d else faces.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(k + 1)), lambda i: F.filter("vertices", lambda v, j: j != i - 1))).alias("vertices")).distinct()
        counted = faces.agg(F.lit(k).alias("k"), F.count("*").alias("n"))
        sizes = counted if k == d else sizes.unionByName(counted)  # noqa: F821
    euler = sizes.agg(F.sum(F.when(F.col("k") % 2 == 1, F.col("n")).otherwise(-F.col("n"))).alias("euler"))
    ridges = hull.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.filter("vertices", lambda v, j: j != i - 1))).alias("r")).groupBy("r").count()
    odd = ridges.agg(F.coalesce(F.sum((F.col("count") != 2).cast("long")), F.lit(0)).alias("open_ridges"))
    beyond = outside(points, hull, axes).agg(F.count("*").alias("outside"))
    n = points.dropna(subset=axes).agg(F.count("*").alias("points"))
    out = n.join(euler, F.lit(True)).join(odd, F.lit(True)).join(beyond, F.lit(True))  # one row each
    return out.select("points", "euler", "open_ridges", "outside")
