"""Point look-ups over a stream: a stream-static join with a surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alidade.functions import vectors as v
from alidade.operators import surface as s


def located(stream: DataFrame, tv: DataFrame, size: float | None = None) -> DataFrame:
    """(qid, px, py, tri_id, elevation) for points of a stream that lie on the surface; no state is kept.

    A point on a shared border is found once per triangle that holds it.
    """
    size = size or s.cell_size(tv)
    cx, cy = s.cells(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), size)
    t = tv.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))
    q = stream.withColumns({"cx": F.floor(F.col("px") / size), "cy": F.floor(F.col("py") / size)})
    hit = q.join(t, ["cx", "cy"]).where(v.inside_triangle(F.col("px"), F.col("py")))
    return hit.select("qid", "px", "py", "tri_id", s.elevation(F.col("px"), F.col("py")).alias("elevation"))
