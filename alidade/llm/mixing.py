"""Mixing sources to target weights: repetition rates per source, whole copies plus one hashed coin per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.llm.common import documents, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def coin(key: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) that depends on the key's text and the seed alone; null counts as an empty key."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh `weights` in turn and share all sizes; no target exceeds `most`
    times its source's size. Filling by weight with ceilings has a closed form: order the sources by ceiling over
    weight; the first ones stop at their ceiling, the others share what is left by weight, and the level is the first
    one that the next source's ceiling can hold. The windows run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    # cap / weight in whole numbers: cap times what the weight lacks to the product of all weights
    whole = 1
    for w in weights:
        whole *= w
    by = Window.orderBy(F.col("cap") * (F.lit(whole) / F.col("w")).cast("long"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total, weight_sum = F.sum("source_size").over(everything), F.sum("w").over(everything)
    per = per.withColumns(
        {
            "left_size": total - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left_weight": weight_sum - F.coalesce(F.sum("w").over(before), F.lit(0)),
            "k": F.row_number().over(by),
        }
    )
    fits = F.col("left_size") * F.col("w") <= F.col("cap") * F.col("left_weight")
    level = F.min(F.when(fits, F.struct("k", "left_size", "left_weight"))).over(everything)
    shared = F.col("w") * F.col("level.left_size") / F.col("level.left_weight")
    target = F.when(F.col("k") < F.coalesce(F.col("level.k"), F.lit(2**31 - 1)), F.col("cap").cast("double")).otherwise(shared)
    return per.withColumn("level", level).select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """df with size, source_size, target, rate and copies: how often the mix takes each document.

    rate = target / source size; a document is taken floor(rate) times, and once more if its hashed coin falls under
    the fraction. The coin hangs on key and seed only, so reruns agree and rows that repeat a key fall alike. Null
    text has size 0, null source is a source of its own and comes last; a source of size 0 has target 0 and is not
    taken. An empty table gives an empty result. Input columns named like a result are replaced.
    Only (source, size) is aggregated, with partial sums, so a hot source costs one row per task.
    """
    out = ["size", "source_size", "target", "rate", "copies"]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out], word_count(F.col(f"`{text}`")).alias("size"))
    targets = written(source_targets(base.select(F.col(f"`{source}`").alias("source"), "size"), weights, most), "targets")
    targets = targets.withColumnRenamed("source", "__mix_source")
    # a written table of one row per source: Spark broadcasts it only if its files are small, else sorts and splits
    rows = base.join(targets, base[source].eqNullSafe(targets["__mix_source"]), "left").drop("__mix_source")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = rows.withColumn("rate", rate)
    copies = F.floor("rate") + (coin(F.col(f"`{key}`"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return rows.withColumn("copies", copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mark = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    rows = mix(mark).where("copies > 0")
    return rows.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")


_W = f"[{', '.join(map(str, WEIGHTS))}]"
SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, CAST(3 * sum(size) AS BIGINT) AS cap,
        {_W}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS w FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
        (SELECT sum(s) FROM p) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt,
        (SELECT sum(w) FROM p) - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw FROM p),
v AS (SELECT k, lt, lw FROM q WHERE lt * w <= cap * lw ORDER BY k LIMIT 1),
t AS (SELECT source, s, CASE WHEN q.k < v.k THEN CAST(cap AS DOUBLE) ELSE CAST(w * v.lt AS DOUBLE) / CAST(v.lw AS DOUBLE) END AS target FROM q, v),
r AS (SELECT doc_id, size, s AS source_size, target, CASE WHEN s = 0 THEN 0 ELSE target / s END AS rate,
        CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
