"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.llm.common import documents, written

SHARDS = 24
SEED = "shard-1"
SPAN = float(2**32)


def shuffle_key(key: Column, seed: str = SEED) -> Column:
    """Hex md5 of seed and key: the order of the seeded shuffle."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))


def _ranked(rows: DataFrame, groups: list[str], cell: str, order: list, rank: str) -> DataFrame:
    """rows with `rank` from 0 in `order` within `groups`, where `cell` is a number that never falls along `order`.

    Two levels keep every task small: rows are counted and numbered within (groups, cell), and only the cells' counts
    are summed in order.
    """
    counts = rows.groupBy(*groups, cell).agg(F.count("*").alias("__n"))
    along = Window.partitionBy(*groups).orderBy(cell) if groups else Window.orderBy(cell)
    first = F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.col(cell).alias("__c"), first.alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*groups, cell).orderBy(*order)) - 1
    rows = rows.withColumn("__inside", inside)
    same = rows[cell] == counts["__c"]
    for k, g in enumerate(groups):
        same = same & rows[g].eqNullSafe(counts[f"__g{k}"])
    rows = rows.join(counts, same)
    return rows.withColumn(rank, F.col("__first") + F.col("__inside")).drop("__inside", "__first", "__c", *[f"__g{k}" for k in range(len(groups))])


def interleave(df: DataFrame, key: str = "doc_id", stratum: str = "source", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 within its shard).

    Rows of each stratum are put in a seeded random order; the r-th of n gets the fractional rank (2r + 1) / 2n; all
    rows are sorted by it and the sequence is cut into runs whose lengths differ by one at most, so that every shard
    matches the mixture. Null strata are one stratum, null keys hash as empty ones; rows that repeat a key are ordered
    by the other columns and, where these are equal too, are interchangeable. An empty table gives no rows. Columns
    named shard or slot are replaced.
    A cell is a slice of the hash or of the rank range; about sqrt(rows) cells hold about sqrt(rows) rows each, so a
    stratum with a third of all rows is still numbered in parallel, and only the cells' counts meet in one window.
    """
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    ties = [F.col(f"`{c}`").asc_nulls_last() for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes if not t.startswith(("map", "variant", "void"))]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], shuffle_key(F.col(f"`{key}`"), seed).alias("__h"))
    sizes = written(rows.groupBy(F.col(f"`{stratum}`").alias("__s")).agg(F.count("*").alias("__n")), "strata")
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    cells = max(1, int(total**0.5))
    rows = rows.join(sizes, rows[stratum].eqNullSafe(sizes["__s"])).drop("__s").withColumn("__stratum", F.col(f"`{stratum}`"))
    # as many cells for a stratum as its share of the rows asks for
    own = F.greatest(F.lit(1), F.floor(F.col("__n") * cells / F.lit(max(1, total)))).cast("double")
    rows = rows.withColumn("__cell", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / SPAN * own).cast("long"))
    rows = _ranked(rows, ["__stratum"], "__cell", ["__h", *ties], "__rank")
    rows = rows.withColumn("__part", (F.col("__rank") * 2 + 1) / (F.col("__n") * 2).cast("double"))
    rows = rows.withColumn("__slice", F.floor(F.col("__part") * cells).cast("long"))
    rows = _ranked(rows, [], "__slice", ["__part", F.col("__stratum").asc_nulls_last(), "__h", *ties], "__place")
    small, more = divmod(total, shards)  # the first `more` shards hold one row more
    edge = more * (small + 1)
    shard = F.when(F.col("__place") < edge, F.floor(F.col("__place") / F.lit(small + 1))).otherwise(F.lit(more) + F.floor((F.col("__place") - edge) / F.lit(max(1, small))))
    slot = F.when(F.col("__place") < edge, F.col("__place") % (small + 1)).otherwise((F.col("__place") - edge) % max(1, small))
    return rows.select(*[F.col(f"`{c}`") for c in keep], shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes and checksums are taken in the scan: no text is ever shuffled
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    thin = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = interleave(thin)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, encode(coalesce(text, '')) AS b,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
c AS (SELECT d.*, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT)),
             lambda a, x: xor(a >> 8, tab.t[CAST(xor(a, x) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM d, tab),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, crc) - 1) + 1) / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS part FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY part, source NULLS LAST, h, doc_id, size, crc) - 1 AS place, count(*) OVER () AS n FROM r),
k AS (SELECT *, n // {SHARDS} AS small, n % {SHARDS} AS more, (n % {SHARDS}) * (n // {SHARDS} + 1) AS edge FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law,
  CAST(CASE WHEN place < edge THEN place // (small + 1) ELSE more + (place - edge) // greatest(small, 1) END AS INTEGER) AS shard,
  CAST(CASE WHEN place < edge THEN place % (small + 1) ELSE (place - edge) % greatest(small, 1) END AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, source
FROM k
"""
