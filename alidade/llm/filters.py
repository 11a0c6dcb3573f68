"""Filter interaction audit: what each order of a set of filters removes, with exact duplicates by partition refinement.

Texts are split by their length in code points, then by the hashes of successive blocks; a class with one row left is
dropped at once. The whole texts of what survives are compared. Every row then has one bit for each filter that it fails,
and the orders of the filters are worked out from the counts of these masks alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import documents, drop, join_by_size, written

FILTERS = "ABCDE"
#: UTF-8 bytes up to the end of the first block; each end is four times the one before, and the last block holds the rest.
FIRST, TIMES = 256, 4
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))


def failures(text: bytes) -> int:
    """Bits 0 to 3 for the filters A to D."""
    words = text.split()  # on blank and 09-0D, as for all byte strings
    n = len(words)
    points = len(text) - sum_of_tails(text)
    upper = len(text) - len(text.translate(None, UPPER))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * upper > 5 * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


_TAILS = bytes(range(0x80, 0xC0))


def sum_of_tails(text: bytes) -> int:
    """UTF-8 bytes that continue a code point."""
    return len(text) - len(text.translate(None, _TAILS))


def _described(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, part, mask, points, hashes): hashes[j] is that of the text's block j."""
    import xxhash

    for batch in batches:
        rows = []
        for rid, doc_id, part, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "part", "text"))):
            hashes, begin, end = [], 0, block
            while begin < len(text):
                hashes.append(xxhash.xxh3_64_intdigest(text[begin:end]) - 2**63)
                begin, end = end, end * TIMES
            rows.append((rid, doc_id, part, failures(text), len(text) - sum_of_tails(text), hashes))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["rid", "doc_id", "part", "mask", "points", "hashes"])


def described(docs: DataFrame, part: str = "source", block: int = FIRST) -> DataFrame:
    """Table (rid, doc_id, part, mask, points, hashes) of all rows, without texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return written(rows.mapInArrow(lambda b: _described(b, block), "rid long, doc_id long, part string, mask int, points long, hashes array<long>"), "described")


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose class has more than one; counts are made before the shuffle."""
    return rows.join(rows.groupBy(*by).count().where("count > 1").drop("count"), by, "left_semi")


def duplicates(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, points, cls) of the documents whose text a smaller doc_id has as well; table is described(docs).

    Rows without an id are no copies and make none; rows with one id and one text are the same document.
    """
    rows = table.where("doc_id is not null").select("doc_id", "points", "hashes").distinct()
    rows = written(_shared(rows.withColumn("cls", F.lit(0).cast("long")), ["points"]), "class")
    step = 0
    while True:
        size = rows.agg(F.max(F.size("hashes"))).first()[0]
        if size is None or step >= size:
            break
        # the class is renamed by its block's hash; a text that has ended keeps its class
        finer = rows.withColumn("cls", F.when(F.size("hashes") > step, F.xxhash64("cls", F.get("hashes", F.lit(step)))).otherwise(F.col("cls")))
        before, rows = rows, written(_shared(finer, ["points", "cls"]), "class")
        drop(before)
        step += 1
    # the whole texts of what is left: as a rule a class holds one text, whose least id then stands for it
    ids = rows.select("doc_id", "points", "cls")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = join_by_size(texts.withColumn("points", F.length("text").cast("long")), ids, ["doc_id", "points"])
    alike = written(texts.groupBy("points", "cls", "text").agg(F.min("doc_id").alias("least")), "texts")
    single = alike.groupBy("points", "cls").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    found = join_by_size(ids, written(single.where("n = 1").drop("n"), "classes"), ["points", "cls"])
    mixed = alike.join(single.where("n > 1").select("points", "cls"), ["points", "cls"], "left_semi")
    if mixed.limit(1).count():
        mixed = texts.join(mixed, ["points", "cls", "text"]).select("points", "cls", "doc_id", "least")
        found = found.unionByName(mixed)
    return found.where("doc_id > least").select("doc_id", "points", "cls").distinct()


def masks(docs: DataFrame, part: str = "source", block: int = FIRST) -> DataFrame:
    """(rid, doc_id, part, mask) of all rows of docs: one bit for each filter that the row fails."""
    table = described(docs, part, block)
    # an id may have several texts: a copy is known by its id, its length and the hash of all its blocks
    table = table.withColumn("cls", F.aggregate("hashes", F.lit(0).cast("long"), lambda c, h: F.xxhash64(c, h)))
    copies = duplicates(docs, table).withColumn("copy", F.lit(16))
    rows = table.join(copies, ["doc_id", "points", "cls"], "left")
    return rows.select("rid", "doc_id", "part", (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask"))


ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", block: int = FIRST) -> DataFrame:
    """One row for each part, order of the five filters and step; see the query's contract.

    A null text is empty, a null part the empty string, and labels of one document count once. No documents, no rows.
    """
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = masks(docs, part, block).join(flags, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    counts = written(counts, "masks")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(sum(1 << FILTERS.index(c) for c in o[:i])).alias("before"), F.lit(1 << FILTERS.index(o[i])).alias("bit")) for o in ORDERS for i in range(5)])
    rows = parts.withColumn("s", F.explode(steps)).select("part", "cells", "s.*")

    def total(keep, what: str = "n"):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(keep(c["mask"]), c[what]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    out = rows.select(
        "part",
        "filter_order",
        "step",
        "bit",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
    )
    shapley = out.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))  # five rows a part
    return out.join(shapley, ["part", "bit"]).drop("bit")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as least from d),
marked as (select doc_id, part, case when len(words) < 50 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 65 * len(words) then 2 else 0 end
             + case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) then 4 else 0 end
             + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end + case when doc_id > least then 16 else 0 end as mask from w),
flags as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
cells as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic
          from marked left join flags on marked.doc_id = flags.doc_id group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
           where b.f <> a.f and c.f not in (a.f, b.f) and d.f not in (a.f, b.f, c.f) and e.f not in (a.f, b.f, c.f, d.f)),
steps as (select filter_order, step, substr(filter_order, step, 1) as f, 1 << (ascii(substr(filter_order, step, 1)) - 65) as bit,
            list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda x: case when x = '' then 0 else 1 << (ascii(x) - 65) end)) as before
          from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
counted as (select part, filter_order, step, f,
              sum(case when mask & bit = 0 and mask & coalesce(before, 0)::int = 0 then n else 0 end) as kept,
              sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int = 0 then n else 0 end) as removed,
              sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int <> 0 then n else 0 end) as redundant,
              sum(case when mask = bit then n else 0 end) as unique_fails,
              sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int = 0 then good else 0 end) as good_lost,
              sum(case when mask & bit <> 0 and mask & coalesce(before, 0)::int = 0 then toxic else 0 end) as toxic_lost
            from cells, steps group by part, filter_order, step, f)
select part, filter_order, cast(step as int) as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley from counted
"""
