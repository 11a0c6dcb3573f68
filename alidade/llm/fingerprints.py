"""Threshold-scaled sketches of documents: every shingle hash under a fixed fraction of the hash range is kept, and the
least hashes at any rate, so that short texts keep all of theirs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.llm.common import documents, written
from alidade.llm.kernels import shingle_sets

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
#: So many least hashes are kept wherever they lie.
LEAST = 64
CELLS = 1 << 16


def sketches(texts: pa.Array, k: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """Sorted kept hashes of each text: those under the threshold and the LEAST least ones.

    The sketch of both texts' shingles together is made from the union of two sketches in the same way.
    """
    most = np.uint64(2**64 // scale) if scale > 1 else np.uint64(2**64 - 1)
    return [s[: max(LEAST, np.searchsorted(s, most))] for s in shingle_sets(texts, k)]


def _common_range(a: np.ndarray, b: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both sketches in the range in which neither lacks one of its text's hashes."""
    if len(a) < LEAST and len(b) < LEAST:
        return a, b
    under = np.uint64(2**64 // scale - 1)
    top = min(max(under, s[LEAST - 1]) for s in (a, b) if len(s) >= LEAST)
    return a[: np.searchsorted(a, top, side="right")], b[: np.searchsorted(b, top, side="right")]


def written_out(sketch: np.ndarray) -> str:
    """16 hex digits for each hash, ascending; no hash gives the empty string."""
    return sketch.astype(">u8").tobytes().hex()


def read_in(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Jaccard similarity of the shingle sets, estimated if one has more than LEAST; 1 if neither text has a word."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _common_range(a, b, scale)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of a's shingles that b has, however unequal the texts; 0 if none of a's can be judged."""
    a, b = _common_range(a, b, scale)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint", k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with the fingerprint of each whole text in column `name` (an input column of that name is replaced).

    Only null and wordless texts have the empty fingerprint; equal texts have equal fingerprints. Rows are read alone.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([written_out(s) for s in sketches(texts, k, scale)], pa.string())

    keep = [c for c in df.columns if c.lower() != name.lower()]
    return df.select(*[F.col(f"`{c}`") for c in keep], run(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(name))


def _buckets(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with bucket: descending runs of doc_id of about equal row counts, nulls in the last.

    A histogram of at most CELLS equal slices of the id range is counted over all documents and cut into runs; it is
    joined by broadcast, its size being bounded by CELLS.
    """
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if span["low"] is None:
        return docs.withColumn("bucket", F.lit(0).cast("long"))
    width = max(1, -(-(span["high"] - span["low"] + 1) // CELLS))
    cell = F.coalesce(F.floor((F.lit(span["high"]) - F.col("doc_id")) / F.lit(width)), F.lit(CELLS)).cast("long")
    docs = docs.withColumn("__cell", cell)
    counts = docs.groupBy("__cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    cells = counts.select("__cell", F.floor(before * parts / total).cast("long").alias("bucket"))
    return docs.join(F.broadcast(written(cells, "cells")), "__cell").drop("__cell")


def _with_next(rows: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """rows sorted by bucket, then doc_id descending, each bucket closed by the first row of the next (own = false)."""
    held = None  # the last row of the batch before: (bucket, doc_id, text, own)
    for batch in rows:
        lists = [batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "own")]
        these = list(zip(*lists))
        if held is not None:
            these.insert(0, held)
        if not these:
            continue
        held = these[-1]
        pairs = [(a, b) for a, b in zip(these, these[1:]) if a[3] and a[0] == b[0]]
        for at in range(0, len(pairs), 256):
            yield _described(pairs[at : at + 256], k, scale)


def _described(pairs: list, k: int, scale: int) -> pa.RecordBatch:
    texts = [a[2] for a, _ in pairs]
    edited = [t[: len(t) - len(t) // 2] + b[2][: len(t) // 2] for t, (_, b) in zip(texts, pairs)]
    own, changed, following = (sketches(pa.array(x, pa.large_string()), k, scale) for x in (texts, edited, [b[2] for _, b in pairs]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[1] for a, _ in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([written_out(s) for s in own], pa.string()),
            pa.array([written_out(s) for s in changed], pa.string()),
            pa.array([likeness(a, b, scale) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b, scale) for a, b in zip(own, following)], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))


def compared(docs: DataFrame, k: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, by descending doc_id.

    Ties of doc_id are ordered by text, a null id comes last, a null text is empty, and after the last document comes
    the first; a single document is its own next. Texts are shuffled once, into runs of ids; the first row of each run
    is sent to the run before as well.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = 4 * parts
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = _buckets(thin, runs)
    # one row per run: where its first document is wanted besides (the run before; that of the first run, the last)
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy(F.lit(1)))
    heads = written(heads.select("bucket", "doc_id", F.coalesce(F.lag("bucket").over(order), last).alias("wanted")), "heads")
    heads = F.broadcast(heads.select(F.col("bucket").alias("__b"), F.col("doc_id").alias("__d"), "wanted"))
    joined = rows.join(heads, (rows["bucket"] == heads["__b"]) & rows["doc_id"].eqNullSafe(heads["__d"]), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    extra = F.struct(F.col("wanted").alias("bucket"), F.lit(False).alias("own"))
    places = F.when(F.col("wanted").isNull(), F.array(own)).otherwise(F.array(own, extra))
    dealt = joined.select("doc_id", "text", F.explode(places).alias("p")).select("p.bucket", "doc_id", "text", "p.own")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(lambda batches: _with_next(batches, k, scale), schema)
