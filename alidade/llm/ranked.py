"""Ranked lexical search by three phases over term-partitioned postings (TPUT).

Phase 1 fetches the head of every query term's list; the k-th best sum of a query bounds its k-th best score from below.
Phase 2 fetches every posting of a query's m lists that brings at least that bound / m: a document without one such posting
stays under the bound. Phase 3 looks up all postings of the candidates whose upper bound reaches the k-th best sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alidade.llm.common import documents, drop, join_by_size, written

TOP = 20
#: Query terms up to this many go to the tasks as one set; with more of them, all postings are made and joined with them.
MOST_TERMS = 200_000
#: Terms of all queries of one block.
MOST_PAIRS = 500_000

#: ASCII letters and digits stay, A-Z in lower case; every other ASCII character ends a term. Bytes from 80 up, that is all
#: other characters, belong to terms, so that terms are cut on UTF-8 bytes.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _postings(batches: Iterator[pa.RecordBatch], wanted: set[bytes] | None) -> Iterator[pa.RecordBatch]:
    """Rows (term, rid, doc_id, tf, n) of the wanted terms; for each batch one with no term: documents, and all their terms."""
    for batch in batches:
        rows, docs, length = [], 0, 0
        for rid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
            found = terms(text) if text else []
            if not found:
                continue
            docs += 1
            length += len(found)
            counts = Counter(found)
            rows += [(t.decode(), rid, doc_id, counts[t], len(found)) for t in (counts if wanted is None else counts.keys() & wanted)]
        rows.append((None, None, None, docs, length))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["term", "rid", "doc_id", "tf", "n"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(q, i, t.decode(), c) for q, i, text in zip(*(batch.column(c).to_pylist() for c in ("qid", "item_id", "text"))) if text for t, c in Counter(terms(text)).items()]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["qid", "item_id", "term", "times"])


def query_terms(items: DataFrame) -> DataFrame:
    """Table (qid, item_id, term, times): a number for each row of items, which may repeat ids, and its terms."""
    rows = items.select(F.monotonically_increasing_id().alias("qid"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(_item_terms, "qid long, item_id long, term string, times long"), "query-terms")


def postings(docs: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (tid, rid, doc_id, impact) of the asked terms over all documents and (term, tid). A list lies by descending
    impact, and ranges of (tid, impact) make the partitions, so that a long list lies in several. rid numbers the rows of
    docs; the impact is weight times share."""
    spark = docs.sparkSession
    names = asked.select("term").distinct()
    few = names.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    wanted = {r.term.encode() for r in names.collect()} if few else None
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    raw = written(rows.mapInArrow(lambda b: _postings(b, wanted), "term string, rid long, doc_id long, tf long, n long"), "counts")
    n_docs, length = raw.where("term is null").agg(F.sum("tf"), F.sum("n")).first()
    lists = raw.where("term is not null")
    if not few:
        lists = lists.join(names, "term", "left_semi")
    n_docs, length = n_docs or 0, max(1, length or 0)
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = lists.groupBy("term").agg(F.count("*").alias("df")).select("term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w"))
    weights = written(weights.withColumn("tid", F.monotonically_increasing_id()), "weights")
    lists = join_by_size(lists, weights, ["term"]).withColumn("m", F.expr(f"75 + (25 * n * {n_docs}L) div {length}L"))
    lists = lists.select("tid", "rid", "doc_id", F.expr("w * ((1000000000L * tf) div (1000 * tf + 12 * m))").alias("impact")).where("impact > 0")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tid", F.col("impact").desc(), "rid"]
    found = written(lists.repartitionByRange(parts, *order).sortWithinPartitions(*order), "postings")
    drop(raw)
    return found, weights.select("term", "tid")


def _best(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each group; ranks are cut in every partition before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def _bound(sums: DataFrame, name: str, k: int) -> DataFrame:
    """(qid, the k-th best sum); queries with fewer than k sums have none."""
    return _best(sums, "qid", [F.col("sum").desc()], k).groupBy("qid").agg(F.min("sum").alias(name), F.count("*").alias("c")).where(F.col("c") == k).drop("c")


class Lists:
    """The queries of a block by term: which query wants which list, how often, and from which impact on."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r.tid)
        self.qids = np.array(sorted({r.qid for r in rows}), np.int64)
        self.tids, self.first = np.unique(np.array([r.tid for r in rows], np.int64), return_index=True)
        self.size = np.diff(np.append(self.first, len(rows)))
        self.query = np.searchsorted(self.qids, np.array([r.qid for r in rows], np.int64))
        self.times = np.array([r.times for r in rows], np.int64)
        of_query = {r.qid: (r.m, r.low) for r in rows}
        self.m, self.low = (np.array([of_query[q][i] for q in self.qids.tolist()], np.int64) for i in (0, 1))
        least = -(-self.low[self.query] // (self.m[self.query] * self.times))
        self.least = np.maximum(1, least)

    def sums(self, docs: np.ndarray, tids: np.ndarray, impacts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums, lists seen) as n documents x queries, of postings given by document number, list and impact."""
        at = np.searchsorted(self.tids, tids)
        size = self.size[at]
        pair = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        value = np.repeat(impacts, size)
        fetched = value >= self.least[pair]
        pair, value = pair[fetched], value[fetched] * self.times[pair[fetched]]
        cell = np.repeat(docs, size)[fetched] * len(self.qids) + self.query[pair]
        shape, cells = (n, len(self.qids)), n * len(self.qids)  # sums stay far below 2^53
        return np.bincount(cell, value, cells).astype(np.int64).reshape(shape), np.bincount(cell, minlength=cells).reshape(shape)


def _blocks(batches: Iterator[pa.RecordBatch], lists: Lists) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rids, sums, seen) of some documents at a time."""
    step = max(1, 2_000_000 // max(1, len(lists.qids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            sizes = np.diff(b.column("tids").offsets.to_numpy())
            tids, impacts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("tids", "impacts"))
            yield b.column("rid").to_numpy(), *lists.sums(np.repeat(np.arange(len(sizes)), sizes), tids, impacts, len(sizes))


def _best_sums(batches: Iterator[pa.RecordBatch], lists: Lists, k: int) -> Iterator[pa.RecordBatch]:
    """(qid, sum): the k best sums of each query over the task's documents."""
    best = np.zeros((0, len(lists.qids)), np.int64)
    for _, sums, _ in _blocks(batches, lists):
        best = -np.sort(-np.concatenate([best, sums]), axis=0)[:k]
    q = np.broadcast_to(lists.qids, best.shape)
    yield pa.RecordBatch.from_arrays([pa.array(q[best > 0]), pa.array(best[best > 0])], ["qid", "sum"])


def _candidates(batches: Iterator[pa.RecordBatch], lists: Lists, better: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(qid, rid) whose upper bound reaches the k-th best sum: a list in which a document was not seen brings less than low / m."""
    for rids, sums, seen in _blocks(batches, lists):
        doc, q = np.nonzero((seen > 0) & (sums * lists.m + (lists.m - seen) * lists.low >= better * lists.m))
        yield pa.RecordBatch.from_arrays([pa.array(lists.qids[q]), pa.array(rids[doc])], ["qid", "rid"])


def _searched(lists: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """The k best of each query of known (qid, item_id, tid, times, m), one block of queries."""
    spark = lists.sparkSession
    heads = written(_best(lists, "tid", [F.col("impact").desc(), F.col("rid")], k).select("tid", "rid", "impact"), "heads")
    sums = known.join(heads, "tid").groupBy("qid", "rid").agg(F.sum(F.col("times") * F.col("impact")).alias("sum"))
    limits = known.join(_bound(sums, "low", k), "qid", "left").withColumn("low", F.coalesce("low", F.lit(0)))
    block = Lists(limits.select("qid", "tid", "times", "m", "low").collect())
    drop(heads)
    least = [(int(t), int(i)) for t, i in zip(block.tids, np.minimum.reduceat(block.least, block.first))]
    fetched = lists.select("tid", "rid", "impact").join(F.broadcast(spark.createDataFrame(least, "tid long, least long")), "tid").where("impact >= least")
    fetched = written(fetched.groupBy("rid").agg(F.collect_list("tid").alias("tids"), F.collect_list("impact").alias("impacts")), "fetched")
    better = {r.qid: r.better for r in _bound(fetched.mapInArrow(lambda b: _best_sums(b, block, k), "qid long, sum long"), "better", k).collect()}
    better = np.array([better.get(q, 0) for q in block.qids.tolist()], np.int64)
    candidates = written(fetched.mapInArrow(lambda b: _candidates(b, block, better), "qid long, rid long"), "candidates")
    drop(fetched)
    looked_up = join_by_size(lists, candidates.select("rid").distinct(), ["rid"]).join(candidates, "rid").join(known.select("qid", "item_id", "tid", "times"), ["qid", "tid"])
    scores = looked_up.groupBy("qid", "item_id", "rid", "doc_id").agg(F.sum(F.col("times") * F.col("impact")).alias("score"))
    ranked = _best(scores, "qid", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid")], k)
    return ranked.select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score; equal scores by ascending doc_id.

    All rows of docs (doc_id, text) are searched; a null or empty text has no terms. Rows that repeat a doc_id are documents
    of their own and rank beside each other; a null id comes last among equal scores. Rows that repeat an item, or its id,
    are queries of their own. Items without terms, and terms that no document holds, bring no rows. Queries are taken in
    blocks of about MOST_PAIRS terms, which alone are sent to the tasks.
    """
    asked = query_terms(items)
    lists, ids = postings(docs, asked)
    present = lists.select("tid").distinct()
    known = asked.join(ids.join(present, "tid"), "term")
    known = written(known.withColumn("m", F.count("*").over(Window.partitionBy("qid"))).drop("term"), "known")
    blocks = max(1, -(-known.count() // MOST_PAIRS))
    found = None
    for i in range(blocks):
        some = known if blocks == 1 else known.where(F.abs(F.xxhash64("qid")) % blocks == i)
        part = _searched(lists, some, k)
        found = part if found is None else found.unionByName(part)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with words as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
counts as (select doc_id, term, count(*) as tf from words group by doc_id, term),
lengths as (select doc_id, count(*) as n from words group by doc_id),
totals as (select count(*) as n_docs, cast(sum(n) as bigint) as length from lengths),
weights as (select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
            from counts, totals group by term),
impacts as (select c.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // length))) as impact
            from counts c join lengths l on c.doc_id = l.doc_id join weights on c.term = weights.term, totals),
asked as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
times as (select item_id, term, count(*) as times from asked group by item_id, term),
scores as (select item_id, doc_id, cast(sum(times * impact) as bigint) as score
           from times join impacts on times.term = impacts.term group by item_id, doc_id)
select item_id, cast(place as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as place from scores where score > 0)
where place <= 20
"""
