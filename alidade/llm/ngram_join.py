"""N-gram Jaccard join by grouped prefixes: links between documents, and the components that the links make.

1. Each document becomes the set of its shingles' 64-bit hashes; equal sets are one vertex from here on.
2. All shingles are counted into a table of fixed width; its counts give the global order, rare first. A set's prefix
   is its first n - ceil(t n) + 1 shingles in that order; two sets at or above t share a shingle of both prefixes.
3. Sets with the same prefix and size are one group. Prefix shingles that two or more sets have are the lists.
4. First round: every list's members are paired with the list's pivot (its least group). Second round: only lists that
   still join several components are left, and there the members outside the list's largest component are paired with
   all members of other components. No list is expanded into all its pairs, and no pair of different components goes
   unverified.
5. Pairs pass a size filter, a position filter and a bitmap filter where they meet: bit b of a set's bitmap is the parity
   of its shingles that hash to b, so two sets differ in at least as many shingles as their bitmaps in bits.
   Group pairs are expanded to their members, and what passes is verified on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import components, documents, drop, semi_by_size, written
from alidade.llm.kernels import shingle_sets

#: Width of the table of shingle counts (2 MB): the only thing about shingles that reaches the driver.
WIDTH = 1 << 18
#: Bits of a set's bitmap: so many that sets of some hundred shingles which fall short of the threshold are told apart by it.
BITS = 1024
WORDS = BITS // 64


def _count(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(WIDTH, dtype=np.int64)
    for batch in batches:
        for hashes in shingle_sets(batch.column(0), k, lower):
            # the slots of one text: sorted and mostly distinct, so few are added twice
            slots, times = np.unique((hashes & np.uint64(WIDTH - 1)).astype(np.int64), return_counts=True)
            counts[slots] += times
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["slot", "n"])


def shingle_counts(df: DataFrame, text: str, k: int, lower: bool) -> np.ndarray:
    """Counts of all documents' distinct shingles by hash slot: WIDTH numbers, whatever the size of the corpus."""
    rows = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(lambda b: _count(b, k, lower), "slot long, n long")
    found = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(WIDTH, dtype=np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return counts


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _prefixes(batches: Iterator[pa.RecordBatch], counts, k: int, num: int, den: int, lower: bool) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        sizes, sids, gids, prefixes, bitmaps = [], [], [], [], []
        for h in shingle_sets(batch.column(2), k, lower):
            n = len(h)
            sizes.append(n)
            sids.append(_digest(h.tobytes(), 16) if n else None)
            take = n - -(-num * n // den) + 1
            if not n or take < 1:
                gids.append(None)
                prefixes.append(None)
                bitmaps.append(None)
                continue
            odd = np.bincount(((h >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
            bitmaps.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            order = np.lexsort((h, table[(h & np.uint64(WIDTH - 1)).astype(np.int64)]))[:take]
            prefix = h[order].astype(np.int64)
            gids.append(int.from_bytes(_digest(prefix.tobytes() + n.to_bytes(8, "little"), 8), "little", signed=True))
            prefixes.append(prefix)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()), pa.array(gids, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bitmaps, pa.list_(pa.int64()))],
            ["row", "id", "n", "sid", "gid", "prefix", "bits"],
        )


def _sets(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [h for h in shingle_sets(batch.column(0), k, lower)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_digest(h.tobytes(), 16) for h in found], pa.binary()), pa.array([h.astype(np.int64) for h in found], pa.list_(pa.int64()))], ["sid", "set"]
        )


def _enough(shared: Column, n: Column, m: Column, num: int, den: int) -> Column:
    """den * shared >= num * (n + m - shared): the threshold in whole numbers."""
    return shared * den >= (n + m - shared) * num


def _possible(n: Column, i: Column, m: Column, j: Column, num: int, den: int) -> Column:
    """Whether sets of sizes n and m whose first common shingle is at places i and j of their orders can link.

    At most min(n - i, m - j) shingles are shared then. A pair that links passes at its first common shingle, so each
    posting can be judged alone and a pair that passes nowhere is none.
    """
    return _enough(F.least(n - i, m - j), n, m, num, den)


def _alike(n: Column, x: Column, m: Column, y: Column, num: int, den: int) -> Column:
    """Whether sets of sizes n and m with bitmaps x and y can link."""
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return _enough(F.floor((n + m - apart) / 2), n, m, num, den)


def linked(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100, lower: bool = True) -> DataFrame:
    """(id, n_shingles, component_id): one row per row of df.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of k-word shingles; component_id is the
    least id that links reach, the own id included (null ids are reached last). A text with fewer than k words has its
    whole sequence as one shingle; a null, empty or wordless text has none and links with nothing. Repeated rows and
    repeated ids are rows of their own; an empty table gives no rows. Only the columns id and text are read.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold lies in (0, 1]")
    return _linked(df, id, text, k, num, den, lower).select("id", F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def _linked(df: DataFrame, id: str, text: str, k: int, num: int, den: int, lower: bool) -> DataFrame:
    """(row, id, n, root, low): a hash of each row's id and text, which also tells rows without an id apart, the size of its
    set, and, where its set has copies or links, its component's key and least id."""
    spark = df.sparkSession
    thin = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).select(F.xxhash64("id", "text").alias("row"), "id", "text")
    counts = spark.sparkContext.broadcast(shingle_counts(thin, "text", k, lower))
    id_type = thin.schema["id"].dataType.simpleString()
    schema = f"row long, id {id_type}, n long, sid binary, gid long, prefix array<long>, bits array<long>"
    docs = written(thin.mapInArrow(lambda b: _prefixes(b, counts, k, num, den, lower), schema), "prefixes")

    # equal sets are one vertex; one of its documents stands for it
    sets = docs.where("sid is not null").groupBy("sid").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.count("*").alias("copies"))
    sets = written(sets, "sets")
    # the smallest size that can link with a different set: n shingles of n + 1
    least = next((n for n in range(1, den + 1) if (n + 1) * num <= n * den), None)
    if least is None:  # only equal sets link
        return _labelled(docs, sets, sets.select("sid", F.col("sid").alias("root")).limit(0))
    vertices = docs.where(F.col("n") >= least)
    members = written(vertices.groupBy("sid", "gid", "n").agg(F.first("bits").alias("bits")), "members")
    groups = vertices.groupBy("gid", "n").agg(F.first("prefix").alias("prefix"), (F.min("sid") != F.max("sid")).alias("several"))
    groups = written(groups, "groups")
    posted = groups.select(F.posexplode("prefix").alias("pos", "shingle"), "gid", "n", "several")
    # a posting is its shingle, its group and one number for size, place and whether the group has several members
    packed = F.shiftleft("n", 32) + F.shiftleft(F.col("pos").cast("long"), 1) + F.col("several").cast("long")
    posted = posted.select("shingle", "gid", packed.alias("at"))
    lists = posted.groupBy("shingle").agg(F.count("*").alias("size"), F.max(F.col("at").bitwiseAND(F.lit(1))).alias("several"), F.min("gid").alias("pgid"))
    lists = written(lists.where("size > 1 or several = 1").select("shingle", "pgid"), "shared")
    n_pos = (F.shiftright("at", 32).alias("n"), F.shiftright(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), 1).alias("pos"))
    entries = written(posted.join(lists, "shingle").select("shingle", "gid", *n_pos, "pgid"), "lists")
    drop(groups, lists)

    # first round: each group with the pivots of its lists, and each pivot with itself if it has several members
    pivots = entries.where("gid = pgid").select("shingle", F.col("n").alias("pn"), F.col("pos").alias("ppos"))
    pairs = entries.join(pivots, "shingle").where(_possible(F.col("n"), F.col("pos"), F.col("pn"), F.col("ppos"), num, den)).select("gid", "pgid").distinct()
    stand = members.groupBy("gid").agg(F.min_by(F.struct("sid", "n", "bits"), "sid").alias("s")).select(F.col("gid").alias("pgid"), "s")
    first = members.join(pairs, "gid").join(stand, "pgid").where((F.col("sid") != F.col("s.sid")) & _alike(F.col("n"), F.col("bits"), F.col("s.n"), F.col("s.bits"), num, den))
    first = first.select(F.col("sid").alias("x"), F.col("s.sid").alias("y")).distinct()
    first = written(first, "pairs")
    links = written(_verified(first, thin, sets, k, lower, num, den), "links")
    root = written(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")

    # second round: lists that still join several components
    named = members.join(root, members["sid"] == root["id"], "left").withColumn("c", F.xxhash64(F.coalesce("root", "sid")))
    named = written(named.select("sid", "gid", "bits", "c"), "named")
    comps = named.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    spread = written(entries.select("shingle", "gid", "n", "pos").join(comps, "gid"), "spread")
    drop(entries, members)
    entry = spread
    mixed = entry.groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("shingle")
    entry = entry.select("shingle", "gid", "n", "pos").join(written(mixed, "mixed"), "shingle", "left_semi")
    # beside a group that is one set its bitmap, so that postings can be told apart where they meet
    whole = [F.when(F.count("*") == 1, F.max(F.get("bits", F.lit(i)))).alias(f"w{i}_") for i in range(WORDS)]
    entry = written(entry.join(named.groupBy("gid", "c").agg(*whole), "gid"), "mixed")
    parts = entry.groupBy("shingle", "c").agg(F.count("*").alias("size"))
    main = written(parts.groupBy("shingle").agg(F.max(F.struct("size", "c"))["c"].alias("main")), "main")
    bits = named.groupBy("gid", "c").agg(F.collect_list(F.struct("sid", "bits")).alias("sets"))
    drop(spread)
    entry = entry.join(main, "shingle")
    words = [f"w{i}_" for i in range(WORDS)]
    names = {c: f"{c}2" for c in ("gid", "n", "pos", "c", *words)}
    small = entry.where("c != main").select("shingle", "gid", "n", "pos", "c", *words)
    every = entry.select(F.col("shingle").alias("shingle2"), "main", *[F.col(c).alias(d) for c, d in names.items()])
    fits = (F.col("c") != F.col("c2")) & ((F.col("c2") == F.col("main")) | (F.col("c") < F.col("c2"))) & _possible(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), num, den)
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}2"))) for w in words), F.lit(0))
    fits = fits & F.coalesce(_enough(F.floor((F.col("n") + F.col("n2") - apart) / 2), F.col("n"), F.col("n2"), num, den), F.lit(True))
    second = small.join(every, (F.col("shingle") == F.col("shingle2")) & fits)
    second = written(second.select("gid", "c", "n", "gid2", "c2", "n2").distinct(), "group-pairs")
    one = bits.select("gid", "c", F.col("sets").alias("x"))
    two = bits.select(F.col("gid").alias("gid2"), F.col("c").alias("c2"), F.col("sets").alias("y"))
    second = second.join(one, ["gid", "c"]).join(two, ["gid2", "c2"]).select("n", "n2", "y", F.explode("x").alias("x")).select("n", "n2", "x", F.explode("y").alias("y"))
    second = second.where(_alike(F.col("n"), F.col("x.bits"), F.col("n2"), F.col("y.bits"), num, den))
    second = second.select(F.least("x.sid", "y.sid").alias("x"), F.greatest("x.sid", "y.sid").alias("y")).distinct()
    done = first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    second = written(second.join(done, ["x", "y"], "left_anti"), "pairs")
    more = written(_verified(second, thin, sets, k, lower, num, den), "links")
    if not more.isEmpty():
        edges = links.union(more).select(F.col("x").alias("a"), F.col("y").alias("b"))
        root = written(components(edges), "roots")
    drop(named, second)
    return _labelled(docs, sets, root.select(F.col("id").alias("sid"), "root"))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, lower: bool, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of set ids that link, judged on the whole sets, which are read again from one document each."""
    wanted = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
    rows = written(sets.join(wanted, "sid", "left_semi").select("row").distinct(), "wanted")
    texts = semi_by_size(docs, rows, ["row"])
    found = texts.select("text").mapInArrow(lambda b: _sets(b, k, lower), "sid binary, set array<long>")
    found = written(found.dropDuplicates(["sid"]), "sets")
    left = pairs.join(found.select(F.col("sid").alias("x"), F.col("set").alias("sx")), "x")
    both = left.join(found.select(F.col("sid").alias("y"), F.col("set").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy")).cast("long")
    rows = both.select("x", "y", shared.alias("shared"), F.size("sx").cast("long").alias("n"), F.size("sy").cast("long").alias("m"))
    return rows.where(_enough(F.col("shared"), F.col("n"), F.col("m"), num, den)).select("x", "y")


def _labelled(docs: DataFrame, sets: DataFrame, root: DataFrame) -> DataFrame:
    """Each document with its component's least id; only sets with copies or links need a look-up."""
    tied = sets.join(root, "sid", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "sid"))
    low = tied.groupBy("root").agg(F.min("id").alias("low"))
    labels = written(tied.select("sid", "root").join(low, "root").select("sid", "root", "low"), "labels")
    return docs.select("row", "id", "n", "sid").join(labels, "sid", "left").select("row", "id", "n", "root", "low")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 0.8 or more on five-word shingles, with its own columns: the least by doc_id (null
    last), then by a hash of id and text. Documents without a word link with nothing and stay."""
    rows = written(_linked(docs, "doc_id", "text", 5, 80, 100, True).where("root is not null").select("row", "id", "root"), "tied")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("best"))
    rows = rows.join(best, "root")
    gone = written(rows.where("row <> best").select(F.col("row").alias("__gone")).distinct(), "gone")
    row = F.xxhash64("doc_id", "text")
    left = docs.join(gone, row == gone["__gone"], "left_anti")
    again = written(rows.where("row = best").groupBy("row").agg(F.count("*").alias("times")).where("times > 1").select(F.col("row").alias("__again")), "again")
    if again.isEmpty():
        return left
    once = left.join(again, row == again["__again"], "left_semi").withColumn("__row", row).dropDuplicates(["__row"]).drop("__row")
    return left.join(again, row == again["__again"], "left_anti").union(once)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, gram FROM (
    SELECT rid, array_to_string(w[i:i+2], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
    UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.rid < b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
s AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, s.y FROM reach JOIN s ON reach.b = s.x) SELECT a, b FROM reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.rid = d.rid
JOIN (SELECT r.a, min(t.doc_id) AS component_id FROM r JOIN d t ON t.rid = r.b GROUP BY r.a) c ON c.a = d.rid
"""
