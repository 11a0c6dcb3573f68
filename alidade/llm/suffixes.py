"""Suffix-array dedup: sorted, front-coded runs of suffixes are exchanged by range and merged by their common prefixes.

Every byte covered by a string of `length` bytes that starts anywhere else as well is removed. A string's *anchor* is its
least-hashed gram (leftmost of equals), so equal strings have their anchors at the same place, and only suffixes that
start at anchors are sorted: about one byte in 85 at 200 bytes. A suffix carries the bytes to the left of its anchor that
its strings reach back to. Where the anchor's gram occurs once in all texts there is nothing to sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import documents, shared_dir, written

LENGTH = 200
#: Bytes of text that are hashed at once, and suffixes of one sorted run.
SEGMENT = 1 << 20
RUN = 1 << 13
#: Suffixes that one merge is meant to hold, and keys of the sample that splits the order: so many a range, at most so many in all.
PART = 1 << 16
KEYS_A_PART, KEYS = 64, 1 << 16


# --- anchors ---


def gram_of(length: int) -> int:
    """Bytes of a gram: the largest power of two up to a sixth of the length, 32 at most."""
    return 1 << min(5, max(0, (length // 6).bit_length() - 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, anchor, gram hash) of each run of strings with one anchor; buf holds texts one after the other that
    end at `ends`; low and high are the first and last start of the run's strings."""
    gram = gram_of(length)
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none
    h, step, factor = _BYTES[buf], 1, 0xD6E8FEB86659FD93
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
    h = _mixed(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    wide, reach = length - gram + 1, 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if wide > reach:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    has = ends - starts >= length
    edges = np.zeros(len(at) + 1, np.int64)
    np.add.at(edges, starts[has], 1)
    np.add.at(edges, ends[has] - length + 1, -1)
    inside = np.cumsum(edges[:-1]) > 0
    fresh = np.ones(len(at), bool)
    fresh[1:] = at[1:] != at[:-1]
    fresh[starts[has]] = True
    last = np.ones(len(at), bool)
    last[:-1] = fresh[1:] | ~inside[1:]
    low, high = np.flatnonzero(inside & fresh), np.flatnonzero(inside & last)
    return low, high, at[low], h[at[low]].view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, low, back, more, gram): back = anchor - low, more = high - low."""

    def rows(pieces: list) -> pa.RecordBatch:
        ends = np.cumsum([len(p[3]) for p in pieces])
        low, high, at, gram = anchors(np.frombuffer(b"".join(p[3] for p in pieces), np.uint8), ends, length)
        whose = np.searchsorted(ends, low, side="right")
        k1, k2, begin = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
        shift = begin - np.concatenate([[0], ends[:-1]])
        columns = (k1[whose], k2[whose], low + shift[whose], (at - low).astype(np.int32), (high - low).astype(np.int32), gram)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k1", "k2", "low", "back", "more", "gram"])

    pieces, size = [], 0
    for batch in batches:
        for k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text"))):
            for begin in range(0, max(1, len(text) - length + 1), SEGMENT):  # pieces overlap by one string less a byte
                pieces.append((k1, k2, begin, text[begin : begin + SEGMENT + length - 1]))
                size += len(pieces[-1][3])
                if size >= SEGMENT:
                    yield rows(pieces)
                    pieces, size = [], 0
    if pieces:
        yield rows(pieces)


# --- sorted runs, front-coded ---


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while a[known : known + 16] == b[known : known + 16]:
        known += 16
    differ = int.from_bytes(a[known : known + 16].ljust(16, b"\0"), "big") ^ int.from_bytes(b[known : known + 16].ljust(16, b"\0"), "big")
    return min(n, known + (128 - differ.bit_length()) // 8)


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the one before, length of the rest, all rests) of sorted strings; the numbers as int32."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = common(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, np.int32).tobytes(), np.array([len(r) for r in rests], np.int32).tobytes(), b"".join(rests)


def decoded(shared: bytes, sizes: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the one before, string), in order."""
    s, at = b"", 0
    for n, size in zip(np.frombuffer(shared, np.int32).tolist(), np.frombuffer(sizes, np.int32).tolist()):
        s = s[:n] + rests[at : at + size]
        at += size
        yield n, s


BLOCK = "run long, part int, first int, shared binary, sizes binary, rests binary, left_sizes binary, lefts binary, counts binary"
_BLOCK = [("run", pa.int64()), ("part", pa.int32()), ("first", pa.int32()), *((c, pa.binary()) for c in ("shared", "sizes", "rests", "left_sizes", "lefts", "counts"))]


def _block(run: int, part: int, first: int, entries: list) -> list:
    """entries: (right, left, count), sorted."""
    lefts = [e[1] for e in entries]
    return [run, part, first, *front_coded([e[0] for e in entries]), np.array([len(x) for x in lefts], np.int32).tobytes(), b"".join(lefts), np.array([e[2] for e in entries], np.int64).tobytes()]


def _entries(row: dict) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(common prefix with the one before, right, left, count) of a block."""
    at = 0
    sizes, counts = np.frombuffer(row["left_sizes"], np.int32).tolist(), np.frombuffer(row["counts"], np.int64).tolist()
    for (n, right), size, count in zip(decoded(row["shared"], row["sizes"], row["rests"]), sizes, counts):
        yield n, right, row["lefts"][at : at + size], count
        at += size


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the suffixes at the given anchors. Suffixes that are equal, with equal bytes to their left, make one
    entry with a count; the entry's places (`members`: entry, k1, k2, anchor) stay with the run and are not exchanged."""
    import secrets

    def run(found: list) -> pa.RecordBatch:
        found.sort()
        entries, members = [], np.empty((len(found), 4), np.int64)
        for i, (right, left, k1, k2, at) in enumerate(found):
            if entries and entries[-1][0] == right and entries[-1][1] == left:
                entries[-1][2] += 1
            else:
                entries.append([right, left, 1])
            members[i] = len(entries) - 1, k1, k2, at
        row = _block(secrets.randbits(62), 0, 0, entries)  # the table is written before it is read, so a run keeps its number
        sample = [e[0] for e in entries[:: max(1, len(entries) // KEYS_A_PART)]]
        arrays = [pa.array([v], t) for v, (_, t) in zip(row, _BLOCK)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([len(entries)], pa.int32()), pa.array([sample], pa.list_(pa.binary())), pa.array([members.tobytes()], pa.binary())], [*(c for c, _ in _BLOCK), "n", "sample", "members"])

    found = []
    for batch in batches:
        for row in batch.to_pylist():
            text = row["text"]
            for x in row["anchors"]:
                low, at = x["low"], x["low"] + x["back"]
                found.append((text[at : low + x["more"] + length], text[low:at], row["k1"], row["k2"], at))
                if len(found) >= RUN:
                    yield run(found)
                    found = []
    if found:
        yield run(found)


def _splitters(runs: DataFrame, gram: int) -> list[bytes]:
    """Keys that split the order of suffixes into ranges of about PART entries, from a bounded sample of the sorted runs.

    A key is cut to its gram, so that suffixes with one gram share a range; only where a gram fills a range alone, the
    whole suffix splits it.
    """
    total = runs.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // PART)
    if parts < 2:
        return []
    sample = runs.select(F.explode("sample").alias("s"), "run")
    wanted = min(KEYS, KEYS_A_PART * parts)
    rate = wanted / max(1, runs.agg(F.sum(F.size("sample"))).first()[0])
    keys = sorted(bytes(r.s) for r in sample.where(F.abs(F.xxhash64("run", "s")) % 1_000_003 < int(1_000_003 * min(1.0, rate))).limit(2 * KEYS).select("s").toLocalIterator())
    cut, before = [], None
    for i in range(1, parts):
        if not keys:
            break
        key = keys[len(keys) * i // parts]
        short = key[:gram]
        key = key if before is not None and before[:gram] == short else short
        if before is None or key > before:
            cut.append(key)
            before = key
    return cut


def _dealt(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Each run cut at the splitters; every piece is front-coded anew, its first entry whole."""
    from bisect import bisect_right

    for batch in batches:
        for row in batch.to_pylist():
            blocks, entries, first, part = [], [], 0, 0
            for i, (_, right, left, count) in enumerate(_entries(row)):
                if part < len(splitters) and right >= splitters[part]:
                    if entries:
                        blocks.append(_block(row["run"], part, first, entries))
                    part, entries, first = bisect_right(splitters, right), [], i
                entries.append((right, left, count))
            if entries:
                blocks.append(_block(row["run"], part, first, entries))
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], t) for i, (_, t) in enumerate(_BLOCK)], [c for c, _ in _BLOCK])


# --- the merge ---


def merged(runs: list[Iterator]) -> Iterator[tuple[int, int, tuple]]:
    """(run, common prefix with the one before, entry) of all runs' entries in order, by a loser tree.

    An entry is (common prefix with its run's last, string, ...). Each loser is kept with the length of the prefix that it
    shares with the string that beat it. All strings that meet on a path were compared with the last winner, so the longer
    of two prefixes wins unseen, and only equally long ones are read, from their end on.
    """
    k = len(runs)
    done = object()
    heads = [next(r, done) for r in runs]
    known = [0] * k
    losers = [-1] * k  # inner nodes 1..k-1; leaves are k..2k-1

    def beats(a: int, b: int) -> bool:
        """Whether the head of run a comes before that of b; the loser's known prefix is set."""
        x, y = heads[a], heads[b]
        if x is done or y is done:
            return y is done
        if known[a] != known[b]:
            return known[a] > known[b]
        s, t = x[1], y[1]
        n = common(s, t, known[a])
        first = len(s) == n if n in (len(s), len(t)) else s[n] < t[n]
        known[b if first else a] = n
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won, lost = (a, b) if beats(a, b) else (b, a)
        losers[node] = lost
        return won

    top = build(1) if k > 1 else 0
    while heads[top] is not done:
        yield top, known[top], heads[top]
        heads[top] = next(runs[top], done)
        known[top] = heads[top][0] if heads[top] is not done else 0
        node = (top + k) // 2
        while node:
            other = losers[node]
            x, y = known[top], known[other]
            if heads[other] is not done and (heads[top] is done or y > x or (x == y and not beats(top, other))):
                losers[node], top = top, other
            node //= 2


def _classes(order: np.ndarray, shared: np.ndarray, at_least: int) -> np.ndarray:
    """Class of each entry: neighbours in `order` that share `at_least` bytes are of one class."""
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(shared < at_least)
    return found


def repeats(rights: list[bytes], shared: np.ndarray, lefts: list[bytes], counts: np.ndarray, length: int, low: bytes | None, high: bytes | None) -> tuple[list, list]:
    """Which strings of a range's sorted entries start elsewhere as well.

    Returns rows (entry, first, last) of strings that begin `first` to `last` bytes left of the anchor and are repeated in
    the range, and rows (entry, back, string, copies) of strings whose equals may lie on both sides of a splitter.
    A string is a left part of d bytes and a right part of length - d: of one class in the order of the rights at length - d
    and in the order of the reversed lefts at d.
    """
    n = len(rights)
    reach = np.array([len(x) for x in lefts], np.int32)
    least = length - np.array([len(x) for x in rights], np.int32)
    backward = [x[::-1] for x in lefts]
    by_left = np.array(sorted(range(n), key=backward.__getitem__), np.int64)
    left_shared = np.array([0, *(common(backward[a], backward[b]) for a, b in zip(by_left[:-1], by_left[1:]))], np.int32)
    own = np.arange(n)
    near_low = np.array([common(r, low) if low else -1 for r in rights]) if low else np.full(n, -1)
    near_high = np.array([common(r, high) if high else -1 for r in rights]) if high else np.full(n, -1)
    since = np.full(n, -1, np.int32)
    rows, open_rows = [], []
    for d in range(int(least.min()), int(reach.max()) + 2):
        alive = np.flatnonzero((least <= d) & (d <= reach))
        here = np.zeros(n, bool)
        if len(alive):
            r, l = _classes(own, shared, length - d)[alive], _classes(by_left, left_shared, d)[alive]
            _, which = np.unique(r * (n + 1) + l, return_inverse=True)
            copies = np.bincount(which, weights=counts[alive])[which]
            here[alive] = copies > 1
            cut = (near_high[alive] >= length - d) | ((near_low[alive] >= length - d) & (len(low or b"") > length - d))
            for i, c in zip(alive[cut].tolist(), copies[cut].tolist()):
                open_rows.append((i, d, lefts[i][len(lefts[i]) - d :] + rights[i][: length - d], int(c)))
        ended = np.flatnonzero((since >= 0) & ~here)
        rows += zip(ended.tolist(), since[ended].tolist(), [d - 1] * len(ended))
        since[ended] = -1
        since[here & (since < 0)] = d
    return rows, open_rows


VERDICT = "run long, entry int, first int, last int, digest binary, copies long"


def _judged(batches: Iterator[pa.RecordBatch], splitters: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """Verdicts of the blocks of each range, which come sorted by `part`: the digest is null where the range decides."""
    import hashlib

    def judge(part: int, blocks: list[dict]) -> pa.RecordBatch:
        whose, places, rights, lefts, shared, counts = [], [0] * len(blocks), [], [], [], []
        for k, prefix, (_, right, left, count) in merged([_entries(b) for b in blocks]):
            whose.append((blocks[k]["run"], blocks[k]["first"] + places[k]))
            places[k] += 1
            rights.append(right)
            lefts.append(left)
            shared.append(prefix)
            counts.append(count)
        low = splitters[part - 1] if part else None
        high = splitters[part] if part < len(splitters) else None
        rows, open_rows = repeats(rights, np.array(shared, np.int32), lefts, np.array(counts, np.int64), length, low, high)
        rows = [(*whose[i], a, b, None, None) for i, a, b in rows] + [(*whose[i], d, d, hashlib.blake2b(s, digest_size=16).digest(), c) for i, d, s, c in open_rows]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["run", "entry", "first", "last", "digest", "copies"])

    part, blocks = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and blocks:
                yield judge(part, blocks)
                blocks = []
            part = row["part"]
            blocks.append(row)
    if blocks:
        yield judge(part, blocks)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, members in zip(batch.column("run").to_pylist(), batch.column("members").to_pylist()):
            m = np.frombuffer(members, np.int64).reshape(-1, 4)
            columns = [np.full(len(m), run), m[:, 0].astype(np.int32), m[:, 1], m[:, 2], m[:, 3]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["run", "entry", "k1", "k2", "at"])


# --- the operator ---


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with the bytes of their texts and a key of 128 bits for each different text."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumns({"__text": t.cast("binary"), "__k1": F.xxhash64(F.lit(1), t), "__k2": F.xxhash64(F.lit(2), t)})


def folded(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Table (k1, k2, copies, text) of the different texts of at least `length` bytes, bucketed by key in the shared folder."""
    spark = docs.sparkSession
    rows = _keyed(docs, text).where(F.octet_length("__text") >= length)
    rows = rows.groupBy(F.col("__k1").alias("k1"), F.col("__k2").alias("k2")).agg(F.count("*").alias("copies"), F.first("__text").alias("text"))
    name = f"suffix_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(parts, "k1", "k2").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (k1, k2, start, end) of the repeated stretches of texts (k1, k2, text), in bytes; stretches may overlap."""
    found = written(texts.select("k1", "k2", "text").mapInArrow(lambda b: _anchor_rows(b, length), "k1 long, k2 long, low long, back int, more int, gram long"), "anchors")
    grams = found.groupBy("gram").count().where("count > 1").select("gram")
    wanted = found.join(grams, "gram", "left_semi").groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "back", "more")).alias("anchors"))
    runs = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "anchors")
    runs = written(runs.mapInArrow(lambda b: _runs(b, length), f"{BLOCK}, n int, sample array<binary>, members binary"), "runs")
    cut = _splitters(runs, gram_of(length))
    blocks = runs.select(*(c for c, _ in _BLOCK))
    if cut:
        blocks = blocks.mapInArrow(lambda b: _dealt(b, cut), BLOCK)
    blocks = blocks.repartition(len(cut) + 1, "part").sortWithinPartitions("part")
    verdicts = written(blocks.mapInArrow(lambda b: _judged(b, cut, length), VERDICT), "verdicts")
    both = verdicts.where("digest is not null").groupBy("digest").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 1").select("digest")
    sure = verdicts.where("digest is null").union(verdicts.where("digest is not null").join(both, "digest", "left_semi").select(*verdicts.columns))
    places = runs.select("run", "members").mapInArrow(_places, "run long, entry int, k1 long, k2 long, at long")
    return places.join(sure.select("run", "entry", "first", "last"), ["run", "entry"]).select("k1", "k2", (F.col("at") - F.col("last")).alias("start"), (F.col("at") - F.col("first") + length).alias("end"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text = r["text"]
            spans = [{"start": 0, "end": len(text)}] if r["copies"] > 1 else []
            for s in [] if spans else sorted((s["start"], s["end"]) for s in r["spans"] or []):
                if spans and s[0] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s[1])
                else:
                    spans.append({"start": s[0], "end": s[1]})
            ends = [0, *(s["end"] for s in spans)]
            kept = b"".join(text[a:b] for a, b in zip(ends, [*(s["start"] for s in spans), len(text)]))
            rows.append((r["k1"], r["k2"], spans, kept))
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["k1", "k2", "removed_spans", "kept"])


def cut_texts(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (k1, k2, removed_spans, kept) of the different texts of at least `length` bytes: the maximal removed runs and
    the remaining bytes. A text with copies goes whole; one copy of it is compared with the others."""
    texts = folded(docs, text, length)
    spans = repeated(texts, length).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "k1 long, k2 long, removed_spans array<struct<start: long, end: long>>, kept binary"
    return texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "copies", "text", "spans").mapInArrow(_cut, schema)


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, removed_spans and kept (bytes that remain) of each whole text; input columns of these names go.

    A null text is empty. Texts shorter than `length` bytes keep everything, and so does an only text without repeats.
    Rows with equal texts have equal results, whatever their ids; no rows give no rows.
    """
    names = ("n_bytes", "removed_spans", "kept")
    keep = [c for c in docs.columns if c.lower() not in names]
    cut = cut_texts(docs, text, length)
    cut = cut.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "removed_spans", "kept")
    rows = _keyed(docs, text).select(*(F.col(f"`{c}`") for c in keep), "__text", "__k1", "__k2").join(cut, ["__k1", "__k2"], "left")
    spans = F.coalesce("removed_spans", F.expr("cast(array() as array<struct<start: long, end: long>>)"))
    return rows.select(*(F.col(f"`{c}`") for c in keep), F.octet_length("__text").cast("long").alias("n_bytes"), spans.alias("removed_spans"), F.coalesce("kept", "__text").alias("kept"))


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what remains, from cut_texts(): texts stay where they are."""
    cut = cut_texts(docs.select("text"), "text", length)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cut = cut.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    rows = _keyed(docs.select("doc_id", "text"), "text")
    own = F.when(F.octet_length("__text") < length, F.sha2("__text", 256))
    rows = rows.select("doc_id", "__k1", "__k2", F.octet_length("__text").cast("long").alias("n_bytes"), own.alias("own"))
    rows = rows.join(cut, ["__k1", "__k2"], "left")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


SQL = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
strings as (select rid, s, md5(substr(h, 2 * s + 1, 400)) as m
            from (select rid, h, unnest(range(0, length(h) // 2 - 199)) as s from d where length(h) >= 400)),
twice as (select rid, s from (select rid, s, count(*) over (partition by m) as n from strings) where n > 1),
marked as (select rid, s, case when s <= lag(s) over (partition by rid order by s) + 200 then 0 else 1 end as fresh from twice),
numbered as (select rid, s, sum(fresh) over (partition by rid order by s) as k from marked),
spans as (select rid, k, min(s) as a, max(s) + 200 as b from numbered group by rid, k),
gaps as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as since from spans),
cut as (select g.rid, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
               string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as kept
        from gaps g join d on d.rid = g.rid group by g.rid)
select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(case when last is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from d left join cut on d.rid = cut.rid
"""
