"""Operators 11 to 13 on small fixtures: brute force over all strings, all scores and all orders; odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import pytest

from alidade.llm import filters, ranked, suffixes

SCHEMA = "doc_id long, text string, source string, kept string, rank int, part string"
ODD = [(1, None, None), (2, "", "s"), (2, "", "s"), (None, "one two three", "s"), (3, " \n\t\n ", "t"), (4, "x " * 30000, None), (5, "one two three", ""), (6, "é" * 300, "t")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "a", 1, "b") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 0, 1), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


# --- 11 ---


def removed(texts, length):
    """(bytes, bytes removed, spans, hash of the rest) of each text by looking up all strings."""
    bs = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in bs for i in range(len(b) - length + 1))
    for b in bs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()


@pytest.mark.parametrize("length", [12, 200])
def test_suffixes_by_brute_force(length, spark, monkeypatch):
    """Few suffixes a range, so that splitters cut grams as well."""
    monkeypatch.setattr(suffixes, "PART", 60)
    rng = random.Random(length)
    passages = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(length // 2, 3 * length))) for _ in range(6)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdé ") for _ in range(rng.randrange(3 * length))) for _ in range(rng.randrange(5))) for _ in range(80)]
    hot = passages[0][: length // 2]  # one gram in many different surroundings
    texts += [f"{rng.random()}" * 2 + hot + f"{rng.random()}" * 20 for _ in range(60)]
    texts += [texts[0]] * 4 + ["a" * (5 * length), None, "", "ab" * length, "\0" * (2 * length), passages[0] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs, length).collect()}
    assert got == dict(enumerate(removed(texts, length)))


def test_merge_of_runs():
    rng = random.Random(3)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))) for _ in range(7)]
    got = list(suffixes.merged([suffixes.decoded(*suffixes.front_coded(r)) for r in runs]))
    strings = [e[1] for _, _, e in got]
    assert strings == sorted(s for r in runs for s in r)
    assert [n for _, n, _ in got] == [0, *(suffixes.common(a, b) for a, b in zip(strings, strings[1:]))]


def test_suffixes_of_odd_rows(spark, odd, empty):
    rows = suffixes.dedup(odd).collect()
    got = {(r.doc_id, r.source): (r.n_bytes, len(r.removed_spans), bytes(r.kept)) for r in rows}
    assert len(rows) == 8 and got[1, None] == (0, 0, b"") and got[4, None] == (60000, 1, b"") and got[6, "t"] == (600, 1, b"")
    assert got[None, "s"] == got[5, ""] == (13, 0, b"one two three")
    assert "rank" in rows[0] and suffixes.dedup(empty).count() == 0 and suffixes.digests(empty.select("doc_id", "text")).count() == 0


# --- 12 ---


def scores(docs, item):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, collections.Counter(cut(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = collections.Counter(t for _, c in texts for t in c)
    for doc_id, c in texts:
        m = 75 + (25 * sum(c.values()) * n_docs) // max(1, length)
        s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in collections.Counter(cut(item)).items() if t in c)
        if s > 0:
            yield -s, doc_id is None, doc_id or 0


@pytest.mark.parametrize("bound", [None, 0])
def test_search_by_brute_force(bound, spark, monkeypatch):
    """Ties, repeated ids, null ids and items; with few terms in one set and with all postings joined, in several blocks."""
    if bound is not None:
        monkeypatch.setattr(ranked, "MOST_TERMS", bound)
        monkeypatch.setattr(ranked, "MOST_PAIRS", 20)
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.5)) % 200}" + rng.choice(["", "É", "é"]) for _ in range(400)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words).title() for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (200, None), (201, "")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15)))) for i in range(12)] + [(50, None), (51, "unseen"), (None, words[0])]
    got = collections.defaultdict(list)
    for r in ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), 5).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    for item_id, text in items:
        want = sorted(scores(docs, text))[:5]
        assert sorted(got[item_id]) == [(i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(want)], item_id


def test_search_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "One, TWO", "x")], "item_id long, text string, score string")
    got = [(r.doc_id, r["rank"]) for r in ranked.search(odd, items).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(5, 1), (None, 2)]
    assert ranked.search(empty, items).count() == 0 and ranked.search(odd, items.where("false")).count() == 0


# --- 13 ---


def audited(docs, good, toxic):
    """All rows of the audit by applying each order to the documents one by one."""
    fails, ids = {}, collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""].append(i)
    for row, (i, t, _) in enumerate(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(ids[t]) < i}
        fails[row] = {f for f in found if found[f]}
    out, total = {}, collections.Counter()
    for part in {p or "" for _, _, p in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in fails if (docs[r][2] or "") == part]
            for step, f in enumerate(order):
                gone = [r for r in left if f in fails[r]]
                mine = [r for r in fails if (docs[r][2] or "") == part and f in fails[r]]
                left = [r for r in left if f not in fails[r]]
                total[part, f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), len(mine) - len(gone), sum(fails[r] == {f} for r in mine), sum(docs[r][0] in good for r in gone), sum(docs[r][0] in toxic for r in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def table(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_by_brute_force(spark):
    """Small blocks, so that classes are split in several steps: texts that differ in the first, a middle or the last block."""
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Ab", "cd", "e#f", "gh", "é", "I"]) + str(rng.randrange(k)) for _ in range(n)) for k, n in [(2, 10), (90, 70), (3, 60), (200, 400)]]
    near = [t[:at] + "~" + t[at + 1 :] for t in base for at in (0, len(t) // 2, len(t) - 1)]
    texts = [rng.choice(base + near) for _ in range(120)] + ["", None, "x"]
    docs = [(rng.randrange(100) if rng.random() < 0.9 else None, t, rng.choice(["s", "t", None, ""])) for t in texts]
    docs += docs[:10]
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    got = table(filters.audit(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3), labels, block=8).collect())
    assert got == audited(docs, set(range(1, 100, 2)), set(range(0, 100, 5)))


def test_texts_that_share_all_hashes(spark, monkeypatch):
    """Classes by hash are not trusted: with hashes of nothing, whole texts still tell documents apart."""
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "xyz"), (5, "xyz!")], "doc_id long, text string")
    rows = filters.described(docs.withColumn("source", filters.F.lit("s"))).withColumn("hashes", filters.F.array(filters.F.lit(7).cast("long")))
    assert [r.doc_id for r in filters.duplicates(docs, rows).collect()] == [3]


def test_audit_of_odd_rows(spark, odd, labels, empty):
    got = table(filters.audit(odd, labels).collect())
    assert got == audited(ODD, {1, 5, None} - {None}, {3, 5}) and len(got) == 3 * 600
    assert filters.audit(empty, labels).count() == 0 and filters.audit(odd, labels.where("false")).count() == 1800
