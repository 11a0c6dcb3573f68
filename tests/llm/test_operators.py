"""The ten operators on small fixtures: brute force, libraries, odd rows (nulls, empty texts, repeats, clashing names)."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alidade.llm import bpe, common, fingerprints, kernels, licences, line_dedup, mixing, ngram_join, pieces, quality, registry, secrets, sharding

ODD = [(1, None, None, "a"), (2, "", "s", None), (2, "", "s", None), (None, "one two three", "s", "b"), (3, " \n\t\n ", "t", "c"), (4, "x " * 30000, None, "d")]
SCHEMA = "doc_id long, text string, source string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, spark, sf_dir, matches):
    matches(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name])


# --- 1 ---


def test_licences(spark, odd, empty):
    mit = "\n".join(v[0].capitalize() + "." for v in (licences.SENTENCES[k] for k in ("mit_title", "mit_grant", "mit_notice", "mit_disclaim")))
    wrapped = mit.replace(" of ", " of\n")
    rows = [(1, mit), (2, wrapped), (3, "Prose.\nReleased under the MIT License."), (4, "We like the MIT License and others."), (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].licences for k in range(1, 6)] == ["MIT", "MIT", "MIT", "", "Apache-2.0,CC-BY-NC-4.0"]
    assert got[1].n_known == 4 and got[1].sentence_ids == "<mit_title><mit_grant><mit_notice><mit_disclaim>"
    assert all(any(h in w for h in licences.HINTS) for ws in licences.SENTENCES.values() for w in ws)
    assert licences.scan(odd.withColumn("licences", F.lit("x"))).where("licences = ''").count() == 6 and licences.scan(empty).count() == 0


# --- 2 ---


def test_sharding(spark, odd, empty):
    got = sharding.interleave(odd.withColumn("shard", F.lit(7)), shards=4).collect()
    per = collections.Counter(r.shard for r in got)
    assert len(got) == 6 and max(per.values()) - min(per[k] for k in range(4)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(per[k])) for k in per)
    assert sharding.interleave(empty).count() == 0
    many = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"))
    rows = sharding.interleave(many).collect()
    hot = collections.Counter(r.shard for r in rows if r.source == "hot")
    assert set(collections.Counter(r.shard for r in rows).values()) == {100} and all(abs(hot[k] - 800 / 24) <= 2 for k in range(24))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.interleave(many.repartition(7)).collect()))


def test_sharding_columns(spark, sf_dir):
    text = {r.doc_id: r.text for r in common.documents(spark, sf_dir).collect()}
    for r in sharding.query(spark, sf_dir).collect():
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)


# --- 3 ---


def brute_base(t):
    pats = (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")
    found = []
    for k, (p, least) in enumerate(zip(pats, (8, 16, 32))):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[2] if k == 0 else m[0]) >= least]
    return sorted(found)


def test_secrets(spark, odd, empty, sf_dir):
    rnd = random.Random(4)
    bits = ["password", "API_KEY", "apikey", "Secret", "tokens", "=", ": ", '"', "'", " ", "\n", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef0123456789abcdef", "deadbeef", "é", "ſecret", "x.y-z_1", "hunter22"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    texts += [r.text for r in common.documents(spark, sf_dir).collect()]
    for t in texts:
        assert secrets.base_spans(t) == brute_base(t)
    key = "xK9vQ2mZr7LpT4wB8nYc3HdF"
    rows = spark.createDataFrame([(1, f"key is {key} here"), (2, "getRemoteConnectionManagerFactory and documentation_of_internationalization"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(rows).collect()}
    assert got[1].spans == f"markov:7:{7 + len(key)}" and got[2].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(odd.withColumn("spans", F.lit(1))).count() == 6 and secrets.scan(empty).count() == 0


def test_secret_models_on_held_out_samples():
    judge = secrets.Detector()
    rows = secrets.labelled_samples(3000, 12345)
    assert sum(judge.is_secret(s) for s, y in rows if y) >= 0.98 * 1500
    assert sum(judge.is_secret(s) for s, y in rows if not y) <= 0.005 * 1500


# --- 4 and 7 ---


@pytest.fixture(scope="module")
def hard_texts(spark, sf_dir):
    rnd = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "in", "ing", "▁", "1x", "Ü", "=", "====", "00", "it's", "'LL", "<|endoftext|>", "<s>", "🎉", "\t", "\x1c", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    return texts + [r.text for r in common.documents(spark, sf_dir).limit(60).collect()] + ["՘b՘", "", " ", "a" * 3000]


def test_token_counts(spark, hard_texts, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, lib = bpe.HeapCounter(open(path, "rb").read()), Tokenizer.from_file(path)
    assert [own.count(t) for t in hard_texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in hard_texts]
    got = bpe.count_tokens(odd.withColumn("n_tokens", F.lit("x")), path, limit=100).collect()
    assert sorted((r.n_tokens, r.over_limit) for r in got)[:3] == [(0, False)] * 3 and max(r.n_tokens for r in got) > 30000 and len(got) == 6
    assert bpe.count_tokens(empty, path).count() == 0


def test_pieces(spark, hard_texts, odd, empty):
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor

    path = P.path("piece_bpe_32k.model")
    lib = SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(hard_texts)), "doc_id long, text string").repartition(3)
    for r in pieces.decode(pieces.encode(df, path), path).collect():
        assert r.ids == lib.encode(r.text) and r.decoded == lib.decode(r.ids) == r.text.replace("▁", " ")
    got = pieces.decode(pieces.encode(odd, path), path)
    assert got.columns == ["doc_id", "text", "source", "ids", "decoded"] and got.count() == 6 and pieces.encode(empty, path).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in pieces.decode(none, path).orderBy("k").collect()] == [None, ""]


# --- 5 ---


def test_line_dedup(spark, empty):
    long = "the quick brown fox jumps over the lazy dog while seventeen curious onlookers watch from behind an old wooden fence near river"
    rows = [(1, f"{long}\nonly here one"), (2, f"{long.upper()}!\nonly here two"), (3, None), (4, ""), (5, "\n--\n\n--"), (2, f"{long.upper()}!\nonly here two"), (None, "no id line\nno id line"), (6, "only here one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x")).withColumn("source", F.lit("s"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == 7  # the repeated row is returned once
    assert got[1].text == rows[0][1] and got[2].text == "only here two" and got[3].text is None and got[4].text == "" and got[5].text == rows[4][1]
    assert got[None].text == "no id line" and got[6].text == "" and (got[2].n_lines, got[2].n_removed) == (2, 1)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_against_brute_force(spark, sf_dir):
    """All pairs of lines by DuckDB's edit distance: nothing else goes, and nearly all that should go does."""
    rnd = random.Random(3)
    base = [(r.doc_id, r.text) for r in common.documents(spark, sf_dir).limit(80).collect()]
    some = [x for _, t in base for x in t.split("\n") if len(x.split()) > 25][:40]
    for k, x in enumerate(some):
        w = x.split()
        w[rnd.randrange(len(w))] = "changed"
        base.append((10_000 + k, " ".join(w) + f"\nown line number {k} of this text"))
    df = spark.createDataFrame(base, "doc_id long, text string")
    lines = [(i, p, " ".join(re.sub(r"[^\w\n]|_", " ", x.lower()).split())) for i, t in base for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    distinct = sorted({x[2] for x in lines})
    con = duckdb.connect()
    con.execute("create table l (k int, line varchar)")
    con.executemany("insert into l values (?, ?)", list(enumerate(distinct)))
    pairs = con.execute("select a.k, b.k from l a join l b on a.k < b.k and 5 * abs(length(a.line) - length(b.line)) <= greatest(length(a.line), length(b.line)) and (length(a.line) < 60 or len(list_intersect(string_split(a.line, ' '), string_split(b.line, ' '))) * 4 >= len(list_distinct(string_split(a.line, ' ')))) where 5 * levenshtein(a.line, b.line) <= greatest(length(a.line), length(b.line))").fetchall()
    parent = list(range(len(distinct)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[find(a)] = find(b)
    at = {x: k for k, x in enumerate(distinct)}
    groups = collections.defaultdict(list)
    for i, p, x in lines:
        groups[find(at[x])].append((i, p))
    gone = collections.Counter(i for occ in groups.values() for i, p in occ if (i, p) != min(occ))
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()}
    assert set(got) == {i for i, _ in base} and all(got[i] <= gone[i] for i in got)
    assert len(pairs) > 60 and sum(got.values()) >= 0.97 * sum(gone.values())
    assert sum(got[10_000 + k] > 0 for k in range(len(some))) >= 0.95 * len(some)


@pytest.mark.parametrize("n", [6, 8, 10, 15, 25, 40, 80])
def test_one_word_changed(n, spark, tmp_path):
    """Of 100 pairs of lines of n words that differ in one word nine in ten are found at the least."""
    rnd = random.Random(100 + n)
    pairs = []
    while len(pairs) < 100:
        a = invented(rnd, n)
        b = list(a)
        b[rnd.randrange(n)] = invented(rnd, 1)[0]
        a, b = " ".join(a), " ".join(b)
        if a != b and 5 * edits(a, b) <= max(len(a), len(b)):
            pairs.append((a, b))
    assert sum(removed_copies(spark, tmp_path, pairs)) >= 90


def test_line_dedup_in_a_block_of_all_lines(spark, tmp_path):
    """Pairs whose only common words are those of all lines, and whose other words all have another first letter, go."""
    rnd = random.Random(29)
    common_words = " ".join(invented(rnd, 5))
    pairs = []
    for _ in range(150):
        rest = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(3)]
        pairs.append(tuple(f"{common_words} {' '.join(first + r for r in rest)}" for first in "xy"))
    assert all(removed_copies(spark, tmp_path, pairs))


def test_line_dedup_meets_blocks_in_slices(spark, monkeypatch):
    """Lines of one block that share a tenth of their words are told apart before their texts; slices of blocks and pairs lose no link."""
    rnd = random.Random(41)
    beginning, often = invented(rnd, 4), invented(rnd, 2)
    rows = []
    for k in range(60):
        rest = often + invented(rnd, 54)
        rnd.shuffle(rest)
        rows += [(2 * k, " ".join(beginning + rest)), (2 * k + 1, " ".join(beginning + rest[:-2] + ["changed"]))]
    df = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("th"), "text")
    per = common.written(line_dedup.distinct_lines(line_dedup.signed_lines(df)), "distinct")
    # all lines in one block more, so that each pair meets
    per = per.withColumn("keys", F.concat("keys", F.array(F.lit(1).cast("long"))))
    met = {tuple(r) for r in line_dedup._candidates(per, 0.8).collect()}
    assert 60 <= len(met) <= 120  # 7,140 pairs
    monkeypatch.setattr(line_dedup, "ENTRIES", 1000)
    monkeypatch.setattr(line_dedup, "PAIRS", 1)
    assert {tuple(r) for r in line_dedup._candidates(per, 0.8).collect()} == met
    got = line_dedup.dedup_lines(df.select("id", "text"), "id").where("n_removed > 0").collect()
    assert sorted(r.id for r in got) == list(range(1, 120, 2))


def test_line_dedup_tells_lines_of_a_block_apart(spark):
    """Of brief lines and lines of 130 words that all meet, hardly any but the similar ones are left for their texts, and all of those are."""
    rnd = random.Random(43)
    often, lines = invented(rnd, 30), []
    for n in [9, 12, 14, 15, 16, 17] * 5 + [130] * 12:
        w = rnd.sample(often, n // 8) + invented(rnd, n - n // 8)
        rnd.shuffle(w)
        lines += [" ".join(w), " ".join(w[:-1] + ["changed"]), " ".join(w[1:])]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string").select("id", F.xxhash64("text").alias("th"), "text")
    per = common.written(line_dedup.distinct_lines(line_dedup.signed_lines(df)), "distinct")
    per = per.withColumn("keys", F.concat("keys", F.array(F.lit(1).cast("long"))))
    at = {r.x: r.id for r in per.collect()}
    met = {tuple(sorted((at[r.x], at[r.y]))) for r in line_dedup._candidates(per, 0.8).collect()}
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if 5 * abs(len(lines[i]) - len(lines[j])) <= max(len(lines[i]), len(lines[j])) < 150 or i // 3 == j // 3}
    links = {(i, j) for i, j in near if 5 * edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))}
    assert len(links) >= 100 and links <= met and len(met - links) <= 20


def test_line_dedup_compares_a_group_once(spark, monkeypatch):
    """Lines that are linked by way of others are not compared again, and a chain of links stays one group."""
    rnd = random.Random(47)
    base = invented(rnd, 40)
    rows = [(k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(40)]
    step = invented(rnd, 40)
    for k in range(12):  # neighbours are similar, the ends are not
        rows.append((100 + k, " ".join(step)))
        step[3 * k : 3 * k + 3] = invented(rnd, 3)
    df = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("th"), "text")
    compared, verified = [], line_dedup._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    got = {r.id: r.n_removed for r in line_dedup.dedup_lines(df.select("id", "text"), "id").collect()}
    assert [i for i in sorted(got) if not got[i]] == [0, 100]
    assert sum(compared) <= 150  # of 780 pairs of the first group alone


def test_line_dedup_methods_are_compiled(spark):
    """The JVM leaves methods of over 8,000 bytes to its interpreter: no stage of the signing or the meeting of lines has one."""
    df = spark.createDataFrame([(1, "some words of a line")], "id long, text string").select("id", F.xxhash64("text").alias("th"), "text")
    signed = line_dedup.signed_lines(df)
    per = common.written(line_dedup.distinct_lines(signed), "distinct").withColumn("key", F.col("x"))
    pairs = per.alias("p").join(per.select(*[F.col(c).alias(f"o{c}") for c in ("key", "x", *line_dedup.SIGNS)]).hint("merge"), F.col("key") == F.col("okey")).where(line_dedup._near("", "o", 0.8))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in (signed, pairs):
            code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan._jdf.queryExecution().executedPlan())
            found = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
            assert found and max(found) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_line_dedup_of_odd_lines(spark):
    """Null ids and long lines are linked, hot lines and hot blocks keep one occurrence each."""
    rnd = random.Random(17)
    long, hot = invented(rnd, 20_000), " ".join(invented(rnd, 12))
    other = list(long)
    for k in range(0, 20_000, 40):
        other[k] = "changed"
    del other[::397]
    run = " ".join(invented(rnd, 3))
    rows = [(None, " ".join(invented(rnd, 30))), (1, " ".join(long)), (2, " ".join(other))]
    rows.append((3, rows[0][1].rsplit(" ", 1)[0] + " changed"))
    rows += [(10 + k, f"{hot}\n{run} {' '.join(invented(rnd, 9))}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()}
    assert got[None] == got[1] == got[10] == 0 and got[2] == got[3] == 1 and all(got[10 + k] == 1 for k in range(1, 60))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_copies(spark, folder, pairs):
    """Which of the pairs of lines lose the second one in the query, a document each."""
    rows = [(2 * k + j, line) for k, p in enumerate(pairs) for j, line in enumerate(p)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    gone = {r.doc_id for r in line_dedup.query(spark, str(folder)).where("n_removed > 0").collect()}
    assert all(i % 2 for i in gone)
    return [2 * k + 1 in gone for k in range(len(pairs))]


def invented(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 8))) for _ in range(n)]


def test_similar_lines_by_length(spark, tmp_path):
    rnd = random.Random(11)
    pairs, sizes = [], []
    for n in (13, 16, 20, 25, 40):
        while sizes.count(n) < 30:
            a = invented(rnd, n)
            b = list(a)
            for k in rnd.sample(range(n), rnd.randint(1, n // 6)):
                b[k] = invented(rnd, 1)[0]
            a, b = " ".join(a), " ".join(b)
            if a != b and 5 * edits(a, b) <= max(len(a), len(b)):
                pairs.append((a, b))
                sizes.append(n)
    found = collections.Counter(n for n, f in zip(sizes, removed_copies(spark, tmp_path, pairs)) if f)
    assert all(found[n] >= 27 for n in set(sizes)), found


@pytest.mark.parametrize("n", [6, 10, 20, 40])
def test_typing_errors(n, spark, tmp_path):
    """Of 40 pairs of lines of n words with 8 % of their letters changed nine in ten are found at the least."""
    rnd = random.Random(200 + n)
    pairs = []
    while len(pairs) < 40:
        a = " ".join(invented(rnd, n))
        b = list(a)
        at = [i for i, c in enumerate(b) if c != " "]
        for i in rnd.sample(at, round(0.08 * len(at))):
            b[i] = rnd.choice("abcdefghijklmnoprstuvw")
        b = "".join(b)
        if a != b and 5 * edits(a, b) <= len(a):
            pairs.append((a, b))
    assert sum(removed_copies(spark, tmp_path, pairs)) >= 36


def test_similar_lines_in_hot_blocks(spark, tmp_path):
    """200 pairs that share nothing but two blocks of all 400 lines, three of six words in the middle changed."""
    rnd = random.Random(13)
    head, tail = invented(rnd, 3), invented(rnd, 3)
    head, tail = [w + "ly" for w in head], [w + "on" for w in tail]
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(5))
    pairs = []
    while len(pairs) < 200:
        a = [word() for _ in range(6)]
        b = [word() if k % 2 else w for k, w in enumerate(a)]
        a, b = (" ".join(head + m + tail) for m in (a, b))
        if a != b and 5 * edits(a, b) <= max(len(a), len(b)):
            pairs.append((a, b))
    assert sum(removed_copies(spark, tmp_path, pairs)) >= 180


def test_similar_short_lines(spark, tmp_path):
    rnd = random.Random(12)
    pairs = [("internationalisation", "internationalization"), ("abcde", "abxde"), ("harbour lights", "harbor lights"), ("eding enin", "eding in")]
    for n in (6, 8, 9, 10, 12):
        for kind in ("replaced", "swapped", "repeated", "two") * 8:
            a = invented(rnd, n)
            b, k = list(a), rnd.randrange(n - 1)
            if kind == "swapped":
                b[k], b[k + 1] = b[k + 1], b[k]
            elif kind == "repeated":
                b.insert(k, b[k])
            else:
                for i in rnd.sample(range(n), 1 + (kind == "two")):
                    b[i] = invented(rnd, 1)[0]
            a, b = " ".join(a), " ".join(b)
            if a != b and 5 * edits(a, b) <= max(len(a), len(b)):
                pairs.append((a, b))
    assert len(pairs) > 80 and all(removed_copies(spark, tmp_path, pairs))


# --- 6 ---


def test_ngram_join(spark, empty, odd):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(500)]
    rows, n = [], 0
    for _ in range(25):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice((2, 3, 12, 60, 150)))]
        for _ in range(rnd.choice((1, 4, 12))):
            v = list(w)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = rnd.choice(vocabulary).upper()
            rows.append((n := n + 1, " ".join(v)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, rows[0][1]), (5, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80), (2, 100)):
        got = sorted((r.id, r.n_shingles, r.component_id) for r in ngram_join.linked(df, k=k, num=num).collect())
        sets = []
        for _, t in rows:
            w = words((t or "").lower())
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
        parent = list(range(len(rows)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    parent[find(i)] = find(j)
        low = {}
        for i, (d, _) in enumerate(rows):
            low[find(i)] = min(low.get(find(i), d), d)
        assert got == sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))
    assert ngram_join.linked(empty).count() == 0 and ngram_join.linked(odd).count() == 6
    with pytest.raises(ValueError):
        ngram_join.linked(df, num=101)


def test_ngram_join_of_odd_rows(spark):
    rnd = random.Random(21)
    text = invented(rnd, 60)
    near = " ".join([*text[:-1], "changed"])
    rows = [(4, " ".join(text)), (None, near), (7, " ".join(invented(rnd, 60))), (None, "x y z"), (None, " ".join(text[:-1])), (9, "lone word"), (9, "lone word"), (7, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(1)).withColumn("row", F.lit("r"))
    got = collections.Counter((r.id, r.component_id) for r in ngram_join.linked(df).collect())
    assert got == {(4, 4): 1, (None, 4): 2, (7, 7): 1, (None, None): 1, (9, 9): 2, (7, 4): 1}
    left = ngram_join.stage(spark, df, "")
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted((i or 0, t) for i, t in [rows[0], rows[2], rows[3], rows[5]])
    huge = " ".join(invented(rnd, 50_000))
    assert {r.component_id for r in ngram_join.linked(spark.createDataFrame([(1, huge), (2, huge + " more")], "doc_id long, text string")).collect()} == {1}


def test_shingle_hashes_agree_with_sets():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "b", "aa", "é", "日"]) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "\n", "\x0b x"]) for _ in range(300)] + [None, "x" * (kernels.CHUNK + 5) + " y z"]
    seen = {}
    for t, h in zip(texts, kernels.shingle_sets(pa.array(texts), 3)):
        w = words(t)
        want = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        assert len(h) == len(want)
        assert seen.setdefault(frozenset(want), h.tobytes()) == h.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {v: find(v) for p in pairs for v in p if p[0] != p[1]}


# --- 8 ---


def test_fingerprints(spark, sf_dir, odd, empty):
    docs = common.documents(spark, sf_dir)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compared(docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        s = lambda x: {tuple(words(x)[k : k + 5]) for k in range(max(1, len(words(x)) - 4))}
        if n > 1500:
            errors.append(abs(got[i].near_edited - len(s(t) & s(edited)) / len(s(t) | s(edited))))
    assert sum(errors) / len(errors) < 0.08
    a, b = fingerprints.sketches(pa.array(["a b c d e f g h " * 50 + "x y z", None]))
    assert len(b) == 0 and (fingerprints.read_in(fingerprints.written_out(a)) == a).all() and fingerprints.likeness(a, b) == 0.0
    assert fingerprints.compared(odd).count() == 6 and fingerprints.compared(empty).count() == 0 and fingerprints.compared(odd.where("doc_id = 4")).count() == 1
    assert fingerprints.fingerprint(odd.withColumn("fingerprint", F.lit(1))).count() == 6


def test_likeness_of_short_texts(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(n)) for n in range(1, 51)]
    rows = [(2 * k, t) for k, t in enumerate(texts)] + [(2 * k + 1, t) for k, t in enumerate(texts)] + [(-1, ""), (-2, None), (-3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = lambda x: {tuple(words(x)[k : k + 5]) for k in range(max(1, len(words(x)) - 4))}
    got = {r.doc_id: r for r in fingerprints.compared(df).collect()}
    for k, t in enumerate(texts):
        r = got[2 * k + 1]
        edited = t[: len(t) - len(t) // 2] + t[: len(t) // 2]
        assert r.fingerprint and r.near_next == 1.0 and r.near_edited == pytest.approx(len(s(t) & s(edited)) / len(s(t) | s(edited)))
    assert got[-1].near_edited == got[-1].near_next == 1.0 and got[-1].fingerprint == ""


def test_containment_of_unequal_texts():
    rnd = random.Random(5)
    big = [f"t{rnd.randrange(10**6)}" for _ in range(20000)]
    a, b = fingerprints.sketches(pa.array([" ".join(big[:3000]), " ".join(big)]))
    assert fingerprints.containment(a, b) == 1.0 and abs(fingerprints.containment(b, a) - 0.15) < 0.03


# --- 9 ---


def test_quality(spark, odd, empty):
    rows = [(1, "a b c d e " * 4), (2, "the cat sat on the mat and then it went off to sleep"), (3, "x y\nx y\n\nx z"), (4, "one two three four five six seven one two three four five eight nine ten")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_repeat_words, got[1].base_failed) == (20, True) and got[2].kept and got[3].n_dup_lines == 1 and got[4].n_repeat_words == 10
    got = quality.quality(odd.withColumn("kept", F.lit("x")))
    assert [f.dataType.typeName() for f in got.schema if f.name == "kept"] == ["boolean"] and got.where("kept").count() == 0 and quality.quality(empty).count() == 0


# --- 10 ---


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    cap, share, full = {s: 3 * v for s, v in sizes.items()}, {}, set()
    total = sum(sizes.values())
    while True:
        rest, w = total - sum(cap[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        share = {s: cap[s] if s in full else rest * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and share[s] > cap[s]}
        if not over:
            return share
        full |= over


def test_targets(spark):
    rnd = random.Random(6)
    for _ in range(6):
        sizes = {f"s{k}" if k else None: rnd.choice((0, 1, 10, 1000, 10**6)) + rnd.randrange(50) for k in range(rnd.randint(1, 9))}
        df = spark.createDataFrame([(s, int(v)) for s, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark, odd, empty):
    got = mixing.mix(odd.withColumn("rate", F.lit("x"))).collect()
    assert len(got) == 6 and all(0 <= r.copies <= 3 for r in got) and mixing.mix(empty).count() == 0
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    m = mixing.mix(rows)
    for r in m.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 0.06 * r.g
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixing.mix(rows.repartition(5)).collect()))
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).first().copies == 0
