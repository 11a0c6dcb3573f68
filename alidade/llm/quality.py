"""Quality rules: one table of thresholds compiled into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import SPACE, WORD, documents, let

SYMBOLS = r"[#*$%&|<>]"

#: Common function words of the corpus languages (en, fr, es, de).
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are or an from at have not "
    "le la les de des du et en un une que qui dans pour par sur est au aux avec "
    "el los las y que del se por con para una como lo su al "
    "der die das und ist von zu den mit ein eine nicht sich auf im dem für sie er es"
).split()

#: (rule, statistic, least value, greatest value, least number of words from which the rule is applied).
THRESHOLDS = (
    ("words", "n_words", 10.0, None, 0),
    ("repeats", "repeat_ratio", None, 0.2, 0),
    ("word_length", "mean_word", 2.0, 14.0, 10),
    ("symbols", "symbol_ratio", None, 0.2, 10),
    ("stop_words", "stop_ratio", 0.01, None, 50),
    ("duplicate_lines", "dup_line_ratio", None, 0.5, 10),
    ("letters", "letter_ratio", 0.3, None, 10),
)
BASE_RULES = ("words", "repeats")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_hashes(words: Column, width: int = 5) -> Column:
    """A hash for each window of `width` words; none for shorter texts."""

    def grams(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (width - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(width)]))

    some = let(F.transform(words, lambda w: F.xxhash64(w)), grams)
    return F.when(F.size(words) >= width, some).otherwise(F.array().cast("array<bigint>"))


def covered(grams: Column, width: int = 5) -> Column:
    """Words that lie in a window found at least twice in the text.

    Sorted (window, start) pairs put equal windows side by side; the starts of those that have a twin, in order, then
    cover min(width, distance to the start before) words each.
    """

    def starts(pairs: Column) -> Column:
        def twin(p: Column, k: Column) -> Column:
            before = (k > 0) & (F.get(pairs, k - 1)["g"] == p["g"])
            after = (k < F.size(pairs) - 1) & (F.get(pairs, k + 1)["g"] == p["g"])
            return before | after

        return F.array_sort(F.transform(F.filter(pairs, twin), lambda p: p["i"]))

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.aggregate(
        let(pairs, starts),
        F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(s.alias("last"), (a["sum"] + F.least(F.lit(width), s - a["last"]).cast("long")).alias("sum")),
        lambda a: a["sum"],
    )


def quality(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules and kept.

    Every statistic is a built-in expression over the whole text, and the threshold table becomes one array of
    CASE branches in the same projection: no shuffle and no user function. A null or empty text has no words and
    fails; a statistic that is undefined (no words) fails no ratio rule. Rows are judged alone, so repeated rows
    repeat their verdict; input columns named like a result are replaced by it.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept_columns = [c for c in df.columns if c.lower() not in out]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    # Steps in separate projections, so that the word array and the gram array are each built once.
    step = df.withColumn("__q_words", _words(t))
    step = step.withColumn(
        "__q",
        F.struct(
            F.size("__q_words").cast("long").alias("n_words"),
            F.char_length(F.array_join("__q_words", "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("d")).alias("lines"),
            F.size(F.filter("__q_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("stops"),
            F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")).alias("letters"),
            window_hashes(F.col("__q_words")).alias("grams"),
        ),
    )
    q = F.col("__q")
    repeats = F.when(F.size(F.array_distinct(q["grams"])) == F.size(q["grams"]), F.lit(0).cast("long")).otherwise(covered(q["grams"]))
    step = step.withColumn("__q_repeats", repeats)
    n = q["n_words"]
    stats = {
        "n_words": n.cast("double"),
        "repeat_ratio": F.try_divide(F.col("__q_repeats"), n),
        "mean_word": F.try_divide(q["word_chars"], n),
        "symbol_ratio": F.try_divide(q["n_symbols"], n),
        "stop_ratio": F.try_divide(q["stops"], n),
        "dup_line_ratio": F.try_divide(q["lines"]["n"] - q["lines"]["d"], q["lines"]["n"]),
        "letter_ratio": F.try_divide(q["letters"], q["word_chars"]),
    }
    branches = []
    for rule, stat, low, high, least in thresholds:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (stats[stat] < low)
        if high is not None:
            bad = bad | (stats[stat] > high)
        if rule == "repeats":  # the base rule, in whole numbers
            bad = F.col("__q_repeats") * 100 > n * 20
        branches.append(F.when(bad & (n >= least), F.lit(rule)))
    failed = F.array_compact(F.array(*branches))
    base = (n < 10) | (F.col("__q_repeats") * 100 > n * 20)
    step = step.withColumn("__q_failed", failed)
    return step.select(
        *[F.col(f"`{c}`") for c in kept_columns],
        n.alias("n_words"),
        q["word_chars"].alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        (q["lines"]["n"] - q["lines"]["d"]).cast("long").alias("n_dup_lines"),
        F.col("__q_repeats").alias("n_repeat_words"),
        base.alias("base_failed"),
        F.col("__q_failed").alias("failed_rules"),
        (~base & (F.size("__q_failed") == 0)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with their own columns."""
    mark = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").alias("__text"))
    # an explode of one or no document, not a filter: that would be pushed below the statistics and repeat them per use
    some = F.explode(F.when(F.col("kept"), F.array("__doc"))).alias("__doc")
    return quality(mark, text="__text").select(some).select("__doc.*")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, [words[i], words[i+1], words[i+2], words[i+3], words[i+4]] AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
s AS (SELECT w.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        len(lines) AS n_lines,
        len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS stops,
        length(regexp_replace(t, '[^\pL]+', '', 'g')) AS letters
      FROM w JOIN l ON w.rid = l.rid LEFT JOIN c ON w.rid = c.rid),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT (n_words >= 10 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 14.0))
  AND NOT (n_words >= 10 AND n_symbols / n_words > 0.2)
  AND NOT (n_words >= 50 AND stops / n_words < 0.01)
  AND NOT (n_words >= 10 AND n_dup_lines / n_lines > 0.5)
  AND NOT (n_words >= 10 AND letters / word_chars < 0.3) AS kept
FROM v
"""
