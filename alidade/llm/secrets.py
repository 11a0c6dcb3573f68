"""Secret scans: fixed patterns, and strings that a Markov model of random strings explains better than one of names."""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import documents

KINDS = ("assign", "access", "hex", "markov")
#: Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the models judge: runs of key characters of LEAST or more that hold a letter and a digit or both cases.
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)

#: Words that programs' names are made of (fixed values).
NAME_WORDS = (
    "get set is has to from with add remove update delete create build make load save read write open close parse format "
    "encode decode send receive request response handler manager factory service client server session user account "
    "group role file path name type value key index count size length list map table row column field record data info "
    "config option default global local static public private internal abstract base common util helper test mock "
    "event listener callback queue stack tree node edge graph cache buffer stream socket thread process task job worker "
    "message error warning exception status code state context view model controller template render layout button label "
    "input output start stop begin end first last next previous left right top bottom width height color image text "
    "string number integer float double boolean date time zone year month day hour minute second total average maximum "
    "minimum random hash check sum valid invalid enable disable connection database transaction repository environment "
    "administration internationalization configuration initialization authentication synchronization documentation"
).split()
#: Frequent words of running text in four languages (fixed values).
PLAIN_WORDS = (
    "the of and that with this from which there their would about other people nation station reason season "
    "les des que dans pour avec une cette mais comme tout faire leurs entre depuis pendant toujours maison heureux eau "
    "los las que por con para una este pero como todo hacer entre desde durante siempre casa tiempo mente cion "
    "der die das und mit von eine nicht auch sich werden haben zwischen heit keit ung schaft lich gebe ver"
).split()


def labelled_samples(n: int, seed: int) -> list[tuple[str, int]]:
    """n strings, half of them random (1) and half names or words (0), drawn by rule from the seed."""
    rnd = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (digits + "abcdef", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_")
    found = []
    for i in range(n):
        if i % 2:
            letters = rnd.choice(alphabets)
            found.append(("".join(rnd.choice(letters) for _ in range(rnd.randint(LEAST, 48))), 1))
            continue
        words: list[str] = []
        source = NAME_WORDS if rnd.random() < 0.6 else PLAIN_WORDS
        while sum(map(len, words)) < LEAST:
            words.append(rnd.choice(source) if rnd.random() < 0.93 else str(rnd.choice((1, 2, 8, 16, 32, 64, 100, 128, 256, 2024))))
        style = rnd.randrange(6)
        if style == 0:
            name = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 1:
            name = "".join(w.capitalize() for w in words)
        else:
            name = ("_", "-", "/", "")[style - 2].join(words)
        if rnd.random() < 0.12:
            name = name.upper()
        found.append((name, 0))
    return found


class Markov:
    """Second-order character model with additive smoothing over letters, digits and key punctuation."""

    ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

    def __init__(self, strings: list[str], smoothing: float = 0.3):
        self.place = {c: i for i, c in enumerate(self.ALPHABET)}
        n = len(self.ALPHABET) + 1  # the last stands for the border
        pair = [[smoothing] * n for _ in range(n)]
        triple: dict[tuple[int, int], list[float]] = {}
        for s in strings:
            a = b = n - 1
            for c in map(self.place.__getitem__, s):
                pair[b][c] += 1
                triple.setdefault((a, b), [0.0] * n)[c] += 1
                a, b = b, c
        self.pair = [[x / sum(row) for x in row] for row in pair]
        # a context's own counts weigh against the shorter context's distribution
        self.triple = {k: [(x + 8 * p) / (sum(row) + 8) for x, p in zip(row, self.pair[k[1]])] for k, row in triple.items()}
        self.border = n - 1

    def log_likelihood(self, s: str) -> float:
        a = b = self.border
        total = 0.0
        for c in map(self.place.__getitem__, s):
            row = self.triple.get((a, b))
            total += math.log(row[c] if row else self.pair[b][c])
            a, b = b, c
        return total


class Detector:
    """Log-likelihood ratio per character of the random model against the names' model, with a learnt threshold."""

    def __init__(self, samples: int = 8000, seed: int = 7, false_alarms: float = 0.001):
        rows = labelled_samples(samples, seed)
        cut = len(rows) * 3 // 4
        self.random = Markov([s for s, y in rows[:cut] if y])
        self.names = Markov([s for s, y in rows[:cut] if not y])
        held = sorted((self.ratio(s) for s, y in rows[cut:] if not y), reverse=True)
        # above what all but a share of the held-out names reach, and never where names are as likely
        self.threshold = max(0.3, held[int(len(held) * false_alarms)])

    def ratio(self, s: str) -> float:
        return (self.random.log_likelihood(s) - self.names.log_likelihood(s)) / len(s)

    def is_secret(self, s: str) -> bool:
        mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or not (s.islower() or s.isupper()) and any(c.isalpha() for c in s)
        return mixed and self.ratio(s) > self.threshold


@lru_cache(maxsize=4)
def detector(samples: int, seed: int, false_alarms: float) -> Detector:
    return Detector(samples, seed, false_alarms)


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted."""
    found = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a hex run of 32 or more lies within one run of key characters
    for run in RUN.finditer(text) if runs is None else runs:
        if run.end() - run.start() >= 32:
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, run.start(), run.end()) if m.end() - m.start() >= 32]
    return sorted(found)


def all_spans(text: str, judge: Detector) -> tuple[list, list]:
    """Base spans, and base spans with those runs outside them that the models take for random strings."""
    runs = list(RUN.finditer(text))
    base = base_spans(text, runs)
    more = []
    for run in runs:
        a, b = run.span()
        if not any(s < b and a < e for s, _, e in base) and judge.is_secret(run[0]):
            more.append((a, 3, b))
    return base, sorted(base + more) if more else base


def written_out(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, text: str = "text", samples: int = 8000, seed: int = 7, false_alarms: float = 0.001) -> DataFrame:
    """df with n_assign, n_access, n_hex, base_sha256, n_markov and spans.

    Spans are kind:start:end in code points of the whole text, end exclusive; a null or empty text has none. The
    models are trained once per worker from `samples` labelled strings that a rule draws from `seed` (that number
    bounds the training), and the ratio's threshold lets at most `false_alarms` of held-out names pass. Rows are
    scanned alone; input columns named like a result are replaced.
    """
    out = ["n_assign", "n_access", "n_hex", "base_sha256", "n_markov", "spans"]

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, n_markov long, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        judge = detector(samples, seed, false_alarms)
        rows = []
        for t in texts:
            base, spans = all_spans(t or "", judge)
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written_out(base).encode()).hexdigest(), len(spans) - len(base), written_out(spans)))
        return pd.DataFrame(rows, columns=out)

    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]
    rows = df.select(*keep, found(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__found"))
    return rows.select("*", "__found.*").drop("__found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
