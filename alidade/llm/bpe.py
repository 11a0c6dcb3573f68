"""Token counts of a byte-level BPE vocabulary by merging with a heap over a linked list of symbols."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import documents

#: Split of a text before merging, as the byte-level pre-tokenizer defines it (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Scripts whose letters and digits every Unicode version agrees on; other texts are split by the library's splitter.
SETTLED = "\\x00-\u0557\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
LIMIT = 1024
#: Pieces whose counts a worker remembers; it starts again when they are full.
REMEMBERED = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stands = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in stands)
    stands |= {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [stands[b] for b in range(256)]


class HeapCounter:
    """Counts tokens: initial byte symbols minus merges, the lowest-ranked adjacent pair (leftmost first) merged next."""

    def __init__(self, tokenizer_json: bytes):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")
        ids = model["vocab"]
        self.initial = [ids[s] for s in byte_symbols()]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_hints = special
        self.pieces = regex.compile(PIECES)
        self.unsettled = regex.compile(f"[^{SETTLED}]")
        self.memory: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        initial, ranks, made = self.initial, self.ranks, self.made
        symbols = [initial[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = left = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] << 32 | symbols[i + 1]
            if (rank := ranks.get(pair)) is not None:
                heap.append((rank, i, pair))
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] << 32 | symbols[j] != pair:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made[rank], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = symbols[i] << 32 | symbols[k]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, i, pair))
            if (h := before[i]) >= 0:
                pair = symbols[h] << 32 | symbols[i]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(heap, (rank, h, pair))
        return left

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.unsettled.search(text):
            return self.pieces.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def _plain(self, text: str) -> int:
        memory, total = self.memory, 0
        for piece in self.split(text):
            n = memory.get(piece)
            if n is None:
                n = self.merged(piece)
                if len(piece) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.special_hints):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


@lru_cache(maxsize=4)
def _counter(tokenizer_json: bytes) -> HeapCounter:
    return HeapCounter(tokenizer_json)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit).

    `tokenizer` is the path of a byte-level BPE tokenizer file; the driver reads it and broadcasts its bytes, which
    are as many as the vocabulary needs. Whole texts are counted, a null text as an empty one (0 tokens). Each row is
    counted alone, so repeated rows repeat their counts; input columns named like a result are replaced.
    """
    out = ["n_bytes", "n_tokens", "over_limit"]
    with open(tokenizer, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        counter = _counter(spec.value)
        return pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out], F.octet_length(t).cast("long").alias("n_bytes"), tokens(t).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text")
