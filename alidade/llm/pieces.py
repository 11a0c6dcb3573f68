"""SentencePiece encoding and decoding as the shortest path through a weighted transducer."""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import documents

MARK = "▁"
#: Segments whose paths a worker remembers: the last so many, and those used again among the so many before.
REMEMBERED = 1 << 18
#: Pairs of pieces whose weights a worker remembers; it starts again when they are full.
WEIGHTS = 1 << 19
INF = float("inf")
#: Before the first piece, after or for a character that is no piece, and no piece at all; the first two index tables from the end.
START, OUTSIDE, NONE = -1, -2, -3


def read_model(path: str) -> dict:
    """Pieces, scores and normaliser settings of a BPE model file with byte fallback and the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
    if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("a BPE model with the identity normaliser is needed")
    found = {"texts": {}, "scores": {}, "bytes": {}, "out": [], "prefix": norm.add_dummy_prefix, "unknown": 0}
    for i, p in enumerate(proto.pieces):
        out = b""
        if p.type == kinds.NORMAL:
            found["texts"][p.piece] = i
            found["scores"][p.piece] = p.score
            out = p.piece.replace(MARK, " ").encode()
        elif p.type == kinds.BYTE:
            found["bytes"][int(p.piece[3:5], 16)] = i
            out = bytes([int(p.piece[3:5], 16)])
        elif p.type == kinds.UNKNOWN:
            found["unknown"] = i
            out = " ⁇ ".encode()
        found["out"].append(out)
    if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    return found


class Transducer:
    """normaliser o pieces o byte fallback, composed lazily with one input at a time.

    Normaliser: puts one mark in front of the text and rewrites each blank to the mark, each other character to itself.
    Pieces: a tree of characters whose leaves write piece ids; its states remember the piece last written. Byte
    fallback: a character that is no piece is rewritten to the byte pieces of its UTF-8 form. The weight of an arc that
    writes a piece after another is a number in the tropical semiring: the piece's merge rank, or infinity if merging
    the two texts by rank would not end in just these two pieces. A sequence of pieces all of whose neighbours may stand
    side by side is what merging the whole text gives, so there is one path with a finite sum of weights, and it
    is right.

    Compiled once from the model: the tree, the last merge inside each piece, and the table of the pairs of pieces that
    merge, by which a weight is found without merging any text.
    """

    def __init__(self, model: dict):
        self.ids, self.out = model["texts"], model["out"]
        self.byte_ids = model["bytes"]
        self.unknown = model["unknown"]
        self.prefix = MARK if model["prefix"] else ""
        self.normal = {" ": MARK}
        # No piece has a mark after another character, and controls outside the vocabulary join nothing: a text
        # falls into segments there, whose paths are independent.
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span words are not supported")
        cut = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.segments = re.compile(f"[{cut}]|{MARK}*[^{MARK}{cut}]+|{MARK}+" if cut else f"{MARK}*[^{MARK}]+|{MARK}+")
        # symbols: the pieces, and characters inside pieces that are none themselves
        names = dict(self.ids)
        for p in self.ids:
            for c in p:
                names.setdefault(c, len(self.out) + len(names))
        order = {s: k for k, s in enumerate(sorted(set(model["scores"].values()), reverse=True))}
        self.rank = {i: order[model["scores"][p]] if p in model["scores"] else len(order) for p, i in names.items()}
        self.pairs: dict[int, int] = {}  # left << 32 | right -> rank of what they merge into
        self.halves: dict[int, tuple[int, int]] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if p[:k] in names and p[k:] in names:
                    self.pairs[names[p[:k]] << 32 | names[p[k:]]] = self.rank[i]
        made = {}
        for p, i in self.ids.items():
            if len(p) > 1:
                half = self.last_merge(p, names)
                if half is None:
                    continue  # merging never makes this piece
                self.halves[i] = half
            made[p] = i
        # character -> (node behind it, longest piece so far); shorter[i] is the longest piece that begins piece i
        self.tree: dict = {}
        self.longest = max(map(len, made), default=1)
        self.size, self.shorter = ([v] * (len(self.out) + 2) for v in (1, NONE))
        for p in sorted(made, key=len):
            node, before = self.tree, OUTSIDE
            for c in p[:-1]:
                node, before = node.setdefault(c, ({}, before))
            node[p[-1]] = ({}, made[p])
            self.size[made[p]] = len(p)
            self.shorter[made[p]] = before if len(p) > 1 else NONE
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Empties the table of weights: after each piece, those of the pieces that were asked for."""
        self.weights: list[dict[int, float]] = [{OUTSIDE: 0.0} for _ in range(len(self.out) + 2)]
        self.known = 0

    def last_merge(self, piece: str, names: dict[str, int]) -> tuple[int, int] | None:
        """The two symbols that merging joins last in a piece's text, None if it does not end in the piece."""
        parts = [names[c] for c in piece]
        texts = list(piece)
        while len(parts) > 1:
            ranks = [self.pairs.get(a << 32 | b, INF) for a, b in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == INF:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            texts[k : k + 2] = [texts[k] + texts[k + 1]]
            parts[k : k + 2] = [names[texts[k]]]
        return None

    def weight(self, left: int, right: int) -> float:
        """Of the arc that writes `right` after `left` (START at the beginning and after what joins nothing).

        Goes back in time: the parts of both that touch, from the last merge of either to the single characters, must
        not merge before one of them grows; of equal ranks the leftmost merge comes first.
        """
        pairs, halves, rank = self.pairs, self.halves, self.rank
        found, limit, a, b = float(rank[right]), INF, left, right
        while a >= 0:
            if pairs.get(a << 32 | b, INF) < limit:
                found = INF
                break
            x, y = halves.get(a), halves.get(b)
            if x is None and y is None:
                break
            if y is None or (x is not None and rank[a] > rank[b]):
                limit, a = rank[a], x[1]
            else:
                limit, b = rank[b] + 1, y[0]
        if self.known >= WEIGHTS:
            self.forget()
        self.weights[left][right] = found
        self.known += 1
        return found

    def path(self, segment: str) -> bytes:
        """Ids along the shortest path through the composed machine, as 32-bit numbers. The segment is normalised.

        Sums of weights are carried along, arcs with an infinite sum are dropped, and of two finite sums the lesser would
        win; but as at most one path has a finite sum, the search goes on from the arc that reaches farthest and turns
        back only from positions that no finite arc leaves. The arcs that leave a position are its longest piece and the
        pieces that begin it, the longest first.
        """
        weights, size, shorter, tree, longest, n = self.weights, self.size, self.shorter, self.tree, self.longest, len(segment)
        found: list[int] = []
        sums = [0.0]
        end, last = 0, START
        dead: set[tuple[int, int]] = set()  # states that no finite path goes on from
        while end < n:
            node, piece = tree, OUTSIDE
            for c in segment[end : end + longest]:
                hit = node.get(c)
                if hit is None:
                    break
                node, piece = hit
            while True:
                w = weights[last].get(piece)
                if w is None:
                    w = self.weight(last, piece)
                    weights = self.weights
                total = sums[-1] + w
                if total < INF and not (dead and (end + size[piece], piece) in dead):
                    break
                piece = shorter[piece]
                while piece == NONE:
                    dead.add((end, last))
                    end -= size[last]
                    piece = shorter[found.pop()]
                    sums.pop()
                    last = found[-1] if found else START
            found.append(piece)
            sums.append(total)
            end += size[piece]
            last = piece
        if OUTSIDE not in found:
            return array("i", found).tobytes()
        ids, end = array("i"), 0
        for piece in found:
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in segment[end].encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
            end += size[piece]
        return ids.tobytes()

    def encode(self, text: str, into: array) -> None:
        if not text:
            return
        segments = self.segments.findall(self.prefix + text.replace(" ", self.normal[" "]))
        out = list(map(self.paths.get, segments))
        for k, found in enumerate(out):
            if found is None:
                segment = segments[k]
                found = out[k] = self.paths.get(segment) or self.older.get(segment) or self.path(segment)
                if len(segment) <= 64:
                    if len(self.paths) >= REMEMBERED:
                        self.older, self.paths = self.paths, {}
                    self.paths[segment] = found
        into.frombytes(b"".join(out))

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_ready: dict[str, Transducer] = {}


def _transducer(key: str, model) -> Transducer:
    """The worker's transducer of the broadcast model, compiled once a worker."""
    if key not in _ready:
        _ready[key] = Transducer(model.value)
    return _ready[key]


def _others(df: DataFrame, name: str) -> list[str]:
    return [c for c in df.columns if c.lower() != name.lower()]


def _broadcast(df: DataFrame, model: str):
    found = read_model(model)
    return hashlib.md5(repr(sorted(found["texts"].items())).encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(found)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the piece ids of each whole text in column `ids`, which replaces an input column of that name.

    `model` is the path of a model file, read by the driver and broadcast (its size is the vocabulary's). A null or
    empty text has no ids. Rows are encoded alone; memory per row is the row's own ids and a bounded table of paths.
    """
    key, shared = _broadcast(df, model)
    keep = _others(df, ids)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        fst = _transducer(key, shared)
        values, ends = array("i"), [0]
        for t in texts.to_pylist():
            fst.encode(t, values)
            ends.append(len(values))
        flat = pa.array(np.frombuffer(values, dtype=np.int32) if values else [], pa.int32())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return df.select(*[F.col(f"`{c}`") for c in keep], run(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(ids))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each id list in column `text`, which replaces an input column of that name.

    Byte pieces are joined to UTF-8 (what is no UTF-8 becomes U+FFFD) and the leading blank is taken off. A null list
    decodes to null, an empty one to the empty text.
    """
    key, shared = _broadcast(df, model)
    keep = _others(df, text)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        fst = _transducer(key, shared)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        # one list at a time becomes Python numbers: those of a whole batch would be many times its size
        return pa.array([fst.decode(values[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], lists.is_valid().to_pylist())], pa.string())

    return df.select(*[F.col(f"`{c}`") for c in keep], run(F.col(f"`{ids}`")).alias(text))


def _model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the md5 of what they decode to beside that of the normalised text."""
    rows = decode(encode(documents(spark, sf_dir).select("doc_id", "text"), _model_path()), _model_path())
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.md5("decoded").alias("decoded_md5"), (F.md5("decoded") == F.md5(plain)).alias("round_trip"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the ids of each text, the md5 of what they decode to, and whether that is the text (with marks as blanks)."""
    rows = decode(encode(docs.select("doc_id", "source", "text"), _model_path()), _model_path())
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.md5("decoded").alias("decoded_md5"), (F.md5("decoded") == F.md5(plain)).alias("round_trip"))
