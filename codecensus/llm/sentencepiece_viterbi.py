"""SentencePiece encoding and decoding: Aho-Corasick matches relax best scores in a single Viterbi pass."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, pick, prepare, table, texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000
LEAST = float("-inf")
BYTES = re.compile(r"[\udc00-\udcff]+")


class Pieces:
    """Pieces and scores of a .model file, read through the library; the segmentation is our own.

    The best segmentation has the highest sum of piece scores (the unigram rule, whatever algorithm the file names);
    among equals the one whose last piece is longest, from the right. A character that no piece covers costs the lowest
    score less UNKNOWN_PENALTY and becomes its byte pieces, or the unknown piece where the file has no byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        normal = [i for i in range(n) if i not in special and self.text[i]]
        # byte pieces are shown as lone surrogates, which no text holds, until decode() joins their runs
        self.shown = [chr(0xDC00 + self.byte_of[i]) if i in self.byte_of else "" if i in special and i != self.unknown else
                      " ⁇ " if i == self.unknown else t for i, t in enumerate(self.text)]
        self.size = [len(t) for t in self.text]
        self.single = {self.text[i] for i in normal if len(self.text[i]) == 1}
        self.lowest = min(sp.get_score(i) for i in normal) - UNKNOWN_PENALTY
        self.machine = ahocorasick.Automaton()
        for i in normal:
            self.machine.add_word(self.text[i], (len(self.text[i]), sp.get_score(i), i))
        self.machine.make_automaton()
        # no piece holds a space mark after another character: a mark that follows one always begins a piece
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in normal)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[int, ...]] = {}

    def viterbi(self, s: str) -> list[int]:
        """Ids of one string: at each position all matches that end there relax the best score."""
        n = len(s)
        best, last = [0.0] + [LEAST] * n, [-1] * (n + 1)
        gaps = [] if self.single.issuperset(s) else [k for k, c in enumerate(s) if c not in self.single]
        for end, (length, score, i) in self.machine.iter(s):
            while gaps and gaps[0] < end:  # characters that are no piece, before this end: every earlier position is final
                k = gaps.pop(0)
                if best[k] + self.lowest > best[k + 1]:
                    best[k + 1], last[k + 1] = best[k] + self.lowest, -1
            x = best[end + 1 - length] + score
            if x > best[end + 1]:
                best[end + 1] = x
                last[end + 1] = i
        for k in gaps:
            if best[k] + self.lowest > best[k + 1]:
                best[k + 1], last[k + 1] = best[k] + self.lowest, -1
        out = []
        while n:
            i = last[n]
            if i >= 0:
                out.append(i)
                n -= self.size[i]
                continue
            n -= 1
            if self.byte:
                out += [self.byte[b] for b in reversed(s[n].encode())]
            else:
                out.append(self.unknown)
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the leading space mark that the library adds; an empty text has none."""
        if not text:
            return []
        s = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.viterbi(s)
        out: list[int] = []
        known = self.known
        for c in self.chunk.findall(s):
            ids = known.get(c)
            if ids is None:
                ids = tuple(self.viterbi(c))
                if len(c) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[c] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text again; control pieces vanish, broken byte runs become U+FFFD, space marks become blanks."""
        s = "".join(map(self.shown.__getitem__, ids))
        s = BYTES.sub(lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode(errors="replace"), s).replace(SPACE, " ")
        return s[1:] if s.startswith(" ") else s


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip, ids.

    round_trip: decoding gives the text back (a U+2581 in a text comes back as a blank, as in the library, and counts as
    equal). Null texts count as empty and have no pieces; repeated rows are encoded each; other columns are not read.
    ``ids=False`` leaves the id lists out. No shuffle.
    """

    def run(batches: Batches) -> Batches:
        p = pieces(path)
        for b in batches:
            lists, ok, sha = [], [], []
            n = []
            for t in texts(b):
                x = p.encode(t)
                n.append(len(x))
                ok.append(p.decode(x) == t.replace(SPACE, " "))
                x = np.array(x, "<i4")
                sha.append(hashlib.sha256(x.tobytes()).hexdigest())
                if ids:
                    lists.append(x)
            cols = {"doc_id": b.column("doc_id"), "n_pieces": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "round_trip": pa.array(ok, pa.bool_())}
            if ids:
                cols["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield batch(**cols)

    prepare(docs.sparkSession)
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece count, digest of the ids and round trip of every whole document."""
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
