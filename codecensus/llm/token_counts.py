"""Token counts: byte-level BPE by rank-synchronous array merging."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, pick, prepare, table, texts

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pre-tokens whose counts a worker remembers; forgotten all at once when full.
REMEMBERED = 400_000
LONG = 1 << 30
GROUP = 2_000_000
BLANK_RUN = re.compile(r" \s")
CUT = re.compile(r"(?= \S)")


class Vocabulary:
    """Merge table of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made
        # printable stand-ins of the 256 bytes: the visible Latin-1 characters stand for themselves, the rest follow from 256 on
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in seen]
        char = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte = np.array([vocab[char[b]] for b in range(256)], np.int64)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.split = regex.compile(PRETOKEN)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols that each word ends with: all sequences apply their own lowest-ranked pair in the same step.

        A merge's parts are made before it, so a new pair never outranks the pair just merged, and merging all
        occurrences of the lowest pair at once, left to right, equals merging them one after the other.
        """
        out = np.array([len(w) for w in words], np.int64)
        live = np.flatnonzero(out > 1)
        if not len(live):
            return out
        size = out[live]
        sym = self.byte[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        seq = np.repeat(np.arange(len(live)), size)
        while len(sym):
            key = sym[:-1] << 20 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], LONG)
            rank = np.append(rank, LONG)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, first)
            each = np.repeat(low, np.diff(np.append(first, len(seq))))
            go = (rank == each) & (rank < LONG)
            # in a run of equal symbols the pairs overlap: take every second one
            idx = np.flatnonzero(go)
            if len(idx) > 1:
                run = np.maximum.accumulate(np.where(np.append(True, np.diff(idx) > 1), np.arange(len(idx)), 0))
                idx = idx[(np.arange(len(idx)) - run) % 2 == 0]
            sym[idx] = self.made[rank[idx]]
            keep = np.ones(len(sym), bool)
            keep[idx + 1] = False
            out[live] -= np.bincount(seq[idx], minlength=len(live))
            keep &= each < LONG  # finished sequences leave
            sym, seq = sym[keep], seq[keep]
        return out


def counter(vocab: Vocabulary):
    """A function from texts to token counts that remembers the counts of words and of pre-tokens."""
    words: dict[str, int] = {}
    pretokens: dict[str, int] = {}

    def chunks(text: str) -> list[str]:
        """Cut before every blank that something solid follows; a pre-token always begins there."""
        if BLANK_RUN.search(text):
            return CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)]

    def learn(new: list[str]) -> None:
        split = [vocab.split.findall(w) for w in new]
        fresh = set().union(*split).difference(pretokens)
        if len(pretokens) + len(fresh) > REMEMBERED:
            pretokens.clear()
            fresh = set().union(*split)
        fresh = list(fresh)
        pretokens.update(zip(fresh, vocab.lengths([w.encode() for w in fresh]).tolist()))
        words.update(zip(new, [sum(map(pretokens.__getitem__, w)) for w in split]))

    def group(docs: list[str]) -> list[int]:
        split = [vocab.special.split(t) if vocab.special else [t] for t in docs]
        cut = [[chunks(p) for p in parts] for parts in split]
        new = set().union(*(w for parts in cut for w in parts)).difference(words)
        if len(words) + len(new) > REMEMBERED:
            words.clear()
            new = set().union(*(w for parts in cut for w in parts))
        learn(list(new))
        return [len(parts) - 1 + sum(sum(map(words.__getitem__, w)) for w in parts) for parts in cut]

    def count(docs: list[str]) -> list[int]:
        """In groups of about GROUP characters, so that the arrays are long and memory stays bounded."""
        out, at, size = [], 0, 0
        for i, text in enumerate(docs):
            size += len(text)
            if size > GROUP:
                out += group(docs[at:i + 1])
                at, size = i + 1, 0
        return out + group(docs[at:])

    return count


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path``: a byte-level BPE .json vocabulary, present on every executor. Null and empty texts have 0 bytes and 0
    tokens; repeated rows and ids are counted each; special strings inside texts count as the one token they stand for;
    columns other than doc_id and text are not read. No shuffle.
    """

    def run(batches: Batches) -> Batches:
        if path not in _COUNTERS:
            _COUNTERS[path] = counter(Vocabulary(path))
        for b in batches:
            ts = texts(b)
            n = _COUNTERS[path](ts)
            yield batch(doc_id=b.column("doc_id"), n_bytes=pa.array([len(t.encode()) for t in ts], pa.int64()),
                        n_tokens=pa.array(n, pa.int64()), over_limit=pa.array([x > limit for x in n], pa.bool_()))

    prepare(docs.sparkSession)
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
