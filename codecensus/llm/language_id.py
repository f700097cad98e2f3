"""Language identification: prediction by partial matching with frozen per-language byte context trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, batch, joined, pick, prepare, remainder, saved, table, texts

#: Bytes of context.
ORDER = 3
#: Bytes of text that each language's statistics are gathered from, as an expected value; whole texts are drawn by hash.
SAMPLE_BYTES = 2_000_000
PIECE = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Windows of k bytes as integers; the last byte is the lowest."""
    out = np.zeros(max(len(data) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out << np.uint64(8) | data[j:j + len(out)].astype(np.uint64)
    return out


class Lookup:
    """From integer keys to row numbers, -1 where absent: open addressing at a load of a quarter at most."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.row = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, np.uint64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.row[at[left]] < 0]
            self.row[at[free]] = free  # the last of those that meet in a slot gets it
            self.key[at[free]] = keys[free]
            won = (self.row[at[left]] == left)
            left = left[~won]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys + np.uint64(1)) * _MULT >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.row[at]
        odd = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            out[odd] = self.row[at[odd]]
            odd = odd[(out[odd] >= 0) & (self.key[at[odd]] != keys[odd])]
        return out


class ContextTrees:
    """Code lengths in bits of each byte after its context, per language, with escapes resolved (method C, frozen).

    A seen byte costs -log2(c / (n + d)) after a context seen n times with d distinct successors; an unseen one pays the
    escape -log2(d / (n + d)) and goes on with a context one byte shorter; below the empty context bytes cost 8 bits.
    """

    def __init__(self, counts: pd.DataFrame, langs: list[str]):
        self.langs = langs
        self.levels = []
        below_keys, below_cost = None, None
        for k in range(ORDER + 1):
            c = counts[counts.k == k]
            keys = np.unique(c.key.to_numpy().astype(np.uint64))
            ctxs = np.unique(keys >> np.uint64(8))
            escape = np.zeros((len(ctxs), len(langs)))
            if k:
                suffix = keys & np.uint64((1 << 8 * k) - 1)
                base = below_cost[np.searchsorted(below_keys, suffix)]
            else:
                base = np.full((len(keys), len(langs)), 8.0)
            cost = np.zeros((len(keys), len(langs)))
            for j, lang in enumerate(langs):
                own = c[c.lang == lang]
                g, n = own.key.to_numpy().astype(np.uint64), own.n.to_numpy().astype(float)
                ctx = np.searchsorted(ctxs, g >> np.uint64(8))
                total, kinds = np.bincount(ctx, n, len(ctxs)), np.bincount(ctx, minlength=len(ctxs))
                seen = kinds > 0
                escape[seen, j] = np.log2((total[seen] + kinds[seen]) / kinds[seen])
                cost[:, j] = escape[np.searchsorted(ctxs, keys >> np.uint64(8)), j] + base[:, j]
                cost[np.searchsorted(keys, g), j] = np.log2((total[ctx] + kinds[ctx]) / n)
            below_keys, below_cost = keys, cost
            self.levels.append((Lookup(keys), cost.astype(np.float32), Lookup(ctxs), escape.astype(np.float32)))

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of the whole text in each language, in pieces that share their context bytes."""
        data = np.frombuffer(text, np.uint8)
        out = np.zeros(len(self.langs))
        for k in range(min(ORDER, len(data))):  # the first bytes have shorter contexts
            out += self._cost(_grams(data[:k + 1], k + 1), k).sum(0)
        for at in range(0, max(len(data) - ORDER, 0), PIECE):
            part = data[at:at + PIECE + ORDER]
            out += self._cost(_grams(part, ORDER + 1), ORDER).sum(0, dtype=np.float64)
        return out

    def _cost(self, grams: np.ndarray, k: int) -> np.ndarray:
        gram, cost, ctx, escape = self.levels[k]
        row = gram(grams)
        out = cost[row] if len(cost) else np.zeros((len(grams), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            g = grams[miss]
            esc = ctx(g >> np.uint64(8))
            paid = np.where((esc >= 0)[:, None], escape[esc], 0) if len(escape) else 0
            less = self._cost(g & np.uint64((1 << 8 * k) - 1), k - 1) if k else 8.0
            out[miss] = paid + less
        return out


def train(docs: DataFrame) -> ContextTrees | None:
    """Context trees from rows (text, lang) without nulls; None when there are none.

    Each language's rows are drawn by a hash of doc_id so that about SAMPLE_BYTES of text remain; statistics are counted
    in Spark, and what reaches the driver is bounded by the sample.
    """
    size = F.octet_length("text")
    total = saved(docs.groupBy("lang").agg(F.sum(size).alias("size")), "lang-sizes")
    share = F.lit(float(SAMPLE_BYTES)) / F.greatest(F.col("size"), F.lit(1)).cast("double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang-sample")), F.lit(1 << 30)) / float(1 << 30)
    part = joined(docs, total, ["lang"]).filter(draw < share).select("lang", "text")

    def count(batches: Batches) -> Batches:
        for b in batches:
            lang = np.array(b.column("lang").to_pylist(), object)
            ts = texts(b)
            for x in sorted(set(lang)):
                datas = [np.frombuffer(ts[i].encode(), np.uint8) for i in np.flatnonzero(lang == x)]
                for k in range(ORDER + 1):
                    g = [_grams(d, k + 1) for d in datas]
                    keys, n = np.unique(np.concatenate(g), return_counts=True)
                    yield batch(lang=[x] * len(keys), k=np.full(len(keys), k, np.int32),
                                key=keys.view(np.int64), n=n.astype(np.int64))

    grams = part.mapInArrow(count, "lang string, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))
    counts = grams.toArrow().to_pandas()
    if not len(counts):
        return None
    return ContextTrees(counts, sorted(counts.lang.unique(), key=lambda s: s.encode()))


def predict(docs: DataFrame, model: ContextTrees | None) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    The language with the shortest code for the whole text wins, the smaller name on a tie; score is its posterior
    probability under equal priors. Null texts, texts without a letter and an empty model give und and 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        trees = held.value
        for b in batches:
            lang, score = [], []
            for t in texts(b):
                if trees is None or not _LETTER.search(t):
                    lang.append("und")
                    score.append(0.0)
                    continue
                bits = trees.bits(t.encode())
                best = int(np.argmin(bits))
                lang.append(trees.langs[best])
                score.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield batch(doc_id=b.column("doc_id"), lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 3 is not 1.

    An empty table gives no rows; repeated rows are predicted each; a null doc_id counts as the empty text in the crc32.
    """
    prepare(spark)
    src = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    src = src.withColumn("doc_id", F.col("doc_id").cast("long"))
    learn = src.filter((remainder(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = predict(src.select("doc_id", "text"), train(learn))
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
