"""Language-model scoring: Katz backoff bigrams with Good-Turing discounts over the whole training part of a corpus.

Every word counts as itself. Keys are 64-bit hashes of words, and of pairs of them; no table by word or by pair is held
whole by a task or the driver. Between tasks keys travel as packed sorted arrays, one row per chunk of documents and
bucket, and each key only once per chunk:
  counts   chunk -> (bucket, keys, counts) -> one sorted table per bucket, written
  model    the distinct pairs meet the counts of their words and the totals of their histories by joins
  lookups  chunk -> (bucket, keys, which documents hold them how often), met by the bucket's table; what a document
           gains in a bucket goes back to its chunk and is added up there; in two passes, so that lookups take half the room
A token's log probability is that of backing off, log backoff(history) + log p(word), which two lookups by word give, and
for a pair seen in training what the pair's own estimate is above that, which the lookup by pair gives.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, pack, unpack, word_hashes
from .common import Batches, batch, pick, prepare, remainder, saved, table

#: Words below this share of all training tokens are merged into one class; 0: none are.
VOCABULARY = 0.0
#: Counts up to this are discounted.
GT_MAX = 5
#: Tokens and documents of a chunk.
CHUNK, CHUNK_DOCS = 2_000_000, (1 << 20) - 1
#: Keys of a long table that are packed at a time.
PIECE = 1 << 18
#: Log probabilities are added up as whole multiples of this, in any order with one result.
UNIT = 1e-9
#: Stand for the end of a text, its begin (only as a history), and the class of merged words.
END, BEGIN, RARE = np.uint64(0x5EED0FE2D0C5E7D1), np.uint64(0xB16B00571A27ED03), np.uint64(0x3A4E0C1A5500D9F7)
_SHIFT = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)

COUNTS = "bucket int, keys binary, counts binary"
TABLE = "bucket int, keys binary, counts binary, total long, n array<long>"
PAIRS = "bucket int, h binary, w binary, counts binary"
PAIR_TABLE = "bucket int, h binary, w binary, counts binary, total long, n array<long>"
LOOKUPS = "bucket int, kind int, block long, keys binary, counts binary, lengths binary, docs binary"
GAINS = "block long, kind int, a binary, b binary, c binary"


@dataclass
class Chunk:
    """Documents of one task, in order: ids, training flags, and the hashes of their tokens with one END each."""

    block: int
    ids: list
    train: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    n_tokens: np.ndarray


def chunks(batches: Batches) -> object:
    """Chunks of a task's documents (doc_id, text, train); the block number is the same in a repeated attempt."""
    part, no = TaskContext.get().partitionId(), 0
    ids, train, hashes, sizes, n = [], [], [], [], 0

    def made() -> Chunk:
        k = np.concatenate(sizes)
        return Chunk(part << 32 | no, ids, np.array(train, bool), np.concatenate(hashes), np.repeat(np.arange(len(k)), k), k)

    for b in batches:
        all_ids, flags = b.column("doc_id").to_pylist(), b.column("train").to_pylist()
        for first, h, offs in word_hashes(b.column("text")):
            rows = len(offs) - 1
            hashes.append(np.insert(h, offs[1:], END))
            sizes.append(np.diff(offs) + 1)
            ids += all_ids[first:first + rows]
            train += flags[first:first + rows]
            n += len(h) + rows
            if n >= CHUNK or len(ids) >= CHUNK_DOCS - 100_000:
                yield made()
                no += 1
                ids, train, hashes, sizes, n = [], [], [], [], 0
    if ids:
        yield made()


def buckets_of(spark: SparkSession) -> int:
    """A power of two of at least the shuffle partitions: what one bucket holds shrinks as those grow."""
    return 1 << max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket that keeps the keys' order inside each, and the bucket of each key in that order."""
    b = (mix(keys) >> np.uint64(65 - buckets.bit_length())).astype(np.uint32)
    order = np.argsort(b, kind="stable")
    return order, b[order]


def _counted(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    order, b = _by_bucket(keys, buckets)
    keys, counts = keys[order], counts[order]
    edge = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else [], len(b)).astype(int)
    return batch(bucket=pa.array([int(b[i]) for i in edge[:-1]], pa.int32()),
                 keys=pa.array([pack(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in zip(edge, edge[1:], strict=False)], pa.binary()),
                 counts=pa.array([pack(counts[i:j].astype(np.int64)) for i, j in zip(edge, edge[1:], strict=False)], pa.binary()))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket's table: sorted keys with their summed counts, and how many keys have the counts 1 to GT_MAX + 1."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(group), 64):  # a few chunks at a time, so that frequent keys meet early
        part = group.iloc[at:at + 64]
        k = np.concatenate([keys, *map(_keys, part["keys"])])
        c = np.concatenate([counts, *(unpack(x, np.int64) for x in part["counts"])])
        keys, where = np.unique(k, return_inverse=True)
        counts = np.bincount(where, c, len(keys)).astype(np.int64)
    n = [int((counts == r).sum()) for r in range(1, GT_MAX + 2)]
    return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "keys": [pack(np.diff(keys, prepend=np.uint64(0)))],
                         "counts": [pack(counts)], "total": [int(counts.sum())], "n": [[*n, len(keys)]]})


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) + w)


def _quarters(keys: np.ndarray, only: tuple[int, ...] = (0, 1, 2, 3)) -> Iterator[np.ndarray]:
    """Where the keys of each quarter of the buckets are, so that a task sorts fewer at a time."""
    quarter = (mix(keys) >> np.uint64(62)).astype(np.uint8)
    for q in only:
        at = np.flatnonzero(quarter == q)
        if len(at):
            yield at


def _counted_pairs(h: np.ndarray, w: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Distinct pairs of one chunk with their counts, by bucket of the pair and sorted by history inside each."""
    _, first, n = np.unique(_pair_keys(h, w), return_index=True, return_counts=True)
    h, w = h[first], w[first]
    order = np.argsort(h)
    h, w, n = h[order], w[order], n[order]
    order, b = _by_bucket(_pair_keys(h, w), buckets)
    h, w, n = h[order], w[order], n[order].astype(np.int64)
    edge = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else [], len(b)).astype(int)
    cut = list(zip(edge, edge[1:], strict=False))
    return batch(bucket=pa.array([int(b[i]) for i, _ in cut], pa.int32()),
                 h=pa.array([pack(np.diff(h[i:j], prepend=np.uint64(0))) for i, j in cut], pa.binary()),
                 w=pa.array([w[i:j].tobytes() for i, j in cut], pa.binary()), counts=pa.array([pack(n[i:j]) for i, j in cut], pa.binary()))


def _merged_pairs(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket's pairs with their summed counts, and how many have the counts 1 to GT_MAX + 1."""
    h, w, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(group), 64):
        part = group.iloc[at:at + 64]
        h = np.concatenate([h, *map(_keys, part["h"])])
        w = np.concatenate([w, *(np.frombuffer(x, np.uint64) for x in part["w"])])
        c = np.concatenate([counts, *(unpack(x, np.int64) for x in part["counts"])])
        _, first, where = np.unique(_pair_keys(h, w), return_index=True, return_inverse=True)
        h, w, counts = h[first], w[first], np.bincount(where, c, len(first)).astype(np.int64)
    n = [int((counts == r).sum()) for r in range(1, GT_MAX + 2)]
    order = np.argsort(h)
    return pd.DataFrame({"bucket": [int(group["bucket"].iloc[0])], "h": [pack(np.diff(h[order], prepend=np.uint64(0)))], "w": [w[order].tobytes()],
                         "counts": [pack(counts[order])], "total": [int(counts.sum())], "n": [[*n, len(h)]]})


def _tabled(counts: DataFrame, name: str, merged: object = _merged, schema: str = TABLE) -> tuple[DataFrame, int, list[int]]:
    """The written tables by bucket, the sum of all counts, and the numbers of keys by count (the last: of all keys)."""
    out = _written(counts.groupBy("bucket").applyInPandas(merged, schema), name)
    row = out.agg(F.sum("total"), *[F.sum(F.col("n")[i]) for i in range(GT_MAX + 2)]).first()
    return out, row[0] or 0, [x or 0 for x in row[1:]]


def _written(df: DataFrame, name: str) -> DataFrame:
    """saved(), after which the shuffle files that made the table go."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return saved(df, name)
    finally:
        conf.set(key, before)


def _drop(df: DataFrame) -> None:
    """Delete a table of ``_written`` that only served to make others."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _slices(size: int = 50_000, **columns: np.ndarray) -> Batches:
    """Long rows of equally long arrays, some at a time."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, size):
        yield batch(**{k: v[at:at + size] for k, v in columns.items()})


def _pieces(batches: Batches, buckets: int, key: object) -> Iterator[pa.RecordBatch]:
    """Long rows (..., value) packed by bucket; ``key`` makes the 64-bit keys of a batch."""
    keys, values, n = [], [], 0

    def made() -> pa.RecordBatch:
        k, v = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(k)
        return _counted(k[order], v[order], buckets)

    for b in batches:
        keys.append(key(b))
        values.append(b.column("value").to_numpy())
        n += len(b)
        if n >= PIECE:
            yield made()
            keys, values, n = [], [], 0
    if n:
        yield made()


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy().view(np.uint64)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of the counts 0 to GT_MAX, renormalised so that higher counts keep all; 1 where the
    numbers of counts do not give a proper discount."""
    d = np.ones(GT_MAX + 1)
    if n[0] and n[GT_MAX]:
        top = (GT_MAX + 1) * n[GT_MAX] / n[0]
        for r in range(1, GT_MAX + 1):
            if n[r - 1] and top < 1:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top)
                if 0 < x < 1:
                    d[r] = x
    return d


@dataclass
class Model:
    """What every task needs: a few numbers, and with VOCABULARY the sorted words that are no part of the class."""

    tokens: int
    types: int
    least: int
    d1: np.ndarray
    #: What the discounted counts are divided by, and the probability left for unseen words or the class of merged ones.
    total: float
    left: float
    rare_tokens: int
    rare_types: int
    named: np.ndarray | None = None
    backoff_begin: float = 0.0
    backoff_rare: float = 0.0

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        if self.named is None:
            return hashes
        if not len(self.named):
            return np.full(len(hashes), RARE)
        at = np.minimum(np.searchsorted(self.named, hashes), len(self.named) - 1)
        return np.where(self.named[at] == hashes, hashes, RARE)

    def pairs(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Each token's history and the token."""
        w = self.classes(c.hashes)
        h = np.append(BEGIN, w[:-1])
        h[np.cumsum(c.n_tokens)[:-1]] = BEGIN
        return h, w

    def own(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which words have a probability of their own."""
        return (counts > 0) & ((counts >= self.least) | (keys == END))

    def log_p1(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words by their counts; the others share what is left."""
        d = np.where(counts <= GT_MAX, self.d1[np.minimum(counts, GT_MAX)], 1.0)
        share = (counts + 0.5) / (self.rare_tokens + 0.5 * (self.rare_types + 1))
        return np.log10(np.where(self.own(keys, counts), d * counts / self.total, self.left * share))


def _discounted(counts: Column, d: np.ndarray) -> Column:
    """Which part of a count discounting leaves."""
    kept = F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(counts, F.lit(GT_MAX)).cast("int") + 1)
    return F.when(counts <= GT_MAX, kept).otherwise(1.0)


def learn(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the written tables by word (kind 0: counts, -1: backoff) and by pair, from the rows of docs with ``train``."""
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    train = docs.filter("train")

    def words(batches: Batches) -> Batches:
        for c in chunks(batches):
            yield _counted(*np.unique(c.hashes, return_counts=True), buckets)

    unigrams, tokens, n1 = _tabled(train.mapInArrow(words, COUNTS), "unigrams")
    model = Model(tokens, n1[-1], max(1, int(np.ceil(tokens * VOCABULARY))), discounts(n1), 1.0, 1.0, 0, 0)

    def own_words(batches: Batches) -> Batches:
        for b in batches:
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                keys, counts = _keys(k), unpack(c, np.int64)
                own = model.own(keys, counts)
                yield from _slices(w=keys[own].view(np.int64), u=counts[own])

    named = unigrams.select("keys", "counts").mapInArrow(own_words, "w long, u long")
    mass, own_tokens, own_types = named.agg(F.sum(F.round(F.col("u") * _discounted(F.col("u"), model.d1) * (1 << 20)).cast("long")), F.sum("u"), F.count("*")).first()
    mass, own_tokens = (mass or 0) / (1 << 20), own_tokens or 0
    # what discounting and merging leave is never nothing
    model.total = max(tokens if mass < tokens - 0.5 else tokens + 1, 1)
    model.left = max((model.total - mass) / model.total, 1e-300)
    model.rare_tokens, model.rare_types = tokens - own_tokens, n1[-1] - own_types
    if model.least > 1:
        model.named = np.sort(named.select("w").toArrow()["w"].to_numpy().view(np.uint64))
    held = spark.sparkContext.broadcast(model)
    parts = 4 * buckets  # a pair takes more room than a word

    def pairs(batches: Batches) -> Batches:
        for c in chunks(batches):
            h, w = held.value.pairs(c)
            for at in _quarters(_pair_keys(h, w)):
                yield _counted_pairs(h[at], w[at], parts)

    counted, _, n2 = _tabled(train.mapInArrow(pairs, PAIRS), "bigrams", _merged_pairs, PAIR_TABLE)
    d2 = discounts(n2)

    def rows(batches: Batches) -> Batches:
        for b in batches:
            for h, w, c in zip(*(b.column(x).to_pylist() for x in ("h", "w", "counts")), strict=True):
                yield from _slices(h=_keys(h).view(np.int64), w=np.frombuffer(w, np.int64), n=unpack(c, np.int64))

    seen = counted.select("h", "w", "counts").mapInArrow(rows, "h long, w long, n long")
    seen = _written(seen.join(named, "w", "left").select("h", "w", "n", "u"), "pairs")
    _drop(counted)
    p1 = F.when(F.col("u").isNull(), F.lit(model.left)).otherwise(F.col("u") * _discounted(F.col("u"), model.d1) / F.lit(float(model.total)))
    n, left = F.col("n"), _discounted(F.col("n"), d2)
    # by history: its count, what discounting frees, and the unigram mass of the words seen after it
    sums = seen.groupBy("h").agg(F.sum("n").alias("n"), (F.sum(F.round((1 - left) * n * (1 << 20)).cast("long")) / (1 << 20)).alias("freed"),
                                 (1 - F.sum(F.round(p1 * (1 << 50)).cast("long")) / (1 << 50)).alias("rest"))
    # a history without discounted counts frees one count; one after which every word was seen needs nothing for the rest
    open_, frees = F.col("rest") > 1e-9, F.col("freed") > 0
    total = F.when(~open_, n - F.col("freed")).when(frees, n).otherwise(n + 1)
    backoff = F.when(open_, F.when(frees, F.col("freed")).otherwise(1.0) / F.greatest(total, F.lit(1.0)) / F.col("rest")).otherwise(1.0)
    histories = _written(sums.select("h", F.log10(total).alias("total"), F.log10(backoff).alias("backoff")), "histories")
    for h, x in histories.filter(F.col("h").isin(int(BEGIN.view(np.int64)), int(RARE.view(np.int64)))).select("h", "backoff").collect():
        setattr(model, "backoff_begin" if h == int(BEGIN.view(np.int64)) else "backoff_rare", x)

    unit = lambda x: F.round(x / UNIT).cast("long").alias("value")
    above = seen.join(histories, "h").select("h", "w", unit(F.log10(n * left) - F.col("total") - F.col("backoff") - F.log10(p1)))
    above = above.mapInArrow(lambda bs: _pieces(bs, parts, lambda b: _pair_keys(_column(b, "h"), _column(b, "w"))), COUNTS)
    by_word = histories.select("h", unit(F.col("backoff"))).mapInArrow(lambda bs: _pieces(bs, buckets, lambda b: _column(b, "h")), COUNTS)
    by_word = by_word.select(F.lit(-1).alias("kind"), "*").unionByName(unigrams.select(F.lit(0).alias("kind"), "bucket", "keys", "counts"))
    by_word, by_pair = _written(by_word, "by-word"), _written(above, "by-pair")
    _drop(seen)
    return model, by_word, by_pair


def _postings(keys: np.ndarray, docs: np.ndarray, buckets: int, offset: int, kind: int, block: int) -> pa.RecordBatch:
    """Lookups of one chunk: per bucket the sorted keys, how many documents hold each, which, and how often."""
    each, where = np.unique(keys, return_inverse=True)
    both = np.sort(where.astype(np.uint64) << _SHIFT | docs.astype(np.uint64))  # documents of a chunk take 20 bits
    keys, docs = each[(both >> _SHIFT).astype(np.int64)], (both & _LOW).astype(np.int64)
    new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys)))
    keys, docs = keys[first], docs[first]
    order, b = _by_bucket(keys, buckets)
    keys, docs, times = keys[order], docs[order], times[order]
    edge = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else [], len(b)).astype(int)
    cols = {x: [] for x in ("bucket", "keys", "counts", "lengths", "docs")}
    for i, j in zip(edge, edge[1:], strict=False):
        k = keys[i:j]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        cols["bucket"].append(int(b[i]) + offset)
        cols["keys"].append(pack(np.diff(k[start], prepend=np.uint64(0))))
        cols["lengths"].append(pack(np.diff(np.append(start, len(k))).astype(np.int32)))
        cols["docs"].append(pack(docs[i:j].astype(np.int32)))
        cols["counts"].append(pack(times[i:j].astype(np.int32)))
    n = len(cols["bucket"])
    return batch(bucket=pa.array(cols["bucket"], pa.int32()), kind=pa.array([kind] * n, pa.int32()), block=pa.array([block] * n, pa.int64()),
                 **{x: pa.array(cols[x], pa.binary()) for x in ("keys", "counts", "lengths", "docs")})


def _added(packed: list[bytes]) -> bytes:
    """Packed arrays added up, the shorter ones from the first place on."""
    arrays = [unpack(x, np.int64) for x in packed]
    out = np.zeros(max(map(len, arrays)), np.int64)
    for x in arrays:
        out[:len(x)] += x
    return pack(out)


def _together(group: pd.DataFrame) -> pd.DataFrame:
    """What the documents of one chunk gain in all buckets of a pass: a row per kind."""
    rows = []
    for kind, g in group.groupby("kind"):
        own = g.iloc[0][["a", "b", "c"]].tolist()
        rows.append([g["block"].iloc[0], kind, *([_added(g["a"]), *([_added(g["b"]), _added(g["c"])] if kind == 2 else [b"", b""])] if kind < 3 else own)])
    return pd.DataFrame(rows, columns=["block", "kind", "a", "b", "c"])


def score(docs: DataFrame, model: Model, by_word: DataFrame, by_pair: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, train): doc_id, train, n_tokens, n_known, base_score, score.

    Lookups take several times the room of the texts, so they are made in two passes, each with half of the pairs' buckets: what
    a document gains in a pass is written and the lookups go before the next begins. Chunks must be the same in both, which their
    checksums tell.
    """
    spark = docs.sparkSession
    buckets = buckets_of(spark)
    parts = 4 * buckets
    held = spark.sparkContext.broadcast(model)
    base_low = model.tokens + 0.5 * (model.types + 1)

    def look(half: int):
        def run(batches: Batches) -> Batches:
            for c in chunks(batches):
                keys = _pair_keys(*held.value.pairs(c))
                for at in _quarters(keys, (2 * half, 2 * half + 1)):
                    yield _postings(keys[at], c.doc[at], parts, 0, 1, c.block)
                ids = pa.array(c.ids, pa.int64())
                head = [pack(ids.fill_null(0).to_numpy()), pack(np.vstack([c.train, ids.is_null().to_numpy(False)]).astype(np.uint8).ravel()), pack(c.n_tokens.astype(np.int64))]
                check = pack(np.array([zlib.crc32(c.hashes, zlib.crc32(b"".join(head)))], np.int64))
                if half:
                    yield _postings(c.hashes, c.doc, buckets, parts, 2, c.block)
                yield batch(bucket=pa.array([c.block % (parts + buckets)] * 2, pa.int32()), kind=pa.array([3, 4 + half], pa.int32()), block=pa.array([c.block] * 2, pa.int64()),
                            keys=[head[0], check], counts=[head[1], b""], lengths=[head[2], b""], docs=[b"", b""]).slice(0 if half else 1)
        return run

    def meet(batches: Batches) -> Batches:
        """A bucket's tables come first (kinds -1 and 0), then the lookups of all chunks, one at a time."""
        m = held.value
        bucket, pieces, tables = -1, {}, {}

        def found(kind: int, k: np.ndarray) -> np.ndarray:
            if kind not in tables:
                got = pieces.pop(kind, [])
                keys = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in got)])
                order = np.argsort(keys)
                tables[kind] = keys[order], np.concatenate([np.zeros(0, np.int64), *(x for _, x in got)])[order]
            keys, values = tables[kind]
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            return np.where(keys[at] == k, values[at], 0) if len(keys) else np.zeros(len(k), np.int64)

        for b in batches:
            for r in b.to_pylist():
                if r["kind"] >= 3:
                    yield batch(block=pa.array([r["block"]], pa.int64()), kind=pa.array([r["kind"]], pa.int32()), a=[r["keys"]], b=[r["counts"]], c=[r["lengths"]])
                    continue
                if r["bucket"] != bucket:
                    bucket, pieces, tables = r["bucket"], {}, {}
                if r["kind"] <= 0:
                    pieces.setdefault(r["kind"], []).append((_keys(r["keys"]), unpack(r["counts"], np.int64)))
                    continue
                k = _keys(r["keys"])
                n = found(0, k)
                doc, times, each = unpack(r["docs"], np.int32), unpack(r["counts"], np.int32), unpack(r["lengths"], np.int32)
                add = lambda x: pack(np.bincount(doc, np.repeat(x, each) * times).astype(np.int64))  # noqa: B023, E731
                if r["kind"] == 1:
                    sums = [add(n), b"", b""]
                else:  # a word's own probability, and its backoff as the next token's history
                    after = np.where(m.own(k, n), found(-1, k), round(m.backoff_rare / UNIT))
                    gain = np.rint(m.log_p1(k, n) / UNIT) + np.where(k == END, 0, after)
                    sums = [add(gain), add(n > 0), add(np.rint(np.log10((n + 0.5) / base_low) / UNIT))]
                yield batch(block=pa.array([r["block"]], pa.int64()), kind=pa.array([r["kind"]], pa.int32()), a=sums[:1], b=sums[1:2], c=sums[2:])

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        checks = {k: list(group.loc[group["kind"] == k, "a"]) for k in (4, 5)}
        if len(checks[4]) != 1 or checks[4] != checks[5]:
            raise RuntimeError("a chunk of documents differs between the passes: score a written table")
        head = group[group["kind"] == 3].iloc[0]
        ids, tokens = unpack(head["a"], np.int64), unpack(head["c"], np.int64)
        n = len(ids)
        train, absent = unpack(head["b"], np.uint8).reshape(2, n).astype(bool)
        total, known, base = np.full(n, round(held.value.backoff_begin / UNIT)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for kind, a, b, c in zip(group["kind"], group["a"], group["b"], group["c"], strict=True):
            if kind >= 3:
                continue
            x = unpack(a, np.int64)
            total[:len(x)] += x
            if kind == 2:
                known[:len(x)] += unpack(b, np.int64)
                base[:len(x)] += unpack(c, np.int64)
        return pd.DataFrame({"doc_id": pd.array(np.where(absent, 0, ids), "Int64").copy() if not absent.any() else pd.array([None if z else int(i) for i, z in zip(ids, absent, strict=True)], "Int64"),
                             "train": train, "n_tokens": tokens, "n_known": known, "base_score": base * UNIT, "score": total * UNIT})

    none = [F.lit(None).cast("binary").alias(x) for x in ("lengths", "docs")]
    tables = [t.select((F.col("bucket") + add).alias("bucket"), kind.alias("kind"), F.lit(-1).cast("long").alias("block"), "keys", "counts", *none)
              for t, kind, add in ((by_pair, F.lit(0), 0), (by_word, F.col("kind"), parts))]
    passes = []
    for half in (0, 1):
        mine = F.col("bucket").between(half * parts // 2, (half + 1) * parts // 2 - 1)
        rows = docs.mapInArrow(look(half), LOOKUPS).unionByName(tables[0].filter(mine))
        if half:
            rows = rows.unionByName(tables[1])
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "kind", "block")
        passes.append(_written(rows.mapInArrow(meet, GAINS).groupBy("block").applyInPandas(_together, GAINS), "gains"))
    gains = passes[0].unionByName(passes[1])
    return gains.groupBy("block").applyInPandas(add_up, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(doc_id) mod 5 is not 1.

    Null texts count as empty: one end token. Repeated rows count and are scored each; a null doc_id counts as the empty text
    in the crc32; an empty table gives no rows; without training rows base scores are 0 and all words are unknown.
    """
    prepare(spark)
    src = pick(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    src = src.withColumn("train", remainder(F.col("doc_id"), 5) != 1)
    model, unigrams, bigrams = learn(src)
    out = score(src, model, unigrams, bigrams)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
