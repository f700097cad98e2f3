"""Fill-in-middle: texts cut into pieces of whole units, assembled and restored by secondary sort, digests fed piece by piece."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _SPACE
from .common import Batches, batch, pick, prepare, table

#: Bytes of a piece at most; it ends with a whole unit unless one unit is longer.
PIECE = 64 << 10
#: Bytes and rows that a task gathers before it hands a batch on.
FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 4000
SEED = 42
#: Documents cut, of 100; of those the ones whose suffix comes first, of 100.
CUT, SUFFIX_FIRST = 50, 80
#: The mark that opens each section of an output.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Places of the sections in a text; the row that ends a document comes behind them.
_PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_END = 3

CUT_ROWS = "doc_id long, key binary, pos int, form string, n long, prefix_chars long, middle_chars long, data binary"
OUTPUT_ROWS = CUT_ROWS + ", place int, copies long, output_sha256 string"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class _Rows:
    """Rows gathered column by column; a batch is due when they are many or long."""

    def __init__(self, schema: str):
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        self.schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.rows = self.bytes = 0

    def add(self, *values: object, size: int = 0) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)
        self.rows += 1
        self.bytes += size

    def due(self) -> bool:
        return self.rows >= FLUSH_ROWS or self.bytes >= FLUSH_BYTES

    def take(self) -> pa.RecordBatch:
        out = batch(**{f.name: pa.array(c, f.type) for f, c in zip(self.schema, self.columns, strict=True)})
        self.clear()
        return out


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Ends (in bytes) of a text's units: words with the blanks before them, and the blanks at its end."""
    solid = ~_SPACE[raw]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(raw)) if len(raw) and not solid[-1] else ends


def _chars(raw: np.ndarray) -> int:
    return len(raw) - int(((raw & 0xC0) == 0x80).sum())


def sections(text: bytes, h: tuple[int, int, int, int]) -> tuple[str, int, int | None, int | None, list[tuple[bytes, int, int]], np.ndarray]:
    """Form, units, code points of prefix and middle, the sections (mark, from, to) in output order, and the unit ends."""
    raw = np.frombuffer(text, np.uint8)
    ends = unit_ends(raw)
    n = len(ends)
    if not n or h[2] % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", n, None, None, [(b"", 0, len(text))], ends
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, q = (int(ends[k - 1]) if k else 0 for k in (low, high))
    prefix, suffix, middle = (PREFIX, 0, p), (SUFFIX, q, len(text)), (MIDDLE, p, q)
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    order = [suffix, prefix, middle] if form == "spm" else [prefix, suffix, middle]
    return form, n, _chars(raw[:p]), _chars(raw[p:q]), order, ends


def _cuts(text: bytes, ends: np.ndarray, lo: int, hi: int):
    """Pieces (from, to) of a section; an empty section is one empty piece."""
    at = lo
    while True:
        to = hi
        if hi - at > PIECE:
            k = int(np.searchsorted(ends, at + PIECE, "right")) - 1
            to = int(ends[k]) if k >= 0 and ends[k] > at else at + PIECE
            while to > at + 1 and text[to] & 0xC0 == 0x80:  # inside a long unit: between code points
                to -= 1
        yield at, to
        at = to
        if at >= hi:
            return


def cut(batches: Batches) -> Batches:
    """Rows (doc_id, text, h1..h4) as pieces in output order; the first piece of a section begins with its mark.

    A key names the row's content and how often the task has met it before, so equal rows don't gather under one key; it
    doesn't depend on the order of the rows, so a task that is run again makes the same pieces.
    """
    seen: dict[bytes, int] = {}
    out = _Rows(CUT_ROWS)
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        h = list(zip(*(b.column(f"h{k}").to_pylist() for k in range(1, 5)), strict=True))
        for i, value in enumerate(b.column("text")):
            text = (value.as_py() or "").encode()
            key = hashlib.blake2b(text, digest_size=16, key=str(ids[i]).encode()).digest()
            seen[key] = times = seen.get(key, 0) + 1
            key += times.to_bytes(4, "big")
            form, n, prefix, middle, order, ends = sections(text, h[i])
            pos = 0
            for mark, lo, hi in order:
                for k, (a, z) in enumerate(_cuts(text, ends, lo, hi)):
                    out.add(ids[i], key, pos, form, n, prefix, middle, (b"" if k else mark) + text[a:z], size=z - a)
                    pos += 1
                    if out.due():
                        yield out.take()
    yield out.take()


def assemble(batches: Batches) -> Batches:
    """Pieces sorted by key and output position: digests the output as it goes by and finds each piece's place in the text.

    The sections are read off the output alone: a mark that opens a piece opens a section. Equal pieces of equal rows from
    several tasks lie side by side and count as copies. A row behind each document's pieces holds its digest and copies.
    """
    out = _Rows(OUTPUT_ROWS)
    doc: list | None = None  # the columns of the document at hand
    digest, last, copies, place = hashlib.sha256(), -1, 0, 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            doc_id, key, pos, form, n, prefix, middle, data = row
            if doc is None or key != doc[1]:
                if doc:
                    out.add(*doc[:2], last + 1, *doc[3:7], b"", _END, copies, digest.hexdigest())
                doc, digest, last, copies, place = list(row), hashlib.sha256(), -1, 0, 0
            copies += pos == 0
            if pos == last:
                continue
            last = pos
            digest.update(data)
            if form != "plain" and data[:3] in _PLACE:
                place, data = _PLACE[data[:3]], data[3:]
            out.add(doc_id, key, pos, form, n, prefix, middle, data, place, None, None, size=len(data))
            if out.due():
                yield out.take()
    if doc:
        out.add(*doc[:2], last + 1, *doc[3:7], b"", _END, copies, digest.hexdigest())
    yield out.take()


def restore(batches: Batches) -> Batches:
    """Pieces sorted by key and place in the text: digests the text as it goes by; one row for every copy of a document."""
    out = _Rows(RESULT)
    digest = hashlib.sha256()
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            doc_id, _, _, form, n, prefix, middle, data, place, copies, sha = row
            if place != _END:
                digest.update(data)
                continue
            for _ in range(copies):
                out.add(doc_id, n, form, prefix, middle, sha, digest.hexdigest())
                if out.due():
                    yield out.take()
            digest = hashlib.sha256()
    yield out.take()


def pieces(docs: DataFrame) -> DataFrame:
    """The outputs as pieces (doc_id, key, pos, form, n, prefix_chars, middle_chars, data): the output of a key is its data in
    the order of pos. Read the pieces of several tasks by ``distinct`` keys and positions: equal rows may share a key."""
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    h = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    return src.select("doc_id", "text", *draws).mapInArrow(cut, CUT_ROWS)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Pieces are dealt by key and sorted by (key, output position) inside their partitions, the DataFrame form of
    repartitionAndSortWithinPartitions; a task streams them into digests and never holds a document. The same partitions are then
    sorted by (key, place in the text), which needs no second exchange, and streamed into the digest of the restored text.

    Null texts count as empty; empty texts are plain with n = 0; a null doc_id draws as the empty text; repeated rows give
    a row each; an empty table gives no rows; other columns are not read; texts without a word are one unit.
    """
    dealt = pieces(docs).repartition("key").sortWithinPartitions("key", "pos")
    again = dealt.mapInArrow(assemble, OUTPUT_ROWS).sortWithinPartitions("key", "place", "pos")
    return again.mapInArrow(restore, RESULT)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle outputs and restored texts of all whole documents, as digests."""
    prepare(spark)
    return fill_in_middle(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3,
             ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS z,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT} THEN 'plain'
                  WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid, array_to_string(u[z + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
