"""Shared helpers of the training-text operators: column picking, written tables, Arrow batch limits."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_defaults, ensure_checkpoint_dir

#: Java's \S is [^\x20\x09-\x0D] exactly, as long as UNICODE_CHARACTER_CLASS is off (Spark never sets it).
WORD = r"\S+"
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of text that one Arrow batch brings into a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Settings and code that the Python stages rely on: bounded Arrow batches, this package on every executor."""
    apply_defaults(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "codecensus.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.join("codecensus", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str, row: str | None = None) -> DataFrame:
    """Exactly the named columns, found by position so that other columns whose names clash do no harm.

    With ``row``, the whole input row comes along as a struct of that name.
    """
    cols = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(cols))])
    out = [F.col(f"c{cols.index(n)}").alias(n) for n in names]
    if row:
        out.append(F.struct(*[F.col(f"c{i}") for i in range(len(cols))]).alias(row))
    return flat.select(*out)


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The rows that ``pick(..., row=...)`` carried, with their own names again."""
    return df.select(*[F.col(f"{row}.c{i}") for i in range(len(names))]).toDF(*names)


#: Tables written inside each open scratch, innermost last.
_OPEN: list[list[str]] = []
_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write as parquet in the shared folder and read again: cuts the lineage, survives lost executors.

    Inside a ``scratch`` the table goes with it, and the shuffle files that made it go at once.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if not _OPEN:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    _OPEN[-1].append(path)
    before = spark.conf.get(_FILES_GO, None)
    try:
        spark.conf.set(_FILES_GO, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FILES_GO) if before is None else spark.conf.set(_FILES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``saved`` inside are deleted at the end; what ``kept`` wrote stays for the caller."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``saved`` for a result that outlives the innermost scratch."""
    out = saved(df, name)
    if _OPEN:
        path = _OPEN[-1].pop()
        if len(_OPEN) > 1:
            _OPEN[-2].append(path)
    return out


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int = 200_000) -> DataFrame:
    """Join with a table that has one row per key: broadcast when its counted rows are few, else by shuffle.

    ``right`` must be cheap to count (a written table or a small aggregate). Beyond the limit a sort-merge join is used,
    whose hot keys adaptive execution splits.
    """
    names = right.columns
    right = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(names)])
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    cond = [F.col(c).eqNullSafe(F.col(f"_r{names.index(c)}")) for c in on]
    out = left.join(right, cond, how)
    return out.select(*left.columns, *[F.col(f"_r{i}").alias(c) for i, c in enumerate(names) if c not in on])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


Batches = Iterator[pa.RecordBatch]


def batch(**columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
