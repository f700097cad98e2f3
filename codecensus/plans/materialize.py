"""Reuse of derived corpora within a session.

A corpus (a ``files`` table derived from the driver tables) is built once per
(session, tables folder) and written as parquet under the session's shared
checkpoint folder (``spark.checkpoint.dir``), range-partitioned by
(ext, base): later queries read the written table, so a parser's
``base = 'go.mod'`` filter and its column selection reach the parquet scan
(file skipping on min/max statistics, column pruning), and the lineage is cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_CACHE: dict[tuple, DataFrame] = {}
_RUN = uuid.uuid4().hex[:12]


def write_table(df: DataFrame, spark: SparkSession, name: str, cluster_by=("ext", "base", "repo_id", "rel_path")) -> DataFrame:
    """Write ``df`` as parquet in the shared checkpoint folder and return the re-read table.

    Rows are range-partitioned by ``cluster_by`` as far as ``df`` has those columns. The last of them is unique enough to
    split a repository of any size; the number of files follows the data, by adaptive execution.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    safe = "".join(ch if ch.isalnum() else "_" for ch in name)
    path = f"{root}/codecensus-{_RUN}/{safe}"
    by = [c for c in cluster_by if c in df.columns]
    out = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    out.write.mode("overwrite").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def corpus(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    df = _CACHE.get(key)
    if df is None:
        df = write_table(build(), spark, f"{sf_dir.rstrip('/').split('/')[-1]}-{name}")
        _CACHE[key] = df
    return df


def clear() -> None:
    _CACHE.clear()
