"""The canonical ``files`` table.

``files(repo_id, snapshot_id, project_name, rel_path, abs_path, base, ext, n_bytes, content)``
unique on (repo_id, snapshot_id, rel_path).  A tree is ingested once (listed and
pruned by tasks -> read by tasks -> parquet) and every job reads the parquet table, so later stages get
column pruning and predicate pushdown on ``base`` / ``ext``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.paths import pruned_by
from ..functions.running import running_total
from ..session import ensure_checkpoint_dir, saved, ship_package
from .tree import FORMAT, register

FILES_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("snapshot_id", T.StringType()),
    T.StructField("project_name", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("abs_path", T.StringType()),
    T.StructField("base", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])

FILE_KEY = ["repo_id", "snapshot_id", "rel_path"]
SNAP_KEY = ["repo_id", "snapshot_id"]


def with_path_columns(df: DataFrame) -> DataFrame:
    """Derive abs_path, base, ext, n_bytes from (project_name, rel_path, content)."""
    base = F.element_at(F.split(F.col("rel_path"), "/"), -1)
    return (
        df.withColumn("abs_path", F.concat(F.lit("/"), F.col("project_name"), F.lit("/"), F.col("rel_path")))
        .withColumn("base", base)
        .withColumn("ext", F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)))
        .withColumn("n_bytes", F.octet_length("content").cast("bigint"))
        .select(*[f.name for f in FILES_SCHEMA.fields])
    )


def files_from_frame(df: DataFrame, prune: bool = True) -> DataFrame:
    """Normalise a (repo_id, snapshot_id, project_name, rel_path, content) frame into ``files``."""
    out = with_path_columns(df)
    if prune:
        out = out.filter(~pruned_by(fixed.SKIP_DIRS_SCAN))
    return out


def files_from_rows(spark: SparkSession, rows, repo_id="repo", snapshot_id="s1", project_name="project") -> DataFrame:
    """Small helper for tests: rows are (rel_path, content) pairs of one snapshot."""
    data = [(repo_id, snapshot_id, project_name, r, c) for r, c in rows]
    schema = "repo_id string, snapshot_id string, project_name string, rel_path string, content string"
    return files_from_frame(spark.createDataFrame(data, schema))


LISTED = "path string, is_dir boolean, length bigint"
#: Bytes of a shard of a listing, what opening a file costs in the same measure, and the number of shards that a plan looks at.
SHARD_BYTES, OPEN_BYTES, MAX_SHARDS = 128 << 20, 64 << 10, 50_000


def _list_folders(batches):
    """Children of each folder. A link is a file, wherever it leads: the walk doesn't follow links to folders."""
    import os

    import pandas as pd
    from pyarrow import fs

    from codecensus.sources.tree import open_store
    for b in batches:
        rows = []
        for p in b["path"]:
            store, inner = open_store(p)
            scheme = p[:len(p) - len(inner)] if p.endswith(inner) else ""
            for x in store.get_file_info(fs.FileSelector(inner)):
                link = isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path)
                folder = x.type == fs.FileType.Directory and not link
                if folder or link or x.type == fs.FileType.File:
                    rows.append((scheme + x.path, folder, x.size or 0 if x.type == fs.FileType.File else 0))
            if isinstance(store, fs.LocalFileSystem):  # links to nothing are no entry of the listing above
                for e in os.scandir(inner):
                    if e.is_symlink() and not os.path.exists(e.path):
                        rows.append((scheme + e.path, False, 0))
        yield pd.DataFrame(rows, columns=["path", "is_dir", "length"]).astype({"path": "object", "is_dir": "bool", "length": "int64"}).drop_duplicates("path")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file under ``root`` outside pruned folders, whatever its name starts with.

    Folders are listed in tasks, level by level: a pruned folder is never entered, and the driver only learns whether
    another level is left. One job per level of depth.
    """
    ship_package(spark)
    folders = spark.createDataFrame([(root,)], "path string")
    levels = []
    while True:
        listed = saved(folders.mapInPandas(_list_folders, LISTED), "listing")
        levels.append(listed.filter("not is_dir").select("path", "length"))
        name = F.element_at(F.split("path", "/"), -1)
        folders = listed.filter("is_dir").filter(~name.isin(*fixed.SKIP_DIRS_SCAN) & ~name.startswith(".")).select("path")
        if not folders.limit(1).count():
            return reduce(DataFrame.unionByName, levels)
        folders = folders.repartition(spark.sparkContext.defaultParallelism)


def write_listing(listed: DataFrame) -> str:
    """Deal a listing (path, length) to shards of about equal bytes, in path order; returns the folder of the shards.

    A file's shard follows from the bytes listed before it, a running total over range partitions. Beyond MAX_SHARDS the
    shards grow instead, which readers take batch by batch.
    """
    spark = listed.sparkSession
    base = F.element_at(F.split("path", "/"), -1)
    cost = F.col("n_bytes") + OPEN_BYTES
    rows = listed.select("path", base.alias("base"), F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("n_bytes"))
    placed = running_total(rows, [], [F.col("path")], {"before": cost}, lambda d: saved(d, "listed-files"))
    total = placed.agg(F.max(F.col("before") + cost)).first()[0] or 0
    shard = F.expr(f"cast(before div {max(SHARD_BYTES, total // MAX_SHARDS + 1)} as int)").alias("shard")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/codecensus-listing-{uuid.uuid4().hex}"
    placed.select("path", "base", "ext", "n_bytes", shard).repartition("shard").write.partitionBy("shard").parquet(path)
    return path


def ingest_tree(spark: SparkSession, root: str, repo_id: str, snapshot_id: str) -> DataFrame:
    """S1 + S2: every file under ``root`` outside pruned folders, links to files with what they lead to.

    Spark's own file listing hides names that start with '.' or '_', which the census keeps (``.env``, ``__init__.py``,
    ``_x/``), so the tree is listed by tasks, dealt to shards of equal bytes and read by the ``source_tree`` source; a
    filter on ``base`` or ``ext`` of the result decides which files are opened. Bytes that are no UTF-8 are replaced.
    A link to a folder or to nothing is a file with null content.
    """
    uri = root.rstrip("/")
    register(spark)
    raw = spark.read.format(FORMAT).option("listing", write_listing(list_tree(spark, uri))).load()
    rel = F.substring(F.col("path"), F.lit(len(uri) + 2), F.length("path"))
    project = uri.split("/")[-1]
    return raw.select(
        F.lit(repo_id).alias("repo_id"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(project).alias("project_name"), rel.alias("rel_path"),
        F.concat(F.lit(f"/{project}/"), rel).alias("abs_path"), "base", "ext", "n_bytes", F.expr("make_valid_utf8(cast(content as string))").alias("content"))


def unreadable(files: DataFrame) -> DataFrame:
    """(repo_id, snapshot_id, n_files, n_unreadable): files of each snapshot, and those whose content could not be had."""
    return files.groupBy(*SNAP_KEY).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("content").isNull()).alias("n_unreadable"))


def write_files(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist ``files`` partitioned by snapshot and clustered by (ext, base) for row-group skipping; a repository of any size spans tasks."""
    (df.repartitionByRange("snapshot_id", "repo_id", "ext", "base", "rel_path")
       .sortWithinPartitions("snapshot_id", "ext", "base")
       .write.mode(mode).partitionBy("snapshot_id").parquet(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in FILES_SCHEMA.fields])
