"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for correctness or scale, applied on top of whatever
# the cluster already configured (never overriding an explicit cluster value).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value, as the
    # reference's JSON decoder does.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Filters on file names reach the reader of source trees.
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "codecensus") -> SparkSession:
    """Local session for tests and the benchmark (single JVM)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
        # Post-shuffle stages here are CPU-bound (regexes, windows over lines): keep them at least
        # as wide as the cores instead of coalescing to 64 MB partitions.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(8 * 1024 * 1024))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to an existing session."""
    for k, v in _DEFAULTS.items():
        if k == "spark.ui.enabled":
            continue
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; a scratch one stands in only on a single machine (tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="codecensus-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write as parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/codecensus-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a corpus that one task builds and parses: its memory and time stay the same at any size.
TASK_ROWS = 50_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int | None = None) -> DataFrame:
    """Deal ``df`` by ``keys`` to as many tasks as its ``rows`` need, ``each`` of them or TASK_ROWS to a task.

    Adaptive execution sizes tasks by the bytes that it moves; where row keys become texts and lines behind the exchange, those
    say nothing about what a task holds. What a reader groups by file behind this exchange needs no further one.
    """
    return df.repartition(max(2, -(-rows // (each or TASK_ROWS))), *keys)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> str:
    """Write as a table bucketed and sorted by ``keys`` in the shared folder; groupings and joins of it need no exchange.

    Returns the table's name. One exchange per table deals the rows; a bucket is one file. Rows of one key meet in one bucket, sorted on disk where they don't
    fit. ``drop_bucketed`` removes what was written.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"codecensus_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}"
    rows = df.repartition(n, *keys).sortWithinPartitions(*keys)
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return table


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_bucketed(spark: SparkSession, tables: list[str]) -> None:
    """Drop bucketed tables and their files; results that still read them must be written before."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    for t in tables:
        spark.sql(f"drop table if exists {t}")
        delete_folder(spark, f"{root}/{t}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Bring this package to executors that don't have it installed, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="codecensus-code-"), "codecensus_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("codecensus", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
