"""Incremental census with Structured Streaming.

The reference scans one tree on demand; at corpus scale new snapshots arrive
continuously.  A file stream over a folder of ``files`` parquet batches feeds
the same batch operators through ``foreachBatch``: each micro-batch's long
fact tables (dependencies, routes, infrastructure, structure stats) are written
to a folder of that batch, so a replayed batch overwrites its own rows.  A batch
may hold part of a snapshot: ``read_census`` adds up counts and removes repeated
routes over batches.  The caller names the stream's checkpoint folder, so a
restarted query resumes where it stopped (``availableNow`` processes the backlog
and stops).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import infra as I
from ..operators import manifests as M
from ..operators import routes as R
from ..operators import structure as S
from ..session import saved
from ..sources.files import FILES_SCHEMA, SNAP_KEY


def _process_batch(out_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch = saved(batch, "stream-batch")  # read once from the source, then by each parser from columns
        facts = S.file_facts(batch)
        tables = {
            "dependencies": M.dependencies(batch),
            "routes": R.routes(batch),
            "infrastructure": I.infrastructure(batch),
            "project_stats": S.project_stats(facts),
        }
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}/batch_id={batch_id}")
    return run


def read_census(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """One of the stream's tables over all batches."""
    df = spark.read.parquet(f"{out_dir.rstrip('/')}/{name}").drop("batch_id")
    if name == "project_stats":
        counts = [c for c in df.columns if c not in SNAP_KEY]
        return df.groupBy(*SNAP_KEY).agg(*[F.sum(c).alias(c) for c in counts])
    return df.distinct() if name in ("routes", "infrastructure") else df


def start_census_stream(spark: SparkSession, files_dir: str, out_dir: str, checkpoint: str,
                        available_now: bool = True, max_files_per_trigger: int = 64):
    """Start the stream; returns the StreamingQuery."""
    stream = (spark.readStream.schema(FILES_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(files_dir))
    writer = stream.writeStream.foreachBatch(_process_batch(out_dir)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
