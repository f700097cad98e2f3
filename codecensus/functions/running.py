"""Running totals and positions over a global or grouped order, without one task per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def running_total(df: DataFrame, group: list[str], order: list[Column], values: dict[str, Column],
                  save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add for each name in ``values`` the sum of its value over the rows of the group that come before the row.

    Rows are range-partitioned by group and order, so a group of any size spans many tasks: each partition sums its own
    rows, and the sums of the partitions before it (one row per partition and group) are added. ``save`` writes and
    rereads a table, so that both readings see the same partitions. ``order`` must decide every tie that matters.
    """
    part = df.withColumn("_g", F.struct(*[F.col(c) for c in group]) if group else F.lit(0)) \
        .withColumn("_o", F.struct(*order)).withColumns({f"_v_{k}": v for k, v in values.items()})
    part = save(part.repartitionByRange(F.col("_g"), F.col("_o")).withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", "_g").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("_g", "_pid").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    offs = sums.select(F.col("_g").alias("_g2"), F.col("_pid").alias("_p2"),
                       *[F.coalesce(F.sum(f"_s_{k}").over(across), F.lit(0)).alias(f"_b_{k}") for k in values])
    out = part.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(local), F.lit(0)) for k in values})
    out = out.join(offs, out["_g"].eqNullSafe(offs["_g2"]) & (out["_pid"] == offs["_p2"]))
    return out.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_b_{k}")).alias(k) for k in values])


def running_position(df: DataFrame, group: list[str], order: list[Column], name: str, save: Callable[[DataFrame], DataFrame],
                     drop: tuple[str, ...] = ()) -> DataFrame:
    """Add as ``name`` how many rows of the group come before the row: ``running_total`` of ones, with one exchange of the rows.

    Rows are range-partitioned and sorted by group and order, and a task counts as they stream by, in Arrow batches. Only a
    partition's first group may have rows in the partitions before it; their number, one row per partition, is
    added. ``order`` must decide every tie that matters; the columns ``drop`` only serve it.
    """
    part = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).drop(*drop)
    columns = part.columns
    part = part.withColumn("_pid", F.spark_partition_id())
    schema = StructType([*part.schema.fields, StructField("_first", BooleanType()), StructField("_n", LongType())])
    part = save(part.mapInArrow(_counted(group), schema))
    n = part.groupBy(*group, "_pid").agg(F.max("_first").alias("_f"), F.count(F.lit(1)).alias("_c"))
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = n.select("_f", F.col("_pid").alias("_p2"), F.coalesce(F.sum("_c").over(across), F.lit(0)).alias("_b")).filter("_f").drop("_f")
    out = part.join(F.broadcast(offs), F.col("_first") & (F.col("_pid") == F.col("_p2")), "left")
    return out.select(*columns, (F.col("_n") + F.coalesce("_b", F.lit(0))).alias(name))


def _counted(group: list[str]):
    """Per row of a sorted partition: whether its group is the partition's first, and the rows of the group before it there."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last, first, seen = None, True, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for c in group:
                now = b.column(c)
                a, z = now.slice(0, n - 1), now.slice(1)
                begins[1:] |= pc.fill_null(pc.not_equal(a, z), False).to_numpy(zero_copy_only=False)
                begins[1:] |= a.is_null().to_numpy(zero_copy_only=False) != z.is_null().to_numpy(zero_copy_only=False)
                if last is not None and last[c] != now[0].as_py():
                    begins[0] = True
            row = np.arange(n)
            # where a row's group begins; before this batch: the rows of it that went by
            start = np.maximum.accumulate(np.where(begins, row, -1))
            count = np.where(start >= 0, row - start, row + seen)
            in_first = first & (start < 0)
            first, seen = bool(in_first[-1]), int(count[-1]) + 1
            last = {c: b.column(c)[n - 1].as_py() for c in group}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(in_first), pa.array(count, pa.int64())], names=[*b.schema.names, "_first", "_n"])

    return run
