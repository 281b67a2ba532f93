"""Run progress over a ledger (S21) with a distributed running sum.

A running sum over a whole table is usually written as a window without a
partition, which gathers every row into one task.  Here the ledger is range
partitioned by the order column, each partition sums locally, the partition
totals (one row per partition, bounded by the partition count) are turned
into offsets, and every row adds its partition's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.format import progress_percent
from quarry.session import ensure_checkpoint_dir


def running_sum(df: DataFrame, order_col: str, value_col: str, out_col: str, partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over rows with order <= this row.

    ``order_col`` must be unique.  The range-partitioned input is checkpointed
    (reliable, in the session's checkpoint folder); then one job for the
    partition totals and one for the result; no task sees more than a
    partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or spark.sparkContext.defaultParallelism
    # Checkpointed so the partition ids stay fixed even if a task is re-run.
    parted = df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id()).checkpoint()
    totals = parted.groupBy("_pid").agg(F.sum(value_col).alias("_ptot"))
    # One row per partition: a window over it is bounded by the partition count.
    offsets = totals.select(
        "_pid",
        (F.sum("_ptot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ptot")).alias(
            "_off"
        ),
    )
    local = F.sum(value_col).over(
        Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = parted.withColumn("_local", local).join(F.broadcast(offsets), "_pid")
    return out.withColumn(out_col, F.col("_local") + F.col("_off")).drop("_pid", "_local", "_off")


def ledger_progress(ledger: DataFrame, order_col: str, initial: int, final: int) -> DataFrame:
    """Per ledger row: cumulative done, total and progress percent.

    ``ledger`` has one row per batch with ``n_done``; the total is one scalar.
    """
    total = ledger.agg(F.sum("n_done").alias("t")).first()["t"] or 0
    cum = running_sum(ledger, order_col, "n_done", "cum_done")
    return cum.withColumn("n_total", F.lit(int(total))).withColumn(
        "progress", progress_percent(F.col("cum_done"), F.col("n_total"), initial, final)
    )
