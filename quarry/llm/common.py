"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Words between ASCII white space, and the white space itself.
WS_WORD = r"[^\x20\x09-\x0D]+"
WS = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the session."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs later steps a read, not the work
    before; columns such as generated row ids are fixed facts from then on.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # texts and ids take about a third less room than by default
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``used`` columns renamed, and what selects its columns again by their names.

    So a further column may bear any name, also one that a step makes up.
    """
    names = docs.columns
    inner = [n if n in used else f"further{i}" for i, n in enumerate(names)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*names)


def id_key(name: str) -> Column:
    """An id as text that is never null, to join and group by."""
    return F.coalesce(F.concat(F.lit("#"), F.col(name).cast("string")), F.lit("null"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into short ones, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def prefix_sum(
    df: DataFrame, order: list[Column], value: str, out: str, group: list[str] = (), name: str = "prefix"
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (long) over the rows before in ``order``.

    With ``group``, sums start anew in each group; ``order`` must then begin
    with the group's columns.  Rows are range-partitioned by ``order``, so a
    group or a tie of any size is split as long as ``order`` ends in a column
    that tells rows apart.  A row adds to the sum inside its partition what its
    group had in earlier partitions.  Of the groups in a partition only the
    first can have begun before it, so at most one row for each partition is
    broadcast, however many groups there are.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, name)
    group = list(group)
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], F.sum("_total").over(before).alias("_before")
    ).filter(F.col("_before") != 0)
    on = F.col("_part") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    zero = F.lit(0).cast("long")
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
        .join(F.broadcast(offsets), on, "left")
        .withColumn(out, F.col("_inside") + F.coalesce("_before", zero))
        .drop("_part", "_p", "_inside", "_before", *[f"_g_{g}" for g in group])
    )
