"""Exact duplicates with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z.  Digests that hold a
large share of the rows would each meet in one task, so they are dealt with
apart: a Misra-Gries summary of every partition (no shuffle of rows), merged,
names at most ``counters`` digests that may be frequent; exact counts verify
them; the verified winners are broadcast (at most ``counters`` rows) and their
rows are decided map-side.  Every other digest holds at most
rows / (counters + 1) rows and goes through an ordinary shuffle.

Cases: a null text counts as empty; the row with the largest id stays; a null
id is smaller than any other; of rows that repeat id and text exactly one
stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, id_key, materialize, shielded

COUNTERS = 1024


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, digest), written once; texts are not read again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest"),
        ),
        "digests",
    )


def _shrink(counts: dict, counters: int) -> dict:
    """Misra-Gries: subtracts the (counters + 1)-th largest count from all."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def summarize(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """Digests that may hold more than rows / (counters + 1) rows; at most ``counters``."""

    def summary(batches):
        counts: dict = {}
        for b in batches:
            for k, v in Counter(b.column(0).to_pylist()).items():
                counts[k] = counts.get(k, 0) + v
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())}
        )

    merged = (
        digests.select("digest")
        .mapInArrow(summary, "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "digest")
        .limit(counters + 1)
        .collect()
    )
    return [bytes(k) for k in _shrink({bytes(r["digest"]): r["n"] for r in merged}, counters)]


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, group_size, keep): the frequent digests, counted exactly."""
    spark = digests.sparkSession
    candidates = spark.createDataFrame([(k,) for k in summarize(digests, counters)], "digest binary")
    rows = digests.count()
    found = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep"))
        .filter(F.col("group_size") * (counters + 1) > rows)
    )
    return materialize(found, "heavy-digests")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = digest_table(docs, id_col, text_col)
    heavy = heavy_hitters(digests, counters)
    hot = digests.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("keep", F.max(F.struct("doc_id", "row_id")).over(group))
    )
    columns = (
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return hot.select(*columns).unionByName(rest.select(*columns))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    docs, restore = shielded(docs, (id_col, text_col))
    stays = exact_dedup(docs, id_col, text_col).filter("kept")
    stays = stays.select(id_key("doc_id").alias("_key"), F.col("text_sha256").alias("_digest"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Both steps need the same keys together: the texts are shuffled once.
    keyed = docs.withColumns({"_key": id_key(id_col), "_digest": F.sha2(ascii_lower(text), 256)})
    keyed = keyed.dropDuplicates(["_key", "_digest"])
    return restore(keyed.join(stays, ["_key", "_digest"], "left_semi"))
