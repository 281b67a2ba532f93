"""SparkSession settings for local runs, tests and the benchmark.

On a cluster the session comes from the platform; ``ensure_checkpoint_dir``
only fills ``spark.checkpoint.dir`` when nothing set it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        # Small broadcast hash tables otherwise reserve a whole 64 MiB page.
        .config("spark.buffer.pageSize", "4m")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new folder of the shared folder and reads it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only where nothing set
    it (local tests) a scratch folder is made; the setting itself is static, so
    that folder is kept as the checkpoint folder of the SparkContext.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
