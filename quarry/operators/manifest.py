"""Manifest interchange as key/value JSON rows.

The manifest is a typed table; for exchange with key/value stores each row
becomes ``(bucket, key, value)`` with ``value`` the JSON object
``{"last_indexed": "<RFC 3339 UTC time>"}`` (fraction digits only when
non-zero, trailing zeros dropped).  An empty bucket name means ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket names.
BUCKET_DEFAULT = "default"
BUCKET_REQUESTS = "requests"
BUCKET_FILES = "files"


def bucket_name(col: Column) -> Column:
    """An empty bucket name means the default bucket."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(BUCKET_DEFAULT))


def rfc3339(ts: Column) -> Column:
    """UTC timestamp as RFC 3339 text with trimmed fraction (session zone UTC)."""
    frac = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.lit("Z"),
    )


def manifest_to_kv(manifest: DataFrame) -> DataFrame:
    """S19 encode: manifest -> (bucket, key, value JSON)."""
    return manifest.select(
        F.lit(BUCKET_FILES).alias("bucket"),
        F.col("path").alias("key"),
        F.to_json(F.struct(rfc3339(F.col("last_indexed")).alias("last_indexed"))).alias("value"),
    )


def manifest_from_kv(kv: DataFrame) -> DataFrame:
    """S19 decode: the files bucket of a key/value table -> manifest.

    Empty keys are invalid and dropped; values that do not parse give a null
    time, which the change check treats like a missing entry (index it).
    """
    parsed = F.from_json(F.col("value"), "last_indexed string")
    return kv.filter((bucket_name(F.col("bucket")) == BUCKET_FILES) & (F.col("key") != "")).select(
        F.col("key").alias("path"),
        F.to_timestamp(parsed["last_indexed"]).alias("last_indexed"),
    )


def _addressed(kv: DataFrame) -> DataFrame:
    """Rows with their bucket named and a valid (not empty) key."""
    return kv.withColumn("bucket", bucket_name(F.col("bucket"))).filter(F.col("key").isNotNull() & (F.col("key") != ""))


def kv_put(kv: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (bucket, key, value) replace those of the same bucket and key, or are added."""
    new = _addressed(rows).select("bucket", "key", "value").dropDuplicates(["bucket", "key"])
    old = _addressed(kv).join(new.select("bucket", "key"), ["bucket", "key"], "left_anti")
    return old.select("bucket", "key", "value").unionByName(new)


def kv_delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the keys (bucket, key); keys that are not there are no error."""
    gone = _addressed(keys).select("bucket", "key").distinct()
    return _addressed(kv).join(gone, ["bucket", "key"], "left_anti").select("bucket", "key", "value")


def kv_keys(kv: DataFrame, bucket: str = "") -> DataFrame:
    """The keys of a bucket; an empty name means the default bucket."""
    named = F.lit(bucket or BUCKET_DEFAULT)
    return _addressed(kv).filter(F.col("bucket") == named).select("key")
