"""Content extraction and document assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.paths import is_index_text


def capped_text(content, cap_bytes: int | None = None):
    """A file as valid UTF-8 text; with ``cap_bytes``, its first bytes.

    ``content`` may be BINARY (file scan) or STRING (table views).  A cut
    inside a multi-byte character becomes U+FFFD.  Short content is passed
    through without re-encoding.
    """
    if cap_bytes is None:
        return content.cast("string")
    raw = F.encode(content, "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, cap_bytes).cast("string"))
    return F.when(F.octet_length(content) > cap_bytes, cut).otherwise(content.cast("string"))


def capped_binary_text(content, cap_bytes: int | None = None):
    """S8 for BINARY content from a file scan."""
    if cap_bytes is None:
        return F.make_valid_utf8(content.cast("string"))
    return F.make_valid_utf8(F.substring(content, 1, cap_bytes).cast("string"))


def assemble_documents(files: DataFrame, cap_bytes: int | None = None) -> DataFrame:
    """Listing rows -> documents (id = path).

    Files of a non-text type keep empty content but stay findable by name and
    path.  Rows with an ``error`` column set (unreadable files) are dropped
    here and are therefore not recorded as indexed (S20).  ``truncated`` marks
    text files of which ``cap_bytes`` left something out.
    """
    if "error" in files.columns:
        files = files.filter(F.col("error").isNull())
    if "content" not in files.columns:
        files = files.withColumn("content", F.lit(None).cast("string"))
    ctype = files.schema["content"].dataType
    if isinstance(ctype, T.BinaryType):
        text = capped_binary_text(F.col("content"), cap_bytes)
    else:
        text = capped_text(F.col("content"), cap_bytes)
    return files.select(
        F.col("path").alias("id"),
        "path",
        "name",
        F.when(is_index_text(F.col("name")), F.coalesce(text, F.lit(""))).otherwise(F.lit("")).alias("content"),
        F.col("size").cast("bigint").alias("size"),  # T5: numeric field, stored
        F.col("mod_time").cast("timestamp").alias("mod_time"),
        (
            F.lit(False)
            if cap_bytes is None
            else F.coalesce(is_index_text(F.col("name")) & (F.col("size") > cap_bytes), F.lit(False))
        ).alias("truncated"),
    )
