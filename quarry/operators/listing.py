"""Listing operators: pruning, exclusion, change detection.

All are narrow transforms or equi-joins on ``path``; none collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import (
    ancestor_dirs,
    is_hidden_below,
    is_index_text,
    is_snippet_text,
    is_under,
    strip_trailing_slash,
)


def _norm_excludes(excludes: Sequence[str]) -> list[str]:
    out = []
    for e in excludes:
        e = e.rstrip("/") or "/"
        if e not in out:
            out.append(e)
    return out


def visible_files(listing: DataFrame, root: str) -> DataFrame:
    """S2 + S4: regular files under ``root`` with no hidden part below it."""
    r = F.lit(root.rstrip("/") or "/")
    return listing.filter(~F.col("is_dir") & is_under(F.col("path"), r) & ~is_hidden_below(F.col("path"), r))


def excluded(path, excludes: Sequence[str]):
    """Column: ``path`` lies below one of the exclude folders (None if none)."""
    ex = _norm_excludes(excludes)
    if not ex:
        return None
    return F.arrays_overlap(ancestor_dirs(path), F.array(*[F.lit(e) for e in ex]))


def drop_excluded(listing: DataFrame, excludes: Sequence[str]) -> DataFrame:
    """S3: drop files below any excluded folder (whole path segments).

    An excluded folder drops its whole subtree.  The exclude list is a request
    parameter (validated, bounded), so it travels as a literal array and the
    check is a per-row ``arrays_overlap`` with the file's ancestor folders: no
    shuffle and no join.  A trailing slash on an entry is ignored.
    """
    ex = _norm_excludes(excludes)
    if not ex:
        return listing
    ex_arr = F.array(*[F.lit(e) for e in ex])
    return listing.filter(~F.arrays_overlap(ancestor_dirs(F.col("path")), ex_arr))


def drop_excluded_table(listing: DataFrame, excludes: DataFrame) -> DataFrame:
    """S3 with the exclude folders as a table (column ``dir``).

    Ancestor folders are exploded and semi-joined with the excludes; the
    excluded paths are then anti-joined.  Anti-joining the exploded rows
    directly would be wrong: the other ancestors of an excluded file survive.
    """
    # An anti join (as for deletes S10/S11, hidden S14 and cleanup S15).
    ex = excludes.select(strip_trailing_slash(F.col("dir")).alias("dir")).distinct()
    anc = listing.select("path", F.explode(ancestor_dirs(F.col("path"))).alias("dir"))
    hit = anc.join(ex, "dir", "left_semi").select("path").distinct()
    return listing.join(hit, "path", "left_anti")


def classify_text(listing: DataFrame) -> DataFrame:
    """S7 + N3: add ``is_text`` (content indexed) and ``is_snippet_text``."""
    return listing.withColumn("is_text", is_index_text(F.col("name"))).withColumn(
        "is_snippet_text", is_snippet_text(F.col("name"))
    )


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """S6 + J4: files never indexed, or modified strictly after last indexing.

    Adds ``last_indexed`` (null when new) and ``reason`` ('new'/'changed').
    """
    m = manifest.select("path", "last_indexed")
    j = listing.join(m, "path", "left")
    return j.filter(F.col("last_indexed").isNull() | (F.col("mod_time") > F.col("last_indexed"))).withColumn(
        "reason", F.when(F.col("last_indexed").isNull(), F.lit("new")).otherwise(F.lit("changed"))
    )


def deleted_files(raw_listing: DataFrame, manifest: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Manifest paths under the listed roots that no longer exist.

    ``raw_listing`` must be the unfiltered listing: an excluded or newly
    hidden file still exists and keeps its documents.
    """
    under = None
    for r in roots:
        c = is_under(F.col("path"), F.lit(r))
        under = c if under is None else (under | c)
    m = manifest.select("path")
    if under is not None:
        m = m.filter(under)
    return m.join(raw_listing.select("path"), "path", "left_anti")


def manifest_lookup(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per listed path, whether the manifest has it and when indexed.

    Empty paths are rejected (dropped) as invalid keys.
    """
    m = manifest.filter(F.col("path") != "").select("path", "last_indexed")
    return (
        listing.filter(F.col("path") != "")
        .join(m, "path", "left")
        .withColumn("found", F.col("last_indexed").isNotNull())
    )


def change_set(raw_listing: DataFrame, manifest: DataFrame, root: str, excludes: Sequence[str] = ()) -> DataFrame:
    """S2-S6 + S14 in one pass: one full outer join of listing and manifest.

    Rows get ``status``: 'new' or 'changed' for visible, non-excluded files
    never indexed or modified after indexing; 'deleted' for manifest paths
    under ``root`` that the (unfiltered) listing no longer has; 'unreadable'
    for folders that could not be listed (``truly_deleted`` leaves out what lies
    below them).  Unchanged files are dropped.  Listed
    columns are kept (null for deleted rows).
    """
    r = root.rstrip("/") or "/"
    path = F.col("path")
    keep = ~F.col("is_dir") & is_under(path, F.lit(r)) & ~is_hidden_below(path, F.lit(r))
    ex = excluded(path, excludes)
    if ex is not None:
        keep = keep & ~ex
    listed = raw_listing.withColumn("_keep", keep).withColumn("_listed", F.lit(True))
    m = manifest.filter(is_under(path, F.lit(r))).select("path", "last_indexed")
    j = listed.join(m, "path", "full_outer")
    status = (
        F.when(F.col("_listed").isNull(), F.lit("deleted"))
        .when(F.col("_keep") & F.col("last_indexed").isNull(), F.lit("new"))
        .when(F.col("_keep") & (F.col("mod_time") > F.col("last_indexed")), F.lit("changed"))
    )
    if "error" in raw_listing.columns:
        status = F.when(F.col("is_dir") & F.col("error").isNotNull(), F.lit("unreadable")).otherwise(status)
    return j.withColumn("status", status).filter(F.col("status").isNotNull()).drop("_keep", "_listed")


def truly_deleted(changes: DataFrame) -> DataFrame:
    """Deleted paths of a written change set that lie below no unreadable folder."""
    gone = changes.filter(F.col("status") == "deleted").select("path")
    blind = changes.filter(F.col("status") == "unreadable").select(F.col("path").alias("dir"))
    hidden = gone.select("path", F.explode(ancestor_dirs(F.col("path"))).alias("dir")).join(blind, "dir", "left_semi")
    return gone.join(hidden.select("path").distinct(), "path", "left_anti")
