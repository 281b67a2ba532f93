"""File-tree sources.

Two loaders produce the listing contract (``quarry.schema.LISTING``):

- ``scan_binary``: Spark's ``binaryFile`` source with recursive lookup.
  Selecting no ``content`` prunes it from the scan, so the change check reads
  metadata only; ``length``/``modificationTime`` filters are pushed down.
  It skips names starting with '_' as well as '.', and follows links.
- ``scan_tree``: a Python data source that walks a tree mounted on every
  machine, split by folders of the level that has enough of them, without
  following linked folders and without dropping '_' names.  It lists metadata
  only, with an error row for each folder that cannot be listed; excluded and
  hidden folders may be left closed, so that what lies below is never listed;
  ``with_content`` then reads the rows that need it, in parallel tasks, and
  records per-file errors instead of failing the run.  For other file systems
  take ``scan_binary``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.paths import base_name

#: Error of a folder that was left closed on request.  As with any folder that was not
#: listed, nothing indexed below it counts as deleted.
CLOSED = "not opened: excluded or hidden"

TREE_SCHEMA = "path string, name string, is_dir boolean, size bigint, mod_time timestamp, error string"


def scan_binary(spark: SparkSession, root: str, with_bytes: bool = False) -> DataFrame:
    """Listing via ``binaryFile``; metadata only unless ``with_bytes``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), r"^file:(//)?", "")
    return raw.select(
        path.alias("path"),
        base_name(path).alias("name"),
        F.lit(False).alias("is_dir"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mod_time"),
        *([F.col("content")] if with_bytes else []),
    )


class _TreePartition(InputPartition):
    def __init__(self, folders: list[str], recurse: bool):
        super().__init__(folders)
        self.folders = folders
        self.recurse = recurse


class _TreeReader(DataSourceReader):
    """Folders are opened level by level until there are ``splits`` of them.

    What was opened on the way is listed without its sub-folders; the folders
    of the last level are walked whole, each in a partition of its own.  A
    folder that cannot be listed gives a row with ``error``; a root that cannot
    be listed fails the scan.  A folder in ``excludes`` (a JSON list), or a hidden
    one with ``skip_hidden``, gives such a row too and is opened neither here nor
    in a task.
    """

    def __init__(self, options):
        self.root = os.path.normpath(options["path"])
        self.splits = int(options.get("splits", 64))
        self.depth = int(options.get("depth", 4))
        self.excludes = {os.path.normpath(e) for e in json.loads(options.get("excludes", "[]"))}
        self.skip_hidden = options.get("skip_hidden", "false") == "true"

    def _closed(self, folder):
        if folder in self.excludes:
            return True
        return self.skip_hidden and folder != self.root and os.path.basename(folder).startswith(".")

    @staticmethod
    def _folders(top):
        with os.scandir(top) as it:
            return sorted(e.path for e in it if e.is_dir(follow_symlinks=False))

    def partitions(self):
        opened, level = [self.root], [] if self._closed(self.root) else self._folders(self.root)
        for _ in range(self.depth):
            if not level or len(level) >= self.splits:
                break
            below = []
            for folder in level:
                if self._closed(folder):
                    continue
                try:
                    below += self._folders(folder)
                except OSError:
                    pass  # read() meets the same folder and reports it
            opened += level
            level = below
        return [_TreePartition(opened, False)] + [_TreePartition([f], True) for f in level]

    @staticmethod
    def _row(path, is_dir):
        try:
            st = os.stat(path, follow_symlinks=False)
        except OSError as ex:
            return (path, os.path.basename(path), is_dir, None, None, str(ex))
        mtime = datetime.fromtimestamp(st.st_mtime, tz=timezone.utc)
        return (path, os.path.basename(path), is_dir, int(st.st_size), mtime, None)

    def read(self, partition):
        pending = list(reversed(partition.folders))
        while pending:
            folder = pending.pop()
            row = self._row(folder, True)
            if self._closed(folder):
                if folder != self.root:
                    yield (*row[:5], CLOSED)
                continue
            try:
                with os.scandir(folder) as it:
                    entries = sorted((e.path, e.is_dir(follow_symlinks=False)) for e in it)
            except OSError as ex:
                if folder == self.root:
                    raise
                yield (*row[:5], str(ex))
                continue
            if folder != self.root:
                yield row
            for path, is_dir in entries:
                if not is_dir:
                    yield self._row(path, False)
                elif partition.recurse:
                    pending.append(path)


class FileTreeSource(DataSource):
    @classmethod
    def name(cls):
        return "quarry_tree"

    def schema(self):
        return TREE_SCHEMA

    def reader(self, schema):
        return _TreeReader(self.options)


def scan_tree(spark: SparkSession, root: str, excludes: Sequence[str] = (), skip_hidden: bool = False) -> DataFrame:
    """Metadata listing of every entry under ``root`` (files and folders).

    Nothing below an ``excludes`` folder, or with ``skip_hidden`` below a folder whose
    name begins with a dot, is listed; such a folder has a row with error ``CLOSED``.
    An excluded root gives no rows.
    """
    spark.dataSource.register(FileTreeSource)
    read = spark.read.format(FileTreeSource.name()).option("path", root)
    return read.option("excludes", json.dumps(list(excludes))).option("skip_hidden", str(skip_hidden).lower()).load()


#: Bytes of file content that a task holds before it passes them on.
HELD_BYTES = 32 * 1024 * 1024


def _read_capped(cap: int | None):
    def read(path, want, error):
        if error is not None or not want:
            return None, error
        try:
            with open(path, "rb") as fh:
                return fh.read(-1 if cap is None else cap), None
        except OSError as ex:
            return None, str(ex)

    def fn(batches):
        for pdf in batches:
            rest = pdf.drop(columns=["_want"])
            contents, errors, start, held = [], [], 0, 0
            for at, (path, want, error) in enumerate(zip(pdf["path"], pdf["_want"], pdf["error"]), 1):
                content, error = read(path, want, error)
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held >= HELD_BYTES or at == len(pdf):
                    yield rest.iloc[start:at].assign(content=contents, error=errors)
                    contents, errors, start, held = [], [], at, 0

    return fn


def with_content(listing: DataFrame, want, cap: int | None = None) -> DataFrame:
    """Read each file where ``want`` holds (S8); with ``cap``, its first bytes.

    A file that cannot be read gets ``error`` set and no content; downstream
    it is neither indexed nor recorded, so the next run retries it (S20).
    """
    cols = [c for c in listing.columns if c != "content"]
    src = listing.select(*cols, want.alias("_want"))
    out_schema = ", ".join(
        [f"{f.name} {f.dataType.simpleString()}" for f in listing.select(*cols).schema.fields] + ["content binary"]
    )
    return src.mapInPandas(_read_capped(cap), out_schema)


__all__ = ["CLOSED", "scan_binary", "scan_tree", "with_content", "FileTreeSource"]
