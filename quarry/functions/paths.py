"""Column expressions over file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import (
    INDEX_TEXT_EXTENSIONS,
    SNIPPET_TEXT_EXTENSIONS,
    TEXT_MEDIA_EXTENSIONS,
)


def extension(name: Column) -> Column:
    """Lower-cased last extension without the dot ('' when there is none).

    As for a path's last element: ``.gitignore`` has extension ``gitignore``.
    """
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def strip_trailing_slash(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=.)/+$", "")


def is_index_text(name: Column) -> Column:
    """Content of these files is read and indexed."""
    return extension(name).isin(*INDEX_TEXT_EXTENSIONS)


def is_snippet_text(name: Column) -> Column:
    """Files that get a snippet (list, then text/* media fallback)."""
    return extension(name).isin(*(SNIPPET_TEXT_EXTENSIONS + TEXT_MEDIA_EXTENSIONS))


def is_hidden_below(path: Column, root: Column) -> Column:
    """Some folder or the file below ``root`` starts with '.'.

    Relative to the root, so a root whose own name starts with '.' is fine.
    """
    rel = F.substring(path, F.length(root) + 1, 1 << 30)
    return rel.rlike(r"/\.")


def is_under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or lies below it, on whole path segments."""
    r = strip_trailing_slash(root)
    return (path == r) | path.startswith(F.concat(r, F.lit("/"))) | (r == F.lit("/"))


def ancestor_dirs(path: Column) -> Column:
    """ARRAY<STRING> of every folder above ``path`` ('/a/b/f' -> ['/', '/a', '/a/b'])."""
    parts = F.split(path, "/")
    below = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")),
    )
    return F.when(path.startswith("/"), below).otherwise(F.array().cast("array<string>"))
