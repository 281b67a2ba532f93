"""Views that turn the given test tables into file listings.

A listing has the schema of a file scan (``quarry.schema.LISTING``); the
corpus views derive one from a text table so that the whole indexing and
search stack can run over it.

``files``: every ``documents`` row as a file

- extension by ``doc_id % 6``: .txt .md .py .csv .rs .png
  (four indexed types, one with a snippet only, one with neither);
- name ``doc<doc_id><ext>``, hidden (leading '.') when ``doc_id % 37 = 0``;
- path ``/corpus/<source>/<lang>/<name>``, inside a hidden ``.cache`` folder
  when ``doc_id % 41 = 0``;
- size is the UTF-8 length of the text; mod_time is 2024-01-01 00:00 UTC
  plus ``doc_id`` minutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_ROOT = "/corpus"
PAGES_ROOT = "/pages"
CONVERSATIONS_ROOT = "/conversations"

# Fixed values of the corpus view.
FILE_EXTENSIONS = (".txt", ".md", ".py", ".csv", ".rs", ".png")
TEXT_EXTENSIONS = (".txt", ".md", ".py", ".csv")
EDITED_AT = 1893456000  # 2030-01-01 00:00:00 UTC, seconds
EDIT_TEXT = " revised under the apache license"
HIDDEN_FILE_MOD = 37
HIDDEN_DIR_MOD = 41
EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC, seconds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod_time(doc_id: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_2024) + doc_id * F.lit(60))


def files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of the ``documents`` table as files under ``/corpus``.

    Columns: path, name, is_dir, size, mod_time, content (STRING),
    plus doc_id, source, lang kept for derived test views.
    """
    d = read_table(spark, sf_dir, "documents")
    exts = F.array(*[F.lit(e) for e in FILE_EXTENSIONS])
    ext = F.element_at(exts, (F.col("doc_id") % len(FILE_EXTENSIONS) + 1).cast("int"))
    name = F.concat(
        F.when(F.col("doc_id") % HIDDEN_FILE_MOD == 0, F.lit(".")).otherwise(F.lit("")),
        F.lit("doc"),
        F.col("doc_id").cast("string"),
        ext,
    )
    folder = F.when(F.col("doc_id") % HIDDEN_DIR_MOD == 0, F.lit(".cache/")).otherwise(F.lit(""))
    return d.select(
        F.concat(
            F.lit(CORPUS_ROOT + "/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), folder, name
        ).alias("path"),
        name.alias("name"),
        F.lit(False).alias("is_dir"),
        F.octet_length("text").cast("bigint").alias("size"),
        _mod_time(F.col("doc_id")).alias("mod_time"),
        F.col("text").alias("content"),
        "doc_id",
        "source",
        "lang",
    )


def texts_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row as a visible file of an indexed type.

    ``/corpus/<source>/<lang>/doc<doc_id><ext>`` with the indexed extensions
    of ``FILE_EXTENSIONS`` in turn: the view that the index and search rows read.
    """
    d = read_table(spark, sf_dir, "documents")
    exts = F.array(*[F.lit(e) for e in TEXT_EXTENSIONS])
    ext = F.element_at(exts, (F.col("doc_id") % len(TEXT_EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext)
    return d.select(
        F.concat(F.lit(CORPUS_ROOT + "/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.lit(False).alias("is_dir"),
        F.octet_length("text").cast("bigint").alias("size"),
        _mod_time(F.col("doc_id")).alias("mod_time"),
        F.col("text").alias("content"),
        "doc_id",
    )


def edited_listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree of ``texts_listing`` at three times.

    First without every third document, and with a file ``/corpus/gone/<id>.txt``
    for every fiftieth; then whole, with every fifth document edited; last
    without the gone files.
    """
    now = texts_listing(spark, sf_dir)
    gone = now.filter(F.col("doc_id") % 50 == 0).withColumns(
        {
            "name": F.concat(F.col("doc_id").cast("string"), F.lit(".txt")),
            "path": F.concat(F.lit(CORPUS_ROOT + "/gone/"), F.col("doc_id").cast("string"), F.lit(".txt")),
        }
    )
    edited = F.col("doc_id") % 5 == 0
    last = now.withColumns(
        {
            "mod_time": F.when(edited, F.timestamp_seconds(F.lit(EDITED_AT))).otherwise(F.col("mod_time")),
            "content": F.when(edited, F.concat("content", F.lit(EDIT_TEXT))).otherwise(F.col("content")),
            "size": F.when(edited, F.col("size") + len(EDIT_TEXT)).otherwise(F.col("size")),
        }
    )
    return now.filter(F.col("doc_id") % 3 != 0).unionByName(gone), last.unionByName(gone), last


def pages_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of ``pages``: ``/pages/<page_id>.html`` holding the raw HTML."""
    p = read_table(spark, sf_dir, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html"))
    return p.select(
        F.concat(F.lit(PAGES_ROOT + "/"), name).alias("path"),
        name.alias("name"),
        F.lit(False).alias("is_dir"),
        F.octet_length("html").cast("bigint").alias("size"),
        _mod_time(F.col("page_id")).alias("mod_time"),
        F.col("html").alias("content"),
    )


def conversations_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of ``conversations``: ``/conversations/<conv_id>/<turn>.txt``."""
    c = read_table(spark, sf_dir, "conversations")
    name = F.concat(F.col("turn").cast("string"), F.lit(".txt"))
    return c.select(
        F.concat(F.lit(CONVERSATIONS_ROOT + "/"), F.col("conv_id").cast("string"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.lit(False).alias("is_dir"),
        F.octet_length("text").cast("bigint").alias("size"),
        _mod_time(F.col("conv_id") * 100 + F.col("turn")).alias("mod_time"),
        F.col("text").alias("content"),
    )


def derived_manifest(files: DataFrame) -> DataFrame:
    """A manifest as an earlier run would have left it.

    Files with ``doc_id % 3 <> 0`` were indexed; those with ``doc_id % 5 = 0``
    changed one minute after; ``/corpus/gone/<doc_id>.txt`` for
    ``doc_id % 50 = 0`` were indexed and have since been deleted.
    """
    kept = files.filter(F.col("doc_id") % 3 != 0).select(
        "path",
        F.when(F.col("doc_id") % 5 == 0, F.col("mod_time") - F.expr("INTERVAL 1 MINUTE"))
        .otherwise(F.col("mod_time"))
        .alias("last_indexed"),
    )
    gone = files.filter(F.col("doc_id") % 50 == 0).select(
        F.concat(F.lit(CORPUS_ROOT + "/gone/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("mod_time").alias("last_indexed"),
    )
    return kept.unionByName(gone)


# Exclude folders used with the corpus view: src7 must not drop src17, and
# src1 must keep src10..src19.
CORPUS_EXCLUDES = ("/corpus/src7", "/corpus/src1")
