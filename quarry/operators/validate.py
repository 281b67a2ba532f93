"""Request validation over whole tables (Q15-Q18, Q20).

Rows are never dropped silently: each gets an ``error`` column (null when
valid) holding the reason of the first failing rule.  Rules are checked in
field order and, per field, custom rules first, then required, then range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import MAX_PER_PAGE, MAX_QUERY_CHARS
from quarry.functions.paths import ancestor_dirs, strip_trailing_slash
from quarry.functions.text import trim_ws
from quarry.operators.parse import apply_defaults

# Error texts.
ERR_REQUIRED = "missing required field '{}'"
ERR_RANGE = "value or length of field '{}' is not in the expected range"
ERR_QUERY = "invalid query"
ERR_PATH = "invalid path"
ERR_EXCLUDES = "invalid exclude path(s)"
ERR_EXCLUDE_IS_ROOT = "path to exclude cannot be the same as index path"
ERR_EXCLUDE_OUTSIDE = "path to exclude must begin with the index path"

# Requested paths up to this many are broadcast for the existence check.
BROADCAST_WANTED_ROWS = 100_000


def _first(*pairs: tuple[Column, str]) -> Column:
    out = None
    for cond, msg in pairs:
        out = F.when(cond, F.lit(msg)) if out is None else out.when(cond, F.lit(msg))
    return out.otherwise(F.lit(None).cast("string"))


def validate_queries(queries: DataFrame, allow_blank: bool = False) -> DataFrame:
    """Q14 + Q15: defaults, then (query, per_page, page) rules.

    Adds ``error``; per_page and page carry their defaulted values.
    ``allow_blank`` lets blank queries through (match-all mode, Q5).
    """
    d = apply_defaults(queries)
    q = F.coalesce(F.col("query"), F.lit(""))
    no = F.lit(False)
    return d.withColumn(
        "error",
        _first(
            (no if allow_blank else (q == ""), ERR_REQUIRED.format("query")),
            (no if allow_blank else (trim_ws(q) == ""), ERR_QUERY),
            (F.char_length(q) > MAX_QUERY_CHARS, ERR_RANGE.format("query")),
            ((F.col("per_page") < 0) | (F.col("per_page") > MAX_PER_PAGE), ERR_RANGE.format("per_page")),
            (F.col("page") < 0, ERR_RANGE.format("page")),
        ),
    )


def path_syntax_ok(p: Column) -> Column:
    """Q16 without existence: '' is allowed; else not blank, no NUL, absolute."""
    return (p == "") | ((trim_ws(p) != "") & ~F.instr(p, "\x00").cast("boolean") & p.startswith("/"))


def existing_paths(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which of the ``wanted`` paths exist: a listed file or a folder above one.

    Each file's own path and ancestor folders are produced per row and
    semi-joined with the (small, broadcast) set of wanted paths before any
    shuffle; the distinct then only sees matches.
    """
    cand = listing.select(F.explode(F.array_union(F.array(F.col("path")), ancestor_dirs(F.col("path")))).alias("path"))
    w = wanted.select("path").distinct()
    if w.count() <= BROADCAST_WANTED_ROWS:
        w = F.broadcast(w)
    return cand.join(w, "path", "left_semi").distinct()


def parse_exclude_text(text: Column) -> Column:
    """Q18: comma-separated text -> trimmed, non-blank entries."""
    return F.filter(F.transform(F.split(text, ","), trim_ws), lambda x: x != F.lit(""))


def validate_index_requests(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """Q16 + Q17 over ``requests(request_id, path, excludes ARRAY<STRING>)``.

    Existence is a semi-join against the listed files and their folders
    (exploded requests are small, the listing side is the big one).
    """
    req = requests.withColumn("excludes", F.coalesce(F.col("excludes"), F.array().cast("array<string>")))
    wanted = req.select("path").unionByName(req.select(F.explode("excludes").alias("path")))
    ex = existing_paths(listing, wanted.select(strip_trailing_slash(F.col("path")).alias("path")))
    ex = ex.withColumnRenamed("path", "bare")
    root_ok = req.select("request_id", strip_trailing_slash(F.col("path")).alias("bare")).join(
        ex.withColumn("root_exists", F.lit(True)), "bare", "left"
    )
    items = req.select("request_id", "path", F.posexplode("excludes").alias("i", "ex"))
    items = items.withColumn("bare", strip_trailing_slash(F.col("ex"))).join(
        ex.withColumn("ex_exists", F.lit(True)), "bare", "left"
    ).select(
        "request_id",
        "i",
        (path_syntax_ok(F.col("ex")) & ((F.col("ex") == "") | F.col("ex_exists").isNotNull())).alias("ok"),
        F.when(F.col("ex") == F.col("path"), F.lit(ERR_EXCLUDE_IS_ROOT))
        .when(~F.col("ex").startswith(F.col("path")), F.lit(ERR_EXCLUDE_OUTSIDE))
        .alias("sem_err"),
    )
    flags = items.groupBy("request_id").agg(
        F.bool_and("ok").alias("all_ok"),
        F.min_by("sem_err", F.when(F.col("sem_err").isNotNull(), F.col("i"))).alias("sem_err"),
    )
    j = req.join(root_ok.select("request_id", "root_exists"), "request_id", "left").join(flags, "request_id", "left")
    p = F.coalesce(F.col("path"), F.lit(""))
    path_ok = path_syntax_ok(p) & F.col("root_exists").isNotNull()
    return j.select(
        "request_id",
        "path",
        "excludes",
        _first(
            (p == "", ERR_REQUIRED.format("path")),
            (~path_ok, ERR_PATH),
            (~F.coalesce(F.col("all_ok"), F.lit(True)), ERR_EXCLUDES),
        ).alias("error0"),
        "sem_err",
    ).select(
        "request_id", "path", "excludes", F.coalesce(F.col("error0"), F.col("sem_err")).alias("error")
    )
