"""Fixed values and tunables.

The constants under "fixed values" must keep these exact values for results
to agree with the behaviour this engine reproduces.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
BOOST_CONTENT = 3.0
BOOST_NAME = 2.0
BOOST_PATH = 1.0
BOOST_QUOTED_PHRASE = 6.0
BOOST_REGULAR_PHRASE = 5.0
BOOST_PREFIX = 1.5

CONTENT_CAP_BYTES = 5 * 1024 * 1024  # an optional bound on the bytes of a file read for indexing
SNIPPET_CONTEXT = 100  # characters (or bytes) on each side of the match
PREFIX_MIN_BYTES = 3  # prefix clauses need a term of more than 2 bytes

DEFAULT_PER_PAGE = 20
MAX_PER_PAGE = 20
MAX_QUERY_CHARS = 1000

# run progress steps
PROGRESS_STEP_LISTED = 10
PROGRESS_STEP_CLEANED = 20
PROGRESS_COMPLETE = 100
PROGRESS_FAILED = -1

# Extensions whose content is read and indexed (lower-case, without the dot).
INDEX_TEXT_EXTENSIONS = (
    "txt", "md", "go", "js", "py", "java", "cpp", "c", "html", "css", "json", "xml", "yaml", "yml",
    "ini", "conf", "doc", "xlsx", "docx", "pptx", "csv", "tsv", "sql", "pdf", "cs",
)

# Extensions that get a snippet (lower-case, without the dot).
SNIPPET_TEXT_EXTENSIONS = (
    "txt", "md", "go", "js", "py", "java", "cpp", "c", "h", "css", "html", "htm", "xml", "json",
    "yaml", "yml", "sh", "bash", "zsh", "fish", "sql", "log", "conf", "cfg", "ini", "toml", "rs",
    "rb", "php", "pl", "swift", "kt", "scala", "clj", "hs", "ml", "elm", "r", "m", "tex",
    "dockerfile", "makefile", "cmake", "gradle", "maven", "sbt", "lock", "env", "gitignore",
    "gitattributes", "editorconfig", "prettierrc", "eslintrc", "babelrc", "nvmrc", "nodeversion",
)

# Extensions with a text/* media type in the built-in media table, used as
# the fallback of the snippet classification.
TEXT_MEDIA_EXTENSIONS = (
    "css", "htm", "html", "js", "mjs", "xml",
)

# Size units for display, base 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB")


@dataclass(frozen=True)
class SearchConfig:
    """Knobs of the search plan.

    phrase_mode: ``as_built`` runs each quoted-phrase clause on the whole
    normalised query (quotes and other words included); ``per_phrase`` runs it
    on the phrase itself.
    broadcast_max_rows: upper bound on rows of a query-side table that may be
    broadcast (about 20 MB); larger query batches use shuffle joins.
    Scores are kept as 32-bit floats (7 significant digits at any size) before
    ranking, so that the order does not depend on summation order.
    """

    phrase_mode: str = "as_built"
    blank_matches_all: bool = False
    broadcast_max_rows: int = 100_000
    snippet_context: int = SNIPPET_CONTEXT
    # What the context is counted in, "chars" or "bytes" (UTF-8).
    snippet_unit: str = "chars"
    # Parts that a query's matches are dealt into; None: as many as the
    # session has shuffle partitions.
    ranking_splits: int | None = None
    # Q5: with ``blank_matches_all`` a blank query is valid and matches every
    # document with a constant score (ranked by path).  Off by default, as
    # validation rejects blank queries before they reach the index.


@dataclass(frozen=True)
class IndexConfig:
    """Knobs of the index build.

    term_buckets: number of hash buckets postings and term statistics are
    partitioned by on disk; a query batch reads only the buckets of its terms.
    doc_buckets: hash buckets of the documents table, so that fetching the
    page hits reads only their buckets.
    content_cap_bytes: bytes of each file that are indexed; None, the default,
    indexes whole files.
    max_segments: ``IndexStore.maintain`` merges the segments after the first
    into one when there are more than this.
    """

    term_buckets: int = 16
    doc_buckets: int = 8
    content_cap_bytes: int | None = None
    max_segments: int = 8
