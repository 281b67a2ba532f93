"""Index build plans.

``build_index`` derives every index table from a documents DataFrame as one
lazy plan (used for in-memory searches and by the store when it publishes a
version).  ``corpus_documents`` turns a listing into the documents to index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quarry.config import IndexConfig
from quarry.operators.analysis import build_blocks, build_term_stats, posting_rows
from quarry.operators.extract import assemble_documents
from quarry.operators.listing import drop_excluded, visible_files
from quarry.operators.match import IndexTables


def listing_documents(
    listing: DataFrame, root: str, excludes: Sequence[str] = (), config: IndexConfig = IndexConfig()
) -> DataFrame:
    """S2-S4 + S8-S9: the documents a full build of ``root`` indexes."""
    files = drop_excluded(visible_files(listing, root), excludes)
    return assemble_documents(files, config.content_cap_bytes)


def build_index(documents: DataFrame, config: IndexConfig = IndexConfig(), n_docs: int | None = None) -> IndexTables:
    blocks = build_blocks(documents, config.term_buckets)
    postings = posting_rows(blocks)
    term_stats = build_term_stats(blocks)
    if n_docs is None:
        n_docs = documents.select("id").count()
    return IndexTables(
        documents=documents,
        postings=postings,
        term_stats=term_stats,
        n_docs=n_docs,
        term_buckets=config.term_buckets,
    )
