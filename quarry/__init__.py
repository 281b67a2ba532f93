"""quarry: a Spark-native file and document search engine.

Indexing and search are plain DataFrame jobs: a listing becomes documents,
documents become postings and statistics, and a table of queries becomes a
table of ranked, paged hits with snippets.
"""

from quarry.config import SearchConfig

__all__ = ["SearchConfig"]
