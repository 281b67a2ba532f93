"""Search plan: queries table x index -> ranked, paged hits with snippets.

``search(queries, index)`` is one declarative plan per output table:

    queries -> validate/defaults (Q14, Q15) -> compile (Q1-Q11, Q21)
      -> term leaves (J1, J3) + phrase matches (J2) -> score tree (R2)
      -> rank, totals, pages (R3-R6) -> late document fetch (J6)
      -> snippets (N1-N5) -> hits

A single search is a one-row queries table.  Collected are counts (of queries,
phrase tokens and leaves, to bound broadcasts), the deepest page end, and the
buckets, terms and page ids that become scan filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.functions.format import iso_utc
from quarry.functions.text import raw_tokens
from quarry.operators import match as M
from quarry.operators import rank as R
from quarry.operators.parse import compile_queries, persist_compiled
from quarry.operators.snippet import snippet
from quarry.operators.validate import validate_queries


# Page ids up to this many are pushed to the documents scan as a filter.
PUSHED_ID_LIMIT = 10_000


@dataclass
class SearchResult:
    hits: DataFrame  # query_id, rank, id, path, name, score, size, mod_time, snippet
    pages: DataFrame  # query_id, total_results, max_score, current_page, ...
    # query_id, doc_id, score: all scored matches, unpaged (a blank query in
    # match-all mode matches every document; those pairs are not listed)
    matches: DataFrame
    rejected: DataFrame  # query_id, query, error
    cached: tuple = ()

    def unpersist(self) -> None:
        """Release the cached intermediate tables of this search."""
        for df in self.cached:
            df.unpersist()


def match_queries(queries: DataFrame, index: M.IndexTables, config: SearchConfig = SearchConfig()):
    """Validated queries -> (compiled, matches(query_id, doc_id, score, loc))."""
    checked = validate_queries(queries, allow_blank=config.blank_matches_all)
    valid = checked.filter(F.col("error").isNull()).drop("error")
    cq = persist_compiled(compile_queries(valid, config.phrase_mode))
    facts = M.batch_facts(cq, index)
    n_queries, max_end = max(1, facts.n_queries), facts.max_end
    index = M.pruned_index(index, facts)
    leaves = M.term_leaves(cq, index, n_queries, config.broadcast_max_rows).persist()
    # Exact leaves are bounded by the query text; prefix expansions by the
    # vocabulary, so count them before deciding to broadcast.
    n_leaves_bound = leaves.count()
    splits = ranking_splits(queries, config)
    children = M.term_child_scores(leaves, index, n_leaves_bound, config.broadcast_max_rows, splits)
    kept = [leaves]
    if facts.phrase_tokens:
        toks = M.phrase_tokens(cq, index, facts.phrase_tokens, config.broadcast_max_rows).persist()
        kept.append(toks)
        children = children.unionByName(
            M.phrase_child_scores(toks, index, facts.phrase_tokens, config.broadcast_max_rows, splits)
        )
    # Branches of a union may be partitioned apart; this costs no shuffle where there is one branch.
    matches = M.score_matches(children.repartition("query_id", "split") if facts.phrase_tokens else children)
    return checked, cq, matches, n_queries, max_end, kept


def ranking_splits(queries: DataFrame, config: SearchConfig) -> int:
    return config.ranking_splits or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def match_all(cq, index: M.IndexTables, max_end: int, max_rows: int, splits: int):
    """Q5: blank queries match every document with the constant score 1.0.

    Equal scores are ranked by id, so every blank query shares one ranking of
    the documents, taken like that of any query: the best of each split, then
    of all, down to the deepest page.  Each blank query asks for the ranks of
    its own page (at most ``per_page`` of them), joined to that ranking on the
    rank: no query x document pairs are formed.  Totals are the document count.
    Returns (page rows, totals).
    """
    blank = cq.prepared.filter(F.col("q") == "").select("query_id", "per_page", "page")
    lo = (F.col("page").cast("long") - 1) * F.col("per_page").cast("long")
    wanted = blank.select(
        "query_id", "per_page", "page",
        F.explode(F.sequence(lo + 1, lo + F.col("per_page").cast("long"))).alias("rank"),
    )
    spark = cq.prepared.sparkSession
    everyone = spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(1).alias("page"), F.lit(max_end).alias("per_page"))
    ids = index.documents.select(
        F.lit(0).cast("long").alias("query_id"), R.split_of(F.col("id"), splits).alias("split"), F.col("id").alias("doc_id"), F.lit(1.0).alias("score")
    ).repartition("query_id", "split")
    ranked = R.ranked_rows(R.best_of_splits(ids, everyone)).filter(F.col("rank") <= F.lit(max_end)).drop("query_id", "score")
    page = wanted.join(M.bounded_broadcast(ranked, max_end, max_rows), "rank").select(
        "query_id",
        "doc_id",
        F.lit(1.0).alias("score"),
        F.col("rank").cast("bigint").alias("rank"),
        F.lit(None).cast("int").alias("loc"),
        "per_page",
        "page",
    )
    tot = blank.select(
        "query_id",
        F.lit(index.n_docs).cast("bigint").alias("total_results"),
        F.lit(1.0 if index.n_docs > 0 else None).cast("double").alias("max_score"),
    )
    return page, tot


def search(queries: DataFrame, index: M.IndexTables, config: SearchConfig = SearchConfig()) -> SearchResult:
    checked, cq, matches, n_queries, max_end, kept = match_queries(queries, index, config)
    # Hits and page details both read the best rows of each split: at most
    # splits x page end rows of a query, with what totals need.
    ranked = R.rank_matches(matches)
    few_queries = n_queries <= config.broadcast_max_rows
    best = R.best_of_splits(ranked, cq.prepared, few_queries).persist(StorageLevel.MEMORY_AND_DISK)
    tot = R.totals(best)
    page = R.page_rows(R.ranked_rows(best), cq.prepared, few_queries)
    if config.blank_matches_all:
        splits = ranking_splits(queries, config)
        blank_page, blank_tot = match_all(cq, index, max_end, config.broadcast_max_rows, splits)
        page = page.select(*blank_page.columns).unionByName(blank_page)
        tot = tot.unionByName(blank_tot)
    pages = R.page_details(cq.prepared, tot)
    docs = index.documents
    cached = [best, cq.prepared, cq.groups, cq.phrases, *kept]
    if index.doc_buckets > 0 and "db" in docs.columns:
        # Documents are partitioned by an id-hash bucket: read only the
        # buckets of this batch's page rows (at most doc_buckets integers).
        page = page.persist()
        cached.append(page)
        # When the page ids are few, they also go down as a pushed filter:
        # documents are sorted by id inside each bucket, so row-group
        # statistics skip most of a bucket.
        db = F.pmod(F.xxhash64("doc_id"), F.lit(index.doc_buckets)).cast("int")
        rows = page.select(db.alias("db"), "doc_id").distinct().limit(PUSHED_ID_LIMIT + 1).collect()
        if len(rows) <= PUSHED_ID_LIMIT:
            dbs = sorted({int(r["db"]) for r in rows})
            ids = sorted({r["doc_id"] for r in rows})
            docs = docs.filter(F.col("db").isin(*dbs) & F.col("id").isin(*ids)) if ids else docs.filter(F.lit(False))
        else:
            dbs = [int(r[0]) for r in page.select(db).distinct().collect()]
            docs = docs.filter(F.col("db").isin(*dbs))
    docs = docs.select(F.col("id").alias("doc_id"), "path", "name", "size", "mod_time", "content")
    # The page rows are at most n_queries * 20; broadcast them and fetch
    # only their documents.
    fetched = M.bounded_broadcast(page, 20 * n_queries, config.broadcast_max_rows).join(docs, "doc_id")
    # The matched term is the token at the earliest matched position of
    # the indexed text (tokenised again for page hits only).
    fetched = fetched.withColumn(
        "loc_term", F.try_element_at(raw_tokens(F.coalesce(F.col("content"), F.lit(""))), F.col("loc") + 1)
    )
    # Q13: result projection (path, name, size, mod_time, score, id).
    hits = fetched.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        F.col("doc_id").alias("id"),
        "path",
        "name",
        "score",
        "size",
        iso_utc(F.col("mod_time")).alias("mod_time"),
        snippet(F.col("content"), F.col("name"), F.col("loc_term"), config.snippet_context, config.snippet_unit).alias("snippet"),
    )
    rejected = checked.filter(F.col("error").isNotNull()).select("query_id", "query", "error")
    return SearchResult(
        hits=hits,
        pages=pages,
        matches=ranked.select("query_id", "doc_id", "score"),
        rejected=rejected,
        cached=tuple(cached),
    )
