"""Ranking, paging and page details.

Per query the hits are ordered by score (with 7 significant digits, so the
order does not depend on summation order), ties by path.

Matches carry a ``split``, a hash of their document below a fixed number, and
are partitioned by (query, split).  In the partitions that the score tree left,
every (query, split) keeps its best rows down to the end of the query's page,
with its number of matches and best score; only those, at most splits x page
end rows of a query, are kept and ranked.  Totals are sums over splits.  So one
way serves pages at any depth, matches are shuffled once, no table of all
(query, match) rows is kept, and a query that matches everything is spread over
as many tasks as there are splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of(doc_id: Column, splits: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(splits)).cast("int")


def rank_matches(matches: DataFrame) -> DataFrame:
    """Scores with 7 significant digits: a 32-bit float has them at any size."""
    return matches.withColumn("score", F.col("score").cast("float").cast("double"))


def best_of_splits(ranked: DataFrame, prepared: DataFrame, broadcast_ok: bool = True) -> DataFrame:
    """The rows of each (query, split) that may be on the query's page.

    Adds n_split and best_split, the matches and the best score of the whole
    split, and rn, the row's place in it; the first row of a split is always
    kept.  ``prepared`` has one row per query, with its page.
    """
    group = Window.partitionBy("query_id", "split")
    place = F.row_number().over(group.orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    ends = prepared.select("query_id", (F.col("page").cast("long") * F.col("per_page").cast("long")).alias("end"))
    return (
        ranked.withColumns(
            {"rn": place, "n_split": F.count(F.lit(1)).over(group), "best_split": F.max("score").over(group)}
        )
        .join(F.broadcast(ends) if broadcast_ok else ends, "query_id")
        .filter((F.col("rn") == 1) | (F.col("rn") <= F.col("end")))
        .drop("end")
    )


def totals(best: DataFrame) -> DataFrame:
    """Total hits and best score per query, over all matches."""
    return best.filter("rn = 1").groupBy("query_id").agg(
        F.sum("n_split").alias("total_results"), F.max("best_split").alias("max_score")
    )


def ranked_rows(best: DataFrame) -> DataFrame:
    """The rank of rows that are their query's best (1 = best); exact down to the page's end."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return best.drop("split", "rn", "n_split", "best_split").withColumn("rank", F.row_number().over(w).cast("long"))


def page_rows(top: DataFrame, prepared: DataFrame, broadcast_ok: bool = True) -> DataFrame:
    """Keep each query's own page: offset = (page-1)*per_page.

    ``prepared`` has one row per query; it is broadcast when the caller has
    checked the batch size.
    """
    p = prepared.select("query_id", "per_page", "page")
    p = F.broadcast(p) if broadcast_ok else p
    lo = (F.col("page").cast("long") - 1) * F.col("per_page").cast("long")
    return top.join(p, "query_id").filter((F.col("rank") > lo) & (F.col("rank") <= lo + F.col("per_page")))


def page_details(prepared: DataFrame, tot: DataFrame) -> DataFrame:
    """Current page, page size, total pages (at least 1), next/prev."""
    j = prepared.select("query_id", "per_page", "page").join(tot, "query_id", "left")
    total = F.coalesce(F.col("total_results"), F.lit(0)).cast("bigint")
    offset = (F.col("page").cast("long") - 1) * F.col("per_page").cast("long")
    current = (F.floor(offset / F.col("per_page")) + 1).cast("bigint")
    pages = F.greatest(F.ceil(total / F.col("per_page")), F.lit(1)).cast("bigint")
    return j.select(
        "query_id",
        total.alias("total_results"),
        F.coalesce(F.col("max_score"), F.lit(0.0)).alias("max_score"),
        current.alias("current_page"),
        F.col("per_page").alias("page_size"),
        pages.alias("total_pages"),
        (current < pages).alias("has_next_page"),
        (current > 1).alias("has_prev_page"),
    )
