"""Ranking by the best rows of splits under skew, against one window over all matches."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import rank as R


def _skewed(spark, n=6000):
    # Query 0 holds a third of all rows; scores repeat, so ties are broken by
    # doc_id.
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).cast("long").alias("query_id"),
        F.format_string("doc%06d", F.col("id")).alias("doc_id"),
        ((F.col("id") * 7919) % 97 / F.lit(10.0)).alias("score"),
        F.lit(None).cast("int").alias("loc"),
    )


def _prepared(spark, page, per_page):
    return spark.range(51).select(F.col("id").alias("query_id"), F.lit(page).alias("page"), F.lit(per_page).alias("per_page"))


def _best(ranked, prepared, splits):
    parted = ranked.withColumn("split", R.split_of(F.col("doc_id"), splits)).repartition("query_id", "split")
    return R.best_of_splits(parted, prepared)


def test_ranks_and_totals_equal_one_window(spark):
    ranked = _skewed(spark).persist()
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    whole = [tuple(r) for r in ranked.select("query_id", "doc_id", F.row_number().over(w)).collect()]
    totals = {tuple(r) for r in ranked.groupBy("query_id").agg(F.count(F.lit(1)), F.max("score")).collect()}
    for splits in (1, 8, 1000):
        for page, per_page in ((1, 5), (35, 20), (150, 20)):
            best = _best(ranked, _prepared(spark, page, per_page), splits)
            assert {tuple(r) for r in R.totals(best).collect()} == totals
            end = page * per_page
            got = sorted(tuple(r) for r in R.ranked_rows(best).filter(F.col("rank") <= end).select("query_id", "doc_id", "rank").collect())
            assert got == sorted(r for r in whole if r[2] <= end)
    hot = [r for r in got if r[0] == 0]
    assert len(hot) == 2000 and sorted(r[2] for r in hot) == list(range(1, 2001))
    ranked.unpersist()


def test_few_rows_are_kept_and_a_hot_query_is_split(spark):
    best = _best(_skewed(spark), _prepared(spark, 2, 10), 16)
    per_query = {r.query_id: r["count"] for r in best.groupBy("query_id").count().collect()}
    assert per_query[0] <= 16 * 20 and len(per_query) == 51  # of its 2000 matches
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(query_id") == 1  # the matches' own shuffle serves the windows
    per_split = best.filter("query_id = 0 AND rn = 1").select("n_split").collect()
    assert len(per_split) == 16 and sum(r.n_split for r in per_split) == 2000 and max(r.n_split for r in per_split) < 250


def test_ranking_of_no_matches(spark):
    best = _best(_skewed(spark).filter(F.lit(False)), _prepared(spark, 1, 50), 8)
    assert R.ranked_rows(best).count() == 0 and R.totals(best).count() == 0
