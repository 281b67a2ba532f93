"""Phrases from their rarest token: candidates, the filter on other tokens, and the plan."""

from pyspark.sql import functions as F

from quarry.config import IndexConfig, SearchConfig
from quarry.operators import match as M
from quarry.operators.parse import compile_queries, persist_compiled
from quarry.operators.validate import validate_queries
from quarry.plans.index import build_index
from quarry.plans.search import search

N = 2000


def _index(spark):
    """Every text holds "hot cold"; every fortieth "hot rare", some of those in another order."""
    texts = [
        (f"/d/{i:04}", f"/d/{i:04}", f"n{i}", "hot cold " + ("" if i % 40 else "hot rare" if i % 80 else "rare hot"))
        for i in range(N)
    ]
    docs = spark.createDataFrame(texts, "id string, path string, name string, content string")
    docs = docs.withColumns({"size": F.lit(1).cast("long"), "mod_time": F.lit(0).cast("timestamp"), "truncated": F.lit(False)})
    return build_index(docs, IndexConfig(term_buckets=2), N)


def _tokens(spark, index, text, mode="per_phrase"):
    q = spark.createDataFrame([(1, text, 20, 1)], "query_id long, query string, per_page int, page int")
    cq = persist_compiled(compile_queries(validate_queries(q).drop("error"), mode))
    return M.phrase_tokens(cq, index, 100, 100_000).persist()


def test_rarest_token_is_the_anchor(spark):
    index = _index(spark)
    toks = _tokens(spark, index, '"hot rare" "cold hot" "hot missing"')
    anchors = {(r.lterm, r.df) for r in toks.filter("anchor").collect()}
    assert anchors == {("rare", N // 40), ("cold", N)}  # a phrase with an unknown token has no rows
    assert toks.count() == 4


def test_only_candidates_pass_the_filter(spark):
    index = _index(spark)
    toks = _tokens(spark, index, '"hot rare"')
    rows = lambda anchor: toks.filter(F.col("anchor") == anchor).join(
        index.postings.withColumnRenamed("term", "lterm"), ["field", "tb", "lterm"]
    )
    candidates, others = rows(True), rows(False)
    assert candidates.count() == N // 40 and others.count() == N
    passed = M.among_candidates(others, M.candidate_filter(candidates))
    ids = {r.doc_id for r in passed.collect()}
    assert {r.doc_id for r in candidates.collect()} <= ids and len(ids) <= N // 40 + 3
    assert set(passed.columns) == set(others.columns)


def test_plan_filters_before_the_shuffle(spark):
    index = _index(spark)
    plan = M.phrase_child_scores(_tokens(spark, index, '"hot rare"'), index, 2, 100_000, 8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    shuffle = text.index("hashpartitioning(query_id")
    assert text.index("shiftright") > shuffle  # printed below the exchange: before it in time


def test_hits(spark):
    index = _index(spark)
    q = spark.createDataFrame(
        [(1, '"hot rare"', 20, 1), (2, '"rare hot"', 20, 1), (3, '"hot cold" "hot rare"', 20, 1), (4, '"rare missing"', 20, 1)],
        "query_id long, query string, per_page int, page int",
    )
    found = search(q, index, SearchConfig(phrase_mode="per_phrase"))
    totals = {r.query_id: r.total_results for r in found.pages.collect()}
    found.unpersist()
    assert totals == {1: N // 80, 2: N // 80, 3: N, 4: 0}
