"""What a search reads from the stored postings."""

import os
import re
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.operators import match as M
from quarry.operators.parse import compile_queries, persist_compiled
from quarry.operators.validate import validate_queries
from quarry.plans.search import search
from quarry.sources.store import IndexStore


@pytest.fixture(scope="module")
def store(spark):
    rows = [(f"/t/{i}.txt", f"{i}.txt", False, 10, datetime(2024, 1, 1), f"word{i} common lamp{i % 7}") for i in range(400)]
    listing = spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, mod_time timestamp, content string")
    s = IndexStore(spark, os.path.join(spark.conf.get("spark.checkpoint.dir"), f"prune-{uuid.uuid4().hex}"))
    s.update(listing, "/t", run_ts=datetime(2024, 2, 1))
    return s


def facts_of(spark, store, queries):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string").selectExpr("*", "0 AS per_page", "0 AS page")
    cq = persist_compiled(compile_queries(validate_queries(q).drop("error"), "per_phrase"))
    return M.batch_facts(cq, store.open_index())


def test_terms_reach_the_scan(spark, store):
    facts = facts_of(spark, store, ["lamp3"])
    assert facts.n_queries == 1 and "lamp3" in facts.terms["content"] and facts.prefixes["content"] == ["lamp3"]
    plan = M.pruned_index(store.open_index(), facts).postings._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S).group(1)
    assert "lamp3" in pushed and "StringStartsWith(term,lamp3)" in pushed
    assert "PartitionFilters: [" in plan and "tb#" in plan


def test_large_batches_fall_back_to_buckets(spark, store):
    facts = facts_of(spark, store, [f"word{i}" for i in range(M.SCAN_TERMS + 5)])
    assert facts.terms is None and facts.buckets
    rows = M.pruned_index(store.open_index(), facts).postings
    assert rows.filter("field = 'content' AND term LIKE 'word%'").count() == 400


def test_many_quoted_phrases_of_one_query_are_one_row(spark, store):
    query = " ".join(['"lamp3"'] * 30)
    q = spark.createDataFrame([(1, query, 0, 0)], "query_id long, query string, per_page int, page int")
    for mode in ("as_built", "per_phrase"):
        cq = compile_queries(validate_queries(q).drop("error"), mode)
        assert [(r.c, r.times) for r in cq.phrases.collect()] == [(0, 30)]
    res = search(q, store.open_index(), SearchConfig(phrase_mode="per_phrase"))
    assert res.matches.count() == len([i for i in range(400) if i % 7 == 3])
    one = search(q.withColumn("query", F.lit('"lamp3"')), store.open_index(), SearchConfig(phrase_mode="per_phrase"))
    a, b = ({r.doc_id: r.score for r in x.matches.collect()} for x in (res, one))
    # Thirty equal children: thirty times the sum, all of them matched.
    assert a.keys() == b.keys() and all(a[d] == pytest.approx(30 * b[d], rel=1e-5) for d in a)
    res.unpersist()
    one.unpersist()
