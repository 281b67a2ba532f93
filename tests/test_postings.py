"""In-row postings: run-length groups of a document's tokens against plain Python, and their plan."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.functions.stopwords import STOP_WORDS_EN
from quarry.functions.text import raw_tokens
from quarry.operators.analysis import build_doc_stats, build_postings

SCHEMA = "id string, path string, name string, content string"


def documents(spark, texts):
    return spark.createDataFrame([(f"/d/{i}", f"/d/{i}", f"n{i}.txt", t) for i, t in enumerate(texts)], SCHEMA)


def test_runs_against_plain_python(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "the", "of", "Größe", "x1", "it's", "3.14", "a.b.c", "zeta", "Beta", "_"]
    texts = [None, "", "the of and", "one", "same same same"] + [
        " ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(0, 120))) for _ in range(40)
    ]
    docs = documents(spark, texts)
    stop, expected = set(STOP_WORDS_EN), {}
    for r in docs.select("id", "name", raw_tokens(F.coalesce("content", F.lit(""))).alias("c"), raw_tokens(F.col("name")).alias("n")).collect():
        for field, tokens in (("content", r.c), ("name", r.n)):
            places = defaultdict(list)
            for i, t in enumerate(tokens):
                if t not in stop:
                    places[t].append(i)
            for t, at in places.items():
                expected[(field, t, r.id)] = (len(at), at, sum(map(len, places.values())))
        expected[("path", r.id, r.id)] = (1, [0], 1)
    rows = build_postings(docs, 4).collect()
    assert len(rows) == len(expected)
    assert {(r.field, r.term, r.doc_id): (r.tf, r.positions, r.dl) for r in rows} == expected
    lengths = {(r.field, r.doc_id): r.len for r in build_doc_stats(docs).collect()}
    assert all(lengths[(f, d)] == dl for (f, _, d), (_, _, dl) in expected.items())


def test_no_shuffle_and_one_pass(spark):
    plan = build_postings(documents(spark, ["a b c"]), 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert plan.count("regexp_extract_all") <= 2  # one for each analysed field


def test_long_text(spark):
    """One text of 300,000 tokens, one of them a third of all."""
    docs = documents(spark, [" ".join("hot" if i % 3 == 0 else f"w{i % 50_000}" for i in range(300_000))])
    rows = {r.term: r for r in build_postings(docs, 4).filter("field = 'content'").collect()}
    assert rows["hot"].positions == list(range(0, 300_000, 3)) and rows["hot"].dl == 300_000
    assert sum(r.tf for r in rows.values()) == 300_000 and rows["w1"].positions == [i for i in range(1, 300_000, 50_000) if i % 3]
