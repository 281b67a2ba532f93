"""Registered queries against their DuckDB statements on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from quarry.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = [
    "listing_excluded", "changed_files", "deleted_files", "upsert_documents", "manifest_upsert",
    "run_progress", "term_frequencies", "doc_frequencies", "parse_queries", "validate_excludes",
    "format_size", "search_batch", "page_details", "snippets",
]


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x

    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert _norm(srows, cols) == _norm(cur.fetchall(), dcols)


def test_every_query_has_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) <= set(E.oracle_sql())


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables missing")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "path", "name", "score", "size", "mod_time"]
    assert df.count() > 0
