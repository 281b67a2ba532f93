"""A store whose removed documents are too many to broadcast: their Bloom filter decides which rows are shuffled."""

import os
from datetime import datetime

from quarry.sources import store as store_module
from quarry.sources.store import IndexStore

COLUMNS = "path string, name string, is_dir boolean, size long, mod_time timestamp, content string"


def listing(spark, texts, year):
    return spark.createDataFrame([(f"/t/{k}.txt", f"{k}.txt", False, len(t), datetime(year, 1, 1), t) for k, t in texts.items()], COLUMNS).coalesce(1)


def facts(store):
    docs = {(r.id, r.content) for r in store.documents().collect()}
    return docs, {(r.field, r.term): r.df for r in store.term_stats().collect()}, store.doc_count()


def test_same_as_a_fresh_store(spark, scratch, monkeypatch):
    monkeypatch.setattr(store_module, "TOMBSTONE_BROADCAST_ROWS", 0)
    first = {i: f"harbour lamp{i % 3} tide{i}" for i in range(12)}
    last = {i: t + " revised" if i % 4 == 0 else t for i, t in first.items() if i % 5} | {20: "harbour new"}
    store = IndexStore(spark, os.path.join(scratch, "edited"))
    store.update(listing(spark, first, 2020), "/t", run_ts=datetime(2021, 1, 1))
    edited = listing(spark, last, 2020).filter("content NOT LIKE '%revised%'").unionByName(listing(spark, last, 2022).filter("content LIKE '%revised%'"))
    store.update(edited, "/t", run_ts=datetime(2023, 1, 1))
    fresh = IndexStore(spark, os.path.join(scratch, "fresh"))
    fresh.update(edited, "/t", run_ts=datetime(2023, 1, 1))
    assert facts(store) == facts(fresh)
    plan = store.documents()._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan
