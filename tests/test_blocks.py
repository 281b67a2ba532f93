"""Stored postings: rows of a term and a group of documents, read as one row per posting."""

import os
from datetime import datetime

import pyarrow as pa
import pytest

from quarry import schema as S
from quarry.config import IndexConfig
from quarry.operators import analysis as A
from quarry.sources.store import IndexStore

COLUMNS = "path string, name string, is_dir boolean, size long, mod_time timestamp, content string"


def listing(spark, texts, year):
    return spark.createDataFrame([(f"/t/{k}.txt", f"{k}.txt", False, len(t), datetime(year, 1, 1), t) for k, t in texts.items()], COLUMNS).coalesce(1)


def rows(postings):
    return sorted((r.field, r.tb, r.term, r.doc_id, r.tf, tuple(r.positions), r.dl) for r in postings.collect())


def test_a_row_holds_many_postings(spark, scratch):
    texts = {i: f"harbour the lamp{i % 3} harbour tide{i}" for i in range(60)}
    store = IndexStore(spark, os.path.join(scratch, "store"), IndexConfig(doc_buckets=1))
    store.update(listing(spark, texts, 2020), "/t", run_ts=datetime(2021, 1, 1))
    v = store.current()
    stored = store._seg_read(v.segments[0], "postings", S.BLOCKS).filter("field = 'content'").collect()
    at = {r.term: r for r in stored}
    # Once each: 60 "harbour" in one row, though its postings are 60.
    assert len(stored) == len(at) == 1 + 3 + 60 and at["harbour"].n == len(at["harbour"].doc_ids) == 60
    flat = rows(store.postings())
    assert flat == rows(A.build_postings(store.documents(), v.term_buckets)) and len(flat) == 5 * 60 + 60
    assert {(r.field, r.term): r.df for r in store.term_stats().collect()}[("content", "harbour")] == 60


def test_merged_and_compacted_like_fresh(spark, scratch):
    texts = {i: f"harbour lamp{i % 3}" for i in range(12)}
    store = IndexStore(spark, os.path.join(scratch, "edited"))
    store.update(listing(spark, texts, 2020), "/t", run_ts=datetime(2021, 1, 1))
    for year in (2022, 2024):
        texts = {i: f"{t} tide{year}" for i, t in texts.items() if i != year % 10}
        store.update(listing(spark, texts, year), "/t", run_ts=datetime(year + 1, 1, 1))
    fresh = IndexStore(spark, os.path.join(scratch, "fresh"))
    fresh.update(listing(spark, texts, 2024), "/t", run_ts=datetime(2025, 1, 1))
    stats = lambda s: {(r.field, r.term): r.df for r in s.term_stats().collect()}
    for step in (lambda: None, store.merge_tail, store.compact):
        step()
        assert rows(store.postings()) == rows(fresh.postings()) and stats(store) == stats(fresh)


@pytest.mark.parametrize("tokens, postings", [(1, 1), (7, 2), (10_000, 3), (10_000, 10_000)])
def test_groups_and_batches_of_any_size(monkeypatch, tokens, postings):
    """Cut groups and batches give the same postings; texts without a term give none."""
    monkeypatch.setattr(A, "CHUNK_TOKENS", tokens)
    monkeypatch.setattr(A, "BATCH_POSTINGS", postings)
    texts = ["", "the of", *(f"hot w{i % 4} hot the end{i}" for i in range(9)), "", None]
    lists = [None] * (len(texts) - 1) + [["Ж", "hot", "the", "hot"]]
    ids = [f"/{i}" for i in range(len(texts) - 2)] + [None, "/last"]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "text", "tokens"])
    out = [r for b in A._blocks(iter([batch.slice(0, 5), batch.slice(5)])) for r in b.to_pylist()]
    assert all(r["n"] == len(r["doc_ids"]) == len(r["dls"]) == len(r["ends"]) > 0 and r["ends"][-1] == len(r["positions"]) for r in out)
    found = sorted((r["term"], d, dl, r["positions"][a:z]) for r in out for d, dl, a, z in zip(r["doc_ids"], r["dls"], [0, *r["ends"]], r["ends"]))
    expected = [("hot", "/last", 3, [1, 3]), ("Ж", "/last", 3, [0])]
    for i in range(9):
        d = f"/{i + 2}"
        expected += [("hot", d, 4, [0, 2]), (f"w{i % 4}", d, 4, [1]), (f"end{i}", d, 4, [4])]
    assert found == sorted(expected)
    assert not [*A._blocks(iter([batch.slice(0, 2), batch.slice(0, 0)]))]
