"""The index store under deletions, unreadable files and folders, changed settings and other writers."""

import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.config import PROGRESS_FAILED, IndexConfig
from quarry.plans.search import search
from quarry.sources.files import scan_tree
from quarry.sources.store import ConcurrentUpdate, IndexStore, progress

T = [datetime(2025, 1, 1 + i) for i in range(9)]


def put(root, files, mtime):
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as fh:
            fh.write(text)
        os.utime(p, (mtime, mtime))


@pytest.fixture
def made(spark):
    base = os.path.join(spark.conf.get("spark.checkpoint.dir"), f"store-{uuid.uuid4().hex}")
    root = os.path.join(base, "tree")
    put(root, {"a.txt": "lantern oil", "b.txt": "lantern glass", "deep/c.txt": "lantern hook", "deep/er/d.md": "rope"}, 1_700_000_000)
    store = IndexStore(spark, os.path.join(base, "index"))
    store.update(scan_tree(spark, root), root, run_ts=T[0])
    return root, store


def found(spark, store, word):
    res = search(spark.createDataFrame([(1, word, 0, 0)], "query_id long, query string, per_page int, page int"), store.open_index())
    out = {os.path.basename(r.path) for r in res.hits.collect()}
    res.unpersist()
    return out


def test_a_run_that_only_deletes(spark, made):
    root, store = made
    os.remove(os.path.join(root, "b.txt"))
    r = store.update(scan_tree(spark, root), root, run_ts=T[1])
    assert (r["changed"], r["deleted"], store.doc_count()) == (0, 1, 3)
    assert found(spark, store, "lantern") == {"a.txt", "c.txt"} and store.manifest().count() == 3
    assert store.merge_tail() and store.compact()
    assert found(spark, store, "lantern") == {"a.txt", "c.txt"} and store.documents().count() == 3


def test_an_unreadable_file_keeps_its_document(spark, made):
    root, store = made
    path = os.path.join(root, "b.txt")
    os.remove(path)
    os.symlink(os.path.join(root, "deep"), path)  # opening it as a file fails
    put(root, {"a.txt": "lantern wick"}, 1_800_000_000)
    os.utime(path, (1_800_000_000, 1_800_000_000), follow_symlinks=False)
    r = store.update(scan_tree(spark, root), root, run_ts=T[1])
    assert r["published"] and store.doc_count() == 4 == store.documents().count()
    assert found(spark, store, "glass") == {"b.txt"} and found(spark, store, "wick") == {"a.txt"}
    os.remove(path)
    put(root, {"b.txt": "lantern brass"}, 1_900_000_000)
    store.update(scan_tree(spark, root), root, run_ts=T[2])
    assert found(spark, store, "brass") == {"b.txt"} and not found(spark, store, "glass")


def test_nothing_below_an_unreadable_folder_is_deleted(spark, made):
    root, store = made
    listing = scan_tree(spark, root)
    blind = os.path.join(root, "deep")
    # What a scan gives when the folder cannot be listed.
    cut = listing.filter(~F.col("path").startswith(blind + "/")).withColumn(
        "error", F.when(F.col("path") == blind, F.lit("permission denied")).otherwise(F.col("error"))
    ).filter(~F.col("path").endswith("/a.txt"))
    r = store.update(cut, root, run_ts=T[1])
    assert r["deleted"] == 1 and store.doc_count() == 3 and found(spark, store, "hook") == {"c.txt"}


def test_a_folder_that_cannot_be_listed_is_reported(spark, made, tmp_path):
    root, _ = made
    os.symlink(os.path.join(root, "nowhere"), os.path.join(root, "dangling"))
    rows = {os.path.relpath(r.path, root): r for r in scan_tree(spark, root).collect()}
    assert {"a.txt", "deep", "deep/er", "deep/er/d.md", "dangling"} <= set(rows) and len(rows) == len(set(rows))
    with pytest.raises(Exception):
        scan_tree(spark, str(tmp_path / "missing")).collect()


def test_scan_splits_do_not_change_the_listing(spark, made):
    from quarry.sources.files import _TreeReader

    root, _ = made
    seen = []
    for splits in (1, 2, 100):
        reader = _TreeReader({"path": root, "splits": str(splits)})
        seen.append(sorted(r[0] for p in reader.partitions() for r in reader.read(p)))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 6


def test_buckets_stay_as_the_store_began(spark, made):
    root, store = made
    other = IndexStore(spark, store.root, IndexConfig(term_buckets=64, doc_buckets=3))
    put(root, {"e.txt": "lantern new"}, 1_800_000_000)
    other.update(scan_tree(spark, root), root, run_ts=T[1])
    assert (other.current().term_buckets, other.current().doc_buckets) == (16, 8)
    assert found(spark, other, "lantern") == {"a.txt", "b.txt", "c.txt", "e.txt"}


def test_a_version_is_published_once(spark, made):
    root, store = made
    v = store.current()
    with pytest.raises(ConcurrentUpdate):
        store._publish(v)
    assert store.current() == v and store.fs.names("versions") == ["v000001.json"]


def test_a_failed_run_is_recorded(spark, made):
    root, store = made
    broken = scan_tree(spark, root).withColumn("size", F.raise_error(F.lit("listing broke")).cast("long"))
    with pytest.raises(Exception):
        store.update(broken, root, run_id="broken", run_ts=T[1])
    last = {r.run_id: r.status for r in progress(store.ledger()).collect()}
    assert last["broken"] == PROGRESS_FAILED and store.doc_count() == 4


def test_a_cap_marks_what_it_cuts(spark, made):
    root, _ = made
    store = IndexStore(spark, f"{root}-capped", IndexConfig(content_cap_bytes=8))
    store.update(scan_tree(spark, root), root, run_ts=T[0])
    got = {os.path.basename(r.path): (r.content, r.truncated) for r in store.documents().collect()}
    assert got["a.txt"] == ("lantern ", True) and got["d.md"] == ("rope", False)


def test_closed_folders_are_never_opened(spark, made, monkeypatch):
    from quarry.sources import files

    root, _ = made
    os.makedirs(os.path.join(root, ".git", "objects"))
    deep = os.path.join(root, "deep")
    opened = []
    scandir = os.scandir
    monkeypatch.setattr(files.os, "scandir", lambda top: opened.append(top) or scandir(top))
    for splits in ("1", "2", "100"):
        options = {"path": root, "splits": splits, "skip_hidden": "true", "excludes": f'["{deep}/"]'}
        reader = files._TreeReader(options)
        rows = {r[0]: r[5] for p in reader.partitions() for r in reader.read(p)}
        assert rows[deep] == rows[os.path.join(root, ".git")] == files.CLOSED
        assert not any(p.startswith((deep + "/", os.path.join(root, ".git/"))) for p in rows)
    assert opened and set(opened) & {deep, os.path.join(root, ".git")} == set()
    everything = files._TreeReader({"path": root})
    assert deep + "/er/d.md" in {r[0] for p in everything.partitions() for r in everything.read(p)}
    none = files._TreeReader({"path": root, "excludes": f'["{root}"]'})
    assert [r for p in none.partitions() for r in none.read(p)] == []


def test_a_later_exclude_keeps_documents(spark, made):
    root, store = made
    n = store.doc_count()
    r = store.update(scan_tree(spark, root, [os.path.join(root, "deep")], skip_hidden=True), root, run_ts=T[1])
    assert r["deleted"] == 0 and store.doc_count() == n
    os.remove(os.path.join(root, "a.txt"))
    r = store.update(scan_tree(spark, root, [os.path.join(root, "deep")]), root, run_ts=T[2])
    assert r["deleted"] == 1 and store.doc_count() == n - 1
