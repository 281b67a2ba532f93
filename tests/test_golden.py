"""End to end on a small tree of our own: build, search, page, change, rebuild.

The tree has what decides hits and their order: a word twice in one file and
once in another, words met only by a beginning or a file name, a name whose
parts split and one that stays whole, a pair of words in one file of which
another has one, mixed case, source code, and a root that begins with a dot.
"""

import os
import time
from datetime import datetime, timezone

import pytest

from quarry.config import SearchConfig
from quarry.plans.search import search
from quarry.sources.files import scan_tree
from quarry.sources.store import IndexStore

HARBOUR = "Harbour notes: the ferry leaves at dawn, and every ferry returns by dusk.\n"
TIDES = "# Tide tables\n\nLow water on Monday; one FERRY waits for the flood.\n"
ENGINE = "int knots = 12; /* cruising speed, uphill never */\n"
CREW = '{"captain": "Ødegård", "deckhands": 7, "berth": "north quay"}\n'
PILOT = "for buoy in range(3):\n    signal(buoy, 'north')\n"
TREE = {
    "log7.txt": HARBOUR,
    "charts/coast/tides.md": TIDES,
    "engine.c": ENGINE,
    "people/crew.json": CREW,
    "people/watch/pilot.py": PILOT,
    "photo.png": "ferry in a picture",
}
START = 1_600_000_000
QUERY = "query_id long, query string, per_page int, page int"


def put(root, rel, text, mtime):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    os.utime(p, (mtime, mtime))


def at(seconds):
    return datetime.fromtimestamp(START + seconds, tz=timezone.utc).replace(tzinfo=None)


def run(spark, store, rows, config=SearchConfig()):
    """Paths below the root by query, page details by query, reasons by query."""
    res = search(spark.createDataFrame(rows, QUERY), store.open_index(), config)
    hits = {r[0]: [] for r in rows}
    for r in res.hits.orderBy("query_id", "rank").collect():
        hits[r.query_id].append(r)
    pages = {r.query_id: r for r in res.pages.collect()}
    rejected = {r.query_id: r.error for r in res.rejected.collect()}
    res.unpersist()
    return hits, pages, rejected


@pytest.fixture(scope="module")
def port(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    mark = int(time.time() * 1e6)
    root = os.path.join(base, f"golden-{mark}", ".port")
    for rel, text in TREE.items():
        put(root, rel, text, START)
    store = IndexStore(spark, os.path.join(base, f"golden-index-{mark}"))
    assert store.update(scan_tree(spark, root), root, run_ts=at(5))["published"]
    assert store.doc_count() == len(TREE)
    return root, store


FOUND = {
    "ferry": ["log7.txt", "charts/coast/tides.md"],  # twice, then once in a longer text; not inside the picture
    "FERRY": ["log7.txt", "charts/coast/tides.md"],
    "tide tables": ["charts/coast/tides.md"],
    "deckh": ["people/crew.json"],  # the beginning of a word
    "ødegård": ["people/crew.json"],
    "log7": ["log7.txt"],  # a digit before the dot splits the name
    "engine.c": ["engine.c"],  # a letter on both sides keeps it whole
    "photo": ["photo.png"],
    '"north quay"': ["people/crew.json"],
    "knots": ["engine.c"],
    "submarine": [],
    "the by": [],  # only stop words
    "buoy": ["people/watch/pilot.py"],
}


def test_hits_and_their_order(spark, port):
    root, store = port
    rows = [(i, q, 0, 0) for i, q in enumerate(FOUND)]
    hits, pages, rejected = run(spark, store, rows)
    for i, (q, want) in enumerate(FOUND.items()):
        assert [os.path.relpath(r.path, root) for r in hits[i]] == want, q
        assert pages[i].total_results == len(want)
    assert not rejected


def test_quoted_pair_needs_neighbours(spark, port):
    root, store = port
    hits, *_ = run(spark, store, [(1, '"quay north"', 0, 0), (2, "north", 0, 0)], SearchConfig(phrase_mode="per_phrase"))
    assert hits[1] == []
    assert {os.path.relpath(r.path, root) for r in hits[2]} == {"people/crew.json", "people/watch/pilot.py"}


def test_pages(spark, port):
    _, store = port
    hits, pages, _ = run(spark, store, [(1, "ferry", 1, 1), (2, "ferry", 1, 2), (3, "submarine", 0, 0)])
    assert [len(hits[i]) for i in (1, 2, 3)] == [1, 1, 0] and hits[1][0].path != hits[2][0].path
    shape = {i: (p.current_page, p.page_size, p.total_pages, p.has_next_page, p.has_prev_page) for i, p in pages.items()}
    assert shape == {1: (1, 1, 2, True, False), 2: (2, 1, 2, False, True), 3: (1, 20, 1, False, False)}
    assert pages[3].max_score == 0.0


def test_reasons_for_rejection(spark, port):
    _, store = port
    rows = [(1, None, 0, 0), (2, "", 0, 0), (3, "q" * 1001, 0, 0), (4, "ferry", -3, 0), (5, "ferry", 0, -2), (6, "\t ", 0, 0), (7, "ferry", 99, 0)]
    hits, _, rejected = run(spark, store, rows)
    assert not any(hits.values())
    field = {1: "'query'", 2: "'query'", 3: "'query'", 4: "'per_page'", 5: "'page'", 7: "'per_page'"}
    assert set(rejected) == {1, 2, 3, 4, 5, 6, 7} and rejected[6] == "invalid query"
    assert all(f in rejected[i] for i, f in field.items())
    assert rejected[1] == rejected[2] != rejected[3]


def test_snippets(spark, port):
    _, store = port
    hits, *_ = run(spark, store, [(1, "tide", 0, 0), (2, "photo", 0, 0), (3, "engine.c", 0, 0)])
    assert hits[1][0].snippet == TIDES.strip()
    assert hits[2][0].snippet == hits[3][0].snippet == ""  # a name is no place in a text


def test_blank_queries_match_all_when_asked(spark, port):
    _, store = port
    rows = [(1, " ", 2, 1), (2, "tide", 0, 0), (3, "", 0, 0), (4, "  ", 2, 2)]
    near, pages, _ = run(spark, store, rows, SearchConfig(blank_matches_all=True))
    deep, *_ = run(spark, store, rows, SearchConfig(blank_matches_all=True, ranking_splits=1))
    every = sorted(r.id for r in store.documents().select("id").collect())
    for hits in (near, deep):
        assert [r.path for r in hits[1]] == every[:2] and [r.path for r in hits[4]] == every[2:4]
        assert [r.path for r in hits[3]] == every and {r.score for r in hits[3]} == {1.0}
        assert len(hits[2]) == 1
    assert {pages[i].total_results for i in (1, 3, 4)} == {len(every)}
    assert set(run(spark, store, rows)[2]) == {1, 3, 4}


def test_changes(spark, port):
    root, store = port
    number = store.current().number
    assert not store.update(scan_tree(spark, root), root, run_ts=at(10))["published"]
    assert store.current().number == number

    put(root, "people/watch/pilot.py", "beacon = 'south'\n", START + 20)
    put(root, "new/arrivals.csv", "ship,ferry\nAurora,1\n", START + 20)
    os.remove(os.path.join(root, "log7.txt"))
    r = store.update(scan_tree(spark, root), root, run_ts=at(30))
    assert (r["changed"], r["deleted"], store.doc_count()) == (2, 1, len(TREE))
    hits, *_ = run(spark, store, [(1, "ferry", 0, 0), (2, "beacon", 0, 0), (3, "buoy", 0, 0), (4, "harbour", 0, 0)])
    assert {os.path.relpath(h.path, root) for h in hits[1]} == {"new/arrivals.csv", "charts/coast/tides.md"}
    assert len(hits[2]) == 1 and not hits[3] and not hits[4]
    assert store.open_index().term_stats.filter("field = 'content' AND term = 'ferry'").first().df == 2

    # A later exclude does not take out what is indexed.
    r = store.update(scan_tree(spark, root), root, excludes=[os.path.join(root, "people")], run_ts=at(40))
    assert not r["published"] and store.doc_count() == len(TREE)
    store.compact()
    assert len(store.current().segments) == 1 and store.documents().count() == len(TREE)
    assert len(run(spark, store, [(1, "ferry", 0, 0)])[0][1]) == 2
