import hashlib
import random

import pytest

from quarry.llm import exact_dedup as X


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True)):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in X.exact_dedup(df, **kw).collect()), key=str)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_against_brute_force(make_docs, counters):
    rng = random.Random(counters)
    rows = [(i, rng.choice(["Hot", "hot", "HOT", "warm", "Warm", "", None, f"t{i}", "É", "é"])) for i in range(300)]
    assert run(make_docs(rows).repartition(5), counters=counters) == brute(rows)


def test_odd_rows(make_docs):
    rows = [(None, "a"), (None, "A"), (3, "x"), (3, "x"), (3, "y"), (4, None), (5, ""), (6, "long " * 50_000)]
    for counters in (1, 100):
        assert run(make_docs(rows), counters=counters) == brute(rows)
    assert run(make_docs([])) == []


def test_names_that_clash(make_docs):
    df = make_docs([(1, "a"), (2, "A")]).selectExpr(
        "doc_id", "text", "1 AS row_id", "2 AS digest", "3 AS keep", "4 AS group_size", "5 AS kept"
    )
    assert run(df) == brute([(1, "a"), (2, "A")])
    assert [(r.doc_id, r.keep, r.kept) for r in X.drop_duplicates(df).collect()] == [(2, 3, 5)]


def test_summary_keeps_frequent_digests(make_docs):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(999)]
    digests = X.digest_table(make_docs(rows).repartition(7))
    assert hashlib.sha256(b"hot").digest() in X.summarize(digests, counters=3)
    heavy = X.heavy_hitters(digests, counters=3).collect()
    assert [(r.group_size, r.keep.doc_id) for r in heavy] == [(333, 996)]


def test_rows_that_stay(make_docs):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (3, "c"), (None, "n")]
    got = X.drop_duplicates(make_docs(rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("2", "A"), ("3", "b"), ("3", "c"), ("None", "n")]
