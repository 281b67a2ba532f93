"""Periodic runs against brute force over all lags."""

import hashlib
import random
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from quarry.llm import periodic_runs as P
from quarry.llm.queries import QUERIES


def brute(words):
    """All runs (start, length, period): every lag, every stretch, smallest periods only."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            run = words[start : start + length]
            if length >= max(6, 4 * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = (text or "").encode().split()
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    )


def run(docs):
    return [tuple(r) for r in P.run_digest(P.periodic_runs(docs, plant=True)).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_runs_of_word_lists():
    rng = random.Random(7)
    cases = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"], list("abc") * 4, list("abc") * 4 + ["a"],
             list("aab") * 5 + list("aabaab"), (["a"] * 6 + ["b"]) * 5, (["x"] + ["y"] * 9) * 9 + ["z"] + (["x"] + ["y"] * 9) * 4]
    for _ in range(400):
        words = []
        while len(words) < rng.randint(0, 90):
            unit = [rng.choice("ab" if rng.random() < 0.6 else "abcdef") for _ in range(rng.randint(1, 9))]
            words += unit * rng.randint(1, 7)
            words = words[: len(words) - rng.randint(0, min(3, len(words)))]
        cases.append(words)
    as_bytes = [[w.encode() for w in c] for c in cases]
    assert P.texts_runs(as_bytes) == [brute(c) for c in cases]  # all in one batch
    assert [P.texts_runs([c])[0] for c in as_bytes[:60]] == [brute(c) for c in cases[:60]]


def test_long_repetitions_take_time_in_proportion():
    words = [b"%d" % (i % 7919) for i in range(100_000)]
    assert P.texts_runs([words]) == [[(0, 100_000, 7919)]]
    assert P.texts_runs([[b"a"] * 400_000]) == [[(0, 400_000, 1)]]
    nested = ([b"a"] * 50 + [b"b"]) * 2_000  # a run in each period, and one of all
    runs = P.texts_runs([nested])[0]
    assert len(runs) == 2_001 and (0, len(nested), 51) in runs


def test_odd_rows_against_brute_force(make_docs):
    rng = random.Random(3)
    spaces = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", " \n"]
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a a"), (5, "x " * 30), (5, "x " * 30), (10**15, "Ü ü " * 20)]
    for i in range(300):
        words = [rng.choice(["a", "b", "c", "Dé", "e."]) for _ in range(rng.randint(0, 80))]
        rows.append((i, rng.choice(["", " "]) + "".join(w + rng.choice(spaces) for w in words)))
    rows.append((77, " ".join(str(i % 300) for i in range(1_500))))
    got = run(make_docs(rows).repartition(3))
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in rows), key=key)
    assert run(make_docs([])) == []


def test_operator_keeps_texts_and_ignores_other_columns(make_docs):
    docs = make_docs([(1, "go go go go go go now"), (2, "one two")])
    for c in ("key", "runs", "collapsed", "n_words", "best"):
        docs = docs.withColumn(c, F.lit("x"))
    rows = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 6, 1)] and rows[1].collapsed == "go now" and rows[2].collapsed == "one two"


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r.text or "").split()) <= 2_000]  # brute force takes squares of the words
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) >= len(rows) and all(got[r.doc_id] == expected(r.doc_id, r.text) for r in rows)
