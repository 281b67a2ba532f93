import math
import random
from collections import Counter, defaultdict

import pytest

from quarry.llm import mixing as X


def size_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return len([w for w in (text or "").split(" ") if w])


def brute_targets(sizes):
    """Excess over twice a source's size is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        share = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        above = {s for s in names if s not in full and share[s] >= 2 * sizes[s]}
        if not above:
            return share
        full |= above
        if len(full) == len(names):
            return {s: 2 * sizes[s] for s in names}


def brute_rates(sizes, target):
    """Rates by bisection of the dual."""
    total, mean = sum(sizes), sum(sizes) / len(sizes)
    if target >= 2 * total:
        return [2.0] * len(sizes)
    lo, hi = -80.0, 80.0
    for _ in range(200):
        mid = (lo + hi) / 2
        got = sum(s * min(2, math.exp(min(50, mid * (s / mean) ** X.POWER))) for s in sizes if s)
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return [min(2, math.exp(min(50, lo * (s / mean) ** X.POWER))) for s in sizes]


def corpus(seed, per_source):
    rng = random.Random(seed)
    rows = []
    for source, n in per_source.items():
        for _ in range(n):
            k = int(rng.paretovariate(1.1) * 10) if rng.random() < 0.9 else 0
            rows.append((len(rows), "w " * min(k, 3000), "en", source))
    rng.shuffle(rows)
    return rows


def check(rows, got, near=0.01):
    sizes, by = defaultdict(int), defaultdict(list)
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    want = brute_targets(sizes)
    for r in got:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
    for s, rs in by.items():
        taken, least = sum(r.taken for r in rs), min([r.size for r in rs if r.size], default=0)
        assert abs(taken - want[s]) <= max(2 * least, near * want[s])
        rates = brute_rates([r.size for r in rs], want[s])
        for r, rate in zip(rs, rates, strict=True):
            assert not r.size or r.rate == pytest.approx(rate, rel=1e-3, abs=1e-4)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size_of(t)) for i, t, *_ in rows)


def test_targets_rates_and_copies(make_docs):
    rows = corpus(1, {"a": 300, "b": 60, "c": 60, "é": 20, "z": 5, None: 40})
    got = X.mix(make_docs(rows).repartition(4)).collect()
    check(rows, got)
    again = X.mix(make_docs(rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_power_zero_gives_one_rate_for_each_source(make_docs):
    got = X.mix(make_docs(corpus(2, {"a": 50, "b": 50, "c": 50})), power=0).collect()
    for s in "abc":
        rates = {round(r.rate, 4) for r in got if r.source == s and r.size}
        (r, *_) = [r for r in got if r.source == s]
        assert len(rates) == 1 and rates.pop() == pytest.approx(r.target / r.source_size, abs=1e-3)


def test_odd_rows(make_docs):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", None, None), (3, "x y", None, None), (None, "p q r", "en", "b"),
            (4, "long " * 50_000, "en", "b"), (5, None, "en", "empty")]
    check(rows, X.mix(make_docs(rows)).collect(), near=0.5)  # a long text is half of its source
    assert X.mix(make_docs([])).collect() == []
    assert X.mixed_documents(make_docs([])).count() == 0


def test_mixed_documents(make_docs):
    docs = make_docs(corpus(3, {"a": 40, "b": 10, "c": 20})).selectExpr("*", "'k' AS row_id", "7 AS copies", "8 AS size")
    copies = {r.doc_id: r.copies for r in X.mix(docs).collect()}
    got = X.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for i, n in copies.items() if n})
