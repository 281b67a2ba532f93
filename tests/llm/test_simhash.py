import random

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash as S


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if comp[j] < comp[i] and (fps[i] ^ fps[j]).bit_count() <= radius:
                    comp[i], changed = comp[j], True
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            base = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(3, 150))))
    return out


def run(df):
    return sorted((tuple(r) for r in S.simhash_dedup(df).collect()), key=str)


def test_against_brute_force(make_docs):
    rows = [(1000 - i, t) for i, t in enumerate(texts(3, 160))]
    got = run(make_docs(rows).repartition(3))
    assert got == brute(rows)
    assert len({c for *_, c in got}) < len(rows)


def test_odd_rows(make_docs):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a  b\nc\x0bd"),
        (None, "a b c d"), (None, "alone here with no id"), (8, "x y"), (9, "É é"), (10, "long text " * 40_000),
    ]
    assert run(make_docs(rows)) == brute(rows)
    assert run(make_docs([])) == []


def test_representatives(make_docs):
    t = texts(5, 30)
    rows = [(i, x) for i, x in enumerate(t)] + [(100 + i, x.upper()) for i, x in enumerate(t)] + [(0, t[0])]
    want = sorted({d for d, _, c in brute(rows) if d == c})
    got = S.keep_representatives(make_docs(rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("limit", [1 << 22, 500])
def test_every_pair_within_the_radius_is_connected(spark, monkeypatch, limit):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flip = lambda f, k: f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    fps = np.unique(np.array([*base, *(flip(f, k) for f in base for k in (1, 3, 4, 5, 6))], np.uint64))
    links = {(a, b) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= 4}
    found = set()
    for p in range(16):
        need = np.bitwise_count((fps >> np.uint64(60)) ^ np.uint64(p)).astype(np.int64)
        take = need <= 2
        monkeypatch.setattr(S, "VARIANTS_MOST", limit)
        who = np.flatnonzero(take)
        for i, j in S.meetings(fps[take] & np.uint64((1 << 60) - 1), 2 - need[take], who, 60):
            found |= {(fps[max(x, y)], fps[min(x, y)]) for x, y in zip(i, j, strict=True)}
    assert found <= links

    def roots(pairs):
        root = {f: f for f in fps}
        for _ in fps:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(found) == roots(links)


def linked(spark, fps, radius):
    signed = [(int(f) - (1 << 64) if int(f) >> 63 else int(f),) for f in fps]
    pairs = S.link_fingerprints(spark.createDataFrame(signed, "fp long"), radius).collect()
    return [(p.a % (1 << 64), p.b % (1 << 64)) for p in pairs]


def roots_of(fps, pairs):
    root = {int(f): int(f) for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in pairs:
        a, b = sorted((top(int(a)), top(int(b))))
        root[b] = a
    return {f: top(f) for f in root}


@pytest.mark.parametrize("radius,most", [(0, 3), (2, 3), (4, 6)])
def test_full_prefixes_are_dealt_out_again(spark, monkeypatch, radius, most):
    """A dense cluster of one template among scattered fingerprints, with few or many rounds of further bits."""
    rng = np.random.default_rng(radius + most)
    flip = lambda f, k: f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    dense = [flip(base[0], k) for k in (1, 2, 3, 4, 5, 7) for _ in range(25)]
    fps = np.unique(np.array([*base, *dense, *(flip(f, k) for f in base for k in (1, 4, 5))], np.uint64))
    monkeypatch.setattr(S, "PREFIX_MOST", most)
    monkeypatch.setattr(S, "DEAL_BITS", 20)
    got = linked(spark, fps, radius)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if int(a ^ b).bit_count() <= radius]
    assert {tuple(sorted(p)) for p in got} <= {tuple(sorted((int(a), int(b)))) for a, b in links}
    assert roots_of(fps, got) == roots_of(fps, links)


def test_hub_join_keeps_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_SHARES", 4)
    rows = spark.createDataFrame([(0 if i < 700 else i, i) for i in range(1000)], "k long, v long")
    keys = rows.groupBy("k").agg(S.F.max("v").alias("top"), S.F.count("*").alias("n"))
    got = sorted((r.k, r.v, r.top) for r in S.hub_join(rows, keys, "k", "n", 1000, "v").collect())
    assert got == [(0, i, 699) for i in range(700)] + [(i, i, i) for i in range(700, 1000)]


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(200, 230)] + [(-5, 900), (7, 7)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 200 for i in [*range(201, 230), 500]} | {900: -5}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_component_stays_whatever_its_id(make_docs):
    a, b, c, d, e = ("%s " % x * 3 + " ".join(f"{x}{i}" for i in range(90)) for x in "abcde")
    rows = [
        (5, a), (5, b), (2, b), (6, a.upper()),  # (5, b) is stood for by 2, though its id stands for a
        (7, c), (7, c.upper()), (7, c),  # one smallest id with two texts, one of them twice
        (None, d), (None, d.upper()), (None, a), (None, e), (9, e),  # one null id of each component stays
        (11, None), (11, ""),
    ]
    got = [(r.doc_id, r.text) for r in S.keep_representatives(make_docs(rows).repartition(3)).collect()]
    with_id = [brute_fingerprint(t) for i, t in got if i is not None]
    assert sorted(with_id) == sorted({brute_fingerprint(t) for i, t in rows if i is not None})
    assert sorted((str(i), (t or "").lower()[:1]) for i, t in got) == [
        ("11", ""), ("2", "b"), ("5", "a"), ("7", "c"), ("9", "e"), ("None", "a"), ("None", "d"), ("None", "e"),
    ]


def test_odd_radii_are_refused(spark):
    with pytest.raises(ValueError):
        S.link_fingerprints(spark.createDataFrame([(1,)], "fp long"), 3)
