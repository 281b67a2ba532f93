import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lm_score as M
from quarry.llm.common import fold
from quarry.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def learns(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 != 2


def segmentations(s, v):
    if not s:
        yield []
    for k in range(1, len(s) + 1):
        if s[:k] in v.pieces:
            for rest in segmentations(s[k:], v):
                yield [[v.pieces[s[:k]]], *rest]
    if s and s[0] not in v.pieces:
        for rest in segmentations(s[1:], v):
            yield [[v.byte_ids[b] for b in s[0].encode()], *rest]


def brute(rows):
    v = M.Vocabulary(PATH)
    train = [words_of(t) for i, t in rows if learns(i)]
    c = Counter(w for ws in train for w in ws)
    n, distinct = sum(c.values()) + len(train), len(c) + bool(train)
    pieces = np.full(v.size, M.ALPHA)
    for w, k in c.items():
        for i in v.segment([w])[0]:
            pieces[i] += k
    for _ in range(M.ROUNDS):
        log_p = np.log(pieces / (pieces.sum() + len(train) + M.ALPHA))
        pieces = np.full(v.size, M.ALPHA)
        for w, k in c.items():
            ways = [[j for e in seg for j in e] for seg in segmentations("▁" + w, v)]
            chance = np.array([math.exp(sum(log_p[j] for j in way)) for way in ways])
            for way, share in zip(ways, chance / chance.sum(), strict=True):
                for j in way:
                    pieces[j] += k * share
    total = pieces.sum() + len(train) + M.ALPHA
    end = math.log10((len(train) + M.ALPHA) / total)
    log_word = {}
    out = []
    for i, t in rows:
        ws = words_of(t)
        base = sum(math.log10((c[w] + 1) / (n + distinct + 1)) for w in ws) + math.log10((len(train) + 1) / (n + distinct + 1))
        score = end
        for w in ws:
            if w not in log_word:
                log_word[w] = math.log10(sum(math.prod(pieces[j] / total for e in seg for j in e) for seg in segmentations("▁" + w, v)))
            score += log_word[w]
        out.append((i, not learns(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + bool(train), n, base, score))
    return out


def run(df, head):
    rows = M.lm_scores(df, fold(F.col("doc_id"), 7) != 2, PATH, head=head).collect()
    return [(r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]


def same(got, want):
    key = lambda r: str(r[:4]) + f"{r[5]:.6f}"
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-4)  # expected counts are rounded to parts of 1 / UNIT


@pytest.mark.parametrize("head", [1, 20, 100_000])
def test_against_all_segmentations(make_docs, monkeypatch, head):
    monkeypatch.setattr(M, "HELD_WORDS", 10)
    rng = random.Random(4)
    vocab = ["the", "The", "of", "café", "naïve", "x1", "☃", "hello,", "日本", "a", "zq", "�", "ing.", "ß"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\t \n"), (None, "the of"), (63, "the THE"), (63, "the THE")]
    same(run(make_docs(rows).repartition(4), head), brute(rows))


def test_lattices_of_any_cut(monkeypatch):
    v = M.Vocabulary(PATH)
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrst☃é日", k=rng.randint(1, 9))) for _ in range(200)]
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(v.size)))
    times = np.arange(1, len(words) + 1)
    whole = M.Lattice(v, words)
    want, counts = whole.log_probabilities(log_p), whole.expected(log_p, times)
    for w, got in list(zip(words, want, strict=True))[:40]:
        ways = [sum(log_p[j] for e in seg for j in e) for seg in segmentations("▁" + w, v)]
        assert got == pytest.approx(np.logaddexp.reduce(ways))
    for chars in (1, 7, 60):
        monkeypatch.setattr(M, "LATTICE_CHARS", chars)
        parts = list(M.lattices(v, words))
        assert [(lo, hi) for lo, hi, _ in parts][0][0] == 0 and parts[-1][1] == len(words)
        assert np.array_equal(np.concatenate([x.log_probabilities(log_p) for _, _, x in parts]), want)
        assert np.array_equal(sum(x.expected(log_p, times[lo:hi]) for lo, hi, x in parts), counts)


def test_long_words_and_empty_tables(make_docs):
    got = run(make_docs([(1, "ab" * 50_000), (2, "☃" * 2000)]), 10)
    assert all(math.isfinite(r[6]) for r in got) and {r[2] for r in got} == {2}
    assert run(make_docs([]), 10) == []
    held = next(i for i in range(100) if not learns(i))
    same(run(make_docs([(held, "only held out")]), 10), brute([(held, "only held out")]))


def test_likelier_texts_score_higher(make_docs):
    ids = [i for i in range(400) if learns(i)][:200]
    held = [i for i in range(400) if not learns(i)][:2]
    rows = [(i, "the cat sat on the mat with the hat") for i in ids]
    got = {r[0]: r[6] for r in run(make_docs([*rows, (held[0], "the hat on the cat"), (held[1], "qzx vkj wqz pfx jjq")]), 50)}
    assert got[held[0]] > got[held[1]]
