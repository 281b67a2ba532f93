import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing as P
from quarry.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(monkeypatch):
    rng = random.Random(3)
    chars = list("ab cdE\n\t.,!'19é日 😀ΣςIİ") + [" the", "ing", "<|endoftext|>", "<|startoftext|>", "é", "́", " ", "\x1c", "\x85"]
    texts = [None, "", " ", "ΑΣ ΑΣΑ", "it's 'S", "İ", "ﬁ Å"] + ["".join(rng.choices(chars, k=rng.randint(0, 50))) for _ in range(1500)]
    monkeypatch.setattr(P, "CACHE_WORDS", 500)
    t = P.WordTokenizer(PATH)
    got = [np.frombuffer(x, "<u2").tolist() for at in range(0, len(texts), 100) for x in t.encode(texts[at : at + 100])]
    assert got == library(texts)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_hilbert_neighbours(dims, bits):
    cells = np.indices((1 << bits,) * dims).reshape(dims, -1).T
    index = P.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    walk = cells[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(got, rows, length):
    """Every id once, gapless sequences, full but for the last; piece sums by document."""
    ids = library([t for _, t in rows])
    whole = {}
    for (i, _), x in zip(rows, ids, strict=True):
        whole.setdefault((i, len(x)), []).append(x)
    pieces = Counter()
    for r in got:
        candidates = whole[(r.doc_id, r.doc_tokens)]
        crcs = {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in candidates}
        assert r.ids_crc32 in crcs
        pieces[(r.doc_id, r.doc_tokens)] += r.length
    assert pieces == Counter({k: sum(map(len, v)) for k, v in whole.items()})
    total = sum(map(len, ids))
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * length + r.offset == at
        assert r.length > 0 and r.offset + r.length <= length
        at += r.length
    assert at == total


@pytest.mark.parametrize("length", [16, 4096])
def test_every_id_lies_in_one_piece(make_docs, length):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "cat", "Zebra", "naïve", "42", "日本"], k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(i, "copy of one text " * 5) for i in range(200, 260)]
    rows += [(300, None), (301, ""), (302, "twice"), (302, "twice"), (None, "no id"), (303, "long one " * 6000)]
    check(P.pack(make_docs(rows).repartition(5), PATH, length).collect(), rows, length)


def test_empty_table(make_docs):
    assert P.pack(make_docs([]), PATH).count() == 0


def test_similar_texts_are_neighbours(make_docs):
    rng = random.Random(1)
    themes = [[f"{c}{i}word" for i in range(30)] for c in ("fish", "stone", "cloud", "iron")]
    rows = [(i, " ".join(rng.choices(themes[i % 4], k=80))) for i in range(80)]
    got = sorted((r for r in P.pack(make_docs(rows), PATH).collect() if r.start == 0), key=lambda r: (r.sequence_id, r.offset))
    kinds = [r.doc_id % 4 for r in got]
    assert sum(a == b for a, b in zip(kinds, kinds[1:])) > 55
