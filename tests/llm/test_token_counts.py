import random

import numpy as np
from tokenizers import Tokenizer

from quarry.llm import token_counts as T
from quarry.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a\nb", "a\n b", "a \nb", "a  b", "x<|endoftext|>y", "<|endoftext|>",
    "it's we'll 'tis", "\ta\tb", "\r\na\r\n", " b c", "a\x1cb \x1d c", "日本語 と 한국어", "é ñ ß İ", "aaaaaaaaaaaaaaaaaa",
    "ab" * 5000, "a b\n\nc d", "100 000 1,5", "😀😀 👍🏽", "a\x00b", "²³ ½ x²", "don't\nI've", "a\u0085b \u0085c", "!!! ??? ...",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    rng = random.Random(7)
    chars = list("ab cdE\n\t .,!'12é日 😀") + [" the", "ing", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(1500)]
    assert T.Counter(PATH).count(texts) == library(texts)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "CACHE_PIECES", 5)
    c = T.Counter(PATH)
    texts = [f"word{i} of text{i % 3}" for i in range(40)]
    got = [n for at in range(0, 40, 4) for n in c.count(texts[at : at + 4])]
    assert got == library(texts)


def test_merging_is_per_sequence():
    table = T.PairTable(PATH)
    words = [b"hello", b"h", b"lowest lowest", b"zzzz"]
    together = T.surviving_symbols(words, table)
    assert np.array_equal(together, [T.surviving_symbols([w], table)[0] for w in words])


def test_operator(spark, make_docs):
    long = "word " * 3000
    rows = [(1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id"), (5, long)]
    got = T.token_counts(make_docs(rows), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library([t or "" for _, t in rows]))
    )
    assert T.token_counts(make_docs([]), PATH).count() == 0
