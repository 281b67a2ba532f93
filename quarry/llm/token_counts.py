"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

The pre-tokens of a batch are held as one ragged numpy array of symbols.  In
each round every sequence finds its lowest-rank adjacent pair and merges all
its occurrences, all sequences at once; sequences without a mergeable pair
drop out.  The symbols that survive are counted.

Texts are cut at single spaces and line feeds where pre-tokens end in any case,
equal pieces are counted once for each batch, and counts of frequent pieces are
kept between batches (at most ``CACHE_PIECES``; a full cache starts anew).
Texts in which such a cut would not be safe (runs of white space, special
strings) take the pre-tokenizer's pattern over the whole text instead.

Cases: null text counts as empty, with no token; a very long pre-token takes
more rounds, not more memory; null ids and extra columns do no harm.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_slices

CACHE_PIECES = 300_000
MAX_TOKENS = 1024

#: Fixed value: the pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PairTable:
    """Merge ranks of a vocabulary file, looked up by pairs of symbol ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int32), made
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def surviving_symbols(pretokens: list[bytes], table: PairTable) -> np.ndarray:
    """The number of BPE symbols of each pre-token, all merged in step."""
    lengths = np.array([len(p) for p in pretokens], np.int64)
    result = lengths.copy()
    symbols = table.byte_ids[np.frombuffer(b"".join(pretokens), np.uint8)]
    owner = np.repeat(np.arange(len(pretokens)), lengths)
    active = lengths > 1
    keep = active[owner]
    symbols, owner = symbols[keep], owner[keep]
    while len(symbols):
        rank = np.full(len(symbols), _NONE, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = table.rank(symbols[inner], symbols[inner + 1])
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(symbols)])
        result[owner[starts]] = sizes
        here = np.repeat(lowest, sizes)
        chosen = np.flatnonzero((rank == here) & (here != _NONE))
        if not len(chosen):
            break
        # A run of neighbouring candidates (aaa) merges every second one from its left end.
        new_run = np.r_[True, (chosen[1:] != chosen[:-1] + 1)]
        run_start = chosen[np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))]
        chosen = chosen[(chosen - run_start) % 2 == 0]
        symbols[chosen] = table.made_by_rank[rank[chosen]]
        keep = np.repeat(lowest != _NONE, sizes)
        keep[chosen + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return result


class Counter:
    """Counts tokens of texts; lives as long as a Python worker."""

    def __init__(self, path: str):
        import regex

        self.table = PairTable(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(s) for s in self.table.special) or r"(?!)")
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pieces whose pre-tokens do not depend on each other, and tokens counted already."""
        if not text:
            return [], 0
        lines = text.split("\n")
        safe = len(lines) == 1 or all(x and not x[0].isspace() and not x[-1].isspace() for x in lines)
        out: list[str] = []
        if safe:
            for line in lines:
                words = line.split(" ")
                out.append(words[0])
                out += [" " + w for w in words[1:]]
            # A piece is safe if it starts with a visible character and holds no other white space.
            safe = " " not in out and "" not in out
        if safe and len(text.split()) == len(out) and not self.special.search(text):
            return out, len(lines) - 1
        out, tokens = [], 0
        at = 0
        for m in self.special.finditer(text):
            out += self.pattern.findall(text, at, m.start())
            tokens, at = tokens + 1, m.end()
        return out + self.pattern.findall(text, at), tokens

    def count(self, texts: Iterable[str | None]) -> list[int]:
        cut = [self.pieces(t or "") for t in texts]
        cache = self.cache
        new = list({p for pieces, _ in cut for p in pieces if p not in cache})
        if len(cache) + len(new) > CACHE_PIECES:
            cache.clear()
            new = list({p for pieces, _ in cut for p in pieces})
        if new:
            owners, flat = [], []
            for i, p in enumerate(new):
                found = self.pattern.findall(p)
                owners += [i] * len(found)
                flat += found
            counts = surviving_symbols([p.encode("utf-8") for p in flat], self.table)
            sums = np.bincount(np.array(owners, np.int64), counts, len(new)).astype(np.int64).tolist()
            cache.update(zip(new, sums, strict=True))
        return [sum(map(cache.__getitem__, pieces)) + tokens for pieces, tokens in cut]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(
    docs: DataFrame, vocabulary: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; no shuffle.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers
    library, the same on every machine.
    """
    kind = docs.schema[id_col].dataType

    def count(batches):
        c = counter(vocabulary)
        for b in row_slices(batches):
            texts = b.column(1).to_pylist()
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return picked.mapInArrow(
        count, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    )
