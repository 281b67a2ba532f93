"""Packing along a space-filling curve.

A document's token ids (with an end id) give a hashed count vector; a fixed
random projection takes it to a few dimensions; the Hilbert index of the
quantised projection orders documents so that neighbours have similar tokens.
Rows are range-sorted by that key, token counts are summed along the order,
and the stream is cut every ``length`` tokens: only the last sequence is not
full.

How it runs: texts are tokenised once and their ids written to the shared
folder with a row id, the key and the count.  Order and places come from the
small columns alone; ids meet their places in one shuffle by row id.  Equal
keys are split by id and row, so copies of one text spread over partitions.

The words of a batch are dictionary-encoded, and each distinct one is tokenised
once for each worker while it stays in a bounded cache: the tokenizer drops
white space and no token crosses it, so a text's ids are those of its words, one
after another, gathered by numpy.

Cases: a null or empty text has only the end id; repeated rows are packed each
(their order among themselves does not change any result but which is which);
null ids sort first; a document longer than a sequence is cut into many
pieces; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, prefix_sum, row_slices
from quarry.llm.token_counts import byte_symbols

LENGTH = 4096
END_ID = 2
#: Dimensions of the hashed vector, of its projection, and bits of each coordinate.
HASHED = 1024
DIMENSIONS = 4
BITS = 12
SEED = 20_240_501
#: Words whose ids a worker keeps; a full cache starts anew.
CACHE_WORDS = 1_000_000
#: Texts whose words are looked up together.
BATCH_ROWS = 1024

#: Letters that lower-case and compose to themselves, then ASCII marks without
#: the apostrophe: two pre-tokens whatever stands around them.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def projection(seed: int = SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((HASHED, DIMENSIONS))


def hash_slots(ids: np.ndarray) -> np.ndarray:
    """The place of each token id in the hashed vector (multiplicative hashing)."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def coordinates(ids: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """A document's place in the cube [0, 2**BITS): damped counts, unit length, projected."""
    vector = np.log1p(np.bincount(hash_slots(ids), minlength=HASHED))
    norm = np.linalg.norm(vector)
    x = vector @ plane / (norm if norm else 1.0)
    unit = 1 / (1 + np.exp(-1.702 * x))  # near the normal distribution function, so that cells fill evenly
    return np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve index of each row of integer coordinates below 2**bits.

    After J. Skilling, Programming the Hilbert curve (2004), on all rows at
    once: rotates and reflects sub-cubes from the highest bit down, then reads
    the Gray code across dimensions.
    """
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, below = 1 << level, (1 << level) - 1
        for d in range(dims):
            set_ = (x[d] & high) != 0
            swap = np.where(set_, 0, (x[0] ^ x[d]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


class WordTokenizer:
    """Token ids of texts as little-endian unsigned 16-bit arrays; lives as long as a worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.clear()

    def clear(self) -> None:
        """Empties the cache: words' numbers, their ids one after another, and where each word's ids end."""
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = array("H"), array("q", [0])

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word; plain words go to the merging model without the steps that would not change them."""
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        letters, marks = plain.groups()
        letters = letters.lower()
        if letters != word:  # the word in lower case is often known
            return self.known(letters) + (self.model_ids(marks) if marks else [])
        return self.model_ids(word if word.isascii() else "".join(map(self.symbols.__getitem__, word.encode("utf-8"))))

    def model_ids(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part)]

    def known(self, word: str) -> list[int]:
        row = self.row(word)
        return self.ids[self.ends[row] : self.ends[row + 1]].tolist()

    def row(self, word: str) -> int:
        """The cache's row of a word; a new one is tokenised."""
        if word not in self.numbers:
            ids = self.word_ids(word)
            self.numbers[word] = len(self.ends) - 1
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
        return self.numbers[word]

    def rows(self, words: np.ndarray) -> np.ndarray:
        found = list(map(self.numbers.get, words))
        if len(self.numbers) + 2 * found.count(None) > CACHE_WORDS:
            self.clear()
            found = [None] * len(words)
        return np.array([self.row(words[i]) if r is None else r for i, r in enumerate(found)], np.int64)

    def encode(self, texts: list[str | None] | pa.Array, end_id: int = END_ID) -> list[bytes]:
        """Each distinct word of the texts is looked up once; ids are gathered by the words' places in the cache."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        words = lists.flatten().dictionary_encode()
        rows = self.rows(words.dictionary.to_numpy(zero_copy_only=False))
        ends, ids = np.frombuffer(self.ends, np.int64), np.append(np.frombuffer(self.ids, np.uint16), np.uint16(end_id))
        # a last word, of the end id alone, is set behind each text
        start, length = np.append(ends[rows], len(ids) - 1), np.append(ends[rows + 1] - ends[rows], 1)
        bounds = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        place = np.insert(words.indices.to_numpy().astype(np.int64), bounds, len(rows))
        start, length = start[place], length[place]
        behind = np.cumsum(length)
        out = ids[np.arange(behind[-1] if len(behind) else 0) + np.repeat(start - (behind - length), length)].astype("<u2").tobytes()
        cuts = [0, *(2 * behind[bounds + np.arange(len(bounds))]).tolist()]
        return [out[x:y] for x, y in zip(cuts, cuts[1:])]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(
    docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, tokens, curve, ids): ids as packed 16-bit numbers, curve the Hilbert key."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches):
        tokenizer, plane = word_tokenizer(vocabulary), projection()
        for b in row_slices(batches, BATCH_ROWS):
            packed = tokenizer.encode(b.column(1), end_id)
            arrays = [np.frombuffer(p, "<u2") for p in packed]
            points = np.array([coordinates(a, plane) for a in arrays], np.int64).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array(hilbert_index(points)),
                 pa.array(packed, pa.binary())],
                names=["doc_id", "tokens", "curve", "ids"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, f"doc_id {kind}, tokens long, curve long, ids binary")


def cut(placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of each document, from (doc_id, ids, at): at, its place in the whole stream."""
    kind = placed.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in row_slices(batches):
            out = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for row, (ids, at) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                start = 0
                while start < len(wide):
                    here = min(length - (at + start) % length, len(wide) - start)
                    piece = (row, start, here, zlib.crc32(wide[start : start + here].tobytes()), len(wide),
                             (at + start) // length, (at + start) % length)
                    for column, x in zip(out.values(), piece, strict=True):
                        column.append(x)
                    start += here
            rows = pa.array(out.pop("row"), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), *[pa.array(x, pa.int64()) for x in out.values()]], names=["doc_id", *out]
            )

    schema = (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return placed.select("doc_id", "ids", "at").mapInArrow(work, schema)


def pack(
    docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokenized = tokenize(docs, vocabulary, end_id, id_col, text_col)
    tokenized = materialize(tokenized.withColumn("row_id", F.monotonically_increasing_id()), "token-ids")
    order = [F.col("curve"), F.col("doc_id").asc_nulls_first(), F.col("row_id")]
    places = prefix_sum(tokenized.select("row_id", "doc_id", "curve", "tokens"), order, "tokens", "at", name="curve")
    placed = tokenized.select("row_id", "doc_id", "ids").join(places.select("row_id", "at"), "row_id")
    return cut(placed, length)
