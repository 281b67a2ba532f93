"""Language-model scores: marginal likelihood of a subword lattice.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text
ends with one end symbol.  Under the lattice model a word's probability is the
sum over all its segmentations into pieces of an existing vocabulary of the
product of the pieces' probabilities, found by a forward recursion in log
space; a text's probability is the product over its words and its end.

The vocabulary file gives the pieces and a best segmentation; its own scores
are merge ranks, not probabilities, so the pieces' probabilities come from
the training documents.  They start from counts of pieces in the file's best
segmentations of all training words; then, ``ROUNDS`` times, a forward and a
backward recursion over each distinct training word give every piece its
expected count over all segmentations, weighted by their probabilities so far.
``ALPHA`` is added to each count, and the end symbol counts once for each
training document.  Characters without a piece are spelled by byte pieces.
Expected counts are summed as whole numbers of ``1 / UNIT``, so that they do not
hang on how the words were dealt to tasks.

A batch of words is one ragged lattice in numpy: the pieces that start at every
place are found by walking a sorted table of the vocabulary's tree for all
places together, and each step of a recursion takes all words at one place.

The base score is an add-one unigram score of whole words.

How it runs: word counts of all documents are gathered (counted per task,
then shuffled by word); each distinct word is scored once; documents look up
the ``HEAD`` most frequent words in a broadcast table of that bound, and only
their other words are joined, so that no join key holds many rows.

Cases: null and empty texts have only the end symbol; a null id counts as the
empty text for the folds; repeated rows are scored and counted each; a model
without training documents scores by ``ALPHA`` alone; an empty table gives an
empty result; a very long word costs time linear in its length.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_slices

#: Distinct words in the broadcast table.
HEAD = 150_000
#: Bins of word counts for each power of two.
COUNT_BINS = 8
#: Added to each piece's count.
ALPHA = 0.1
#: Rounds of expected counts, and the parts of one that are summed.
ROUNDS = 2
UNIT = 1 << 16
#: Characters of the words in one ragged lattice (a longer word has one of its own).
LATTICE_CHARS = 100_000
#: Distinct words that a task holds before it passes on its counts.
HELD_WORDS = 250_000
#: Marks the start of a word in the vocabulary.
START = "▁"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, c): occurrences in all and in training documents; from (text, train)."""

    def flush(alls: Counter, train: Counter):
        words = list(alls)
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array(words, pa.binary()),
                "n": pa.array(alls.values(), pa.int64()),
                "c": pa.array([train[w] for w in words], pa.int64()),
            }
        )

    def count(batches):
        alls, train = Counter(), Counter()
        for b in row_slices(batches):
            for text, learn in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                alls.update(words)
                if learn:
                    train.update(words)
            if len(alls) > HELD_WORDS:
                yield from flush(alls, train)
                alls, train = Counter(), Counter()
        yield from flush(alls, train)

    counted = docs.select("text", "train").mapInArrow(count, "word binary, n long, c long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


class Vocabulary:
    """Pieces of a sentencepiece file; lives as long as a Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        self.size = n
        special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        self.byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.pieces = {m.id_to_piece(i): i for i in range(n) if not special[i] and not m.is_byte(i)}
        self._plant()

    def _plant(self):
        """The tree of the pieces' characters: sorted (node, character) keys, next nodes, pieces that end in a node."""
        nodes: dict[int, int] = {}
        ends = [-1]
        for piece, i in self.pieces.items():
            at = 0
            for char in piece:
                key = at << 21 | ord(char)
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = i
        self.keys = np.array(sorted(nodes), np.int64)
        self.next = np.array([nodes[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes reached by one more character, -1 where no piece goes on so."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def segment(self, words: list[str]) -> list[list[int]]:
        """The vocabulary's own best segmentation of each word."""
        return self.model.encode(words, num_threads=1)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """Counts of pieces in the training words; at most one entry for each piece of the file."""

    def count(batches):
        v = vocabulary(path)
        total = np.zeros(v.size, np.int64)
        for b in row_slices(batches, 4096):
            texts = [w.decode("utf-8") for w in b.column(0).to_pylist()]
            c = b.column(1).to_numpy(zero_copy_only=False)
            found = v.segment(texts)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
            np.add.at(total, ids, np.repeat(c, sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(at), "n": pa.array(total[at])})

    found = words.filter("c > 0").select("word", "c").mapInArrow(count, "piece long, n long")
    return {r["piece"]: r["n"] for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """The pieces at all places of some words, as edges of one ragged graph.

    A word of n characters (its start mark included) has n + 1 slots, which follow
    those of the word before.  ``ids`` beyond the vocabulary stand for the
    characters ``odd``, which have no piece.
    """

    def __init__(self, v: Vocabulary, words: list[str]):
        self.v = v
        marked = [START + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        self.last = self.first + size
        self.slots = int(size.sum()) + len(size)
        word = np.repeat(np.arange(len(size)), size)
        slot = np.arange(len(chars)) + word  # of each character
        left = self.last[word] - slot  # characters from here to the word's end
        found = []
        at, node, n = np.arange(len(chars)), np.zeros(len(chars), np.int64), 0
        while len(at):
            node = v.step(node, chars[at + n])
            at, node = at[node >= 0], node[node >= 0]
            n += 1
            here = v.ends[node] >= 0
            found.append((at[here], np.full(here.sum(), n), v.ends[node[here]]))
            more = left[at] > n
            at, node = at[more], node[more]
        plain = np.zeros(len(chars), bool)
        plain[found[0][0]] = True
        at = np.flatnonzero(~plain)
        self.odd, which = np.unique(chars[at], return_inverse=True)
        found.append((at, np.ones(len(at), np.int64), v.size + which))
        at, n, self.ids = (np.concatenate(c) for c in zip(*found, strict=True))
        self.start, self.end, self.word = slot[at], slot[at] + n, word[at]
        self.offset = self.start - self.first[self.word]

    def weights(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of every edge."""
        spelled = [sum(log_p[self.v.byte_ids[b]] for b in chr(c).encode("utf-8")) for c in self.odd.tolist()]
        return np.concatenate([log_p, spelled])[self.ids]

    def _swept(self, weight: np.ndarray, origin: np.ndarray, source: np.ndarray, target: np.ndarray, step: np.ndarray):
        """Log sums over all paths from ``origin`` to every slot; edges are taken by rising ``step``, a word's own count."""
        total = np.full(self.slots, -np.inf)
        total[origin] = 0.0
        order = np.lexsort((target, step))
        step, target, source, weight = step[order], target[order], source[order], weight[order]
        group = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])  # edges into one slot
        bounds = np.flatnonzero(np.r_[True, step[group[1:]] != step[group[:-1]], True])
        limits = np.append(group, len(order))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            lo, hi = limits[a], limits[b]
            total[target[group[a:b]]] = np.logaddexp.reduceat(total[source[lo:hi]] + weight[lo:hi], group[a:b] - lo)
        return total

    def forward(self, weight: np.ndarray) -> np.ndarray:
        return self._swept(weight, self.first, self.start, self.end, self.end - self.first[self.word])

    def backward(self, weight: np.ndarray) -> np.ndarray:
        return self._swept(weight, self.last, self.end, self.start, self.last[self.word] - self.start)

    def log_probabilities(self, log_p: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        return self.forward(self.weights(log_p))[self.last]

    def expected(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts of the vocabulary's pieces in the words taken ``times`` each, in parts of ``1 / UNIT``."""
        weight = self.weights(log_p)
        to, since = self.forward(weight), self.backward(weight)
        share = np.exp(to[self.start] + weight + since[self.end] - to[self.last[self.word]])
        parts = np.rint(share * times[self.word] * UNIT).astype(np.int64)
        total = np.zeros(self.v.size + len(self.odd), np.int64)
        np.add.at(total, self.ids, parts)
        for c, n in zip(self.odd.tolist(), total[self.v.size :], strict=True):
            for b in chr(c).encode("utf-8"):
                total[self.v.byte_ids[b]] += n
        return total[: self.v.size]


def lattices(v: Vocabulary, words: list[str]):
    """(first word, word after the last, lattice) of successive words, few enough to hold at once."""
    at, chars = 0, 0
    for i, w in enumerate(words):
        if i > at and chars + len(w) > LATTICE_CHARS:
            yield at, i, Lattice(v, words[at:i])
            at, chars = i, 0
        chars += len(w)
    if words:
        yield at, len(words), Lattice(v, words[at:])


def expected_counts(words: DataFrame, log_p: np.ndarray, path: str) -> dict[int, float]:
    """Expected counts of pieces over the training words; at most one entry for each piece of the file."""
    shared = words.sparkSession.sparkContext.broadcast(log_p.tolist())

    def count(batches):
        v, p = vocabulary(path), np.array(shared.value)
        total = np.zeros(v.size, np.int64)
        for b in row_slices(batches, 8192):
            times = b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, lattice in lattices(v, [w.decode("utf-8") for w in b.column(0).to_pylist()]):
                total += lattice.expected(p, times[lo:hi])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(at), "n": pa.array(total[at])})

    found = words.filter("c > 0").select("word", "c").mapInArrow(count, "piece long, n long")
    return {r["piece"]: r["n"] / UNIT for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect()}


def train(words: DataFrame, documents: int, path: str) -> tuple[np.ndarray, float]:
    """log probabilities of all pieces, and of the end symbol."""
    size, end = vocabulary(path).size, documents + ALPHA

    def probabilities(found: dict[int, float]) -> tuple[np.ndarray, float]:
        counts = np.full(size, ALPHA)
        for i, n in found.items():
            counts[i] += n
        total = counts.sum() + end
        return np.log(counts / total), math.log(end / total)

    log_p, end_log_p = probabilities(piece_counts(words, path))
    for _ in range(ROUNDS):
        log_p, end_log_p = probabilities(expected_counts(words, log_p, path))
    return log_p, end_log_p


def score_words(words: DataFrame, log_p: np.ndarray, path: str) -> DataFrame:
    """Adds ``lattice``: log10 of each distinct word's marginal probability."""
    shared = words.sparkSession.sparkContext.broadcast(log_p.tolist())

    def score(batches):
        v, p = vocabulary(path), np.array(shared.value)
        for b in row_slices(batches, 8192):
            texts = [w.decode("utf-8") for w in b.column(0).to_pylist()]
            out = [x.log_probabilities(p) / math.log(10) for _, _, x in lattices(v, texts)]
            out = pa.array(np.concatenate(out) if out else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=["word", "n", "c", "lattice"])

    return words.select("word", "n", "c").mapInArrow(score, "word binary, n long, c long, lattice double")


def frequent_words(words: DataFrame, head: int) -> DataFrame:
    """The most frequent words, at most ``head``: whole bins of similar counts, from the top.

    Bins of counts find the limit, so that no task has to rank the words.
    """
    size = F.floor(F.log2("n") * COUNT_BINS).cast("int")
    bins = words.groupBy(size.alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect()  # 64 * COUNT_BINS at most
    least, taken = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        taken += r["words"]
        if taken > head:
            break
        least = r["bin"]
    return words.filter(size >= least) if least is not None else words.limit(0)


def lm_scores(
    docs: DataFrame, train_row: Column, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD
) -> DataFrame:
    """One row per document.

    doc_id, train, n_tokens, n_known, train_tokens, base_score, score.
    ``train_row`` tells the documents to learn from.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), train_row.alias("train"))
    counted = materialize(word_counts(picked), "word-counts")
    documents = picked.filter("train").count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train_tokens = total + documents
    base_total = train_tokens + distinct + (1 if documents else 0) + 1
    log_p, end_log_p = train(counted, documents, path)
    words = materialize(
        score_words(counted, log_p, path).withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(base_total)))), "words"
    )
    table = {bytes(r["word"]): (r["c"] > 0, r["base"], r["lattice"]) for r in frequent_words(words, head).collect()}
    frequent = spark.sparkContext.broadcast(table)
    end = (documents > 0, math.log10((documents + 1) / base_total), end_log_p / math.log(10))

    def look_up(batches):
        known = frequent.value
        for b in row_slices(batches):
            n, k, base, lattice, rest = [], [], [], [], []
            for text in b.column(1).to_pylist():
                words = Counter(words_of(text))
                sums, tail = [1, int(end[0]), end[1], end[2]], []
                for w, c in words.items():
                    hit = known.get(w)
                    sums[0] += c
                    if hit is None:
                        tail.append((w, c))
                    else:
                        sums[1] += c * hit[0]
                        sums[2] += c * hit[1]
                        sums[3] += c * hit[2]
                for column, x in zip((n, k, base, lattice), sums, strict=True):
                    column.append(x)
                rest.append(tail)
            offsets = np.r_[0, np.cumsum([len(t) for t in rest])].astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array([w for t in rest for w, _ in t], pa.binary()), pa.array([c for t in rest for _, c in t], pa.int32())],
                names=["word", "times"],
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(lattice, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                names=["doc_id", "train", "n_tokens", "known", "base", "lattice", "rest"],
            )

    schema = (
        f"doc_id {kind}, train boolean, n_tokens long, known long, base double, lattice double, "
        "rest array<struct<word:binary,times:int>>"
    )
    looked = picked.mapInArrow(look_up, schema).withColumn("row_id", F.monotonically_increasing_id())
    looked = materialize(looked, "looked-up")
    tail = looked.select("row_id", F.explode("rest").alias("r")).select("row_id", "r.word", "r.times")
    tail = tail.join(words.select("word", "c", "base", "lattice"), "word").groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.col("base")).alias("tail_base"),
        F.sum(F.col("times") * F.col("lattice")).alias("tail_lattice"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return looked.drop("rest").join(tail, "row_id", "left").select(
        "doc_id",
        "train",
        "n_tokens",
        plus("known", "tail_known").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        plus("base", "tail_base").alias("base_score"),
        plus("lattice", "tail_lattice").alias("score"),
    )
