"""Periodic runs of words: seed-and-extend along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) that no neighbouring word extends, of at least ``max(SHORTEST,
POWERS * q)`` words.  Its overlap with itself q words on is at least
``max(SHORTEST - q, (POWERS - 1) * q)`` words.

Lags are taken in classes [2**j, 2**(j+1)).  Within a class a run's overlap is
guaranteed to hold k words, the least overlap of its lags, and k is no less
than any lag of the class, so that inside a run a k-gram occurs again exactly
one period later and not before.  So the k-grams of each class are indexed,
neighbouring occurrences of one gram in one document whose distance is a lag of
the class are the seeds, and every run has one; a document of n words has at
most n seeds in a class and log n classes, however often words repeat.  A seed
is extended to both sides along its diagonal (position, position + lag); of
each lag the furthest word covered is kept, and seeds before it are skipped, as
they lie on a diagonal stretch that was extended already.

Grams are compared exactly, not by hashes: their ranks double in length from
class to class, and positions whose gram occurs once in its document are left
out of longer ones, so most texts are done after a few short steps.

How it runs: texts are mapped in batches without a shuffle; a batch's words are
numbered and its grams ranked in numpy together, with words of different
documents kept apart.  Memory is linear in the words of a batch of rows.

Cases: a null or blank text has no words, no run and collapses to the empty
text; a null id has no hash, so its text is never made periodic; repeated rows
give equal results; a batch with one very long text is cut down to a few
texts; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import row_slices

#: Words and periods that a run holds at least.
SHORTEST = 6
POWERS = 4
#: Characters of texts that are looked at together, unless one text has more.
BATCH_CHARS = 1 << 21


def least_overlap(j: int) -> int:
    """The words that any run with a lag in [2**j, 2**(j+1)) shares with itself one period on.

    The class of lag 1 has that lag alone; in others the smallest lag shares least.
    """
    q = 1 << j
    return max(SHORTEST - q, (POWERS - 1) * q)


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal pairs, and whether a pair occurs more than once."""
    key = first * (second.max(initial=0) + 1) + second
    _, rank, count = np.unique(key, return_inverse=True, return_counts=True)
    return rank, count[rank] > 1


def _paired(rank: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """Of the positions ``at`` those whose gram, and that ``shift`` words on, are ranked."""
    at = at[at + shift < len(rank)]
    return at[rank[at + shift] >= 0]


def seeds(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(lags, positions), sorted, of neighbouring equal grams; ``words`` are numbered by document.

    ``longest`` is the number of words of the longest document.
    """
    rank, twice = _ranks(np.zeros(len(words), np.int64), words)
    rank[~twice] = -1
    at = np.flatnonzero(twice)
    length, lags, places = 1, [], []
    j = 0
    while len(at) and (POWERS << j) <= longest:
        k = least_overlap(j)
        while 2 * length <= k and len(at):
            at = _paired(rank, at, length)
            grams, twice = _ranks(rank[at], rank[at + length])
            rank = np.full(len(words), -1, np.int64)
            at = at[twice]
            rank[at] = grams[twice]
            length *= 2
        start = _paired(rank, at, k - length)
        if len(start):
            grams, _ = _ranks(rank[start], rank[start + k - length])
            order = np.argsort(grams, kind="stable")
            grams, ordered = grams[order], start[order]
            lag = np.diff(ordered)
            seed = (grams[1:] == grams[:-1]) & (lag >= 1 << j) & (lag < 2 << j)
            lags.append(lag[seed])
            places.append(ordered[:-1][seed])
        j += 1
    if not lags:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lag, place = np.concatenate(lags), np.concatenate(places)
    order = np.lexsort((place, lag))
    return lag[order], place[order]


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """Leading equal elements, looked at in blocks that double."""
    done, block, n = 0, 16, min(len(a), len(b))
    while done < n:
        differ = a[done : min(done + block, n)] != b[done : min(done + block, n)]
        if differ.any():
            return done + int(differ.argmax())
        done, block = done + block, block * 2
    return n


def extended(words: np.ndarray, lag: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs that the seeds lie in."""
    found = []
    i = 0
    while i < len(lag):
        q = int(lag[i])
        last = int(np.searchsorted(lag, q, side="right"))  # seeds of this lag
        while i < last:
            x = int(place[i])
            right = x + _matching(words[x:], words[x + q :])
            left = x - _matching(words[:x][::-1], words[: x + q][::-1])
            if right + q - left >= max(SHORTEST, POWERS * q):
                found.append((left, right + q - left, q))
            i += int(np.searchsorted(place[i:last], right))  # covered up to ``right``
    return found


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """Of every tenth hash, the words are made periodic from some place on."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def texts_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start and period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    numbers: dict[bytes, int] = {}
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in texts for w in ws), np.int64, int(bounds[-1]))
    words += np.repeat(np.arange(len(texts)), sizes) * max(len(numbers), 1)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in extended(words, *seeds(words, int(sizes.max(initial=0)))):
        row = int(np.searchsorted(bounds, start, side="right")) - 1
        out[row].append((start - int(bounds[row]), length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without the words that follow a run's first period inside it."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def _groups(batches):
    """Row slices, cut further where their texts are long."""
    for b in row_slices(batches):
        sizes = [len(t or "") for t in b.column(2).to_pylist()]
        at = size = 0
        for i, mine in enumerate(sizes):
            if i > at and size + mine > BATCH_CHARS:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += mine
        yield b.slice(at)


def periodic_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period), collapsed.

    ``collapsed`` is the text without the repetitions.  With ``plant`` the words
    of every document are first made periodic as its id's crc32 says.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for b in _groups(batches):
            texts = [(t or "").encode("utf-8").split() for t in b.column(2).to_pylist()]  # ASCII white space
            if plant:
                keys = b.column(1).to_pylist()
                texts = [planted(ws, None if k is None else zlib.crc32(k.encode())) for k, ws in zip(keys, texts, strict=True)]
            runs = texts_runs(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(ws) for ws in texts], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": q} for s, n, q in rs] for rs in runs], pa.list_(run)),
                    pa.array([collapsed(ws, rs).decode("utf-8") for ws, rs in zip(texts, runs, strict=True)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return picked.mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    stronger = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # runs are sorted by start and period, so that of equals the first stays
    best = F.aggregate("runs", F.get("runs", 0), lambda a, b: F.when(stronger(b, a), b).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
