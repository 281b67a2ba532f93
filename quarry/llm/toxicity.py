"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (``FEATURES``): densities of lexicon words, their nearness to
second-person words, capitals, punctuation and obfuscation.  There are two
lexicons: insults listed here, and terms (words and their beginnings) that are
far more frequent in labelled toxic documents.  Labels, language, source and
id are no features.

Learning uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id, from the rows that the caller allows.  The sample is halved by
another hash: each half's features come from the terms learned on the other
half, each half's calibration scores from trees fitted on the other half; then
terms and trees are learned from the whole sample.  The sample's terms are
counted in Spark; only its features (``SAMPLE`` rows) and at most ``TERMS`` terms
reach the driver, where the trees are fitted.  Scoring is one pass over all
texts, in whole, without a shuffle.

Cases: null and empty texts have features 0 and a score like any other; a
label that is null is not used, several labels of one id count as toxic if one
does; ids without a label are only scored; with no toxic or no clean row to
learn from, every score is the share of toxic rows (0 without rows); repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, row_slices

SAMPLE = 20_000
#: Terms of the learned lexicon, candidates counted, and the support and log ratio that a term needs.
TERMS = 5_000
CANDIDATES = 50_000
MIN_TOXIC = 3
MIN_WEIGHT = 2.0
#: Lengths of word beginnings that are terms too.
BEGINNINGS = (4, 5, 6)

TREES, DEPTH, RATE, BINS, L2 = 80, 3, 0.15, 32, 1.0
NEAR = 5
CACHE_WORDS = 200_000

INSULTS = frozenset(
    """
    idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers pathetic worthless trash garbage scum
    clown clowns disgusting filthy vile vermin imbecile cretin fool fools jerk creep creepy freak pig pigs rat rats
    bastard bitch whore slut asshole ass shit shitty crap fuck fucking fucker motherfucker cunt dick prick twat wanker
    retard retarded degenerate subhuman parasite coward liar ugly fat hate hateful die kill
    idiote imbécile crétin crétine abruti connard connasse salaud salope ordure pourriture merde putain débile minable
    raclure bouffon ignoble dégoûtant
    dummkopf trottel depp vollidiot arschloch scheiße scheisse abschaum wichser hurensohn schlampe miststück dreckig
    widerlich erbärmlich wertlos versager
    idiota imbécil estúpido estúpida tonto pendejo cabrón gilipollas mierda puta puto escoria basura asqueroso
    patético inútil perdedor cerdo
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself u ur ya youre du dich dir dein deine deinen deiner euch euer ihr tu toi ton ta tes vous votre
    vos tú ti tuyo tus usted ustedes vosotros
    """.split()
)
FEATURES = (
    "log_words", "insults", "terms", "heavy_terms", "top_term", "mean_term", "hidden_insults", "near_you", "you",
    "capital_words", "capital_letters", "exclamations", "questions", "punctuation", "repeated_marks", "mixed_words",
    "spaced_words", "drawn_out", "digits", "word_length",
)

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]+[@$*!0134579]+[^\W\d_]+")
_INSIDE = re.compile(r"[@$*!0134579](?=[^\W\d_])")  # in every mixed word
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![^\W_])")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_MARKS = re.compile(r"[!?.#$%&*][!?.#$%&*]+")  # around all repeated marks
_REPEATED = re.compile(r"[!?.]{2,}|[#$%&*]{2,}")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[^\w\s]")
_LEET = str.maketrans("@$!0134579*", "asioieastgu")


def terms_of(word: str) -> list[str]:
    """A lower-case word and its beginnings, which end in a mark of their own."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


class WordFacts(dict):
    """Facts of a word as it is written, made once; None for the many words that say nothing.

    (weight of the strongest term, insult, second person, capital letters, drawn-out letters, letters)
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str):
        low = word.lower()
        weight = max((self.weights.get(t, 0.0) for t in terms_of(low)), default=0.0)
        capitals, drawn = len(_CAPITAL.findall(word)), len(_DRAWN.findall(word))
        facts = (weight, low in INSULTS, low in SECOND_PERSON, capitals, drawn, len(word))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = facts if any(facts[:5]) or len(word) == 1 else None
        return out


class Extractor:
    """Feature vectors, given the learned terms and their weights."""

    def __init__(self, weights: dict[str, float]):
        self.facts = WordFacts(weights)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        found = _WORD.findall(text)
        n = len(found)
        if not n:
            return [0.0] * len(FEATURES)
        look_up = self.facts.__getitem__
        told = [(i, x) for i, x in enumerate(map(look_up, found)) if x]
        weights = [x[0] for _, x in told if x[0]]
        hits = [i for i, x in told if x[0] or x[1]]
        you = [i for i, x in told if x[2]]
        near = 0
        if hits and you:
            at = np.searchsorted(you, hits)
            marks = np.array([-10 * NEAR, *you, n + 10 * NEAR])
            near = int((np.minimum(np.array(hits) - marks[at], marks[at + 1] - np.array(hits)) <= NEAR).sum())
        mixed = _MIXED.findall(text) if _INSIDE.search(text) else []
        single = [i for i, x in told if x[5] == 1]
        # Three single letters in a row are in every spaced word.
        spaced = _SPACED.findall(text) if any(c - a == 2 for a, c in zip(single, single[2:], strict=False)) else []
        hidden = [m.lower().translate(_LEET) for m in mixed] + [re.sub(r"[^\w]|_", "", m).lower() for m in spaced]
        letters = sum(map(len, found))
        chars = len(text)
        return [
            math.log1p(n),
            100 * sum(x[1] for _, x in told) / n,
            100 * len(weights) / n,
            100 * sum(w >= 2 * MIN_WEIGHT for w in weights) / n,
            max(weights, default=0.0),
            sum(weights) / n,
            100 * sum(bool(x and (x[0] > 0 or x[1])) for x in map(look_up, hidden)) / n,
            100 * near / n,
            100 * len(you) / n,
            100 * sum(x[3] == x[5] > 1 for _, x in told) / n,
            100 * sum(x[3] for _, x in told) / letters,
            100 * text.count("!") / chars,
            100 * text.count("?") / chars,
            100 * len(_PUNCTUATION.findall(text)) / chars,
            100 * sum(len(_REPEATED.findall(m)) for m in _MARKS.findall(text)) / n,
            100 * len(mixed) / n,
            100 * len(spaced) / n,
            100 * sum(x[4] for _, x in told) / n,
            100 * sum(map(text.count, "0123456789")) / chars,
            letters / n,
        ]


class Boosted:
    """Gradient-boosted trees of equal depth for a 0/1 label, over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.start, self.splits, self.leaves = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)])
        raw = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            slope, bend = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            features, limits = [], []
            for level in range(self.depth):
                feature, place = self._best(binned, node, 1 << level, slope, bend)
                features.append(feature)
                limits.append(
                    [cuts[f][b] if b >= 0 and b < len(cuts[f]) else np.inf for f, b in zip(feature, place, strict=True)]
                )
                node = 2 * node + (x[np.arange(len(y)), feature[node]] > np.array(limits[-1])[node])
            size = 1 << self.depth
            leaf = -self.rate * np.bincount(node, slope, size) / (np.bincount(node, bend, size) + L2)
            self.splits.append((features, [np.array(v) for v in limits]))
            self.leaves.append(leaf)
            raw += leaf[node]
        return self

    @staticmethod
    def _best(binned, node, nodes, slope, bend):
        """For each node the feature and bin with the largest gain; bin -1: no split."""
        gain = np.zeros(nodes)
        feature, place = np.zeros(nodes, np.int64), np.full(nodes, -1, np.int64)
        for f, column in enumerate(binned):
            key = node * BINS + column
            g = np.bincount(key, slope, nodes * BINS).reshape(nodes, BINS)
            h = np.bincount(key, bend, nodes * BINS).reshape(nodes, BINS)
            gl, hl = g.cumsum(1), h.cumsum(1)
            gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
            score = gl**2 / (hl + L2) + gr**2 / (hr + L2) - gl[:, -1:] ** 2 / (hl[:, -1:] + L2)
            score[(hl < 0.5) | (hr < 0.5)] = 0
            at = score.argmax(1)
            best = score[np.arange(nodes), at]
            better = best > gain + 1e-9
            gain[better], feature[better], place[better] = best[better], f, at[better]
        return feature, place

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for (features, limits), leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for feature, limit in zip(features, limits, strict=True):
                node = 2 * node + (x[rows, feature[node]] > limit[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw score, share of 1) of a rising function."""
    values, at = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []  # sum of labels, weight, first and last raw score
    for value, total, n in zip(values, np.bincount(at, y), np.bincount(at), strict=True):
        blocks.append([float(total), float(n), value, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, _, last = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = [(x, s / w) for s, w, a, b in blocks for x in ((a,) if a == b else (a, b))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    def __init__(self, weights: dict[str, float], trees: Boosted | None, knots, share: float):
        self.weights, self.trees, self.knots, self.share = weights, trees, knots, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, half) of at most ``rows`` labelled documents; ``allowed`` is over doc_id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(allowed)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Hashes are spread evenly: a bound on them leaves about twice the rows wanted, whatever the
    # number of labels, and only those are ranked.
    share = min(1.0, 2 * rows / max(known.count(), 1))
    low = known.filter(F.xxhash64("doc_id") <= F.lit(int((share - 0.5) * (2**64 - 1))).cast("long")) if share < 1 else known
    chosen = low.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    half = F.pmod(F.xxhash64(F.concat(F.lit("half"), F.col("doc_id").cast("string"))), F.lit(2)).cast("int")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return materialize(found.withColumn("half", half), "labelled-sample")


def learn_terms(sample: DataFrame) -> list[dict[str, float]]:
    """Weights of terms learned on half 0, on half 1 and on both."""
    # Terms of the toxic texts come first; clean texts are asked for those alone.
    first = _term_counts(sample.filter("toxic = 1"), None)
    found = (
        first.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TOXIC)
        .orderBy(F.col("n").desc(), "term").limit(CANDIDATES)
    )
    candidates = frozenset(r["term"] for r in found.collect())
    counts = {(r["term"], r["half"], r["toxic"]): r["n"] for r in _collect(_term_counts(sample, candidates))}
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    out = []
    for halves in ((0,), (1,), (0, 1)):
        total = [sum(sizes.get((h, t), 0) for h in halves) for t in (0, 1)]
        weights = {}
        for term in candidates:
            clean, toxic = (sum(counts.get((term, h, t), 0) for h in halves) for t in (0, 1))
            weight = math.log((toxic + 0.5) / (total[1] + 1)) - math.log((clean + 0.5) / (total[0] + 1))
            if toxic >= MIN_TOXIC and weight >= MIN_WEIGHT:
                weights[term] = (toxic * weight, weight)
        best = sorted(weights, key=lambda t: (-weights[t][0], t))[:TERMS]
        out.append({t: round(weights[t][1], 6) for t in best})
    return out


def _collect(counts: DataFrame) -> list:
    # At most CANDIDATES terms, two halves and two labels.
    return counts.groupBy("term", "half", "toxic").agg(F.sum("n").alias("n")).collect()


def _term_counts(sample: DataFrame, only: frozenset | None) -> DataFrame:
    """Documents that hold each term, by half and label; counted per task."""
    shared = sample.sparkSession.sparkContext.broadcast(only)

    def count(batches):
        wanted, seen = shared.value, Counter()
        for b in row_slices(batches):
            for text, half, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
                terms = {t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)}
                seen.update((t, half, toxic) for t in (terms if wanted is None else terms & wanted))
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array([k[0] for k in seen], pa.string()),
                "half": pa.array([k[1] for k in seen], pa.int32()),
                "toxic": pa.array([k[2] for k in seen], pa.int32()),
                "n": pa.array(seen.values(), pa.int64()),
            }
        )

    return sample.select("text", "half", F.col("toxic").cast("int")).mapInArrow(
        count, "term string, half int, toxic int, n long"
    )


def sample_features(sample: DataFrame, by_half: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and halves; ``by_half``: the terms to use for each half."""
    shared = sample.sparkSession.sparkContext.broadcast(by_half)

    def work(batches):
        extractors = [Extractor(w) for w in shared.value]
        for b in row_slices(batches):
            texts, halves = b.column(0).to_pylist(), b.column(1).to_pylist()
            x = [extractors[h].features(t) for t, h in zip(texts, halves, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2), b.column(3)], names=["x", "half", "toxic", "id"]
            )

    rows = (
        sample.select("text", "half", F.col("toxic").cast("int"), F.col("doc_id").cast("string"))
        .mapInArrow(work, "x array<double>, half int, toxic int, id string")
        .collect()
    )
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return x, np.array([r["toxic"] for r in rows], float), np.array([r["half"] for r in rows])


def train(sample: DataFrame) -> Model:
    terms = learn_terms(sample)
    x, y, half = sample_features(sample, [terms[1], terms[0]])
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model({}, None, None, share)
    raw = np.zeros(len(y))
    for h in (0, 1):
        here = half == h
        if here.any():
            other = ~here if 0 < y[~here].sum() < (~here).sum() else np.ones(len(y), bool)
            raw[here] = Boosted().fit(x[other], y[other]).raw(x[here])
    return Model(terms[2], Boosted().fit(x, y), isotonic(raw, y), share)


def toxicity(
    docs: DataFrame, labels: DataFrame, allowed: Column, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs``.

    ``labels`` has doc_id and toxic; ``allowed`` (over doc_id) tells the rows to learn from.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(labelled_sample(picked, labels.select("doc_id", "toxic"), allowed, sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        extractor = Extractor(m.weights)
        for b in row_slices(batches):
            x = np.array([extractor.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            score = m.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return picked.mapInArrow(work, f"doc_id {kind}, score double, predicted int")
