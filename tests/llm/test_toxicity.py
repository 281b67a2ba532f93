import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity as T
from quarry.llm.common import fold

LABELS = "doc_id long, quality int, toxic int"


def named(vector):
    return dict(zip(T.FEATURES, vector, strict=True))


def test_features():
    x = T.Extractor({"blorg": 3.0, "blor~": 2.0, "vequ~": 4.5})
    f = named(x.features("You are a MORON and a blorgish vequel, aren't you?! Nooo1 l.o.s.e.r st0pid stup1d"))
    assert f["insults"] > 0 and f["near_you"] > 0 and f["you"] > 0 and f["capital_words"] > 0
    assert f["terms"] > 0 and f["top_term"] == 4.5 and f["hidden_insults"] > 0 and f["spaced_words"] > 0
    assert f["mixed_words"] > 0 and f["drawn_out"] > 0 and f["repeated_marks"] > 0 and f["digits"] > 0
    clean = named(x.features("a calm and tidy sentence about the weather"))
    assert clean["insults"] == clean["terms"] == clean["near_you"] == clean["hidden_insults"] == 0
    far = named(x.features("you " + "word " * 50 + "idiot"))
    assert far["insults"] > 0 and far["near_you"] == 0
    for text in (None, "", " \n", "123 !!"):
        assert x.features(text) == [0.0] * len(T.FEATURES)


def test_cache_limit_changes_nothing(monkeypatch):
    texts = [" ".join(random.Random(i).choices(["you", "idiot", "tree", "blorg", "x"], k=20)) for i in range(30)]
    want = [T.Extractor({"blorg": 3.0}).features(t) for t in texts]
    monkeypatch.setattr(T, "CACHE_WORDS", 2)
    x = T.Extractor({"blorg": 3.0})
    assert [x.features(t) for t in texts] == want


def test_trees_learn_what_one_split_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    b = T.Boosted().fit(x, y)
    assert ((b.raw(x) > 0) == y).mean() > 0.97


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(1)
    raw = np.round(rng.random(200), 2)
    y = (rng.random(200) < raw).astype(float)
    got = np.interp(raw, *T.isotonic(raw, y))
    values = np.unique(raw)
    sums, n = np.array([y[raw == v].sum() for v in values]), np.array([(raw == v).sum() for v in values])
    want = [
        max(min(sums[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(values))) for i in range(k + 1))
        for k in range(len(values))
    ]  # min-max formula
    assert got == pytest.approx(np.array(want)[np.searchsorted(values, raw)])


def corpus(seed, n):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "lo", "mir", "tes", "gol", "pan") for b in ("an", "er", "ist", "om", "uk")]
    slurs = ["zogblat", "zogbler", "zogblun", "krazfid", "krazfon"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice([*slurs, "idiot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus(5, 600)
    held = fold(F.col("doc_id"), 5) == 0
    # Labels of held-out rows are turned round: they must not be used.
    turned = [(i, q, t) for i, q, t in labels]
    ids = {r.doc_id for r in make_docs(rows).filter(held).select("doc_id").collect()}
    turned = [(i, q, 1 - t if i in ids else t) for i, q, t in labels]
    got = T.toxicity(make_docs(rows), spark.createDataFrame(turned, LABELS), ~held).collect()
    right = [r.predicted == labels[r.doc_id][2] for r in got if r.doc_id in ids]
    assert len(got) == 600 and sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_odd_rows(spark, make_docs):
    rows, labels = corpus(6, 120)
    extra = [(None, "idiot you idiot"), (500, None), (501, ""), (0, rows[0][1]), (502, "you idiot " * 30_000), (503, "no label")]
    labels += [(None, 1, 1), (500, 1, 0), (501, None, None), (0, 1, 0), (999, 1, 1)]
    docs = make_docs(rows + extra).withColumn("toxic", F.lit("clash"))
    got = T.toxicity(docs, spark.createDataFrame(labels, LABELS), F.lit(True)).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert T.toxicity(make_docs([]), spark.createDataFrame([], LABELS), F.lit(True)).collect() == []


@pytest.mark.parametrize("toxic,score", [(0, 0.0), (1, 1.0)])
def test_one_class_and_no_labels(spark, make_docs, toxic, score):
    rows = [(i, f"text {i}") for i in range(5)]
    got = T.toxicity(make_docs(rows), spark.createDataFrame([(i, 1, toxic) for i in range(5)], LABELS), F.lit(True)).collect()
    assert {r.score for r in got} == {score}
    none = T.toxicity(make_docs(rows), spark.createDataFrame([], LABELS), F.lit(True)).collect()
    assert {r.score for r in none} == {0.0}


def letters_of(text):
    """Runs of letters and where they start."""
    runs, here = [], ""
    for at, c in enumerate(text + " "):
        if c.isalnum() and not c.isdecimal():
            here += c
        elif here:
            runs.append((at - len(here), here))
            here = ""
    return runs


def plain_features(text, weights):
    """The features by loops over characters and words."""
    text = text or ""
    words = [w for _, w in letters_of(text)]
    n, low = len(words), [w.lower() for _, w in letters_of(text)]
    if not n:
        return dict.fromkeys(T.FEATURES, 0.0)

    def weight(w):
        return max([weights.get(w, 0.0)] + [weights.get(w[:k] + "~", 0.0) for k in T.BEGINNINGS if len(w) > k])

    def bad(w):
        return weight(w) > 0 or w in T.INSULTS

    told = [weight(w) for w in low if weight(w)]
    you = [i for i, w in enumerate(low) if w in T.SECOND_PERSON]
    near = sum(any(abs(i - j) <= T.NEAR for j in you) for i, w in enumerate(low) if bad(w))
    mixed, taken = [], 0
    for at, w in letters_of(text):
        end = at + len(w)
        to = end
        while to < len(text) and text[to] in "@$*!0134579":
            to += 1
        after = [x for s, x in letters_of(text) if s == to]
        if at >= taken and to > end and after:
            mixed.append(text[at : to + len(after[0])])
            taken = to + len(after[0])
    drawn = 0
    for w in words:
        i = 0
        while i + 2 < len(w):
            same = w[i] == w[i + 1] == w[i + 2]
            drawn += same
            i += 3 if same else 1
    marks, i = 0, 0
    while i < len(text):
        kind = next((k for k in ("!?.", "#$%&*") if text[i] in k), None)
        to = i + 1
        while kind and to < len(text) and text[to] in kind:
            to += 1
        marks += bool(kind) and to - i > 1
        i = to
    capital = [[c for c in w if "A" <= c <= "Z" or "À" <= c <= "Þ"] for w in words]
    leet = dict(zip("@$!0134579*", "asioieastgu", strict=True))
    size = sum(map(len, words))
    return {
        "log_words": math.log1p(n), "insults": 100 * sum(w in T.INSULTS for w in low) / n, "terms": 100 * len(told) / n,
        "heavy_terms": 100 * sum(w >= 2 * T.MIN_WEIGHT for w in told) / n, "top_term": max(told, default=0.0),
        "mean_term": sum(told) / n,
        "hidden_insults": 100 * sum(bad("".join(leet.get(c, c) for c in m.lower())) for m in mixed) / n,
        "near_you": 100 * near / n, "you": 100 * len(you) / n,
        "capital_words": 100 * sum(len(c) == len(w) > 1 for c, w in zip(capital, words, strict=True)) / n,
        "capital_letters": 100 * sum(map(len, capital)) / size, "exclamations": 100 * text.count("!") / len(text),
        "questions": 100 * text.count("?") / len(text),
        "punctuation": 100 * sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / len(text),
        "repeated_marks": 100 * marks / n, "mixed_words": 100 * len(mixed) / n, "spaced_words": 0.0,
        "drawn_out": 100 * drawn / n, "digits": 100 * sum(c in "0123456789" for c in text) / len(text), "word_length": size / n,
    }


def test_features_against_loops():
    weights = {"blorg": 3.0, "blor~": 2.0, "vequ~": 4.5, "stupid": 2.5}
    x, rng = T.Extractor(weights), random.Random(3)
    parts = ["you", "Blorgish", "IDIOT", "st0pid", "a1b2c", "id!ot", "sooo", "EEEE", "élan", "ÀÉ", "vequel", "tree", "the", "x_y",
             "12", "!!", "?!.", "$$", ".", "#*!!", "-", "_", "naïve", "ein", "dich", "a$$hole", "ß", "日本日日日"]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice([" ", "  ", ", ", "! ", "\n", ""]) for _ in range(rng.randint(0, 40)))
        if T._SPACED.search(text):
            continue  # the loops leave spaced words out; test_features has one
        got, want = named(x.features(text)), plain_features(text, weights)
        assert got == pytest.approx(want), text


def test_whole_result_against_plain_steps(spark, make_docs):
    """Terms, features, trees and calibration by plain loops, for every row of the result."""
    rows, labels = corpus(9, 240)
    held = fold(F.col("doc_id"), 5) == 0
    docs = make_docs([*rows, (240, None), (241, "You IDIOT, you zogblat!")])
    frame = spark.createDataFrame(labels, LABELS)
    sample = T.labelled_sample(docs.select("doc_id", "text"), frame, ~held)
    halves = {r.doc_id: (r.half, r.toxic) for r in sample.collect()}
    assert set(halves) == {r.doc_id for r in docs.filter(~held).collect()} - {240, 241}
    texts = dict([*rows, (240, None), (241, "You IDIOT, you zogblat!")])

    def terms(ids):
        counts = {}
        for i in ids:
            for t in {t for _, w in letters_of(texts[i].lower()) for t in T.terms_of(w)}:
                counts.setdefault(t, [0, 0])[halves[i][1]] += 1
        size = [sum(halves[i][1] == t for i in ids) for t in (0, 1)]
        weight = {t: math.log((b + 0.5) / (size[1] + 1)) - math.log((a + 0.5) / (size[0] + 1)) for t, (a, b) in counts.items()}
        return {t: round(w, 6) for t, w in weight.items() if counts[t][1] >= T.MIN_TOXIC and w >= T.MIN_WEIGHT}

    def vector(i, weights):
        return list(plain_features(texts[i], weights).values())

    ids = sorted(halves, key=str)
    lexicon = [terms([i for i in ids if halves[i][0] == h]) for h in (0, 1)]
    whole = terms(ids)
    assert T.learn_terms(sample) == [lexicon[0], lexicon[1], whole]
    x = np.array([vector(i, lexicon[1 - halves[i][0]]) for i in ids])
    y, half = np.array([halves[i][1] for i in ids], float), np.array([halves[i][0] for i in ids])

    def walk(trees, v):
        raw = trees.start
        for (features, limits), leaf in zip(trees.splits, trees.leaves, strict=True):
            node = 0
            for feature, limit in zip(features, limits, strict=True):
                node = 2 * node + int(v[feature[node]] > limit[node])
            raw += leaf[node]
        return raw

    fits = [T.Boosted().fit(x[half != h], y[half != h]) for h in (0, 1)]
    knots = T.isotonic(np.array([walk(fits[h], v) for h, v in zip(half, x, strict=True)]), y)
    last = T.Boosted().fit(x, y)
    want = {i: min(max(float(np.interp(walk(last, vector(i, whole)), *knots)), 0.0), 1.0) for i in texts}
    got = {r.doc_id: r for r in T.toxicity(docs, frame, ~held).collect()}
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-6)
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
