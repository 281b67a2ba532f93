import math
import random
import re
import unicodedata
from collections import Counter

import pytest

from quarry.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def counts(text):
    text = text or ""
    w = re.findall(WORD, text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed,
    )


def histograms(text, lang):
    text = text or ""
    cls = Counter()
    for c in text:
        k = unicodedata.category(c)
        if k == "Ll":
            cls["lower"] += 1
        elif c in " \t\n\x0b\f\r":
            cls["space"] += 1
        elif k == "Lu":
            cls["upper"] += 1
        elif c in ".,;:!?'\"()-":
            cls["stop"] += 1
        elif k[0] == "N":
            cls["digit"] += 1
        elif k[0] == "L":
            cls["letter"] += 1
        else:
            cls["rest"] += 1
    names = ("lower", "space", "upper", "stop", "digit", "letter", "rest")
    listed = Q.COMMON_WORDS.get(lang)
    if not listed:
        return [cls[n] for n in names], None
    found = Counter(w for w in re.findall(r"[^\W_]+", text.lower()) if w in listed)
    n = len(re.findall(WORD, text))
    bins = [found[w] for w in listed] + [0] * (Q.BINS - len(listed))
    return [cls[n] for n in names], bins + [max(n - sum(bins), 0)]


def distance(p, q):
    sp, sq = sum(p), sum(q)
    total = 0.0
    for a, b in zip(p, q, strict=True):
        a, b = a / sp, b / sq
        total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x > 0) / 2
    return math.sqrt(max(total, 0))


def text_of(rng, lang, n, common=0.4):
    words = [f"{a}{b}" for a in ("ba", "lo", "mir", "tes", "gol") for b in ("an", "er", "ist", "om", "uk", "ell")]
    out = []
    for i in range(n):
        w = rng.choice(Q.COMMON_WORDS[lang][:12]) if rng.random() < common else rng.choice(words) + rng.choice(words)
        out.append(w + rng.choice(["", "", "", "", ",", "."]) + ("\n" if i % 17 == 16 else ""))
    return " ".join(out)


def corpus():
    rng = random.Random(11)
    rows = [(i, text_of(rng, lang, rng.randint(30, 400)), lang, "s") for i, lang in enumerate(["en", "fr", "de", "es"] * 30)]
    rows += [(200 + i, text_of(rng, "en", 200), "xx" if i % 2 else None, "s") for i in range(6)]
    rows += [
        (300, text_of(rng, "en", 300).upper().replace(" ", "!! "), "en", "s"),
        (301, "#$%& ".join(text_of(rng, "en", 300).split()), "en", "s"),
        (302, " ".join(f"Zq{i}xk" for i in range(400)), "en", "s"),
        (303, "same three words " * 100, "en", "s"),
        (304, "a line here\n\na line here\n a line here\n" + text_of(rng, "de", 90), "de", "s"),
    ]
    return rows


def test_counts_distances_and_verdicts(make_docs):
    rows = corpus()
    got = {r.doc_id: r for r in Q.quality_rules(make_docs(rows)).collect()}
    base = {i: counts(t) for i, t, *_ in rows}
    for i, want in base.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
    hist = {i: histograms(t, lang) for i, t, lang, _ in rows}
    passed = [(i, lang if lang in Q.COMMON_WORDS else "") for i, _, lang, _ in rows if not base[i][-1]]
    add = lambda xs: [sum(c) for c in zip(*xs, strict=True)]
    judged = {  # which histogram is judged for which document
        0: [(i, lang) for i, lang in passed if sum(hist[i][0]) >= Q.MIN_CLASS_CHARS],
        1: [(i, lang) for i, lang in passed if hist[i][1] and base[i][0] >= Q.MIN_COMMON_WORDS],
    }

    def reference(k, lang, chosen):
        peers = [j for j, other in chosen if (other == lang or not lang) and hist[j][k]]
        return add(hist[j][k] for j in peers) if peers else None

    def far(k, chosen):
        out = {}
        for i, lang in judged[k]:
            if sum(other == lang or not lang for _, other in passed) >= Q.MIN_REFERENCE_DOCS:
                ref = reference(k, lang, chosen)
                out[i] = distance(hist[i][k], ref)
        return out

    want = {}
    for k in (0, 1):
        first = far(k, passed)
        near = []
        for lang in {x for _, x in passed}:
            steps = sorted(int(first[i] * Q.STEPS) for i, other in judged[k] if other == lang and i in first)
            near += [(i, lang) for i, other in judged[k] if other == lang and i in first and int(first[i] * Q.STEPS) <= steps[(len(steps) - 1) // 2]]
        want[k] = far(k, near)
    for i, t, *_ in rows:
        r = got[i]
        for k, d in ((0, r.class_distance), (1, r.word_distance)):
            assert d == (pytest.approx(want[k][i], abs=1e-9) if i in want[k] else None)
        limit = lambda x, n: x[0] + x[1] / math.sqrt(n)
        assert r.kept == (
            not base[i][-1]
            and want[0].get(i, 0) <= limit(Q.CLASS_LIMIT, max(len(t), 1))
            and want[1].get(i, 0) <= limit(Q.WORD_LIMIT, max(base[i][0], 1))
        )
    assert not any(got[i].kept for i in (300, 301, 302, 303)) and got[304].kept
    assert all(got[i].kept for i, *_ in rows[:120] if not base[i][-1])


def test_odd_rows(make_docs):
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, " \t\n", "en", "s"), (None, "a b c a b c", "fr", "s"),
            (4, "x y z x y z x y z x", "de", "s"), (4, "x y z x y z x y z x", "de", "s"), (5, "é è ñ\x0b\x0cb", "es", "s"),
            (6, ("long text with words number " * 3 + "\n") * 3000, "en", "s")]
    got = sorted((tuple(r)[:7] for r in Q.quality_rules(make_docs(rows)).collect()), key=str)
    assert got == sorted(((i, *counts(t)) for i, t, *_ in rows), key=str)
    assert Q.quality_rules(make_docs([])).count() == 0
    assert Q.filter_quality(make_docs([])).count() == 0


def test_filter_keeps_columns_and_rows(make_docs):
    docs = make_docs(corpus()).selectExpr("*", "1 AS _kept0", "'x' AS words", "2 AS classes")
    kept = {r.doc_id for r in Q.quality_rules(docs).collect() if r.kept}
    got = Q.filter_quality(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == kept


def test_copies_of_one_text_do_not_become_the_reference(make_docs):
    rng = random.Random(4)
    clean = [(i, text_of(rng, "es", rng.randint(100, 400)), "es", "s") for i in range(60)]
    copied = ("Ya no hay más que decir aquí, SEÑOR 1234! " * 2 + " ".join(f"TEXTO{i} 99{i}" for i in range(150)))
    alone = {r.doc_id: r for r in Q.quality_rules(make_docs([*clean, (100, copied, "es", "s")])).collect()}
    rows = clean + [(100 + i, copied, "es", "s") for i in range(400)]
    got = {r.doc_id: r for r in Q.quality_rules(make_docs(rows).repartition(5)).collect()}
    assert len(got) == len(rows) and not got[100].base_failed
    assert all(got[i].kept for i, *_ in clean)
    for i in alone:  # further copies change no reference
        assert got[i].class_distance == pytest.approx(alone[i].class_distance, abs=1e-9)
        assert got[i].word_distance == pytest.approx(alone[i].word_distance, abs=1e-9)
    # copies do not make up the texts that a reference needs
    few = Q.quality_rules(make_docs(rows[50:])).collect()
    assert all(r.class_distance is None and r.word_distance is None for r in few)


def test_words_are_judged_from_the_first_length_that_passes(make_docs):
    rng = random.Random(6)
    clean = [(i, text_of(rng, "en", rng.randint(50, 300)), "en", "s") for i in range(80)]
    salad = [(100 + n, text_of(rng, "en", n, common=0), "en", "s") for n in (50, 60, 79)]
    got = {r.doc_id: r for r in Q.quality_rules(make_docs(clean + salad)).collect()}
    assert all(got[i].kept for i, *_ in clean if not got[i].base_failed)
    for i, *_ in salad:
        assert not got[i].base_failed and got[i].word_distance is not None and not got[i].kept
