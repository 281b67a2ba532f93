import random
import re
import time

import pytest

from quarry.llm import license_scan as L
from quarry.llm.license_rules import CONFIDENCE, RULES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(WORD, low)


def brute(text):
    w = words_of(text)
    flat = " ".join(w)
    starts, at = {}, 0
    for i, x in enumerate(w):
        starts[at] = i
        at += len(x) + 1
    ends = {s + len(w[i]): i for s, i in starts.items()}
    base, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split(" ")
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        base += hits
        labels |= {label} if hits else set()
    found = []
    for priority, label, _, pattern in RULES:
        for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", flat):
            found.append((starts[m.start()], ends[m.end()], priority, label))
    kept = [d for d in found if not any(e[2] < d[2] and e[0] <= d[0] and e[1] >= d[1] for e in found)]
    score = 1.0
    for _, priority in {(d[3], d[2]) for d in kept}:
        score *= 1 - CONFIDENCE[priority]
    return (
        len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {d[3] for d in kept})), round(1 - score, 9), len(kept),
    )


def run(df):
    rows = L.label_digest(L.scan_licenses(df)).collect()
    return sorted(
        ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), r.n_detections) for r in rows),
        key=str,
    )


NOTICES = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Released under the MIT License. All rights reserved.",
    "under the terms of the GNU Lesser General Public License", "GNU General Public License, version 3", "mit license mit license",
    "Mozilla Public License v2.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "licensed under the Apache license", "BSD 3-Clause License", "GPLv3 or later", "GPL 3", "see the LICENSE file for details",
    "the general public license", "apache\nlicense", "MIT-License", "commit license", "mit licenses", "smit license",
]


def test_every_rule_is_gated_by_its_own_keyword():
    assert len(RULES) > 200
    for priority, label, keyword, pattern in RULES:
        assert priority in CONFIDENCE and "," not in label
        literal = re.sub(r"\[cs\]", "c", pattern)
        plain = re.compile(r"(?<![a-z0-9])" + re.escape(keyword))
        options = [literal, literal.replace("(?:", "").replace(")?", "").replace(")", "").replace("licenc", "licens"),
                   re.sub(r"\(\?:[^()]*\)\?", "", literal), re.sub(r"\(\?:[^()]*\)\?", "", literal).replace("licenc", "licens")]
        assert any(plain.search(o) for o in options), (keyword, pattern)


def test_against_brute_force(make_docs):
    rng = random.Random(2)
    fill = ["the", "mit", "license", "apache", "gpl", "public", "general", "gnu", "version", "2", "0", "of", "Öl", "x1"]
    texts = NOTICES + [
        " ".join(rng.choice(NOTICES) if rng.random() < 0.2 else rng.choice(fill) for _ in range(rng.randint(1, 40))) for _ in range(150)
    ]
    rows = list(enumerate(texts))
    assert run(make_docs(rows)) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_weak_inside_strong_is_suppressed(make_docs):
    text = "Released under the terms of the MIT License"
    (row,) = L.scan_licenses(make_docs([(1, text)])).collect()
    assert [(d.label, d.priority, d.first_word, d.last_word) for d in row.detections] == [("mit", 1, 0, 7)]
    assert (row.n_base, row.first_word, row.last_word) == (1, 6, 6)


def test_odd_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " .,; "), (None, "mit license"), (4, "mit license"), (4, "mit license"),
            (5, "x " * 30_000 + "MIT license " * 3000 + "apache license"), (6, "ÄMIT license mit\x00license")]
    assert run(make_docs(rows)) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert run(make_docs([])) == []


def test_blocks_of_the_sweep(make_docs, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(NOTICES + ["x", "mit license", "apache license"]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    monkeypatch.setattr(L, "BLOCK", 3)
    assert run(make_docs(rows)) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_many_detections_take_time_in_proportion(make_docs):
    took = []
    for n in (10, 10_000, 100_000):
        began = time.time()
        ((_, n_words, n_base, first, last, _, labels, _, n_detections),) = run(make_docs([(1, "mit license x " * n)]))
        took.append(time.time() - began)
        assert (n_words, n_base, first, last, labels, n_detections) == (3 * n, n, 0, 3 * n - 3, "mit", n)
    assert took[2] < 60 and took[2] < 15 * took[1]


@pytest.mark.parametrize("words", [["a"], ["ab", "abc", "b"], ["gpl", "gplv3", "apache org", "apache"]])
def test_prefix_tree(words):
    p = re.compile(L.prefix_tree(words))
    assert all(p.match(w) for w in words) and not p.match("zz")


def matches_of(pattern):
    """Strings that a rule's pattern matches: all choices of its groups, one of each character set."""
    from itertools import product

    def of(parts):
        return ["".join(x) for x in product(*map(options, parts))]

    def options(part):
        op, arg = part
        name = str(op)
        if name == "LITERAL":
            return [chr(arg)]
        if name == "IN":
            kind, first = arg[0]
            return [chr(c) for k, c in arg if str(k) == "LITERAL"] or [chr(first[0] if str(kind) == "RANGE" else first)]
        if name == "SUBPATTERN":
            return of(arg[-1])
        if name == "BRANCH":
            return [x for branch in arg[1] for x in of(branch)]
        assert name == "MAX_REPEAT", name
        low, high, inner = arg
        return [x for n in {low, min(int(high), low + 1)} for x in of(list(inner) * n)]

    return of(re._parser.parse(pattern))


def test_the_gate_lets_every_match_of_every_rule_through(make_docs):
    gate = re.compile("(?<![^ ])" + L.prefix_tree(sorted({k for _, _, k, _ in RULES} | {p for p, _ in L.BASE})))
    for _, _, keyword, pattern in RULES:
        for text in matches_of(pattern):
            assert re.fullmatch(pattern, text) and keyword in text and gate.search(text), (keyword, text)
    rows = list(enumerate(["See the COPYING file for details", "refer to copying.txt for more details", "see copying", "see LICENSE.md"]))
    assert run(make_docs(rows)) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert all(r.labels == "license-reference" for r in L.label_digest(L.scan_licenses(make_docs(rows))).collect())
