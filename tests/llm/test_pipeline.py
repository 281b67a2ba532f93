import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from quarry.llm.common import scratch_path
from quarry.llm.queries import ORACLE, QUERIES, vocabulary
from tests.llm import test_exact_dedup, test_mixing, test_quality_rules, test_simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(8)
    rows = [
        (i, test_quality_rules.text_of(rng, lang, rng.randint(60, 200)), lang, f"src{i % 4}")
        for i, lang in enumerate(["en", "fr", "de", "es"] * 25)
    ]
    for i in range(30):  # copies in other letters
        _, t, lang, s = rows[i]
        rows.append((200 + i, t.upper() if i % 2 else t, lang, s))
    for i in range(20):  # copies with a word changed
        _, t, lang, s = rows[40 + i]
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        rows.append((300 + i, " ".join(w), lang, "src0"))
    rows += [(400, None, "en", "src1"), (401, "", None, None), (402, "too short", "en", "src2"), (403, "same three words " * 80, "en", "src3"),
             (404, rows[5][1], None, None), (5, rows[5][1], rows[5][2], rows[5][3]), (None, rows[70][1] + " no id", "de", None)]
    return rows


@pytest.fixture(scope="module")
def run(spark, make_docs):
    folder = scratch_path(spark, "pipeline-test")
    make_docs(corpus()).repartition(3).write.parquet(f"{folder}/documents.parquet")
    stages, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        path = scratch_path(spark, "pipeline-stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        stages.append(docs)
    return folder, stages


def texts(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages(spark, run):
    _, stages = run
    assert all(s.columns == COLUMNS for s in stages[:-1])
    first, second, third, fourth = map(texts, stages[:-1])
    rows = corpus()
    # quality: base rules are those of the brute force, clean documents stay
    passed = {i for i, t, *_ in rows if not test_quality_rules.counts(t)[-1]}
    assert {k[0] for k in first} <= passed and {k[0] for k in first} >= {i for i in passed if i is not None and i < 200}
    # exact duplicates
    rows = [k[:2] for k in first.elements()]
    stays = {(i, d) for i, _, _, kept, d in test_exact_dedup.brute(rows) if kept}
    assert len(second) == sum(second.values()) == len(stays)
    # near duplicates
    rows = [k[:2] for k in second.elements()]
    stays = {i for i, _, c in test_simhash.brute(rows) if i is None or i == c}
    assert {k[0] for k in third} == stays and sum(third.values()) == len(stays)
    assert len(third) < len(second) < len(first)
    # mixing
    sizes, taken = defaultdict(int), defaultdict(int)
    for (_, t, _, s, _), n in third.items():
        sizes[s] += n * test_mixing.size_of(t)
    for (_, t, _, s, _), n in fourth.items():
        taken[s] += n * test_mixing.size_of(t)
    assert set(fourth) <= set(third) and max(fourth.values()) <= 2
    for s, want in test_mixing.brute_targets(sizes).items():
        assert abs(taken[s] - want) <= max(0.02 * want, 120)


def test_last_stage_holds_every_token(spark, run):
    folder, stages = run
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for (i, text, *_), n in texts(stages[-2]).items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[(i, zlib.crc32(np.array(ids, "<u4").tobytes()) if len(ids) <= 4096 else None, len(ids))] += n
    whole = Counter()
    for r in stages[-1].collect():
        whole[(r.doc_id, r.doc_tokens)] += r.length
    assert whole == Counter({(i, n): sum(c * n for (j, _, m), c in want.items() if (j, m) == (i, n)) for i, _, n in want})
    got = P.run(spark, folder)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1].collect()))


def test_empty_documents(spark, make_docs):
    docs = make_docs([])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = make_docs([])


def test_registered():
    names = E.queries()
    assert names["pipeline"] is P.run
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(ORACLE) <= set(QUERIES) <= set(names)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables missing")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_on_the_given_tables(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= (50 if name in ("op3_warc", "op13_html_extraction") else 200)  # pages, documents
