"""Tokens of plain texts in Python against the column expressions, and postings of texts of both kinds."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.functions import plain_words as P
from quarry.functions.stopwords import STOP_WORDS_EN
from quarry.functions.text import raw_tokens
from quarry.operators.analysis import build_postings


def test_classes_agree(spark):
    """Every plain character is a letter, number or word character to both, and is plain to the JVM."""
    rows = spark.createDataFrame([(chr(c),) for a, b in P.PLAIN_BLOCKS for c in range(a, b + 1)], "s string")
    tests = [F.col("s").rlike(f"(?s)^{x}$") for x in (r"\p{L}", r"\p{N}", r"[\p{L}\p{N}\p{M}_]", P.OTHER_RE)]
    ours = [re.compile(f"[{P._class(*x)}]") for x in (("L",), ("N",), ("LNM", "_"))]
    for r in rows.select("s", F.array(*tests).alias("is")).collect():
        assert [bool(p.fullmatch(r.s)) for p in ours] + [False] == r["is"], hex(ord(r.s))


def test_plain_and_other_texts(spark):
    rng = random.Random(7)
    parts = list("aZé1²_.'’:,; \ńİßΣσж\x01—🙂") + ["the", "3.14", "x.y", "it's", "1,2;3"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [t + "東京 กขค" for t in texts[:20]] + ["", None]
    docs = spark.createDataFrame([(f"/{i}", f"/{i}", f"n{i}.TXT", t) for i, t in enumerate(texts)], "id string, path string, name string, content string")
    expected = {}
    for r in docs.select("id", raw_tokens(F.coalesce("content", F.lit(""))).alias("tokens")).collect():
        places = defaultdict(list)
        for i, t in enumerate(r.tokens):
            if t not in STOP_WORDS_EN:
                places[t].append(i)
        expected |= {(t, r.id): (at, sum(map(len, places.values()))) for t, at in places.items()}
    post = build_postings(docs, 4)
    assert "MapInArrow" in post._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.doc_id): (r.positions, r.dl) for r in post.filter("field = 'content'").collect()} == expected
