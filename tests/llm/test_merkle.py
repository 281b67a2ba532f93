"""The Merkle manifest against a plain-Python tree, with odd groups and rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle
from quarry.llm.common import ascii_lower
from quarry.llm.queries import QUERIES

UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, arity):
    """(top, proofs): the siblings of every leaf, level by level, as (left, right) lists."""
    proofs = [[] for _ in digests]
    under = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, above_under = [], []
        for at in range(0, len(digests), arity):
            run = digests[at : at + arity]
            for slot in range(len(run)):
                for i in under[at + slot]:
                    proofs[i].append((run[:slot], run[slot + 1 :]))
            above.append(sha("".join(run)))
            above_under.append([i for u in under[at : at + arity] for i in u])
        digests, under = above, above_under
    return digests[0], proofs


def expected(rows, arity=16):
    """Rows are (doc_id, source, lang, n_chars, text); gives the contract's rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for name in names:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append((members, *tree([leaf(r) for r in members], arity)))
    if not built:
        return []
    root, upper = tree([b[1] for b in built], arity)
    out = []
    for (members, subroot, proofs), above in zip(built, upper):
        for r, proof in zip(members, proofs):
            path = proof + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4].translate(UPPER_LOWER) if tampered and r[4] is not None else r[4]
            node = leaf((*r[:4], text))
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            proof_sha = sha("".join(d for left, right in path for d in [*left, *right]))
            out.append((r[0], leaf(r), subroot, root, proof_sha, node, node == root))
    return out


def run(docs, arity=16):
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.verify(merkle.merkle_manifest(docs, arity=arity, presented={"text": text})).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


ODD = [
    (5, "Hello World", "en", "a"), (None, "No Id", "en", "a"), (None, "No Id", "en", "a"), (7, None, None, None), (8, "", "en", None),
    (9, "Ünï—码 X", "de", "ä"), (5, "Other text", "en", "a"), (5, "Hello World", "en", "a"), (10, "lone", "en", "z"), (10, "Q" * 100_000, "en", "Z"),
]


@pytest.mark.parametrize("arity", [2, 5, 16])
def test_against_plain_trees(make_docs, arity):
    rng = random.Random(arity)
    sizes = {"hot": 300, "run": 17, "exact": 16, "square": 256, "two": 2, "one": 1, **{f"s{i:02}": 1 + i % 3 for i in range(20)}}
    if arity == 2:
        sizes = {"run": 9, "exact": 8, "one": 1}
    rows, ids = [], rng.sample(range(10_000), sum(sizes.values()))
    for source, n in sizes.items():
        rows += [(ids.pop(), rng.choice(["Abc", "abc", "X y", "1"]) * rng.randint(0, 5), "en", source) for _ in range(n)]
    rows += ODD
    rng.shuffle(rows)
    full = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows]
    got = run(make_docs(rows).repartition(5), arity)
    assert sorted(got, key=key) == sorted(expected(full, arity), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_small_tables_and_clashing_names(make_docs):
    assert run(make_docs([])) == []
    one = [(3, "A", "en", "s")]
    (got,) = run(make_docs(one))
    assert got[1] == got[2] == got[3] and got[4] == sha("")
    clash = make_docs(ODD)
    for c in ("tree", "idx", "digest", "place", "one", "group", "row_id", "left", "right", "path", "root", "_part", "presented", "leaf"):
        clash = clash.withColumn(c, F.lit("x"))
    assert sorted(run(clash), key=key) == sorted(run(make_docs(ODD)), key=key)


def test_query_over_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = [tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(expected(rows))
