"""The registered queries of this folder and the SQL that checks them.

Each applies its operator, with the parameters below, to a whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    exact_dedup,
    html_extract,
    license_scan,
    lm_score,
    merkle,
    mixing,
    packing,
    periodic_runs,
    quality_rules,
    simhash,
    token_counts,
    toxicity,
    warc,
)
from quarry.llm.common import ascii_lower, documents, fold


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file; ``QUARRY_TOKENIZERS`` may name another folder."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label_digest(license_scan.scan_licenses(documents(spark, sf_dir)))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = toxicity.toxicity(documents(spark, sf_dir), labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = fold(F.col("doc_id"), 7) != 2
    scored = lm_score.lm_scores(documents(spark, sf_dir), train, vocabulary("piece_bpe_32k.model"))
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    text = F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    return merkle.verify(merkle.merkle_manifest(documents(spark, sf_dir), presented={"text": text}))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.periodic_runs(documents(spark, sf_dir), plant=True))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.with_length(html_extract.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_html_extraction": op13_html_extraction,
}

def merkle_sql(arity: int = 16, below: int = 6, above: int = 4) -> str:
    """The Merkle manifest in DuckDB: ``below`` levels under the subroots, ``above`` over them.

    A tree that is done passes its node on; enough for arity ** below rows a
    source and arity ** above sources.
    """
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = lambda text: " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    parts = [f"""
WITH bits AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda x, s: xor(x >> 8, t[CAST(xor(x, s) & 255 AS INTEGER) + 1])), 4294967295) AS crc
  FROM documents, bits
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM (SELECT doc_id, source, sha256({fields("text")}) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256({fields(low)}) ELSE sha256({fields("text")}) END AS shown FROM hashed)
), n0 AS (SELECT tree, i, leaf AS d FROM leaves)"""]
    level = """
, r{k} AS (
  SELECT tree, i // {a} AS p, list(d ORDER BY i) AS ds, count(*) OVER (PARTITION BY tree) AS runs FROM n{k} GROUP BY tree, p
), n{next} AS (
  SELECT tree, p AS i, CASE WHEN runs = 1 AND len(ds) = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d FROM r{k}
)"""
    for k in range(below):
        parts.append(level.format(k=k, next=k + 1, a=arity))
    parts.append(f", n{below + 1} AS (SELECT CAST(0 AS BIGINT) AS tree, tree AS i, d FROM n{below})")
    for k in range(below + 1, below + 1 + above):
        parts.append(level.format(k=k, next=k + 1, a=arity))
    top = below + 1 + above
    parts.append("\n, s0 AS (SELECT doc_id, tree, tree AS t, i, leaf, shown AS f, '' AS proof FROM leaves)")
    steps = [*range(below), *range(below + 1, top)]
    for step, k in enumerate(steps):
        t, i = ("s.t", "s.i") if k < below else ("CAST(0 AS BIGINT)", "s.tree" if k == below + 1 else "s.i")
        parts.append(f"""
, s{step + 1} AS (
  SELECT s.doc_id, s.tree, s.t, {i} // {arity} AS i, s.leaf,
    CASE WHEN r.runs = 1 AND len(r.ds) = 1 THEN s.f
      ELSE sha256(array_to_string(r.ds[:{i} % {arity}], '') || s.f || array_to_string(r.ds[{i} % {arity} + 2:], '')) END AS f,
    s.proof || array_to_string(r.ds[:{i} % {arity}], '') || array_to_string(r.ds[{i} % {arity} + 2:], '') AS proof
  FROM s{step} s JOIN r{k} r ON r.tree = {t} AND r.p = {i} // {arity}
)""")
    parts.append(f"""
SELECT s.doc_id, s.leaf, n.d AS subroot, o.d AS root, sha256(s.proof) AS proof_sha256, s.f AS folded_root, s.f = o.d AS verified
FROM s{len(steps)} s JOIN n{below} n ON n.tree = s.tree CROSS JOIN n{top} o
""")
    return "".join(parts)


ORACLE: dict[str, str] = {
    "op11_merkle_manifest": merkle_sql(),
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest
  FROM h
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
""",
    "op10_exact_dedup": """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
}
