"""Pipeline stages keep further columns, whatever their names."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, quality_rules, simhash

NAMES = ("_q", "_r_n", "_kept", "_class_distance", "_mix_row", "_mix_copy", "_mix_copies", "_key", "_digest", "_row", "fp", "size", "row_id")


@pytest.mark.parametrize(
    "stage", [quality_rules.filter_quality, exact_dedup.drop_duplicates, simhash.keep_representatives, mixing.mixed_documents]
)
def test_further_columns_stay(make_docs, stage):
    rows = [(i, " ".join(f"w{(i + 1) * j % 97}" for j in range(60 + i)), "en", f"s{i % 2}") for i in range(12)] + [(20, None, None, None)]
    docs = make_docs(rows)
    clash = docs
    for i, name in enumerate(NAMES):
        clash = clash.withColumn(name, F.concat(F.lit(f"{i}/"), F.col("doc_id").cast("string")))
    got = stage(clash)
    assert got.columns == clash.columns
    found = [tuple(r) for r in got.collect()]
    assert all(r[5:] == tuple(f"{i}/{r[0]}" for i in range(len(NAMES))) for r in found)
    assert sorted((r[:5] for r in found), key=str) == sorted((tuple(r) for r in stage(docs).collect()), key=str)
