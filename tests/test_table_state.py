"""Registered queries see the tables as they are now, not as a store was built from them before."""

from pyspark.sql import functions as F

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


def test_a_changed_table_gets_a_new_store(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n_docs = lambda: catalog.q_doc_count(spark, scratch).first()["n_docs"]
    docs.write.parquet(f"{scratch}/documents.parquet")
    assert n_docs() == docs.count()
    built = catalog._store(spark, scratch, "corpus")
    assert catalog._store(spark, scratch, "corpus") is built
    docs.filter(F.col("doc_id") < 10).write.mode("overwrite").parquet(f"{scratch}/documents.parquet")
    assert n_docs() == docs.filter(F.col("doc_id") < 10).count()
