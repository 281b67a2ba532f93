"""Fixed schemas of the engine's tables."""

from pyspark.sql import types as T

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("size", T.LongType(), True),
        T.StructField("mod_time", T.TimestampType(), True),
        T.StructField("content", T.StringType(), True),
    ]
)

DOCUMENTS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("content", T.StringType(), True),
        T.StructField("size", T.LongType(), True),
        T.StructField("mod_time", T.TimestampType(), True),
        T.StructField("truncated", T.BooleanType(), True),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("field", T.StringType(), False),
        T.StructField("tb", T.IntegerType(), False),
        T.StructField("term", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("tf", T.IntegerType(), False),
        T.StructField("positions", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("dl", T.IntegerType(), False),
    ]
)

#: Postings as stored: ``n`` of a term in one row.
BLOCKS = T.StructType(
    [
        *POSTINGS.fields[:3],
        T.StructField("n", T.IntegerType(), False),
        T.StructField("doc_ids", T.ArrayType(T.StringType()), False),
        T.StructField("dls", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("ends", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("positions", T.ArrayType(T.IntegerType(), False), False),
    ]
)

DOC_STATS = T.StructType(
    [
        T.StructField("field", T.StringType(), False),
        T.StructField("doc_id", T.StringType(), False),
        T.StructField("len", T.IntegerType(), False),
    ]
)

TERM_STATS = T.StructType(
    [
        T.StructField("field", T.StringType(), False),
        T.StructField("tb", T.IntegerType(), False),
        T.StructField("term", T.StringType(), False),
        T.StructField("df", T.LongType(), False),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("last_indexed", T.TimestampType(), False),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("query", T.StringType(), True),
        T.StructField("per_page", T.IntegerType(), True),
        T.StructField("page", T.IntegerType(), True),
    ]
)

RUN_LEDGER = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("batch_id", T.IntegerType(), False),
        T.StructField("n_done", T.LongType(), False),
        T.StructField("n_total", T.LongType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("ts", T.TimestampType(), True),
    ]
)
