"""Index-side analysis: postings, field lengths, document frequencies.

Shapes (see ``quarry.schema``):

- postings   (field, tb, term, doc_id, tf, positions, dl)
- blocks     (field, tb, term, n, doc_ids, dls, ends, positions): n postings of a
  term in one row, as stored; the positions of all are one array, and ``ends``
  tells where each document's end
- doc_stats  (field, doc_id, len)
- term_stats (field, tb, term, df)

``content`` and ``name`` use the standard analyser; ``path`` is one
case-kept keyword term.  ``dl`` (the field length after stop words) is
denormalised into postings so scoring needs no join with doc_stats.

``tb`` is the storage bucket of a term: a hash of its first three UTF-8 bytes
for the analysed fields (so every term a prefix expands to shares the
prefix's bucket) and a hash of the whole path for ``path``.  Written tables
are partitioned by (field, tb); a query batch then reads only its buckets
through dynamic partition pruning.

Work per document stays inside its task: the tokens of a few million are grouped
by term as columns of an Arrow batch, so postings need no aggregation; the only
shuffle is the one that lays them out on disk, and it moves and sorts a row for
each term of such a group, not one for each posting.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.plain_words import OTHER_RE, word_pattern
from quarry.functions.stopwords import STOP_WORDS_EN
from quarry.functions.text import is_stop_word, raw_tokens, utf8_prefix3

FIELDS_ANALYSED = ("content", "name")


def term_bucket(field: Column, term: Column, buckets: int) -> Column:
    key = F.when(field == F.lit("path"), F.encode(term, "UTF-8")).otherwise(utf8_prefix3(term))
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def sorted_tokens(text: Column) -> Column:
    """ARRAY<STRUCT<term, pos>> of a text's tokens without stop words, sorted; holes keep their positions."""
    placed = F.transform(raw_tokens(text), lambda t, i: F.struct(t.alias("term"), i.cast("int").alias("pos")))
    return F.sort_array(F.filter(placed, lambda x: ~is_stop_word(x["term"])))


def _token_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, field, tokens) per document and analysed field."""
    per_field = [
        documents.select(
            F.col("id").alias("doc_id"), F.lit(f).alias("field"), sorted_tokens(F.coalesce(F.col(f), F.lit(""))).alias("tokens")
        )
        for f in FIELDS_ANALYSED
    ]
    return per_field[0].unionByName(per_field[1])


def _texts(documents: DataFrame, field: str) -> DataFrame:
    """(doc_id, text, tokens) of an analysed field: lower-cased text, or the tokens where it is not plain."""
    raw = F.coalesce(F.col(field), F.lit(""))
    plain = ~raw.rlike(OTHER_RE)
    return documents.select(
        F.col("id").alias("doc_id"), F.when(plain, F.lower(raw)).alias("text"), F.when(~plain, raw_tokens(raw)).alias("tokens")
    )


#: Tokens whose postings are grouped by term at once; a longer text is grouped whole.
CHUNK_TOKENS = 3_000_000
#: Postings of an Arrow batch that goes back to the JVM; a term's are never cut.
BATCH_POSTINGS = 100_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray], list[str]]]:
    """(doc ids, token codes of each, terms by code), a few million tokens at a time."""
    words = word_pattern()
    ids, parts, n, codes = [], [], 0, defaultdict(count().__next__)
    for b in batches:
        names, texts, tokens = b.column("doc_id"), b.column("text"), b.column("tokens")
        for i in range(b.num_rows):
            text = texts[i].as_py()
            found = tokens[i].as_py() if text is None else words.findall(text)
            ids.append(names[i].as_py())
            parts.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
            n += 1 + len(found)
            if n >= CHUNK_TOKENS:
                yield ids, parts, list(codes)
                ids, parts, n, codes = [], [], 0, defaultdict(count().__next__)
    if ids:
        yield ids, parts, list(codes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, doc_ids, dls, ends, positions): postings without stop words, grouped by term, documents in the order they came."""
    stop = set(STOP_WORDS_EN)
    for ids, parts, terms in _chunks(batches):
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        code = np.concatenate(parts)
        at = (np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        row = np.repeat(np.arange(len(parts), dtype=np.int32), counts)
        keep = ~np.fromiter((t in stop for t in terms), bool, len(terms))[code]
        row, code, at = row[keep], code[keep], at[keep]
        if not len(code):
            continue
        lengths = np.bincount(row, minlength=len(parts)).astype(np.int32)
        order = np.argsort(code, kind="stable")  # places were in order of row and position
        row, code, at = row[order], code[order], at[order]
        new_term = np.r_[True, code[1:] != code[:-1]]
        begins = np.flatnonzero(new_term | np.r_[True, row[1:] != row[:-1]])
        row, term_begins = row[begins], np.flatnonzero(new_term[begins])
        ends = np.r_[begins, len(code)]
        term_ends = np.r_[term_begins, len(begins)]
        counts = np.diff(term_ends)
        by_term = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()).take(pa.array(code[begins[term_begins]])),
                pa.array(counts, pa.int32()),
                by_term(term_ends, pa.array(ids, pa.string()).take(pa.array(row))),
                by_term(term_ends, pa.array(lengths[row])),
                by_term(term_ends, pa.array(ends[1:] - np.repeat(begins[term_begins], counts), pa.int32())),
                by_term(ends[term_ends], pa.array(at)),
            ],
            ["term", "n", "doc_ids", "dls", "ends", "positions"],
        )
        cuts = np.unique(np.searchsorted(term_begins, np.arange(0, len(begins), BATCH_POSTINGS)))
        for a, z in pairwise([*cuts.tolist(), len(term_begins)]):
            if a < z:
                yield out.slice(a, z - a)


BLOCK = "term string, n int, doc_ids array<string>, dls array<int>, ends array<int>, positions array<int>"


def build_blocks(documents: DataFrame, term_buckets: int) -> DataFrame:
    """Postings in rows of a term and a group of documents; no shuffle."""
    one = F.lit(1)
    out = documents.select(
        F.col("path").alias("term"),
        one.alias("n"),
        F.array("id").alias("doc_ids"),
        F.array(one).alias("dls"),
        F.array(one).alias("ends"),
        F.array(F.lit(0)).alias("positions"),
        F.lit("path").alias("field"),
    )
    for f in FIELDS_ANALYSED:
        out = out.unionByName(_texts(documents, f).mapInArrow(_blocks, BLOCK).withColumn("field", F.lit(f)))
    tb = term_bucket(F.col("field"), F.col("term"), term_buckets).alias("tb")
    return out.select("field", tb, "term", "n", "doc_ids", "dls", "ends", "positions")


def posting_rows(blocks: DataFrame) -> DataFrame:
    """One row per (field, term, document) of blocks.

    The arrays are read in place while their row is taken apart; a higher-order
    function that made structs of them first would run outside generated code.
    """
    begin = F.when(F.col("i") == 0, 0).otherwise(F.get("ends", F.col("i") - 1))
    tf = F.get("ends", "i") - begin
    rows = blocks.select("field", "tb", "term", "dls", "ends", "positions", F.posexplode("doc_ids").alias("i", "doc_id"))
    return rows.select(
        "field", "tb", "term", "doc_id", tf.alias("tf"), F.slice("positions", begin + 1, tf).alias("positions"), F.get("dls", "i").alias("dl")
    )


def build_postings(documents: DataFrame, term_buckets: int) -> DataFrame:
    """One row per (field, term, document) with tf and positions; no shuffle."""
    return posting_rows(build_blocks(documents, term_buckets))


def build_doc_stats(documents: DataFrame) -> DataFrame:
    """T4: field length per document (tokens after stop words; path is 1)."""
    rows = _token_rows(documents).select("field", "doc_id", F.size("tokens").cast("int").alias("len"))
    path = documents.select(F.lit("path").alias("field"), F.col("id").alias("doc_id"), F.lit(1).alias("len"))
    return rows.unionByName(path)


def build_term_stats(blocks: DataFrame) -> DataFrame:
    """T4: document frequency per (field, term); partial aggregation map-side."""
    return blocks.groupBy("field", "tb", "term").agg(F.sum(F.col("n").cast("long")).alias("df"))
