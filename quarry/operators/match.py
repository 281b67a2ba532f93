"""Matching and scoring of compiled queries against the index.

Score (vector-space TF-IDF with field-length norm):

    idf  = 1 + ln(N / (df + 1))
    leaf = boost * idf^2 * sqrt(tf) / sqrt(len)

- a match clause is an OR over the tokens of its word, a prefix clause an OR
  over the vocabulary terms it expands to; an OR scores
  ``(matched / total) * sum``;
- a phrase scores the sum of its token leaves where the phrase occurs;
- an ``and`` child needs every word; it scores the sum over words, each word
  being an OR of its single-term clauses;
- the query is an OR of its children.

Every step is a join or an aggregation.  Query-side tables are small and
broadcast behind a row bound; postings are only streamed, with their
partitions pruned to the query terms' buckets.  All aggregation levels group
by keys that contain (query_id, split), split being a hash of the document, and
the matched leaves are hash partitioned on exactly those two columns once, so
the whole score tree and the choice of each split's best rows cost one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import is_stop_word, utf8_prefix3
from quarry.operators.analysis import term_bucket
from quarry.operators.parse import CompiledQueries
from quarry.operators.rank import split_of

# A query of at most 1000 characters yields at most 500 words, each with at
# most 5 single-term clauses; this bounds the exact-term leaves per query.
# Phrase tokens have no such bound (a query may quote many phrases, each clause
# holding the whole query): they are counted before one is broadcast.
LEAVES_PER_QUERY_BOUND = 2500


@dataclass
class IndexTables:
    documents: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    n_docs: int
    term_buckets: int
    doc_buckets: int = 0  # > 0 when documents carry a ``db`` id-hash bucket column


def bounded_broadcast(df: DataFrame, bound_rows: int, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when its proven row bound fits ``max_rows``."""
    return F.broadcast(df) if bound_rows <= max_rows else df


# Up to this many terms and prefixes of a batch go into the scan filter.
SCAN_TERMS = 300


@dataclass
class BatchFacts:
    n_queries: int
    max_end: int
    phrase_tokens: int
    buckets: dict[str, list[int]]  # field -> storage buckets
    terms: dict[str, list[str]] | None  # field -> exact terms; None: too many to list
    prefixes: dict[str, list[str]] | None


def batch_facts(cq: CompiledQueries, index: IndexTables) -> BatchFacts:
    """One small job: number of queries, deepest page end, phrase tokens, buckets and terms.

    Buckets are the storage buckets (per field) of every term the batch can
    touch: exact tokens, path terms, phrase tokens and prefixes (a prefix
    shares the bucket of its first three bytes with all its expansions).
    There are at most ``3 * term_buckets`` of them whatever the data size, so
    they are collected and applied as a static partition filter: postings
    and term statistics are read only in these buckets.  The terms themselves,
    when a batch has few, become a pushed filter: files are sorted by term, so
    a scan skips all row groups but those of the terms.
    """
    g = cq.groups
    b = index.term_buckets
    exact = g.filter((F.col("kind") == "match") & (F.col("field") != "path")).select(
        F.lit("term").alias("kind"), "field", F.explode("atoks").alias("t")
    )
    path = g.filter((F.col("kind") != "prefix") & (F.col("field") == "path")).select(
        F.lit("term").alias("kind"), "field", F.col("term").alias("t")
    )
    prefix = g.filter(F.col("kind") == "prefix").select("kind", "field", F.col("term").alias("t"))
    phr = cq.phrases.select(
        F.lit("term").alias("kind"),
        F.lit("content").alias("field"),
        F.explode(F.filter("rtoks", lambda t: ~is_stop_word(t))).alias("t"),
    )
    allt = exact.unionByName(path).unionByName(prefix).unionByName(phr)
    text, number = F.lit(None).cast("string").alias("t"), F.lit(None).cast("long").alias("v")
    terms = allt.select("kind", "field", "t", number).distinct().limit(SCAN_TERMS + 1)
    buckets = allt.select(
        F.lit("bucket").alias("kind"), "field", text, term_bucket(F.col("field"), F.col("t"), b).cast("long").alias("v")
    ).distinct()
    end = F.max(F.col("page").cast("long") * F.col("per_page").cast("long"))
    field = F.lit("").alias("field")
    counts = cq.prepared.agg(F.count(F.lit(1)).cast("long").alias("n"), end.alias("end"))
    stats = counts.select(F.lit("n").alias("kind"), field, text, F.col("n").alias("v")).unionByName(
        counts.select(F.lit("end").alias("kind"), field, text, F.col("end").alias("v"))
    )
    tokens = cq.phrases.agg(F.sum(F.size("rtoks")).cast("long").alias("v"))
    stats = stats.unionByName(tokens.select(F.lit("phrase").alias("kind"), field, text, "v"))
    found: dict[str, dict[str, list]] = {k: {} for k in ("term", "prefix", "bucket", "n", "end", "phrase")}
    for r in terms.unionByName(buckets).unionByName(stats).collect():
        found[r["kind"]].setdefault(r["field"], []).append(r["t"] if r["kind"] in ("term", "prefix") else int(r["v"] or 0))
    few = sum(len(x) for k in ("term", "prefix") for x in found[k].values()) <= SCAN_TERMS
    single = lambda k: next(iter(found[k].get("", [])), 0)
    return BatchFacts(
        single("n"),
        single("end"),
        single("phrase"),
        {k: sorted(v) for k, v in found["bucket"].items()},
        found["term"] if few else None,
        found["prefix"] if few else None,
    )


def _any_of(terms: list[str], prefixes: list[str]) -> str:
    """SQL for: term is one of these, or begins with one of these.

    Single comparisons, each of which Parquet checks against the pages of a
    file sorted by term; of a long IN list it would see only both ends.
    """
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    tests = [f"term = {quoted(t)}" for t in sorted(set(terms))]
    tests += [f"startswith(term, {quoted(p)})" for p in sorted(set(prefixes))]
    return " OR ".join(tests) or "false"


def pruned(df: DataFrame, facts: BatchFacts) -> DataFrame:
    """Filter a (field, tb)-partitioned table, sorted by term, to what a batch can touch."""
    cond = F.lit(False)
    for f, tbs in sorted(facts.buckets.items()):
        c = (F.col("field") == F.lit(f)) & F.col("tb").isin(*tbs)
        if facts.terms is not None:
            named = F.expr(_any_of(facts.terms.get(f, []), facts.prefixes.get(f, [])))
            c = c & named
        cond = cond | c
    return df.filter(cond)


def pruned_index(index: IndexTables, facts: BatchFacts) -> IndexTables:
    return IndexTables(
        documents=index.documents,
        postings=pruned(index.postings, facts),
        term_stats=pruned(index.term_stats, facts),
        n_docs=index.n_docs,
        term_buckets=index.term_buckets,
        doc_buckets=index.doc_buckets,
    )


def _idf(df_col: Column, n_docs: int) -> Column:
    return F.lit(1.0) + F.log(F.lit(float(n_docs)) / (df_col.cast("double") + F.lit(1.0)))


def _leaf(boost: Column, idf: Column, tf: Column, dl: Column) -> Column:
    return boost * idf * idf * F.sqrt(tf.cast("double")) / F.sqrt(dl.cast("double"))


def term_leaves(cq: CompiledQueries, index: IndexTables, n_queries: int, max_rows: int) -> DataFrame:
    """Leaves of the single-term clauses with their document frequency.

    Columns: query_id, n_children, c, t, s, n_subs, n_terms, field, tb, lterm,
    boost, n_leaves, df.
    """
    g = cq.groups
    keys = ["query_id", "n_children", "c", "t", "s", "n_subs", "n_terms", "field", "boost"]
    analysed = g.filter((F.col("kind") == "match") & (F.col("field") != "path")).select(
        *keys,
        F.size("atoks").alias("n_leaves"),
        F.explode("atoks").alias("lterm"),
    )
    path = g.filter((F.col("kind") == "match") & (F.col("field") == "path")).select(
        *keys, F.lit(1).alias("n_leaves"), F.col("term").alias("lterm")
    )
    exact = analysed.unionByName(path).withColumn(
        "tb", term_bucket(F.col("field"), F.col("lterm"), index.term_buckets)
    )
    bound = n_queries * LEAVES_PER_QUERY_BOUND
    ts = index.term_stats.select("field", "tb", F.col("term").alias("lterm"), "df")
    exact = bounded_broadcast(exact, bound, max_rows).join(ts, ["field", "tb", "lterm"])

    # Prefix -> vocabulary.  Every prefix has >= 3 bytes, so the first
    # three bytes are an equi-key (and the storage bucket); startswith is the
    # residual.  Plans as a hash join, never a nested loop.
    px = g.filter(F.col("kind") == "prefix").select(
        *keys,
        F.col("term").alias("prefix"),
        utf8_prefix3(F.col("term")).alias("k3"),
        term_bucket(F.col("field"), F.col("term"), index.term_buckets).alias("tb"),
    )
    vocab = index.term_stats.select(
        "field", "tb", F.col("term").alias("lterm"), "df", utf8_prefix3(F.col("term")).alias("k3")
    )
    expanded = bounded_broadcast(px, bound, max_rows).join(vocab, ["field", "tb", "k3"]).filter(
        F.col("lterm").startswith(F.col("prefix"))
    )
    # One count row per prefix clause (bounded like the clauses themselves).
    n_exp = expanded.groupBy("query_id", "c", "t", "s").agg(F.count(F.lit(1)).cast("int").alias("n_leaves"))
    expanded = expanded.join(bounded_broadcast(n_exp, bound, max_rows), ["query_id", "c", "t", "s"]).select(
        *keys, "n_leaves", "lterm", "tb", "df"
    )
    return exact.select(*keys, "n_leaves", "lterm", "tb", "df").unionByName(expanded)


def _postings_for(index: IndexTables) -> DataFrame:
    return index.postings.select(
        "field",
        "tb",
        F.col("term").alias("lterm"),
        "doc_id",
        "tf",
        "dl",
        "positions",
    )


def term_child_scores(leaves: DataFrame, index: IndexTables, expansion_rows: int, max_rows: int, splits: int) -> DataFrame:
    """Scores of the single-term children and the ``and`` children per doc.

    Output: query_id, split, doc_id, n_children, c, cscore, loc (first matched
    content position).  A position holds one token, so the earliest position
    also fixes the matched term; keeping it an int lets every aggregation of
    the score tree be a hash aggregate (a string in the buffer would force
    sort-based aggregation).
    """
    leaves = bounded_broadcast(leaves, expansion_rows, max_rows)
    hits = leaves.join(_postings_for(index), ["field", "tb", "lterm"]).select(
        "query_id",
        "doc_id",
        "n_children",
        "c",
        "t",
        "s",
        "n_subs",
        "n_terms",
        "n_leaves",
        _leaf(F.col("boost"), _idf(F.col("df"), index.n_docs), F.col("tf"), F.col("dl")).alias("leaf"),
        F.when(F.col("field") == "content", F.element_at("positions", 1)).alias("loc"),
    )
    hits = hits.withColumn("split", split_of(F.col("doc_id"), splits)).repartition("query_id", "split")
    grp = hits.groupBy("query_id", "split", "doc_id", "n_children", "c", "t", "s", "n_subs", "n_terms", "n_leaves").agg(
        (F.sum("leaf") * F.count(F.lit(1)) / F.col("n_leaves")).alias("gscore"),
        F.min("loc").alias("loc"),
    )
    single = grp.filter(F.col("t") < 0).select(
        "query_id", "split", "doc_id", "n_children", "c", F.col("gscore").alias("cscore"), "loc"
    )
    per_word = (
        grp.filter(F.col("t") >= 0)
        .groupBy("query_id", "split", "doc_id", "n_children", "c", "t", "n_subs", "n_terms")
        .agg((F.sum("gscore") * F.count(F.lit(1)) / F.col("n_subs")).alias("wscore"), F.min("loc").alias("loc"))
    )
    conj = (
        per_word.groupBy("query_id", "split", "doc_id", "n_children", "c", "n_terms")
        .agg(F.sum("wscore").alias("cscore"), F.count(F.lit(1)).alias("n_matched"), F.min("loc").alias("loc"))
        .filter(F.col("n_matched") == F.col("n_terms"))
        .select("query_id", "split", "doc_id", "n_children", "c", "cscore", "loc")
    )
    return single.unionByName(conj).withColumn("times", F.lit(1))


#: Bits of the Bloom filter of phrase candidates: a broadcast of at most 8 MiB at any size.
BLOOM_BITS = 1 << 26


def phrase_tokens(cq: CompiledQueries, index: IndexTables, n_tokens: int, max_rows: int) -> DataFrame:
    """The tokens of phrases that may match, with df; ``anchor`` marks each phrase's rarest.

    A phrase with a token that no document holds has no row.
    """
    keys = ["query_id", "n_children", "c", "boost", "k", "times"]
    toks = cq.phrases.select(*keys, F.posexplode("rtoks").alias("off", "lterm")).filter(~is_stop_word(F.col("lterm")))
    toks = toks.withColumn("field", F.lit("content"))
    toks = toks.withColumn("tb", term_bucket(F.col("field"), F.col("lterm"), index.term_buckets))
    ts = index.term_stats.select("field", "tb", F.col("term").alias("lterm"), "df")
    toks = bounded_broadcast(toks, n_tokens, max_rows).join(ts, ["field", "tb", "lterm"])
    phrase = Window.partitionBy("query_id", "c")
    return (
        toks.withColumn("indexed", F.count(F.lit(1)).over(phrase))
        .withColumn("anchor", F.row_number().over(phrase.orderBy("df", "off")) == 1)
        .filter("indexed = k")
        .drop("indexed")
    )


CANDIDATE = ("query_id", "c", "doc_id")


def _slot(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BLOOM_BITS))


def candidate_filter(candidates: DataFrame, keys=CANDIDATE) -> DataFrame:
    """(bucket, bitmap): the Bloom filter of the keys, by default (query, phrase, document); 4 KiB for each bucket in use."""
    slots = candidates.select(_slot(keys).alias("slot"))
    bucket, bit = F.bitmap_bucket_number("slot"), F.bitmap_bit_position("slot")
    return slots.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def among_candidates(rows: DataFrame, bitmaps: DataFrame, keys=CANDIDATE, others: bool = False) -> DataFrame:
    """Rows whose bit of the filter is set: all rows of candidates, few others; ``others``: the rest of the rows."""
    bit = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    in_filter = F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1") == 1
    return (
        rows.withColumn("slot", _slot(keys))
        .withColumn("bucket", F.bitmap_bucket_number("slot"))
        .join(F.broadcast(bitmaps), "bucket", "left" if others else "inner")
        .withColumns({"_byte": byte, "_bit": bit})
        .filter(~F.coalesce(in_filter, F.lit(False)) if others else in_filter)
        .drop("slot", "bucket", "bitmap", "_byte", "_bit")
    )


def phrase_child_scores(toks: DataFrame, index: IndexTables, n_tokens: int, max_rows: int, splits: int) -> DataFrame:
    """Positional phrase match on content, rarest token first, without a theta join.

    ``toks`` are ``phrase_tokens``, read three times: keep them first.  Postings of each phrase's rarest token give its candidate documents.  The
    postings of its other tokens are streamed against the candidates' Bloom
    filter, so that positions of candidates alone are shuffled.  Positions
    shifted by the token's offset in the phrase must share a common start across
    all tokens: the start sets of one (query, phrase, document) are gathered, as
    many as the phrase has tokens, and intersected with ``array_intersect``.
    """
    keys = ["query_id", "doc_id", "n_children", "c", "k", "times"]

    def postings_of(tokens: DataFrame) -> DataFrame:
        return bounded_broadcast(tokens, n_tokens, max_rows).join(_postings_for(index), ["field", "tb", "lterm"])

    candidates = postings_of(toks.filter("anchor"))
    others = among_candidates(postings_of(toks.filter("NOT anchor")), candidate_filter(candidates.filter("k > 1")))
    hits = candidates.unionByName(others).select(
        *keys,
        _leaf(F.col("boost"), _idf(F.col("df"), index.n_docs), F.col("tf"), F.col("dl")).alias("leaf"),
        F.transform("positions", lambda p: p - F.col("off")).alias("starts"),
        F.element_at("positions", 1).alias("loc"),
        split_of(F.col("doc_id"), splits).alias("split"),
    ).repartition("query_id", "split")
    agg = hits.groupBy("split", *keys).agg(
        F.sum("leaf").alias("cscore"),
        F.count(F.lit(1)).alias("m"),
        F.collect_list("starts").alias("starts"),
        F.min("loc").alias("loc"),
    )
    common = F.aggregate(
        F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))),
        F.element_at("starts", 1),
        lambda acc, x: F.array_intersect(acc, x),
    )
    return agg.filter((F.col("m") == F.col("k")) & (F.size(common) > 0)).select(
        "query_id", "split", "doc_id", "n_children", "c", "cscore", "loc", "times"
    )


def score_matches(children: DataFrame) -> DataFrame:
    """Top-level OR: (matched children / children) * sum, per (query, doc); a child counts ``times`` times."""
    return children.groupBy("query_id", "split", "doc_id", "n_children").agg(
        (F.sum(F.col("cscore") * F.col("times")) * F.sum("times") / F.col("n_children")).alias("score"),
        F.min("loc").alias("loc"),
    )
