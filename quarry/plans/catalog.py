"""Registered queries: one per operator family, run over the given tables.

Every query reads whole tables (``documents``, ``pages``, ``conversations``)
through the corpus views of ``quarry.sources.corpus``; query strings and
exclude lists are request parameters, as a user would send them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import (
    PROGRESS_COMPLETE,
    PROGRESS_STEP_CLEANED,
    SearchConfig,
)
from quarry.functions.format import format_size, iso_utc
from quarry.functions.paths import base_name, is_index_text
from quarry.functions.text import normalize_query, raw_tokens, split_words
from quarry.operators import listing as L
from quarry.operators.analysis import build_doc_stats
from quarry.operators.extract import assemble_documents
from quarry.operators.manifest import kv_delete, kv_keys, kv_put, manifest_to_kv
from quarry.operators.parse import parse_queries
from quarry.operators.progress import ledger_progress
from quarry.operators.validate import parse_exclude_text, validate_index_requests, validate_queries
from quarry.plans.search import search
from quarry.session import ensure_checkpoint_dir, materialize
from quarry.sources import corpus as C
from quarry.sources.store import IndexStore

# ---------------------------------------------------------------------------
# Request parameters (fixed values shared with the SQL oracle)
# ---------------------------------------------------------------------------
# A query log of 21 searches: (query_id, query, per_page, page).
BATCH_QUERIES = (
    (1, "license", 0, 0),
    (2, "worthless", 0, 0),
    (3, '"apache license"', 0, 0),
    (4, '"rights reserved"', 0, 0),
    (5, "licen", 0, 0),
    (6, "worth", 0, 0),
    (7, "of the", 0, 0),
    (8, "apache license", 0, 0),
    (9, "worthless license", 10, 1),
    (10, "doc42.txt", 5, 2),
    (11, "LICENSE", 0, 0),
    (12, '"apache license" worthless', 0, 0),
    (13, "released under the mit license", 0, 0),
    (14, "mit", 3, 2),
    (15, "version 2.0", 0, 0),
    (16, '"license', 0, 0),
    (17, "the", 0, 0),
    (18, "eau", 20, 1),
    (19, "md", 4, 3),
    (20, "reserved rights", 0, 0),
    (21, "/corpus/src12/en/doc12.txt", 0, 0),
)

PAGE_QUERIES = (
    (1, "nicht", 0, 0),
    (2, "margin", 0, 0),
    (3, '"var t"', 0, 0),
    (4, "track", 5, 2),
    (5, "div class", 0, 0),
    (6, "example", 0, 0),
    (7, "html", 10, 1),
    (8, "ad", 0, 0),
)

CONVERSATION_QUERIES = (
    (1, "des", 0, 0),
    (2, "le de", 0, 0),
    (3, '"qui de"', 0, 0),
    (4, "eau", 10, 2),
    (5, "avec", 0, 0),
    (6, "0.txt", 0, 0),
)

STORE_QUERIES = ((1, "license", 0, 0), (2, "revis", 0, 0), (3, "apache license", 0, 0), (4, "gone", 0, 0))

# Every file name begins with "doc".
DEEP_QUERIES = ((1, "doc", 20, 1), (2, "doc", 20, 50), (3, "doc", 20, 51), (4, "doc", 20, 501))

BLANK_QUERIES = ((1, "   ", 20, 2), (2, "", 7, 3), (3, "license", 5, 1), (4, "\t", 20, 60))

# Many quoted phrases, each matched by itself.
PHRASE_QUERIES = (
    (1, '"apache license" "rights reserved" "attion to thanedble"', 0, 0),
    (2, '"anea eriner" worthless', 0, 0),
    (3, '"de la" "le de" license', 0, 0),
    (4, '"ntre in onbleea of" "nowhere to be found"', 0, 0),
    (5, '"the of" "of the"', 0, 0),
    (6, '"license license" "thanedble the anea" "thanedble the anea"', 0, 0),
    (7, '"und der" "de la" "mit license" "apache" "released under the mit license"', 0, 0),
    (8, "thanedble the anea", 0, 0),
)

# Letters of the texts and what the ideograph query puts in their place: Han, Hiragana, Katakana, Hangul, a mark.
IDEOGRAPH_LETTERS = ("bhkpqvwxz", "中の東タ한々京\u3099\U00020000")

SINGLE_TERM = "license"
SINGLE_PREFIX = "licen"
SINGLE_FILENAME = "doc42.txt"
SINGLE_PHRASE = "apache license"
SINGLE_QUOTED = '"rights reserved"'
SINGLE_AND = "released mit"
RUN_TS = "2024-06-01 00:00:00"
CONTENT_CAP_TEST_BYTES = 1000


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _queries_df(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id long, query string, per_page int, page int")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return C.files_listing(spark, sf_dir)


def _corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return assemble_documents(C.texts_listing(spark, sf_dir))


#: Index stores built in this process: one for each application, state of the input table and tree.
_STORES: dict = {}
RUN_TIMES = (datetime(2029, 1, 1), datetime(2031, 1, 1), datetime(2032, 1, 1))
#: The table behind each tree.
_TREE_TABLES = {"corpus": "documents", "edited": "documents", "pages": "pages", "conversations": "conversations"}


def _table_state(spark: SparkSession, sf_dir: str, table: str) -> tuple:
    """Number, bytes and digest of a table's files: path, size and time of each; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/{table}.parquet")
    seen = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(seen)).first())


def _store(spark: SparkSession, sf_dir: str, tree: str) -> IndexStore:
    """The index store of a tree, built in the shared folder by its first user and again when its table has changed."""
    _utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir, tree, _table_state(spark, sf_dir, _TREE_TABLES[tree]))
    if key not in _STORES or _STORES[key].current() is None:
        store = IndexStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry/store-{tree}-{uuid.uuid4().hex}")
        if tree == "edited":
            for i, (listing, at) in enumerate(zip(C.edited_listings(spark, sf_dir), RUN_TIMES, strict=True), 1):
                store.update(listing.drop("doc_id"), C.CORPUS_ROOT, run_id=f"run{i}", run_ts=at)
        else:
            listing, root = {
                "corpus": (C.texts_listing, C.CORPUS_ROOT),
                "pages": (C.pages_listing, C.PAGES_ROOT),
                "conversations": (C.conversations_listing, C.CONVERSATIONS_ROOT),
            }[tree]
            store.update(listing(spark, sf_dir), root, run_id="run1", run_ts=RUN_TIMES[0])
        _STORES[key] = store
    return _STORES[key]


def _search(spark: SparkSession, sf_dir: str, rows, pick, tree: str = "corpus", config: SearchConfig = SearchConfig()):
    """Searches a built index; the rows that ``pick`` takes are written, then the search's caches released."""
    found = search(_queries_df(spark, rows), _store(spark, sf_dir, tree).open_index(), config)
    out = materialize(pick(found), "hits")
    found.unpersist()
    return out


def _matches(found) -> DataFrame:
    return found.matches.select("query_id", F.col("doc_id").alias("path"), "score")


def _hits(found) -> DataFrame:
    return _hits_out(found.hits)


def _hits_out(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        F.col("rank").cast("bigint").alias("rank"),
        "path",
        "name",
        "score",
        "size",
        "mod_time",
    )


# ---------------------------------------------------------------------------
# Listing and incremental-index operators
# ---------------------------------------------------------------------------
def q_listing_visible(spark, sf_dir):
    """S2 + S4: files under /corpus with no hidden part."""
    return L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT).select("path", "name", "size")


def q_listing_excluded(spark, sf_dir):
    """S3: visible files not below /corpus/src7 or /corpus/src1."""
    v = L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT)
    return L.drop_excluded(v, C.CORPUS_EXCLUDES).select("path")


def q_text_class(spark, sf_dir):
    """S7 + N3: index and snippet classification of every file."""
    f = L.classify_text(_files(spark, sf_dir))
    return f.select("path", "is_text", "is_snippet_text")


def _manifest(spark, sf_dir):
    return C.derived_manifest(_files(spark, sf_dir))


def q_changed_files(spark, sf_dir):
    """S6 + J4: new or changed visible files against the manifest."""
    v = L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT)
    ch = L.changed_files(v, _manifest(spark, sf_dir))
    return ch.select("path", "reason")


def q_deleted_files(spark, sf_dir):
    """Manifest paths under /corpus with no file any more."""
    return L.deleted_files(_files(spark, sf_dir), _manifest(spark, sf_dir), [C.CORPUS_ROOT])


def _previous_documents(spark, sf_dir):
    """Documents as the previous run indexed them: manifest paths still listed
    and visible, with mod_time = last_indexed."""
    f = L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT)
    m = _manifest(spark, sf_dir)
    prev = f.join(m, "path").withColumn("mod_time", F.col("last_indexed")).drop("last_indexed")
    gone = m.join(f.select("path"), "path", "left_anti").select(
        "path",
        base_name(F.col("path")).alias("name"),
        F.lit(False).alias("is_dir"),
        F.lit(0).cast("bigint").alias("size"),
        F.col("last_indexed").alias("mod_time"),
        F.lit("").alias("content"),
    )
    return assemble_documents(prev.select(*gone.columns).unionByName(gone))


def q_upsert_documents(spark, sf_dir):
    """Previous documents upserted with the changed set (by id)."""
    f = L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT)
    changed = assemble_documents(L.changed_files(f, _manifest(spark, sf_dir)))
    prev = _previous_documents(spark, sf_dir)
    out = prev.join(changed.select("id"), "id", "left_anti").unionByName(changed)
    return out.select("id", "name", "size", iso_utc(F.col("mod_time")).alias("mod_time"),
                      F.char_length("content").cast("bigint").alias("n_chars"))


def q_delete_documents(spark, sf_dir):
    """S11 + S15: previous documents minus those whose file is gone."""
    prev = _previous_documents(spark, sf_dir)
    gone = L.deleted_files(_files(spark, sf_dir), _manifest(spark, sf_dir), [C.CORPUS_ROOT])
    return prev.join(gone.select(F.col("path").alias("id")), "id", "left_anti").select("id")


def q_manifest_upsert(spark, sf_dir):
    """S15 + S16: manifest after a run: deleted rows removed, processed files
    stamped with the run timestamp."""
    f = L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT)
    m = _manifest(spark, sf_dir)
    gone = L.deleted_files(_files(spark, sf_dir), m, [C.CORPUS_ROOT])
    processed = L.changed_files(f, m).select("path")
    kept = m.join(gone, "path", "left_anti").join(processed, "path", "left_anti")
    stamped = processed.select("path", F.to_timestamp(F.lit(RUN_TS)).alias("last_indexed"))
    out = kept.unionByName(stamped)
    return out.select("path", iso_utc(F.col("last_indexed")).alias("last_indexed"))


def q_manifest_lookup(spark, sf_dir):
    """S17 + S18: per listed file, whether it is a manifest key and its time."""
    lk = L.manifest_lookup(_files(spark, sf_dir), _manifest(spark, sf_dir))
    return lk.select("path", "found", iso_utc(F.col("last_indexed")).alias("last_indexed"))


def q_manifest_json(spark, sf_dir):
    """The manifest as key/value JSON rows."""
    return manifest_to_kv(_manifest(spark, sf_dir))


def q_manifest_buckets(spark, sf_dir):
    """Keys of two buckets after puts and deletes.

    The manifest lies in the files bucket; changed files are put into the
    default bucket (named by an empty name), and gone files are deleted.
    """
    files, manifest = _files(spark, sf_dir), _manifest(spark, sf_dir)
    kv = manifest_to_kv(manifest)
    changed = L.changed_files(L.visible_files(files, C.CORPUS_ROOT), manifest)
    puts = changed.select(F.lit("").alias("bucket"), F.col("path").alias("key"), F.col("reason").alias("value"))
    gone = L.deleted_files(files, manifest, [C.CORPUS_ROOT])
    kv = kv_delete(kv_put(kv, puts), gone.select(F.lit("files").alias("bucket"), F.col("path").alias("key")))
    listed = [kv_keys(kv, name).withColumn("bucket", F.lit(name or "default")) for name in ("", "files")]
    return listed[0].unionByName(listed[1])


def q_run_progress(spark, sf_dir):
    """Run ledger with one batch per folder, progress after each batch.

    The running total is a distributed prefix sum, so no task gathers the
    whole ledger.
    """
    docs = _corpus_docs(spark, sf_dir)
    folder = F.regexp_extract(F.col("id"), r"^(.*)/[^/]*$", 1)
    ledger = docs.groupBy(folder.alias("batch")).agg(F.count(F.lit(1)).alias("n_done"))
    out = ledger_progress(ledger, "batch", PROGRESS_STEP_CLEANED, PROGRESS_COMPLETE)
    return out.select(
        "batch",
        F.col("n_done").cast("bigint").alias("n_done"),
        F.col("cum_done").cast("bigint").alias("cum_done"),
        F.col("progress").cast("bigint").alias("progress"),
    )


def q_doc_count(spark, sf_dir):
    """Number of documents in the built index."""
    return _store(spark, sf_dir, "corpus").documents().agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))


def q_store_documents(spark, sf_dir):
    """S10 + S11 + S15: documents of a store after a build, edits and additions, and a run that only deletes."""
    d = _store(spark, sf_dir, "edited").documents()
    return d.select("id", "name", "size", iso_utc(F.col("mod_time")).alias("mod_time"),
                    F.char_length("content").cast("bigint").alias("n_chars"), "truncated")


def q_store_manifest(spark, sf_dir):
    """That store's manifest, each path with the run that processed it."""
    m = _store(spark, sf_dir, "edited").manifest()
    return m.select("path", iso_utc(F.col("last_indexed")).alias("last_indexed"))


def q_store_term_stats(spark, sf_dir):
    """T4: that store's document frequencies, summed over its segments."""
    ts = _store(spark, sf_dir, "edited").term_stats()
    return ts.select("field", "term", F.col("df").cast("bigint").alias("df"))


def q_store_search(spark, sf_dir):
    """Q7 + Q9 + Q10 on that store: scores see live documents only."""
    return _search(spark, sf_dir, STORE_QUERIES, _matches, "edited")


def q_store_ledger(spark, sf_dir):
    """What that store's runs recorded."""
    ledger = _store(spark, sf_dir, "edited").ledger()
    return ledger.groupBy("run_id").agg(
        F.max("status").cast("bigint").alias("status"), F.max("n_done").cast("bigint").alias("n_done"),
        F.max("n_total").cast("bigint").alias("n_total"), F.count(F.lit(1)).alias("n_records"),
    )


def q_store_compacted(spark, sf_dir):
    """Term frequencies of postings after compaction of a store of its own."""
    _utc(spark)
    first, second, last = C.edited_listings(spark, sf_dir)
    store = IndexStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry/store-compact-{uuid.uuid4().hex}")
    store.update(first.drop("doc_id"), C.CORPUS_ROOT, run_ts=RUN_TIMES[0])
    store.update(last.drop("doc_id"), C.CORPUS_ROOT, run_ts=RUN_TIMES[1])
    store.compact()
    return store.postings().select("field", "term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl"))


def q_content_cap(spark, sf_dir):
    """S8 with a small cap: bytes kept per indexed text file."""
    f = L.visible_files(_files(spark, sf_dir), C.CORPUS_ROOT)
    f = f.filter(is_index_text(F.col("name")))
    d = assemble_documents(f, CONTENT_CAP_TEST_BYTES)
    # A cut inside a character leaves U+FFFD, so bytes are counted without it.
    whole = F.regexp_replace("content", "\uFFFD$", "")
    return d.select("path", F.octet_length(whole).cast("bigint").alias("capped_bytes"), "truncated")


# ---------------------------------------------------------------------------
# Index tables
# ---------------------------------------------------------------------------
def q_term_frequencies(spark, sf_dir):
    """Postings of all fields with tf and positions, from the built index."""
    p = _store(spark, sf_dir, "corpus").postings()
    return p.select(
        "field", "term", "doc_id",
        F.col("tf").cast("bigint").alias("tf"),
        F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"),
    )


def q_field_lengths(spark, sf_dir):
    """T4: field length per document."""
    s = build_doc_stats(_corpus_docs(spark, sf_dir))
    return s.select("field", "doc_id", F.col("len").cast("bigint").alias("len"))


def q_doc_frequencies(spark, sf_dir):
    """T4: document frequency per term, from the built index."""
    ts = _store(spark, sf_dir, "corpus").term_stats()
    return ts.select("field", "term", F.col("df").cast("bigint").alias("df"))


# ---------------------------------------------------------------------------
# Query side
# ---------------------------------------------------------------------------
def q_parse_queries(spark, sf_dir):
    """Q2 + Q3 + Q21 over the conversation log used as raw query strings,
    plus the query batch."""
    _utc(spark)
    conv = C.read_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )
    qs = conv.unionByName(_queries_df(spark, BATCH_QUERIES).select("query_id", "query"))
    p = parse_queries(qs)
    return p.select(
        "query_id",
        "q",
        F.array_join("phrases", "|").alias("phrases"),
        F.size("phrases").cast("bigint").alias("n_phrases"),
        "remaining",
        F.size(split_words(F.col("remaining"))).cast("bigint").alias("n_words"),
    )


def q_search_term(spark, sf_dir):
    """Q7 + R2: every match of one word, with its score."""
    return _search(spark, sf_dir, [(1, SINGLE_TERM, 0, 0)], _matches)


def q_search_prefix(spark, sf_dir):
    """Q9 + J3: every match of a word prefix."""
    return _search(spark, sf_dir, [(1, SINGLE_PREFIX, 0, 0)], _matches)


def q_search_filename(spark, sf_dir):
    """Q8: a file name that analyses to several tokens."""
    return _search(spark, sf_dir, [(1, SINGLE_FILENAME, 0, 0)], _matches)


def q_search_phrase(spark, sf_dir):
    """Q10 + Q11: implied phrase or all words."""
    return _search(spark, sf_dir, [(1, SINGLE_PHRASE, 0, 0)], _matches)


def q_search_quoted(spark, sf_dir):
    """Q6 + J2: quoted phrase."""
    return _search(spark, sf_dir, [(1, SINGLE_QUOTED, 0, 0)], _matches)


def q_search_per_phrase(spark, sf_dir):
    """Q6 + J2: queries of many quoted phrases, each phrase a clause of its own words."""
    return _search(spark, sf_dir, PHRASE_QUERIES, _matches, config=SearchConfig(phrase_mode="per_phrase"))


def q_search_and(spark, sf_dir):
    """Q11: two words, both required unless the phrase matches."""
    return _search(spark, sf_dir, [(1, SINGLE_AND, 0, 0)], _matches)


def q_search_ranked_topk(spark, sf_dir):
    """R3 + R4: best 10 for one word."""
    return _search(spark, sf_dir, [(1, SINGLE_TERM, 10, 1)], _hits)


def q_search_page(spark, sf_dir):
    """Second page of 5 for a prefix."""
    return _search(spark, sf_dir, [(1, SINGLE_PREFIX, 5, 2)], _hits)


def q_search_batch(spark, sf_dir):
    """J1-J3 + R4: 20 queries in one plan, each with its own page."""
    return _search(spark, sf_dir, BATCH_QUERIES, _hits)


def q_page_details(spark, sf_dir):
    """R5 + R6: totals and page details of the batch."""
    p = _search(spark, sf_dir, BATCH_QUERIES, lambda found: found.pages)
    return p.select(
        "query_id",
        "total_results",
        "max_score",
        F.col("current_page").cast("bigint").alias("current_page"),
        F.col("page_size").cast("bigint").alias("page_size"),
        F.col("total_pages").cast("bigint").alias("total_pages"),
        "has_next_page",
        "has_prev_page",
    )


def q_snippets(spark, sf_dir):
    """Snippets of the batch's page hits."""
    return _search(spark, sf_dir, BATCH_QUERIES, lambda found: found.hits.select("query_id", "rank", "path", "snippet"))


def q_snippets_bytes(spark, sf_dir):
    """Snippets of the batch's page hits, windows counted in bytes."""
    config = SearchConfig(snippet_unit="bytes")
    pick = lambda found: found.hits.select("query_id", "rank", "path", "snippet")
    return _search(spark, sf_dir, BATCH_QUERIES, pick, config=config)


def q_ideograph_tokens(spark, sf_dir):
    """Every document's tokens, some of its letters turned into ideographs, kana, Hangul and marks."""
    docs = C.read_table(spark, sf_dir, "documents")
    text = F.translate(F.coalesce("text", F.lit("")), *IDEOGRAPH_LETTERS)
    tokens = raw_tokens(text)
    return docs.select(
        "doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")
    )


def q_search_deep_pages(spark, sf_dir):
    """Pages of one broad prefix that end at ranks 20, 1000, 1020 and 10020."""
    return _search(spark, sf_dir, DEEP_QUERIES, _hits)


def q_search_match_all(spark, sf_dir):
    """Q1 + Q5: blank queries match every document, beside one that does not."""
    return _search(spark, sf_dir, BLANK_QUERIES, _hits, config=SearchConfig(blank_matches_all=True))


def q_search_pages(spark, sf_dir):
    """The search stack over raw HTML pages."""
    return _search(spark, sf_dir, PAGE_QUERIES, _hits, "pages")


def q_search_conversations(spark, sf_dir):
    """The search stack over chat turns."""
    return _search(spark, sf_dir, CONVERSATION_QUERIES, _hits, "conversations")


def q_validate_queries(spark, sf_dir):
    """Q14 + Q15 + Q20 over conversation turns used as search requests;
    per_page and page come from the turn and conversation numbers."""
    _utc(spark)
    conv = C.read_table(spark, sf_dir, "conversations")
    req = conv.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(F.col("role") == "system", F.lit("   ")).otherwise(F.col("text")).alias("query"),
        (F.col("turn") * 3 - 2).cast("int").alias("per_page"),
        (F.col("conv_id") % 4 - 1).cast("int").alias("page"),
    )
    v = validate_queries(req)
    return v.select(
        "query_id",
        F.col("per_page").cast("bigint").alias("per_page"),
        F.col("page").cast("bigint").alias("page"),
        "error",
    )


def q_validate_excludes(spark, sf_dir):
    """Q16-Q18: index requests built from the corpus folders.

    For each source folder: root = the folder; excludes typed as text
    '<root>/<lang>, <other source folder>/' with an extra blank entry.
    """
    f = _files(spark, sf_dir)
    src = f.select("source", "lang").distinct()
    req = src.select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("request_id"),
        F.concat(F.lit(C.CORPUS_ROOT + "/"), F.col("source")).alias("path"),
        F.concat(
            F.lit(C.CORPUS_ROOT + "/"), F.col("source"), F.lit("/"), F.col("lang"),
            F.lit(" , ,"),
            F.when(F.col("lang") == "en", F.lit(C.CORPUS_ROOT + "/src1"))
            .when(F.col("lang") == "de", F.concat(F.lit(C.CORPUS_ROOT + "/"), F.col("source")))
            .when(F.col("lang") == "fr", F.lit("relative/path"))
            .when(F.col("lang") == "es", F.concat(F.lit(C.CORPUS_ROOT + "/"), F.col("source"), F.lit("/es/")))
            .otherwise(F.lit("")),
        ).alias("exclude_text"),
    )
    req = req.withColumn("excludes", parse_exclude_text(F.col("exclude_text")))
    v = validate_index_requests(req, f)
    return v.select(
        "request_id", F.array_join("excludes", "|").alias("excludes"), "error"
    )


def q_format_size(spark, sf_dir):
    """Q19: display size of every file."""
    return _files(spark, sf_dir).select("path", "size", format_size(F.col("size")).alias("size_text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "listing_visible": q_listing_visible,
    "listing_excluded": q_listing_excluded,
    "text_class": q_text_class,
    "changed_files": q_changed_files,
    "deleted_files": q_deleted_files,
    "upsert_documents": q_upsert_documents,
    "delete_documents": q_delete_documents,
    "manifest_upsert": q_manifest_upsert,
    "manifest_lookup": q_manifest_lookup,
    "manifest_json": q_manifest_json,
    "manifest_buckets": q_manifest_buckets,
    "run_progress": q_run_progress,
    "doc_count": q_doc_count,
    "store_documents": q_store_documents,
    "store_manifest": q_store_manifest,
    "store_term_stats": q_store_term_stats,
    "store_search": q_store_search,
    "store_ledger": q_store_ledger,
    "store_compacted": q_store_compacted,
    "content_cap": q_content_cap,
    "term_frequencies": q_term_frequencies,
    "field_lengths": q_field_lengths,
    "doc_frequencies": q_doc_frequencies,
    "parse_queries": q_parse_queries,
    "search_term": q_search_term,
    "search_prefix": q_search_prefix,
    "search_filename": q_search_filename,
    "search_phrase": q_search_phrase,
    "search_quoted": q_search_quoted,
    "search_per_phrase": q_search_per_phrase,
    "search_and": q_search_and,
    "search_ranked_topk": q_search_ranked_topk,
    "search_page": q_search_page,
    "search_batch": q_search_batch,
    "page_details": q_page_details,
    "snippets": q_snippets,
    "snippets_bytes": q_snippets_bytes,
    "ideograph_tokens": q_ideograph_tokens,
    "search_deep_pages": q_search_deep_pages,
    "search_match_all": q_search_match_all,
    "search_pages": q_search_pages,
    "search_conversations": q_search_conversations,
    "validate_queries": q_validate_queries,
    "validate_excludes": q_validate_excludes,
    "format_size": q_format_size,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the 20-query batch, ranked and paged."""
    return q_search_batch(spark, sf_dir)


__all__ = ["QUERIES", "flagship", "normalize_query"]
