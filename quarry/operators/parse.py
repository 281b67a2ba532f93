"""Query compilation: queries table -> clause tables (Q1-Q6, Q8-Q11, Q14, Q21).

A search request is a row of ``queries(query_id, query, per_page, page)``.
Each query becomes a boosted OR of top-level children:

- one ``phrase`` child per quoted phrase (boost 6; in ``as_built`` mode its
  text is the whole normalised query, in ``per_phrase`` mode the phrase);
- for the remaining words (or the whole query when nothing was parsed):
  one word -> its single-term clauses are themselves children: content match
  (3), name match (2), path match (1) and, for words over 2 bytes, name and
  content prefix (1.5); several words -> a ``phrase`` child on the words
  (boost 5) plus an ``and`` child whose every word must match through its
  single-term clauses.

The output is three tables, all small (bounded by the query text):

- ``prepared``: per query the normalised text, paging and ``n_children``;
- ``phrases``: (query_id, c, text, boost) phrase children;
- ``groups``: (query_id, c, t, s, kind, field, term, boost, n_subs, n_terms)
  single-term clauses; ``t = -1`` marks a clause that is itself a child,
  otherwise ``t`` is the word number inside the ``and`` child ``c``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import (
    BOOST_CONTENT,
    BOOST_NAME,
    BOOST_PATH,
    BOOST_PREFIX,
    BOOST_QUOTED_PHRASE,
    BOOST_REGULAR_PHRASE,
    DEFAULT_PER_PAGE,
    PREFIX_MIN_BYTES,
)
from quarry.functions.text import (
    analyzed_terms,
    constant_columns,
    is_stop_word,
    normalize_query,
    raw_tokens,
    split_words,
    trim_ws,
)

_QUOTED_RE = r'"([^"]*)"'


@dataclass
class CompiledQueries:
    prepared: DataFrame
    phrases: DataFrame
    groups: DataFrame


def apply_defaults(queries: DataFrame) -> DataFrame:
    """Q14: per_page 0 or null -> 20, page 0 or null -> 1."""
    pp = F.coalesce(F.col("per_page"), F.lit(0))
    pg = F.coalesce(F.col("page"), F.lit(0))
    return queries.withColumn(
        "per_page", F.when(pp == 0, F.lit(DEFAULT_PER_PAGE)).otherwise(pp).cast("int")
    ).withColumn("page", F.when(pg == 0, F.lit(1)).otherwise(pg).cast("int"))


def quoted_phrases(q):
    """Q3: trimmed, non-blank quoted phrases of a (normalised) query."""
    found = F.regexp_extract_all(q, F.lit(_QUOTED_RE), 1)
    return F.filter(F.transform(found, trim_ws), lambda x: x != F.lit(""))


def remaining_terms(q):
    """Q3: the query with each quoted span replaced by one space, trimmed."""
    return trim_ws(F.regexp_replace(q, _QUOTED_RE, " "))


def parse_queries(queries: DataFrame) -> DataFrame:
    """Q2 + Q3 + Q21 per query: q, phrases, remaining, branch, terms.

    Q4: the query is an OR of one clause per quoted phrase plus the
    remaining-terms clause (``branch``); when nothing was parsed the whole
    string is the terms clause.  ``compile_queries`` explodes these into the
    clause tables that the score tree ORs by aggregation.
    """
    q = normalize_query(F.col("query"))
    p = queries.withColumn("q", q)
    p = p.withColumn("phrases", quoted_phrases(F.col("q"))).withColumn("remaining", remaining_terms(F.col("q")))
    branch = (
        F.when((F.size("phrases") == 0) & (F.col("remaining") == ""), F.col("q"))
        .when(F.col("remaining") != "", F.col("remaining"))
        .otherwise(F.lit(None).cast("string"))
    )
    p = p.withColumn("branch", branch)
    p = p.withColumn(
        "terms",
        F.when(F.col("branch").isNull(), F.array().cast("array<string>")).otherwise(split_words(F.col("branch"))),
    )
    return p


def _sub_clauses():
    """Single-term clauses in child order: kind, field, boost, needs_prefix."""
    rows = [
        ("match", "content", BOOST_CONTENT, False),
        ("match", "name", BOOST_NAME, False),
        ("match", "path", BOOST_PATH, False),
        ("prefix", "name", BOOST_PREFIX, True),
        ("prefix", "content", BOOST_PREFIX, True),
    ]
    return constant_columns(
        "sub_clauses",
        lambda: F.array(
            *[
                F.struct(
                    F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(b).alias("boost"), F.lit(px).alias("px")
                )
                for k, f, b, px in rows
            ]
        ),
    )


def _subs_for(term):
    long_enough = F.octet_length(term) >= PREFIX_MIN_BYTES
    return F.filter(_sub_clauses(), lambda s: ~s["px"] | long_enough)


def compile_queries(queries: DataFrame, phrase_mode: str = "as_built") -> CompiledQueries:
    """Queries (already defaulted and validated) -> clause tables.

    Q1: a query that is blank after trimming yields no clauses (no hits);
    it keeps its ``prepared`` row so it still gets page details.
    """
    p = parse_queries(queries)
    n_terms = F.size("terms")
    n_phr = F.size("phrases")
    n_single = F.size(_subs_for(F.try_element_at("terms", F.lit(1))))
    n_children = (
        n_phr
        + F.when(n_terms == 1, n_single).when(n_terms > 1, F.lit(2)).otherwise(F.lit(0))
    ).cast("int")
    prepared = p.select(
        "query_id",
        "query",
        "per_page",
        "page",
        "q",
        "phrases",
        "remaining",
        "terms",
        n_phr.cast("int").alias("n_phr"),
        n_terms.cast("int").alias("n_terms"),
        n_children.alias("n_children"),
    )

    live = prepared.filter(F.col("q") != "")
    quoted = live.select(
        "query_id",
        "n_children",
        "q",
        F.posexplode("phrases").alias("c", "phrase"),
    ).select(
        "query_id",
        "n_children",
        F.col("c").cast("int").alias("c"),
        (F.col("phrase") if phrase_mode == "per_phrase" else F.col("q")).alias("text"),
        F.lit(BOOST_QUOTED_PHRASE).alias("boost"),
    )
    # Clauses of one text are one row that counts so many times: in ``as_built``
    # mode all quoted phrases of a query are, since each holds the whole query.
    quoted = quoted.groupBy("query_id", "n_children", "text", "boost").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).cast("int").alias("times")
    )
    # The implied phrase runs on the remaining string itself (or the whole
    # query when nothing was parsed), not on the re-joined words.
    implied = live.filter(F.col("n_terms") > 1).select(
        "query_id",
        "n_children",
        F.col("n_phr").alias("c"),
        F.when((F.col("n_phr") == 0) & (F.col("remaining") == ""), F.col("q"))
        .otherwise(F.col("remaining"))
        .alias("text"),
        F.lit(BOOST_REGULAR_PHRASE).alias("boost"),
        F.lit(1).alias("times"),
    )
    phrases = quoted.unionByName(implied)
    # Query text is tokenised once here; later steps read these columns.
    phrases = phrases.withColumn("rtoks", raw_tokens(F.col("text"))).withColumn(
        "k", F.size(F.filter("rtoks", lambda t: ~is_stop_word(t)))
    )

    single = live.filter(F.col("n_terms") == 1).select(
        "query_id",
        "n_children",
        "n_phr",
        F.try_element_at("terms", F.lit(1)).alias("term"),
        F.posexplode(_subs_for(F.try_element_at("terms", F.lit(1)))).alias("s", "sub"),
    )
    single = single.select(
        "query_id",
        "n_children",
        (F.col("n_phr") + F.col("s")).cast("int").alias("c"),
        F.lit(-1).alias("t"),
        F.lit(0).alias("s"),
        F.col("sub.kind").alias("kind"),
        F.col("sub.field").alias("field"),
        "term",
        F.col("sub.boost").alias("boost"),
        F.lit(1).alias("n_subs"),
        F.lit(0).alias("n_terms"),
    )
    multi = live.filter(F.col("n_terms") > 1).select(
        "query_id", "n_children", "n_phr", "n_terms", F.posexplode("terms").alias("t", "term")
    )
    multi = multi.select(
        "query_id",
        "n_children",
        "n_phr",
        "n_terms",
        "t",
        "term",
        F.size(_subs_for(F.col("term"))).alias("n_subs"),
        F.posexplode(_subs_for(F.col("term"))).alias("s", "sub"),
    ).select(
        "query_id",
        "n_children",
        (F.col("n_phr") + 1).cast("int").alias("c"),
        F.col("t").cast("int").alias("t"),
        F.col("s").cast("int").alias("s"),
        F.col("sub.kind").alias("kind"),
        F.col("sub.field").alias("field"),
        "term",
        F.col("sub.boost").alias("boost"),
        F.col("n_subs").cast("int").alias("n_subs"),
        F.col("n_terms").cast("int").alias("n_terms"),
    )
    groups = single.unionByName(multi)
    groups = groups.withColumn(
        "atoks",
        F.when((F.col("kind") == "match") & (F.col("field") != "path"), analyzed_terms(F.col("term"))),
    )
    return CompiledQueries(prepared=prepared, phrases=phrases, groups=groups)


def persist_compiled(cq: CompiledQueries) -> CompiledQueries:
    """Keep the (small) clause tables once instead of re-deriving them at
    every use in the plan; they are bounded by the query text."""
    return CompiledQueries(
        prepared=cq.prepared.persist(),
        phrases=cq.phrases.persist(),
        groups=cq.groups.persist(),
    )
