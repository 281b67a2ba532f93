"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and into
shingles of ``words`` words, repeats included; a bit of its fingerprint is set
when it is set in more than half of the shingles' XXH64 values.  Fingerprints
with at most ``radius`` differing bits are linked; the radius must be even.

Two fingerprints are linked exactly if some value lies within half the radius
of both.  So every distinct fingerprint emits all variants within half the
radius; equal variants meet; the fingerprints of a meeting variant are linked
to the smallest of them, pairs are deduplicated and verified by their distance.

Variants are shuffled by their leading bits, and a fingerprint is sent once to
every prefix that any of its variants has; the variants below that prefix are
written out where they meet.  For 64 bits and radius 4 that sends 1 + b + b(b-1)/2
rows of one fingerprint for b leading bits instead of 2081 rows, and the same
variants meet.  ``b`` follows from the number of fingerprints.  Where more than
``PREFIX_MOST`` of them reach one prefix (near copies of one template), that
prefix is dealt out again by its next bits, with the flips that are left, until
none holds more; at full length a prefix is one variant, which at most 2081
fingerprints have.  So what meets in one group is bounded at any density.

Copies share a fingerprint and count once from the start; components are
joined back to documents on the fingerprint, a join that Spark splits where
one fingerprint holds many rows.  The hub of a large component is one key in the
rounds that find components: joins on it are dealt out by measured counts.

Cases: a null, empty or blank text has fingerprint zero, linked like any other;
fewer words than ``words`` make one shingle; repeated rows are kept, each with
its component; a null id never names a component unless all its ids are null;
an empty table gives an empty result; very long texts are hashed in blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_key, materialize, row_slices, shielded

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BITS = 64
#: Hashes unpacked to bits at once.
BLOCK = 65_536
#: Variants of one prefix that are aimed at, and the most that are sorted at once.
VARIANTS_AIM = 1 << 20
VARIANTS_MOST = 1 << 22
#: Fingerprints of one prefix that meet at once, and the bits by which a fuller prefix is dealt out.
PREFIX_MOST = 1 << 15
DEAL_BITS = 8
#: Shares of a table above which a key's rows are dealt out: at most so many keys can be.
HOT_SHARES = 256


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    return np.fromiter(
        (xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)
    )


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def compute(batches):
        for b in row_slices(batches):
            fps = [fingerprint(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed)], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(compute, f"doc_id {kind}, fp long")


def flips(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` low bits with at most ``most`` bits set."""
    masks = [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(width), k)]
    return np.array(masks, np.uint64)


def ball_size(width: int, most: int) -> int:
    return sum(math.comb(width, k) for k in range(most + 1))


def prefix_bits(n: int, half: int) -> int:
    """Leading bits by which ``n`` fingerprints are dealt out."""
    wanted = n * ball_size(BITS, half) / VARIANTS_AIM
    return int(min(48, max(4, math.ceil(math.log2(max(wanted, 1))))))


def meetings(low: np.ndarray, left: np.ndarray, who: np.ndarray, width: int):
    """Yields (i, j) index arrays: owners of equal variants, each with the first of its variant.

    ``low`` are the lowest ``width`` bits of fingerprints, of which ``left``
    may still be flipped.
    """
    sizes = [ball_size(width, r) for r in range(int(left.max(initial=0)) + 1)]
    total = sum(sizes[r] * int((left == r).sum()) for r in range(len(sizes)))
    if len(low) < 2:
        return
    if total > VARIANTS_MOST and width > 8:
        step = 6
        rest = width - step
        top = low >> np.uint64(rest)
        for sub in range(1 << step):
            need = np.bitwise_count(top ^ np.uint64(sub)).astype(np.int64)
            take = need <= left
            yield from meetings(
                low[take] & np.uint64((1 << rest) - 1), (left - need)[take], who[take], rest
            )
        return
    variants, owners = [], []
    for r in range(len(sizes)):
        rows = np.flatnonzero(left == r)
        if len(rows):
            variants.append((low[rows, None] ^ flips(width, r)[None, :]).ravel())
            owners.append(np.repeat(who[rows], sizes[r]))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variants)
    shared = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(shared):
        return
    shared = np.unique(shared)
    at = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
    hit = shared[at] == variants
    at, owners = at[hit], owners[hit]
    first = np.full(len(shared), np.iinfo(np.int64).max)
    np.minimum.at(first, at, owners)
    pairs = np.unique(np.stack([first[at], owners], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    yield pairs[:, 0], pairs[:, 1]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): verified pairs of distinct fingerprints (column fp) that hold every component together.

    Each linked pair is connected through the smallest fingerprint of a variant
    that both have; the pairs given are those, not all pairs of a group.
    """
    if radius % 2:
        raise ValueError("the radius must be even: variants lie within half of it")
    half = radius // 2
    bits = prefix_bits(fps.count(), half)
    sent = _dealt(fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(half).alias("left")), 0, bits, half)
    found = []
    while True:
        # The fingerprints of a prefix, counted with partial sums; rows are written only where one is too full.
        counts = sent.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= PREFIX_MOST or bits == BITS:
            return _met(sent, bits, radius, found).distinct()
        total = sent.count()
        with_n = hub_join(materialize(sent, "dealt"), counts, "prefix", "n", total, "fp")
        with_n = materialize(with_n.select("fp", "prefix", "left", "n"), "counted")
        found.append(_meet(with_n.filter(F.col("n") <= PREFIX_MOST), bits, radius))
        step = min(DEAL_BITS, BITS - bits)
        sent = _dealt(with_n.filter(F.col("n") > PREFIX_MOST), bits, step, half)
        bits += step


def _dealt(rows: DataFrame, bits: int, step: int, half: int) -> DataFrame:
    """(fp, prefix, left): each row under every prefix of ``bits + step`` bits that its flips ``left`` reach from its prefix."""
    rest = BITS - bits - step
    masks = [int(m) for m in flips(step, half)]
    reach = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m.bit_count()).alias("used")) for m in masks])
    own = F.shiftrightunsigned("fp", rest).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    out = rows.select("fp", "prefix", "left", F.explode(reach).alias("flip")).filter(F.col("flip.used") <= F.col("left"))
    prefix = F.shiftleft("prefix", step).bitwiseOR(own.bitwiseXOR(F.col("flip.mask").cast("long")))
    return out.select("fp", prefix.alias("prefix"), (F.col("left") - F.col("flip.used")).alias("left"))


def _met(sent: DataFrame, bits: int, radius: int, found: list[DataFrame]) -> DataFrame:
    """The pairs of ``sent`` and those found at shorter prefixes."""
    out = _meet(sent, bits, radius)
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def _meet(sent: DataFrame, bits: int, radius: int) -> DataFrame:
    """(a, b): verified pairs of fingerprints that have a variant below the same prefix of ``bits`` bits."""
    rest = BITS - bits

    def meet(key, table):
        order = np.argsort(table.column("fp").to_numpy().view(np.uint64), kind="stable")
        fp = table.column("fp").to_numpy().view(np.uint64)[order]
        left = table.column("left").to_numpy().astype(np.int64)[order]
        seen = [np.empty((0, 2), np.int64)]
        low = fp & np.uint64((1 << rest) - 1)
        for i, j in meetings(low, left, np.arange(len(fp)), rest):
            seen.append(np.stack([i, j], axis=1))
            if sum(map(len, seen)) > 4 * len(fp) + BLOCK:
                seen = [np.unique(np.concatenate(seen), axis=0)]
        pairs = np.unique(np.concatenate(seen), axis=0)
        a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
        near = np.bitwise_count(a ^ b) <= radius
        return pa.table({"a": a[near].view(np.int64), "b": b[near].view(np.int64)})

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "prefix").groupBy("prefix").applyInArrow(meet, "a long, b long")


def hub_join(rows: DataFrame, keys: DataFrame, key: str, count: str, total: int, by: str) -> DataFrame:
    """``rows`` joined to ``keys`` (unique in ``key``; ``count`` rows each), the rows of a hot key dealt out by ``by``.

    With at most ``total`` rows, fewer than ``HOT_SHARES`` keys can hold more
    than that share of them each: those are broadcast with the number of parts
    that their rows are dealt into, and stand in ``keys`` once for each part.
    """
    share = max(1, -(-total // HOT_SHARES))
    parts = F.ceil(F.col(count) / F.lit(share)).cast("int")
    # a hot key at least: never the case for more keys than shares
    hot = keys.filter(F.col(count) > share).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int"))
    spread = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.drop("_hot", "_parts").join(spread, [key, "_part"]).drop("_part")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes on edges (a, b).

    Alternating large-star and small-star rounds; every round is written to the
    shared folder, and the rounds end when one changes nothing.
    """

    def star(pairs: DataFrame, large: bool, most: int) -> DataFrame:
        both = pairs if not large else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # pairs hold a > b, so that small-star sees the smaller neighbours of a only
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count(F.lit(1)).alias("n"))
        joined = hub_join(both, low, "a", "n", most, "b")
        moved = joined.filter(F.col("b") > F.col("a")) if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not large:
            out = out.unionByName(low.select("a", F.col("low").alias("b")))
        return out.filter("a <> b").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    was = state(pairs)
    for _ in range(most_rounds if was[0] else 0):
        # a star of n pairs reads them from both ends and leaves no more than that
        pairs = materialize(star(pairs, True, 2 * was[0]), "edges")
        pairs = materialize(star(pairs, False, 2 * was[0]), "edges")
        now = state(pairs)
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def with_components(hashed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id to rows with doc_id and fp; one row for each row."""
    distinct = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    total = distinct.count()
    found = components(link_fingerprints(distinct, radius))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = hub_join(rooted, named, "root", "n", total, "fp").select("fp", "root", "component_id")
    return hashed.join(named, "fp", "left")


def simhash_dedup(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    hashed = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    return with_components(hashed, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_key() -> Column:
    """What tells rows apart: the id and the text (a null text is like an empty one)."""
    return F.struct(id_key("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))


def keep_representatives(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that with the smallest id.

    Where an id repeats with other texts, the row's text counts, not its id
    alone; of rows that repeat id and text one stays.  Of the documents with a
    null id, one of each component stays too, beside any that has an id.
    """
    docs, restore = shielded(docs, ("doc_id", "text"))
    keyed = docs.withColumn("_key", _row_key())
    hashed = fingerprints(keyed.withColumn("_row", F.struct("doc_id", F.col("_key.digest").alias("digest"))), words, "_row")
    hashed = hashed.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.digest").alias("digest"), "fp")
    hashed = materialize(hashed, "fingerprints")
    found = with_components(hashed, radius)
    chosen = found.groupBy("root", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "digest")).alias("row"))
    chosen = chosen.select(F.struct(id_key("row.doc_id").alias("id"), F.col("row.digest").alias("digest")).alias("_key"))
    return restore(keyed.join(chosen, "_key", "left_semi").dropDuplicates(["_key"]))
