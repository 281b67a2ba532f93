"""Merkle manifest of a dataset by sibling-shift self-joins.

A row's leaf is the SHA-256 of its fields; the leaves of a group (a source) in
order of their ids form a tree in which every ``arity`` consecutive nodes, the
last run with fewer, become the digest of their digests, until one node, the
subroot, remains.  The subroots in order of their groups form the root's tree
alike.  Digests are hashed as lower-case hex text.

Every level is one join: each node sends its digest to the computed indices of
its siblings (index XOR 1 for a binary tree, else its slot shifted by 1, 2, ...
inside the run), and nodes meet what was sent to them on (tree, index).  Those
in slot zero emit the parents.  Keys are unique, so a group of any size spreads
over all tasks; a level has 1/arity of the rows of the one below.  Proofs are
then handed down from the root: a node's path is its own siblings and its
parent's path.

How it runs: leaves are hashed once and written with a row id.  Their index is
a prefix sum over range partitions; a tree is named by the place of its first
leaf in the whole order, a number.  Every level is written to the shared
folder, so a lost executor costs a read.  Only one number, the size of the
largest group, comes to the driver.

Cases: a null field is ``-``; null groups and null ids come first; rows that
repeat an id are ordered by their leaf, and equal rows are leaves of their own;
a group of one leaf is its own subroot; a run of one node, where others remain,
is hashed like any run; an empty table gives an empty result; very long texts
are hashed by Spark where they lie and never shuffled; extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, prefix_sum

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16

NO_PATH = "array<struct<left:binary,right:binary>>"


def digest(parts: Column) -> Column:
    """SHA-256, as bytes, of digests (bytes, one after another) written as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def text_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def field_text(value: Column) -> Column:
    """A field as hashed: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field_text, values)), 256))


def sibling_indices(index: Column, arity: int) -> Column:
    """The indices of a node's siblings, whether they exist or not."""
    if arity == 2:
        return F.array(index.bitwiseXOR(F.lit(1).cast("long")))
    slot = index % arity
    return F.array(*[index - slot + (slot + shift) % arity for shift in range(1, arity)])


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``left`` and ``right``: the digests of a node's siblings on each side, one after another.

    ``nodes`` holds tree, idx and digest; (tree, idx) is unique.
    """
    sent = nodes.select(
        "tree",
        (F.col("idx") % arity).cast("int").alias("slot"),
        "digest",
        F.explode(sibling_indices(F.col("idx"), arity)).alias("to"),
    ).select("tree", F.col("to").alias("idx"), F.struct("slot", "digest").alias("sent"))
    met = nodes.join(sent, ["tree", "idx"], "left").groupBy(*nodes.columns).agg(F.sort_array(F.collect_list("sent")).alias("sent"))
    slot = F.col("idx") % arity
    join = lambda side: F.aggregate(side, F.lit(b""), lambda joined, s: F.concat(joined, s["digest"]))
    return met.select(
        *nodes.columns,
        join(F.filter("sent", lambda s: s["slot"] < slot)).alias("left"),
        join(F.filter("sent", lambda s: s["slot"] > slot)).alias("right"),
    )


def is_top(prefix: str = "") -> Column:
    """The one node that is left of its tree: the first, without siblings."""
    c = lambda name: F.col(f"{prefix}{name}")
    return (c("idx") == 0) & (F.octet_length(c("left")) == 0) & (F.octet_length(c("right")) == 0)


def levels(nodes: DataFrame, most: int, arity: int, name: str) -> list[DataFrame]:
    """All levels of trees of at most ``most`` leaves, each written; the lowest keeps further columns."""
    out = []
    while True:
        out.append(materialize(with_siblings(nodes, arity), f"{name}-{len(out)}"))
        if most <= 1:
            return out
        most = -(-most // arity)
        nodes = out[-1].filter((F.col("idx") % arity == 0) & ~is_top()).select(
            "tree",
            (F.col("idx") / arity).cast("long").alias("idx"),
            digest(F.concat("digest", "right")).alias("digest"),
        )


def tops(stages: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the node that remains of each tree."""
    found = [s.filter(is_top()).select("tree", "digest") for s in stages]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def handed_down(stages: list[DataFrame], top: DataFrame, arity: int) -> DataFrame:
    """The lowest level with its path and what ``top`` says of its tree.

    ``top`` has tree, path (from that tree's top upwards) and further columns;
    ``path`` lists, upwards, the siblings left and right of a node.
    """
    said = [c for c in top.columns if c != "tree"]
    above = None
    for stage in reversed(stages):
        ends = stage.filter(is_top()).select("tree").join(top, "tree").select("tree", F.lit(0).cast("long").alias("parent"), *said)
        above = ends if above is None else above.unionByName(ends)
        stage = stage.withColumn("parent", (F.col("idx") / arity).cast("long"))
        here = F.array(F.struct("left", "right"))
        placed = stage.join(above, ["tree", "parent"]).withColumn(
            "path", F.when(is_top(), F.col("path")).otherwise(F.concat(here, "path"))
        )
        above = placed.select("tree", F.col("idx").alias("parent"), *said)
    return placed.drop("parent", "left", "right")


def merkle_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "source",
    id_col: str = "doc_id",
    arity: int = ARITY,
    presented: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per leaf: doc_id, tree, idx, digest, subroot, root, path, presented.

    ``digest`` is the leaf; ``presented`` the leaf of the row with the given
    columns in place of its own, as a reader might present it.  Digests are
    bytes; ``path`` lists the siblings left and right, from the leaf to the root.
    """
    shown = [(presented or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.col(group_col).alias("group"), F.col(id_col).alias("doc_id"),
        leaf([F.col(f) for f in fields]).alias("digest"), leaf(shown).alias("presented"),
    )
    leaves = materialize(leaves.withColumn("row_id", F.monotonically_increasing_id()), "leaves")
    order = [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("row_id")]
    one = leaves.withColumn("one", F.lit(1).cast("long"))
    placed = prefix_sum(one, order, "one", "idx", ["group"], name="leaf-order")
    placed = prefix_sum(placed, order, "one", "place", name="leaf-places")
    nodes = placed.select((F.col("place") - F.col("idx")).alias("tree"), "idx", "digest", "doc_id", "presented")
    nodes = materialize(nodes, "leaf-nodes")
    most = nodes.agg(F.max("idx")).first()[0]
    stages = levels(nodes, 0 if most is None else most + 1, arity, "level")

    subroots = tops(stages).withColumn("one", F.lit(1).cast("long"))  # trees are numbered in the order of their groups
    ranked = prefix_sum(subroots, [F.col("tree")], "one", "rank", name="subroots")
    upper = materialize(
        ranked.select(F.lit(0).cast("long").alias("tree"), F.col("rank").alias("idx"), "digest", F.col("tree").alias("named")),
        "subroot-nodes",
    )
    groups = upper.agg(F.max("idx")).first()[0]
    upper = levels(upper, 0 if groups is None else groups + 1, arity, "upper")
    root = tops(upper).select("tree", F.array().cast(NO_PATH).alias("path"), F.col("digest").alias("root"))
    top = handed_down(upper, root, arity).select(
        F.col("named").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    return handed_down(stages, top, arity)


def proof_digest(path: Column) -> Column:
    """SHA-256, as bytes, of all siblings of a path, upwards and from left to right."""
    return digest(F.aggregate(path, F.lit(b""), lambda joined, p: F.concat(joined, p["left"], p["right"])))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


def verify(manifest: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex text."""
    folded = fold(F.col("presented"), F.col("path"))
    return manifest.select(
        "doc_id",
        text_of(F.col("digest")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(F.col("root")).alias("root"),
        text_of(proof_digest(F.col("path"))).alias("proof_sha256"),
        text_of(folded).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
