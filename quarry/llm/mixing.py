"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh ``WEIGHTS`` in turn and
share ``SHARE`` of all words; a target stops at ``CAP`` times its source's
size, and the excess is shared again by weight until none is above.

Rates: among all rates of documents whose words add up to a source's target,
those nearest to the corpus as it is (rate 1) in relative entropy, where a
document weighs size ** (1 - POWER).  They are tilted exponentially,
rate = min(CAP, exp(dual * (size / mean size) ** POWER)), with one dual
variable for each source: power 1 weighs all documents alike and tilts by their
length, power 0 weighs words alike and gives all documents of a source one
rate.  The convex dual is solved by Newton steps, kept inside a bracket, for
all sources at once; each step is one aggregation over (source, size) counts.

Copies: rates become whole copies by systematic rounding along each source in
order of size, so that errors of neighbours cancel; then a few documents of
each size class, chosen by hash, gain or lose a copy to close what is left.

Sums that steer a decision are sums of whole numbers, so reruns agree whatever
the order in which partitions are added up.

Cases: a null text has size 0 and is never taken; null is a source of its own;
repeated rows count each; a source without words has target 0; an empty table
gives an empty result; a source that holds most rows is split by range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WS_WORD, materialize, prefix_sum, shielded

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
POWER = 0.25
#: Newton stops when each source's words are this near to its target.
TOLERANCE = 1e-6
ROUNDS = 60
#: Rates as whole numbers.
UNIT = 1 << 30
#: Documents of a source and size class that may change by a copy.
CANDIDATES = 4
MOVES = 4


def document_sizes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None
) -> DataFrame:
    """(row_id, doc_id, source, size), written once; ``row_col`` tells rows of ``docs`` apart if given."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WS_WORD)), F.lit(0)).cast("long")
    return materialize(
        docs.select(
            row.alias("row_id"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")
        ),
        "sizes",
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, docs, target) for each source; only sums reach the driver."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = prefix_sum(
        sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "place", name="sources"
    )
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight).drop("one", "place"), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, before = 0.0, None
    while level != before:  # words for each unit of weight; only grows, as more sources reach their cap
        capped = F.col("weight") * F.lit(level) >= cap * F.col("source_size")
        full, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        if not open_weight:
            break
        before, level = level, (share * total - cap * full) / open_weight
    return ranked.withColumn(
        "target", F.least(F.col("weight") * F.lit(float(level)), (cap * F.col("source_size")).cast("double"))
    ).drop("weight")


def _tilt(size: Column, mean: Column, power: float) -> Column:
    return F.pow(size / mean, F.lit(float(power)))


def solve_duals(sizes: DataFrame, goals: DataFrame, cap: int = CAP, power: float = POWER) -> DataFrame:
    """Adds to ``goals`` the dual variable of each source; null where all documents are at the cap."""
    counts = materialize(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    at_cap = F.col("target") >= cap * F.col("source_size")
    mean = F.col("source_size") / F.col("docs")
    state = goals.withColumns(
        {
            "mean": mean,
            "dual": F.when(~at_cap, F.log(F.col("target") / F.col("source_size"))),
            "low": F.lit(float("-inf")),
            "high": F.lit(float("inf")),
            "off": F.when(at_cap, 0.0),
        }
    )
    state = materialize(state, "duals")
    whole = lambda c: F.sum(F.round(c * 1_000_000).cast("decimal(30,0)"))
    for _ in range(ROUNDS):
        # The rounds have as many rows as there are sources; Spark broadcasts them only while they are small.
        now = state.filter("dual IS NOT NULL").select(F.col("source").alias("s"), "dual", "mean")
        x = _tilt(F.col("size"), F.col("mean"), power)
        free = F.col("dual") * x < F.log(F.lit(float(cap)))
        rate = F.when(free, F.exp(F.col("dual") * x)).otherwise(F.lit(float(cap)))
        mass = F.col("n") * F.col("size") * rate
        sums = (
            counts.join(now, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(whole(mass).alias("words"), whole(F.when(free, mass * x).otherwise(0.0)).alias("slope"))
            .select("s", F.col("words").cast("double") / 1e6, F.col("slope").cast("double") / 1e6)
            .toDF("s", "words", "slope")
        )
        step = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        excess = F.col("words") - F.col("target")
        low = F.when(excess < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(excess > 0, F.col("dual")).otherwise(F.col("high"))
        # Newton on log(words), which is nearly linear; outside the bracket, halve or double instead.
        newton = F.col("dual") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low2")) & (newton < F.col("high2"))
        fallback = (
            F.when(F.col("low2") == float("-inf"), F.col("high2") - 1.0)
            .when(F.col("high2") == float("inf"), F.col("low2") + 1.0)
            .otherwise((F.col("low2") + F.col("high2")) / 2)
        )
        off = F.when(F.col("target") > 0, F.abs(excess) / F.col("target")).otherwise(0.0)
        step = step.withColumns({"low2": low, "high2": high, "off2": off})
        moved = F.when(F.col("off2") <= TOLERANCE, F.col("dual")).when(inside, newton).otherwise(fallback)
        state = step.select(
            "source", "source_size", "docs", "target", "mean",
            F.when(F.col("dual").isNotNull(), moved).alias("dual"),
            F.col("low2").alias("low"), F.col("high2").alias("high"),
            F.coalesce(F.when(F.col("dual").isNotNull(), F.col("off2")), F.lit(0.0)).alias("off"),
        )
        state = materialize(state, "duals")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"the duals did not converge: a source is off its target by a share of {worst}")
    return state.select("source", "source_size", "target", "mean", "dual")


def round_to_copies(rated: DataFrame) -> DataFrame:
    """Adds ``copies`` from whole-number rates (rate / UNIT) by systematic rounding in each source."""
    order = [
        F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id"), F.col("row_id"),
    ]
    placed = prefix_sum(rated, order, "rate", "before", group=["source"], name="rates")
    half = UNIT // 2
    whole = lambda c: F.shiftright(c, 30)  # noqa: E731  exact, where a quotient of doubles is not
    count = whole(F.col("before") + F.col("rate") + half) - whole(F.col("before") + half)
    return placed.withColumn("copies", count.cast("long")).drop("before")


def close_gaps(rounded: DataFrame, cap: int = CAP) -> DataFrame:
    """Moves a few documents of each source by a copy towards its target."""
    gaps = rounded.groupBy("source").agg(
        F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("taken")
    ).select(F.col("source").alias("s"), (F.col("t") - F.col("taken")).alias("gap"))
    # Candidates first, so that only they, not all rows, meet the gaps of their sources.
    kind = Window.partitionBy("source", F.length(F.bin("size"))).orderBy(F.xxhash64("doc_id"), "doc_id", "row_id")
    few = rounded.filter("size > 0").withColumn("rank", F.row_number().over(kind)).filter(F.col("rank") <= CANDIDATES)
    few = few.join(gaps, F.col("source").eqNullSafe(F.col("s"))).filter("abs(gap) >= 0.5")

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        """Up to MOVES times, the one or two changes that leave the smallest gap."""
        rows = rows.sort_values(["size", "rank", "row_id"])
        gap, out = float(rows["gap"].iloc[0]), []
        up, down = rows[rows["copies"] < cap], rows[rows["copies"] > 0]
        ids = np.r_[up["row_id"], down["row_id"]].astype(np.int64)
        step = np.r_[np.ones(len(up), np.int64), -np.ones(len(down), np.int64)]
        words = step * np.r_[up["size"], down["size"]].astype(np.int64)
        for _ in range(MOVES):
            # With the empty change first, a single change is a pair with it.
            change = np.r_[0, words]
            left = np.abs(gap - (change[:, None] + change[None, :]))
            left[np.r_[-1, ids][:, None] == np.r_[-2, ids][None, :]] = np.inf
            i, j = np.unravel_index(np.argmin(left), left.shape)
            if left[i, j] >= abs(gap):
                break
            gap -= float(change[i] + change[j])
            used = [k - 1 for k in (i, j) if k]
            out += [(ids[k], step[k]) for k in used]
            keep = ~np.isin(ids, ids[used])
            ids, step, words = ids[keep], step[keep], words[keep]
        return pd.DataFrame(out, columns=["moved_row", "moved"])

    # At most CANDIDATES rows for each power of two in a group.
    moves = few.select("source", "row_id", "size", "copies", "rank", "gap").groupBy("source").applyInPandas(
        nearest, "moved_row long, moved long"
    )
    moves = materialize(moves, "moves")
    return rounded.join(moves, F.col("row_id") == F.col("moved_row"), "left").withColumn(
        "copies", F.col("copies") + F.coalesce("moved", F.lit(0))
    ).drop("moved_row", "moved")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    power: float = POWER,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: row_id, doc_id, source, size, source_size, target, rate, copies, taken."""
    sizes = document_sizes(docs, id_col, text_col, source_col, row_col)
    duals = solve_duals(sizes, targets(sizes, weights, share, cap), cap, power).withColumnRenamed("source", "s")
    tilt = F.exp(F.col("dual") * _tilt(F.col("size"), F.col("mean"), power))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("dual").isNull(), float(cap)).otherwise(F.least(tilt, F.lit(float(cap))))
    rated = sizes.join(duals, F.col("source").eqNullSafe(F.col("s"))).select(
        "row_id", "doc_id", "source", "size", "source_size", "target", F.round(rate * UNIT).cast("long").alias("rate")
    )
    rounded = materialize(round_to_copies(rated), "copies")
    return close_gaps(rounded, cap).select(
        "row_id", "doc_id", "source", "size", "source_size", "target",
        (F.col("rate") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it, with its columns.

    Texts are written once beside a row id, by which they meet their copies.
    """
    docs, restore = shielded(docs, ("doc_id", "text", "source"))
    numbered = materialize(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")
    copies = mix(numbered, row_col="_mix_row").filter("copies > 0")
    copies = copies.select(F.col("row_id").alias("_mix_row"), F.col("copies").alias("_mix_copies"))
    taken = numbered.join(copies, "_mix_row").withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))
    )
    return restore(taken)
