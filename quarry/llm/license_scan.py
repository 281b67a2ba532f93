"""Licence scan: ordered signature rules with keyword prefilter and suppression.

Built from DataFrame functions only; every step is per row, without a shuffle.

A text is lower-cased (A-Z) and cut into words.  One pattern over all keywords
tells the few texts that hold any; of those, the words are numbered inside the
text ("the/0 mit/1 license/2"), so that every match of a rule carries its
place, and each rule whose keyword occurs is matched.  Detections of all rules
are then swept in order of their places: a detection whose interval lies
inside that of a detection of stronger priority is suppressed.  The sweep
keeps the farthest end of each priority and gathers what stays in blocks, so
its work grows with the detections of a text, not with their pairs.

Base phrases count apart, with all their places, suppressed or not.

Cases: null and empty texts have no words, no places and score 0; repeated
rows are scanned alike; extra columns do no harm; an empty table gives an
empty result; a long text is one row, in memory linear in its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower
from quarry.llm.license_rules import CONFIDENCE, RULES

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Characters between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PRIORITIES = sorted(CONFIDENCE)

#: Detections of a text that are swept together.
BLOCK = 256


def numbered(pattern: str) -> str:
    """A rule's pattern for numbered words: each word is followed by / and its place."""
    gap = "/[0-9]+ "
    inner = gap.join(part for part in pattern.replace(" ?", f"(?:{gap})?".replace(" ", "\0")).split(" "))
    return "(?<![^ ])(?:" + inner.replace("\0", " ") + ")/[0-9]+"


def prefix_tree(words: list[str]) -> str:
    """A pattern for any of the words, sharing their common beginnings; shorter words win."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        parts = [c + pattern(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return pattern(tree)


def _place(match: Column, last: bool) -> Column:
    return F.regexp_extract(match, r"/([0-9]+)$" if last else r"^[^/]*/([0-9]+)", 1).cast("int")


def _detections(keywords: Column, text: Column, rules: list) -> Column:
    table = F.array(
        *[
            F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(numbered(r)).alias("pattern"))
            for p, label, k, r in rules
        ]
    )

    def found(rule: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(text, rule["pattern"], F.lit(0)),
            lambda m: F.struct(
                _place(m, False).alias("start"),
                (-_place(m, True)).alias("minus_end"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
            ),
        )

    return F.sort_array(F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(keywords, r["keyword"])), found)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _unsuppressed(detections: Column) -> Column:
    """The detections, in order, that no stronger one contains.

    A fold over blocks of ``BLOCK`` detections, and inside over each block.  As a
    fold copies its state at each step, the inner one holds no more than a
    block, and only the outer one, with few steps, all that is kept.
    """
    kind = "struct<start:int,minus_end:int,priority:int,label:string>"
    none = F.array().cast(f"array<{kind}>")

    def state(ends: list[Column], kept: Column) -> Column:
        return F.struct(*[e.alias(f"end{p}") for p, e in zip(PRIORITIES, ends, strict=True)], kept.alias("kept"))

    def ends_of(s: Column) -> list[Column]:
        return [s[f"end{p}"] for p in PRIORITIES]

    def step(s: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside = reduce(lambda a, b: a | b, [(d["priority"] > p) & (e >= end) for p, e in zip(PRIORITIES, ends_of(s), strict=True)])
        farther = [F.when(d["priority"] == p, F.greatest(e, end)).otherwise(e) for p, e in zip(PRIORITIES, ends_of(s), strict=True)]
        return state(farther, F.concat(s["kept"], F.when(inside, none).otherwise(F.array(d))))

    def sweep(s: Column, block: Column) -> Column:
        swept = F.aggregate(block, state(ends_of(s), none), step)
        return _let(swept, lambda x: state(ends_of(x), F.concat(s["kept"], F.array(x["kept"]))))

    blocks = _let(
        detections, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(BLOCK)), lambda at: F.slice(x, at, BLOCK))
    )
    start = state([F.lit(-1) for _ in PRIORITIES], F.array().cast(f"array<array<{kind}>>"))
    return F.aggregate(blocks, start, sweep, lambda s: F.flatten(s["kept"]))


def scan_licenses(
    docs: DataFrame, rules: list = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document.

    doc_id, n_words, n_base, first_word, last_word, base_labels (array),
    detections (array of label, priority, first and last word), score.
    """
    keywords = sorted({k for _, _, k, _ in rules} | {p for p, _ in BASE})
    any_keyword = f"(?<![^ ]){prefix_tree(keywords)}"
    step = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    step = step.withColumn("flat", F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), BETWEEN, " ")))
    n_words = F.char_length("flat") - F.char_length(F.replace("flat", F.lit(" "), F.lit(""))) + 1
    step = step.select(
        "doc_id",
        F.when(F.col("flat") == "", F.lit(0)).otherwise(n_words).cast("long").alias("n_words"),
        F.when(F.col("flat").rlike(any_keyword), F.col("flat")).alias("flat"),  # null: no rule can match
    )
    step = step.withColumns(
        {
            "keywords": F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("flat"), k)),
            "marked": F.array_join(
                F.transform(F.split("flat", " "), lambda w, i: F.concat(w, F.lit("/"), i.cast("string"))), " "
            ),
        }
    )
    places = [F.regexp_extract_all("marked", F.lit(numbered(p)), F.lit(0)) for p, _ in BASE]
    step = step.withColumns({f"base{i}": F.transform(m, lambda x: _place(x, False)) for i, m in enumerate(places)})
    step = step.withColumn("found", _detections(F.col("keywords"), F.col("marked"), rules))
    step = step.withColumn("kept", _unsuppressed(F.col("found")))
    step = step.withColumns(
        {
            "all_base": F.concat(*[f"base{i}" for i in range(len(BASE))]),
            "detections": F.transform(
                "kept",
                lambda d: F.struct(
                    d["label"].alias("label"),
                    d["priority"].alias("priority"),
                    d["start"].cast("long").alias("first_word"),
                    (-d["minus_end"]).cast("long").alias("last_word"),
                ),
            ),
        }
    )
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base{i}") > 0, F.lit(l)) for i, (_, l) in enumerate(BASE)]))
    confidence = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    kinds = F.array_distinct(F.transform("detections", lambda d: F.struct(d["label"], d["priority"])))
    doubt = F.aggregate(kinds, F.lit(1.0), lambda s, k: s * (1.0 - F.try_element_at(confidence, k["priority"])))
    none = F.array().cast("array<struct<label:string,priority:int,first_word:bigint,last_word:bigint>>")
    return step.select(
        "doc_id",
        "n_words",
        F.when(F.col("all_base").isNull(), F.lit(0)).otherwise(F.size("all_base")).cast("long").alias("n_base"),
        F.array_min("all_base").cast("long").alias("first_word"),
        F.array_max("all_base").cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.coalesce("detections", none).alias("detections"),
        F.coalesce(1.0 - doubt, F.lit(0.0)).alias("score"),
    )


def label_digest(scanned: DataFrame) -> DataFrame:
    """The scan with base_labels and labels as sorted, comma-joined strings."""
    join = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return scanned.withColumns(
        {
            "labels": join(F.concat("base_labels", F.transform("detections", lambda d: d["label"]))),
            "n_detections": F.size("detections").cast("long"),
        }
    ).withColumn("base_labels", join(F.col("base_labels"))).drop("detections")
