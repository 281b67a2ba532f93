"""Quality rules: distribution divergence after length and repetition rules.

Built from DataFrame functions only.

Words are runs of characters outside ASCII white space.  A document fails the
base rules with fewer than ``MIN_WORDS`` words or when more than half of its
words stand in three-word windows that are found twice or more in it.

Every other document is compared with the reference of its language by the
Jensen-Shannon distance (base 2, so 0 to 1) of two histograms: character
classes, and common words (the words of ``COMMON_WORDS``, and all other words
as one bin).  A language's reference comes from every distinct text of the
table, so that copies of one text count once: the texts that pass the base
rules are summed, and then, so that a share of odd texts does not bend it,
those of them that lie nearer to this sum than half of them do are summed
again.  Languages outside ``COMMON_WORDS`` share the class sums over all texts;
their words are not judged, as another language's common words tell nothing of
them (see the README).  A document is rejected
when a distance is above its limit.  Limits widen with 1/sqrt(length), as the
distance of a small sample does; below a minimum length, and where a
reference rests on too few distinct texts, a histogram is not judged.

Cases: a null or blank text has no words and fails the base rules; a null
language uses the shared class reference; repeated rows are judged alike; an empty
table gives an empty result; extra columns stay as they are with ``filter_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WS, materialize, shielded

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Lengths from which a histogram is judged, and distinct texts that a reference needs.
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = MIN_WORDS
MIN_REFERENCE_DOCS = 20

#: Limits of the distances: at length n, base + slope / sqrt(n).
CLASS_LIMIT = (0.25, 1.0)
WORD_LIMIT = (0.12, 2.0)

#: Frequent function words of the languages judged.
COMMON_WORDS = {
    "en": "the of and to in a is that it was for on are as with his they at be this from or had by not but what all were when".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me sin".split(),
}

#: Character classes in the order in which they are taken out of a text: the
#: most frequent first, so that later ones scan less.
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("space", r"[\s]+"),
    ("upper", r"\p{Lu}+"),
    ("stop", r"[.,;:!?'\"()-]+"),
    ("digit", r"\p{N}+"),
    ("letter", r"\p{L}+"),
)  # what is left are symbols


def _removed(before: str, after: str) -> Column:
    return (F.char_length(before) - F.char_length(after)).cast("long")


def _repeated_words(sorted_windows: str) -> Column:
    """Words that stand in a window found twice or more, from the sorted (window, position) pairs."""
    n = F.greatest(F.size(sorted_windows) - 1, F.lit(0))
    same = F.zip_with(
        F.slice(sorted_windows, F.lit(1), n),
        F.slice(sorted_windows, F.lit(2), n),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
    )
    return F.array_distinct(F.flatten(same))


def _word_list(lang: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        out = F.when(lang == code, F.array(*map(F.lit, words))).otherwise(out)
    return out


def _found_words(lang: Column, text: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        longest_first = "|".join(sorted(words, key=len, reverse=True))
        pattern = rf"(?<![\p{{L}}\p{{N}}])({longest_first})(?![\p{{L}}\p{{N}}])"
        out = F.when(lang == code, F.regexp_extract_all(text, F.lit(pattern), 1)).otherwise(out)
    return out


BINS = max(map(len, COMMON_WORDS.values()))
#: One character for each place in a word list, to count places in a string.
MARKS = [chr(0x4E00 + i) for i in range(BINS)]


def measure(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Adds the struct ``_q`` of counts and histograms; row by row, no shuffle."""
    step = docs.withColumns(
        {
            "_q_text": F.coalesce(F.col(text_col), F.lit("")),
            "_q_lang": F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(F.lit("")),
        }
    )
    step = step.withColumn("_q_flat", F.trim(F.regexp_replace("_q_text", WS, " ")))
    gaps = F.replace("_q_flat", F.lit(" "), F.lit(""))
    step = step.withColumn("_q_solid", gaps)
    step = step.withColumn(
        "_q_words", F.when(F.col("_q_flat") == "", F.lit(0)).otherwise(_removed("_q_flat", "_q_solid") + 1).cast("long")
    )
    # Windows of three words, in order: matches of no width that look ahead.
    windows = F.regexp_extract_all("_q_flat", F.lit(r"(?<![^ ])(?=([^ ]+ [^ ]+ [^ ]+))"), F.lit(1))
    step = step.withColumn(
        "_q_windows", F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    )
    step = step.withColumn("_q_twice", _repeated_words("_q_windows"))
    shifted = [F.transform("_q_twice", lambda p: p + 1), F.transform("_q_twice", lambda p: p + 2)]
    lines = F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumns(
        {
            "_q_repeat": F.size(F.array_distinct(F.concat("_q_twice", *shifted))).cast("long"),
            "_q_lines": lines,
            "_q_symbols": F.char_length(F.regexp_replace("_q_text", r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    step = step.withColumn(
        "_q_failed",
        (F.col("_q_words") < MIN_WORDS) | (F.col("_q_repeat") * 100 > F.col("_q_words") * MAX_REPEAT_PERCENT),
    )
    judged = ~F.col("_q_failed")
    # Character classes, each taken out of what the ones before left.
    left, classes = "_q_text", []
    for name, pattern in CLASSES:
        step = step.withColumn(f"_q_after_{name}", F.when(judged, F.regexp_replace(left, pattern, "")))
        classes.append(_removed(left, f"_q_after_{name}"))
        left = f"_q_after_{name}"
    classes.append(F.char_length(left).cast("long"))
    found = F.when(judged, _found_words(F.col("_q_lang"), F.lower("_q_flat")))
    step = step.withColumns({"_q_list": _word_list(F.col("_q_lang")), "_q_found": found})
    marks = F.array(*map(F.lit, MARKS))
    step = step.withColumn(
        "_q_marks",
        F.array_join(F.transform("_q_found", lambda w: F.get(marks, F.array_position("_q_list", w).cast("int") - 1)), ""),
    )
    bins = [
        (F.char_length("_q_marks") - F.char_length(F.replace("_q_marks", F.lit(m), F.lit("")))).cast("long") for m in MARKS
    ]
    other = F.greatest(F.col("_q_words") - F.size("_q_found"), F.lit(0)).cast("long")
    q = F.struct(
        F.col("_q_lang").alias("lang"),
        F.col("_q_words").alias("n_words"),
        F.char_length("_q_solid").cast("long").alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"),
        F.col("_q_failed").alias("base_failed"),
        F.char_length("_q_text").cast("long").alias("n_chars"),
        F.when(judged, F.array(*classes)).alias("classes"),
        F.when(judged & (F.col("_q_lang") != ""), F.array(*bins, other)).alias("words"),
        F.when(judged, F.unhex(F.sha2("_q_text", 256))).alias("digest"),
    )
    return step.select(*docs.columns, q.alias("_q"))


def _sums(measured: DataFrame, classes: Column, words: Column) -> DataFrame:
    """Summed histograms of the rows that the conditions choose.

    One row for each judged language and one for all others: at most
    ``len(COMMON_WORDS) + 1`` rows.
    """
    sums = [F.sum(F.when(classes, F.get("_q.classes", F.lit(i)))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.when(words, F.get("_q.words", F.lit(i)))).alias(f"w{i}") for i in range(BINS + 1)]
    by_lang = measured.groupBy(F.col("_q.lang").alias("lang")).agg(F.count(F.lit(1)).alias("n"), *sums)
    # Documents of other languages are compared with all texts.
    names = [c for c in by_lang.columns if c != "lang"]
    shared = by_lang.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit("").alias("lang"), *names)
    rows = by_lang.filter("lang <> ''").unionByName(shared)
    return rows.select(
        F.col("lang").alias("_r_lang"),
        F.col("n").alias("_r_n"),
        F.array(*[F.col(f"c{i}").cast("double") for i in range(len(CLASSES) + 1)]).alias("_r_classes"),
        F.array(*[F.col(f"w{i}").cast("double") for i in range(BINS + 1)]).alias("_r_words"),
    )


#: Distances are counted in steps of 1 / STEPS to find their middle.
STEPS = 1000


def _step(distance: str) -> Column:
    return F.floor(F.col(distance) * STEPS).cast("int")


def _middle(far: DataFrame, distance: str, out: str) -> DataFrame:
    """(lang, out): the step by which half of the language's texts are reached; exact."""
    counts = far.filter(F.col(distance).isNotNull()).groupBy(F.col("_q.lang").alias("lang"), _step(distance).alias("step"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"))  # at most STEPS + 1 rows for each language
    reached = Window.partitionBy("lang").orderBy("step")
    whole = Window.partitionBy("lang")
    counts = counts.withColumns({"reached": F.sum("n").over(reached), "all": F.sum("n").over(whole)})
    return counts.filter(F.col("reached") * 2 >= F.col("all")).groupBy("lang").agg(F.min("step").alias(out))


def distinct_texts(measured: DataFrame) -> DataFrame:
    """(_q): one row for each language and text that passes the base rules.

    Copies have equal histograms, so any of them will do; they are put together
    before the shuffle, so a text of any number of copies sends a row a task.
    """
    passed = measured.filter("NOT _q.base_failed").select(F.col("_q.lang").alias("lang"), F.col("_q.digest").alias("digest"), "_q")
    return passed.dropDuplicates(["lang", "digest"]).select("_q")


def references(measured: DataFrame) -> DataFrame:
    """The reference histograms; at most ``len(COMMON_WORDS) + 1`` rows."""
    texts = materialize(distinct_texts(measured), "distinct-texts")
    far = materialize(distances(texts, _sums(texts, F.lit(True), F.lit(True))), "distances")
    middle = _middle(far, "_class_distance", "_c_step").join(_middle(far, "_word_distance", "_w_step"), "lang", "full")
    # One row for each language.
    near = far.join(F.broadcast(middle), F.col("_q.lang") == F.col("lang"), "left")
    return _sums(near, _step("_class_distance") <= F.col("_c_step"), _step("_word_distance") <= F.col("_w_step"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _distance(p: Column, p_sum: Column, q: Column, q_sum: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts with their sums."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x / p_sum, y / q_sum) + part(y / q_sum, x / p_sum))
    return F.sqrt(F.greatest(_total(terms) / 2, F.lit(0.0)))


def distances(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds _class_distance and _word_distance to rows with ``_q``; null where not judged."""
    sums = refs.withColumns({"_r_chars": _total(F.col("_r_classes")), "_r_total": _total(F.col("_r_words"))})
    both = measured.join(F.broadcast(sums), F.col("_q.lang") == F.col("_r_lang"), "left")
    enough = ~F.col("_q.base_failed") & (F.col("_r_n") >= MIN_REFERENCE_DOCS)
    n_chars, n_words = F.col("_q.n_chars"), F.col("_q.n_words")
    by_class = F.when(
        enough & (n_chars >= MIN_CLASS_CHARS) & (F.col("_r_chars") > 0),
        _distance(F.col("_q.classes"), n_chars, F.col("_r_classes"), F.col("_r_chars")),
    )
    word_sum = _total(F.transform("_q.words", lambda x: x.cast("double")))
    by_word = F.when(
        enough & F.col("_q.words").isNotNull() & (n_words >= MIN_COMMON_WORDS) & (F.col("_r_total") > 0),
        _distance(F.col("_q.words"), word_sum, F.col("_r_words"), F.col("_r_total")),
    )
    return both.withColumns({"_class_distance": by_class, "_word_distance": by_word}).drop(*sums.columns)


def judge(measured: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds the distances and _kept to rows with ``_q``."""

    def too_far(distance: str, length: Column, limit: tuple[float, float]) -> Column:
        return F.coalesce(F.col(distance) > limit[0] + limit[1] / F.sqrt(length), F.lit(False))

    return distances(measured, refs).withColumn(
        "_kept",
        ~F.col("_q.base_failed")
        & ~too_far("_class_distance", F.col("_q.n_chars"), CLASS_LIMIT)
        & ~too_far("_word_distance", F.col("_q.n_words"), WORD_LIMIT),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, base_failed, kept and the distances."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    measured = materialize(measure(picked).select("doc_id", "_q"), "quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judge(measured, references(measured)).select(
        "doc_id",
        *[F.col(f"_q.{n}").alias(n) for n in names],
        F.col("_kept").alias("kept"),
        F.col("_class_distance").alias("class_distance"),
        F.col("_word_distance").alias("word_distance"),
    )


def filter_quality(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their columns.

    Texts are written once beside their measures, so that references and
    verdicts come from one pass over them.
    """
    docs, restore = shielded(docs, (lang_col, text_col))
    measured = materialize(measure(docs, lang_col, text_col), "quality-texts")
    return restore(judge(measured, references(measured)).filter("_kept"))
