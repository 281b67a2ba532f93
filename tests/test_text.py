"""Expression tests on literals: tokeniser, query parsing, formatting."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.format import format_size, progress_percent
from quarry.functions.paths import ancestor_dirs, extension, is_hidden_below
from quarry.functions.text import analyzed_terms, lower_case, normalize_query, raw_tokens, split_words
from quarry.operators.manifest import kv_delete, kv_keys, kv_put
from quarry.operators.parse import quoted_phrases, remaining_terms
from quarry.operators.snippet import snippet


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text,tokens",
    [
        ("log7.txt", ["log7", "txt"]),
        ("engine.c", ["engine.c"]),
        ("pi is 3.14, ok", ["pi", "is", "3.14", "ok"]),
        ("it's fine", ["it's", "fine"]),
        ("a.b.c d", ["a.b.c", "d"]),
        ("1,000;2 x,y", ["1,000;2", "x", "y"]),
        ("key:value 1:2", ["key:value", "1", "2"]),
        ("Ahoy, Harbour!", ["ahoy", "harbour"]),
        ("snake_case été Ünïcödé", ["snake_case", "été", "ünïcödé"]),
        ('{"berth": "quay", "depth": 9}', ["berth", "quay", "depth", "9"]),
        ("東京タワーに行く", ["東", "京", "タワー", "に", "行", "く"]),
        ("v2中文.md 한국어", ["v2", "中", "文", "md", "한국어"]),
        ("中.文 か\u3099き 々 \U00020000\U00020001x", ["中", "文", "か\u3099", "き", "々", "\U00020000", "\U00020001", "x"]),
        ("1,中 l'été中's", ["1", "中", "l'été", "中", "s"]),
        ("", []),
    ],
)
def test_raw_tokens(spark, text, tokens):
    assert _one(spark, raw_tokens, text) == tokens


def test_stop_words_removed_after_positions(spark):
    assert _one(spark, analyzed_terms, "There is a chart of the harbour") == ["chart", "harbour"]


QUOTES = {
    '"low tide"': (["low tide"], ""),
    'ferry "low tide" quay': (["low tide"], "ferry quay"),
    '"north quay"\t"south  quay"': (["north quay", "south  quay"], ""),
    "no quotes at all": ([], "no quotes at all"),
    '""': ([], ""),
    '"   " buoy': ([], "buoy"),
    '\n " dawn\tferry " \n dusk': (["dawn\tferry"], "dusk"),
    'tide "open end': ([], 'tide "open end'),
    'a "b" c "d" e': (["b", "d"], "a c e"),
    'left"inner"right': (["inner"], None),
}


def test_quoted_phrases(spark):
    df = spark.createDataFrame([(q,) for q in QUOTES], "q string")
    rows = df.select("q", quoted_phrases(F.col("q")).alias("p"), remaining_terms(F.col("q")).alias("r")).collect()
    for r in rows:
        phrases, rest = QUOTES[r.q]
        assert r.p == phrases, r.q
        assert rest is None or r.r.split() == rest.split(), r.q


def test_control_characters_separate_words(spark):
    for mark in "\x01\x02\x03\x04\x05\x06":
        assert _one(spark, raw_tokens, f"alpha{mark}beta 1{mark}2") == ["alpha", "beta", "1", "2"]


def test_lower_case_keeps_lengths(spark):
    text = "İİ word İstanbul"
    assert _one(spark, lambda c: F.char_length(lower_case(c)), text) == len(text)
    assert _one(spark, raw_tokens, text) == ["ii", "word", "istanbul"]
    cut = _one(spark, lambda c: snippet(c, F.lit("a.txt"), F.lit("istanbul"), 3), text)
    assert cut == "...rd İstanbul"


def _snippet(spark, text, term, context, unit="chars"):
    return _one(spark, lambda c: snippet(c, F.lit("a.txt"), F.lit(term), context, unit), text)


def test_snippets_of_ideographs(spark):
    assert _snippet(spark, "ab東京タワー", "京", 1) == "...東京タ..."
    assert _snippet(spark, "タワー東ワ", "ワ", 1) == "...東ワ"  # not inside a run of kana
    assert _snippet(spark, "か\u3099 か", "か", 1) == "...か"  # with a mark it is another token


def _byte_window(text, term, context):
    """Brute force: the window of bytes, without the characters that it cuts."""
    raw, at = text.encode(), len(text[: text.index(term)].encode())
    begin, end = max(0, at - context), min(len(raw), at + len(term.encode()) + context)
    body = raw[begin:end].decode("utf-8", "ignore").strip()
    return "..." * (begin > 0) + body + "..." * (end < len(raw))


@pytest.mark.parametrize("context", range(9))
def test_byte_windows(spark, context):
    for text in ("tide", "aé tide éa", "€€€ tide €€€", "𠀀é tide é𠀀𠀀", "ééé\ntide", "x tide\t𠀀y€é"):
        assert _snippet(spark, text, "tide", context, "bytes") == _byte_window(text, "tide", context), (text, context)


def test_normalize_and_split(spark):
    assert _one(spark, normalize_query, "\t  LoW Tide \n") == "low tide"
    assert _one(spark, split_words, " a \t b\nc  ") == ["a", "b", "c"]


@pytest.mark.parametrize(
    "size,text",
    [(0, "0 B"), (1, "1 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (1280, "1.3 KB"),
     (1048576, "1 MB"), (5 * 1024 ** 3, "5 GB"), (3 * 1024 ** 4, "3072 GB")],
)
def test_format_size(spark, size, text):
    assert _one(spark, format_size, size, "bigint") == text


def test_progress_percent(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (3, 0), (1, 3), (12, 10)], "d long, t long")
    got = [r[0] for r in df.select(progress_percent(F.col("d"), F.col("t"), 20, 100)).collect()]
    assert got == [20, 60, 100, 20, 46, 100]


def test_paths(spark):
    assert _one(spark, extension, "a.TXT") == "txt"
    assert _one(spark, extension, ".gitignore") == "gitignore"
    assert _one(spark, extension, "Makefile") == ""
    assert _one(spark, ancestor_dirs, "/a/b/c/f.txt") == ["/", "/a", "/a/b", "/a/b/c"]
    assert _one(spark, ancestor_dirs, "/f.txt") == ["/"]
    df = spark.createDataFrame(
        [("/r/.root/x.txt", "/r/.root"), ("/r/.root/.h/x.txt", "/r/.root"), ("/r/a/.x", "/r")], "p string, root string"
    )
    got = [r[0] for r in df.select(is_hidden_below(F.col("p"), F.col("root"))).collect()]
    assert got == [False, True, True]


def test_key_value_buckets(spark):
    shape = "bucket string, key string, value string"
    kv = spark.createDataFrame([("files", "a", "1"), ("", "a", "2"), ("requests", "r", "3")], shape)
    put = kv_put(kv, spark.createDataFrame([("default", "a", "new"), ("", "b", "x"), ("files", "", "no key")], shape))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(put) == [("default", "a", "new"), ("default", "b", "x"), ("files", "a", "1"), ("requests", "r", "3")]
    cut = kv_delete(put, spark.createDataFrame([("", "a"), ("files", "missing")], "bucket string, key string"))
    assert rows(kv_keys(cut)) == [("b",)] and rows(kv_keys(cut, "files")) == [("a",)] and rows(kv_keys(cut, "none")) == []
