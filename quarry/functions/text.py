"""Column expressions for text analysis and query strings.

Everything here is a built-in Spark expression (JVM side, no Python per row).

Tokeniser (T2, the "standard" analyser of ``name`` and ``content``): Unicode word segmentation after UAX #29,
lower-cased, English stop words removed.  Word characters are letters, digits,
combining marks and ``_``.  ``.``, ``'`` and ``’`` join letter-letter and
digit-digit, ``:`` joins letter-letter, ``,`` and ``;`` join digit-digit;
every other character splits.  An ideograph (Han, Hiragana) is a token of its
own, with the combining marks that follow it, and joins nothing; Katakana and
Hangul run like letters.  So ``file1.txt`` gives ``file1, txt``,
``main.go`` stays ``main.go`` and ``3.14`` stays ``3.14``.

A joining character is first replaced by a one-character control marker, one
``regexp_replace`` pass per character, then words are runs of word characters
and markers, and the markers are translated back.  Markers are one character
for one character, so character offsets survive the marking.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.stopwords import STOP_WORDS_EN

# Joining characters, the letter/digit contexts they join in,
# and the control marker standing for each.
JOINERS = ".'’:,;"
MARKERS = "\x01\x02\x03\x04\x05\x06"
_JOIN_CONTEXT = {
    ".": ("L", "N"),
    "'": ("L", "N"),
    "’": ("L", "N"),
    ":": ("L",),
    ",": ("N",),
    ";": ("N",),
}

# Code points of Hiragana and Han word characters.  Ranges, as a
# script look-up for each character of a text costs far more.
IDEOGRAPHS = (
    r"\u3005\u3007\u3021-\u3029\u3038-\u303b\u3041-\u3096\u309d-\u309f\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    r"\x{1b001}-\x{1b11f}\x{20000}-\x{323af}"
)
IDEOGRAPH_RE = "[" + IDEOGRAPHS + r"]\p{M}*"

WORD_CLASS = r"\p{L}\p{N}\p{M}_\x01-\x06"
#: What a run is made of: word characters that are no ideographs.
RUN_CLASS = WORD_CLASS + "&&[^" + IDEOGRAPHS + "]"
WORD_RE = "[" + RUN_CLASS + "]+|" + IDEOGRAPH_RE

# Unicode white space (Java's UNICODE_CHARACTER_CLASS makes \s Unicode aware).
_TRIM_RE = r"(?U)^\s+|\s+$"
_WS_RUN_RE = r"(?U)\s+"


def _joiner_pattern(ch: str) -> str:
    esc = "\\" + ch if ch in ".:" else ch
    classes = [f"[\\p{{{cls}}}&&[^{IDEOGRAPHS}]]" for cls in _JOIN_CONTEXT[ch]]
    # the character first, so that the classes are tried at its places only
    return esc + "(?:" + "|".join(f"(?<={c}{esc})(?={c})" for c in classes) + ")"


def trim_ws(col: Column) -> Column:
    """Trim all Unicode white space at both ends (plain ``trim`` keeps tabs)."""
    return F.regexp_replace(col, _TRIM_RE, "")


def lower_case(col: Column) -> Column:
    """Lower case that keeps the number of characters (İ alone would become two)."""
    return F.lower(F.translate(col, "İ", "i"))


def normalize_query(col: Column) -> Column:
    """Q2: lower-case and trim a query string."""
    return lower_case(trim_ws(col))


def split_words(col: Column) -> Column:
    """Q21: split on runs of white space, dropping empty pieces."""
    return F.filter(F.split(col, _WS_RUN_RE), lambda x: x != F.lit(""))


def mark_joiners(col: Column) -> Column:
    """Replace joining characters in joining context by their markers.

    Marker characters of the text itself become spaces first.
    """
    out = F.translate(col, MARKERS, " " * len(MARKERS))
    for ch, marker in zip(JOINERS, MARKERS):
        out = F.regexp_replace(out, _joiner_pattern(ch), marker)
    return out


def unmark(col: Column) -> Column:
    return F.translate(col, MARKERS, JOINERS)


def raw_tokens(col: Column) -> Column:
    """ARRAY<STRING> of all tokens of a text, stop words included.

    The array index of a token is its position; positions are assigned before
    stop words are removed, so phrase matching keeps their holes.
    """
    marked = mark_joiners(lower_case(col))
    return F.transform(F.regexp_extract_all(marked, F.lit(WORD_RE), 0), unmark)


_CONSTANT_COLUMNS: dict = {}


def constant_columns(name: str, build):
    """Constant column expressions made once per JVM gateway.

    Every literal costs a few JVM round-trips to build; plans use the same
    constants several times per search, so the built columns are kept.
    """
    from pyspark import SparkContext

    key = (id(SparkContext._gateway), name)
    if key not in _CONSTANT_COLUMNS:
        _CONSTANT_COLUMNS[key] = build()
    return _CONSTANT_COLUMNS[key]


def is_stop_word(col: Column) -> Column:
    # A literal IN list (J5's stop-word anti join): 181 fixed words, so a
    # hash set per task beats any join.
    return col.isin(*constant_columns("stop_words", lambda: [F.lit(w) for w in STOP_WORDS_EN]))


def analyzed_terms(col: Column) -> Column:
    """ARRAY<STRING> of indexed terms of a text (stop words removed).

    Q12: terms are lower-cased here and query words by the same expression,
    so matching is case-insensitive; ``path`` is kept as it is (T1), so an
    upper-case path never equals a lower-cased query.
    """
    return F.filter(raw_tokens(col), lambda t: ~is_stop_word(t))


def utf8_prefix3(col: Column) -> Column:
    """First three UTF-8 bytes of a string, as BINARY (prefix-join key)."""
    return F.substring(F.encode(col, "UTF-8"), 1, 3)


def quote_regex(col: Column) -> Column:
    """Quote a string for use as a literal inside a Java regex."""
    return F.concat(F.lit("\\Q"), col, F.lit("\\E"))
