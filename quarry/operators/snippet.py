"""Snippets for page hits.

Only the rows of a result page reach this step (late materialisation), so
reading text and running a regex over it is bounded by page size.

N1: the location is the earliest position at which any matched content term
occurs; its character offset is found by searching the term as a whole token
in the marked, lower-cased content (the same text the tokeniser saw).
N2: no snippet unless content matched and the file type is snippet text.
N4/N5: a window of ``context`` characters or bytes on each side, clamped to the
text, trimmed, with '...' where it was cut.  A window in bytes is cut to whole
characters: one that reaches over an edge is left out.
N6 (deliberate change): the text is the indexed ``documents.content`` of the
version searched, not the file as it is now, so snippets agree with scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.config import SNIPPET_CONTEXT
from quarry.functions.paths import is_snippet_text
from quarry.functions.text import (
    IDEOGRAPH_RE,
    JOINERS,
    MARKERS,
    RUN_CLASS,
    lower_case,
    mark_joiners,
    quote_regex,
    trim_ws,
)

# Edges of a byte window seen as one character for each byte: bytes that go on
# a character begun before it, and a character that goes on behind it.
_CUT_BEGIN_RE = r"^[\x80-\xbf]{1,3}"
_CUT_END_RE = r"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})$"


def match_offset(content: Column, term: Column) -> Column:
    """0-based character offset of the first whole-token occurrence of term."""
    marked = mark_joiners(lower_case(content))
    run = F.concat(
        F.lit("(?s)^(.*?)(?<![" + RUN_CLASS + "])"),
        quote_regex(F.translate(term, JOINERS, MARKERS)),
        F.lit("(?![" + RUN_CLASS + "])"),
    )
    # An ideograph ends where its marks do, whatever stands beside it.
    ideograph = F.concat(F.lit("(?s)^(.*?)"), quote_regex(term), F.lit("(?!\\p{M})"))
    pat = F.when(term.rlike("^" + IDEOGRAPH_RE + "$"), ideograph).otherwise(run)
    return F.char_length(F.call_function("regexp_extract", marked, pat, F.lit(1)))


def _dotted(text: Column, cut_before: Column, cut_after: Column) -> Column:
    dots = lambda cut: F.when(cut, F.lit("...")).otherwise(F.lit(""))
    return F.concat(dots(cut_before), trim_ws(text), dots(cut_after))


def window_snippet(content: Column, start: Column, end: Column, context: int = SNIPPET_CONTEXT) -> Column:
    n = F.char_length(content)
    s0 = F.greatest(F.lit(0), start - F.lit(context))
    s1 = F.least(n, end + F.lit(context))
    return _dotted(F.substring(content, s0 + 1, s1 - s0), s0 > 0, s1 < n)


def byte_window_snippet(content: Column, start: Column, end: Column, context: int = SNIPPET_CONTEXT) -> Column:
    """The window of ``context`` UTF-8 bytes on each side of the characters from ``start`` to ``end``."""
    raw = F.encode(content, "UTF-8")
    bytes_before = lambda at: F.octet_length(F.substring(content, F.lit(1), at))
    n = F.octet_length(content)
    s0 = F.greatest(F.lit(0), bytes_before(start) - F.lit(context))
    s1 = F.least(n, bytes_before(end) + F.lit(context))
    # ISO-8859-1 shows each byte as one character, so the edges can be cut by patterns.
    shown = F.decode(F.substring(raw, s0 + 1, s1 - s0), "ISO-8859-1")
    whole = F.regexp_replace(F.regexp_replace(shown, _CUT_BEGIN_RE, ""), _CUT_END_RE, "")
    return _dotted(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"), s0 > 0, s1 < n)


WINDOWS = {"chars": window_snippet, "bytes": byte_window_snippet}


def snippet(content: Column, name: Column, loc_term: Column, context: int = SNIPPET_CONTEXT, unit: str = "chars") -> Column:
    start = match_offset(content, loc_term)
    end = start + F.char_length(loc_term)
    gate = loc_term.isNotNull() & is_snippet_text(name) & (F.coalesce(content, F.lit("")) != "")
    return F.when(gate, WINDOWS[unit](content, start, end, context)).otherwise(F.lit(""))
