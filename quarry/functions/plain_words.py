"""The tokeniser of ``quarry.functions.text`` in Python, for texts of plain characters.

Plain characters are those of blocks whose letters, numbers and marks are the
same in every Unicode version that a JVM or a Python of today knows: Latin,
Greek, Cyrillic, punctuation, symbols, emoji.  None is an ideograph, and İ is left out, whose lower case is two
characters.  A text with any other character is left to the column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

PLAIN_BLOCKS = ((0x0000, 0x012F), (0x0131, 0x052F), (0x1E00, 0x2BFF), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF))

#: Java pattern of a character that is not plain.
OTHER_RE = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in PLAIN_BLOCKS) + "]"


def _class(categories: str, more: str = "") -> str:
    """Regex class, without brackets, of the plain characters of these categories."""
    points = [c for a, b in PLAIN_BLOCKS for c in range(a, b + 1) if unicodedata.category(chr(c))[0] in categories]
    out, begin = more, None
    for c, then in zip(points, [*points[1:], None]):
        begin = c if begin is None else begin
        if then != c + 1:
            out += f"\\U{begin:08x}-\\U{c:08x}"
            begin = None
    return out


@cache
def word_pattern() -> re.Pattern:
    """A word of lower-cased plain text: runs, and between two of them a character that joins letters or digits."""
    letter, number, word = _class("L"), _class("N"), _class("LNM", "_")
    join = f"(?:(?<=[{letter}])[.'’:](?=[{letter}])|(?<=[{number}])[.'’,;](?=[{number}]))"
    return re.compile(f"[{word}]+(?:{join}[{word}]+)*")
