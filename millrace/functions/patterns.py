"""Fragments that give Python's str semantics inside the JVM.

Python's ``strip`` and ``\\s`` cover all Unicode white space plus the four ASCII
separators; its ``\\w`` is letters, numbers and underscore.  Java needs the
``(?U)`` flag and explicit classes for the same sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPACE = r"\s\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"

# The characters that str.strip() removes, by code point.
_SPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, _SPACE_POINTS))


def strip(col: Column) -> Column:
    """``str.strip()``: looks at both ends only, whatever the length of the text."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Nested expressions are otherwise repeated wherever a result is used twice.
    """
    return F.transform(F.array(value), body)[0]
