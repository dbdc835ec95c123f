"""Line-first cleaning: rules look at single lines, documents that lose too much text are rejected.

All of it is column expressions over one row: no shuffle, no Python.  A document that is one very long
line, or very many lines, takes time in proportion to its length (times a logarithm for the sort of
repeated windows).

A line (split at "\\n", with a word) fails when it
* punctuation: has more than one symbol of #*$%&|<> in twenty characters, or fewer than SHORT_LINE words and no
  closing mark;
* shouting: has five words or more and more than half of its A-Z letters in upper case;
* navigation: has three separators or more, and one for six words or fewer;
* boilerplate: has at most BOILERPLATE_WORDS words and one of BOILERPLATE's phrases;
* repetition: has ten words or more of which fewer than a fifth are different.
Of equal lines the first stays.  A document is rejected when the lines that stay hold less than
1 - MAX_LOSS of the characters of all lines with a word, or when a base rule fails.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import let
from .common import BLANK, BLANKS, col, words

SYMBOLS = "#*$%&|<>"
SHORT_LINE = 6
BOILERPLATE_WORDS = 40
MAX_LOSS = 0.5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
CLOSING = r"[.!?:;…\"'”’»)\]]$"
SEPARATORS = "|»›•·→"
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript",
    "click here", "sign up", "log in", "subscribe", "newsletter", "share this", "read more", "skip to content",
)


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{BLANK}]"))


def has_phrase(text: Column) -> Column:
    """Whether a text holds one of BOILERPLATE's phrases in any case."""
    return let(F.lower(text), lambda lowered: reduce(or_, [F.contains(lowered, F.lit(phrase)) for phrase in BOILERPLATE]))


def mostly_upper(line: Column) -> Column:
    """More than half of the A-Z letters are upper case.  Few capitals among four letters or more need no full count."""
    upper = F.char_length(F.regexp_replace(line, "[^A-Z]+", ""))
    few = (upper <= 2) & line.rlike("[A-Za-z](?:[^A-Za-z]*[A-Za-z]){3}")
    return ~few & (upper * 2 > F.char_length(F.regexp_replace(line, "[^A-Za-z]+", "")))


def text_flags(text: Column) -> Column:
    """Whether a whole text holds any symbol (1), separator (2) or phrase (4); without one no line needs a look.

    One number, used several times: the optimizer would else copy the tests to every line.
    """
    found = (text.rlike(f"[{SYMBOLS}]"), text.rlike(f"[{SEPARATORS}]"), has_phrase(text))
    return reduce(add, [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(found)])


def line_fails(line: Column, flags: Column) -> Column:
    """True for a line that has to go; the line must have a word."""
    symbols, separators, phrases = (flags.bitwiseAND(F.lit(1 << k)) > 0 for k in range(3))

    def judge(own: Column) -> Column:
        n = F.size(own)
        bare = F.btrim(line, F.lit(BLANKS))
        parts = count_of(line, SEPARATORS)
        return (
            ((n < SHORT_LINE) & ~bare.rlike(CLOSING))
            | (symbols & (count_of(line, SYMBOLS) * 20 > F.char_length(line)))
            | (separators & (parts >= 3) & (parts * 6 >= n))
            | (phrases & (n <= BOILERPLATE_WORDS) & has_phrase(line))
            | ((n >= 5) & mostly_upper(line))
            | ((n >= 10) & (F.size(F.array_distinct(own)) * 5 < n))
        )

    return let(words(line), judge)


def repeated_window_words(own: str, window: int = WINDOW) -> tuple[list[dict[str, Column]], Column]:
    """Words covered by windows that occur twice or more in the array of words.

    Returns the helper columns, level by level, and the count.  The window is a power of two; windows are compared by
    64-bit hashes, built from the hashes of their halves.  Only rows with an equal pair sort their windows.
    """
    hashes, wins, pairs, starts = "__hashes", "__windows", "__pairs", "__starts"
    one_hash = F.transform(F.col(own), lambda w: F.xxhash64(w))
    many = F.size(own) >= window

    def doubled(name: str, width: int) -> Column:
        """Hashes of twice the width from hashes of windows of one width."""
        n = F.size(name) - width
        return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(width + 1), n), lambda a, b: F.xxhash64(a, b))

    repeats = F.size(F.array_distinct(F.col(wins))) < F.size(wins)
    sorted_pairs = F.array_sort(F.transform(F.col(wins), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twin(p: Column, k: Column) -> Column:
        before, after = F.get(F.col(pairs), k - 1)["h"], F.get(F.col(pairs), k + 1)["h"]
        return F.coalesce(before == p["h"], F.lit(False)) | F.coalesce(after == p["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(F.col(pairs), twin), lambda p: p["i"]))
    gap = F.transform(
        F.col(starts),
        lambda s, k: F.least(F.lit(window), F.coalesce(F.get(F.col(starts), k + 1) - s, F.lit(window))).cast("long"),
    )
    total = F.aggregate(gap, F.lit(0).cast("long"), lambda a, b: a + b)
    levels = [
        {hashes: F.when(many, one_hash)},
        *[{wins: F.when(many, doubled(wins if k else hashes, 1 << k))} for k in range(window.bit_length() - 1)],
        {pairs: F.when(many & repeats, sorted_pairs)},
        {starts: F.when(F.col(pairs).isNotNull(), places)},
    ]
    return levels, F.coalesce(total, F.lit(0).cast("long"))


def apply_line_rules(docs: DataFrame, text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """The input's columns, the base counts, base_failed, kept, n_lines, n_failed_lines, lost_chars, cleaned_text.

    Null text has no words and no lines, fails the base rules and has null cleaned_text.  A text none of whose
    lines goes is returned as it is.  New columns replace columns of the same name; names that start with two
    underscores are reserved.  Rows are independent of each other.
    """
    own = docs.withColumn("__text", F.coalesce(col(text_col), F.lit("")))
    own = own.withColumns({"__words": words(F.col("__text")), "__lines": lines_with_words(F.col("__text"))})
    levels, repeated = repeated_window_words("__words")
    for level in levels:
        own = own.withColumns(level)
    length = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, b: a + F.char_length(b))
    own = own.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_symbols": count_of(F.col("__text"), SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": repeated,
            "n_lines": F.size("__lines").cast("long"),
            "__flags": text_flags(F.col("__text")),
            "__all_chars": length(F.col("__lines")),
        }
    )
    own = own.withColumn("__good", F.array_distinct(F.filter("__lines", lambda x: ~line_fails(x, F.col("__flags")))))
    failed = F.col("n_lines") - F.size("__good")
    lost = F.col("__all_chars") - length(F.col("__good"))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    verdict = {
        "n_failed_lines": failed,
        "lost_chars": lost,
        "base_failed": base,
        "kept": ~base & (lost <= F.col("__all_chars") * F.lit(float(max_loss))),
        "cleaned_text": F.when(failed == 0, col(text_col)).otherwise(F.array_join("__good", "\n")),
    }
    # A generator keeps the optimizer from copying all of the above into a filter on the verdict.
    own = own.withColumn("__verdict", F.explode(F.array(F.struct(*[c.alias(name) for name, c in verdict.items()]))))
    own = own.withColumns({name: F.col(f"__verdict.{name}") for name in verdict})
    helpers = ("__text", "__words", "__lines", "__hashes", "__windows", "__pairs", "__starts", "__good", "__all_chars", "__flags")
    return own.drop(*helpers, "__verdict")
