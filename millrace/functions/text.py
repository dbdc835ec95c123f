"""Text functions: boilerplate removal, token estimate, splitting, code fences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .patterns import SPACE, let, strip

CHARS_PER_TOKEN = 4
DEFAULT_MAX_TOKENS = 6000
HARD_CHAR_CEILING = 40_000


def _where(text: Column, can: Column, change: Callable[[Column], Column]) -> Column:
    return F.when(can, change(text)).otherwise(text)


def strip_boilerplate(raw: Column) -> Column:
    """Blank out scripts, styles and comments, then squeeze blanks and empty lines."""

    def untagged(text: Column) -> Column:
        for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"):
            text = F.regexp_replace(text, pattern, " ")
        return text

    # A pattern is searched only where a plain look says that it can occur.
    text = _where(raw, F.contains(raw, F.lit("<")), untagged)
    text = let(text, lambda t: _where(t, F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), lambda x: F.regexp_replace(x, r"[ \t]+", " ")))
    text = let(text, lambda t: _where(t, F.contains(t, F.lit("\n\n\n")), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n")))
    return strip(text)


def estimate_tokens(text: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def max_chunk_chars(max_tokens: int, hard_char_ceiling: int = HARD_CHAR_CEILING) -> int:
    limit = min(max_tokens * CHARS_PER_TOKEN, hard_char_ceiling)
    if limit < 1:
        raise ValueError("a chunk must hold at least one character")
    return limit


def hard_slices(text: Column, max_chars: int) -> Column:
    """Consecutive slices of ``max_chars`` code points, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{max_chars}}}"), F.lit(0))


def paragraphs(cleaned: Column) -> Column:
    """Stripped, non-empty paragraphs; a line of white space ends a paragraph."""
    parts = F.split(cleaned, rf"(?U)\n[{SPACE}]*\n", -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def pack_paragraphs(paras: Column, max_chars: int) -> Column:
    """Greedy packing of paragraphs into chunks of at most ``max_chars`` characters.

    A paragraph that is too long by itself closes the open chunk and is sliced; its
    last slice stays a chunk of its own.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"))

    def closed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, para: Column) -> Column:
        joined = F.length(acc["open"]) + 2 + F.length(para)
        return (
            F.when(F.length(para) > max_chars, state(F.concat(closed(acc), hard_slices(para, max_chars)), F.lit("")))
            .when(acc["open"] == "", state(acc["done"], para))
            .when(joined > max_chars, state(closed(acc), para))
            .otherwise(state(acc["done"], F.concat(acc["open"], F.lit("\n\n"), para)))
        )

    return F.aggregate(paras, start, step, closed)


def chunk_array(
    raw: Column, max_tokens: int = DEFAULT_MAX_TOKENS, hard_char_ceiling: int = HARD_CHAR_CEILING
) -> Column:
    """All chunks of a raw text, in order; an empty array when nothing is left to send."""
    limit = max_chunk_chars(max_tokens, hard_char_ceiling)
    return pack_paragraphs(paragraphs(strip_boilerplate(raw)), limit)


def midpoint_halves(text: Column) -> Column:
    """Both halves of a text, cut at the floor of its middle."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))


def strip_code_fences(text: Column) -> Column:
    """Remove a Markdown fence around a reply; a fence on one single line stays."""
    body = strip(text)
    opened = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, r"(?s)^[^\n]*\n", "")).otherwise(body)
    unfenced = F.regexp_replace(opened, r"```\z", "")
    return strip(F.when(body.startswith("```"), unfenced).otherwise(body))


def excerpt(text: Column, n_chars: int) -> Column:
    return F.substring(text, 1, n_chars)
