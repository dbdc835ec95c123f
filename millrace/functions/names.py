"""Entity-name keys: exact key, normalized key, token-sorted key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .patterns import SPACE, WORD, WORD_END, WORD_START, strip

# Company-form words that a normalized name leaves out.
LEGAL_FORM_WORDS = (
    "inc", "llc", "ltd", "pbc", "corp", "corporation", "technologies", "technology",
    "labs", "lab", "systems", "solutions", "company", "gmbh",
)


def exact_key(name: Column) -> Column:
    return strip(F.lower(name))


def normalized_key(name: Column) -> Column:
    """Lower case, punctuation to blanks, company-form words out, blanks squeezed.

    May be empty for a name made of such words only.  It depends on the exact key
    alone, so it can be computed after names are grouped by that key.
    """
    text = F.regexp_replace(exact_key(name), rf"(?U)[^{WORD}{SPACE}]", " ")
    text = F.regexp_replace(text, rf"{WORD_START}(?:{'|'.join(LEGAL_FORM_WORDS)}){WORD_END}", " ")
    return strip(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def token_sorted(key: Column) -> Column:
    """Tokens in code-point order, joined by one blank."""
    return F.array_join(F.array_sort(F.split(key, " ")), " ")
