"""URL functions: network location, code-hosting repository, arXiv month."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .patterns import WORD, strip

# Fixed value: the address shape of a hosted repository, anchored at the end.
_REPOSITORY = rf"(?U)github\.com/([{WORD}.-]+)/([{WORD}.-]+?)(?:\.git)?/?$"


def netloc(url: Column) -> Column:
    """Everything between ``//`` and the path, with user, port and case kept."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def owner_repo(url: Column) -> Column:
    """``struct<owner, repo>`` of a repository address, null if it is none."""
    text = strip(url)
    owner = F.regexp_extract(text, _REPOSITORY, 1)
    return F.when(
        owner != "", F.struct(owner.alias("owner"), F.regexp_extract(text, _REPOSITORY, 2).alias("repo"))
    )


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def arxiv_month_start(paper_url: Column) -> Column:
    """First of the month that an arXiv id (``YYMM.number``) encodes, as an ISO string."""
    ident = last_segment(paper_url)
    return F.concat(
        F.lit("20"), F.substring(ident, 1, 2), F.lit("-"), F.substring(ident, 3, 2), F.lit("-01T00:00:00")
    )


def slug_url(base: str, slug: Column) -> Column:
    return F.concat(F.lit(base), slug)
