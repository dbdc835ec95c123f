"""Documents to chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import let
from ..functions.text import DEFAULT_MAX_TOKENS, HARD_CHAR_CEILING, chunk_array, estimate_tokens


def chunk_documents(
    docs: DataFrame,
    text_col: str,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    hard_char_ceiling: int = HARD_CHAR_CEILING,
) -> DataFrame:
    """One row per chunk: ``chunk_index``, ``total_chunks``, ``approx_tokens``, ``chunk_text``.

    The text column is replaced by its chunks; a document with nothing left has no rows.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]

    def numbered(chunks: Column) -> Column:
        return F.transform(
            chunks,
            lambda text, place: F.struct(
                place.alias("chunk_index"),
                F.size(chunks).alias("total_chunks"),
                estimate_tokens(text).alias("approx_tokens"),
                text.alias("chunk_text"),
            ),
        )

    # The generator takes the expression itself: over a column, the optimizer would
    # add "not empty" filters below it and pack every document again for each.
    return docs.select(*kept, F.inline(let(chunk_array(F.col(text_col), max_tokens, hard_char_ceiling), numbered)))
