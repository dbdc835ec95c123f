"""All registered queries."""

from . import date_queries, http_queries, output_queries, record_queries, resolve_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
