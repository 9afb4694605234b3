"""The catalogue: every query by its stable name, with the SQL it must equal."""

from . import content_queries, fact_queries, mailbox_queries, panel_queries, people_queries, report_queries, search_queries, word_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
