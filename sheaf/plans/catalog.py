"""Importing this module registers every query."""

from . import html_queries, order_queries, package_queries, relation_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
