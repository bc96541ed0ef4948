"""Imports every query module, so that the registry is complete."""

from . import config_queries, diff_queries, fact_queries, graph_queries, impact_queries, relation_queries, source_queries, stream_queries, text_queries, verdict_queries, version_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
