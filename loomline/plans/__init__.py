"""Registered queries over the driver's tables."""

from . import arm_queries, assembly_queries, evaluation_queries, graph_queries, model_queries, more_queries, request_queries, resampling_queries, selection_queries, stat_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "assembly_queries", "evaluation_queries", "graph_queries", "model_queries", "more_queries", "request_queries", "resampling_queries", "selection_queries", "stat_queries", "text_queries"]
