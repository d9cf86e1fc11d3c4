"""Queries over the test tables, each with the SQL that checks it."""

from workload import (  # noqa: F401
    panel_queries, column_queries, summary_queries, source_queries, model_queries,
)
from workload.registry import QUERIES  # noqa: F401
