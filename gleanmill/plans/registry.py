"""All queries by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """A Spark job over the given tables and, where SQL can express it, the equivalent query."""

    build: Build
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from gleanmill.plans import (
        citation_queries,
        json_queries,
        knowledge_queries,
        page_queries,
        report_queries,
        search_queries,
        source_queries,
        stream_queries,
        text_queries,
        trace_queries,
    )

    merged: dict[str, Query] = {}
    for module in (
        report_queries,
        text_queries,
        json_queries,
        source_queries,
        search_queries,
        citation_queries,
        page_queries,
        knowledge_queries,
        trace_queries,
        stream_queries,
    ):
        for name, query in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = query
    return merged
