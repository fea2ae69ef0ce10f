"""The registered queries of the library and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, governance_queries, graph_queries, request_queries, source_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, answer_queries, graph_queries, governance_queries, source_queries, request_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.hybrid_search(spark, sf_dir)
