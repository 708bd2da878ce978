"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import annex_queries, boundary_queries, course_queries, document_queries, fold_queries, layout_queries, link_queries, list_queries, novelle_queries, proof_queries, record_queries, rule_queries, text_queries, tree_queries, version_queries, xml_queries

MODULES: list = [list_queries, fold_queries, layout_queries, link_queries, text_queries, document_queries, record_queries, rule_queries, annex_queries, tree_queries, version_queries, boundary_queries, proof_queries, layout_queries, course_queries, xml_queries, novelle_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
