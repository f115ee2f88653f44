"""Every core query and its SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans import answer_queries, artifact_queries, cluster_queries, experiment_queries, labels, model_queries, papers, rejected_rows, search_queries, storage_queries, text_queries

MODULES = (rejected_rows, papers, search_queries, labels, cluster_queries, text_queries, storage_queries, model_queries, artifact_queries, experiment_queries, answer_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
