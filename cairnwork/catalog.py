"""Every query of the library outside the training-data subpackage, with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import conversations, corpus, curation, evaluation, guards, logs, packing, reports, tasks  # noqa: F401  (each registers its queries)
from .plans.registry import ORACLE, QUERIES

FLAGSHIP = "t02_t06_quota_top_k"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
