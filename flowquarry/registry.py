"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowquarry.plans import detail_queries  # noqa: F401  registers its queries
from flowquarry.plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most likely process of every flow, from a model trained on the others."""
    return plans.nb_classify(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
