"""All queries of the engine by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arterion.plans import accuracy, care, extensions, frames, learning, relational, shapes, signals, stream_views

MODULES = (accuracy, relational, stream_views, frames, signals, learning, shapes, care, extensions)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.QUERIES["acc_error_metrics"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
