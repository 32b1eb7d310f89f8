"""All registered queries of the analytics engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import calibration, contracts, cross_section, inference, kernels, monitoring, panel, paths, point_in_time, records, regression, relational, series, significance, surfaces, tilts, time_series, walk_forward

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [time_series, cross_section, relational, calibration, inference, regression, significance, records, kernels, point_in_time, panel, surfaces, monitoring, walk_forward, paths, tilts, contracts, series]


def queries() -> dict[str, Query]:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_section.QUERIES["rotation_score"](spark, sf_dir)
