"""Queries of the core's own problem: timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.operators import timestamps
from folioflow.plans.registry import query
from folioflow.sources.tables import table


def _normalised(spark: SparkSession, base: str) -> DataFrame:
    return timestamps.normalise(spark, table(spark, base, "articles"), table(spark, base, "sites"))


@query()
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _normalised(spark, base).filter("fixed").select("article_id", "utc_us")


@query()
def p2_normalised(spark: SparkSession, base: str) -> DataFrame:
    return _normalised(spark, base)
