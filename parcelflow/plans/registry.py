"""Named queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.plans import extraction_queries, listing_queries, property_queries, resolution_queries, space_queries, statistics_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _plan in (extraction_queries, listing_queries, property_queries, resolution_queries, statistics_queries, space_queries):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["golden_properties"](spark, sf_dir)
