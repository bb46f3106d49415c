"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.plans import q_feeds, q_history, q_pages, q_streams, refresh  # noqa: F401
from newsloom.plans.registry import ORACLES, QUERIES  # noqa: F401
from newsloom.session import tune


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return refresh.front_documents(tune(spark), folder)
