"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> Column:
    """The row as one struct, so that its columns can't clash with those an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def mixed(column: Column | str, seed: int) -> Column:
    """A 64-bit hash of the column under a seed."""
    return F.xxhash64(F.lit(seed), column)


def in_parts(column: Column | str, count: int | Column, seed: int = 11) -> Column:
    """A stable part number from 0 to count - 1."""
    return F.pmod(mixed(column, seed), F.lit(count).cast("long") if isinstance(count, int) else count.cast("long")).cast("int")
