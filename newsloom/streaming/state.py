"""Versioned state tables for micro-batches.

Every batch reads the newest committed version before it and writes its own; the
commit is a one-row table written last. Replaying a batch after a failure reads
the same input version and overwrites its own output, so each batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COMMIT = "batch long, part string"


class StateTables:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _committed(self, before: int) -> int | None:
        try:
            log = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException:
            return None
        return log.filter(F.col("batch") < before).agg(F.max("batch")).first()[0]

    def read(self, name: str, before: int, schema: str) -> DataFrame:
        version = self._committed(before)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={version}")

    def latest(self, name: str, schema: str) -> DataFrame:
        return self.read(name, 1 << 62, schema)

    def write(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        """Write a table of this batch and continue from the written copy, which also cuts lineage."""
        path = f"{self.root}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, batch: int) -> None:
        row = self.spark.createDataFrame([(batch, "all")], COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/id={batch}")

    def all_batches(self, name: str, schema: str) -> DataFrame:
        """Append-only outputs of every committed batch."""
        log = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits").select("batch")
        rows = self.spark.read.schema(schema + ", batch long").parquet(f"{self.root}/{name}")
        return rows.join(log, "batch", "left_semi")
