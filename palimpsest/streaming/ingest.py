"""Streaming ingest: dedup under a watermark, and versioned edges kept as a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import relationships as R

DEDUP_HORIZON = "7 days"


def dedup_stream(messages: DataFrame, time_col: str = "timestamp", horizon: str = DEDUP_HORIZON) -> DataFrame:
    """First arrival of each message id within the horizon; state older than it is let go."""
    return messages.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["message_id"])


def activity(messages: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour", time_col: str = "timestamp") -> DataFrame:
    w = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    return messages.withWatermark(time_col, late).groupBy(w, "conversation_id").agg(F.count(F.lit(1)).alias("messages"))


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time_col: str = "timestamp") -> DataFrame:
    return messages.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), "conversation_id").agg(F.count(F.lit(1)).alias("messages"))


def seed_rows(edges: DataFrame) -> DataFrame:
    """What a later batch needs: the open edge of each class, and the last version of each closing type."""
    rows = edges.withColumn("_class", R.edge_class(F.col("rel_type"))).where(F.col("_class").isNotNull())
    last = F.row_number().over(W.partitionBy(*R.KEYS, "rel_type").orderBy(F.desc("seq")))
    return rows.withColumn("_k", last).where(F.col("_k") == 1).drop("_k", "_class")


class EdgeTable:
    """A Parquet table of resolved edges, one folder a batch; a batch that runs again overwrites its own folder.

    Rows of earlier batches that a new one closes are written again; the row of
    the highest batch counts.
    """

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def read(self, spark, before: int | None = None) -> DataFrame | None:
        try:
            rows = spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        rows = rows.where(F.col("batch") < before) if before is not None else rows
        return rows.withColumn("_k", F.row_number().over(W.partitionBy("seq").orderBy(F.desc("batch")))).where(F.col("_k") == 1).drop("_k", "batch")

    def upsert(self, assertions: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        old = self.read(assertions.sparkSession, batch_id)
        prior = None if old is None else seed_rows(old)
        R.resolve(assertions.select(*self.columns), prior=prior).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
