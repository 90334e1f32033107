"""Edges and facts as streams with state for each key: a batch reads and writes the state of the keys it touches, and no history.

Tables are two append-only logs, one of rows as they arrive and one of what
ends them; a row is ended once at most, so reading is one join on seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import relationships as R

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACT_KEYS = ("entity_id",)
#: seq names the row; ended_by and ended_at are set in rows that end an earlier one.
EVENTS = "seq long, version long, conflicts long, ended_seq long, ended_by long, ended_at long"


def use_state_store(spark: SparkSession) -> None:
    """State by key lies in RocksDB under the checkpoint, so it may outgrow memory and outlives executors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


def _events(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in EVENTS.split(", ")]
    return pd.DataFrame(rows, columns=names).astype("Int64")


class EdgeState(StatefulProcessor):
    """Of a source: the open edge of each class, and the last version of each closing type."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "class string", "seq long")
        self.version = handle.getMapState("version", "rel_type string", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for seq, kind, at in _in_order(rows)[["seq", "rel_type", "at"]].itertuples(index=False):
            group = R.CLOSING.get(kind)
            if group is None:
                out.append((seq, 1, 0, None, None, None))
                continue
            version = (self.version.getValue((kind,))[0] if self.version.containsKey((kind,)) else 0) + 1
            before = self.open.getValue((group,))[0] if self.open.containsKey((group,)) else None
            out.append((seq, version, int(before is not None), before, None if before is None else seq, None if before is None else at))
            self.version.updateValue((kind,), (int(version),))
            self.open.updateValue((group,), (int(seq),))
        yield _events(out)

    def close(self) -> None:
        pass


class FactState(StatefulProcessor):
    """Of an entity: the active facts of each key as a queue, one entry of state each, so a long queue is never read as a whole."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getMapState("ends", "fact_key string", "head long, tail long")
        self.queue = handle.getMapState("queue", "fact_key string, place long", "seq long")

    def _ends(self, key: str) -> tuple[int, int]:
        return tuple(self.ends.getValue((key,))) if self.ends.containsKey((key,)) else (0, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for seq, name, gone, at in _in_order(rows)[["seq", "fact_key", "supersedes_key", "at"]].itertuples(index=False):
            ended = None
            if isinstance(gone, str):
                head, tail = self._ends(gone)
                if head < tail:
                    ended = self.queue.getValue((gone, head))[0]
                    self.queue.removeKey((gone, head))
                    self.ends.updateValue((gone,), (head + 1, tail))
            if isinstance(name, str):
                head, tail = self._ends(name)
                self.queue.updateValue((name, tail), (int(seq),))
                self.ends.updateValue((name,), (head, tail + 1))
            out.append((seq, 1, 0, ended, None if ended is None else seq, None if ended is None else at))
        yield _events(out)

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, keys: list[str], processor: StatefulProcessor, columns: list[str]) -> DataFrame:
    use_state_store(rows.sparkSession)
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("valid_from"))
    asked = rows.select(*keys, "seq", *columns, at.alias("at"))
    return asked.groupBy(*keys).transformWithStateInPandas(processor, EVENTS, "Append", "None")


def edge_events(assertions: DataFrame) -> DataFrame:
    """A streaming table of assertions to its events: version and conflicts of each new edge, and which edge it ends."""
    return _stream(assertions, R.KEYS, EdgeState(), ["rel_type"])


def fact_events(facts: DataFrame, keys: tuple[str, ...] = FACT_KEYS) -> DataFrame:
    """A streaming table of facts to its events: which active fact each one supersedes, the first inserted of its key."""
    return _stream(facts, list(keys), FactState(), ["fact_key", "supersedes_key"])


class LogTable:
    """Arrived rows and events, a folder for each batch; a batch that comes again overwrites its own folders."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def rows_batch(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")

    def events_batch(self, events: DataFrame, batch_id: int) -> None:
        events.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch_id}")

    def _log(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/batch=*").drop("batch")

    def _ended(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        events = self._log(spark, "events")
        at = F.timestamp_add("MICROSECOND", F.col("ended_at"), F.lit("1970-01-01").cast("timestamp_ntz"))
        return events, events.where(F.col("ended_seq").isNotNull()).select(F.col("ended_seq").alias("seq"), at.alias("_end"), "ended_by")

    def edges(self, spark: SparkSession) -> DataFrame:
        """The edges of all batches so far, as ``relationships.resolve`` gives them."""
        events, ended = self._ended(spark)
        rows = self._log(spark, "rows").join(events.select("seq", "version", "conflicts"), "seq").join(ended.drop("ended_by"), "seq", "left")
        return rows.withColumns({"valid_to": F.col("_end"), "recorded_to": F.col("_end")}).drop("_end")

    def facts(self, spark: SparkSession) -> DataFrame:
        """The facts of all batches so far, as ``facts.supersede`` gives them."""
        events, ended = self._ended(spark)
        by = events.select("seq", F.col("ended_seq").alias("supersedes_seq"))
        rows = self._log(spark, "rows").join(by, "seq").join(ended.drop("ended_by"), "seq", "left").withColumnRenamed("_end", "valid_to")
        return rows.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def write_log(rows: DataFrame, events: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts both logs of a table, each with its own checkpoint; the queries, to wait for or stop."""
    table = LogTable(path)
    start = lambda df, put, name: df.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    return start(rows, table.rows_batch, "rows"), start(events, table.events_batch, "events")
