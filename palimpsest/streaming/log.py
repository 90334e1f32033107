"""Pushed messages as a stream: a log of segments that writers append to, read with offsets that can be replayed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import scalars as S
from ..sources.files import MESSAGE

RAW = "writer string, segment long, line long, value string"
#: Messages of a segment; seq numbers leave room for so many.
SEGMENT_ROWS, LINE_BITS = 100_000, 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _segments(path: str) -> dict[str, list[int]]:
    """The numbers of each writer's segments, ascending.  A segment has its name only when it is whole."""
    from pyarrow import fs

    store, base = _store(path)
    found: dict[str, list[int]] = {}
    for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and f.path.endswith(".ndjson"):
            writer, _, number = f.path.removeprefix(base.rstrip("/") + "/").removesuffix(".ndjson").rpartition("/")
            found.setdefault(writer, []).append(int(number))
    return {w: sorted(n) for w, n in found.items()}


def append(path: str, messages: Iterable[dict], writer: str = "push") -> int:
    """Adds messages to the log as new segments of one writer, and returns how many segments it has.

    A segment is written under another name and then renamed, so readers see whole
    ones only.  Writers don't share a name; each numbers its own segments.
    """
    store, base = _store(path)
    number = max(_segments(path).get(writer, [-1])) + 1
    rows = [json.dumps(m) for m in messages]
    store.create_dir(f"{base}/{writer}", recursive=True)
    for k in range(0, len(rows), SEGMENT_ROWS):
        name = f"{base}/{writer}/{uuid.uuid4().hex}.part"
        with store.open_output_stream(name) as out:
            out.write("\n".join(rows[k : k + SEGMENT_ROWS]).encode())
        store.move(name, f"{base}/{writer}/{number:012d}.ndjson")
        number += 1
    return number


class Segment(InputPartition):
    def __init__(self, writer: str, number: int):
        self.writer, self.number = writer, number


def _lines(path: str, part: Segment) -> Iterator[tuple]:
    store, base = _store(path)
    with store.open_input_file(f"{base}/{part.writer}/{part.number:012d}.ndjson") as f:
        for k, line in enumerate(f.read().decode().split("\n")):
            yield part.writer, part.number, k, line


class LogStream(DataSourceStreamReader):
    """An offset is each writer's last segment; a batch is the segments between two offsets, so it can be read again as it was."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {w: n[-1] for w, n in _segments(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(w, n) for w, last in sorted(end.items()) for n in range(start.get(w, -1) + 1, last + 1)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _lines(self.path, partition)

    def commit(self, end: dict) -> None:
        """Segments stay: what was read may be asked for again after a restart."""


class LogBatch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Segment]:
        return [Segment(w, n) for w, all_ in sorted(_segments(self.path).items()) for n in all_]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _lines(self.path, partition) if partition is not None else iter(())


class MessageLog(DataSource):
    """spark.read or spark.readStream.format("message_log").load(folder), after ``register``; the folder is one that executors share."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> LogBatch:
        return LogBatch(self.options["path"])

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MessageLog)


def messages(raw: DataFrame, now: str, tenant: str = "default", conversation: str = "default") -> DataFrame:
    """Log rows, batch or stream, to messages with the defaults of a pushed payload; rows without text or speaker are left out.

    seq follows arrival (segment, then line), whatever time a message gives, so a
    late one is a version after those that came before it.  Rows of several
    writers are told apart by ``writer``.
    """
    rows = raw.select("writer", (F.shiftleft("segment", LINE_BITS) + F.col("line")).alias("seq"), F.from_json("value", MESSAGE).alias("m")).select("writer", "seq", "m.*")
    rows = rows.where(F.col("text").isNotNull() & F.col("speaker").isNotNull())
    rows = rows.withColumns({"conversation_id": F.coalesce("conversation_id", F.lit(conversation)), "tenant_id": F.coalesce("tenant_id", F.lit(tenant))})
    return rows.withColumns({"group_id": S.effective_group(F.col("group_id"), F.col("conversation_id")), "timestamp": S.parse_time(F.coalesce("timestamp", F.lit(now))), "message_id": F.coalesce("message_id", F.concat_ws(":", "writer", F.col("seq").cast("string")))})
