"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import functools
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as no taken name needs; Spark's names ignore case."""
    used, mark = {t.lower() for t in taken}, "_"
    while any((mark + n).lower() in used for n in names):
        mark += "_"
    return [mark + n for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    The cluster names it in spark.checkpoint.dir.  Only a local session
    without that setting gets a folder of its own, since there driver and
    executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    own = tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def release(spark: SparkSession) -> None:
    """Let the executors delete shuffle files that no plan refers to any more.

    Spark does so when the driver's garbage collector has found the plans to be
    gone, which on a driver with little to do may take half an hour.
    """
    spark.sparkContext._jvm.java.lang.System.gc()


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives lost executors, is columnar and compressed, and
    gives the optimizer real sizes.  After a write the shuffle files behind it
    are let go.  ``drop`` removes what is no longer read; the rest goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.base}/{name}")

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        try:
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
        except Exception as e:  # at exit the JVM may be gone; whole tables then stay in the shared folder
            logging.getLogger(__name__).warning("%s was not removed: %s", path, e)


#: Rows whose texts a Python worker holds at a time.
PIECE_ROWS = 256


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices (no copies), so that the words of a whole batch are never in memory together."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


#: Bytes of an Arrow batch inside small_batches; Spark's own limit is 64 MB, which the JVM, while it grows the batch, and the Python worker hold several times.
BATCH_BYTES = 4 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends BATCH_BYTES or so to a Python worker at a time, unless it has a limit of its own.

    For jobs that return frames which run later, when small_batches has ended.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def local_rows(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A few rows of the driver as a DataFrame, by Arrow: from a list Spark would start Python workers of a second kind beside those of the operators."""
    kinds = to_arrow_schema(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rows], kind.type) for k, kind in enumerate(kinds)], schema=kinds), schema)


def small_batches(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator of a DataFrame that writes its tables itself: while it runs, the session sends BATCH_BYTES or so to a Python worker at a time."""
    @functools.wraps(run)
    def bounded(docs: DataFrame, *args, **options) -> DataFrame:
        conf = docs.sparkSession.conf
        before = conf.get(ARROW_BYTES, None)
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
        try:
            return run(docs, *args, **options)
        finally:
            conf.unset(ARROW_BYTES) if before is None else conf.set(ARROW_BYTES, before)

    return bounded


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether df has at most ``limit`` rows; looks at no more than limit + 1."""
    return df.limit(limit + 1).count() <= limit


#: Ids that are broadcast to take rows out; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows of these ids (a written table); rows with a null id stay."""
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    return docs.join(ids, id_col, "left_anti").select(docs.columns)
