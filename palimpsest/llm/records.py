"""Length-delimited binary records with masked checksums, and an offset index for reads in any order.

A record is framed as an 8-byte little-endian length, the masked CRC-32C of
those 8 bytes, the payload, and the masked CRC-32C of the payload.  Tasks write
frames to files of their own in the shared folder and hand on one index row a
record (part, place, file, offset, length, key).  The index is Parquet, written
under Spark's commit: a file that no committed row names, such as that of a lost
executor or a second attempt, is no part of the data set.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bytebpe import byte_encoder, tokenizer_path
from .common import Scratch, pieces, text_or_empty

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text and rows that a part (a task, one or more files) takes, or so; bytes after which a task starts another file.
PART_BYTES, PART_ROWS, FILE_BYTES = 32_000_000, 1_000_000, 256_000_000
HEAD, FOOT = 12, 4
BLOCK = 256
_POLY = 0x82F63B78  # CRC-32C, reflected


@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables to take four bytes at a time, and to move a checksum past 2 ** k zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLY), one >> 1)
    by = [one]
    for _ in range(3):
        by.append(one[by[-1] & 0xFF] ^ (by[-1] >> 8))
    step = lambda c: one[c & 0xFF] ^ (c >> 8)
    lone = np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
    moves = [lone]
    for _ in range(40):
        t = moves[-1]
        moves.append(np.stack([_apply(t, t[k]) for k in range(4)]))
    return np.stack(by[::-1]), moves


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 0xFF] ^ table[1][(c >> 8) & 0xFF] ^ table[2][(c >> 16) & 0xFF] ^ table[3][c >> 24]


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload, all of them side by side.

    A checksum is linear: payloads are padded in front to blocks, blocks are
    taken four bytes a step side by side, and a payload's blocks are joined by
    moving the checksum so far past a block of zeros.
    """
    four, moves = _tables()
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint32)
    n_blocks = -(-sizes // BLOCK)
    ends = np.cumsum(n_blocks)
    padded = b"".join(x for p, n in zip(payloads, n_blocks) for x in (bytes(int(n) * BLOCK - len(p)), p))
    words = np.frombuffer(padded, dtype="<u4").reshape(-1, BLOCK // 4)
    raw = np.zeros(len(words), np.uint32)
    for k in range(BLOCK // 4):
        raw = _apply(four, raw ^ words[:, k])
    out, at, block = np.zeros(len(sizes), np.uint32), ends - n_blocks, moves[BLOCK.bit_length() - 1]
    order = np.argsort(-n_blocks, kind="stable")
    for k in range(int(n_blocks.max())):
        live = order[: np.searchsorted(-n_blocks[order], -k, side="left")]
        out[live] = _apply(block, out[live]) ^ raw[at[live] + k]
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max()).bit_length()):
        on = (sizes >> k) & 1 == 1
        start[on] = _apply(moves[k], start[on])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum that may itself be checked: rotated by 15 bits, plus a constant."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The frames of the payloads one after the other, and the length of each payload."""
    sizes = np.array([len(p) for p in payloads], dtype="<u8")
    heads = [n.tobytes() for n in sizes]
    head, foot = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return b"".join(x for n, h, p, f in zip(heads, head, payloads, foot) for x in (n, h.tobytes(), p, f.tobytes())), sizes.astype(np.int64)


def unframe(spans: list[bytes], where: str = "") -> list[bytes]:
    """The payloads of the frames that the spans hold; a wrong length or checksum is an error."""
    heads, payloads, sums = [], [], []
    for span in spans:
        at = 0
        while at < len(span):
            n = int.from_bytes(span[at : at + 8], "little")
            if at + HEAD + n + FOOT > len(span):
                raise ValueError(f"a record of {where or 'the span'} is cut")
            heads.append(span[at : at + 8])
            payloads.append(span[at + HEAD : at + HEAD + n])
            sums.append((span[at + 8 : at + HEAD], span[at + HEAD + n : at + HEAD + n + FOOT]))
            at += HEAD + n + FOOT
    known = np.array([[int.from_bytes(a, "little"), int.from_bytes(b, "little")] for a, b in sums], dtype=np.uint32).reshape(-1, 2)
    if (masked(crc32c(heads)) != known[:, 0]).any() or (masked(crc32c(payloads)) != known[:, 1]).any():
        raise ValueError(f"a record of {where or 'the span'} has a wrong checksum")
    return payloads


def filesystem(uri: str):
    """The file system of a folder that executors share (local, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Files:
    """Writes frames to files of one task; a new file after ``limit`` bytes."""

    def __init__(self, folder: str, part: int, limit: int):
        self.fs, self.base = filesystem(folder)
        self.part, self.limit, self.out, self.at, self.name = part, limit, None, 0, ""

    def write(self, payloads: list[bytes]) -> tuple[str, np.ndarray, np.ndarray]:
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.name, self.at = f"{self.part:06d}-{uuid.uuid4().hex}.records", 0
            self.out = self.fs.open_output_stream(f"{self.base}/{self.name}")
        data, sizes = frame(payloads)
        offsets = self.at + np.cumsum(sizes + HEAD + FOOT) - (sizes + HEAD + FOOT)
        self.out.write(data)
        self.at += len(data)
        return self.name, offsets, sizes

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder: str, payloads_of, limit: int):
    """For mapInArrow: (key, value) rows to index rows.  payloads_of: Arrow values to payloads and the number of items in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, nth, before = _Files(folder, part, limit), 0, 0
        try:
            for b in pieces(batches):
                if not b.num_rows:
                    continue
                payloads, items = payloads_of(b.column(1))
                name, offsets, sizes = files.write(payloads)
                n = len(payloads)
                places = before + np.cumsum(items) - items
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(n, part, np.int64)), pa.array(nth + np.arange(n, dtype=np.int64)), pa.array([name] * n), pa.array(offsets), pa.array(sizes), pa.array(places.astype(np.int64)), pa.array(items.astype(np.int64))],
                    names=["key", "part", "nth", "file", "offset", "length", "before", "items"],
                )
                nth, before = nth + n, before + int(items.sum())
        finally:
            files.close()

    return run


class RecordSet:
    """Records in a folder: ``data`` holds the files, ``index`` the offsets.

    Index columns: key, part (tasks in order), nth (place in the part), file,
    offset and length of the payload's frame, items and how many items the part
    has before it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def write(self, rows: DataFrame, payloads_of=None, *, file_bytes: int = FILE_BYTES) -> "RecordSet":
        """rows: (key, value), written in the order of their partitions.  Values are binary, or what ``payloads_of`` makes payloads of.

        A null value is an empty payload, repeated rows are written as often,
        an empty table gives an empty index and no file.
        """
        kind = rows.schema[rows.columns[0]].dataType.simpleString()
        schema = f"key {kind}, part long, nth long, file string, offset long, length long, before long, items long"
        rows.mapInArrow(_writer(f"{self.folder}/data", payloads_of or _as_they_are, file_bytes), schema).write.mode("overwrite").parquet(f"{self.folder}/index")
        return self

    def read(self, use=None, schema: str | None = None, *, shuffle_seed: int | None = None, parts: int | None = None) -> DataFrame:
        """key and payload of every record, in stored order or (``shuffle_seed``) in a random one.

        Records are dealt out by their index rows alone; a task reads those that
        lie side by side at once, all others by a seek each.  ``use`` turns (index rows,
        payloads) into a batch of ``schema`` within the task.
        """
        index = self.index()
        order = ["part", "nth"] if shuffle_seed is None else [F.xxhash64("part", "nth", F.lit(shuffle_seed))]
        n = parts or max(1, index.select("part").distinct().count())
        dealt = index.repartitionByRange(n, *order).sortWithinPartitions(*order)
        kind = index.schema["key"].dataType.simpleString()
        return dealt.mapInArrow(_reader(f"{self.folder}/data", use or _key_and_payload), schema or f"key {kind}, payload binary")

    def verify(self) -> int:
        """Reads every record against its checksums; how many there are."""
        return self.read(_count_only, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _as_they_are(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    got = [v or b"" for v in values.to_pylist()]
    return got, np.array([len(v) for v in got], dtype=np.int64)


def _key_and_payload(index: pa.RecordBatch, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([index.column("key"), pa.array(payloads, pa.binary())], names=["key", "payload"])


def _count_only(index: pa.RecordBatch, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(payloads)], pa.int64())], names=["n"])


def _reader(folder: str, use):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name, source = None, None
        try:
            for b in pieces(batches):
                if not b.num_rows:
                    continue
                files, offsets, sizes = b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()
                spans, k = [], 0
                while k < len(files):
                    end, stop = k + 1, offsets[k] + sizes[k] + HEAD + FOOT
                    while end < len(files) and files[end] == files[k] and offsets[end] == stop:
                        stop += sizes[end] + HEAD + FOOT
                        end += 1
                    if files[k] != name:
                        if source is not None:
                            source.close()
                        name, source = files[k], store.open_input_file(f"{base}/{files[k]}")
                    spans.append(source.read_at(stop - offsets[k], offsets[k]))
                    k = end
                payloads = unframe(spans, name)
                if [len(p) for p in payloads] != sizes:
                    raise ValueError(f"the records of {name} are not those of its index")
                yield use(b, payloads)
        finally:
            if source is not None:
                source.close()

    return run


def in_order(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, text or empty) in ascending order of id over partitions and within them.

    Null ids come last; rows that share an id are ordered by a hash of the text,
    and equal rows by a number, so that an id with very many rows is cut like
    any other.  The number of ranges follows the bytes and rows.
    """
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    n = max(1, -(-size // part_bytes), -(-rows // part_rows))
    keyed = docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id())
    order = [F.col(id_col).asc_nulls_last(), "tie", "nth"]
    return keyed.repartitionByRange(int(n), *order).sortWithinPartitions(*order).select(id_col, "text")


def _token_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES, file_bytes: int = FILE_BYTES) -> RecordSet:
    """The ids of every text with ``end_id`` after them, as records in ascending order of the document's id.

    A payload is the ids as little-endian unsigned numbers of 16 bits, or 32 if
    the vocabulary is larger.  A null text counts as empty and has the end id alone.
    """

    def payloads_of(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
        encoder = byte_encoder(tokenizer_path(tokenizer))
        kind, end = _token_type(encoder.size), [end_id]
        ids = encoder.encode(values.to_pylist())
        return [np.concatenate([x, end]).astype(kind).tobytes() for x in ids], np.array([len(x) + 1 for x in ids], dtype=np.int64)

    return RecordSet(docs.sparkSession, folder).write(in_order(docs, id_col=id_col, text_col=text_col, part_bytes=part_bytes), payloads_of, file_bytes=file_bytes)


def token_records(docs: DataFrame, tokenizer: str = TOKENIZER, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Per document, read back from its record: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null texts have the end id alone; null ids come last; rows that share an id
    each have a row, in an order by their texts; an empty table gives no rows;
    other columns are not carried.  The files lie in ``folder``, or in the shared
    folder until the driver ends.
    """
    spark = docs.sparkSession
    records = write_tokens(docs, folder or f"{Scratch(spark).base}/records", tokenizer, id_col=id_col, text_col=text_col)

    def use(index: pa.RecordBatch, payloads: list[bytes]) -> pa.RecordBatch:
        kind = _token_type(byte_encoder(tokenizer_path(tokenizer)).size)
        ids = [np.frombuffer(p, kind).astype("<u4") for p in payloads]
        n = [len(x) for x in ids]
        if n != index.column("items").to_pylist():
            raise ValueError("a record has other ids than its index says")
        crc = [zlib.crc32(x.tobytes()) for x in ids]
        return pa.RecordBatch.from_arrays([index.column("key"), index.column("part"), index.column("before"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "part", "before", "n_tokens", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    back = records.read(use, f"`{id_col}` {kind}, part long, before long, n_tokens long, ids_crc32 long")
    return back.join(F.broadcast(part_starts(records.index())), "part").select(id_col, (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def part_starts(index: DataFrame) -> DataFrame:
    """(part, start): the items of all parts before; a row for each PART_BYTES of text."""
    totals = index.groupBy("part").agg(F.sum("items").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
