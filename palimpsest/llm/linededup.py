"""Substring dedup by hashed lines and sentences.

Lines are cut into sentences; each unit is normalised and hashed, digests are
grouped over all documents, the earliest occurrence (by document id, text, then
place) stays, and later ones go, neighbours as one span.  Offsets refer to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, fresh, pieces

#: Words that a span has at least; with 1 every later occurrence goes, with more short units stay where they stand alone.
MIN_UNIT_WORDS = 1

# A mark ends a unit if white space follows; one mark is looked at once, so long runs of marks take linear time.
_UNIT = re.compile(r"\S[^\n]*?(?:[.!?](?=\s)|(?=\n)|\Z)")
_FILLER = re.compile(r"[\W_]+")
_MASK = (1 << 64) - 1


def units(text: str | None) -> Iterator[tuple[int, int, int, str]]:
    """start, end, words, normal form of each unit that holds a word."""
    for m in _UNIT.finditer(text or ""):
        normal = _FILLER.sub(" ", m[0].lower()).strip()
        if normal:
            yield m.start(), m.end(), normal.count(" ") + 1, normal


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _row_key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def unit_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per unit: the id and text hash of its row, its place, offsets, words and digest.

    Null and empty texts have no units; null ids stay null; an empty table gives
    no rows; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols: list[list] = [[] for _ in range(8)]
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for k, (a, z, n, normal) in enumerate(units(t)):
                    d = xxhash.xxh3_128_intdigest(normal)
                    for c, v in zip(cols, (i, r, k, a, z, n, _signed(d >> 64), _signed(d & _MASK))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["_id", "_row", "_k", "_start", "_end", "_words", "_h1", "_h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), _row_key(text_col).alias("_row"), text_col)
    return rows.mapInArrow(run, "_id long, _row long, _k int, _start int, _end int, _words int, _h1 long, _h2 long")


def repeated_spans(docs: DataFrame, *, min_unit_words: int = MIN_UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per span to remove: id, span_start, span_end, n_units, n_words, kept_id (where its first unit stays), text_hash.

    Every later occurrence of a unit goes, and neighbours form one span; with
    min_unit_words above 1, spans of fewer words stay.  Rows
    count as documents of their own by id and text: rows that share an id, or
    have none, but differ in text are apart, and text_hash tells whose offsets a
    span has.  Rows equal in id and text are one document.  Null ids come last
    and are ordered by text hash, as are the rows of one id.  Null texts have no
    units.  An empty table gives no rows.
    """
    all_units = unit_table(docs, id_col=id_col, text_col=text_col)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("_k").alias("k"))
    shared = all_units.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where(F.col("_n") > 1).drop("_n")
    # Written, so that both sides of the join come from plain shuffles and a digest that very many units have can be split.
    scratch = Scratch(docs.sparkSession)
    shared = scratch.write(shared, "shared")
    later = all_units.join(shared, ["_h1", "_h2"]).where(place != F.col("_first"))
    later = later.select("_id", "_row", "_k", "_start", "_end", "_words", F.col("_first.id").alias("_kept")).dropDuplicates(["_id", "_row", "_k"])
    island = F.col("_k") - F.row_number().over(W.partitionBy("_id", "_row").orderBy("_k"))
    runs = later.withColumn("_island", island).groupBy("_id", "_row", "_island").agg(
        F.min("_start").alias("span_start"), F.max("_end").alias("span_end"), F.count(F.lit(1)).alias("n_units"), F.sum("_words").alias("n_words"), F.min(F.struct("_k", "_kept")).alias("_from")
    )
    whole = runs.where(F.col("n_words") >= min_unit_words)
    return whole.select(F.col("_id").alias(id_col), F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), "n_units", "n_words", F.col("_from._kept").alias(f"kept_{id_col}"), F.col("_row").alias("text_hash"))


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the spans; a span goes with the white space behind it.

    A span is cut only from rows of its id and text.  Null texts, rows without
    spans and all other columns stay as they are; repeated rows are cut alike;
    without spans or rows the result is docs.
    """
    key, row, gone = fresh(docs.columns, "key", "row", "gone")
    grouped = spans.groupBy(F.col(id_col).alias(key), F.col("text_hash").alias(row)).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias(gone))  # of one text
    joined = docs.join(grouped, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (_row_key(text_col) == F.col(row)), "left").drop(key, row)
    at = joined.columns.index(text_col)

    def cut(text: str | None, gone: list | None) -> str | None:
        if text is None or not gone:
            return text
        out, at = [], 0
        for s in gone:
            out.append(text[at : s["span_start"]])
            at = s["span_end"]
            while at < len(text) and text[at].isspace():
                at += 1
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = pa.array([cut(t, g) for t, g in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
