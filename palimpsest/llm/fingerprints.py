"""Exact document fingerprints, with DataFrame functions only.

The canonical form of a text is its compatibility composition (NFKC), case
folded, white space folded.  Its fingerprint is 128 bits of xxhash.  Texts in
an equal bucket are compared byte by byte: texts that differ in one bucket get
different suffixes, so equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, small_enough, text_or_empty

#: Buckets with copies up to this many are looked up by broadcast (16 bytes each); more take a shuffled join.
BROADCAST_BUCKETS = 1_000_000
_LAST = 2**63 - 1


def canonical(text: Column) -> Column:
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, r"[\s\p{Z}\x{85}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as hex: two xxhash64 with different seeds."""
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(canon))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("palimpsest"), canon))), 16, "0"))


def buckets_apart(keyed: DataFrame) -> DataFrame | None:
    """keyed: (_digest, _canon).  (_digest, _canon, _nth) of the buckets that hold different texts, or None if there are none.

    Only buckets with several rows are compared; in each task equal texts are
    combined before the shuffle, so a bucket with a third of all rows sends one
    row a task.
    """
    shared = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_digest")
    shared = F.broadcast(shared) if small_enough(shared, BROADCAST_BUCKETS) else shared
    texts = keyed.join(shared, "_digest", "left_semi").groupBy("_digest", "_canon").agg(F.count(F.lit(1)).alias("_n"))
    split = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1)
    if split.isEmpty():
        return None
    return texts.join(split, "_digest").select("_digest", "_canon", F.row_number().over(W.partitionBy("_digest").orderBy("_canon")).alias("_nth"))


def _with_suffix(rows: DataFrame, apart: DataFrame, digest_col: str, canon_col: str, out_col: str) -> DataFrame:
    """rows with the fingerprint: the digest, and in a bucket of different texts the number of the text."""
    found, text, nth = fresh(rows.columns, "found", "text", "nth")
    numbered = apart.select(F.col("_digest").alias(found), F.col("_canon").alias(text), F.col("_nth").alias(nth))
    joined = rows.join(numbered, (F.col(digest_col) == F.col(found)) & (F.col(canon_col) == F.col(text)), "left")
    return joined.withColumn(out_col, F.concat(F.col(digest_col), F.coalesce(F.concat(F.lit("-"), F.col(nth).cast("string")), F.lit("")))).drop(found, text, nth)


def fingerprint_texts(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint", digest=digest) -> DataFrame:
    """docs with a fingerprint column (which replaces one of that name).

    A null text counts as empty.  Texts whose canonical forms are equal, and
    only those, have equal fingerprints.  Repeated rows stay; an empty table
    stays empty.
    """
    canon = canonical(text_or_empty(text_col))
    apart = buckets_apart(docs.select(canon.alias("_canon")).select(digest(F.col("_canon")).alias("_digest"), "_canon"))
    if apart is None:
        return docs.withColumn(out_col, digest(canon))
    c, d = fresh(docs.columns, "canon", "digest")
    return _with_suffix(docs.withColumn(c, canon).withColumn(d, digest(F.col(c))), apart, d, c, out_col).drop(c, d)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, first id, number of documents, for every group of equal canonical texts."""
    return fingerprint_texts(docs, text_col=text_col).groupBy("fingerprint").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n_docs"))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id") -> DataFrame:
    """docs with next_<column> of the following row by ascending id; the last row is followed by the first.

    Rows are dealt into ranges of ids, cut at quantiles; the first row of a
    range is also handed to the range before it.  So the order is global
    without one task seeing all rows.  Null ids come last; rows that share an id
    are ordered by a hash of the columns, and an id that very many rows share
    (or none at all) is cut into ranges of that hash.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    key, tie, place, first, ghost, to = fresh(docs.columns, "key", "tie", "place", "first", "ghost", "to")
    own = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn(tie, F.xxhash64(*columns))
    n = 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    quantiles = own.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]  # n numbers
    own = own.withColumn(place, _range_of(sorted(quantiles), F.col(key), F.col(tie)))
    firsts = sorted(map(tuple, own.groupBy(place).agg(F.min(F.struct(key, tie))).collect()))  # at most 2 n rows
    lead = spark.createDataFrame([(p, *f, firsts[i - 1][0]) for i, (p, f) in enumerate(firsts)], f"{first} long, {first}k long, {first}t long, {to} long")
    own = own.join(F.broadcast(lead), (F.col(place) == F.col(first)) & (F.col(key) == F.col(f"{first}k")) & (F.col(tie) == F.col(f"{first}t")), "left")
    spot = lambda c, g: F.struct(F.col(c).alias("p"), F.lit(g).alias("g"))
    spots = F.when(F.col(to).isNull(), F.array(spot(place, False))).otherwise(F.array(spot(place, False), spot(to, True)))
    dealt = own.withColumn(ghost, F.explode(spots)).withColumn(place, F.col(ghost)["p"]).withColumn(ghost, F.col(ghost)["g"])
    w = W.partitionBy(place).orderBy(ghost, key, tie)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(~F.col(ghost)).drop(key, tie, place, first, f"{first}k", f"{first}t", ghost, to)


def _range_of(quantiles: list[int], key: Column, tie: Column) -> Column:
    """A number that ascends with (key, tie).

    It is the number of distinct quantiles below the key, found in two steps of
    about the root of their number.  A key that is several quantiles in a row
    is cut into as many ranges of the tie.
    """
    cuts = sorted(set(quantiles))
    times = [quantiles.count(c) for c in cuts] if len(cuts) < len(quantiles) else [1] * len(cuts)
    step = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda a: F.size(F.filter(a, lambda c: c < key))
    block = F.least(below(F.lit([b[-1] for b in blocks])), F.lit(len(blocks) - 1))
    bucket = block * step + below(F.get(F.lit([b + [_LAST] * (step - len(b)) for b in blocks]), block))
    many, upper = F.coalesce(F.get(F.lit(times), bucket), F.lit(1)), F.get(F.lit(cuts), bucket)
    part = F.floor((tie / F.lit(2.0**64) + 0.5) * many).cast("long")
    return bucket.cast("long") * (len(quantiles) + 2) + F.when((many > 1) & (key == upper), part + 1).otherwise(0)


def compare_fingerprints(docs: DataFrame, *, digest=digest) -> DataFrame:
    """The contract's query: every text, its edited text, and likeness to it and to the next text (1 or 0: fingerprints are exact).

    Null texts count as empty.  Null ids come last; rows that share an id are
    ordered by a hash; repeated rows each have a row; an empty table gives no
    rows; other columns are not carried.  An edited text that equals some text
    has its fingerprint, and is compared with its own text byte by byte if the
    digests are equal; edited texts are not compared with each other.
    """
    canon = canonical(text_or_empty())
    apart = buckets_apart(docs.select(canon.alias("_canon")).select(digest(F.col("_canon")).alias("_digest"), "_canon"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), canon.alias("canon")).withColumn("digest", digest(F.col("canon")))
    rows = rows.withColumn("fingerprint", F.col("digest")) if apart is None else _with_suffix(rows, apart, "digest", "canon", "fingerprint")
    rows = with_next(rows.select("doc_id", "text", "digest", "fingerprint"), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("*", edited.alias("edited")).select("*", canonical(F.col("edited")).alias("c_edited")).withColumn("d_edited", digest(F.col("c_edited")))
    rows = rows.withColumn("f_edited", F.col("d_edited")) if apart is None else _with_suffix(rows, apart, "d_edited", "c_edited", "f_edited")
    same = F.when(F.col("digest") == F.col("d_edited"), canonical(F.col("text")) == F.col("c_edited")).otherwise(F.lit(False))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint",
        F.col("f_edited").alias("edited_fingerprint"), same.cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
