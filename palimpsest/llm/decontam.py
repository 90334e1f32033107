"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Fixed masks hash some of the words of a window and ignore the others, so a hit
survives substitutions at the ignored places.  Every window of every document is
probed against the hashes of the benchmark; around a hit the benchmark item is
laid on the document at the hit's offset and the equal words are counted.

Each mask starts with two adjacent words.  So a window whose first two words no
benchmark item has can have no hit, and its masks are never hashed: a join on
the hash of the pair finds that out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_enough, text_or_empty, without_ids

#: Any window of WINDOW words of which NEEDED are equal holds one of these masks (the tests prove it by enumeration).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 4, 5))
WINDOW, NEEDED = 13, 10
#: The index of the benchmark is broadcast up to this many words (some 100 bytes each); with more, ids and places are shuffled.
BROADCAST_WORDS = 2_000_000
#: Offsets that are broadcast to the texts (some 50 bytes each); with more, texts are shuffled to them.
BROADCAST_HITS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pairs(words: Column) -> Column:
    return F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _seeds(words: Column, at: Column) -> list[Column]:
    """The hashes of the masks at a 0-based place; null where a mask doesn't fit."""
    return [F.when(at + m[-1] < F.size(words), F.xxhash64(*(F.get(words, at + k) for k in m), F.lit(i))) for i, m in enumerate(MASKS)]


def _places(base: DataFrame, *carried: str) -> DataFrame:
    """A row per place that has a next word, with the hash of the two.  The outer form keeps Catalyst from testing the pairs of a text, and so cutting it into words, twice."""
    pairs = base.select("_id", "_row", *carried, _pairs(F.col("_w")).alias("_pairs"))
    return pairs.select("_id", "_row", *carried, F.posexplode_outer("_pairs").alias("_i", "_pair"))


def _probe(near: DataFrame) -> DataFrame:
    """The seeds at the places.  Its generator holds no lambda and so runs in generated code, which hands the words on without copies."""
    pair = F.xxhash64(F.get("_w", F.col("_i")), F.get("_w", F.col("_i") + 1))
    return near.select("_id", "_row", "_i", F.explode(F.array(*_seeds(F.col("_w"), F.col("_i")), pair)).alias("_seed"))


def _same_row(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on the id and the text's hash; null ids are equal."""
    b = b.withColumnsRenamed({"_id": "_id2", "_row": "_row2"})
    return a.join(b, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_row") == F.col("_row2")), how).drop("_id2", "_row2")


def _candidates(base: DataFrame, pair_index: DataFrame, index: DataFrame, broadcast: bool) -> DataFrame:
    """The distinct offsets (id, row, item key, diagonal) at which a seed of an item stands in a text.

    An index that fits a broadcast goes to the documents, which stay where they
    are.  Else only ids, places and hashes are shuffled, and words are fetched
    for the texts in which some pair of words is an item's.
    """
    if broadcast:
        near, index = _places(base, "_w").join(F.broadcast(pair_index), "_pair"), F.broadcast(index)
    else:
        at = _places(base).join(pair_index, "_pair").groupBy("_id", "_row").agg(F.collect_set("_i").alias("_at"))  # no more places than one text has
        near = _same_row(base, at).select("_id", "_row", "_w", F.explode("_at").alias("_i"))
    return _probe(near).join(index, "_seed").select("_id", "_row", "_key", (F.col("_i") - F.col("_j")).alias("_diag")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, needed: int = NEEDED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document and benchmark item that it holds: id, item, word_start, n_aligned, n_equal, best_window.

    A document holds an item if, at one offset, some ``window`` adjacent words
    have at least ``needed`` equal.  Items shorter than the window count if all
    their words are there, two at least.  Null and empty texts hold nothing;
    items of fewer than two words are left out.  Repeated documents give equal
    rows once; rows that share an id count as one document; empty tables give no
    rows; other columns are not carried.  The masks find every hit only if
    the window has WINDOW words or more and allows no more than
    WINDOW - NEEDED unequal ones; other values are refused.
    """
    if window < WINDOW or not 0 <= window - needed <= WINDOW - NEEDED:
        raise ValueError(f"the masks find all hits only for windows of {WINDOW} words or more with {WINDOW - NEEDED} unequal ones or fewer")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("_item"), words_of(text_or_empty(item_text)).alias("_iw")).where(F.size("_iw") >= 2).dropDuplicates()
    items = Scratch(spark).write(items.withColumn("_key", F.xxhash64("_item", "_iw")), "items")
    small = items.agg(F.coalesce(F.sum(F.size("_iw")), F.lit(0))).first()[0] <= BROADCAST_WORDS
    places = items.select("_key", "_iw", F.explode(F.sequence(F.lit(0), F.size("_iw") - 1)).alias("_j"))
    long_enough = F.size("_iw") > MASKS[0][-1]
    seeds = places.where(long_enough).select("_key", "_j", F.explode(F.array(*_seeds(F.col("_iw"), F.col("_j")))).alias("_seed")).where(F.col("_seed").isNotNull())
    pair = F.xxhash64(F.get("_iw", F.col("_j")), F.get("_iw", F.col("_j") + 1))
    index = seeds.unionByName(places.where(~long_enough & (F.col("_j") == 0)).select("_key", "_j", pair.alias("_seed")))
    pair_index = places.where(F.col("_j") + 1 < F.size("_iw")).select(pair.alias("_pair")).distinct()

    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t")).withColumn("_row", F.xxhash64("_t"))
    base = texts.select("_id", "_row", words_of(F.col("_t")).alias("_w"))
    found = Scratch(spark).write(_candidates(base, pair_index, index, small), "candidates")
    # Words are cut and compared once for each offset, in the few texts that have one.
    hits = F.broadcast(found) if small_enough(found, BROADCAST_HITS) else found
    hits = _same_row(texts, hits).join(F.broadcast(items) if small else items, "_key").withColumn("_w", words_of(F.col("_t"))).drop("_t")
    # The part of the document under the item, and the part of the item above it.
    skip = F.greatest(F.lit(0), -F.col("_diag"))
    under = F.slice("_w", F.greatest(F.col("_diag"), F.lit(0)) + 1, F.size("_iw") - skip)
    over = F.slice("_iw", skip + 1, F.size(under))
    laid = hits.select("_id", "_item", "_diag", F.size("_iw").alias("_len"), F.transform(F.arrays_zip(under.alias("a"), over.alias("b")), lambda x: (x["a"].eqNullSafe(x["b"])).cast("int")).alias("_eq"))
    laid = laid.dropDuplicates()
    span = F.least(F.lit(window), F.col("_len"))
    need = F.when(F.col("_len") >= window, F.lit(needed)).otherwise(F.col("_len"))
    starts = F.sequence(F.lit(1), F.size("_eq") - span + 1)
    best = F.when(F.size("_eq") >= span, F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("_eq", s, span), F.lit(0), lambda a, x: a + x))))
    checked = laid.withColumn("best_window", best).where(F.col("best_window") >= need)
    total = F.aggregate("_eq", F.lit(0), lambda a, x: a + x)
    rows = checked.select("_id", "_item", F.greatest(F.col("_diag"), F.lit(0)).cast("long").alias("word_start"), F.size("_eq").cast("long").alias("n_aligned"), total.cast("long").alias("n_equal"), F.col("best_window").cast("long").alias("best_window"))
    top = rows.groupBy("_id", "_item").agg(F.max(F.struct("n_equal", -F.col("word_start"), "n_aligned", "best_window", "word_start")).alias("t"))
    return top.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "t.word_start", "t.n_aligned", "t.n_equal", "t.best_window")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold a benchmark item; columns as they are.

    Rows with a null id stay.  Rows that share an id go together if the text of
    one holds an item; repeated rows go or stay alike; with an empty benchmark
    all stay.  The ids that go are written first, so texts are only shuffled if
    there are too many ids to broadcast.
    """
    found = Scratch(docs.sparkSession).write(contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "found")
    return without_ids(docs, found, id_col)
