"""N-gram Jaccard join with a token-group matrix, exact.

1. Each text becomes the set of its word n-grams (64-bit hashes).  Texts with
   equal sets fall together; one representative goes on.
2. Two sets whose Jaccard likeness reaches the threshold share an element of
   their prefixes under any one global order, and the first one that they share
   stands the earlier in both the closer their sizes are.  The order puts
   elements that many documents hold last, the commonest at the very end, so
   passages that many documents share don't call them together.  Right before
   the first element that two sets share stand different elements: where the
   same one stands before it in both, the pair has met there already.
3. Representatives that share a sketch (their least elements and size class)
   are partitioned into groups of bounded size.  The matrix holds, for each element, the groups whose
   union has it in a prefix.
4. Two groups are opened only if an element that their unions share stands early
   enough in members of both to be the first that a link shares, and if the overlap
   that their element counts in BINS hash bins allow reaches that of a link.  Opened
   pairs are compared exactly, block against block, and give a spanning forest
   of links.
5. Groups that share a widespread element are first compared with one of them:
   that with a member of the least share of elements that aren't common, since
   of a text and its edited copies the text itself is alike to most.  Then groups are cut by the classes that these links give.  Parts of one class
   are not paired with each other and meet others as one, so a large class of
   near copies costs no pair for each two groups.  All other pairs follow.
6. Connected components of the links give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, pieces, small_batches, small_enough, without_ids
from .components import connected_components

#: An element is common if more documents than this hold it.  The commonest COMMON_LIMIT of them are sent to the workers (17 bytes each), which only settles the order.
COMMON = 48
COMMON_LIMIT = 2_000_000
#: Elements that a worker counts at a time, and those of a key range.
PACK = 2_000_000
#: Bytes of packed keys that a worker hands on at a time, and keys of all rows of a range that it sums at a time.
SENT, SUMMED = 1 << 20, 1 << 17
_KEY = np.uint64(16)
#: Members of a group.
GROUP = 48
#: An element in more groups than this is widespread: its groups are first compared with one of them.
SPREAD = 8
#: Hash bins in which the elements of a set are counted for the overlap bound.
BINS = 256
#: Elements of several prefixes that are sent to the workers (8 bytes each); more take a shuffled join.
SHARED_LIST = 4_000_000
#: Groups are sent to the texts by broadcast for up to this many documents (16 bytes each); more take a shuffled join.
BROADCAST_MEMBERS = 2_000_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


class Shingler:
    """Sets of n-gram hashes, sorted.  A text with fewer words is one n-gram of its own kind; without words the set is empty."""

    def __init__(self, n: int):
        self.n, self.seen = n, _Memo()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()  # bytes split at ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh64_intdigest(b"\x1f".join(words), 99 + len(words))], np.uint64)
        if len(self.seen) > 65_536:
            self.seen.clear()
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        m = len(words) - self.n + 1
        with np.errstate(over="ignore"):
            out = np.zeros(m, np.uint64)
            for k in range(self.n):
                x = (h[k : k + m] + np.uint64(k + 1)) * _MIX[k % 7]
                out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def prefix_length(n: int, t: Fraction) -> int:
    return n - ceil_div(n * t.numerator, t.denominator) + 1 if n else 0


def pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as their gaps, by as many bytes as the widest needs, like bytes together."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(packed: bytes, count: int) -> np.ndarray:
    gaps = np.zeros((count, 8), np.uint8)
    if count:
        gaps[:, : len(packed) // count] = np.frombuffer(packed, np.uint8).reshape(-1, count).T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def packed(keys: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of a key range each, for keys once and keys more often; sorts keys where they are, and copies a range at a time."""
    keys.sort()
    lows = np.arange(int(keys[0]) // width, int(keys[-1]) // width + 2)
    cuts = np.searchsorted(keys, lows.astype(np.uint64) * np.uint64(width)).tolist()
    cols: list[list] = [[], [], [], []]
    for part, i, j in zip(lows.tolist(), cuts, cuts[1:]):
        if i < j:
            e, c = counted(keys[i:j])
            for some, times in ((e[c == 1], None), (e[c > 1], c[c > 1].astype("<u4").tobytes())):
                if len(some):
                    for col, v in zip(cols, (part, len(some), pack(some), times)):
                        col.append(v)
        if cols[0] and (j == len(keys) or sum(map(len, cols[2])) >= SENT):
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "size", "keys", "times"])
            cols = [[], [], [], []]


def summed(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the rows of a range and how often they occur; brings together some SUMMED keys at a time, of all rows."""
    rows = [(unpack(k.as_py(), n.as_py()), t.as_py()) for n, k, t in zip(*(found.column(c) for c in ("size", "keys", "times")))]
    rows = [(k, None if t is None else np.frombuffer(t, "<u4")) for k, t in rows]
    low, high = min(int(k[0]) for k, _ in rows), max(int(k[-1]) for k, _ in rows)
    bounds = np.arange(low, high + 1, ceil_div(high + 1 - low, ceil_div(sum(len(k) for k, _ in rows), SUMMED)), dtype=np.uint64)
    cuts = [[*np.searchsorted(k, bounds).tolist(), len(k)] for k, _ in rows]
    out = []
    for q in range(len(bounds)):
        some = [(k[x[q] : x[q + 1]], t if t is None else t[x[q] : x[q + 1]]) for (k, t), x in zip(rows, cuts) if x[q] < x[q + 1]]
        if some:
            out.append(counted(np.concatenate([k for k, _ in some]), np.concatenate([np.ones(len(k), "<u4") if t is None else t for k, t in some])))
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of counts of each; without counts of keys that are sorted, how often each stands there."""
    if counts is not None:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(starts, append=len(keys)) if counts is None else np.add.reduceat(counts, starts, dtype=np.int64)


def _common_elements(docs: DataFrame, n: int, text_col: str, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Elements that more than COMMON documents hold, by a count over all of them, and the power of two of each count.

    An element is counted by its upper 48 bits, which is enough for an order.
    Workers count PACK elements at a time and hand on a row per key range with
    the gaps of its sorted keys, some 4 bytes an element.  There are as many ranges as
    the texts need for PACK elements each, so one range fits in memory at any size, and
    an element that all documents hold is one entry in PACK.
    """
    size, least_count = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0, COMMON
    width = -(-(2**48) // max(1, size // (4 * PACK)))  # a word and the space after it take 4 bytes or more on the whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, count = Shingler(n), np.empty(PACK, np.uint64), 0
        for b in pieces(batches):
            for s in map(shingle, b.column(0).to_pylist()):
                while len(s):
                    some, s = s[: PACK - count], s[PACK - count :]
                    held[count : count + len(some)] = some >> _KEY
                    count += len(some)
                    if count == PACK:
                        yield from packed(held, width)
                        count = 0
        if count:
            yield from packed(held[:count], width)

    def total(found: pa.Table) -> pa.Table:
        e, c = summed(found)
        e, c = e[c > least_count], c[c > least_count]
        return pa.table({"e": pa.array(e.astype(np.int64)), "k": pa.array(np.log2(c).astype(np.int8))})

    rows = docs.select(text_col).mapInArrow(run, "part long, size long, keys binary, times binary")
    counts = scratch.write(rows.groupBy("part").applyInArrow(total, "e long, k byte"), "common")
    found = {r["k"]: r["count"] for r in counts.groupBy("k").count().collect()}  # a row per power of two
    least = min((k for k in found if sum(v for j, v in found.items() if j >= k) <= COMMON_LIMIT), default=64)
    listed = counts.where(F.col("k") >= least).toArrow()
    scratch.drop("common")
    e, k = listed.column("e").to_numpy().view(np.uint64), listed.column("k").to_numpy()
    order = np.argsort(e)
    return e[order], k[order]


def _is_in(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(values), bool)
    return sorted_list[np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)] == values


def _signatures(docs: DataFrame, n: int, t: Fraction, common, id_col: str, text_col: str) -> DataFrame:
    """id, size, digest of the set, sketch, how many elements of a thousand aren't common, prefix under the final order, counts by hash bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (last, level) = Shingler(n), common.value
        for b in pieces(batches):
            rows: list[list] = [[], [], [], [], [], [], []]
            for s in map(shingle, b.column(1).to_pylist()):
                p = prefix_length(len(s), t)
                hot = _is_in(s >> _KEY, last)
                prefix = s[:p]
                if hot[:p].any():
                    common_ones = s[hot]
                    prefix = np.concatenate([s[~hot], common_ones[np.argsort(level[np.searchsorted(last, common_ones >> _KEY)], kind="stable")]])[:p]
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                for c, v in zip(rows, (len(s), (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63, sketch(s), 1000 - 1000 * int(hot.sum()) // max(1, len(s)), prefix.view(np.int64), bin_counts(s).tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())))], names=["id", "n", "d1", "d2", "sketch", "own", "prefix", "bins"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, n long, d1 long, d2 long, sketch long, own long, prefix array<long>, bins binary")


def sketch(s: np.ndarray) -> int:
    """Equal for most pairs of similar sets and few others: the three least elements and the size class."""
    return xxhash.xxh64_intdigest(s[:3].tobytes(), int(np.log2(len(s) + 1) * 4)) - 2**63


def bin_counts(s: np.ndarray) -> np.ndarray:
    """Elements by hash bin; 255 stands for 255 or more."""
    return np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.intp), minlength=BINS), 255).astype(np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row, the most elements that sets with these bin counts can share; a full bin bounds nothing."""
    low = np.minimum(a, b)
    return np.where((low == 255).any(axis=1), np.int64(2**62), low.sum(axis=1, dtype=np.int64))


def _group_bins(nodes: DataFrame) -> DataFrame:
    """g, bins: by bin the most that a member has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            most = [np.max([np.frombuffer(x, np.uint8) for x in m], axis=0).tobytes() for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(most, pa.binary())], names=["g", "bins"])

    return nodes.groupBy("g").agg(F.collect_list("bins").alias("m")).mapInArrow(run, "g long, bins binary")


def _allowed(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """The pairs (g1, g2, overlap) whose bins allow the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (3, 4))
                keep = overlap_bound(left, right) >= b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["g1", "g2"]).filter(pa.array(keep))

    joined = pairs.join(bins.withColumnsRenamed({"g": "g1", "bins": "b1"}), "g1").join(bins.withColumnsRenamed({"g": "g2", "bins": "b2"}), "g2")
    return joined.select("g1", "g2", "overlap", "b1", "b2").mapInArrow(run, "g1 long, g2 long")


def _listed(reps: DataFrame, t: Fraction) -> DataFrame:
    """A row per prefix element that several representatives have: id, n, sketch, own, e, what its place leaves, and the element before it.

    own is how many of a thousand elements of the set aren't common.  Most elements are one representative's own.  A list of the others that is
    not too long goes to the workers, so the rest are never shuffled; a longer
    one is joined.
    """
    shared = Scratch(reps.sparkSession).write(reps.select(F.explode("prefix").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("e"), "shared")
    if not small_enough(shared, SHARED_LIST):
        rows = reps.select("id", "n", "sketch", "own", "prefix", F.posexplode("prefix").alias("pos", "e"))
        return rows.select("id", "n", "sketch", "own", "e", _rest(F.col("n"), F.col("pos"), t).alias("rest"), F.get("prefix", F.col("pos") - 1).alias("pred")).join(shared, "e").select("id", "n", "sketch", "own", "e", "rest", "pred")
    sent = reps.sparkSession.sparkContext.broadcast(np.sort(shared.toArrow().column("e").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            prefixes = b.column(4)
            size = prefixes.value_lengths().to_numpy().astype(np.int64)
            e = prefixes.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
            keep = np.flatnonzero(_is_in(e, sent.value))
            n = b.column(1).to_numpy()[row[keep]]
            before = pa.array(np.where(pos[keep] > 0, e[keep - 1], 0), mask=pos[keep] == 0)
            cols = [b.column(0).take(pa.array(row[keep])), pa.array(n), b.column(2).take(pa.array(row[keep])), b.column(3).take(pa.array(row[keep])), pa.array(e[keep]), pa.array(n * t.denominator - pos[keep] * (t.numerator + t.denominator)), before]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "sketch", "own", "e", "rest", "pred"])

    return reps.select("id", "n", "sketch", "own", "prefix").mapInArrow(run, "id long, n long, sketch long, own long, e long, rest long, pred long")


def _packs(docs: DataFrame, members: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """A row per group: ids and sets of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for b in pieces(batches):
            sets = [shingle(x).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["g", "id", "set"])

    members = F.broadcast(members) if small_enough(members, BROADCAST_MEMBERS) else members
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(members, "id").select("g", "id", "t")
    sets = texts.mapInArrow(run, "g long, id long, set binary")
    return sets.groupBy("g").agg(F.collect_list(F.struct("id", "set")).alias("m"))  # GROUP members or so, never a whole class


def compare_blocks(a: list[np.ndarray], b: list[np.ndarray], t: Fraction) -> np.ndarray:
    """Which sets of a and b reach the threshold: a boolean matrix, by sparse counting over columns of bounded width."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(a) * len(b) <= 4:
        shared = np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    else:
        flat = np.concatenate(a + b)
        owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate([na, nb]))
        _, place = np.unique(flat, return_inverse=True)
        shared, width = np.zeros((len(a), len(b)), np.float32), 1 << 14
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            i, j = np.searchsorted(place, (lo, lo + width))
            m = np.zeros((len(a) + len(b), min(width, int(place[-1]) + 1 - lo)), np.float32)
            m[owner[i:j], place[i:j] - lo] = 1
            shared += m[: len(a)] @ m[len(a) :].T
        shared = shared.astype(np.int64)
    return shared * t.denominator >= (na[:, None] + nb[None, :] - shared) * t.numerator


def _links(pairs: DataFrame, packs: DataFrame, t: Fraction) -> DataFrame:
    """Exact links inside the opened pairs of groups (g1 <= g2): a spanning forest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out: list[tuple[int, int]] = []
            for left, right in zip(b.column(0), b.column(1)):
                x, y = ([(r["id"], np.frombuffer(r["set"], np.uint64)) for r in side.as_py()] for side in (left, right if right.is_valid else left))
                ids = [i for i, _ in x] + [i for i, _ in y]
                root = {i: i for i in ids}

                def find(i: int) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in np.argwhere(compare_blocks([s for _, s in x], [s for _, s in y], t)):
                    p, q = find(x[i][0]), find(y[j][0])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((x[i][0], y[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], names=["a", "b"])

    left = packs.select(F.col("g").alias("g1"), F.col("m").alias("m1"))
    right = packs.select(F.col("g").alias("g2"), F.col("m").alias("m2"))
    same = pairs.where(F.col("g1") == F.col("g2")).join(left, "g1").select("m1", F.lit(None).cast(left.schema["m1"].dataType).alias("m2"))
    other = pairs.where(F.col("g1") != F.col("g2")).join(left, "g1").join(right, "g2").select("m1", "m2")
    return other.unionByName(same).mapInArrow(run, "a long, b long")


def _unions(members: DataFrame, *by: str) -> DataFrame:
    """The element-group matrix: for the members that hold an element in a prefix their least and greatest size, the most that its place leaves, the least own, and the element before it if that is the same one in all."""
    one = (F.count("pred") == F.count(F.lit(1))) & (F.min("pred") == F.max("pred"))
    return members.groupBy("e", *by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rest").alias("rest"), F.min("own").alias("own"), F.when(one, F.min("pred")).alias("pred"))


def _side(matrix: DataFrame, k: int) -> DataFrame:
    """The matrix with a number at the end of all names but the element's."""
    return matrix.withColumnsRenamed({c: f"{c}{k}" for c in matrix.columns if c != "e"})


def _rest(n: Column, pos: Column, t: Fraction) -> Column:
    """What the elements from a place (from 0) on can give to an overlap.

    Sets of n and m elements need (n + m) * t / (1 + t) in common.  Of the first
    element that they share at most n - pos can follow or be it, so the place
    allows a link only if this number reaches m * numerator, on both sides.
    """
    return n * t.denominator - pos * (t.numerator + t.denominator)


def _fits(t: Fraction) -> Column:
    """Whether members of the sides 1 and 2 may be close enough in size, and e the first element that they share and early enough in both."""
    num, den = F.lit(t.numerator), F.lit(t.denominator)
    near = (F.col("hi1") * den >= F.col("lo2") * num) & (F.col("hi2") * den >= F.col("lo1") * num)
    first = F.col("pred1").isNull() | F.col("pred2").isNull() | (F.col("pred1") != F.col("pred2"))
    return near & first & (F.col("rest1") >= F.col("lo2") * num) & (F.col("rest2") >= F.col("lo1") * num)


def _met(met: DataFrame, t: Fraction) -> DataFrame:
    """g1, g2 and the least overlap that a link would need, of the pairs (a row per shared element) that some element allows."""
    num, den = F.lit(t.numerator), F.lit(t.denominator)
    overlap = F.ceil(num * (F.col("lo1") + F.col("lo2")) / (num + den))
    return met.where(_fits(t)).groupBy("g1", "g2").agg(F.min(overlap).alias("overlap"))


def _members(nodes: DataFrame, opened: DataFrame) -> DataFrame:
    return nodes.join(opened.select(F.explode(F.array("g1", "g2")).alias("g")).distinct(), "g", "left_semi").select("id", "g")


@small_batches
def near_duplicate_classes(docs: DataFrame, *, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links of likeness >= threshold reach).

    Empty sets (null texts, texts without words) are linked with nothing, not
    even with each other.  Rows that share an id are one document with the links
    of all its texts, and so have one component; n_shingles is each row's own.
    A row with a null id links nothing and has a null component.  Repeated texts
    fall into one class; an empty table gives an empty result; other columns are
    not carried.
    """
    spark, t = docs.sparkSession, Fraction(threshold)
    scratch = Scratch(spark)
    common = spark.sparkContext.broadcast(_common_elements(docs, n, text_col, scratch))
    sig = scratch.write(_signatures(docs, n, t, common, id_col, text_col), "signatures")
    filled = sig.where((F.col("n") > 0) & F.col("id").isNotNull())
    sets = scratch.write(filled.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "sets")  # written, so that the join below can split a set that very many texts have
    known = scratch.write(sig.select("id", "n", "d1", "d2").join(sets, ["d1", "d2"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep")), "known")
    scratch.drop("sets")
    reps = filled.join(known.where(F.col("id") == F.col("rep")).select("id").distinct(), "id", "left_semi")
    listed = scratch.write(_listed(reps, t), "listed")

    # Groups: representatives with the same sketch, cut to bounded size by a hash of the id.
    nodes = listed.select("id", "sketch").distinct()
    parts = nodes.groupBy("sketch").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("k"))
    nodes = scratch.write(nodes.join(parts, "sketch").select("id", "sketch", F.xxhash64("sketch", F.pmod(F.xxhash64("id"), "k")).alias("g")), "groups")
    held = listed.select("e", "id", "sketch", F.col("n").alias("lo"), F.col("n").alias("hi"), "rest", "own", "pred")
    counted = reps.select("id", "sketch", "bins")

    # First only inside groups, and between the groups of a widespread element and the one of them with the least own.
    matrix = scratch.write(_unions(held.join(nodes, ["id", "sketch"]), "g"), "unions")
    spread = matrix.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("own", "g", "lo", "hi", "rest", "pred")).alias("first")).where(F.col("c") > SPREAD)
    met = _side(matrix, 2).join(spread.select("e", *[F.col(f"first.{c}").alias(f"{c}1") for c in ("g", "lo", "hi", "rest", "pred")]), "e").where(F.col("g1") != F.col("g2"))
    bins = scratch.write(_group_bins(counted.join(nodes, ["id", "sketch"])), "bins")
    within = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1).select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    opened = scratch.write(_allowed(_met(met, t), bins).unionByName(within), "opened")
    scratch.drop("unions", "bins")
    links = scratch.write(_links(opened, scratch.write(_packs(docs, _members(nodes, opened), n, id_col, text_col), "packs"), t), "links")
    scratch.drop("packs", "opened")
    if _repeats(known, "id"):
        links = links.unionByName(known.where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    classes = connected_components(links, scratch)

    # Then exactly between all groups, cut by class: parts of one class count as one for each element and don't meet.
    nodes = nodes.join(classes, "id", "left").select("id", "sketch", F.coalesce("component", "id").alias("label"), F.xxhash64("g", F.coalesce("component", "id")).alias("g"))
    nodes = scratch.write(nodes, "parts")
    matrix = scratch.write(_unions(held.join(nodes, ["id", "sketch"]), "label", "g"), "unions-2")
    scratch.drop("listed", "groups")
    whole = _unions(matrix, "label")
    both = _side(whole, 1).join(_side(whole, 2), "e").where((F.col("label1") < F.col("label2")) & _fits(t)).select("e", "label1", "label2")
    met = scratch.write(_met(both.join(_side(matrix, 1), ["e", "label1"]).join(_side(matrix, 2), ["e", "label2"]), t), "met")
    bins = scratch.write(_group_bins(counted.join(_members(nodes, met), "id")), "bins-2")
    opened = scratch.write(_allowed(met, bins), "opened-2")
    scratch.drop("signatures", "unions-2", "met", "bins-2")
    more = scratch.write(_links(opened, scratch.write(_packs(docs, _members(nodes, opened), n, id_col, text_col), "packs-2"), t), "links-2")
    scratch.drop("packs-2", "opened-2", "parts")
    classes = connected_components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "cc-2")
    scratch.drop("links", "links-2")
    out = known.join(classes.withColumnsRenamed({"id": "rep"}), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def _repeats(known: DataFrame, id_col: str) -> bool:
    """Whether some id is on several rows."""
    return not known.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).isEmpty()


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs that are the least of their class; rows with a null id stay, and so do all rows of an id that stays."""
    classes = near_duplicate_classes(docs, id_col=id_col, **options)
    later = Scratch(docs.sparkSession).write(classes.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "later")
    return without_ids(docs, later, id_col)
