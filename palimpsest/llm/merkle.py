"""A Merkle manifest of a data set: one root, and a proof of membership for every row.

Rows are leaves, in a tree for each group; the roots of the groups give the
root.  The trees are grown by combineByKey over indexed child digests: a partial
parent gathers children until it has as many as the sizes of the tree ask for,
then it becomes a digest itself, an event for its own parent.  What stays open
in a task travels to the others of its block and is completed there; the tops of
the blocks are the leaves of the next round.  Links from children to their
parents, kept from every round, give the proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, Scratch

FAN = 8
#: Levels that a round of combineByKey grows: a block has FAN ** LEVELS leaves.
LEVELS = 4
#: Rows of a range by which leaves are put in order.
RANGE_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as UTF-8 byte count, colon, value; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest_of(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode("ascii")).hexdigest()


class Frontier:
    """Part of a block's tree: parents that are complete, and open ones with the children that have come so far.

    Levels count from the round's leaves (0); ``size`` is the number of nodes of
    the whole group at level 0, so a parent's arity follows from its place.
    """

    __slots__ = ("size", "levels", "done", "open")

    def __init__(self, size: int, levels: int = LEVELS):
        self.size, self.levels, self.done, self.open = size, levels, {}, {}

    def _width(self, level: int) -> int:
        return -(-self.size // FAN**level)

    def add(self, level: int, index: int, digest: str) -> "Frontier":
        """An event: a digest is known.  Parents that it completes are events in turn."""
        while level < self.levels and self._width(level) > 1:
            parent = (level + 1, index // FAN)
            children = self.open.setdefault(parent, {})
            children[index % FAN] = digest
            if len(children) < min(FAN, self._width(level) - parent[1] * FAN):
                break
            del self.open[parent]
            self.done[parent] = [children[k] for k in range(len(children))]
            level, index, digest = level + 1, index // FAN, digest_of(self.done[parent])
        return self

    def merge(self, other: "Frontier") -> "Frontier":
        self.done.update(other.done)
        for (level, parent), children in sorted(other.open.items()):
            for k, digest in children.items():
                self.add(level - 1, parent * FAN + k, digest)
        return self

    def links(self) -> Iterator[tuple]:
        """For each lowest parent: its index, its children, the siblings on the way to the top of the block, the top's index and digest."""
        if self.open:
            raise ValueError("a block of the tree lacks leaves")
        top = max(level for level, _ in self.done)
        up = {key: digest_of(children) for key, children in self.done.items()}
        for (level, parent), children in self.done.items():
            if level > 1:
                continue
            path, at = [], parent
            for k in range(2, top + 1):
                among, place = self.done[(k, at // FAN)], at % FAN
                path.append(("".join(among[:place]), "".join(among[place + 1 :])))
                at //= FAN
            yield parent, children, path, at, up[(top, at)]


LINKS = "tree int, parent long, children array<string>, path array<struct<l string, r string>>, top long, digest string, size long"


def grow(events: DataFrame, parts: int, levels: int = LEVELS) -> DataFrame:
    """One round.  events: tree, index, digest, size (of the tree at this level, over 1).  The links of each lowest parent."""
    block = FAN**levels
    keyed = events.select("tree", "index", "digest", "size").rdd.map(lambda r: ((r[0], r[1] // block), (r[3], r[1], r[2])))
    grown = keyed.combineByKey(lambda v: Frontier(v[0], levels).add(0, *v[1:]), lambda f, v: f.add(0, *v[1:]), Frontier.merge, numPartitions=parts)
    rows = grown.flatMap(lambda kf: [(kf[0][0], *link, kf[1].size) for link in kf[1].links()])
    return events.sparkSession.createDataFrame(rows, LINKS, verifySchema=False)


def numbered(leaves: DataFrame, scratch: Scratch, order: list[Column]) -> DataFrame:
    """leaves (tree, ...) with index (place in the tree by ``order``) and size (leaves of the tree).

    Rows are put in ranges of (tree, order), and the ranges' counts added up,
    so no task sees all rows of a tree.
    """
    n = max(1, -(-leaves.count() // RANGE_ROWS), min(64, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = leaves.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.write(dealt.withColumn("part", F.shiftright("row", 33)), "ordered")
    counts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    by_tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(by_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("tree", "part", "first", before.alias("before"), F.sum("n").over(by_tree).alias("size"))
    return rows.join(F.broadcast(places), ["tree", "part"]).withColumn("index", F.col("before") + F.col("row") - F.col("first")).drop("part", "row", "before", "first")


class Forest:
    """The grown trees of numbered leaves (tree, index, size, digest), with links back from every node.

    ``roots``: tree, subroot.  ``paths``: tree, parent (index // FAN of a leaf),
    children, path (left and right siblings on each level above, up to the
    tree's root); trees of one leaf have no row there.
    """

    def __init__(self, leaves: DataFrame, scratch: Scratch, parts: int, levels: int = LEVELS):
        rounds, events, tops = [], leaves.select("tree", "index", "digest", "size"), []
        while True:
            tops.append(events.where(F.col("size") == 1).select("tree", F.col("digest").alias("subroot")))
            more = events.where(F.col("size") > 1)
            links = scratch.write(grow(more, parts, levels), f"links-{len(rounds)}")
            rounds.append(links)
            block = FAN ** (levels - 1)
            events = links.where(F.col("parent") % block == 0).select("tree", F.col("top").alias("index"), "digest", F.ceil(F.col("size") / F.lit(FAN**levels)).cast("long").alias("size"))
            if events.where(F.col("size") > 1).isEmpty():
                tops.append(events.select("tree", F.col("digest").alias("subroot")))
                break
        self.roots = tops[0]
        for t in tops[1:]:
            self.roots = self.roots.unionByName(t)
        above = None
        for links in reversed(rounds):
            own = links.select("tree", "parent", "children", "path", "top")
            if above is None:
                self.paths = own.drop("top")
            else:
                up = above.select("tree", F.col("parent").alias("up"), F.col("children").alias("among"), F.col("path").alias("rest"))
                joined = own.withColumn("up", F.floor(F.col("top") / FAN).cast("long")).join(up, ["tree", "up"], "left")
                step = F.array(around(F.col("among"), F.col("top")))
                self.paths = joined.select("tree", "parent", "children", F.when(F.col("among").isNull(), F.col("path")).otherwise(F.concat("path", step, "rest")).alias("path"))
            above = self.paths


def around(among: Column, index: Column) -> Column:
    """The siblings before and after a node among the children of its parent, joined."""
    place = (index % FAN).cast("int")
    left = F.array_join(F.slice(among, F.lit(1), place), "")
    right = F.array_join(F.slice(among, place + 2, F.lit(FAN)), "")
    return F.struct(left.alias("l"), right.alias("r"))


def climb(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, digest, lambda acc, step: F.sha2(F.concat(step["l"], acc, step["r"]), 256))


def merkle_manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, when: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Every row's leaf, its group's subroot, the root, the path of siblings and the root that the row as it is now gives.

    Columns: id, leaf, subroot, root, path (left and right siblings by level),
    now_leaf, now_root.  ``tampered`` names columns and what they hold
    now, for the rows ``when`` chooses (by default as they were).  Groups are ordered by
    UTF-8 bytes with null first, leaves by id with null first, rows that
    share an id by their digests; equal rows are leaves of their own.  An empty
    table gives no rows.  Groups are a catalogue: every proof holds the subroots of
    all others, as the one root above them asks.
    """
    scratch = Scratch(docs.sparkSession)
    now = {**{f: F.col(f) for f in fields}, **(tampered or {})}
    leaf = leaf_digest([F.col(f) for f in fields])
    changed = F.when(F.coalesce(when, F.lit(False)), leaf_digest([now[f] for f in fields])) if tampered and when is not None else F.lit(None).cast("string")
    leaves = scratch.write(docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"), leaf.alias("digest"), changed.alias("now")).withColumn("uid", F.monotonically_increasing_id()), "leaves")
    trees = leaves.select("grp").distinct().withColumn("tree", F.row_number().over(W.orderBy(F.col("grp").cast("binary").asc_nulls_first())))
    trees = scratch.write(trees, "trees")
    known = leaves.join(F.broadcast(trees), leaves["grp"].eqNullSafe(trees["grp"])).select("tree", "id", "digest", "now", "uid")
    rows = numbered(known, scratch, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("now"), F.col("uid")])
    rows = scratch.write(rows.drop("uid"), "numbered")
    scratch.drop("leaves", "ordered")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    forest = Forest(rows, scratch, parts, levels)
    return _proofs(rows, forest, scratch, id_col)


def _proofs(rows: DataFrame, forest: Forest, scratch: Scratch, id_col: str) -> DataFrame:
    roots = scratch.write(forest.roots, "roots")
    whole = W.orderBy("tree").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row for each group
    tops = roots.select("tree", "subroot", F.collect_list("subroot").over(whole).alias("among"), F.row_number().over(W.orderBy("tree")).alias("place"))
    last = F.struct(F.array_join(F.slice("among", F.lit(1), F.col("place") - 1), "").alias("l"), F.array_join(F.slice("among", F.col("place") + 1, F.size("among")), "").alias("r"))
    tops = scratch.write(tops.select("tree", "subroot", F.sha2(F.array_join("among", ""), 256).alias("root"), F.array(last).alias("last")), "tops")
    paths = forest.paths.withColumnsRenamed({"path": "rest"})
    joined = rows.withColumn("parent", F.floor(F.col("index") / FAN).cast("long")).join(paths, ["tree", "parent"], "left").join(F.broadcast(tops), "tree")
    own = F.when(F.col("children").isNull(), F.col("last")).otherwise(F.concat(F.array(around(F.col("children"), F.col("index"))), "rest", "last"))
    out = joined.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", own.alias("path"), F.coalesce("now", "digest").alias("now_leaf"))
    return out.withColumn("now_root", climb(F.col("path"), F.col("now_leaf")))


def tampered_by(id_col: str = "doc_id") -> Column:
    """Where 3 divides the CRC-32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0


def merkle_proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The contract's query: leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Nulls are dashes, a null text stays so when tampered with, a null id is never
    tampered with; ties, repeated rows and the empty table are as in merkle_manifest;
    other columns are not carried.
    """
    lower = {"text": F.translate("text", UPPER, LOWER)}
    made = merkle_manifest(docs, tampered=lower, when=tampered_by(), levels=levels)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), F.col("now_root").alias("folded_root"), (F.col("now_root") == F.col("root")).alias("verified"))
