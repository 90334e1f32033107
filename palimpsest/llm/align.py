"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in the corpus.

A transducer reads the tokens of both sides.  Its state is which side leads and
the bytes of its last token that the other side has not matched: the side behind
always reads next, and when nothing is left over a group closes.  Transitions
are memoised by residual and next token.  A text is cut where neither tokenizer
can merge, in front of white space, and pieces that come again keep their groups.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_encoder, tokenizer_path
from .common import Scratch, pieces

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
#: Transitions and pieces of text that a worker keeps; both are shortcuts only.
TRANSITIONS, CHUNKS = 1_000_000, 400_000
#: Pairs whose counts every worker holds; the counts of all others are joined.
HOT_PAIRS = 1 << 16
#: Pieces start at white space (of both tokenizers' kind) after anything else, and, if no token holds both, at a mark after a letter.
_SPACE, _OTHER, _LETTER, _MARKS = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]", "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"
_CHUNK = re.compile(f"{_SPACE}+{_OTHER}*")
_FINE_CHUNK = re.compile(f"{_SPACE}+(?:{_LETTER}+(?={_MARKS})|{_OTHER}*)|{_OTHER}+")


class PieceEncoder:
    """Ids and bytes of a SentencePiece BPE model that keeps the text as it is and adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.vocab_size())
        names = [self.library.id_to_piece(i) for i in ids]
        self.bytes = {i: bytes([int(names[i][3:5], 16)]) if self.library.is_byte(i) else names[i].replace(MARK, " ").encode() for i in ids}
        plain = [names[i] for i in ids if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i))]
        longer = "".join(p for p in plain if len(p) > 1)
        probe = "  ａ é  x "
        #: White space in front of which texts may be cut, since no piece has it inside; none if the model changes texts.
        sound = all(MARK not in p.lstrip(MARK) for p in plain) and self.library.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.cuts = " " + "".join(c for c in "\n\t\r" if c not in longer) if sound and "\n" not in longer else ""
        #: Whether texts may be cut between a letter and a mark as well.
        self.fine = bool(self.cuts) and not any(re.search(_LETTER + _MARKS, p) for p in plain)

    def encode(self, wholes: list[str]) -> list[list[int]]:
        """Ids of space + text, whole."""
        return self.library.encode([w[1:] for w in wholes], num_threads=1)

    def encode_pieces(self, parts: list[str]) -> list[list[int]]:
        """Ids of pieces as they stand inside a text: each is put after a line break, which never merges."""
        head = len(self.library.encode("\n", num_threads=1))
        return [ids[head:] for ids in self.library.encode(["\n" + p for p in parts], num_threads=1)]


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class SuffixTransducer:
    """Groups and links of two token sequences over the same bytes.

    A state is (whether B leads, the leader's bytes that are not matched yet);
    it belongs to one token, since the side behind reads until it has caught up.
    """

    def __init__(self, bytes_a: dict[int, bytes], bytes_b: dict[int, bytes], limit: int = TRANSITIONS):
        self.bytes, self.limit = (bytes_a, bytes_b), limit
        self.moves: dict[tuple, tuple | None] = {}

    def step(self, state: tuple[int, bytes], token: int) -> tuple[int, bytes] | None:
        """The state after the side behind has read a token; None if its bytes are others."""
        key = (state, token)
        if key in self.moves:
            return self.moves[key]
        lead, residual = state
        got = self.bytes[1 - lead].get(token)
        if got is None or not (residual.startswith(got) or got.startswith(residual)):
            after = None
        elif len(got) <= len(residual):
            after = (lead, residual[len(got) :])
        else:
            after = (1 - lead, got[len(residual) :])
        if len(self.moves) >= self.limit:
            self.moves.clear()
        self.moves[key] = after
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """The ends of the groups in a and in b, and the linked pairs in order; None if the bytes are not the same."""
        moves, starts = self.moves, self.bytes[0]
        groups, links = [], []
        i, j, n_a, n_b = 0, 0, len(a), len(b)
        while i < n_a:
            x, i = a[i], i + 1
            state = (0, starts.get(x, b""))
            while state[1]:
                if state[0]:
                    if i == n_a:
                        return None
                    x = token = a[i]
                    i += 1
                else:
                    if j == n_b:
                        return None
                    y = token = b[j]
                    j += 1
                links.append((x, y))
                key = (state, token)
                state = moves[key] if key in moves else self.step(state, token)
                if state is None:
                    return None
            groups.append((i, j))
        return (groups, links) if j == n_b else None


def group_text(a: list[int], b: list[int], groups: list[tuple[int, int]]) -> str:
    x, y = [str(i) for i in a], [str(i) for i in b]
    out, i, j = [], 0, 0
    for m, n in groups:
        out.append(f"{x[i]}|{y[j]}" if m - i == n - j == 1 else ",".join(x[i:m]) + "|" + ",".join(y[j:n]))
        i, j = m, n
    return ";".join(out)


class CorpusAligner:
    """Aligned texts of a worker, batch by batch.  Pieces of text that come again are looked up."""

    def __init__(self, path_a: str, path_b: str, limit: int = CHUNKS):
        self.a, self.b, self.limit = byte_encoder(path_a), piece_encoder(path_b), limit
        self.transducer = SuffixTransducer(self.a.bytes, self.b.bytes)
        self.cut = bool(self.b.cuts and self.a.fast)
        self._clear()

    def _clear(self, keep: list[int] | None = None) -> None:
        """Forget all pieces but those of the given numbers."""
        old = (self.known, self.counts, self.texts, self.pairs, self.starts) if keep else None
        self.known, self.counts, self.texts, self.pairs, self.starts = {}, array("q"), [], array("q"), array("q", [0])
        if old:
            named = dict(zip(old[0].values(), old[0]))
            for i in keep:
                self._put(named[i], old[1][3 * i : 3 * i + 3], old[2][i], old[3][old[4][i] : old[4][i + 1]])
        self.seen = np.zeros(len(self.texts), np.int64)

    def _put(self, chunk: str, counts, text: str | None, pairs) -> None:
        self.known[chunk] = len(self.texts)
        self.counts.extend(counts)
        self.texts.append(text)
        self.pairs.extend(pairs)
        self.starts.append(len(self.pairs))

    def _cut(self, text: str) -> list[str]:
        """The pieces of space + text, each with its leading space or line break."""
        whole = " " + text
        if not self.cut:
            return [whole]
        parts, cuts = (_FINE_CHUNK if self.b.fine else _CHUNK).findall(whole), self.b.cuts
        if any(p[0] not in cuts and p[0].isspace() for p in parts):
            joined: list[str] = []
            for p in parts:
                if p[0] in cuts or not p[0].isspace() or not joined:
                    joined.append(p)
                else:
                    joined[-1] += p
            return joined
        return parts

    def _learn(self, chunks: list[str]) -> None:
        """Encodes, aligns and keeps pieces that are not known yet."""
        ids_a = self.a.plain_ids(chunks)
        bytes_a = self.a.bytes.__getitem__
        ids_b = self.b.encode_pieces(chunks) if self.cut else self.b.encode(chunks)
        for c, a, b in zip(chunks, ids_a, ids_b):
            got = self.transducer.align(a, b) if b"".join(map(bytes_a, a)) == c.encode("utf-8", "surrogatepass") else None
            if got is None:
                self._put(c, (0, 0, 0), None, ())
            else:
                self._put(c, (len(a), len(b), len(got[0])), group_text(a, b, got[0]), [x << 32 | y for x, y in got[1]])

    def batch(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each text; pairs are A's id << 32 | B's."""
        if len(self.texts) > self.limit:
            often = np.flatnonzero(self.seen > 1)
            self._clear(often[: self.limit // 2].tolist())
        cut = [self._cut(t) if t else [] for t in texts]
        fresh = list({c: None for parts in cut for c in parts if c not in self.known})
        if fresh:
            self._learn(fresh)
        numbers = [np.array([self.known[c] for c in parts], dtype=np.int64) for parts in cut]
        self.seen = np.concatenate([self.seen, np.zeros(len(self.texts) - len(self.seen), np.int64)])
        counts = np.frombuffer(self.counts, np.int64).reshape(-1, 3) if self.texts else np.zeros((0, 3), np.int64)
        starts, pairs = np.frombuffer(self.starts, np.int64), np.frombuffer(self.pairs, np.int64)
        for own in numbers:
            self.seen[own] += 1
            words = [self.texts[i] for i in own.tolist()]
            if not words or None in words:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            n_a, n_b, n_groups = counts[own].sum(axis=0).tolist()
            sizes = starts[own + 1] - starts[own]
            ends = np.cumsum(sizes)
            linked = pairs[np.repeat(starts[own] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
            distinct, times = np.unique(linked, return_counts=True)
            yield n_a, n_b, n_groups, len(linked), hashlib.sha256(";".join(words).encode("ascii")).hexdigest(), distinct, times
        del counts, starts, pairs


@functools.lru_cache(maxsize=1)
def corpus_aligner(path_a: str, path_b: str) -> CorpusAligner:
    """One for each Python worker, which serves many tasks."""
    return CorpusAligner(path_a, path_b)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = corpus_aligner(tokenizer_path(tokenizer_a), tokenizer_path(tokenizer_b))
        for b in pieces(batches):
            if not b.num_rows:
                continue
            got = list(zip(*aligner.batch(b.column(2).to_pylist())))
            numbers = [pa.array(list(x), pa.int64()) for x in got[:4]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers, pa.array(list(got[4]), pa.string()), _lists(list(got[5])), _lists(list(got[6]))], names=["row", id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).select(F.monotonically_increasing_id().alias("row"), id_col, "text")
    return rows.mapInArrow(run, f"row long, `{id_col}` {kind}, {ALIGNED}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links of the corpus that hold it), best (whether no pair of its B id has more).  At most one row for each B id is broadcast."""
    counts = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("b", b)


def with_best(counts: DataFrame) -> DataFrame:
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _cutoff(counts: DataFrame, limit: int) -> int:
    """The least count such that no more than ``limit`` pairs, or so, have at least that; from a histogram of a few hundred rows."""
    step = F.floor(F.log2("n") * 16).cast("long")
    bins = sorted(((r["k"], r["m"], r["least"]) for r in counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, m, low in bins:
        if total + m > limit:
            break
        total, least = total + m, low
    return least


def cross_tokenizer(docs: DataFrame, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B, *, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens give other bytes than a space
    and the text, have zeros and an empty digest.  Repeated rows and ids each have
    a row and count each; an empty table gives no rows; other columns are not carried.

    Every link looks up its pair's count in the whole corpus.  The pairs with
    the highest counts, ``hot_pairs`` at most, go to every worker and settle most
    links; the others are joined by pair, so no key of that join is frequent.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(aligned(docs, tokenizer_a, tokenizer_b, id_col=id_col, text_col=text_col), "aligned")
    counts = scratch.write(with_best(scratch.write(pair_counts(rows), "counts")), "pairs")
    scratch.drop("counts")
    hot = counts.where(F.col("n") >= _cutoff(counts, hot_pairs)).orderBy("pair").toArrow()
    held = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))
    settled = scratch.write(rows.mapInArrow(_settle(held), f"{rows.drop('pairs', 'times').schema.simpleString()[7:-1].replace(f'{id_col}:', f'`{id_col}`:')}, hot_best long, hot_sum long, pairs array<long>, times array<long>"), "settled")
    scratch.drop("aligned")
    rest = settled.where(F.size("pairs") > 0).select("row", F.inline(F.arrays_zip("pairs", "times")))
    rest = rest.join(counts.withColumnRenamed("pair", "pairs"), "pairs").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("n") * F.col("times")).alias("sum"))
    out = settled.drop("pairs", "times").join(rest, "row", "left")
    return out.select(
        id_col, "n_a", "n_b", "n_groups", "n_links", (F.col("hot_best") + F.coalesce("best", F.lit(0))).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )


def _settle(held):
    """For mapInArrow: links of hot pairs are summed, the other pairs stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for b in pieces(batches):
            if not b.num_rows:
                continue
            pairs, times = (b.column(c) for c in ("pairs", "times"))
            sizes = np.diff(pairs.offsets.to_numpy())
            own, count = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            doc = np.repeat(np.arange(b.num_rows), sizes)
            place = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hit = pair[place] == own if len(pair) else np.zeros(len(own), bool)
            total, good = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(total, doc[hit], n[place[hit]] * count[hit])
            np.add.at(good, doc[hit], best[place[hit]] * count[hit])
            left = np.bincount(doc[~hit], minlength=b.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (own, count)]
            keep = [b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(good), pa.array(total), *rest], names=[*b.schema.names[:-2], "hot_best", "hot_sum", "pairs", "times"])

    return run
