"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: case, accents of look-alikes, homoglyphs, and digits
that stand for letters inside a word.  Lexicon entries are whole words or word
beginnings with a weight; exception phrases take their matches back.  The sum
of weights is normalised by length, and two fitted numbers turn it into a
score.  The lexicon and the numbers are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces

#: The most labelled rows that the lexicon is fitted on, chosen by hash.
SAMPLE_ROWS = 20_000
#: The most candidate entries that are weighed on the driver.
CANDIDATES = 1_500
#: Letters of the shortest whole word, of the shortest word beginning, and of the longest one.
SHORTEST, BEGINNING, LONGEST = 3, 4, 9
#: Different words of toxic rows that a beginning must stand for; with fewer the words themselves are entries.
BEGINNING_WORDS = 3
#: Entries that a worker counts before it hands the counts on.
HELD_ENTRIES = 100_000
#: Evidence (G statistic) that an entry must bring beyond the entries before it.
EVIDENCE = 14.0
THRESHOLD = 0.5
#: Two rows are copies if all hashes of a band agree: 0.995 of pairs of likeness 0.8, 0.48 of 0.5, 0.02 of 0.2.
BANDS, BAND_HASHES = 10, 4

# Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ρ": "p", "ν": "v", "τ": "t", "κ": "k", "υ": "u"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))

_FOLD = str.maketrans(HOMOGLYPHS) | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | INVISIBLE
_SWAP = str.maketrans(SUBSTITUTES)
_RUN = re.compile(r"[^\W_]+(?:[0-9@$!]+[^\W_]+)*")
_MIXED = re.compile(r"[0-9@$!]")
_LETTERS = re.compile(r"[^\W\d_]+")


def folded_words(text: str | None) -> list[str]:
    """Words in small letters, homoglyphs and digit substitutions undone; a number stays out."""
    out = []
    for run in _RUN.findall((text or "").lower().translate(_FOLD)):
        if _MIXED.search(run):
            if not _LETTERS.search(run):
                continue
            run = run.translate(_SWAP)
            out += _LETTERS.findall(run)
        else:
            out.append(run)
    return out


@dataclass
class Lexicon:
    """Weights by entry: ' word' starts a word, ' word ' is one.  exceptions: phrases in which entries don't count."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    bias: float = -2.0
    slope: float = 1.0

    def matcher(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (k, w))
        for p in self.exceptions:
            phrase = f" {' '.join(folded_words(p))} "
            a.add_word(phrase, (phrase, None))
        a.make_automaton()
        return a if len(a) else None

    def weigh(self, words: list[str], matcher: ahocorasick.Automaton | None) -> float:
        """Weights of the matches over a length norm: a match weighs less the longer the text, but never nothing."""
        if matcher is None or not words:
            return 0.0
        text = f" {' '.join(words)} "
        hits, spared = [], []
        for end, (k, w) in matcher.iter(text):
            start = end - len(k) + 1
            spared.append((start, end)) if w is None else hits.append((start, w))
        spared.sort()
        starts, reach = [a for a, _ in spared], []  # reach: where the farthest of the phrases so far ends
        for _, end in spared:
            reach.append(max(end, reach[-1]) if reach else end)
        best: dict[int, float] = {}
        for start, w in hits:
            i = bisect_right(starts, start) - 1
            if i < 0 or reach[i] <= start:
                best[start] = max(w, best.get(start, 0.0))
        return sum(best.values()) / (1.0 + math.log1p(len(words) / 1000.0))

    def score(self, text: str | None, matcher: ahocorasick.Automaton | None) -> float:
        z = self.bias + self.slope * math.log1p(self.weigh(folded_words(text), matcher))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def entries_of(words: list[str]) -> set[str]:
    found = set()
    for w in set(words):
        if len(w) >= SHORTEST:
            found.update(f" {w[:k]}" for k in range(BEGINNING, min(len(w), LONGEST) + 1))
            found.add(f" {w} ")
    return found


def _g(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Signed evidence that a of na against b of nb differ; negative where a is the rarer."""
    p = (a + b) / max(na + nb, 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / np.maximum(na * p, 1e-12)), 0) + np.where(b > 0, b * np.log(b / np.maximum(nb * p, 1e-12)), 0))
    return np.where(a * nb > b * na, g, -g)


_TURN = np.random.default_rng(17).integers(0, 2**63, BANDS * BAND_HASHES, dtype=np.uint64) | np.uint64(1)


def _bands(words: list[str]) -> list[int]:
    """A key for each band of least hashes of the three-word runs; near copies share one."""
    runs = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
    hashed = np.fromiter({xxhash.xxh64_intdigest(" ".join(r)) for r in runs}, np.uint64)
    least = np.array([(hashed * t).min() for t in _TURN], np.uint64)
    return [xxhash.xxh64_intdigest(band.tobytes()) >> 1 for band in least.reshape(BANDS, BAND_HASHES)]


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """_y, _text: rows that share no band with a row of their class and of a lesser digest (_d)."""
    banded = rows.select("_y", "_d", F.posexplode("bands").alias("band", "key"))
    first = banded.groupBy("_y", "band", "key").agg(F.min("_d").alias("first"))
    copies = banded.join(first, ["_y", "band", "key"]).where(F.col("first") < F.col("_d")).select("_y", "_d").distinct()
    return rows.join(copies, ["_y", "_d"], "left_anti").select("_y", "_text")


def _beginnings(sample: DataFrame) -> DataFrame:
    """start, n, least, last: of each word beginning the different words of toxic rows, and the first and last in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = {w for t in b.column(1).to_pylist() for w in folded_words(t) if len(w) >= BEGINNING}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    words = sample.where("_y = 1").mapInArrow(run, "word string").distinct()
    lengths = F.sequence(F.lit(BEGINNING), F.least(F.length("word"), F.lit(LONGEST)))
    starts = words.select("word", F.explode(F.transform(lengths, lambda k: F.concat(F.lit(" "), F.col("word").substr(F.lit(1), k)))).alias("start"))
    return starts.groupBy("start").agg(F.count("*").alias("n"), F.min("word").alias("least"), F.max("word").alias("last"))


def _count(sample: DataFrame, of: Callable[[list[str]], set[str]]) -> DataFrame:
    """entry, a, b: rows of each class that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def counts() -> pa.RecordBatch:
            names = list(toxic.keys() | clean.keys())
            found = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([clean[k] for k in names], pa.int64())], names=["entry", "a", "b"])
            toxic.clear()
            clean.clear()
            return found

        for b in pieces(batches):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if y == 1 else clean).update(of(folded_words(t)))
            if len(toxic) + len(clean) > HELD_ENTRIES:
                yield counts()
        yield counts()

    return sample.mapInArrow(run, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _harmless(sample: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Phrases of a matched word and a neighbour that no toxic row and three clean rows at least hold.

    The word's share of clean rows must make so many clean rows of the phrase
    unlikely, by the same evidence that an entry must bring.
    """

    def phrases(words: list[str]) -> set[str]:
        found, hit = set(), {w for w in set(words) if not weights.keys().isdisjoint(entries_of([w]))}
        if hit:
            found.update(f"{w}\t{w}" for w in hit)
            for v, w in zip(words, words[1:]):
                found.update(f"{x}\t{v} {w}" for x in {v, w} & hit)
        return found

    parts = F.split("entry", "\t")
    n = _count(sample, phrases).select(parts[0].alias("word"), parts[1].alias("phrase"), "a", "b")
    whole = n.where(F.col("phrase") == F.col("word")).select("word", F.col("a").alias("wa"), F.col("b").alias("wb"))
    clean = n.where((F.col("phrase") != F.col("word")) & (F.col("a") == 0) & (F.col("b") >= 3)).join(whole, "word")
    clean = clean.where(2 * F.col("b") * F.log((F.col("wa") + F.col("wb")) / F.col("wb")) >= EVIDENCE)
    best = clean.groupBy("phrase").agg(F.max("b").alias("b")).orderBy(F.desc("b"), "phrase").limit(CANDIDATES)
    return tuple(r["phrase"] for r in best.collect())


def fit(docs: DataFrame, labels: DataFrame, *, exceptions: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn a lexicon from at most ``sample_rows`` labelled rows (those of the least id hashes).

    Near copies count once: a row goes if it shares a band of hashes with a row
    of its class.  A word beginning stands for BEGINNING_WORDS different words
    and is the longest that they share.  Phrases in which an entry is harmless are learned
    too and join ``exceptions``.  Rows with a null id, label or text are left out.
    An id with several labels is toxic if one of them says so; repeated rows
    count once; texts are taken whole.  Without rows of both classes the lexicon
    is empty.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y")).orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id").where(F.col("_text").isNotNull()).select("_y", "_text")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            keys = [_bands(folded_words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["_y", "_text", "bands"])

    scratch = Scratch(docs.sparkSession)
    distinct = rows.withColumn("_d", F.xxhash64("_text")).groupBy("_d", "_y").agg(F.min("_text").alias("_text"))
    drawn = scratch.write(distinct.select("_y", "_text").mapInArrow(banded, "_y int, _text string, bands array<long>").withColumn("_d", F.xxhash64("_text")), "drawn")
    sample = scratch.write(_one_of_copies(drawn), "sample")
    scratch.drop("drawn")
    sizes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    na, nb = sizes.get(1, 0), sizes.get(0, 0)
    if not na or not nb:
        scratch.drop("sample")
        return Lexicon(exceptions=exceptions)

    counted = _count(sample, entries_of)
    # Three toxic rows at least, and at least four times as frequent among them as among the others.
    strong = counted.where((F.col("a") >= 3) & (F.col("a") * nb >= 4.0 * F.col("b") * na))
    strong = strong.withColumn("g", F.col("a") * F.log((F.col("a") / na) / ((F.col("a") + F.col("b")) / (na + nb))))
    strong = strong.join(_beginnings(sample), F.col("entry") == F.col("start"), "left")
    letters = F.length("entry")  # the space and the beginning; so many letters of a word are one more than the beginning
    longest = (letters == LONGEST + 1) | (F.col("least").substr(F.lit(1), letters) != F.col("last").substr(F.lit(1), letters))
    strong = strong.where(F.col("entry").endswith(" ") | ((F.col("n") >= BEGINNING_WORDS) & longest))
    names = [r["entry"] for r in strong.orderBy(F.desc("g"), F.length("entry"), "entry").limit(CANDIDATES).collect()]
    if not names:
        scratch.drop("sample")
        return Lexicon(exceptions=exceptions)
    place = {k: i for i, k in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = [folded_words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(place[e] for e in entries_of(w) if e in place) for w in words], pa.list_(pa.int32()))], names=["y", "n", "found"])

    got = sample.mapInArrow(present, "y int, n long, found array<int>").collect()  # at most sample_rows short rows
    got.sort(key=lambda r: (r["y"], r["n"], r["found"]))  # sums of floats then don't depend on the order of tasks
    y = np.array([r["y"] for r in got])
    has = np.zeros((len(got), len(names)), dtype=bool)
    for i, r in enumerate(got):
        has[i, r["found"]] = True
    kept = _select(has, y, names)
    weights = {names[j]: float(w) for j, w in kept}
    lexicon = Lexicon(weights, exceptions + (_harmless(sample, weights) if weights else ()))
    scratch.drop("sample")
    norm = 1.0 + np.log1p(np.array([r["n"] for r in got]) / 1000.0)
    x = np.log1p(sum((has[:, j] * w for j, w in kept), np.zeros(len(got))) / norm)
    lexicon.bias, lexicon.slope = _logistic(x, y)
    return lexicon


def _select(has: np.ndarray, y: np.ndarray, names: list[str]) -> list[tuple[int, float]]:
    """Entries by the evidence that each adds: rows that an entry explains count for a fifth afterwards."""
    pos, neg = has[y == 1].astype(np.float32), has[y == 0].astype(np.float32)
    wp = np.ones(len(pos), np.float32)
    b = neg.sum(0)
    out, closed = [], np.zeros(len(names), bool)
    full = pos.sum(0)
    for _ in range(len(names)):
        a = wp @ pos
        g = np.where(closed, -1.0, _g(a, b, float(wp.sum()), float(len(neg))))
        top = float(g.max())
        if top < EVIDENCE:
            break
        near = np.flatnonzero(g >= 0.97 * top)  # of about equal entries a whole word, else the longest beginning
        j = int(min(near, key=lambda k: (not names[k].endswith(" "), -len(names[k]), names[k])))
        out.append((j, math.log(((full[j] + 0.5) / (len(pos) + 1)) / ((b[j] + 0.5) / (len(neg) + 1)))))
        wp[pos[:, j] > 0] *= 0.2
        closed |= np.array([n == names[j] if names[j].endswith(" ") else n.startswith(names[j]) for n in names])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's method, slightly regularised; the slope isn't negative."""
    w = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), max(0.0, float(w[1]))


def score_texts(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score.  Null and empty texts get the score of a text without matches; repeated rows score alike; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(t, matcher) for t in b.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id counts as held out."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: doc_id, held_out, score, predicted, learned from the labels that aren't held out.

    Null and empty texts have the score of a text without matches; rows with a
    null id count as held out; repeated rows score alike; an empty table gives no
    rows, and without labels nothing is predicted toxic.
    """
    lexicon = fit(docs, labels.where(~held_out()))
    scored = score_texts(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; columns as they are.

    Null and empty texts stay unless every text would go; repeated rows go or
    stay alike; an empty table stays empty.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for b in pieces(batches):
            yield b.filter(pa.array([lexicon.score(t, matcher) < THRESHOLD for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
