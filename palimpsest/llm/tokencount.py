"""Token counts with a whole-token shortcut.

A SentencePiece BPE without inner word marks never merges over the start of a
word, nor over a character that no longer piece holds.  So a text falls apart
into pre-tokens that are encoded alone.  Once per worker, every piece of the
vocabulary is encoded as such a pre-token; those that give one token are counted
by a look-up, and only the rest is merged by the library, each distinct one once
as long as a bounded cache holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE = 400_000
MARK = "▁"


class PieceCounter:
    """Counts like SentencePieceProcessor.encode, for identity-normalised BPE models with a dummy prefix."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.encoder.id_to_piece(i) for i in range(self.encoder.vocab_size()) if not (self.encoder.is_control(i) or self.encoder.is_byte(i) or self.encoder.is_unknown(i))]
        self.splits = self._words_split(pieces)
        longer = "".join(p for p in pieces if len(p) > 1)
        self.breaks = [c for c in "\n\t\r" if c not in longer]
        stop = re.escape("".join([MARK, *self.breaks]))
        self.parts = re.compile(f"{MARK}+[^{stop}]*" + (f"|[{re.escape(''.join(self.breaks))}][^{stop}]*" if self.breaks else ""))
        self.cache_size, self.cache = cache, {}
        self.whole = {}
        if self.splits:
            alone = [p for p in pieces if p[0] == MARK and p != MARK and not set(p) & set(self.breaks)]
            got = self.encoder.encode([p.replace(MARK, " ")[1:] for p in alone], num_threads=1)
            self.whole = {p: 1 for p, ids in zip(alone, got) if len(ids) == 1} | {MARK: 1}

    def _words_split(self, pieces: list[str]) -> bool:
        """Whether pre-tokens are sound for this model: no inner mark, text kept as it is, a dummy prefix."""
        probe = "  ａ é  x "
        return all(MARK not in p.lstrip(MARK) for p in pieces) and self.encoder.normalize(probe) == MARK + probe.replace(" ", MARK)

    def _merged(self, part: str) -> int:
        if part[0] == MARK:
            return len(self.encoder.encode(part.replace(MARK, " ")[1:], num_threads=1))
        return len(self.encoder.encode(part, num_threads=1)) - 1  # without the dummy prefix, which a break keeps apart

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.encoder.encode(text, num_threads=1))
        parts = self.parts.findall(MARK + text.replace(" ", MARK))
        whole, cache = self.whole, self.cache
        total = 0
        for p in parts:
            n = whole.get(p) or cache.get(p)
            if n is None:
                n = self._merged(p)
                if len(cache) >= self.cache_size:
                    cache.clear()
                if len(p) <= 64:
                    cache[p] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model: str = MODEL, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit.

    ``model`` is a name that public_tokenizers knows, or a path on every
    worker.  Null texts count as empty (0 tokens), repeated rows are counted
    alike, an empty table stays empty, other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        counter = PieceCounter(model if os.path.isabs(model) else public_tokenizers.path(model))
        for b in pieces(batches):
            texts = b.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
