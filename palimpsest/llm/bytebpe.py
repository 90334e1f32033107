"""Byte-level BPE of a tokenizer file, for every text of a batch.

The file is read by the tokenizers library, which stays the measure of what is
right.  Where the file is proven to be a plain byte-level BPE whose ids ascend
with its merges and whose every vocabulary string encodes alone as itself, a
merge by ids gives the same tokens, and tiktoken does that faster from the same
vocabulary.  Any other file is encoded by the library.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenizer_path(name: str) -> str:
    """A path as it is; any other name is one that public_tokenizers knows."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """Ids of texts, as tokenizers.Tokenizer gives them without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.size = self.library.get_vocab_size()
        to_byte = byte_of_char()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"] if spec["model"].get("type") == "BPE" else {}
        #: The bytes of each id, where the vocabulary is byte-level.
        self.bytes = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in special and all(c in to_byte for c in s)}
        self.fast = self._by_rank(spec, special) if self._merges_by_id(spec, special) else None

    def _merges_by_id(self, spec: dict, special: set[str]) -> bool:
        model, pre, vocab = spec["model"], spec.get("pre_tokenizer") or {}, spec["model"].get("vocab", {})
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            return False
        if any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["special"] for t in spec.get("added_tokens", [])):
            return False
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in made or any(a >= b for a, b in zip(made, made[1:])) or len(self.bytes) != len(vocab) - sum(s in vocab for s in special) or {bytes([b]) for b in range(256)} - set(self.bytes.values()):
            return False
        return all([t.id for t in self.library.model.tokenize(s)] == [i] for s, i in vocab.items() if s not in special)

    def _by_rank(self, spec: dict, special: set[str]):
        import tiktoken

        ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return tiktoken.Encoding("by_rank", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens=ids)

    def encode(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """Ids of each text; special strings inside a text are special tokens, as the library's default has it, or else plain text."""
        if self.fast:
            allowed = "all" if special else set()
            return [self.fast.encode_to_numpy(t, allowed_special=allowed, disallowed_special=()) for t in texts]
        return [np.array(e.ids, dtype=np.uint32) for e in (self.library if special else self.plain).encode_batch(texts, add_special_tokens=False)]

    def plain_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of many short texts, in which special strings are plain text."""
        if self.fast:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.plain.encode_batch(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One for each Python worker, which serves many tasks."""
    return ByteEncoder(path)
