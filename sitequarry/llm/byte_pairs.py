"""Ids of whole texts by a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import regex

#: The split that such files state by name only, and the bytes that their letters stand for as they are.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def letters() -> dict[str, int]:
    """The byte that each letter of a vocabulary stands for: printed ones for themselves, the others from U+0100 on."""
    rest = [b for b in range(256) if b not in set(PRINTED)]
    return {chr(b): b for b in PRINTED} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Packs the ids of texts as little-endian integers, equal to what the tokenizers library gives.

    A file whose parts are just the split above and merges in the order of their ids is run by tiktoken, which needs a fraction of the time.
    Any other file, and texts with runs that its split could not walk through, go to the tokenizers library itself.
    """

    #: A longer run of letters, digits, marks or white space is given to the tokenizers library.
    RUN = 20_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.long = regex.compile(rf"\S{{{self.RUN},}}|\s{{{self.RUN},}}")
        self.fast = self._fast(json.loads(Path(path).read_text()))

    def _fast(self, parts: dict):
        model, split = parts["model"], parts["pre_tokenizer"] or {}
        plain = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain:
            return None
        special = {t["content"] for t in parts["added_tokens"]}
        of = letters()
        vocabulary = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [vocabulary.get(bytes(of[c] for c in (m.replace(" ", "") if isinstance(m, str) else "".join(m)))) for m in model["merges"]]
        singles = sorted(i for t, i in vocabulary.items() if len(t) == 1)
        if merged != sorted(set(merged)) or len(singles) != 256 or len(merged) + 256 != len(vocabulary) or (merged and singles[-1] > merged[0]):
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens={})

    def many(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, self.kind) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            if len(t) >= self.RUN and self.long.search(t):
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, self.kind))
            else:
                out.append(np.array(self.fast.encode_ordinary(t), self.kind))
        return out


_READY: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    """One per worker process."""
    if path not in _READY:
        _READY[path] = BytePairs(path)
    return _READY[path]
