"""Public tokenizer vocabularies, one per worker.

A byte-level BPE whose ranks lie beside its file as ``.tiktoken`` is encoded
from these, several times faster than from the file itself; ids equal those of
the ``tokenizers`` library either way.
"""

from __future__ import annotations

import base64
import json
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: a name in the public folder, or a path as it is."""
    return name if "/" in name else public_tokenizers.path(name)


class ByteBPE:
    """Ids of a byte-level BPE as little-endian 32-bit integers.

    special: strings such as ``<|endoftext|>`` in a text become their own ids, as
    the library has it; otherwise they are ordinary text.
    """

    def __init__(self, name: str = "byte_bpe_50k.json", special: bool = True):
        self.path, self.special, self.quick = vocabulary(name), special, None
        ranks = self.path.removesuffix(".json") + ".tiktoken"
        try:  # the same vocabulary as ranks, if it lies beside the file
            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        except FileNotFoundError:
            pass

    @cached_property
    def marks(self) -> list[str]:
        if not self.special:
            return []
        with open(self.path, encoding="utf-8") as f:
            return [t["content"] for t in json.load(f).get("added_tokens", [])]

    @cached_property
    def whole(self) -> Tokenizer:
        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = not self.special
        return found

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.quick and not any(m in text for m in self.marks):
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its pattern gives up on very long white space
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str | None) -> bytes:
        return self.ids(text).tobytes()


@lru_cache(maxsize=2)
def byte_bpe(name: str = "byte_bpe_50k.json", special: bool = True) -> ByteBPE:
    return ByteBPE(name, special)


@lru_cache(maxsize=2)
def pieces(name: str = "piece_bpe_32k.model") -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
