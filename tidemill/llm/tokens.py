"""Token ids of whole texts by a file of the tokenizers library."""

from __future__ import annotations

import json
import os

import numpy as np

#: How byte-level vocabularies split a text before merging. A fixed value of that kind of tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids as the library gives them without special tokens around a text.

    A byte-level vocabulary whose merges stand in the order of its ids is also run by tiktoken, in about half the time:
    the same pieces, the same merges, the same ids. Texts that hold special tokens, and other vocabularies, go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.tokenizer.get_vocab_size() > 0x10000:
            raise ValueError("ids don't fit in 16 bits")
        self.quick = self._quick(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _quick(rules: dict):
        import tiktoken

        model, before = rules["model"], rules["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or rules["normalizer"] or model.get("ignore_merges"):
            return None
        vocabulary, byte = model["vocab"], _bytes_of()
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or not byte.keys() <= vocabulary.keys():
            return None
        special = {t["content"] for t in rules["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        out = []
        for text in texts:
            if self.quick is None or any(x in text for x in self.special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.quick.encode_ordinary(text)
            out.append(np.array(ids, "<u2").tobytes())
        return out

    def count(self, text: str) -> int:
        """Tokens of a text in which special tokens are ordinary text."""
        if self.quick is not None:
            return len(self.quick.encode_ordinary(text))
        self.tokenizer.encode_special_tokens = True
        try:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        finally:
            self.tokenizer.encode_special_tokens = False


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
