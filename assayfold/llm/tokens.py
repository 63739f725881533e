"""Byte-level BPE ids, equal to those of the tokenizers library, encoded by tiktoken from the same vocabulary file.

The merges are the file's own ranks. Where a text has no two white-space characters in a row, the pre-token pattern needs
no look-ahead and is matched by a plain automaton; other texts use the full pattern, and texts that hold a special
token's string go through the tokenizers library itself.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

_run = re.compile(r"\s\s|\s\Z")
_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as unsigned 16-bit arrays, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self.full = None
        if spec["model"]["type"] == "BPE" and not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get(
            "type"
        ) == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space"):
            # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for 256 and up.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
            ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.special}
            import public_tokenizers

            if sorted(ranks.values()) == list(range(len(ranks))):
                pattern, ahead = public_tokenizers.PATTERN, "|\\s+(?!\\S)|\\s+"
                encode = lambda p: tiktoken.Encoding(
                    "bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={}
                )._core_bpe.encode_ordinary
                self.full = encode(pattern)
                self.fast = encode(pattern.replace(ahead, "|\\s")) if pattern.endswith(ahead) else self.full

    def raw(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 16-bit bytes; none for null or empty text."""
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.full(text) if _run.search(text) else self.fast(text)
        return array("H", ids).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), np.uint16)


def encoder(path: str) -> Encoder:
    """One a worker, loaded at its first use."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
