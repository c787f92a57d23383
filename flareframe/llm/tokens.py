"""Exact token ids from a public tokenizer file, with a bounded cache of pre-tokens.

BPE never merges across pre-tokens, so a text may be cut where the pre-tokenizer cuts and the ids of the
pieces joined.  Two pre-tokenizers are recognised from the file.  Texts of plain Latin characters are cut
into pre-tokens here; others at white space only, and the library does the rest; texts with one of the
tokenizer's added tokens, and tokenizers of another form, are given to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

import numpy as np

# What the tokenizers' patterns take as white space, contractions, and letters within Latin-1.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(f"[\\t\\n\\r -~{LETTER}]*")
BYTE_PIECE = re.compile(f"{SHORT}| ?[{LETTER}]+| ?[0-9]+| ?[^\\s0-9{LETTER}]+|\\s+(?!\\S)|\\s+")
WORD_PIECE = re.compile(f"{SHORT}|[{LETTER}]+|[0-9]|[^\\s0-9{LETTER}]+")


def byte_alphabet() -> dict[int, str]:
    """Byte to character as byte-level BPE writes it: printable ones stay, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cache(dict[str, bytes]):
    """Values worked out when first asked for, of keys of up to 64 characters.  When ``entries`` are full a new set of them
    begins, into which those of the last set that are asked for again are taken over; older ones are forgotten."""

    def __init__(self, of: Callable[[str], bytes], entries: int):
        super().__init__()
        self.of, self.entries, self.last = of, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.last.get(key)
        if value is None:
            value = self.of(key)
        if len(key) <= 64:
            if len(self) >= self.entries:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes; the same as the library gives for whole texts."""

    def __init__(self, path: str, entries: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [p.get("type") for p in pre.get("pretokenizers", [])]
        self.kind = ("byte" if pre.get("type") == "ByteLevel" and pre.get("use_regex")
                     and not pre.get("add_prefix_space") and norm is None else
                     "word" if steps == ["Split", "ByteLevel"] and SHORT in json.dumps(pre)
                     and pre["pretokenizers"][0]["behavior"] == "Removed" else "whole")
        self.alphabet = byte_alphabet()
        self.pieces, self.chunks = Cache(self.piece, entries), Cache(self.whole, entries)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def piece(self, s: str) -> bytes:
        if s.isascii() and s.isprintable():
            shown = s.replace(" ", self.alphabet[32])
        else:
            shown = s.encode().decode("latin-1").translate(self.alphabet)
        return self.pack([t.id for t in self.model.tokenize(shown)])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or any(a in text for a in self.added):
            return self.whole(text)
        if PLAIN.fullmatch(text):
            cut, cache = (BYTE_PIECE.findall(text) if self.kind == "byte" else WORD_PIECE.findall(text.lower())), self.pieces
        else:
            cut, cache = (CHUNK.findall(text) if self.kind == "byte" else [c.decode() for c in text.encode().split()]), self.chunks
        return b"".join(map(cache.__getitem__, cut))

    def sentence_ends(self) -> np.ndarray:
        """Ids of tokens that are nothing but sentence-final punctuation."""
        return np.array(sorted(i for t, i in self.tok.get_vocab().items()
                               if re.fullmatch(r"[.!?]+(</w>)?", t)), dtype=np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
