"""Tokenizer ids of whole texts, with ids of frequent chunks remembered.

Both supported tokenizers cut a text into chunks before they merge, and never merge
across chunks, so a text's ids are its chunks' ids one after another. Every chunk is
encoded by the ``tokenizers`` library; a chunk seen before is only looked up.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

#: Chunks remembered by one worker (about 200 bytes each); when full, the memory starts anew.
REMEMBERED = 1_500_000
_LONGEST = 200
#: White space other than the plain space and the line feed.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Before a single space between two visible characters both tokenizers always cut.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the rest from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Known(dict):
    """Chunk to little-endian 32-bit ids; ``lead`` stands before each chunk."""

    def __init__(self, tokenizer: Tokenizer, lead: str = "", bare: _Known | None = None):
        super().__init__()
        self.tokenizer, self.model, self.normalizer = tokenizer, tokenizer.model, tokenizer.normalizer
        self.lead, self.bare = lead, self if bare is None else bare

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        # chunks put together from others are not remembered
        if self.lead and chunk[:1] == b"\n":
            return self.bare[b"\n"] + self.bare[chunk[1:]]
        if text[-1:] in (".", ",") and self._ends_in_letter(text[-2:-1]):
            # a full stop or comma after a letter is a chunk of its own
            return self[chunk[:-1]] + self.bare[chunk[-1:]]
        ids = struct.pack(f"<{len(found := self._ids(text))}I", *found)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(chunk) <= _LONGEST:
            self[chunk] = ids
        return ids

    def _ends_in_letter(self, last: str) -> bool:
        """Whether a character still ends in a letter once it is normalised."""
        return last.isalpha() and (last.isascii() or not self.normalizer or self.normalizer.normalize_str(last)[-1:].isalpha())

    def _ids(self, text: str) -> list[int]:
        plain = self.normalizer.normalize_str(text) if self.normalizer else text
        if plain.isalpha() and max(plain) < "\u0250":
            # one word of Latin letters is one chunk for the merges
            return [t.id for t in self.model.tokenize((self.lead + plain).encode().decode("latin-1").translate(_LETTERS))]
        return self.tokenizer.encode(self.lead + text, add_special_tokens=False).ids


class Encoder:
    """``encode(text)``: ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        # their strings in a text are ordinary text, as the tokenizers' README shows it
        tokenizer.encode_special_tokens = True
        self.bare = _Known(tokenizer)
        self.spaced = _Known(tokenizer, " ", self.bare)
        # a tokenizer that drops white space has the same ids with and without it
        self.drops_space = not tokenizer.encode(" \n ", add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if self.drops_space:
            return b"".join(map(self.bare.__getitem__, raw.split()))
        if not _ODD.search(text):
            chunks = raw.replace(b"\n", b" \n").split(b" ")
            if b"" not in chunks and b"\n" not in chunks:
                first = self.bare[chunks[0]]
                return first + b"".join(map(self.spaced.__getitem__, chunks[1:]))
        return b"".join(self.bare[c.encode()] for c in _CUT.split(text))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
