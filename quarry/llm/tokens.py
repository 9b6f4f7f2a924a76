"""Token ids of whole texts by the ``tokenizers`` library, unit by unit.

The split pattern of this family of byte-level BPE never lets a piece run
across "other character, space", so a text whose spaces stand alone is the
sequence of its space-separated units, and equal units have equal ids.  A unit
not met before is split by the pattern and each new piece goes through the
library's model.  Texts with spaces beside other white space, and units with
characters above U+0530 (where Unicode versions of pattern engines differ),
go through the library's whole pipeline, as do texts that hold an added token of
the vocabulary: the library gives that token's own id.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units a worker remembers (some 200 bytes each); then it starts afresh.
REMEMBER = 800_000
_FAR = "\u0530"
#: Signs that end many units; none of them takes part in a contraction.
_SIGNS = "#*$%&!,.;:?|"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in such vocabularies: itself where
    it prints, else the next free character from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class UnitEncoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library takes for one token wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.split = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_letters()))
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.known, self.bare = _Known(self, "Ġ"), _Known(self, "")
        #: Pieces of signs alone, and the line break.
        self.signs = _Signs(self)
        self.line = self.piece("Ċ")

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str, pattern: str) -> UnitEncoder:
        return UnitEncoder(path, pattern)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, shown: str) -> bytes:
        return b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])

    def _shown(self, text: str) -> str:
        return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)

    def unit(self, unit: str, known: _Known) -> bytes:
        """Ids of a unit behind a space or, for ``bare``, behind nothing."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Beside
        if not unit.isascii() and max(unit) > _FAR:
            return self.whole(" " + unit if known.lead else unit)
        if unit.isalpha():
            return self.piece(known.lead + self._shown(unit))
        if "\n" in unit:
            # A line break between other characters is a piece of its own.
            parts = unit.split("\n")
            if parts == unit.split():
                first, *rest = parts
                line = self.line
                return b"".join([known[first], *(x for r in rest for x in (line, self.bare[r]))])
        head = unit.rstrip(_SIGNS)
        if head and head != unit and head.isalpha():
            return known[head] + self.signs[unit[len(head) :]]
        pieces = self.split(" " + unit if known.lead else unit)
        return b"".join([self.piece(self._shown(p)) for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if any(a in text for a in self.added):
                out.append(self.whole(text))
                continue
            # A line break that ends a text is a piece, too.
            last = text[-1:] == "\n" and not text[-2:-1].isspace() and len(text) > 1
            first, *rest = text[:-1].split(" ") if last else text.split(" ")
            try:
                ids = self.bare[first] + b"".join(map(known.__getitem__, rest))
                out.append(ids + self.line if last else ids)
            except _Beside:
                out.append(self.whole(text) if text else b"")
            if len(known) > REMEMBER:
                known.clear()
            if len(self.bare) > REMEMBER // 4:
                self.bare.clear()
            if len(self.signs) > REMEMBER // 8:
                self.signs.clear()
        return out


class _Beside(Exception):
    """A space beside other white space: the text is no sequence of units."""


class _Known(dict):
    """Units and their ids; looks up what it has not met."""

    def __init__(self, encoder: UnitEncoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, unit: str) -> bytes:
        e = self.encoder
        if unit.isascii() and unit.isalpha():
            ids = b"".join([e.raw[t.id] for t in e.model.tokenize(self.lead + unit)])
        else:
            ids = e.unit(unit, self)
        self[unit] = ids
        return ids


class _Signs(dict):
    """Pieces of signs and their ids."""

    def __init__(self, encoder: UnitEncoder):
        self.encoder = encoder

    def __missing__(self, shown: str) -> bytes:
        ids = self[shown] = self.encoder.piece(shown)
        return ids


def default_paths() -> tuple[str, str]:
    """The installed vocabulary and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
