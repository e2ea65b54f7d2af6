"""Token ids by the tokenizers library, with a memory of pieces that the pre-tokenizer splits off.

A text is cut where the tokenizer itself cuts before merging, so each piece's ids depend on the piece only.
Pieces repeat; their ids are kept (up to MEMORY pieces a worker) and new ones go to the library in batches.
Texts with characters beyond Latin-1 or special tokens go to the library whole.
"""
from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMORY = {"byte": 700_000, "word": 300_000}  # about 500 bytes each
LONG_PIECE = 256
STEP = 1_000_000  # characters whose pieces are held at once

# Words come first in the patterns, which changes nothing as no other alternative starts with a letter or with a
# blank and a letter. Latin-1 members of the classes in the tokenizers' patterns (letters, numbers, white space): fixed values.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
PIECES = {
    # byte-level: pieces keep their leading blank
    "byte": re.compile(f" ?[{L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"),
    # word ends: lower-cased, white space dropped
    "word": re.compile(f"[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^{S}{L}{N}]+"),
}


def _packed(ids: list[int]) -> bytes:
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Encoder:
    """Ids of whole texts as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memory = MEMORY[kind]
        self.pattern, self.lower = PIECES[kind], kind == "word"
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def by_library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    def pieces(self, text: str) -> list[str] | None:
        """The pieces, or None if the text is for the library."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if any(s in text for s in self.special):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def _some(self, texts: list[str]) -> list[bytes]:
        get, parts, whole = self.known.get, [], []
        holders, places, missing = [], [], []
        for text in texts:
            found = self.pieces(text)
            parts.append(found if found is None else list(map(get, found)))
            if found is None:
                whole.append(text)
            elif None in parts[-1]:
                ids, i = parts[-1], -1
                for _ in range(ids.count(None)):
                    i = ids.index(None, i + 1)
                    holders.append(ids)
                    places.append(i)
                    missing.append(found[i])
        new = list(set(missing))
        made = dict(zip(new, self.by_library(new)))
        for ids, i, p in zip(holders, places, missing):
            ids[i] = made[p]
        if len(self.known) + len(made) <= self.memory:
            self.known.update((p, x) for p, x in made.items() if len(p) <= LONG_PIECE)
        rest = iter(self.by_library(whole))
        return [next(rest) if ids is None else b"".join(ids) for ids in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= STEP:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some)

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process, with its memory."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
