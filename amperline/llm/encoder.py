"""Token ids of whole texts, with a table of pieces seen before.

Some tokenizers treat the text between certain borders by itself, so the ids of a text are the
ids of its pieces joined. Then each distinct piece goes through the library once per worker and
text is mostly table look-ups. Where the borders aren't safe, or where the literal of an added token stands, the whole text goes to the library.

* Byte-level BPE with the usual pattern: a space or line break between two characters that are
  no white space starts or is a token of its own, and nothing reaches across it.
* Word BPE that drops white space: every ASCII white space is a border. Such a tokenizer lowers
  case itself.
* In both, the place between an ASCII letter and a single mark at a piece's end is a border too.

In byte-level BPE a piece of letters only is one word, so it goes to the merges without the pattern.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

TABLE_ENTRIES = 800_000
#: White space other than single inner spaces and line breaks: such texts are encoded whole.
_UNSAFE = re.compile(rb"[\0\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes that no unsafe white space starts with.
_COMMON = bytes(b for b in range(256) if b not in b"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")
_PAIRS = (b"  ", b" \n", b"\n ", b"\n\n")


def _safe(text: bytes) -> bool:
    if text[0] in b" \n" or text[-1] in b" \n" or any(p in text for p in _PAIRS):
        return False
    odd = text.translate(None, _COMMON)
    return not odd or not _UNSAFE.search(text)


_MARKS = b".,;:!?|"
#: Latin and basic Cyrillic letters only, as UTF-8: such a piece is one word for the byte-level pattern.
_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xd0[\x90-\xbf]|\xd1[\x80-\x8f])+")


def _signs() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    plain = {b: chr(b) for b in range(256) if chr(b).isprintable() and b != 32}
    others = (b for b in range(256) if b not in plain)
    return plain | {b: chr(256 + i) for i, b in enumerate(others)}


class _Table(dict):
    """Ids of pieces as bytes. A new piece that is a known one in capitals or with one mark behind a letter
    is made from its parts; others go to the library."""

    def __init__(self, owner: Encoder, before: str, marks: _Table | None, lowers: bool):
        self.owner, self.before, self.lowers = owner, before, lowers
        self.marks = self if marks is None else marks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        if self.lowers and (low := piece.lower()) != piece:
            ids = self[low]
        elif piece[:1] == b"\n":  # a line's first piece
            ids = self.owner.line_break + self.marks[piece[1:]]
        elif len(piece) > 1 and piece[-1] in _MARKS and piece[-2:-1].isalpha():
            ids = self[piece[:-1]] + self.marks[piece[-1:]]
        elif not self.lowers and _WORD.fullmatch(piece):
            ids = self.owner.word(self.before.encode() + piece)
        else:
            ids = self.owner.whole((self.before + piece.decode("utf-8", "replace")))
        self[piece] = ids
        return ids


class Encoder:
    """`blob(text)`: the ids as bytes of `dtype`, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.borders = _borders(spec)
        added = [t["content"].encode() for t in spec.get("added_tokens", []) if t["content"]]
        #: Texts that hold the literal of an added token go to the library whole.
        self._added = re.compile(b"|".join(map(re.escape, added)), re.I) if added else None
        self._model, self._signs = self.tokenizer.model, _signs()
        self._first = _Table(self, "", None, self.borders == "white")
        self._inner = _Table(self, " ", self._first, False)
        self.line_break = self.whole("\n") if self.borders == "space" else b""

    def whole(self, text: str) -> bytes:
        return array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, piece: bytes) -> bytes:
        """Ids of a piece that the byte-level pattern leaves whole, by the merges alone."""
        return array(self._code, [t.id for t in self._model.tokenize(piece.decode("latin-1").translate(self._signs))]).tobytes()

    def blob(self, text: bytes) -> bytes:
        if self._added and self._added.search(text):
            return self.whole(text.decode("utf-8", "replace"))
        if self.borders == "white":
            return b"".join(map(self._first.__getitem__, text.split()))
        if self.borders == "space" and text and _safe(text):
            pieces = text.replace(b"\n", b" \n").split(b" ")
            return self._first[pieces[0]] + b"".join(map(self._inner.__getitem__, pieces[1:]))
        return self.whole(text.decode("utf-8", "replace")) if text else b""


def _borders(spec: dict) -> str:
    before, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not before:
        return "space"
    steps = pre.get("pretokenizers", [])
    kinds = [x.get("type") for x in (before or {}).get("normalizers", [])]
    if (
        pre.get("type") == "Sequence"
        and steps
        and steps[0].get("type") == "Split"
        and steps[0].get("behavior") == "Removed"
        and steps[0].get("invert")
        and "\\s" in str(steps[0].get("pattern"))
        and set(kinds) <= {"NFC", "Replace", "Lowercase"}
    ):
        return "white"
    return "none"


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def forget() -> None:
    """Let go of this worker's tables; for tasks that need memory and no tokenizer, as Spark uses a worker for many jobs."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and its tables hold each other
