"""Words of whole texts as bytes, a piece of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PIECE_BYTES = 1 << 20


def keeping(ascii_chars: bytes) -> bytes:
    """A translation table: A-Z go to lower case, bytes of characters beyond ASCII and `ascii_chars` stay, all others are blanks."""
    kept = set(ascii_chars)
    return bytes(b + 32 if 65 <= b <= 90 and b + 32 in kept else b if b in kept or b >= 128 else 32 for b in range(256))


def word_lists(raw: bytes | None, table: bytes, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of one text in order, in lists of about `limit` bytes of text; null has none."""
    if not raw:
        return
    folded = raw.translate(table)
    at = 0
    while at < len(folded):
        end = len(folded) if at + limit >= len(folded) else folded.find(b" ", at + limit)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    for x in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield x.as_py()
