"""Words of whole texts, as bytes, in bounded memory however long a text is."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

#: Bytes that are cut into words at a time, and bytes for each class of words that is told apart at a time.
PIECE, CLASS = 1 << 20, 16 << 20


def pieces(text: bytes, gap: re.Pattern[bytes]) -> Iterator[bytes]:
    """The text in pieces that end where a gap between words begins."""
    at = 0
    while len(text) - at > PIECE and (m := gap.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def distinct(text: bytes, gap: re.Pattern[bytes], words: Callable[[bytes], list[bytes]]) -> Iterator[set[bytes]]:
    """Disjoint sets that together hold the text's distinct words: one set, or for a long text one for each class of
    words by a hash, so that a text of nothing but different words stays within memory."""
    classes = 1 + len(text) // CLASS
    for k in range(classes):
        found: set[bytes] = set()
        for p in pieces(text, gap):
            found.update(words(p) if classes == 1 else (w for w in words(p) if zlib.crc32(w) % classes == k))
        yield found
