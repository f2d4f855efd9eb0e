"""Texts in slices of bounded size, so that a very long text never becomes one list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of text that are split into words at once.
SLICE = 1 << 22
END = re.compile(rb"[^ ] ")


def slices(data: bytes, most: int = SLICE) -> Iterator[bytes]:
    """``data`` in pieces of about ``most`` bytes; each ends after a word, before a run of spaces. Longer words stay whole."""
    at = 0
    while len(data) - at > most:
        end = END.search(data, at + most)
        if end is None:
            break
        yield data[at : end.start() + 1]
        at = end.start() + 1
    yield data[at:] if at else data
