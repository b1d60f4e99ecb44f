"""The words of very long texts, a stretch at a time."""

from __future__ import annotations

from collections.abc import Iterator

STRETCH = 1 << 20


def word_stretches(text: bytes, table: bytes, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of ``text`` after ``table``, which maps every separator to a space, in lists.

    A word is never parted; lists may be empty.
    """
    rest = b""
    for at in range(0, len(text), stretch):
        said = rest + text[at: at + stretch].translate(table)
        end = len(said) if at + stretch >= len(text) else said.rfind(b" ") + 1
        rest = said[end:]
        yield said[:end].split()
