"""Pre-token splitting and a bounded cache, shared by the byte-pair operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import regex

#: Letters that Python's ``re`` can name by ranges; a text of these, digits and common signs needs no Unicode tables.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
_HARD = re.compile(f"[^\\x00-\\x1b\\x20-\\x7e¡§«°»¿×÷{_LETTERS}–—‘’“”…€]").search
_EASY = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+").findall


def splitter(pattern: str | None = None) -> Callable[[str], list[str]]:
    """The function that cuts a text into the matches of ``pattern`` (by default the public byte-level one).

    For the default pattern, texts of Latin letters take an equal but faster path.
    """
    full = regex.compile(pattern or public_tokenizers.PATTERN).findall
    if pattern is not None:
        return full
    return lambda text: full(text) if _HARD(text) else _EASY(text)


class Generations(dict):
    """A cache of at most twice ``size`` entries: when the young half is full it becomes the old one.

    Entries used since are carried over, so that frequent pieces stay. Results do not depend on what is cached.
    """

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def add(self, key: str, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value


def chunks(texts: Iterable[str], most: int = 400_000) -> Iterator[list[str]]:
    """Lists of texts of about ``most`` characters together (a longer text stands alone)."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held
