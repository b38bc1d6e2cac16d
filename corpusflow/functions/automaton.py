"""Many keywords found in one pass over many texts.

Keywords count where they begin at a word boundary. One automaton holds all of
them, so the time of a pass depends on the texts and on what is found, not on
how many keywords there are.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between texts that are searched together; it is no word character and in no keyword.
_BETWEEN = "\x00"


@lru_cache(maxsize=1 << 16)
def is_word(point: int) -> bool:
    """Letters, marks, digits, letter-like numbers and signs, connectors and joiners make words."""
    kind = unicodedata.category(chr(point))
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or point in (0x200C, 0x200D) or 0x24B6 <= point <= 0x24E9


@lru_cache(maxsize=8)
def _automaton(keywords: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, word in enumerate(keywords):
        found.add_word(word, k)
    found.make_automaton()
    return found


@dataclass
class Hits:
    """Occurrences at word starts: text, keyword, and whether it ends before the text's first slash."""

    text: np.ndarray
    keyword: np.ndarray
    before_slash: np.ndarray


def find(texts: list[str | None], keywords: tuple[str, ...]) -> Hits:
    """All keywords that begin at a word boundary of a text; null texts have none."""
    body = _BETWEEN.join(t or "" for t in texts)
    first = np.r_[0, np.cumsum([len(t or "") + 1 for t in texts])]
    nothing = np.zeros(0, dtype=np.int64)
    if not keywords or not body:
        return Hits(nothing, nothing, nothing.astype(bool))
    found = list(_automaton(keywords).iter(body))
    if not found:
        return Hits(nothing, nothing, nothing.astype(bool))
    end, keyword = np.array(found, dtype=np.int64).T
    start = end - np.array([len(w) for w in keywords])[keyword] + 1
    points = np.frombuffer(body.encode("utf-32-le"), dtype=np.uint32)
    seen, inverse = np.unique(points, return_inverse=True)
    word = np.array([is_word(int(p)) for p in seen])[inverse]
    before = np.where(start > 0, word[np.maximum(start, 1) - 1], False)
    at = np.flatnonzero(before != word[start])
    start, end, keyword = start[at], end[at], keyword[at]
    text = np.searchsorted(first, start, side="right") - 1
    slashes = np.r_[np.flatnonzero(points == ord("/")), len(points)]
    slash = slashes[np.searchsorted(slashes, first[text])]  # the first one from the text's start on
    return Hits(text, keyword, end < slash)


def any_in(tags: pa.Array, values: tuple[str, ...]) -> np.ndarray:
    return np.asarray(pc.is_in(tags, value_set=pa.array(values, pa.string())).fill_null(False))
