"""Space-led spans of a text, and a bounded table of what is known of each distinct span."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import owner, span_hash

#: Bytes that may end a white-space character of two or three UTF-8 bytes, and those before them.
_LAST = np.zeros(256, bool)
_LAST[[0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEFORE = np.zeros(256, bool)
_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True


def may_end_space(last: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """May these two bytes end a white-space character beyond ASCII?"""
    return _LAST[last] & _BEFORE[earlier]


#: ASCII letters.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def space_spans(buf: np.ndarray, offsets: np.ndarray, after_any: bool = False, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows, leads) of spans that tile each row: a new one begins at each space that follows something
    other than white space (other than a space, if after_any). leads: is it the row's first.
    marks: of each byte, does a new one begin there after an ASCII letter too; a line break that is marked begins one where a space would."""
    n = len(buf)
    cut = np.zeros(n, bool)
    if n:
        space = buf == 32
        before = np.concatenate(([32], buf[:-1]))
        if after_any:
            cut = space & (before != 32)
        else:
            earlier = np.concatenate(([32, 32], buf[:-2]))[:n]
            space |= marks is not None and marks[10] and buf == 10
            cut = space & (before > 32) & ~may_end_space(before, earlier)
        if marks is not None:
            cut |= marks[buf] & _LETTER[before]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        cut[first] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)[: len(starts)]
    rows = owner(offsets, starts)
    leads = np.zeros(len(starts), bool)
    leads[np.searchsorted(starts, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
    return starts, ends, rows, leads


class SpanTable:
    """Sorted 64-bit span hashes, each with a run of integers below 2^32, kept in 16 bits while they fit; forgets everything beyond limit spans."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, k, -1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        """keys: new and sorted."""
        at = len(self.values) + np.cumsum(sizes) - sizes
        kind = np.uint32 if self.values.dtype == np.uint32 or (len(values) and int(values.max()) > 65535) else np.uint16
        self.values = np.concatenate((self.values.astype(kind, copy=False), values.astype(kind)))
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, sizes)

    def resolve(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, leads: np.ndarray | None, missing) -> np.ndarray:
        """Table index of each span; missing(span numbers) -> (sizes, values) for spans that it doesn't know."""
        keys = span_hash(buf, starts, ends)
        if leads is not None:
            keys = keys ^ (leads.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > self.limit:
            self.clear()
        new = self.find(unique) < 0
        if new.any():
            self.add(unique[new], *missing(first[new]))
        return self.find(unique)[inverse]

    def expand(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the spans at, one after the other, and the span number of each."""
        sizes = self.size[at]
        which = np.repeat(np.arange(len(at)), sizes)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.values[self.at[at][which] + inner], which
