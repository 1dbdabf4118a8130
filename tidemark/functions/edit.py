"""Edit distance and error rates. Short tokens stay in Catalyst; whole texts are compared along diagonals, many at once, and by bit vectors where they differ much."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound, col, for_character_rate, for_mixed_rate, mixed_tokens, normalisation_language, strip


def token_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of two token arrays: each distinct token becomes one character, and levenshtein does the rest.

    Characters come from the CJK block and above, and from the other planes for a pair of rows with 20,000 distinct tokens or more; beyond a
    million a fold over the arrays takes over."""
    both = F.struct(col(a).alias("a"), col(b).alias("b"), F.array_distinct(F.concat(col(a), col(b))).alias("words"))

    def coded(tokens: Column, words: Column, first: int, digits: int, charset: str) -> Column:
        letter = lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(words, x) + first), digits, "0")), charset)
        return F.array_join(F.transform(tokens, letter), "")

    def distance(x: Column) -> Column:
        by = lambda *how: F.levenshtein(coded(x["a"], x["words"], *how), coded(x["b"], x["words"], *how))
        n = F.size(x["words"])
        return F.when(n < 20_000, by(0x4DFF, 4, "UTF-16BE")).when(n < 1_000_000, by(0xFFFF, 8, "UTF-32")).otherwise(_folded_distance(x["a"], x["b"]))

    return bound(both, distance)


def token_distance_long(a: Column | str, b: Column | str) -> Column:
    """The same for arrays of any size, by bit vectors."""
    return edits(a, b).cast("int")


def _folded_distance(a: Column, b: Column) -> Column:
    """The same in Catalyst, for use inside its lambdas: a row of the edit table is made of the one above, and what goes on from the left by doubling."""
    n = F.size(b)
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda by: by <= n)

    def row(state: Column, x: Column) -> Column:
        above = lambda v, j: F.least(v + 1, F.get(state, j - 1) + F.when(F.get(b, j - 1) == x, 0).otherwise(1))
        return F.aggregate(steps, F.transform(state, above), lambda now, by: F.transform(now, lambda v, j: F.least(v, F.get(now, j - by) + by)))

    return F.element_at(F.aggregate(a, F.sequence(F.lit(0), n), row), -1)


def close_distance(a: Column | str, b: Column | str) -> Column:
    """levenshtein of long texts that differ little: within a band about the diagonal, eight times as wide each time it doesn't hold the
    distance, and without a band in the end."""
    a, b = col(a), col(b)
    banded = lambda k: F.get(F.filter(F.array(F.levenshtein(a, b, k)), lambda d: d >= 0), F.lit(0))
    return F.coalesce(*(banded(k) for k in (16, 128, 1024)), F.levenshtein(a, b))


#: Half the width of the first band that is tried; texts that are shorter than some of it are compared without one.
BAND = 64
#: Pairs and symbols that are compared along diagonals at once, and a measure of how many edits are few for a length.
PAIRS, SYMBOLS, NEAR = 256, 1 << 21, 8
#: Symbols that are compared at a time on diagonals that go on, of how many at once.
BLOCKS, CELLS = (8, 64, 512, 4096), 1 << 18


def _places(a: Sequence[Hashable]) -> dict[Hashable, int]:
    """Of each symbol a number whose bits say where it is."""
    at: dict[Hashable, list[int]] = {}
    for k, x in enumerate(a):
        at.setdefault(x, []).append(k)
    out = {}
    for x, where in at.items():
        bits = bytearray((where[-1] >> 3) + 1)
        for k in where:
            bits[k >> 3] |= 1 << (k & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _whole(places: dict[Hashable, int], m: int, b: Sequence[Hashable]) -> int:
    """Distance of a pattern of m symbols and b: vertical steps of the edit table, up and down, are two numbers of m bits."""
    full = (1 << m) - 1
    up, down = full, 0
    for y in b:
        same = places.get(y, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        right = (down | (full ^ (level | up))) << 1 & full | 1
        left = (level & up) << 1
        up = (left | ~(level | right)) & full
        down = right & level
    return len(b) + up.bit_count() - down.bit_count()


def _banded(places: dict[Hashable, int], m: int, b: Sequence[Hashable], k: int) -> int:
    """The same within k of the diagonal, in numbers of 2k + 1 bits that move along it: exact if it is k at most, else no less than the distance.
    m is k or more, and the lengths differ by k at most."""
    full, low = (1 << 2 * k + 1) - 1, 2 * k
    up, down = full ^ ((1 << k) - 1), 0  # rows before the first are flat
    score = k  # of the band's last row, and of row m when that is reached
    for j, y in enumerate(b, 1):
        same = places.get(y, 0)
        same = (same << k - j + 1 if j <= k else same >> j - k - 1) & full if same else 0
        level = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (full ^ (level | up)), level & up
        if j <= m - k:
            score += not level >> low & 1
        else:
            row = m - j + k
            score += (right >> row & 1) - (left >> row & 1)
        level >>= 1
        up = (left | ~(level | right)) & full
        down = right & level
    return score


def distance(a: Sequence[Hashable], b: Sequence[Hashable], least: int = 0) -> int:
    """Exact edit distance of two sequences: without what they share at both ends, within bands of growing width, and in the end without one.
    least: of the first band, half its width or more."""
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) < len(b):
        a, b = b, a
    m, k = len(a), max(BAND, least, 2 * (len(a) - len(b)))
    if not b:
        return m
    places = _places(a)
    while 8 * k < m:
        if (found := _banded(places, m, b, k)) <= k:
            return found
        k *= 4
    return _whole(places, m, b)


def _laid(rows: list[Sequence[Hashable]], codes: dict[Hashable, int], end: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows' symbols one row after the other, each with end behind it, and room for a block; where each row begins)."""
    parts, stop = [], np.array([end], np.uint32)
    for x in rows:
        parts += [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(x, str) else np.array([codes.setdefault(v, len(codes)) for v in x], np.uint32), stop]
    sizes = np.array([len(x) + 1 for x in rows], np.int64)
    return np.concatenate([*parts, np.full(BLOCKS[-1], end, np.uint32)]), np.cumsum(sizes) - sizes


def _shared(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from each i and j on are the same: one, then blocks that grow for those that go on. a, b: symbols, and blocks of them from each on.
    Rows end in different symbols."""
    live = np.flatnonzero(a[0][i] == b[0][j])
    out = np.zeros(len(i), np.int64)
    begun = i[live]
    p, q, size = begun + 1, j[live] + 1, 0
    while len(live):
        same = a[size + 1][p] == b[size + 1][q]
        first = same.argmin(1)
        on = same[np.arange(len(live)), first]
        p += np.where(on, BLOCKS[size], first)
        if not on.all():
            out[live[~on]] = (p - begun)[~on]
            live, begun, p, q = live[on], begun[on], p[on], q[on]
        q += BLOCKS[size]
        size += size + 1 < len(BLOCKS) and len(live) * BLOCKS[size + 1] <= CELLS
    return out


def _near(a: list[Sequence[Hashable]], b: list[Sequence[Hashable]], most: np.ndarray) -> np.ndarray:
    """Distances of pairs that have most edits or fewer, else -1. With each edit more, every diagonal's furthest place that so many edits lead to
    follows from those of its neighbours: some e * e steps for e edits, of all pairs at once."""
    codes: dict[Hashable, int] = {}
    (xs, at), (ys, to) = _laid(a, codes, 0xFFFFFFFF), _laid(b, codes, 0xFFFFFFFE)
    xs, ys = ([x, *(np.lib.stride_tricks.sliding_window_view(x, k) for k in BLOCKS)] for x in (xs, ys))
    m, n = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out, rows, e = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    ends = (at + _shared(xs, ys, at, to))[:, None]  # places in xs, with a column for each diagonal from -e to e
    while True:
        k = n - m
        done = (abs(k) <= e) & (ends[np.arange(len(rows)), np.clip(k + e, 0, 2 * e)] == at + m)
        out[rows[done]] = e
        stay = ~done & (e < most)
        if not stay.all():
            rows, ends, m, n, at, to, most = (x[stay] for x in (rows, ends, m, n, at, to, most))
        if not len(rows):
            return out
        e += 1
        new = np.zeros((len(rows), 2 * e + 1), np.int64)
        new[:, 2:] = ends  # a symbol more of b
        ends += 1
        np.maximum(new[:, 1:-1], ends, out=new[:, 1:-1])  # another one
        np.maximum(new[:, :-2], ends, out=new[:, :-2])  # one more of a
        diagonal = np.arange(-e, e + 1)
        last = np.minimum((at + m)[:, None], (at + n)[:, None] - diagonal)
        np.minimum(new, last, out=new)
        other = new + ((to - at)[:, None] + diagonal)
        if e <= min(m.min(), n.min()):
            new += _shared(xs, ys, new.ravel(), other.ravel()).reshape(new.shape)
        else:  # some diagonals lie beyond a table
            inside = (last >= at[:, None]) & (m[:, None] + diagonal >= 0)
            new[inside] += _shared(xs, ys, new[inside], other[inside])
            new[~inside] = 0
        ends = new


def distances(a: list[Sequence[Hashable]], b: list[Sequence[Hashable]]) -> list[int]:
    """Exact edit distance of each pair, of texts or of lists: along diagonals while there are few edits for the length, else by bit vectors."""
    out, lo = [0] * len(a), 0
    size = [max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    order = sorted(range(len(a)), key=size.__getitem__)  # pairs of a length need about as many steps
    while lo < len(order):
        hi, held = lo + 1, 2 * size[order[lo]]
        while hi < min(len(order), lo + PAIRS) and (held := held + 2 * size[order[hi]]) <= SYMBOLS:
            hi += 1
        these = order[lo:hi]
        few = [int(NEAR * (size[k] * (1 + size[k] / 6000)) ** 0.5) for k in these]
        for k, most, d in zip(these, few, _near([a[k] for k in these], [b[k] for k in these], np.array(few, np.int64)).tolist(), strict=True):
            out[k] = distance(a[k], b[k], most) if d < 0 else d
        lo = hi
    return out


def compared(a: Column | str, b: Column | str) -> Column:
    """(edits, n_a, n_b): edit distance and lengths of two texts by code point, or of two arrays by element, of any length and at any distance; null with a null.

    Spark's levenshtein fills a table of all pairs of characters; here a batch of rows goes along the diagonals of their tables, or a number holds a
    column of one, some sixty cells a machine step. Lengths come along, so that what makes the texts is evaluated once."""

    @F.pandas_udf("edits long, n_a long, n_b long")
    def each(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        plain = lambda v: v if isinstance(v, str) else list(v)
        there = [k for k, (p, q) in enumerate(zip(x, y, strict=True)) if p is not None and q is not None]
        ps, qs = [plain(x.iat[k]) for k in there], [plain(y.iat[k]) for k in there]
        rows = [(None,) * 3] * len(x)
        for k, p, q, d in zip(there, ps, qs, distances(ps, qs), strict=True):
            rows[k] = d, len(p), len(q)
        return pd.DataFrame(rows, columns=["edits", "n_a", "n_b"], dtype="Int64")

    return each(col(a), col(b))


def edits(a: Column | str, b: Column | str) -> Column:
    return compared(a, b)["edits"]


def compared_rate(a: Column | str, b: Column | str) -> Column:
    """Edits over the length of a, as rate() has it."""
    both = compared(a, b)
    return rate(both["edits"], both["n_a"], both["n_b"])


def rate(n_edits: Column, length: Column, hypothesis_length: Column) -> Column:
    """Edits over the reference's length. Against an empty reference 0 if the hypothesis is empty too, else 1. Not clamped."""
    return F.when(length == 0, F.when(hypothesis_length == 0, 0.0).otherwise(1.0)).otherwise(n_edits / length)


def character_error_rate(reference: Column | str, hypothesis: Column | str, language: Column | str, han=None) -> Column:
    r, h = for_character_rate(reference, hypothesis, language, han)
    return compared_rate(strip(r), strip(h))


def mixed_error_rate(reference: Column | str, hypothesis: Column | str, language: Column | str, han=None) -> Column:
    language = col(language)
    tokens = []
    for text in (reference, hypothesis):
        lang = bound(strip(text), lambda bare: F.coalesce(normalisation_language(language, bare), language))
        ready = F.struct(for_mixed_rate(text, language, han).alias("text"), lang.alias("lang"))
        tokens.append(bound(ready, lambda x: mixed_tokens(x["text"], x["lang"])))
    return compared_rate(*tokens)
