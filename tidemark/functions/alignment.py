"""Dynamic time warping in little memory, and the alignment of tokens to frames, as operators on keyed rows.

Costs are filled by anti-diagonals, whose cells depend on the two before alone. Only some pairs of diagonals are kept; the way back fills what lies between
two of them again, with the moves. So the path is the one that a full table gives, for twice the time and memory that grows with the length times its root."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: cost(i, j): the cells' costs, for arrays of row and column numbers from 0.
Cost = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _rows_of(d: int, n: int, m: int) -> tuple[int, int]:
    """First and last row of anti-diagonal d of a table with edges: cells (i, d - i), 0 <= i <= n, 0 <= d - i <= m."""
    return max(0, d - m), min(n, d)


def _next(cost: Cost, n: int, m: int, d: int, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs, moves) of anti-diagonal d by row, from those of d - 2 and d - 1. A diagonal move needs to be strictly best, then one down; across otherwise."""
    lo, hi = _rows_of(d, n, m)
    out, moves = np.full(n + 1, np.inf), np.full(n + 1, 2, np.int8)
    a, b = max(lo, 1), min(hi, d - 1)  # without the edges
    if a <= b:
        i = np.arange(a, b + 1)
        diagonal, down, across = before[a - 1 : b], last[a - 1 : b], last[a : b + 1]
        move = np.full(len(i), 2, np.int8)
        move[(down < diagonal) & (down < across)] = 1
        move[(diagonal < down) & (diagonal < across)] = 0
        out[a : b + 1] = cost(i - 1, d - i - 1) + np.choose(move, (diagonal, down, across))
        moves[a : b + 1] = move
    if hi == d:  # the first column leads down
        moves[d] = 1
    return out, moves


def path(cost: Cost, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the cheapest monotone path through n x m cells."""
    every = max(2, math.isqrt(n + m))
    start = np.full(n + 1, np.inf)
    before, last = start.copy(), start.copy()
    before[0] = 0.0  # diagonal 0 is the corner alone
    kept = {1: (before, last)}
    for d in range(2, n + m + 1):
        before, last = last, _next(cost, n, m, d, before, last)[0]
        if d % every == 0:
            kept[d] = (before, last)
    i, j, out = n, m, []
    while i > 0 or j > 0:
        base = (i + j - 1) // every * every if (i + j - 1) // every * every in kept else 1
        before, last = kept[base]
        moves = {}
        for d in range(base + 1, i + j + 1):
            costs, moves[d] = _next(cost, n, m, d, before, last)
            before, last = last, costs
        if base == 1:
            moves[1] = np.array([2, 1], np.int8)  # along the edges
        while (i > 0 or j > 0) and i + j in moves:
            out.append((i - 1, j - 1))
            move = 2 if i == 0 else 1 if j == 0 else moves[i + j][i]
            i, j = i - (move != 2), j - (move != 1)
    found = np.array(out[::-1], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def between(x: np.ndarray, y: np.ndarray) -> Cost:
    """The absolute difference of two series' values, or the distance of their vectors."""
    if x.ndim == 1:
        return lambda i, j: np.abs(x[i] - y[j])
    return lambda i, j: np.sqrt(((x[i] - y[j]) ** 2).sum(-1))


def warped(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, step, i, j, cost): the cheapest alignment of each row's two series (arrays of numbers, or of vectors) and what each step costs; nothing for an empty or
    null series. A row's pair is the work of one task."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, a, b in batch.itertuples(index=False, name=None):
                if a is None or b is None or not len(a) or not len(b):
                    continue
                series = [np.array([list(v) for v in s], float) if hasattr(s[0], "__len__") else np.asarray(s, float) for s in (a, b)]
                cost = between(*series)
                i, j = path(cost, len(a), len(b))
                yield pd.DataFrame({key: pd.Series([k] * len(i), dtype=batch[key].dtype), "step": np.arange(len(i)), "i": i, "j": j, "cost": cost(i, j)})

    return rows.select(key, x, y).mapInPandas(work, f"{key} {kind}, step bigint, i bigint, j bigint, cost double")


def standardised(attention: np.ndarray, filter_width: int = 7) -> np.ndarray:
    """(tokens, frames): the mean over the heads of softmax over frames, standardised over tokens, with medians over neighbouring frames."""
    a = np.exp(attention - attention.max(-1, keepdims=True))
    a /= a.sum(-1, keepdims=True)
    deviation = a.std(-2, keepdims=True)
    a = (a - a.mean(-2, keepdims=True)) / np.where(deviation > 0, deviation, 1)
    half = filter_width // 2
    if a.shape[-1] > half:
        padded = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(half, half)], mode="reflect")
        a = np.median(np.lib.stride_tricks.sliding_window_view(padded, filter_width, axis=-1), axis=-1)
    return a.mean(0)


def align_tokens(attention: np.ndarray, widths: list[int], probabilities: list[float] | None = None, filter_width: int = 7, frame_seconds: float = 0.02) -> list[tuple[float, float, float]]:
    """(start, end, probability) of each word from attention (heads, tokens, frames) and its number of tokens."""
    weights = standardised(attention, filter_width)
    tokens, frames = path(lambda i, j: -weights[i, j], *weights.shape)
    times = frames[np.concatenate(([True], np.diff(tokens) != 0))] * frame_seconds
    edges = np.concatenate(([0], np.cumsum(widths)))
    p = np.ones(int(edges[-1])) if probabilities is None else np.array(probabilities)
    at = lambda k: float(times[min(k, len(times) - 1)])
    return [(at(i), at(j), float(p[i:j].mean()) if j > i else 0.0) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def aligned(rows: DataFrame, key: str, attention: str, widths: str, probabilities: str | None = None, filter_width: int = 7, frame_seconds: float = 0.02) -> DataFrame:
    """(key, word, start, end, probability) of the words of each row: attention is an array of heads of tokens of frames, widths has each word's number of tokens."""
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, a, w, *p in batch.itertuples(index=False, name=None):
                if a is None or w is None or not len(a) or not len(a[0]):
                    continue
                weights = np.array([[list(t) for t in head] for head in a], float)
                got = align_tokens(weights, [int(x) for x in w], list(p[0]) if p and p[0] is not None else None, filter_width, frame_seconds)
                made = pd.DataFrame(got, columns=["start", "end", "probability"])
                made.insert(0, "word", np.arange(len(got)))
                made.insert(0, key, pd.Series([k] * len(got), dtype=batch[key].dtype))
                yield made

    return rows.select(key, attention, widths, *([probabilities] if probabilities else [])).mapInPandas(work, f"{key} {kind}, word bigint, start double, end double, probability double")
