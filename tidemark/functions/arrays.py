"""Array and signal functions over columns: statistics, filters, softmax, padding, firing rules. Catalyst alone but for DTW, mel and PCM."""

from __future__ import annotations

import io
import math
import wave
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import bound, col

MINUS_INFINITY = float("-inf")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column | str) -> Column:
    return bound(col(a), lambda a: bound(F.array_max(a), lambda top: bound(F.transform(a, lambda x: F.exp(x - top)), lambda e: bound(_total(e), lambda t: F.transform(e, lambda x: x / t)))))


def log_softmax(a: Column | str) -> Column:
    log_sum = lambda a, top: F.log(_total(F.transform(a, lambda x: F.exp(x - top)))) + top
    return bound(col(a), lambda a: bound(F.array_max(a), lambda top: bound(log_sum(a, top), lambda s: F.transform(a, lambda x: x - s))))


def arg_max(a: Column | str) -> Column:
    """First position, from 0, of the largest element."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def mean(a: Column | str) -> Column:
    a = col(a)
    return F.when(F.size(a) > 0, _total(a) / F.size(a))


def slice_mean(a: Column | str, start: Column, length: Column) -> Column:
    """Mean of length elements from start (from 0)."""
    part = F.slice(col(a), start + 1, length)
    return F.when(F.size(part) > 0, _total(part) / F.size(part))


def z_norm(a: Column | str) -> Column:
    """(x - mean) / population standard deviation; null elements where it is 0."""
    deviation = lambda a, m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))
    return bound(col(a), lambda a: bound(mean(a), lambda m: bound(deviation(a, m), lambda sd: F.transform(a, lambda x: F.when(sd > 0, (x - m) / sd)))))


def median(a: Column | str) -> Column:
    """Exact; 0 for an empty array."""
    s = F.array_sort(col(a))
    n = F.size(s)
    at = lambda k: F.element_at(s, F.greatest(k, F.lit(1)).cast("int"))
    return F.when(n == 0, F.lit(0.0)).otherwise((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def median_filter(a: Column | str, width: int = 7) -> Column:
    """Centred median with reflected edges; as it is where the array is no longer than half the width."""
    if width < 1 or width % 2 == 0:
        raise ValueError("width must be odd")
    half = width // 2

    def padded(a: Column) -> Column:
        if not half:
            return a
        return F.concat(F.reverse(F.slice(a, F.lit(2), F.lit(half))), a, F.reverse(F.slice(a, F.greatest(F.size(a) - half, F.lit(1)), F.lit(half))))

    def middles(a: Column) -> Column:
        mid = bound(padded(a), lambda whole: F.transform(a, lambda x, i: F.element_at(F.array_sort(F.slice(whole, i + 1, F.lit(width))), half + 1)))
        return F.when(F.size(a) <= half, a).otherwise(mid)

    return bound(col(a), middles)


def pad_or_trim(a: Column | str, length: int, value: float = 0.0) -> Column:
    a = col(a)
    return F.slice(F.concat(a, F.array_repeat(F.lit(value), length).cast("array<double>")), 1, length)


def masked(logits: Column | str, suppressed: Column | list[int]) -> Column:
    """-inf at the positions (from 0) to suppress."""
    s = suppressed if isinstance(suppressed, Column) else F.array(*map(F.lit, suppressed)).cast("array<int>")
    return F.transform(col(logits), lambda x, i: F.when(F.array_contains(s, i), F.lit(MINUS_INFINITY)).otherwise(x))


def masked_at_start(logits: Column | str, step: Column, blanks: list[int]) -> Column:
    return F.when(step == 0, masked(logits, blanks)).otherwise(col(logits))


def filter_chain(logits: Column | str, filters: list[Callable[[Column], Column]]) -> Column:
    """Logit filters in order."""
    return reduce(lambda a, f: f(a), filters, col(logits))


def cumulative(a: Column | str) -> Column:
    """Running sums, in one pass."""
    return F.aggregate(col(a), F.array().cast("array<double>"), lambda sums, x: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0)) + x))


def cif_resized(alphas: Column | str, target: Column | str, threshold: float = 0.999, rounds: int = 10) -> Column:
    """Firing weights scaled to a target sum; while some are above the threshold, at most rounds times, they are halved and the
    rest take over what they lost in proportion."""
    scaled = bound(col(alphas), lambda a: bound(_total(a), lambda t: F.transform(a, lambda x: x * col(target) / t)))
    high = lambda x: x > threshold

    def moved(now: Column) -> Column:
        sums = F.struct(
            _total(F.transform(now, lambda x: F.when(high(x), x * 0.5).otherwise(F.lit(0.0)))).alias("lost"), _total(F.transform(now, lambda x: F.when(high(x), F.lit(0.0)).otherwise(x))).alias("rest")
        )
        return bound(sums, lambda s: F.transform(now, lambda x: F.when(high(x), x * 0.5).otherwise(F.when(s["rest"] > 0, x + x * s["lost"] / s["rest"]).otherwise(x))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), scaled, lambda now, _: F.when(F.exists(now, high), moved(now)).otherwise(now))


def cif_fires(alphas: Column | str, threshold: float = 0.999) -> Column:
    """Does the weights' running sum, scaled to whole firings, reach its last one within the last two frames?"""
    weights = F.transform(col(alphas), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))

    def reaches(a: Column, t: Column) -> Column:
        target = F.rint(t)
        crossed = F.filter(F.transform(cumulative(a), lambda x, i: F.when(x * target / t >= target * threshold, i)), lambda i: i.isNotNull())
        return F.coalesce((target > 0) & (F.try_element_at(crossed, F.lit(1)) >= F.size(a) - 2), F.lit(False))

    return bound(weights, lambda a: bound(_total(a), lambda t: reaches(a, t)))


def fire_policy(has_model: Column, never: Column, fired: Column) -> Column:
    """Without a model the last word is always taken as complete, unless never is set; with one, by the model."""
    return F.when(never, F.lit(False)).when(~has_model, F.lit(True)).otherwise(fired)


def pcm16(a: Column | str) -> Column:
    return F.transform(col(a), lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x * 32767)).cast("smallint"))


def time_slice(samples: Column | str, begin: Column, end: Column, rate: int = 16000) -> Column:
    first, last = (begin * rate).cast("int"), (end * rate).cast("int")
    return F.slice(col(samples), first + 1, F.greatest(last - first, F.lit(0)))


def cross_entropy(log_probs: Column | str, labels: Column | str, ignore: int = -100) -> Column:
    """Mean negative log probability of the labels, each against the position before it, without ignored ones. log_probs: an
    array of maps or arrays per position is left to the caller; here one number for each position."""
    pairs = F.arrays_zip(F.slice(col(log_probs), F.lit(1), F.greatest(F.size(col(log_probs)) - 1, F.lit(0))).alias("p"), F.slice(col(labels), F.lit(2), F.size(col(labels))).alias("y"))
    kept = F.transform(F.filter(pairs, lambda z: z["y"] != ignore), lambda z: -z["p"])
    return mean(kept)


def dtw_cost(a: Column | str) -> Column:
    """Cost of the best monotone path through a matrix (array of rows), row by row."""
    rows = col(a)

    def row_step(state: Column, row: Column) -> Column:
        """state: costs of the row above, one longer than row; the first is infinite from the second row on."""
        done = F.aggregate(
            F.sequence(F.lit(1), F.size(row)), F.array(F.lit(math.inf)),
            lambda now, j: F.concat(now, F.array(F.element_at(row, j) + F.least(F.element_at(state, j), F.element_at(state, j + 1), F.element_at(now, j)))),
        )
        return done

    first = F.element_at(rows, 1)
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(math.inf), F.size(first)))
    return F.element_at(F.aggregate(rows, start, row_step), -1)


def dtw_path(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the best path. A diagonal step needs to be strictly best, then one down; across otherwise."""
    n, m = cost.shape
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0
    step = np.zeros((n + 1, m + 1), np.int8)
    for d in range(2, n + m + 1):  # anti-diagonals: all cells of one depend on earlier ones only
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        diagonal, down, across = best[i - 1, j - 1], best[i - 1, j], best[i, j - 1]
        choice = np.where((diagonal < down) & (diagonal < across), 0, np.where((down < diagonal) & (down < across), 1, 2))
        best[i, j] = cost[i - 1, j - 1] + np.choose(choice, (diagonal, down, across))
        step[i, j] = choice
    step[0, :], step[:, 0] = 2, 1
    i, j, path = n, m, []
    while i > 0 or j > 0:
        path.append((i - 1, j - 1))
        move = step[i, j]
        i, j = i - (move != 2), j - (move != 1)
    return tuple(np.array(path[::-1]).T)


def dtw_alignment(matrix: Column | str) -> Column:
    """The best path through each matrix, as an array of (row, column)."""

    @F.pandas_udf("array<struct<row:int,column:int>>")
    def align(m: pd.Series) -> pd.Series:
        out = []
        for x in m:
            rows, columns = dtw_path(np.array([list(r) for r in x], float)) if x is not None and len(x) else ((), ())
            out.append([{"row": int(a), "column": int(b)} for a, b in zip(rows, columns, strict=True)])
        return pd.Series(out)

    return align(col(matrix))


def forbidden_ranges(histories: list[list[int]], size: int, begin: int, end_of_text: int, no_timestamps: int | None, max_initial: int | None) -> np.ndarray:
    """(rows, rules, 2): for each history and rule the range of ids that must not come next; empty where the rule doesn't apply."""
    recent = np.array([([-1, -1] + h[-2:])[-2:] for h in histories], np.int64).reshape(-1, 2)
    length = np.array([len(h) for h in histories])
    latest = np.array([max((k for k, t in enumerate(h) if t >= begin), default=-1) for h in histories])
    stamp = np.array([h[k] if k >= 0 else begin - 1 for h, k in zip(histories, latest, strict=True)])
    ends_in_time = recent[:, 1] >= begin
    closes_a_pair = (length < 2) | (recent[:, 0] >= begin)
    opens_a_pair = ends_in_time & ~closes_a_pair
    rules = [  # (where it applies, first id, id after the last)
        (np.full(len(histories), no_timestamps is not None), no_timestamps or 0, (no_timestamps or 0) + 1),
        (ends_in_time & closes_a_pair, begin, size),  # a closed pair goes on with text
        (opens_a_pair, 0, end_of_text),  # an open one with a time, or the end
        (latest >= 0, begin, np.where(opens_a_pair, stamp, stamp + 1)),  # times don't go back, and stay only to close a pair
        (length == 0, 0, begin),  # a time comes first,
        (np.full(len(histories), max_initial is not None) & (length == 0), begin + (max_initial or 0) + 1, size),  # and an early one
    ]
    return np.stack([np.stack([np.where(on, lo, 0), np.where(on, hi, 0)], 1) for on, lo, hi in rules], 1)


def timestamp_rules(tokens: Column | str, logits: Column | str, begin: int, end_of_text: int, no_timestamps: int | None = None, max_initial: int | None = None) -> Column:
    """Logits after the rules for timestamp tokens (ids from begin on): they come in pairs but before the end, never go back, come first, and
    win if their joint probability is above that of every other token. A table of ranges for a whole batch of histories at once."""

    def apply(histories: list[list[int]], x: np.ndarray) -> np.ndarray:
        ids = np.arange(x.shape[1])
        ranges = forbidden_ranges(histories, x.shape[1], begin, end_of_text, no_timestamps, max_initial)
        x = np.where(((ids >= ranges[:, :, :1]) & (ids < ranges[:, :, 1:])).any(1), -np.inf, x)
        top = x.max(1, keepdims=True)
        shifted = np.exp(x - np.where(np.isfinite(top), top, 0))
        times_win = shifted[:, begin:].sum(1) > shifted[:, :begin].max(1, initial=0.0)
        return np.where(times_win[:, None] & (ids < begin), -np.inf, x)

    @F.pandas_udf("array<double>")
    def rules(t: pd.Series, x: pd.Series) -> pd.Series:
        out, sizes = pd.Series([None] * len(x), dtype=object), x.map(len)
        for size in sizes.unique():
            at = np.flatnonzero(sizes == size)
            for k, row in zip(at, apply([list(t.iloc[k]) for k in at], np.array([x.iloc[k] for k in at], float)), strict=True):
                out.iat[k] = row
        return out

    return rules(col(tokens), col(logits))


def compression_ratio(text: Column | str) -> Column:
    """Bytes over zlib bytes."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield t.map(lambda x: len(raw := x.encode()) / len(zlib.compress(raw)), na_action="ignore")

    return ratio(col(text))


def _resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    if rate == target or not len(x):
        return x
    n = int(round(len(x) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(x)), x).astype(np.float32)


def decode_pcm(content: Column | str) -> Column:
    """Raw signed 16-bit little-endian samples as numbers from -1 to 1."""

    @F.pandas_udf("array<float>")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: np.frombuffer(x[: len(x) // 2 * 2], "<i2").astype(np.float32) / 32768, na_action="ignore")

    return decode(col(content))


def decode_wav(content: Column | str, rate: int = 16000, max_seconds: float | None = None) -> Column:
    """16-bit WAV as mono samples at rate: the mean of up to two channels, or the first of more."""

    def one(raw: bytes) -> np.ndarray:
        with wave.open(io.BytesIO(raw)) as w:
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32).reshape(-1, w.getnchannels()) / 32768
            x = x.mean(1) if x.shape[1] <= 2 else x[:, 0]
            x = _resample(x, w.getframerate(), rate)
        return x if max_seconds is None else x[: int(max_seconds * rate)]

    @F.pandas_udf("array<float>")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(one, na_action="ignore")

    return decode(col(content))


def mel_filters(n_mels: int, n_fft: int = 400, rate: int = 16000) -> np.ndarray:
    """Triangular filters on the Slaney mel scale, each of unit area."""
    knee, log_step = 1000.0, math.log(6.4) / 27
    to_mel = lambda f: np.where(f < knee, f * 3 / 200, 15 + np.log(np.maximum(f, knee) / knee) / log_step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, knee * np.exp((m - 15) * log_step))
    edges = to_hz(np.linspace(0, float(to_mel(np.array(rate / 2))), n_mels + 2))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, n_mels: int = 80, n_fft: int = 400, hop: int = 160) -> np.ndarray:
    """Log-mel spectrogram (mels, frames), clamped to 8 below its top and scaled."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    x = np.pad(samples, n_fft // 2, mode="reflect") if len(samples) > n_fft // 2 else np.pad(samples, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop] * window
    power = np.abs(np.fft.rfft(frames, axis=1))[:-1] ** 2
    logs = np.log10(np.maximum(mel_filters(n_mels, n_fft) @ power.T, 1e-10))
    return (np.maximum(logs, logs.max() - 8) + 4) / 4


def log_mel_column(samples: Column | str, n_mels: int = 80) -> Column:
    @F.pandas_udf("array<array<double>>")
    def spectrum(s: pd.Series) -> pd.Series:
        return s.map(lambda x: log_mel(np.array(x, float), n_mels).tolist(), na_action="ignore")

    return spectrum(col(samples))
