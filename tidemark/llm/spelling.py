"""Spelling variants: words one edit apart, by pigeonholes of even parts (operator 13).

Runs of letters are counted in each text's piece, then over all; the occurrences of a run that its document's id and the run's own crc32 pick lose a letter.
A word of length l is cut evenly in two segments at l // 2. One edit spoils one of them at most, so a word s of length l or l + 1 that is near to
it holds the other one whole, the first at its beginning and the second at its end, moved by the difference in length. That alone would
make all words with one ending candidates of each other, whose number grows with the square of the words; but the same holds within the segment
that is spoiled: one half of it is whole. So an index entry is a segment and a half of the other (four for each word), and words of equal or
greater length by one are looked up with the substrings that lie in these places of theirs. Candidates are verified in the join itself, which
gives near pairs alone, each at the first of the entries that its words share.

A form has at least FACTOR times the occurrences of its word, so chains of forms rise and end; they are followed in doubling steps, for all words at once.

Defined cases: null or empty text has no words; without a doc_id nothing is deleted; rows that repeat a doc_id are each counted; an empty table has no words;
other columns play no part. A pair of words may share all but a quarter with very many others only if these differ in that quarter alone: such words
are compared with one another within tasks, without being returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import distinct_spans, gathered, lower_ascii, owner, pieces, word_spans, written
from tidemark.llm.resample import CRC_TABLE, crc_sql

MIN_POINTS = 5
MIN_COUNT = 3
#: A form has so many times the occurrences of its word.
FACTOR = 2
#: One in so many pairs of a document and a run loses a letter.
EVERY = 97
PIECE = 4 << 20
#: Longer runs than this go through zlib one by one.
LONG_RUN = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32_after(before: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of what has the crc32 before, and then the span, for all spans at once."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size = starts[order], size[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for j in range(min(int(size[0]), LONG_RUN) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, "left"))
        state[:k] = _CRC[(state[:k] ^ buf[at[:k] + j]) & np.uint32(255)] ^ (state[:k] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(int(np.searchsorted(-size, -LONG_RUN, "left"))):
        state[k] = zlib.crc32(buf[at[k] + LONG_RUN : at[k] + size[k]].tobytes(), int(state[k]))
    out = np.empty_like(state)
    out[order] = state
    return out


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of `[A-Za-z\\u00C0-\\u00FF]` in lower-cased bytes: these letters beyond ASCII are the characters that begin with 0xC3."""
    letter = ((buf >= 97) & (buf <= 122)) | (buf == 0xC3)
    letter[1:] |= buf[:-1] == 0xC3
    return word_spans(buf, offsets, letter)


def _counted(ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, min_points: int, every: int) -> tuple[pa.Array, np.ndarray]:
    """(words, occurrences) of a piece of rows, letters deleted; a word may come twice."""
    low = lower_ascii(buf)
    starts, ends = letter_runs(low, offsets)
    points = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))
    enough = points[ends] - points[starts] >= min_points
    starts, ends = starts[enough], ends[enough]
    first, code = distinct_spans(low, starts, ends)
    starts_of, ends_of = starts[first], ends[first]
    row = owner(offsets, starts)
    n = max(len(first), 1)
    pair, times = np.unique(row * n + code, return_counts=True)
    which, code = np.divmod(pair, n)
    before = np.array([0 if x is None else zlib.crc32(b"%d:" % x) for x in ids.to_pylist()], np.int64)
    crc = crc32_after(before[which], low, starts_of[code], ends_of[code])
    hit = (crc % np.uint32(every) == 0) & np.asarray(ids.is_valid())[which]
    left = np.bincount(code[~hit], times[~hit], len(first)).astype(np.int64)
    stay = np.flatnonzero(left)
    cut = []
    for k, h in zip(code[hit].tolist(), crc[hit].tolist(), strict=True):
        run = low[starts_of[k] : ends_of[k]].tobytes().decode()
        at = h % len(run)
        cut.append(run[:at] + run[at + 1 :])
    words = pa.concat_arrays([gathered(low, starts_of[stay], ends_of[stay]), pa.array(cut, pa.large_string())])
    counts = np.concatenate((left[stay], times[hit]))
    long_enough = np.ones(len(words), bool)
    long_enough[len(stay) :] = [len(x) >= min_points for x in cut]
    return words.filter(pa.array(long_enough)), counts[long_enough]


def vocabulary(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the distinct words of all texts with enough letters and occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in pieces(batch.column(1), PIECE):
                words, n = _counted(batch.column(0).slice(lo, hi - lo), buf, offsets, min_points, every)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _entries(word: Column, l: Column, d: Column) -> list[Column]:
    """What a word of length l + d has where one of length l has three of its four quarters: all but the last, the third, the second, the first."""
    h = F.shiftright(l, 1)
    q, p = h + F.shiftright(l - h, 1), F.shiftright(h, 1)
    part = lambda first, end=None: F.substring(word, first + 1, (end - first) if end is not None else l + d - first)
    zero = F.lit(0)
    return [part(zero, q), F.concat(part(zero, h), part(q + d)), F.concat(part(zero, p), part(h + d)), part(p + d)]


def _indexed(words: DataFrame, d: int, name: str) -> DataFrame:
    """A row for each of a word's four entries, for partners shorter by d."""
    l = F.length("word") - d
    keys = F.array(*(F.struct(F.lit(k).alias("c"), F.xxhash64(F.lit(k), l, x).alias("key")) for k, x in enumerate(_entries(F.col("word"), l, F.lit(d)))))
    return words.where(l > 0).select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.inline(keys))


def near_pairs(words: DataFrame) -> DataFrame:
    """(r, n_r, s, n_s): all pairs of words that differ by one inserted, deleted or replaced code point, each once; s isn't shorter than r."""
    index = _indexed(words, 0, "r")
    out = None
    for d in (0, 1):
        probes = _indexed(words, d, "s").withColumnsRenamed({"c": "c_s", "key": "key_s"})
        l = F.length("r")
        mine, theirs = _entries(F.col("r"), l, F.lit(0)), _entries(F.col("s"), l, F.lit(d))
        found = (F.col("key") == F.col("key_s")) & (F.col("c") == F.col("c_s")) & (F.length("s") == l + d)
        if d == 0:
            found &= F.col("r") < F.col("s")
        found &= F.levenshtein(F.col("r"), F.col("s"), 1) == 1
        for k in range(3):  # an earlier entry has the pair
            found &= (F.col("c") <= k) | (mine[k] != theirs[k])
        pairs = index.join(probes, found).select("r", "n_r", "s", "n_s")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def _rooted(forms: DataFrame) -> DataFrame:
    """forms with `root`: pointers are doubled until each points to a word without a form. Counts rise by FACTOR along a chain, so it has 63 links at most."""
    now = written(forms.withColumn("root", F.coalesce("form", "word")))
    while True:
        further = now.where("form IS NOT NULL").select(F.col("word").alias("w"), F.col("root").alias("further"))
        after = now.join(further, now["root"] == further["w"], "left").drop("w")
        after = written(after)
        if not after.where("further IS NOT NULL").limit(1).count():
            return after.drop("further")
        now = after.withColumn("root", F.coalesce("further", "root")).drop("further")


def variants(docs: DataFrame, min_points: int = MIN_POINTS, min_count: int = MIN_COUNT, factor: int = FACTOR, every: int = EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(vocabulary(docs, min_points, min_count, every))
    side = lambda word, near: F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(f"n_{near}").alias("m"))
    both = near_pairs(words).select(F.inline(F.array(side("r", "s"), side("s", "r"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    form_n = -F.col("best")["m"]
    real = form_n >= factor * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(real, F.col("best")["near"]).alias("form"), F.when(real, form_n).alias("form_n"))
    return _rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")


#: For DuckDB. Its levenshtein compares bytes, so letters beyond ASCII are put to unused ones of ASCII first; near words share a form without one letter or as a whole.
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))
_UNUSED = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[: len(_BEYOND)]
ORACLE_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= {MIN_POINTS} GROUP BY doc_id, run),
hashed AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc_sql("(doc_id || ':' || run)")} END AS h FROM runs, crc),
cut AS (SELECT n, CASE WHEN h % {EVERY} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_BEYOND}', '{_UNUSED}') AS x FROM cut WHERE length(word) >= {MIN_POINTS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT word, n, x, unnest(list_append(list_transform(range(1, length(x) + 1), lambda i: x[:i - 1] || x[i + 1:]), x)) AS key FROM words),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b USING (key) WHERE a.word <> b.word AND levenshtein(a.x, b.x) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FACTOR} * w.n THEN other END AS form, CASE WHEN m >= {FACTOR} * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at, form AS further FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.further = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word WHERE c.further IS NULL
"""
