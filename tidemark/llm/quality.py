"""Quality rules from repetition coverage (operator 2).

Word and line hashes come from one prefix sum over the bytes of a batch; rolling hashes over the word hashes give the
n-grams of several lengths, and a sort finds those that a document holds twice. What counts is the share of a
document's word characters inside duplicated n-grams, and inside lines that equal an earlier line.

Defined cases: null or empty text has no words and fails the base rule; a null doc_id is passed through; repeated
rows are judged each for itself; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import line_spans, mix, owner, pieces, rolling, span_hash, word_spans

#: n-gram length in words -> largest share of word characters inside n-grams found twice or more.
MAX_SHARE = {5: 0.40, 7: 0.35, 10: 0.30}
#: Largest share of word characters in lines equal to an earlier line.
MAX_LINE_SHARE = 0.30
#: Most symbols for each word.
MAX_SYMBOLS_PER_WORD = 0.4
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup5 double, dup7 double, dup10 double, dup_line double"


def _covered(hashes: np.ndarray, docs: np.ndarray, n: int, possible: np.ndarray | None) -> np.ndarray:
    """Which words lie in an n-word window that its document holds twice or more."""
    size = len(hashes)
    covered = np.zeros(size, bool)
    if size < n:
        return covered
    inside = docs[: size - n + 1] == docs[n - 1 :]
    if possible is not None:  # every shorter window within a repeated one repeats as well
        run = np.concatenate(([0], np.cumsum(possible)))
        inside &= (run[n:] - run[:-n]) == n
    at = np.flatnonzero(inside)
    if len(at) < 2:
        return covered
    keys = rolling(hashes, n)[at] ^ mix(docs[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = at[twice]
    delta = np.zeros(size + 1, np.int64)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + n, -1)
    return np.cumsum(delta[:-1]) > 0


def measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: the base counts and the shares of characters in repeated n-grams and lines."""
    n = len(offsets) - 1
    starts, ends = word_spans(buf, offsets)
    docs = owner(offsets, starts)
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    per = lambda weights=None, which=docs: np.bincount(which, weights, n)
    hashes = span_hash(buf, starts, ends)
    out = {"n_words": per().astype(np.int64), "word_chars": per(chars).astype(np.int64)}
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[buf])))
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]
    three = _covered(hashes, docs, 3, None)
    out["n_repeat_words"] = per(three).astype(np.int64)
    total = np.maximum(out["word_chars"], 1)
    possible = three
    for length in sorted(MAX_SHARE):
        possible = _covered(hashes, docs, length, possible)
        out[f"dup{length}"] = per(chars * possible) / total
    line_start, line_end, line_doc = line_spans(buf, offsets)
    first, past = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    worded = past > first
    key = span_hash(buf, line_start, line_end) ^ mix(line_doc.astype(np.uint64))
    at = np.flatnonzero(worded)
    _, earliest = np.unique(key[at], return_index=True)
    repeated = np.ones(len(at), bool)
    repeated[earliest] = False
    again = at[repeated]
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    upto = np.concatenate(([0], np.cumsum(chars)))
    out["dup_line"] = np.bincount(line_doc[again], (upto[past] - upto[first])[again], n) / total
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = ~failed & (m["dup_line"] <= MAX_LINE_SHARE) & (m["n_symbols"] <= MAX_SYMBOLS_PER_WORD * m["n_words"])
    for length, most in MAX_SHARE.items():
        kept &= m[f"dup{length}"] <= most
    return failed, kept


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buf, offsets in pieces(batch.column(1)):
            m = measure(buf, offsets)
            failed, kept = verdict(m)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            shares = ["dup5", "dup7", "dup10", "dup_line"]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *(pa.array(m[k], pa.int64()) for k in names), pa.array(failed), pa.array(kept), *(pa.array(m[k], pa.float64()) for k in shares)], names=["doc_id", *names, "base_failed", "kept", *shares])


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: counts, shares, base_failed and kept. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_judge, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass the rules."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [verdict(measure(buf, offsets))[1] for _, _, buf, offsets in pieces(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(parts) if parts else np.zeros(0, bool)))

    return docs.mapInArrow(work, docs.schema)


def _oracle_sql() -> str:
    lengths = (3, *sorted(MAX_SHARE))
    windows = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, unnest(range(1, len(w) - {n} + 2)) AS i, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS s FROM words WHERE len(w) >= {n}" for n in lengths)
    shares = ", ".join(f"coalesce(sum(length(x)) FILTER (WHERE n = {n}), 0) AS c{n}" for n in MAX_SHARE)
    out = ", ".join(f"coalesce(c{n}, 0) / greatest(word_chars, 1) AS dup{n}" for n in MAX_SHARE)
    within = " AND ".join(f"dup{n} <= {most}" for n, most in MAX_SHARE.items())
    return rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words),
windows AS ({windows}),
twice AS (SELECT doc_id, n, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, s) AS times FROM windows) WHERE times > 1),
covered AS (SELECT DISTINCT doc_id, n, pos FROM (SELECT doc_id, n, unnest(range(i, i + n)) AS pos FROM twice)),
spread AS (SELECT doc_id, count(*) FILTER (WHERE n = 3) AS n_repeat_words, {shares} FROM covered JOIN places p USING (doc_id) WHERE p.i = covered.pos GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM words)),
again AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
repeated AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_chars FROM again WHERE again GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM words),
measured AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
  {out}, coalesce(dup_chars, 0) / greatest(word_chars, 1) AS dup_line FROM base b LEFT JOIN spread USING (doc_id) LEFT JOIN repeated USING (doc_id))
SELECT *, NOT base_failed AND dup_line <= {MAX_LINE_SHARE} AND n_symbols <= {MAX_SYMBOLS_PER_WORD} * n_words AND {within} AS kept FROM measured
"""


#: For DuckDB, over whole documents.
ORACLE_SQL = _oracle_sql()
