"""Token counts (operator 10): exact counts at every prefix.

The text is cut where no piece can span (before the first of a run of spaces). For each distinct span the dynamic
program of piece_bpe gives the token count of every prefix of it, and sums over the spans give the count of every prefix of the
text. They are stored as a table, a compressed run of steps for each document; how many tokens a text or a prefix of it has, and where any
budget ends, is read off the table without encoding again. A longer prefix may have fewer tokens than a shorter one.

Defined cases: null or empty text has 0 bytes, characters and tokens; a null doc_id is passed through; repeated rows are counted
each for itself; other columns play no part.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import piece_bpe
from tidemark.llm.common import pieces, written
from tidemark.llm.spans_table import SpanTable, space_spans

LIMIT = 4096
MARK = piece_bpe.SPACE.encode()


@functools.lru_cache(2)
def _table(path: str) -> SpanTable:
    return SpanTable()


def _span_counts(path: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[SpanTable, np.ndarray, np.ndarray]:
    """Table entries of the spans of a piece of rows, and their rows. Entries: token counts of the span's prefixes of 1, 2, ... characters."""
    v, table = piece_bpe.vocabulary(path), _table(path)
    starts, ends, rows, leads = space_spans(buf, offsets, after_any=True)

    def missing(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars, first, limit = piece_bpe.span_chars(buf, starts[which], ends[which], leads[which])
        count, _, _ = piece_bpe.relax(v, chars, first, piece_bpe.trie_edges(v, chars, limit))
        keep = np.ones(len(count), bool)
        keep[first[:-1] + np.arange(len(which))] = False
        return np.diff(first), count[keep]

    at = table.resolve(buf, starts, ends, leads, lambda which: piece_bpe.in_turn(which, ends - starts, missing))
    return table, at, rows


def _marked(column: pa.Array) -> pa.Array:
    """Texts that hold the space mark itself mean a space by it."""
    return pa.compute.replace_substring(column.cast(pa.large_string()), piece_bpe.SPACE, " ")


def _totals(table: SpanTable, at: np.ndarray) -> np.ndarray:
    return table.values[table.at[at] + table.size[at] - 1].astype(np.int64) if len(at) else np.zeros(0, np.int64)


def _row_counts(path: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sizes): token counts of the prefixes of 1, 2, ... characters of each row, one after the other, and their numbers."""
    n = len(offsets) - 1
    table, at, rows = _span_counts(path, buf, offsets)
    totals = _totals(table, at)
    upto = np.cumsum(totals) - totals
    values, which = table.expand(at)
    first = np.searchsorted(rows, rows)  # each span's first span of the row
    counts = values.astype(np.int64) + (upto - upto[first])[which] if len(at) else np.zeros(0, np.int64)
    row = rows[which]
    lead = np.ones(len(row), bool)  # a row's first value counts the mark that it got alone
    lead[1:] = row[1:] != row[:-1]
    return counts[~lead], np.bincount(row[~lead], minlength=n)


def pack_counts(counts: np.ndarray) -> bytes:
    """Steps between the counts of prefixes of 0, 1, 2, ... characters, compressed: a byte each, or four where one of them needs it."""
    steps = np.diff(counts, prepend=0)
    narrow = len(steps) == 0 or (int(steps.min()) >= -128 and int(steps.max()) <= 127)
    return (b"1" if narrow else b"4") + zlib.compress(steps.astype("<i1" if narrow else "<i4").tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    steps = np.frombuffer(zlib.decompress(packed[1:]), "<i1" if packed[:1] == b"1" else "<i4")
    return np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, prefix_counts): the exact token count of every prefix of every text. No shuffle."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            for lo, hi, buf, offsets in pieces(_marked(batch.column(1)), 2 << 20):
                counts, sizes = _row_counts(path, buf, offsets)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                packed = [pack_counts(counts[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n_tokens = np.where(sizes > 0, np.append(counts, 0)[np.maximum(cuts[1:] - 1, 0)], 0)
                columns = [batch.column(0).slice(lo, hi - lo), n_bytes.slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix_counts"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_counts binary")


def within_budget(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) of a prefix table, without its texts: limit_chars is the longest prefix of at most
    limit tokens, null if the whole text is within it. A stored table answers any budget."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [None if x is None else int(np.flatnonzero(unpack_counts(x) <= limit)[-1]) for x in batch.column(3).to_pylist()]
            over = pa.compute.greater(batch.column(2), pa.scalar(limit, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], over, pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    needed = F.when(F.col("n_tokens") > limit, F.col("prefix_counts")).alias("prefix_counts")
    return table.select("doc_id", "n_bytes", "n_tokens", needed).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def truncated(table: DataFrame, n_chars: str) -> DataFrame:
    """table with `truncated_tokens`: the tokens of each text's first n_chars (a column) characters, or of all of it if it is shorter; null for null."""

    @F.pandas_udf("long")
    def at(packed: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) else int((c := unpack_counts(x))[min(max(int(k), 0), len(c) - 1)]) for x, k in zip(packed, n, strict=True)], dtype="Int64")

    return table.withColumn("truncated_tokens", at("prefix_counts", n_chars))


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """within_budget() of the documents' prefix table, which is stored first."""
    return within_budget(written(prefix_table(docs, path)), limit)


def total_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) alone, for those who need no prefixes. No shuffle."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in pieces(_marked(batch.column(1)), 2 << 20):
                table, at, rows = _span_counts(path, buf, offsets)
                n_tokens = np.bincount(rows, _totals(table, at), hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_tokens)], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long")


def prefix_counts(texts: list[str], path: str | None = None) -> list[np.ndarray]:
    """For each text the token count of each of its prefixes of 0, 1, 2, ... characters."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    out = []
    for _, _, buf, offsets in pieces(_marked(pa.array(texts, pa.string()))):
        counts, sizes = _row_counts(path, buf, offsets)
        out += [np.concatenate(([0], x)) for x in np.split(counts, np.cumsum(sizes)[:-1])]
    return out
