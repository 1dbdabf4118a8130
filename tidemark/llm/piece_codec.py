"""SentencePiece encoding and decoding by suffix-array matching (operator 4).

The distinct spans of a batch (a span ends where no piece can go on) are concatenated and indexed by a suffix array,
built by prefix doubling up to the longest piece. Binary search finds each piece's range of suffixes; the occurrences
are edges, sorted by position and relaxed. The model is a BPE model, so an edge is taken if its piece agrees with the
last piece before it (see piece_bpe), which gives the library's encoding; characters in no piece become byte pieces.

Defined cases: null or empty text has no ids and decodes to the empty text; a null doc_id is passed through; repeated
rows are encoded each for itself; other columns play no part. A text that holds the space mark U+2581 itself decodes
with spaces in its place, as with the library, and so isn't equal to what it decodes to.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import piece_bpe
from tidemark.llm.common import pieces
from tidemark.llm.spans_table import SpanTable, space_spans
from tidemark.llm.token_counts import _marked


def suffix_array(chars: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first depth characters at least, by prefix doubling."""
    _, rank = np.unique(chars, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order, k = np.argsort(rank), 1
    while k < depth:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:]
        keys = rank * (len(rank) + 2) + after
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty_like(rank)
        rank[order] = 1 + np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank.max() == len(rank):
            break
        k *= 2
    return order


def _ranges(chars: np.ndarray, order: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of table (a piece's characters, 0 beyond its length) its range in the suffix array: two binary searches
    for all pieces at once."""
    padded = np.concatenate((chars, np.zeros(table.shape[1], np.int64)))
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), len(order))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            sign, open_ = np.zeros(len(table), np.int64), np.ones(len(table), bool)
            for k in range(table.shape[1]):
                open_ &= (lengths > k) & (sign == 0)
                if not open_.any():
                    break
                d = padded[at + k] - table[:, k]
                sign = np.where(open_, np.sign(d), sign)
            right = (sign < 0) | upper & (sign == 0)
            going = lo < hi
            lo, hi = np.where(going & right, mid + 1, lo), np.where(going & ~right, mid, hi)
        bounds.append(lo)
    return bounds[0], bounds[1]


@functools.lru_cache(2)
def _piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = piece_bpe.vocabulary(path)
    texts, ids = list(v.ids), np.array(list(v.ids.values()))
    table = np.zeros((len(texts), v.longest), np.int64)
    for k, text in enumerate(texts):
        table[k, : len(text)] = list(map(ord, text))
    return table, np.array(list(map(len, texts))), ids


def suffix_edges(path: str, chars: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, piece) of every piece that occurs within a span; relax() sorts them by position in the span."""
    table, lengths, ids = _piece_table(path)
    order = suffix_array(chars, table.shape[1])
    lo, hi = _ranges(chars, order, table, lengths)
    counts = hi - lo
    which = np.repeat(np.arange(len(ids)), counts)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at, size = order[lo[which] + inner], lengths[which]
    inside = at + size <= limit[at]
    return at[inside], size[inside], ids[which[inside]]


#: New spans are indexed together up to so many bytes.
INDEXED_BYTES = 256 << 10


@functools.lru_cache(2)
def _table(path: str) -> SpanTable:
    return SpanTable(250_000)


def encode_rows(path: str, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each row)."""
    v, table = piece_bpe.vocabulary(path), _table(path)
    starts, ends, rows, leads = space_spans(buf, offsets, after_any=True)

    def missing(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars, first, limit = piece_bpe.span_chars(buf, starts[which], ends[which], leads[which])
        count, last, step = piece_bpe.relax(v, chars, first, suffix_edges(path, chars, limit))
        return piece_bpe.backtrack(v, chars, first, last, step, count)

    at = table.resolve(buf, starts, ends, leads, lambda which: piece_bpe.in_turn(which, ends - starts, missing, INDEXED_BYTES))
    ids, which = table.expand(at)
    return ids.astype(np.int64), np.bincount(rows[which], minlength=len(offsets) - 1)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, ids). No shuffle."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in pieces(_marked(batch.column(1)), 3 << 19):
                ids, sizes = encode_rows(path, buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], names=["doc_id", "text", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, text string, ids array<int>")


@functools.lru_cache(2)
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in one buffer, their starts and sizes."""
    v = piece_bpe.vocabulary(path)
    raw = [p.replace(piece_bpe.SPACE, " ").encode() for p in v.pieces]
    for value, k in enumerate(v.byte_ids.tolist()):
        raw[k] = bytes([value])
    for k in range(len(raw)):
        if v.processor.is_control(k):
            raw[k] = b""
    sizes = np.array(list(map(len, raw)))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_rows(path: str, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The texts of rows of ids: their pieces' bytes, without the one space that encoding puts first."""
    data, at, width = _decoder(path)
    each = width[ids]
    which = np.repeat(np.arange(len(ids)), each)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    raw = data[at[ids][which] + inner].tobytes()
    upto = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(sizes)))]
    texts = (raw[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
    return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in texts]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The query's columns: (doc_id, n_tokens, ids_crc32, decoded_equal), the crc over little-endian 32-bit ids."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = _marked(batch.column(1))
            changed = ~np.asarray(pa.compute.equal(marked, batch.column(1).cast(pa.large_string())).fill_null(True))
            for lo, hi, buf, offsets in pieces(marked, 3 << 19):
                ids, sizes = encode_rows(path, buf, offsets)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                narrow = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(narrow[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                raw = buf.tobytes()
                again = zip(decode_rows(path, ids, sizes), offsets[:-1].tolist(), offsets[1:].tolist(), changed[lo:hi].tolist(), strict=True)
                same = [not other and x.encode() == raw[a:b] for x, a, b, other in again]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_equal"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_crc32 long, decoded_equal boolean")
