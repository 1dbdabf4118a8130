"""Line dedup (operator 8).

One row for each (key hash, document row) with the lines' positions is range-partitioned by hash and document, largest document first, and
sorted by document and position within. Each partition is streamed: the first document of a hash keeps its lines, later ones lose them, if
enough documents hold it. A hash whose run touches the edge of a partition is left open; the (at most two) open runs of each partition are
counted together, so a line that a third of all documents hold is spread over many tasks. What comes back is not text but a compressed bitmap
of kept lines for each document row that loses any; only texts that may have one meet them, the others never move.

Defined cases: null or empty text is one empty line and loses nothing; a null doc_id neither counts nor loses lines; rows that repeat a doc_id
count as one document, each row keeps or loses its own lines; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import line_spans, lower_ascii, owner, pieces, range_parts, span_hash, word_spans, written

MIN_POINTS = 40
MIN_DOCS = 5
#: Rows of a partition of sorted keys, in the mean.
PART_ROWS = 4_000_000
#: Bits of the filter that says which rows may lose a line: eight for each, from 2^10 to 2^27 in all (16 MB).
FILTER_BITS = (10, 27)
_KEYS = "h1 long, h2 long, doc_id long, row long, n_lines int, lines array<int>"
_FOUND = "kind int, h1 long, h2 long, doc_id long, row long, n_lines int, lines array<int>, lo long, hi long, inner_docs long"


def row_hash() -> Column:
    """Tells the rows of one doc_id apart: equal texts have equal lines, so they may share a bitmap."""
    return F.xxhash64("text")


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def line_keys(buf: np.ndarray, offsets: np.ndarray, min_points: int) -> tuple[np.ndarray, ...]:
    """(row, line number in it, two hashes) of every line whose key has min_points code points."""
    starts, ends, rows = line_spans(buf, offsets)
    first_line = np.searchsorted(rows, np.arange(len(offsets) - 1))
    number = np.arange(len(rows)) - first_line[rows]
    low = lower_ascii(buf)
    word_start, word_end = word_spans(buf, offsets)
    a, b = np.searchsorted(word_start, starts), np.searchsorted(word_start, ends)
    worded = np.flatnonzero(b > a)
    key_start, key_end = word_start[a[worded]], word_end[b[worded] - 1]
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    long_enough = points[key_end] - points[key_start] >= min_points
    worded, key_start, key_end = worded[long_enough], key_start[long_enough], key_end[long_enough]
    return rows[worded], number[worded], span_hash(low, key_start, key_end, 0), span_hash(low, key_start, key_end, 1)


def keyed_lines(docs: DataFrame, min_points: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for lo, hi, buf, offsets in pieces(batch.column(1)):
                row, number, h1, h2 = line_keys(buf, offsets, min_points)
                order = np.lexsort((number, h2, h1, row))
                row, number, h1, h2 = row[order], number[order], h1[order], h2[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                at = np.flatnonzero(new)
                breaks = np.bincount(owner(offsets, np.flatnonzero(buf == 10)), minlength=hi - lo)
                columns = [pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)), pa.array(ids[lo:hi][row[at]], pa.int64()), pa.array(rows[lo:hi][row[at]], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(breaks[row[at]] + 1, pa.int32()), _lists(number, np.append(at, len(row)))], names=["h1", "h2", "doc_id", "row", "n_lines", "lines"])

    return docs.select("doc_id", "text", row_hash().alias("row")).where("doc_id IS NOT NULL").mapInArrow(work, _KEYS)


class _Run:
    """The run of one key that is being read: what has come of it, and what of that hasn't gone out yet."""

    def __init__(self, key: tuple[int, int], first: int, at_edge: bool):
        self.key, self.first, self.at_edge = key, first, at_edge
        self.last, self.docs, self.held = None, 0, []

    def add(self, part: pa.RecordBatch, doc: np.ndarray) -> None:
        self.docs += int((doc[1:] != doc[:-1]).sum()) + (self.last is None or int(doc[0]) != self.last)
        self.last = int(doc[-1])
        if not self.at_edge:  # the largest document's rows stay
            part = part.filter(pa.array(doc != self.first))
        self.held.append(part)


def _stream(min_docs: int):
    """kind 0: lines that are lost; kind 1: rows of a run that touches an edge of its partition; kind 2: such a run's summary.

    No run is held whole: as soon as enough documents have come, or if it began at the partition's edge, its rows go out."""
    schema = pa.schema([("kind", pa.int32()), *((x, pa.int64()) for x in ("h1", "h2", "doc_id", "row")), ("n_lines", pa.int32()), ("lines", pa.list_(pa.int32())), *((x, pa.int64()) for x in ("lo", "hi", "inner_docs"))])

    def rows(kind: int, part: pa.RecordBatch) -> pa.RecordBatch:
        n = len(part)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(part.column(k) for k in range(5)), part.column(5).cast(pa.list_(pa.int32())), *(pa.nulls(n, pa.int64()) for _ in range(3))], schema=schema)

    def release(run: _Run, at_end: bool) -> Iterator[pa.RecordBatch]:
        """The rows held, for a run that is open, known to be common, or over. One that began inside the partition has met its largest document."""
        if run.at_edge or (at_end and run.docs < min_docs):
            yield from (rows(1, x) for x in run.held)
        elif run.docs >= min_docs:
            yield from (rows(0, x) for x in run.held)
        run.held = []

    def summary(run: _Run) -> pa.RecordBatch:
        one = {"kind": 2, "h1": run.key[0], "h2": run.key[1], "lo": run.last, "hi": run.first, "inner_docs": max(0, run.docs - 1 - (run.first != run.last))}
        return pa.RecordBatch.from_pylist([one], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        for batch in batches:
            if not len(batch):
                continue
            h1, h2, doc = (np.asarray(batch.column(k)) for k in range(3))
            new = np.ones(len(doc), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            begins = np.append(np.flatnonzero(new), len(doc))
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            counts = np.add.reduceat(fresh, begins[:-1], dtype=np.int64)
            n_runs = len(begins) - 1
            k = 0
            if run is not None and run.key == (int(h1[0]), int(h2[0])):
                run.add(batch.slice(0, begins[1]), doc[: begins[1]])
                k = 1
            if k < n_runs:
                if run is not None:  # ended inside the partition
                    yield from release(run, run.at_edge)
                    if run.at_edge:
                        yield summary(run)
                elif n_runs > 1:  # the partition's first run
                    first = _Run((int(h1[0]), int(h2[0])), int(doc[0]), True)
                    first.add(batch.slice(0, begins[1]), doc[: begins[1]])
                    yield from release(first, True)
                    yield summary(first)
                    k = 1
                if k < n_runs - 1:  # these begin and end inside the batch
                    each = np.repeat(np.arange(n_runs), np.diff(begins))
                    lost = (each >= k) & (each < n_runs - 1) & (counts[each] >= min_docs) & (doc != doc[begins[:-1]][each])
                    if lost.any():
                        yield rows(0, batch.filter(pa.array(lost)))
                at = int(begins[n_runs - 1])
                run = _Run((int(h1[at]), int(h2[at])), int(doc[at]), run is None and n_runs == 1)
                run.add(batch.slice(at), doc[at:])
            if run.at_edge or run.docs >= min_docs:
                yield from release(run, False)
        if run is not None:
            yield from release(run, True)
            yield summary(run)

    return work


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, row, n_lines, n_dropped, keep_bitmap) of the document rows that lose lines, and of no others. row: see row_hash."""
    keys = written(keyed_lines(docs, min_points))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    ordered = keys.repartitionByRange(range_parts(keys, PART_ROWS), *order).sortWithinPartitions(*order, "lines")
    found = written(ordered.mapInArrow(_stream(min_docs), _FOUND))
    # At most two open runs for each partition, however large the input is.
    runs = found.where("kind = 2").groupBy("h1", "h2").agg(
        (F.sum("inner_docs") + F.size(F.array_distinct(F.flatten(F.collect_list(F.array("lo", "hi")))))).alias("n_docs"), F.max("hi").alias("keeper")
    ).where(F.col("n_docs") >= min_docs)
    still = found.where("kind = 1").join(F.broadcast(runs), ["h1", "h2"]).where("doc_id <> keeper")
    lost = found.where("kind = 0").select("doc_id", "row", "n_lines", "lines").unionByName(still.select("doc_id", "row", "n_lines", "lines"))
    merged = lost.groupBy("doc_id", "row", "n_lines").agg(F.flatten(F.collect_set("lines")).alias("lines"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [bitmap(n, lines) for n, lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            n_dropped = pa.array(np.asarray(batch.column(3).value_lengths()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), n_dropped, pa.array(maps, pa.binary())], names=["doc_id", "row", "n_lines", "n_dropped", "keep_bitmap"])

    return merged.mapInArrow(work, "doc_id long, row long, n_lines long, n_dropped long, keep_bitmap binary")


def bitmap(n_lines: int, lost: list[int]) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[lost] = False
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def kept_lines(n_lines: int, packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines).astype(bool)


def apply_bitmap(text: str | None, packed: bytes | None) -> str:
    text = text or ""
    if packed is None:
        return text
    lines = text.split("\n")
    return "\n".join(x for x, stays in zip(lines, kept_lines(len(lines), packed), strict=True) if stays)


def _may_lose(docs: DataFrame, maps: DataFrame) -> Column:
    """Is a row's hash in a filter of those of maps? A row that isn't loses nothing; with more rows than the filter has room for, more of the
    others are taken for such that may. The filter's size, and so what is sent to the driver and to the workers, is bounded."""
    bits = min(max((8 * maps.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << bits))
    words = maps.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("b")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def hit(s: pd.Series) -> pd.Series:
        at = s.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return hit(F.pmod(F.xxhash64("doc_id", row_hash()), F.lit(1 << bits)))


def _parted(docs: DataFrame, min_docs: int = MIN_DOCS, min_points: int = MIN_POINTS) -> tuple[DataFrame, DataFrame, str]:
    """(rows that surely lose nothing, the others with their bitmaps or null, the bitmaps' column)."""
    taken = {c.lower() for c in docs.columns}
    name = next(x for k in range(len(taken) + 1) if (x := f"keep_bitmap_{k}") not in taken)
    maps = written(keep_bitmaps(docs, min_docs, min_points))
    may = F.coalesce(_may_lose(docs, maps), F.lit(False))
    marked = docs.withColumn(name, may)
    # Bitmaps grow with the documents, so they are merged, never broadcast.
    found = maps.select(F.col("doc_id").alias(f"{name}_d"), F.col("row").alias(f"{name}_r"), F.col("keep_bitmap").alias(f"{name}_m")).hint("merge")
    texts = marked.where(F.col(name)).select(*docs.columns)
    met = texts.join(found, (texts["doc_id"] == found[f"{name}_d"]) & (F.xxhash64(texts["text"]) == found[f"{name}_r"]), "left").select(*docs.columns, F.col(f"{name}_m").alias(name))
    return marked.where(~F.col(name)).select(*docs.columns), met, name


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: from the text alone where nothing is lost, else from the document's bitmap."""
    still, met, name = _parted(docs.select("doc_id", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            n_lines = [(t or "").count("\n") + 1 for t, _ in rows]
            n_dropped = [0 if m is None else n - int(kept_lines(n, m).sum()) for n, (_, m) in zip(n_lines, rows, strict=True)]
            sha = [hashlib.sha256(apply_bitmap(t, m).encode()).hexdigest() for t, m in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    whole = still.select("doc_id", n_lines.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))
    return whole.unionByName(met.select("doc_id", "text", name).mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with all its columns, each text without its lost lines."""
    still, met, _ = _parted(docs)
    at, last = docs.columns.index("text"), len(docs.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if m is None else apply_bitmap(t, m) for t, m in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)]
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:last])

    return still.unionByName(met.mapInArrow(work, docs.schema))


#: For DuckDB, over whole documents.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS stripped
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT d.doc_id, count(*) AS n_lines, count(c.k) FILTER (WHERE d.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(d.line, chr(10) ORDER BY d.pos) FILTER (WHERE c.k IS NULL OR d.doc_id = c.keeper), '')) AS kept_sha256
FROM keyed d LEFT JOIN common c ON d.k = c.k GROUP BY d.doc_id
"""
