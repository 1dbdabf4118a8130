"""Benchmark decontamination by winnowing (operator 11).

A window is WINDOW consecutive words of an item; an item of fewer words is one window as a whole. Of the six hashes of five words in a window the
smallest (of equals the last) is the window's fingerprint, so any WINDOW words that a document shares with an item have the same fingerprint
at the same place in both: no shared window can be missed, and neighbouring windows mostly share theirs. A window of fewer words is its own
fingerprint. Documents are read once. A fingerprint that a bitmap of the benchmark's fingerprints doesn't know is let go, and so are all windows
about it; the others are extended to their windows, which are joined with those of the benchmark by fingerprint and by the content
of the whole window. A fingerprint in many items therefore meets one row for each content at most, however common it is.

Items of a window aren't listed for each document: windows that the same items hold are of one class, documents have sets of classes,
and each distinct set is resolved to its items once.

Words are told apart by two 64-bit hashes of each window. The bitmaps' size is bounded: a benchmark too large for them makes them let more
through, and the join does the rest. Nothing else is broadcast but what Spark finds to be below its own threshold.

Defined cases: null or empty text has no words and is neither hit nor contaminating; rows that repeat a doc_id, and those without one, are judged each for
itself; rows that repeat an item_id are one item with the windows of all of them; a null item_id is an item whose id is the empty
string; without documents, or with an empty benchmark, no row or no hit comes out; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import IS_ALNUM, lower_ascii, owner, pieces, rolling, span_hash, word_spans, written

WINDOW = 10
#: Words of a fingerprint; a window keeps the smallest of WINDOW - GRAM + 1.
GRAM = 5
#: Bits of a bitmap: 16 for each of its members, from 2^10 to 2^27 in all (16 MB).
BITMAP_BITS = (10, 27)
_KEY = ("n", "fp", "h1", "h2")
_FOUND = "row long, doc_id long, n_words long, found array<struct<n:int,fp:long,h1:long,h2:long,at:array<int>>>"


class _Words:
    """Words of a piece of rows, with two hashes of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = lower_ascii(buf)
        starts, ends = word_spans(low, offsets, IS_ALNUM[low])
        self.row = owner(offsets, starts)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.hashes = span_hash(low, starts, ends, 0), span_hash(low, starts, ends, 1)

    def inside(self, n: int) -> np.ndarray:
        """Which n consecutive words are of one row, by their first word."""
        return self.row[: max(0, len(self.row) - n + 1)] == self.row[n - 1 :]

    def grams(self, n: int, which: int = 0) -> np.ndarray:
        return rolling(self.hashes[which], n) if len(self.row) >= n else np.zeros(0, np.uint64)

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the fingerprint of the window of n words at each word; n is WINDOW or less."""
        if n < WINDOW:
            grams = self.grams(n)
            return np.arange(len(grams)), grams
        grams = self.grams(GRAM)
        size = max(0, len(self.row) - WINDOW + 1)
        least, place = grams[:size].copy(), np.arange(size)
        for k in range(1, WINDOW - GRAM + 1):
            other = grams[k : k + size]
            better = other <= least
            least[better], place[better] = other[better], np.flatnonzero(better) + k
        return place, least


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def item_windows(items: DataFrame) -> DataFrame:
    """(item, n, fp, h1, h2): the distinct windows of each item, with their length, fingerprint and content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offsets in pieces(batch.column(1)):
                w = _Words(buf, offsets)
                size = np.diff(w.first)
                for n in range(1, WINDOW + 1):
                    at = np.flatnonzero(w.inside(n))
                    at = at[size[w.row[at]] == n] if n < WINDOW else at
                    if len(at):
                        _, fp = w.fingerprints(n)
                        item = batch.column(0).take(pa.array(lo + w.row[at]))
                        yield pa.RecordBatch.from_arrays([item, pa.array(np.full(len(at), n, np.int32)), *(_signed(x[at]) for x in (fp, w.grams(n), w.grams(n, 1)))], names=["item", *_KEY])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return items.select(item, "text").mapInArrow(work, "item string, n int, fp long, h1 long, h2 long").distinct()


def _bitmap(table: DataFrame, column: str, n_rows: int) -> Broadcast:
    """The leading bits of a column's hashes, as a bitmap whose size is bounded. Words of it come from all tasks, at most 2^21 of them."""
    bits = min(max((16 * n_rows).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    slot = F.shiftrightunsigned(column, 64 - bits)
    words = table.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 AS int))")).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return table.sparkSession.sparkContext.broadcast(out)


def _known(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - 6 - (len(bitmap) - 1).bit_length())).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63) & 1).astype(bool)


def _candidates(w: _Words, lengths: list[int], prints: np.ndarray, contents: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first word, n, fp, h1, h2) of the windows whose fingerprint and content the bitmaps know."""
    out = []
    for n in lengths:
        place, fp = w.fingerprints(n)
        inside = w.inside(n)
        chosen = np.zeros(len(w.row), bool)
        chosen[place[inside]] = True  # each fingerprint is looked up once for all windows about it
        kept = np.flatnonzero(chosen)
        chosen[kept] = _known(prints, w.grams(min(n, GRAM) if n == WINDOW else n)[kept])
        at = np.flatnonzero(inside & chosen[place])
        if len(at):
            h1 = w.grams(n)[at]
            real = _known(contents, h1)
            at, h1 = at[real], h1[real]
            out.append((at, np.full(len(at), n, np.int32), fp[at], h1, w.grams(n, 1)[at]))
    if not out:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int32), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _found(docs: DataFrame, lengths: list[int], prints: Broadcast, contents: Broadcast) -> DataFrame:
    """One row for each row of docs, with its windows that may be of the benchmark: each distinct one once, with its places."""
    kind = pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in pieces(batch.column(2)):
                w = _Words(buf, offsets)
                at, n, fp, h1, h2 = _candidates(w, lengths, prints.value, contents.value)
                row = w.row[at]
                order = np.lexsort((at, h2, h1, n, row))
                at, n, fp, h1, h2, row = (x[order] for x in (at, n, fp, h1, h2, row))
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (n[1:] != n[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                begins = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)), pa.int32()), pa.array(at - w.first[row], pa.int32()))
                each = pa.StructArray.from_arrays([pa.array(n[begins]), _signed(fp[begins]), _signed(h1[begins]), _signed(h2[begins]), places], fields=list(kind))
                cuts = pa.array(np.searchsorted(row[begins], np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(w.first), pa.int64()), pa.ListArray.from_arrays(cuts, each)], names=["row", "doc_id", "n_words", "found"])

    # The row's number is stored with what is found, so it stays what it is if a task runs again.
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(work, _FOUND)


def _results(docs: DataFrame, items: DataFrame, of_items: dict[str, Column], of_none: dict[str, Column]) -> DataFrame:
    """(doc_id, n_words, n_hit, spans) and the columns of_items, which are made of `items`, the sorted ids of a set of items."""
    windows = written(item_windows(items))
    order = [F.bit_xor(F.xxhash64("item", F.lit(k))).alias(f"c{k}") for k in (1, 2)]
    contents = written(windows.groupBy(*_KEY).agg(F.count("*").alias("c0"), *order).select(*_KEY, F.struct("c0", "c1", "c2").alias("class")))
    # Lengths are ten at most.
    sizes = {r["n"]: r["count"] for r in contents.groupBy("n").count().collect()}
    found = written(_found(docs, sorted(sizes), _bitmap(contents, "fp", sum(sizes.values())), _bitmap(contents, "h1", sum(sizes.values()))))
    few = found.where(F.size("found") > 0).select("row", "doc_id", "n_words", F.inline("found")).join(contents, list(_KEY), "left")
    span = F.transform("at", lambda p: F.struct(p.alias("first"), (p + F.col("n")).alias("end")))
    spans = F.flatten(F.collect_list(F.when(F.col("class").isNotNull(), span)))
    hit = written(_merged(few.groupBy("row", "doc_id", "n_words").agg(spans.alias("spans"), F.array_sort(F.collect_set("class")).alias("classes"))))
    # A class's items are those of any one of its windows.
    one = contents.groupBy("class").agg(F.min(F.struct(*_KEY)).alias("w")).select("class", "w.*")
    members = windows.join(one, list(_KEY)).select("class", "item")
    sets = hit.where(F.size("classes") > 0).select("classes").distinct()
    listed = sets.select("classes", F.explode("classes").alias("class")).join(members, "class").groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    resolved = listed.select("classes", *(c.alias(k) for k, c in of_items.items()))
    none = [c.alias(k) for k, c in of_none.items()]
    met = hit.join(resolved, "classes", "left").select("doc_id", "n_words", "n_hit", "spans", *(F.coalesce(F.col(k), of_none[k]).alias(k) for k in of_items))
    clean = found.where(F.size("found") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(hit.schema["spans"].dataType).alias("spans"), *none)
    return met.unionByName(clean)


def _merged(hit: DataFrame) -> DataFrame:
    """hit with n_hit, and with each run of overlapping or touching spans of a row as one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("spans")
            spans = batch.column(at)
            row = np.repeat(np.arange(len(batch)), np.asarray(spans.value_lengths(), np.int64))
            each = spans.flatten()
            first, end = (np.asarray(each.field(k), np.int64) for k in (0, 1))
            order = np.lexsort((end, first, row))
            row, first, end = row[order], first[order], end[order]
            apart = row * (1 << 32)  # no span of a row touches one of the next
            upto = np.maximum.accumulate(end + apart) if len(row) else end
            new = np.ones(len(row), bool)
            new[1:] = (first + apart)[1:] > upto[:-1]
            begins = np.flatnonzero(new)
            row, first, end = row[begins], first[begins], (upto - apart)[np.append(begins[1:], len(new))[: len(begins)] - 1]
            cuts = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["first", "end"]))
            n_hit = pa.array(np.bincount(row, end - first, len(batch)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*columns, n_hit], names=[*batch.schema.names, "n_hit"])

    return hit.mapInArrow(work, StructType([*hit.schema.fields, StructField("n_hit", LongType())]))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items): the spans of hit words (numbers of the first and of the one after the last) and the ids of the items
    whose windows they hold, sorted as strings."""
    return _results(docs, items, {"items": F.col("items")}, {"items": F.array().cast("array<string>")})


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns."""
    of_items = {"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}
    of_none = {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    return _results(docs, items, of_items, of_none).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: For DuckDB, over whole documents and items.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW}, 0) + 2), lambda i: array_to_string(w[i:i + {WINDOW} - 1], ' '))) AS s FROM b WHERE len(w) > 0),
places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
met AS (SELECT DISTINCT r, n, i, item FROM places JOIN windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
