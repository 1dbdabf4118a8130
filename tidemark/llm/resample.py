"""Importance resampling towards a target distribution, by a dictionary of distinct features (operator 12).

Features are runs of consecutive words. Texts go by in blocks: of a block its distinct features are kept once, with their counts, and of each row
the numbers of its features within the block and how often it has them. The features of all blocks are summed to a dictionary; each distinct
string of it is hashed once, and its counts are added up by bucket, for the documents and for the target alike. The gains of the buckets,
whose number is a parameter, go back to the dictionary, from there to the distinct features of each block, and meet the block's rows by number.
So what is shuffled is a row for each distinct feature of a block, not one for each feature of a document; the gains of frequent features, whose number has a
bound, are sent to all tasks, and their rows aren't shuffled at all.

Draws are a Gumbel race: a document's score is its mean gain and a number of its id, and the highest scores are drawn. Places are counted in ranges of
sorted scores whose sizes are added up, so no task sees all rows.

Defined cases: null or empty text has no features and weight 0; a null doc_id is counted and weighed, but has no score and isn't drawn; rows that repeat
a doc_id are each a document; a target without features makes all its counts 0; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import IS_ALNUM, distinct_spans, gathered, lower_ascii, owner, pieces, range_parts, word_spans, written

BUCKETS = 10_000
#: Longest run of words that is a feature.
ORDERS = 1
MIN_WORDS = 20
SHARE = 10
SEED = 2024
#: Bytes of a block's text.
BLOCK_BYTES = 2 << 20
#: A feature with at least one in so many of all features, of which there can't be more, and of at most HOT_BYTES, has its gain sent to all tasks.
HOT, HOT_BYTES = 1_000_000, 32
#: Rows of a range of sorted scores, in the mean.
PART_ROWS = 4_000_000
#: A row of a block (its rows' ids, words and features) has no feature; the others are its features.
_BLOCK = "block long, code int, n long, feature string, doc_ids array<long>, n_words array<int>, sizes array<int>, codes binary, counts binary"
_WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def _packed(x: np.ndarray) -> bytes:
    """Integers below 2^32, compressed, in as few bytes each as hold the largest, which the first byte says."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), f"<u{x[0]}").astype(np.int64)


def features_of(buf: np.ndarray, offsets: np.ndarray, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, row of each feature, bytes, starts, ends): features are spans of the words, rejoined by one space."""
    low = lower_ascii(buf)
    starts, ends = word_spans(low, offsets, IS_ALNUM[low])
    row = owner(offsets, starts)
    sizes = ends - starts + 1
    begins = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) + np.repeat(starts - begins, sizes)
    joined = low[np.minimum(at, max(len(low) - 1, 0))]
    joined[begins + sizes - 1] = 32
    first, last, rows = [], [], []
    for n in range(1, orders + 1):
        size = max(0, len(row) - n + 1)
        inside = np.flatnonzero(row[:size] == row[n - 1 :])
        first.append(begins[inside])
        last.append((begins + sizes - 1)[inside + n - 1])
        rows.append(row[inside])
    return row, np.concatenate(rows), joined, np.concatenate(first), np.concatenate(last)


def blocks(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """For each block of rows one row of their ids and words and the numbers and counts of their features, and one for each distinct feature."""
    inner = pa.schema([("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("counts", pa.binary())])
    outer = pa.schema([("block", pa.int64()), ("code", pa.int32()), ("n", pa.int64()), ("feature", pa.string()), *inner])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi, buf, offsets in pieces(batch.column(1), BLOCK_BYTES):
                n = hi - lo
                word_row, row, joined, starts, ends = features_of(buf, offsets, orders)
                first, code = distinct_spans(joined, starts, ends)
                size = len(first)
                pair, times = np.unique(row * max(size, 1) + code, return_counts=True)
                which, codes = np.divmod(pair, max(size, 1))
                whole = [batch.column(0).slice(lo, n).to_pylist(), np.bincount(word_row, minlength=n), np.bincount(which, minlength=n), _packed(codes), _packed(times)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), *(pa.array([x], f.type) for x, f in zip(whole, inner, strict=True))], schema=outer)
                strings = gathered(joined, starts[first], ends[first]).cast(pa.string())
                each = [pa.array(np.full(size, number)), pa.array(np.arange(size, dtype=np.int32)), pa.array(np.bincount(code, minlength=size)), strings]
                yield pa.RecordBatch.from_arrays([*each, *(pa.nulls(size, f.type) for f in inner)], schema=outer)
                number += 1

    return docs.select("doc_id", "text").mapInArrow(work, _BLOCK)


def dictionary(parts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, n, bucket): each distinct feature of all blocks, how often it is there, and its bucket."""
    each = parts.where("feature IS NOT NULL").select("feature", "n")
    return each.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", (F.crc32("feature") % buckets).cast("int"))


def gains(words: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of two dictionaries; as many rows as buckets at most."""
    s, t = (x.groupBy("bucket").agg(F.sum("n").cast("double").alias(k)) for x, k in ((words, "s"), (target, "t")))
    both = s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0.0)).alias("t"))
    total = lambda x: float(x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    n_s, n_t = total(words), total(target)
    gain = F.floor(1000 * F.ln((F.col("t") + 1) * F.lit(n_s + buckets) / ((F.col("s") + 1) * F.lit(n_t + buckets))))
    return both.select("bucket", gain.cast("long").alias("gain"))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of each block's rows, from the gains of its features."""
    for batch in batches:
        for k in range(len(batch)):
            ids, n_words, sizes, priced = (batch.column(c)[k].values for c in ("doc_ids", "n_words", "sizes", "priced"))
            sizes = np.asarray(sizes, np.int64)
            codes, times = (_unpacked(batch.column(c)[k].as_py()) for c in ("codes", "counts"))
            total, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            if priced is not None:
                both = np.asarray(priced)
                gain = np.zeros(len(both), np.int64)
                gain[both >> 32] = (both & 0xFFFFFFFF) - (1 << 31)
                upto = np.concatenate(([0], np.cumsum(times * gain[codes])))
                ends = np.cumsum(sizes)
                total, n = upto[ends] - upto[ends - sizes], np.concatenate(([0], np.cumsum(times)))
                n = n[ends] - n[ends - sizes]
            yield pa.RecordBatch.from_arrays([ids, n_words.cast(pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of each row's features. target: a table with `text`."""
    parts = written(blocks(docs, orders))
    words = written(dictionary(parts, buckets))
    aims = written(dictionary(blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders), buckets))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = (F.col("n") * HOT >= F.lit(total)) & (F.octet_length("feature") <= HOT_BYTES)
    # A row for each bucket at most: broadcast whatever the input's size.
    priced = words.select("feature", "bucket", hot.alias("hot")).join(F.broadcast(gains(words, aims, buckets)), "bucket").select("feature", "gain", "hot")
    often, seldom = (F.broadcast(priced.where("hot").drop("hot"))), priced.where("NOT hot").drop("hot")
    named = parts.where("feature IS NOT NULL").select(F.col("block").alias("of"), "code", "feature")
    found = named.join(often, "feature").unionByName(named.join(often, "feature", "left_anti").join(seldom, "feature"))
    # Number and gain of a feature as one integer; a block has a bounded number of features.
    both = F.shiftleft(F.col("code").cast("long"), 32).bitwiseOR(F.col("gain") + (1 << 31))
    found = found.groupBy("of").agg(F.collect_list(both).alias("priced"))
    rows = parts.where("feature IS NULL").select("block", "doc_ids", "n_words", "sizes", "codes", "counts")
    return rows.join(found, F.col("block") == F.col("of"), "left").drop("block", "of").mapInArrow(_weigh, _WEIGHED)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * g) for a Gumbel number g that the id and the seed fix; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, upto = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(upto + 1, upto + n + 1))], names=[*batch.schema.names, "part", "k"])
        upto += n


def draw(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, min_words: int = MIN_WORDS, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): rank is 1, 2, ... for the share (per cent) of documents of min_words that is drawn, null for others."""
    scored = written(weights(docs, target, orders, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    named = scored.select("doc_id", "n_words", "n_features", "weight", "score")
    racing = named.where(able)
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features")]
    fields = "doc_id long, n_words long, n_features long, weight long, score long, part int, k long"
    sorted_ = written(racing.repartitionByRange(range_parts(racing, PART_ROWS), *order).sortWithinPartitions(*order).mapInArrow(_numbered, fields))
    # One row for each range.
    counts = {r["part"]: r["n"] for r in sorted_.groupBy("part").agg(F.max("k").alias("n")).collect()}
    ranges, before = [], 0
    for part in sorted(counts):
        ranges.append((part, before))
        before += counts[part]
    last = before * share // 100
    begins = F.broadcast(docs.sparkSession.createDataFrame(ranges, "part int, upto long"))
    place = F.col("k") + F.col("upto")
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    raced = sorted_.join(begins, "part").select(*out, F.when(place <= last, place).alias("rank"))
    return raced.unionByName(named.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))


#: For DuckDB: a text's bytes from its hexadecimal form, and the crc32 of them by a table that the polynomial's rule gives.
CRC_TABLE = "SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text; a column t must hold CRC_TABLE's list."""
    digit = lambda at: f"strpos('0123456789ABCDEF', substr(hex(encode({text})), CAST({at} AS BIGINT), 1)) - 1"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode({text})) + 1), lambda i: 16 * ({digit('2 * i - 1')}) + {digit('2 * i')})), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS BIGINT)])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: For DuckDB, with one word as the longest feature.
ORACLE_SQL = rf"""
WITH crc AS ({CRC_TABLE}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS f FROM d), bw AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
named AS (SELECT f, {crc_sql('f')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM dw UNION ALL SELECT f FROM bw)), crc),
s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS s FROM dw JOIN named USING (f) GROUP BY bucket), t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM bw JOIN named USING (f) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + {BUCKETS}.0::DOUBLE) / ((s + 1) * ((SELECT count(*) FROM bw) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN named USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)),
raced AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS} AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE} * n // 100 THEN place END AS rank FROM scored LEFT JOIN raced USING (r)
"""
