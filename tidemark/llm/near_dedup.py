"""MinHash near-dedup with odd sketches (operator 5).

1. Every document gets its set's size and 128-bit hash, bands of 5 MinHash values (25 at 0.85), and an odd sketch: the samples
   folded into a parity bitmap, whose XOR population count estimates high similarities well. Equal sets are one class.
2. Class representatives meet in range-partitioned band buckets. Sketches reject pairs that are certainly below the
   threshold. A small bucket gives its remaining pairs, a large one gives two links a row: to the best hub of its
   block and to the row's nearest neighbour.
3. Each pair is confirmed on the full shingle sets; confirmed links make components.
4. Rows of a large bucket that are not in their group's main component yet are compared, block by block and on the full
   sets, with all rows of the group; each pair of blocks gives a spanning forest of its links, not its pairs.

So copies are never expanded into all pairs, no partner is capped, and nothing but plan decisions is on the driver.

Defined cases: null or empty text, or text without a word, has an empty set and is linked with nothing; fewer than five
words are one shingle; a null doc_id is kept, linked with nothing; rows that repeat a doc_id are one document, linked with all that any of
its texts is linked with: they get one component, each with the size of its own set; ties in component ids cannot occur; other columns play no part.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, mix, owner, pieces, range_parts, rolling, span_hash, word_spans, written
from tidemark.llm.graph import components

WORDS = 5
ROWS = 5
SKETCH_BITS = 512
#: 100 * intersection >= near * union.
NEAR = 85
#: A pair at the threshold shares no band with at most this probability; that sets the number of bands.
MISSED = 4.5e-7
#: Buckets above this size, and those that cross a partition's edge, are linked by hubs and settled in blocks.
SMALL_BUCKET = 24
BLOCK = 512
PAIR_BLOCK = 256
#: Class representatives of a range partition of buckets, in the mean.
PART_REPS = 250_000


def n_bands(near: int) -> int:
    return math.ceil(math.log(MISSED) / math.log1p(-((near / 100) ** ROWS)))


def max_different_bits(near: int) -> int:
    """Sketches of a pair at the threshold differ in more bits in about one case in 10^11: seven deviations above the mean number of
    samples that differ, each of which flips one bit in either sketch."""
    n, p = n_bands(near) * ROWS, 1 - near / 100
    return 2 * int(n * p + 7 * math.sqrt(n * p * (1 - p)))


@functools.lru_cache(4)
def multipliers(n: int) -> np.ndarray:
    """n odd hash multipliers; fewer are a prefix of more."""
    return np.random.default_rng(5).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary"


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row and the row of each, in row order."""
    starts, ends = word_spans(buf, offsets)
    docs = owner(offsets, starts)
    words = span_hash(lower_ascii(buf), starts, ends)
    counts = np.bincount(docs, minlength=len(offsets) - 1)
    parts, rows = [], []
    if len(words) >= WORDS:
        inside = docs[: len(docs) - WORDS + 1] == docs[WORDS - 1 :]
        parts.append(rolling(words, WORDS)[inside])
        rows.append(docs[: len(docs) - WORDS + 1][inside])
    first = np.cumsum(counts) - counts
    for n in range(1, WORDS):
        short = np.flatnonzero(counts == n)
        if len(short):
            parts.append(mix(rolling(words, n)[first[short]] + np.uint64(n)))
            rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, rows = np.concatenate(parts), np.concatenate(rows)
    _, at = np.unique(values ^ mix(rows.astype(np.uint64)), return_index=True)
    at = at[np.argsort(rows[at], kind="stable")]
    return values[at], rows[at]


def signatures(values: np.ndarray, first: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (n, bands) and odd sketches (n, bytes) of n non-empty sets that begin at first."""
    n, width = len(first), n_bands(near)
    samples = np.empty((n, width * ROWS), np.uint64)
    for k, a in enumerate(multipliers(width * ROWS)):
        samples[:, k] = np.minimum.reduceat(values * a, first)
    bands = np.zeros((n, width), np.uint64) + np.arange(width, dtype=np.uint64)
    for k in range(ROWS):
        bands = mix(bands + samples[:, k::ROWS])
    bits = (mix(samples + np.arange(width * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((bits + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS)
    return bands, np.packbits((flips & 1).astype(np.uint8), axis=1)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sign(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    width = n_bands(near)
    for batch in batches:
        for lo, hi, buf, offsets in pieces(batch.column(1), 1 << 20):
            values, rows = shingles(buf, offsets)
            n = hi - lo
            counts = np.bincount(rows, minlength=n)
            full = np.flatnonzero(counts)
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            bands, sketch = np.zeros((n, width), np.uint64), np.zeros((n, SKETCH_BITS // 8), np.uint8)
            if len(full):
                first = (np.cumsum(counts) - counts)[full]
                s1[full], s2[full] = np.add.reduceat(values, first), np.add.reduceat(mix(values), first)
                bands[full], sketch[full] = signatures(values, first, near)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(counts, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, _binary(sketch)], names=["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"])


_PAIRS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _bucket_pairs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """kind 0: a pair to confirm; kind 1: row a is in the large bucket b. limit: bits by which sketches of a pair may differ."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if out:
            a, b = np.concatenate([x for _, x, _ in out]), np.concatenate([x for _, _, x in out])
            kind = np.repeat([k for k, _, _ in out], [len(x) for _, x, _ in out])
            out.clear()
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)

    def run(bucket: int, ids: np.ndarray, sketch: np.ndarray, large: bool) -> None:
        if len(ids) == 1 and not large:
            return
        for lo in range(0, len(ids), BLOCK):
            block, bits = ids[lo : lo + BLOCK], sketch[lo : lo + BLOCK]
            n = len(block)
            far = np.zeros((n, n), np.int64)
            for k in range(bits.shape[1]):
                far += np.bitwise_count(bits[:, k, None] ^ bits[None, :, k])
            near = far <= limit
            if not large:
                i, j = np.nonzero(np.triu(near, 1))
                out.append((0, block[i], block[j]))
                continue
            far[np.arange(n), np.arange(n)] = 1 << 20
            out.append((1, block, np.full(n, bucket)))
            if n == 1:
                continue
            closest = far.argmin(1)
            ok = near[np.arange(n), closest]
            out.append((0, np.minimum(block, block[closest])[ok], np.maximum(block, block[closest])[ok]))
            rest = near.sum(1) > 1
            while rest.any():  # each hub takes away all rows that may be near it
                hub = int(np.flatnonzero(rest)[near[rest].sum(1).argmax()])
                mine = np.flatnonzero(near[hub] & rest)
                other = block[mine[mine != hub]]
                out.append((0, np.minimum(other, block[hub]), np.maximum(other, block[hub])))
                rest[mine] = False
                rest[hub] = False

    held: list[tuple[np.ndarray, np.ndarray]] = []
    bucket, at_edge = None, True

    def close(large: bool) -> None:
        if held:
            ids = np.concatenate([x for x, _ in held])
            run(bucket, ids, np.concatenate([x for _, x in held]), large or len(ids) > SMALL_BUCKET)
            held.clear()

    for batch in batches:
        if not len(batch):
            continue
        key, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
        begins = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
        for k in range(len(begins) - 1) if len(begins) < 3 else [0, *(1 + np.flatnonzero(np.diff(begins)[1:-1] > 1)), len(begins) - 2]:
            lo, hi = begins[k], begins[k + 1]
            if key[lo] != bucket:
                if bucket is not None:
                    close(at_edge)
                    at_edge = False
                bucket = key[lo]
            held.append((ids[lo:hi], sketch[lo:hi]))
            if sum(len(x) for x, _ in held) >= 8 * BLOCK:  # so large a bucket is settled in blocks anyway
                close(True)
                at_edge = True
        if sum(len(x) for _, x, _ in out) > 50_000:
            yield from flush()
    close(True)
    yield from flush()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in pieces(batch.column(1), 1 << 20):
            values, rows = shingles(buf, offsets)
            cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
            sets = [np.sort(values[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def is_near(x: np.ndarray, y: np.ndarray, near: int = NEAR) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < near * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= near * (len(x) + len(y) - both)


def _confirm(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(k).to_pylist()] for k in (2, 3))
        ok = pa.array(np.array([is_near(a, b, near) for a, b in zip(x, y, strict=True)], bool))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(ok)


def _settle(rows: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links between the rows to settle and the others of two blocks: a spanning forest over their components."""
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(ids, kind="stable")
    for lo in range(0, int(ids.max()) + 1, 4096):  # dense columns for some thousand shingles at a time
        mine = order[np.searchsorted(ids[order], lo) : np.searchsorted(ids[order], lo + 4096)]
        has = np.zeros((len(sets), 4096), np.float32)
        has[owners[mine], ids[mine] - lo] = 1
        both += has @ has.T
    near = 100 * both.astype(np.int64) >= threshold * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    comp, doc, todo = rows["comp"].to_numpy(), rows["doc_id"].to_numpy(), rows["todo"].to_numpy()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x] = parent.setdefault(parent[x], parent[x])
        return x

    links = []
    for i, j in zip(*np.nonzero(near & todo[:, None] & (comp[:, None] != comp[None, :])), strict=True):
        a, b = root(comp[i]), root(comp[j])
        if a != b:
            parent[a] = b
            links.append((doc[i], doc[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _left_over(members: DataFrame, mapping: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """Links that hubs have missed in large buckets. members: (a: row, b: bucket)."""
    groups = components(members).join(members.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    rows = written(groups.select(F.col("node").alias("doc_id"), F.col("root").alias("grp")).join(mapping.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "grp", F.coalesce("root", "doc_id").alias("comp")))
    sizes = rows.groupBy("grp", "comp").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("grp").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main")).where("n > n_main")
    todo = rows.join(groups, "grp").withColumn("todo", F.col("comp") != F.col("main"))
    n_all, n_todo = F.ceil(F.col("n") / PAIR_BLOCK), F.ceil((F.col("n") - F.col("n_main")) / PAIR_BLOCK)
    todo = todo.select("doc_id", "grp", "comp", "todo", n_all.alias("blocks"), n_todo.alias("todo_blocks"), F.xxhash64("doc_id").alias("h"))
    mine = F.pmod(F.col("h"), F.col("blocks"))
    other = todo.select("doc_id", "grp", "comp", F.lit(False).alias("todo"), mine.alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("todo_blocks") - 1)).alias("u"))
    settle = todo.where("todo").select("doc_id", "grp", "comp", "todo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("v"), F.pmod(F.shiftright("h", 20), F.col("todo_blocks")).cast("long").alias("u"))
    # A row to settle meets the others of its own block pair once only: as one to settle.
    met = other.select("doc_id", "grp", "comp", "todo", F.col("v").cast("long").alias("v"), "u").unionByName(settle.select("doc_id", "grp", "comp", "todo", "v", "u"))
    met = met.groupBy("doc_id", "grp", "comp", "v", "u").agg(F.max("todo").alias("todo"))
    return met.join(sets, "doc_id").groupBy("grp", "v", "u").applyInPandas(lambda pdf: _settle(pdf, near), "a long, b long")


def _texts_of_one_id(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the representatives of the classes that a repeated doc_id has texts in. Sizes and hashes meet, no text does."""
    marks = [f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2", "n_shingles") for f in (F.min, F.max)]
    several = real.groupBy("doc_id").agg(*marks).where("min_s1 <> max_s1 OR min_s2 <> max_s2 OR min_n_shingles <> max_n_shingles").select("doc_id")
    of = real.join(several, "doc_id", "left_semi").join(classes, ["s1", "s2", "n_shingles"]).select("doc_id", "rep").distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def near_duplicates(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs. near: the similarity from which texts are linked, in per cent."""
    docs = docs.select("doc_id", "text")
    signed = written(docs.mapInArrow(lambda b: _sign(b, near), _SIGNED))
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = real.join(classes.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    parts = range_parts(classes, PART_REPS)
    banded = reps.select(F.explode("bands").alias("band"), "doc_id", "sketch").repartitionByRange(parts, "band", "doc_id").sortWithinPartitions("band", "doc_id")
    found = written(banded.mapInArrow(lambda b: _bucket_pairs(b, max_different_bits(near)), "kind int, a long, b long").distinct())
    pairs, members = found.where("kind = 0 AND a <> b").select("a", "b"), found.where("kind = 1").select("a", "b")
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(members.select("a")).distinct()
    texts = docs.join(wanted.hint("merge"), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_shingle_rows, "doc_id long, shingles binary").distinct())
    full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    full = full.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    links = written(full.select("a", "b", "x", "y").mapInArrow(lambda b: _confirm(b, near), "a long, b long").unionByName(_texts_of_one_id(real, classes)))
    mapping = components(links)
    if not members.isEmpty():
        more = written(_left_over(members, mapping, sets, near))
        if not more.isEmpty():
            mapping = components(links.unionByName(more))
    by_class = classes.join(mapping.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    narrow = signed.select("doc_id", "n_shingles", "s1", "s2")
    linked = "n_shingles > 0 AND doc_id IS NOT NULL"
    out = narrow.where(linked).join(by_class, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    # Empty sets, of which there may be many, are in no class and need not meet.
    alone = narrow.where(f"NOT ({linked}) OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """The rows of docs, with all their columns, that represent their component; of equal doc_ids all stay."""
    verdict = near_duplicates(docs, near).where("NOT kept").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_anti").select(*docs.columns)


#: For DuckDB, over whole documents.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared s JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * s.n >= 85 * (p.n + q.n - s.n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM sizes UNION SELECT reached.doc_id, ways.y FROM reached JOIN ways ON ways.x = reached.r)
SELECT s.doc_id, s.n AS n_shingles, min(r.r) AS component_id, min(r.r) = s.doc_id AS kept FROM sizes s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""
