"""Token ids in a content-addressed store (operator 3).

Each document's id stream (end id included) is cut where a rolling hash of the last ids is zero in its low bits. A chunk's
key is the hash of its bytes, unique chunks are stored once, and a document is a recipe of keys. The store is a folder:

    blocks/kind=0/   key, n_tokens, data: unique chunks, ids as little-endian unsigned 16-bit (32-bit for larger vocabularies) integers
    recipes/kind=1/  part, at, local_start, doc_id, n_tokens, keys, leaf: documents in ascending doc_id order (nulls first)
    recipes/kind=2/  part, at (documents), local_start (ids), leaf: the Merkle root over the leaves of a part, leaf = hash of a document's keys

One pass encodes, cuts and writes; a chunk leaves a task only once while a bounded list remembers it, so text that many documents share isn't a hot
key. Equal keys then meet sorted, so repeats are told from their neighbours; Merkle roots are taken as the leaves go by.
Reading back checks every chunk against its key and every recipe against its leaf, and every part against its root.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first; rows that repeat a doc_id follow each other,
ordered by length and content; an empty table gives an empty store; other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import own_folder, pieces, range_parts, rolling
from tidemark.llm.spans_table import SpanTable, may_end_space, space_spans

END_ID = 2
WINDOW, MEAN_CHUNK, MIN_CHUNK, MAX_CHUNK = 16, 256, 64, 1024
#: After a letter each of these begins a part of its own, to the byte-level expression; a line break does after anything but white space.
MARKS = "\n.,;:!?%*)(\"'/-_"
#: Keys that a task remembers to have sent, and documents of a part of recipes, in the mean.
SENT_KEYS, PART_DOCS = 1_000_000, 2_000_000
_ENCODED = "kind int, doc_id long, n_tokens long, keys array<binary>, key binary, data binary"
_PLACED = "kind int, part int, at long, local_start long, doc_id long, n_tokens long, keys array<binary>, leaf binary"


class Encoder:
    """The tokenizers library with a table of distinct spans: what it gives for a span doesn't depend on its neighbours
    where a span begins at a space after something other than white space, nor, with the byte-level expression, where it
    begins at a line break after such or at a mark after a letter."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads would each keep memory of their own
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        spec, parts = whole["model"], whole.get("pre_tokenizer") or {}
        self.marks = np.zeros(256, bool)
        if parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not whole.get("normalizer"):
            kept = "".join(x["content"] for x in whole.get("added_tokens") or [])  # their strings stay whole
            self.marks[[ord(x) for x in MARKS if x not in kept]] = True
        if spec.get("type") == "BPE":  # each text is given to it once; the table below is the cache
            rest = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
            self.tokenizer.model = models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **{k: spec[k] for k in rest if spec.get(k) not in (None, "")})
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, np.int64)
        for text, k in vocab.items():
            self.n_bytes[k] = len(text)  # one character stands for one byte
        self.table = SpanTable(1_000_000)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, a few texts at a time: the library's results are far larger than the ids."""
        for k in range(0, len(texts), 8):
            for x in self.tokenizer.encode_batch_fast(texts[k : k + 8], add_special_tokens=False):
                yield np.array(x.ids, np.uint32)

    def _missing(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans are joined to long texts, as their encodings don't depend on each other, and parted by their bytes; odd ones go alone."""
        raw, width = buf.tobytes(), ends - starts
        last, earlier = buf[ends - 1], buf[np.maximum(ends - 2, 0)]
        first = buf[starts]
        plain = ((first == 32) | (first == 10) & self.marks[10]) & (width > 1) & (last > 32) & ~may_end_space(last, earlier)
        joined, alone = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        groups = [joined[k : k + 4000] for k in range(0, len(joined), 4000)]
        bounds = [(starts[g].tolist(), ends[g].tolist()) for g in groups]
        texts = [b"".join([raw[s:e] for s, e in zip(*x, strict=True)]).decode() for x in bounds]
        sizes, order, parts = np.zeros(len(starts), np.int64), [], []
        for group, ids in zip(groups, self._encode(texts), strict=True):
            upto, edges = np.cumsum(self.n_bytes[ids]), np.cumsum(width[group])
            at = np.searchsorted(upto, edges)
            if len(upto) and upto[-1] == edges[-1] and (upto[at] == edges).all():
                sizes[group] = np.diff(at, prepend=-1)
                order.append(group)
                parts.append(ids)
            else:
                alone += group.tolist()
        for k, ids in zip(alone, self._encode([raw[starts[k] : ends[k]].decode() for k in alone]), strict=True):
            sizes[k] = len(ids)
            order.append([k])
            parts.append(ids)
        out = np.zeros(int(sizes.sum()), np.uint32)
        if parts:
            order, values = np.concatenate(order), np.concatenate(parts)
            n = sizes[order]
            out[np.repeat((np.cumsum(sizes) - sizes)[order] - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        return sizes, out

    def rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id after each row, number of ids of each row)."""
        n = len(offsets) - 1
        starts, ends, rows, _ = space_spans(buf, offsets, marks=self.marks)
        at = self.table.resolve(buf, starts, ends, None, lambda w: self._missing(buf, starts[w], ends[w]))
        ids, which = self.table.expand(at)
        row = rows[which]
        sizes = np.bincount(row, minlength=n) + 1
        out = np.full(len(ids) + n, END_ID, np.uint32)
        out[np.arange(len(ids)) + row] = ids
        return out, sizes


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of all chunks of rows of ids that lie one after the other. A chunk has MIN_CHUNK to MAX_CHUNK ids, but for a row's last."""
    ends = np.cumsum(sizes)
    hot = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        hot = np.flatnonzero(rolling(ids.astype(np.uint64) + np.uint64(1), WINDOW) % np.uint64(MEAN_CHUNK) == 0) + WINDOW
    out, begin, bounds = [], 0, np.searchsorted(hot, ends, "right")
    spots, lo = hot.tolist(), 0
    for end, hi in zip(ends.tolist(), bounds.tolist(), strict=True):
        for p in [*spots[lo:hi], end]:
            while p - begin > MAX_CHUNK:
                begin += MAX_CHUNK
                out.append(begin)
            if p - begin >= MIN_CHUNK and p < end:
                out.append(begin := p)
        out.append(begin := end)
        lo = hi
    return np.array(out, np.int64)


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def write(docs: DataFrame, path: str | None = None, folder: str | None = None) -> str:
    """Writes the store and returns its folder."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = folder or f"{own_folder(spark)}/store-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sent = encoder(path), set()
        kind = "<u2" if e.size <= 1 << 16 else "<u4"
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(pa.binary())), ("key", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for lo, hi, buf, offsets in pieces(batch.column(1)):
                ids, sizes = e.rows(buf, offsets)
                cuts = cut_points(ids, sizes)
                raw, width = ids.astype(kind).tobytes(), int(kind[2])
                begins = np.concatenate(([0], cuts[:-1])).tolist()
                data = [raw[a * width : b * width] for a, b in zip(begins, cuts.tolist(), strict=True)]
                keys = [_hash(x) for x in data]
                if len(sent) > SENT_KEYS:
                    sent.clear()
                new, n_ids = {}, {}
                for key, x in zip(keys, data, strict=True):
                    if key not in sent:
                        new[key] = x
                        n_ids[key] = len(x) // width
                sent.update(new)
                of = np.concatenate(([0], np.searchsorted(cuts, np.cumsum(sizes)) + 1))
                n, m = hi - lo, len(new)
                recipes = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(keys, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 1, np.int32)), batch.column(0).slice(lo, n), pa.array(sizes, pa.int64()), recipes, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(list(n_ids.values()), pa.int64()), pa.nulls(m, pa.list_(pa.binary())), pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], schema=schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal keys are neighbours; the first of each stays."""
        last = None
        for batch in batches:
            at = np.flatnonzero(np.asarray(batch.column(4).is_valid()))
            keep = np.ones(len(batch), bool)
            if len(at):
                keys = np.frombuffer(b"".join(batch.column(4).drop_null().to_pylist()), np.uint64).reshape(len(at), -1)
                keep[at[1:]] = (keys[1:] != keys[:-1]).any(1)
                keep[at[0]] = last is None or bool((keys[0] != last).any())
                last = keys[-1].copy()
            yield batch.filter(pa.array(keep))

    encoded = docs.select("doc_id", "text").mapInArrow(work, _ENCODED)
    encoded.repartition(parts, F.xxhash64("key", "doc_id", "n_tokens")).sortWithinPartitions("key").mapInArrow(once, _ENCODED).write.partitionBy("kind").parquet(f"{folder}/blocks")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, start, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        names = [x.split()[0] for x in _PLACED.split(", ")]
        for batch in batches:
            n = len(batch)
            sizes = np.asarray(batch.column(1))
            starts = start + np.cumsum(sizes) - sizes
            leaves = [_hash(b"".join(x)) for x in batch.column(2).to_pylist()]
            tree.extend(leaves)
            columns = [pa.array(np.full(n, 1, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(starts), *batch.columns, pa.array(leaves, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            at, start = at + n, start + int(sizes.sum())
        if at:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((2, part, at, start, None, None, None, tree.root()), kinds, strict=True)], names=names)

    recipes = _stored(spark, folder).where("kind = 1").select("doc_id", "n_tokens", "keys")
    order = [F.asc_nulls_first("doc_id"), F.col("n_tokens"), F.col("keys")]
    recipes = recipes.repartitionByRange(range_parts(recipes, PART_DOCS), *order).sortWithinPartitions(*order)
    recipes.mapInArrow(place, _PLACED).write.partitionBy("kind").parquet(f"{folder}/recipes")
    return folder


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_ENCODED).parquet(f"{folder}/blocks")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_PLACED).parquet(f"{folder}/recipes").where("kind = 1").drop("kind")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, n_docs, n_ids, root), one row for each part."""
    rows = spark.read.schema(_PLACED).parquet(f"{folder}/recipes").where("kind = 2")
    return rows.select("part", F.col("at").alias("n_docs"), F.col("local_start").alias("n_ids"), F.col("leaf").alias("root"))


class Merkle:
    """Root over leaves that come one after the other: complete subtrees, each smaller than the one before, wait on a stack."""

    def __init__(self):
        self.n, self.stack = 0, []

    def extend(self, leaves: list[bytes]) -> None:
        for node in leaves:
            self.n += 1
            n = self.n
            while n % 2 == 0:
                node, n = _hash(self.stack.pop() + node), n // 2
            self.stack.append(node)

    def root(self) -> bytes:
        return functools.reduce(lambda right, left: _hash(left + right), reversed(self.stack)) if self.stack else _hash(b"")


def _roots(recipes: DataFrame) -> DataFrame:
    """One row for each part: its documents, ids and Merkle root, from leaves taken of the recipes' keys themselves."""

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = [_hash(b"".join(x)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leaves, pa.binary())], names=["part", "at", "n_tokens", "leaf"])

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, n_ids = None, Merkle(), 0

        def row() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, tree.n, n_ids, tree.root()), kinds, strict=True)], names=["part", "n_docs", "n_ids", "root"])

        for batch in batches:
            parts, sizes, leaves = np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(3).to_pylist()
            cuts = [0, *(1 + np.flatnonzero(parts[1:] != parts[:-1])).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if parts[a] != part:
                    if part is not None:
                        yield row()
                    part, tree, n_ids = int(parts[a]), Merkle(), 0
                tree.extend(leaves[a:b])
                n_ids += int(sizes[a:b].sum())
        if part is not None:
            yield row()

    leaves = recipes.select("part", "at", "n_tokens", "keys").mapInArrow(leaf, "part int, at long, n_tokens long, leaf binary")
    return leaves.repartition("part").sortWithinPartitions("part", "at").mapInArrow(root, "part int, n_docs long, n_ids long, root binary")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(part, n_ids, ok): does each part's Merkle root follow from its recipes as they are read now?"""
    again = _roots(_recipes(spark, folder)).select("part", F.col("root").alias("root_again"), F.col("n_docs").alias("n_again"), F.col("n_ids").alias("ids_again"))
    same = (F.col("root") == F.col("root_again")) & (F.col("n_docs") == F.col("n_again")) & (F.col("n_ids") == F.col("ids_again"))
    return manifest(spark, folder).join(again, "part", "full").select("part", F.coalesce("n_ids", "ids_again").alias("n_ids"), F.coalesce(same, F.lit(False)).alias("ok"))


def _advance(n_bytes: int) -> np.ndarray:
    """The linear map that n_bytes zero bytes are to a CRC-32, as its 32 columns."""
    square = np.array([0xEDB88320, *(1 << k for k in range(31))], np.uint64)  # one zero bit
    def times(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        for k in range(32):
            out ^= m[k] * (x >> np.uint64(k) & np.uint64(1))
        return out
    out, bits = np.array([1 << k for k in range(32)], np.uint64), 8 * n_bytes
    while bits:
        if bits & 1:
            out = times(square, out)
        square, bits = times(square, square), bits >> 1
    return out


@functools.lru_cache(4096)
def _columns(n_bytes: int) -> tuple[int, ...]:
    return tuple(_advance(n_bytes).tolist())


def crc_of(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from each part's (crc, bytes)."""
    total = 0
    for crc, n_bytes in parts:
        moved, k, columns = 0, 0, _columns(n_bytes)
        while total:
            if total & 1:
                moved ^= columns[k]
            total, k = total >> 1, k + 1
        total = moved ^ crc
    return total


def _ids(data: bytes, n: int) -> np.ndarray:
    """n ids from as many bytes as the store gave each."""
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(key, ok, n_ids, crc) of each stored chunk, from its data; crc over 32-bit ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data, sizes = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            crc = [zlib.crc32(_ids(x, n).astype("<u4")) for x, n in zip(data, sizes.to_pylist(), strict=True)]
            ok = [_hash(x) == k for x, k in zip(data, keys.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(ok), sizes, pa.array(crc, pa.int64())], names=["key", "ok", "n_ids", "crc"])

    return _stored(spark, folder).where("kind = 0").select("key", "data", "n_tokens").mapInArrow(work, "key binary, ok boolean, n_ids long, crc long")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of each document, from the files alone."""
    recipes = _recipes(spark, folder)
    # One row for each range partition.
    sums = sorted((r["part"], r["n_ids"], r["ok"]) for r in verify(spark, folder).collect())
    before, rows = 0, []
    for part, n_ids, ok in sums:
        rows.append((part, before, ok))
        before += n_ids
    offsets = spark.createDataFrame(rows, "part int, before long, part_ok boolean")
    used = recipes.select("part", "at", F.posexplode("keys").alias("seq", "key"))
    found = used.join(chunks(spark, folder).hint("merge"), "key", "left")
    per_doc = found.groupBy("part", "at").agg(F.array_sort(F.collect_list(F.struct("seq", "n_ids", "crc", "ok"))).alias("parts"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            n_ids, crc, ok = (flat.field(k).to_pylist() for k in (1, 2, 3))
            cuts = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths())))).tolist()
            total, size, good = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                fine = all(ok[a:b])
                good.append(fine)
                size.append(sum(x or 0 for x in n_ids[a:b]))
                total.append(crc_of([(c, 4 * n) for c, n in zip(crc[a:b], n_ids[a:b], strict=True)]) if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(good, pa.bool_())], names=["part", "at", "n_tokens", "ids_crc32", "chunks_ok"])

    read = per_doc.mapInArrow(combine, "part int, at long, n_tokens long, ids_crc32 long, chunks_ok boolean")
    out = recipes.select("part", "at", "doc_id", "local_start").join(read.hint("merge"), ["part", "at"]).join(F.broadcast(offsets), "part")
    return out.select("doc_id", (F.col("local_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", (F.col("chunks_ok") & F.col("part_ok")).alias("verified"))


def reconstruct(spark: SparkSession, folder: str, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, ids) of some documents, put together from their chunks."""
    recipes = _recipes(spark, folder).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    used = recipes.select("part", "at", "doc_id", F.posexplode("keys").alias("seq", "key"))
    data = _stored(spark, folder).where("kind = 0").select("key", "data", F.col("n_tokens").alias("n"))
    whole = used.join(data, "key").groupBy("part", "at", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "data", "n"))).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids(p["data"], p["n"]) for p in row]).tolist() for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return whole.select("doc_id", "parts").mapInArrow(work, "doc_id long, ids array<long>")
