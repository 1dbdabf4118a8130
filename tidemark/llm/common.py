"""Shared pieces: shared-folder tables, Arrow text batches, vectorised word spans and hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text is worked on in pieces of about so many bytes, whatever Spark's batch size is.
PIECE_BYTES = 2 << 20

ARROW_BATCH = "8m"

#: Fixed values: `[\x20\x09-\x0D]` is white space.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_RNG = np.random.default_rng(20240607)
_TABLES = _RNG.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset and all runs in one process, as in tests, a new
    temporary one that goes with the process; on a cluster without the setting an error, as executors would each write to their own disk."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.shared.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        local = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("tidemark.shared.dir", folder)
    return folder.rstrip("/")


def range_parts(table: DataFrame, rows: int) -> int:
    """Partitions of a written table of narrow rows: the session's number, or more so that each holds about so many rows."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all tables and stores that this application has left in the shared folder; what still reads them no longer works."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of ARROW_BATCH at most, so that long ones don't fill an executor; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(key, ARROW_BATCH)


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt to all cores if they are read in fewer parts than that, as a table of one small file is. A large one is read as it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows holding about limit bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, or of the runs of the bytes that solid marks; no word crosses a document's edge."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[buf] if solid is None else solid
    before = np.empty(len(buf) + 1, bool)
    before[0], before[1:] = False, solid
    edges = offsets[offsets < len(buf)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.empty(len(buf) + 1, bool)
    after[:-1], after[-1] = solid, False
    cut = after.copy()
    cut[edges] = False
    ends = np.flatnonzero(solid & ~cut[1:]) + 1
    return starts, ends


def owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row that holds byte position at."""
    return np.searchsorted(offsets, at, "right") - 1


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the \\n-split lines, in order; an empty row has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    rows = np.concatenate((np.arange(len(offsets) - 1), owner(offsets, breaks)))
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.empty_like(starts)
    ends[last] = offsets[1:][rows[last]]
    ends[~last] = starts[1:][~last[:-1]] - 1
    return starts, ends, rows


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each distinct content, the number of each span's content): by one 64-bit hash, or by two where the first doesn't tell all apart."""
    keys, other = span_hash(buf, starts, ends, 0), span_hash(buf, starts, ends, 1)
    _, first, code = np.unique(keys, return_index=True, return_inverse=True)
    if (other[first][code] != other).any():
        order = np.lexsort((other, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (other[order][1:] != other[order][:-1])
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        first = order[new]
    return first, code


def gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[at])))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans from one prefix sum of b_i * B^i (mod 2^64)."""
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLES[which][buf] * up[: len(buf)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n values (len(values) - n + 1 of them)."""
    out = values[: len(values) - n + 1].copy()
    for k in range(1, n):
        out *= _BASE
        out += values[k : len(values) - n + 1 + k]
    return mix(out)
