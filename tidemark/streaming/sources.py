"""Streaming sources: PCM over TCP, text lines; and time windows with watermarks."""

from __future__ import annotations

import socket
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class _PcmReader(SimpleDataSourceStreamReader):
    """Whole 16-bit samples from a socket; nothing is given out before least bytes are there or the peer has closed. What is less waits for the next
    call, an odd byte at the end for the one that completes its sample."""

    def __init__(self, options: dict[str, str]):
        self.address = options["host"], int(options["port"])
        self.least = int(float(options.get("min_chunk", "1.0")) * int(options.get("rate", "16000"))) * 2
        self.link, self.waiting, self.closed, self.past = None, b"", False, {}

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.link is None:
            self.link = socket.create_connection(self.address, timeout=5)
            self.link.settimeout(0.5)
        while len(self.waiting) < self.least and not self.closed:
            try:
                got = self.link.recv(1 << 16)
            except TimeoutError:
                break
            self.closed = not got
            self.waiting += got
        whole = len(self.waiting) // 2 * 2 if self.closed or len(self.waiting) >= self.least else 0
        raw, self.waiting = self.waiting[:whole], self.waiting[whole:]
        begin = start["bytes"]
        end = {"bytes": begin + len(raw)}
        rows = [(begin // 2, raw)] if raw else []
        self.past[begin] = (end["bytes"], rows)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at, out = start["bytes"], []
        while at < end["bytes"]:
            at, rows = self.past[at]
            out += rows
        return iter(out)

    def commit(self, end: dict) -> None:
        for k in [k for k, (last, _) in self.past.items() if last <= end["bytes"] and last > k]:
            del self.past[k]


class PcmSource(DataSource):
    """spark.dataSource.register(PcmSource); readStream.format("pcm_socket").option("host", ...).option("port", ...)"""

    @classmethod
    def name(cls) -> str:
        return "pcm_socket"

    def schema(self) -> str:
        return "first_sample bigint, pcm binary"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PcmReader(dict(self.options))


@dataclass
class _Slice(InputPartition):
    stream: str
    path: str
    begin: int
    end: int


class _GrowingReader(DataSourceStreamReader):
    """Offsets are bytes of each recording. A recording gives all that has come by the trigger, if that is least bytes or it is done, and never more than
    most; tasks read what lies between two offsets themselves."""

    def __init__(self, options: dict[str, str]):
        rate = int(options.get("rate", "16000"))
        self.folder, self.suffix, self.done = options["path"], options.get("suffix", ".pcm"), options.get("done", ".done")
        self.least = int(float(options.get("min_chunk", "1.0")) * rate) * 2
        self.most = int(float(options.get("max_chunk", "600")) * rate) * 2
        self.row = int(float(options.get("max_row", "60")) * rate) * 2
        self.at: dict[str, int] | None = None

    def _files(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = {x.base_name: x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file}
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found, out = self._files(), {}
        for name, info in found.items():
            if not name.endswith(self.suffix):
                continue
            before = (self.at or {}).get(name, 0)
            ready = info.size // 2 * 2 - before
            finished = name.removesuffix(self.suffix) + self.done in found
            # After a restart where the query stands is known from its first batch on; until then nothing is held back.
            ready = min(ready, self.most) if self.at is not None and ready >= (1 if finished else self.least) else ready if self.at is None else 0
            if before + ready:
                out[name] = before + ready
        for name, before in (self.at or {}).items():  # what was given stays given, even if its file has gone
            out.setdefault(name, before)
        self.at = out if self.at is not None else self.at
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        found, out = self._files(), []
        for name, last in sorted(end.items()):
            for begin in range(start.get(name, 0), last, self.row):
                out.append(_Slice(name.removesuffix(self.suffix), found[name].path, begin, min(begin + self.row, last)))
        return out

    def read(self, partition: _Slice) -> Iterator[tuple]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as f:
            raw = f.read_at(partition.end - partition.begin, partition.begin)
        yield partition.stream, partition.begin // 2, raw


class GrowingPcm(DataSource):
    """spark.dataSource.register(GrowingPcm); readStream.format("growing_pcm").load(folder): 16-bit recordings of a shared folder that grow while they are read,
    each up to what it has by the trigger. Options: min_chunk, max_chunk and max_row (seconds), rate, suffix, done (the suffix of a file that says that
    the recording of its name is finished). A slow batch is followed by longer chunks, as more has come meanwhile."""

    @classmethod
    def name(cls) -> str:
        return "growing_pcm"

    def schema(self) -> str:
        return "stream string, first_sample bigint, pcm binary"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _GrowingReader(dict(self.options))


def text_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket without NUL padding."""
    rows = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return rows.select(F.regexp_replace("value", "\u0000", "").alias("value"))


def tumbling(rows: DataFrame, time: str, size: str, *keys: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window and keys; late rows beyond the delay are dropped in a stream."""
    stamped = rows.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, delay) if rows.isStreaming else stamped
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stamped.groupBy(window, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(rows: DataFrame, time: str, gap: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    stamped = rows.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, delay) if rows.isStreaming else stamped
    return stamped.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_of_each(rows: DataFrame, time: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Rows without repeats of keys; in a stream within the watermark."""
    if not rows.isStreaming:
        return rows.dropDuplicates(keys)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
