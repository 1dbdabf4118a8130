"""Results as files that appear at once: a writer for batches and streams, and JSON documents of any size in parts.

Tasks write files of their own below a hidden folder. When all have succeeded, what a failed or repeated attempt has left is removed and the folder is
renamed to its place: before that nothing is seen, after it everything. A stream's folders are named by batch, so a batch that is run again after a crash finds
its folder there and adds nothing.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: How a row becomes text, by kind. A row of `documents` is a file of its own, named by its column file; one of `folders` is a line of the file TEXTS in its folder `file`.
KINDS = ("json", "text", "tsv", "documents", "folders")
TEXTS = "texts.txt"
STAGING = "_staging"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors see, and the folder in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class _Results:
    """What batches and streams share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.kind, self.columns = options["path"].rstrip("/"), options.get("kind", "json"), schema.names
        if self.kind not in KINDS:
            raise ValueError(f"no writer for {self.kind!r}")
        self.job = uuid.uuid4().hex

    def _lines(self, rows: Iterator[Row]) -> Iterator[str]:
        for row in rows:
            if self.kind == "json":
                yield json.dumps({k: v for k, v in row.asDict(True).items() if v is not None}, ensure_ascii=False, default=str) + "\n"
            elif self.kind == "text":
                yield f"{row[0] or ''}\n"
            else:
                out = io.StringIO()
                csv.writer(out, delimiter="\t", lineterminator="\n").writerow(["" if v is None else v for v in row])
                yield out.getvalue()

    def _staged(self, job: str) -> str:
        return f"{self.path}/{STAGING}/{job}"

    def _write(self, rows: Iterator[Row], job: str) -> Written:
        """One attempt's files: their names have a part that no other attempt has."""
        store, folder = store_of(self._staged(job))
        store.create_dir(folder, recursive=True)
        attempt, count = uuid.uuid4().hex, 0
        if self.kind == "documents":
            files = []
            for row in rows:
                files.append(f"{attempt}/{row['file']}")
                store.create_dir(f"{folder}/{files[-1]}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{folder}/{files[-1]}") as f:
                    f.write((row["value"] or "").encode())
            return Written(files, len(files))
        if self.kind == "folders":  # all below one folder for each attempt, which alone is named to the driver
            for place, lines in groupby(rows, lambda row: row["file"]):
                name = f"{folder}/{attempt}/{place}"
                store.create_dir(name, recursive=True)
                with store.open_output_stream(f"{name}/{TEXTS}") as f:
                    for row in lines:
                        f.write(f"{row['value'] or ''}\n".encode())
                        count += 1
            return Written([attempt] if count else [], count)
        name = f"part-{attempt}.{'jsonl' if self.kind == 'json' else 'tsv' if self.kind == 'tsv' else 'txt'}"
        with store.open_output_stream(f"{folder}/{name}") as f:
            for line in self._lines(rows):
                f.write(line.encode())
                count += 1
        return Written([name], count)

    def _publish(self, messages: list[Written | None], job: str, place: str) -> None:
        store, staged = store_of(self._staged(job))
        _, target = store_of(f"{self.path}/{place}")
        if store.get_file_info(target).type != fs.FileType.NotFound:  # this batch has been published before
            self._drop(job)
            return
        store.create_dir(staged, recursive=True)
        files = [name for m in messages if m for name in m.files]
        keep = set(files)
        if self.kind == "folders":
            for info in store.get_file_info(fs.FileSelector(staged)):
                if info.base_name not in keep:
                    store.delete_dir(info.path)  # of an attempt that doesn't count
                else:
                    store.move(info.path, f"{staged}/task={info.base_name}")
            store.move(staged, target)
            return
        for info in store.get_file_info(fs.FileSelector(staged, recursive=True)):
            if info.is_file and info.path[len(staged) :].lstrip("/") not in keep:
                store.delete_file(info.path)  # of an attempt that doesn't count
        if self.kind == "documents":  # each at its own name; of equal names the last stays
            for name in files:
                final = f"{staged}/{name.split('/', 1)[1]}"
                store.create_dir(final.rsplit("/", 1)[0], recursive=True)
                store.move(f"{staged}/{name}", final)
            for attempt in {name.split("/", 1)[0] for name in files}:
                store.delete_dir(f"{staged}/{attempt}")
        store.move(staged, target)

    def _drop(self, job: str) -> None:
        store, staged = store_of(self._staged(job))
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)

    def _published(self) -> list[str]:
        store, root = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [x.path for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith("_")]


class _BatchWriter(_Results, DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        super().__init__(options, schema)
        self.overwrite = overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        return self._write(iterator, self.job)

    def commit(self, messages: list[Written | None]) -> None:
        before = self._published() if self.overwrite else []
        self._publish(messages, self.job, f"job={self.job}")
        store, _ = store_of(self.path)
        for folder in before:
            store.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(self.job)


class _StreamWriter(_Results, DataSourceStreamWriter):
    """The writer of a query keeps one job over its batches; a batch's files are those that its messages name."""

    def write(self, iterator: Iterator[Row]) -> Written:
        """Each attempt in a folder of its own, so that those of a batch can be told from those of the one before."""
        own = f"{self.job}/{uuid.uuid4().hex}"
        made = self._write(iterator, own)
        return Written([f"{own}|{name}" for name in made.files], made.rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, _ = store_of(self.path)
        gathered = f"{self.job}-{batchId}"
        _, staged = store_of(self._staged(gathered))
        store.create_dir(staged, recursive=True)
        moved = []
        for m in messages:
            for own, name in (x.split("|", 1) for x in (m.files if m else [])):
                store.create_dir(f"{staged}/{name}".rsplit("/", 1)[0], recursive=True)
                store.move(f"{store_of(self._staged(own))[1]}/{name}", f"{staged}/{name}")
                moved.append(name)
        self._publish([Written(moved, 0)], gathered, f"batch={batchId}")
        self._drop(self.job)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop(self.job)
        self._drop(f"{self.job}-{batchId}")


class Results(DataSource):
    """spark.dataSource.register(Results); df.write.format("results").option("kind", ...).mode("append" or "overwrite").save(path), or writeStream with the
    same. kind: json (lines), text (the first column), tsv, or documents (columns file and value: one file for each row), or folders (the same columns,
    rows of a folder one after the other: a line for each row). path: a folder that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options), schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options), schema)


def write_document(head: dict, rows: DataFrame, order: list[str | Column], path: str, field: str = "results", parts: int | None = None) -> dict:
    """One JSON document, {**head, field: [rows in order]}, of any size: rows go to ranges of their order, which tasks sort and write as parts, and a
    manifest says how the parts join. Returns the manifest; joined() gives the document's bytes."""
    sorted_ = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    line = F.concat(F.lit(","), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    sorted_.select(line.alias("value")).write.mode("error").text(f"{path}/parts")
    store, folder = store_of(path)
    listed = sorted((x for x in store.get_file_info(fs.FileSelector(f"{folder}/parts")) if x.base_name.startswith("part-") and x.size), key=lambda x: x.base_name)
    opening = json.dumps(head, ensure_ascii=False)[:-1] + (", " if head else "") + json.dumps(field) + ": ["
    # Lines begin with a comma, which the first one does without.
    manifest = {"head": opening, "tail": "]}", "parts": [{"file": f"parts/{x.base_name}", "skip": 0 if k else 1, "bytes": x.size} for k, x in enumerate(listed)]}
    with store.open_output_stream(f"{folder}/_manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def joined(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The document's bytes, a piece at a time: a copy of any size needs one piece of memory."""
    store, folder = store_of(path)
    with store.open_input_stream(f"{folder}/_manifest.json") as f:
        manifest = json.loads(f.read())
    yield manifest["head"].encode()
    for part in manifest["parts"]:
        with store.open_input_stream(f"{folder}/{part['file']}") as f:
            f.read(part["skip"])
            while piece := f.read(chunk):
                yield piece
    yield manifest["tail"].encode()


def write_summary(results: DataFrame, path: str, order: list[str | Column] | None = None) -> dict:
    """The summary document of a batch of transcripts, whatever their number: counts and mean latencies, and all results by order."""
    late = ("first_token_latency_ms", "last_token_latency_ms")
    head = results.agg(F.count("*").alias("total_files"), F.count("transcription").alias("processed_files"), *(F.avg(c).alias(f"average_{c}") for c in late)).first().asDict()
    return write_document(head, results, order or list(results.columns), path)


def write_evaluation(pairs: DataFrame, metrics: DataFrame, path: str, order: list[str | Column] | None = None) -> dict:
    """The evaluation document: evaluate.summary() and every file's metrics by order, in parts."""
    from tidemark.operators.evaluate import summary

    return write_document(summary(pairs, metrics).first().asDict(), metrics, order or ["file"], path, "per_file_results")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Results)
