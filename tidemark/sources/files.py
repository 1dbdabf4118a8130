"""File sources: transcripts, hypotheses, logs, samples, audio."""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions.arrays import decode_wav
from tidemark.functions.text import base_name, extension, first_integer, strip
from tidemark.operators.evaluate import dual_keyed
from tidemark.operators.prepare import ranked
from tidemark.sources.results import TEXTS, store_of
from tidemark.sources.sinks import NO_VALUE

YUE_ONLY_SUFFIX = "wsyue_asr_eval.json"


def references(spark: SparkSession, path: str, language: str = "en", text_column: str | None = None) -> DataFrame:
    """(file, reference) from a JSON array of {audio_path, text_<language>}; empty texts go, each file counts under base name and stem, and
    of equal keys the last in the file stays."""
    column = text_column or f"text_{language}"
    rows = spark.read.schema(f"audio_path string, `{column}` string").option("multiLine", True).json(path)
    rows = rows.select("audio_path", F.col(column).alias("reference"), F.monotonically_increasing_id().alias("__n")).where(F.coalesce(F.col("reference"), F.lit("")) != "")
    return dual_keyed(rows, "audio_path", "__n").select("file", "reference")


def hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """(file, generated, latencies) from a batch summary document; empty texts stay."""
    rows = spark.read.schema(schemas.BATCH).option("multiLine", True).json(path).selectExpr("inline(results)")
    return dual_keyed(rows.withColumn("generated", F.coalesce("transcription", F.lit(""))).withColumn("__n", F.monotonically_increasing_id()).withColumnRenamed("file", "path"), "path", "__n").drop("path", "__n")


def iterations(spark: SparkSession, path: str) -> DataFrame:
    """(segment, iteration, text) from the folders of sinks.write_iterations(). A task lists and reads what one task has written; the driver lists no segments."""
    store, root = store_of(path)
    below = lambda name, mark: [f"{name}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(f"{root}{name}", allow_not_found=True)) if x.base_name.startswith(mark)]
    tasks = [task for job in below("", "job=") for task in below(job, "task=")]

    def value(name: str) -> str | None:
        return None if (text := name.split("=", 1)[1]) == NO_VALUE else unquote(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        columns = ["segment", "iteration", "text"]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                out, size = [], 0
                for segment in store.get_file_info(fs.FileSelector(root + tasks[k])):
                    for iteration in store.get_file_info(fs.FileSelector(segment.path)):
                        key = (value(segment.base_name), value(iteration.base_name))
                        with store.open_input_stream(f"{iteration.path}/{TEXTS}") as raw, io.TextIOWrapper(raw, "utf-8", newline="\n") as lines:
                            for line in lines:
                                out.append((*key, line.removesuffix("\n")))
                                size += len(line) + 32
                                if size > 1 << 20:
                                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], columns)
                                    out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], columns)

    return spark.range(0, len(tasks), 1, max(len(tasks), 1)).mapInArrow(work, "segment string, iteration string, text string")


def individual_hypotheses(spark: SparkSession, folder: str, suffix: str = "_transcription.txt") -> DataFrame:
    """(file, generated) from one text file for each stem."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.regexp_replace(F.url_decode(name), F.lit(suffix.replace(".", r"\.") + "$"), F.lit("")).alias("file"), strip("value").alias("generated"))


def any_hypotheses(spark: SparkSession, folder: str, batch_name: str = "batch_transcriptions.json") -> DataFrame:
    """The batch document of a folder if there is one, else its individual files."""
    batch = f"{folder}/{batch_name}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(batch)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return hypotheses(spark, batch)
    return individual_hypotheses(spark, folder)


def id_lines(lines: DataFrame, ext: str = "", prefix: str = "") -> DataFrame:
    """(audio_path, text) from lines of an id, white space and a text. With a prefix the path has the id's sixth to tenth characters as a folder."""
    parts = lines.select(F.regexp_extract("value", r"(?U)^\s*(\S+)", 1).alias("id"), strip(F.regexp_extract("value", r"(?U)^\s*\S+\s*(.*)$", 1)).alias("text")).where("id <> ''")
    name = F.concat("id", F.lit(ext))
    return parts.select((F.concat_ws("/", F.lit(prefix), F.substring("id", 7, 5), name) if prefix else name).alias("audio_path"), "text")


def why_skipped(line: Column | str) -> Column:
    """Why a tab-separated line doesn't count: blank, comment, short or empty; null if it does."""
    line = F.col(line) if isinstance(line, str) else line
    cells = F.split(line, "\t")
    hollow = (strip(F.element_at(cells, 1)) == "") | (strip(F.element_at(cells, -1)) == "")
    return F.when(strip(line) == "", "blank").when(line.rlike(r"^\s*#"), "comment").when(F.size(cells) < 2, "short").when(hollow, "empty")


def tab_lines(lines: DataFrame) -> DataFrame:
    """(name, text, skipped) of tab-separated lines, by first and last column."""
    cells = F.split("value", "\t")
    return lines.select(strip(F.element_at(cells, 1)).alias("name"), strip(F.element_at(cells, -1)).alias("text"), why_skipped("value").alias("skipped"))


def indexed(rows: DataFrame, name: str, order: str, start: int = 0, from_name: bool = True) -> DataFrame:
    """rows with `index`: the first number in the name, else the row's place in order."""
    placed = ranked(rows, order, "__place")
    place = F.col("__place") + start
    return placed.withColumn("index", F.coalesce(first_integer(name), place) if from_name else place).drop("__place")


def counted(rows: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has the number of rows for each condition once an action has run: counters without a second pass."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items())), seen


def parquet_with_blob(spark: SparkSession, path: str, blob: str = "audio") -> tuple[DataFrame, DataFrame]:
    """(the blob's path and bytes, all other columns): only what is used is read."""
    rows = spark.read.parquet(path)
    return rows.select(f"{blob}.path", f"{blob}.bytes"), rows.drop(blob)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Correction samples from JSON lines; broken lines go."""
    corrupt = schemas.SAMPLE + ", __bad string"
    rows = spark.read.schema(corrupt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.where("__bad IS NULL").drop("__bad")


def is_sample_format(spark: SparkSession, path: str, keys: tuple[str, ...] = ("k_best_candidates", "continuation_transcript")) -> bool:
    """Does the first line with content have all these keys?"""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1)
    found = line.select(F.json_object_keys("value").alias("k")).collect()
    return bool(found) and set(keys) <= set(found[0]["k"] or [])


def dataset(spark: SparkSession, path: str, renames: dict[str, str] | None = None, kind: str | None = None) -> DataFrame:
    """JSON, JSON lines, CSV, text or Parquet by extension, with columns renamed."""
    kind = kind or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    read = spark.read
    rows = {"json": lambda: read.option("multiLine", True).json(path), "jsonl": lambda: read.json(path), "csv": lambda: read.option("header", True).csv(path), "parquet": lambda: read.parquet(path), "txt": lambda: read.text(path)}
    if kind not in rows:
        raise ValueError(f"no reader for {kind!r}")
    return rows[kind]().withColumnsRenamed(renames or {})


def from_lists(spark: SparkSession, audio_paths: list[str], instructions: list[str], responses: list[str]) -> DataFrame:
    if not len(audio_paths) == len(instructions) == len(responses):
        raise ValueError("the lists must have the same length")
    return spark.createDataFrame(list(zip(audio_paths, instructions, responses, strict=True)), "audio_path string, instruction string, response string")


def audio_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".wav", ".mp3", ".flac", ".m4a", ".ogg"), limit: int | None = None) -> DataFrame:
    """Paths of all audio files below a folder, or of one file, in order, or of the first limit ones. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    rows = rows.where(extension("path").isin(*extensions)).orderBy("path")
    return rows if limit is None else rows.limit(limit)


def audio(spark: SparkSession, path: str, rate: int = 16000) -> DataFrame:
    """(path, samples) of WAV files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return rows.select("path", decode_wav("content", rate).alias("samples"))


def processed_keys(spark: SparkSession, path: str, column: str = "audio_path") -> DataFrame:
    """Distinct keys of an output of JSON lines; none if there is no output yet."""
    if not path.startswith(("hdfs:", "s3", "viewfs:")) and not glob.glob(path.removeprefix("file://")):
        return spark.createDataFrame([], T.StructType([T.StructField(column, T.StringType())]))
    return spark.read.schema(f"{column} string").json(path).where(F.col(column).isNotNull()).distinct()


# Log patterns: fixed values.
HEADER = r"INFO\s+The system received audio from\s+([\d.]+)\s+s to\s+([\d.]+)\s+s"
CANDIDATE = r"^DEBUG\s+<\|startoftranscript\|><\|[^|>]+\|><\|transcribe\|><\|notimestamps\|>(.*)$"
RESET = r"INFO\s+Decoding loop starts"
OUTPUT = r"INFO\s+Output:(.*)$"
PREVIOUS = r"INFO\s+Previous confirmed transcript:(.*)$"
SAVED = r"INFO\s+Saved encoder_feature to(.*)$"
FINISH = r"^INFO\s+Finish"


#: Lines of a block that is counted by itself.
BLOCK_LINES = 65_536


def running(rows: DataFrame, key: str, order: str, **conditions: Column) -> DataFrame:
    """rows with, for each condition, how many rows of the key meet it up to and with this one. order: a whole number.

    Rows go to blocks of BLOCK_LINES numbers, which tasks count by themselves; a block begins with the sums of those before it, so a key of any length is
    the work of many tasks."""
    counted_, block = rows, F.floor(F.col(order) / BLOCK_LINES)
    for name, met in conditions.items():
        counted_ = counted_.withColumn(f"__{name}", F.coalesce(met.cast("long"), F.lit(0)))
    counted_ = counted_.withColumn("__block", block)
    sums = counted_.groupBy(key, "__block").agg(*(F.sum(f"__{c}").alias(f"__{c}_all") for c in conditions))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    upto = sums.select(key, "__block", *(F.coalesce(F.sum(f"__{c}_all").over(earlier), F.lit(0)).alias(f"__{c}_upto") for c in conditions))
    inside = Window.partitionBy(key, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = counted_.join(upto, [key, "__block"])
    return out.select(*rows.columns, *((F.sum(f"__{c}").over(inside) + F.col(f"__{c}_upto")).alias(c) for c in conditions))


def log_chunks(lines: DataFrame, key: str = "file", order: str = "line_no", k: int = 4) -> DataFrame:
    """(key, chunk, start, end, audio_embed_path, previous_transcript, topk, outputs) from log lines (key, order, value), numbered by order.

    Chunks and loops are running counts over the lines, so the scan is a few windows, not a state machine; chunks are counted by blocks of lines, and
    what follows goes by chunk."""
    line = F.col("value")
    is_ = lambda pattern: F.coalesce(line.rlike(pattern), F.lit(False))
    rows = running(lines.select(key, order, "value"), key, order, stopped=is_(FINISH), chunk=is_(HEADER)).where("stopped = 0 AND chunk > 0").drop("stopped")
    rows = rows.withColumn("loop", F.sum((is_(RESET) & ~is_(HEADER)).cast("int")).over(Window.partitionBy(key, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last_loop", F.max("loop").over(Window.partitionBy(key, "chunk")))
    pick = lambda cond, pattern: F.when(cond, F.struct(F.col(order).alias("o"), strip(F.regexp_extract(line, pattern, 1)).alias("v")))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"])
    candidate = F.when(is_(CANDIDATE) & (F.col("loop") == F.col("last_loop")), F.struct(F.col(order).alias("o"), F.regexp_extract(line, CANDIDATE, 1).alias("v")))
    last = lambda pattern: F.coalesce(F.max(pick(is_(pattern), pattern))["v"], F.lit(""))
    grouped = rows.groupBy(key, "chunk").agg(
        F.max(F.when(is_(HEADER), F.regexp_extract(line, HEADER, 1))).cast("double").alias("start"), F.max(F.when(is_(HEADER), F.regexp_extract(line, HEADER, 2))).cast("double").alias("end"),
        last(SAVED).alias("audio_embed_path"), last(PREVIOUS).alias("previous_transcript"), texts(candidate).alias("__c"), texts(pick(is_(OUTPUT), OUTPUT)).alias("outputs"),
    )
    topk = F.slice("__c", F.greatest(F.size("__c") - k + 1, F.lit(1)), F.lit(k))
    return grouped.withColumn("topk", topk).drop("__c")


def last_marked(lines: DataFrame, mark: str, key: str = "file", order: str = "line_no") -> DataFrame:
    """(key, text) of each key's last line that begins with mark."""
    return lines.where(F.col("value").startswith(mark)).groupBy(key).agg(strip(F.substring_index(F.max_by("value", order), mark, -1)).alias("text"))


#: Blocks of files up to which their line counts are sent to all tasks; with more of them they are joined.
MAX_BLOCKS = 2_000_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files, from 0.

    A file is read in blocks. One pass counts the lines of each, and sums over the blocks of a file say where each begins; the second numbers a block's
    lines from there as it reads them, so no line is shuffled and a file of many blocks is the work of as many tasks. Should the blocks not be those that were
    counted (files that have changed, or a session whose sizes have), reading fails."""
    rows = spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("__p"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"), base_name("_metadata.file_path").alias("file"), "value")
    blocks = rows.groupBy("__p", "__b").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    earlier = Window.partitionBy("__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    begins = blocks.withColumn("__upto", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    begins = begins.cache()  # counted once, for its size and for the join
    begins = F.broadcast(begins) if begins.count() <= MAX_BLOCKS else begins
    place = F.col("__m") - F.col("__first")
    known = F.coalesce((place >= 0) & (place < F.col("__n")), F.lit(False))
    line_no = F.when(known, F.col("__upto") + place).otherwise(F.raise_error(F.lit("the files aren't read in the blocks that were counted")).cast("long"))
    return rows.join(begins, ["__p", "__b"], "left").select("file", line_no.alias("line_no"), "value")


def has_digest(content: Column, digest: str) -> Column:
    """Is the content the one of this SHA-256?"""
    return F.sha2(content, 256) == digest.lower()
