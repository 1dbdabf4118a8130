"""Sinks: JSON summaries, text, TSV, subtitles, packets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import col, cue_text, strip, timestamp_text
from tidemark.operators.runs import other, runs, values

PACKET = 65536
#: Fixed value: a folder's name for null or an empty text, as Spark has it.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Fixed value: characters that Spark writes as %XX in names of partitions, the per cent sign first.
ESCAPED = "%\"#'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32)))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: counts, mean latencies and all results."""
    item = F.struct(*results.columns)
    return results.agg(
        F.count("*").alias("total_files"), F.count("transcription").alias("processed_files"), F.avg("first_token_latency_ms").alias("average_first_token_latency_ms"),
        F.avg("last_token_latency_ms").alias("average_last_token_latency_ms"), F.array_sort(F.collect_list(item)).alias("results"),
    )


def write_json(df: DataFrame, path: str, one_file: bool = False, mode: str = "error") -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Rows are added as whole files, so concurrent writers don't mix lines."""
    df.write.mode("append").json(path)


def failed_keys(rows: DataFrame, key: str, *needed: str) -> tuple[DataFrame, DataFrame]:
    """(complete rows, keys of the others)."""
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in needed), F.lit(0)) == 1
    return rows.where(~missing), rows.where(missing).select(key)


def text_lines(segments: DataFrame) -> DataFrame:
    return segments.select(strip("text").alias("value"))


def tsv_rows(segments: DataFrame) -> DataFrame:
    """start and end in whole milliseconds, half to even, and the text without tabs."""
    ms = lambda c: F.bround(F.col(c).cast("decimal(24,9)") * 1000, 0).cast("bigint").alias(c)
    return segments.select(ms("start"), ms("end"), F.replace(strip("text"), F.lit("\t"), F.lit(" ")).alias("text"))


def srt_blocks(cues: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, block): numbered from 1, hours always, a comma before milliseconds."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    span = F.concat(timestamp_text("start", True, ","), F.lit(" --> "), timestamp_text("end", True, ","))
    return cues.select(key, order, F.concat(n.cast("string"), F.lit("\n"), span, F.lit("\n"), cue_text("text"), F.lit("\n")).alias("block"))


def vtt_blocks(cues: DataFrame, key: str, order: str) -> DataFrame:
    span = F.concat(timestamp_text("start"), F.lit(" --> "), timestamp_text("end"))
    return cues.select(key, order, F.concat(span, F.lit("\n"), cue_text("text"), F.lit("\n")).alias("block"))


def documents(blocks: DataFrame, key: str, order: str, header: str = "") -> DataFrame:
    """(key, value): each key's blocks in one text."""
    return blocks.groupBy(key).agg(F.concat(F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]), "\n")).alias("value"))


def line_numbers(sizes: list[tuple[int, int]], breaks: list[bool], width: int) -> list[int]:
    """The line of each word: lines are filled up to width, and end at each break. sizes: of each word, and of it without white space at its ends."""
    numbers, used = [], 0
    for (size, bare), broken in zip(sizes, breaks, strict=True):
        goes_on = bool(numbers) and not broken and used + size <= width
        numbers.append(numbers[-1] + (not goes_on) if numbers else 0)
        used = used + size if goes_on else bare
    return numbers


def cue_numbers(breaks: list[bool], most: int | None) -> list[int]:
    """The cue of each line: at most so many lines in one, and a new one after each break."""
    numbers, since = [], 0
    for k, broken in enumerate(breaks):
        if k and (broken or k - since == most):
            since = k
        numbers.append(since)
    return numbers


def cue_fold(words: list[tuple[int, str, float, float]], width: int | None, lines: int | None, pause: float = 3.0) -> list[tuple[float, float, str]]:
    """(start, end, text) of cues from words (segment, text, start, end): words are put to lines of width, and lines to cues, at most lines of them in one.

    Without width or lines, segments are kept apart as cues; a pause begins a new cue otherwise."""
    by_segment, broken = width is None or lines is None, []
    for k, (segment, _, start, _) in enumerate(words):
        broken.append(k > 0 and (segment != words[k - 1][0] if by_segment else start - words[k - 1][2] > pause))
    bare = [text.strip() for _, text, _, _ in words]
    numbers = line_numbers([(len(text), len(b)) for (_, text, _, _), b in zip(words, bare, strict=True)], broken, width or 1000)
    made: list[list] = []  # of each line its pieces, start and end, of which a missing one gives way to the next or to the one before
    breaks: list[bool] = []
    for (_, text, start, end), piece, number, new in zip(words, bare, numbers, broken, strict=True):
        if number == len(made):
            made.append([[piece], start, end])
            breaks.append(new)
            continue
        line = made[-1]
        line[0].append(text)
        if line[1] != line[1]:
            line[1] = start
        if end == end:
            line[2] = end
    out: list[list] = []
    last = None
    for (pieces, start, end), cue in zip(made, cue_numbers(breaks, lines), strict=True):
        text = "".join(pieces)
        if cue != last:
            out.append([start, end, [text.lstrip()]])
            last = cue
            continue
        # Only what stands between two lines of a cue is trimmed.
        shown = out[-1]
        shown[2].append(text.strip())
        if shown[0] != shown[0]:
            shown[0] = start
        if end == end:
            shown[1] = end
    return [(start, end, "\n".join(texts)) for start, end, texts in out]


def cues(words: DataFrame, key: str, width: int | None = None, lines: int | None = None) -> DataFrame:
    """(key, seq, start, end, text) of subtitles from word rows (key, segment, seq, text, start, end). A task holds the words of one key at a time."""
    kind = words.schema[key].dataType.simpleString()
    names = [key, "seq", "start", "end", "text"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done() -> list[tuple]:
            return [(last, k, *x) for k, x in enumerate(cue_fold(held, width, lines))]

        def as_rows(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            types = [key_type, pa.int64(), pa.float64(), pa.float64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            key_type, out = batch.column(0).type, []
            for k, *word in zip(batch.column(0).to_pylist(), *(values(batch.column(n)) for n in range(1, 5)), strict=True):
                if held and other(k, last):
                    out += done()
                    held = []
                last = k
                held.append(tuple(word))
            if out:
                yield as_rows(out)
        if held:
            yield as_rows(done())

    ordered = runs(words.select(key, "segment", "text", F.col("start").cast("double"), F.col("end").cast("double"), "seq"), key, "segment", "seq")
    return ordered.mapInArrow(fold, f"{key} {kind}, seq bigint, start double, end double, text string")


def packets(text: Column | str, size: int = PACKET, pad: bool = False) -> Column:
    """The first line in packets of size bytes; the last is filled with NUL if pad."""
    raw = F.concat(F.split_part(col(text), F.lit("\n"), F.lit(1)), F.lit("\n")).cast("binary")
    n = F.greatest(F.ceil(F.octet_length(raw) / size), F.lit(1)).cast("int")
    part = lambda k: F.substring(raw, k * size + 1, F.lit(size))
    filled = lambda p: F.rpad(p, size, F.unhex(F.lit("00"))) if pad else p
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: filled(part(k)))


def write_iterations(rows: DataFrame, path: str) -> None:
    """Texts of each segment's iterations, in a folder for each, which one task writes: job=*/task=*/segment=*/iteration=*/texts.txt, named as Spark names
    partitions. What a task has written is moved to its place as one folder, so a commit costs the same whatever the number of segments."""
    from tidemark.sources import results

    store, folder = results.store_of(path)
    if store.get_file_info(folder).type.name != "NotFound":
        raise FileExistsError(path)
    results.register(rows.sparkSession)

    def named(c: str) -> Column:
        text = F.col(c).cast("string")
        for mark in ESCAPED if rows.schema[c].dataType.simpleString() == "string" else "":
            text = F.replace(text, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
        return F.concat(F.lit(f"{c}="), F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_VALUE)))

    placed = rows.select(F.concat(named("segment"), F.lit("/"), named("iteration")).alias("file"), F.col("text").alias("value"))
    dealt = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").sortWithinPartitions("file")
    dealt.write.format("results").option("kind", "folders").mode("append").save(path)


def _subtitles(blocks, header: str = ""):
    """Segments (file, start, end, text; file is optional) as one document for each file."""

    def write(segments: DataFrame, path: str) -> None:
        rows = segments if "file" in segments.columns else segments.withColumn("file", F.lit("all"))
        rows = blocks(rows.withColumn("start_at", F.col("start")), "file", "start_at")
        documents(rows, "file", "start_at", header).select("file", "value").write.partitionBy("file").text(path)

    return write


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "txt": lambda segments, path: text_lines(segments).write.text(path),
    "vtt": _subtitles(vtt_blocks, "WEBVTT\n\n"),
    "srt": _subtitles(srt_blocks),
    "tsv": lambda segments, path: tsv_rows(segments).write.option("sep", "\t").option("header", True).csv(path),
    "json": lambda segments, path: segments.write.json(path),
}


def write_all(segments: DataFrame, folder: str, kinds: tuple[str, ...] = tuple(WRITERS)) -> None:
    """Every format below one folder. segments is computed once for each."""
    for kind in kinds:
        WRITERS[kind](segments, f"{folder}/{kind}")
