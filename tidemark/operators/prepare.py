"""Training-data preparation: alignment, weighted union, splits, sampling, collation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import col, drop_blank, first_not_blank, for_training, prompt, strip_replacement_marks, syllables

#: The offsets that are tried, in this order; the first of equals wins.
OFFSETS = (0, -6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6)


def best_offset(previous: Column | str, reference: Column | str, offsets: tuple[int, ...] = OFFSETS) -> Column:
    """Shift of the reference against which most tokens of previous agree; 0 where nothing can be compared."""
    p, r = col(previous), col(reference)

    def matches(o: Column) -> Column:
        return F.size(F.filter(F.transform(p, lambda x, i: (i + o >= 0) & (i + o < F.size(r)) & F.coalesce(F.try_element_at(r, F.when(i + o >= 0, i + o + 1).otherwise(F.lit(2147483647))) == x, F.lit(False))), lambda m: m))

    scored = F.transform(F.array(*map(F.lit, offsets)), lambda o, k: F.struct(matches(o).alias("n"), (-k).alias("k"), o.alias("o")))
    return F.array_max(scored)["o"]


def python_slice(a: Column, start: Column, end: Column) -> Column:
    """a[start:end] with Python's meaning of negative and large bounds."""
    n = F.size(a)
    fixed = lambda x: F.when(x < 0, F.greatest(x + n, F.lit(0))).otherwise(F.least(x, n))
    first, last = fixed(start), fixed(end)
    return F.slice(a, first + 1, F.greatest(last - first, F.lit(0)))


def continuation(previous: Column | str, reference: Column | str, candidates: Column | str, normalised: bool = False) -> Column:
    """The part of the reference that should follow previous, as long as the first candidate goes beyond it; empty without candidates."""
    ready = (lambda x: x) if normalised else for_training
    p, r = syllables(ready(strip_replacement_marks(previous))), syllables(ready(col(reference)))
    listed = F.transform(col(candidates), lambda c: ready(strip_replacement_marks(c)))
    t = syllables(first_not_blank(listed))
    left = F.size(p) + best_offset(p, r)
    right = F.least(left + F.size(t) - F.size(p), F.size(r))
    return F.when(F.size(col(candidates)) > 0, F.array_join(python_slice(r, left, right), "")).otherwise(F.lit(""))


def correction_samples(chunks: DataFrame, reference: str, count: int, chunk_ms: int) -> DataFrame:
    """Samples for a corrector from parsed log chunks; chunks without a continuation are dropped."""
    clean = lambda x: for_training(strip_replacement_marks(x))
    out = chunks.select(
        F.transform("topk", clean).alias("k_best_candidates"), F.lit(count).alias("num_candidates"), F.lit(chunk_ms).alias("chunk_size"), clean("previous_transcript").alias("previous_transcript"),
        continuation("previous_transcript", reference, "topk").alias("continuation_transcript"), "audio_path", F.col("end").alias("timestamp"),
    )
    return out.where(F.length("continuation_transcript") > 0)


def instruction_rows(samples: DataFrame, audio: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(instruction, response) beside the columns to keep, with audio_path and timestamp if audio: the audio itself stays where it is."""
    previous = F.coalesce("previous_transcript", F.lit(""))
    count = F.coalesce("num_candidates", F.size("k_best_candidates"))
    beside = [*keep, *(("audio_path", "timestamp") if audio else ())]
    return samples.select(*beside, prompt("k_best_candidates", previous, count, audio).alias("instruction"), F.col("continuation_transcript").alias("response"))


def weighted_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """All rows of each part, as many times as its weight; a weight below 2 counts once."""
    out = None
    for df, weight in parts:
        each = df.withColumn("__w", F.explode(F.sequence(F.lit(1), F.lit(weight)))).drop("__w") if weight > 1 else df
        out = each if out is None else out.unionByName(each, allowMissingColumns=True)
    return out


def repeated(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its own weight, at least once."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(weight, F.lit(1)))))


def split(rows: DataFrame, key: str, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training, validation): a row's side depends on its key and the seed alone."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 6), 16, 10).cast("long") % 10_000
    side = rows.withColumn("__b", bucket)
    limit = round(fraction * 10_000)
    return side.where(F.col("__b") >= limit).drop("__b"), side.where(F.col("__b") < limit).drop("__b")


def sample(rows: DataFrame, key: str, n: int, seed: int = 21) -> DataFrame:
    """n rows by a seeded hash of their key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def ranked(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """rows with their place in order, from 0. Rows are dealt to ranges between values of a sample, whose counts say where each range begins, so that
    no task sees all rows. The sample (by a hash of the value, 64 for each range) is all that reaches the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(64 * n).collect())
    bounds = sorted({drawn[k * len(drawn) // n] for k in range(1, n)}) if drawn else []
    at_least = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order)) if bounds else F.array()
    dealt_ = rows.withColumn("__p", F.coalesce(F.size(at_least), F.lit(0)))
    inside = dealt_.withColumn("__k", F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1)
    counts = dealt_.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row for each range.
    upto = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return inside.join(F.broadcast(upto), "__p").withColumn(name, F.col("__k") + F.col("__before")).drop("__p", "__k", "__before")


def dealt(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows with `worker`, dealt in turn by order."""
    return ranked(rows, order, "__place").withColumn("worker", F.pmod("__place", F.lit(n)).cast("int")).drop("__place")


def collated(rows: DataFrame, batch: str, ids: str, prompt_length: str, pad: int, ignore: int = -100) -> DataFrame:
    """rows with input_ids, attention_mask and labels, padded to the longest of their batch; prompt and padding are ignored as labels."""
    size = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = rows.withColumn("__m", size).withColumn("__n", F.size(ids))
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("__m") - F.col("__n")))
    out = out.withColumn("input_ids", padded)
    out = out.withColumn("attention_mask", F.transform("input_ids", lambda x, i: (i < F.col("__n")).cast("int")))
    label = lambda x, i: F.when((i < F.col(prompt_length)) | (i >= F.col("__n")), F.lit(ignore)).otherwise(x)
    return out.withColumn("labels", F.transform("input_ids", label)).drop("__m", "__n")


def not_processed(rows: DataFrame, done: DataFrame, key: Column, done_key: Column) -> DataFrame:
    """rows whose key is not among the processed ones."""
    return rows.withColumn("__k", key).join(done.select(done_key.alias("__k")).distinct(), "__k", "left_anti").drop("__k")


__all__ = ["best_offset", "collated", "continuation", "correction_samples", "dealt", "drop_blank", "instruction_rows", "not_processed", "python_slice", "ranked", "repeated", "sample", "split", "weighted_union"]
