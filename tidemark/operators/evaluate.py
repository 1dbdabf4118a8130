"""Evaluation: references against hypotheses, error rates per file, averages and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.edit import character_error_rate, mixed_error_rate
from tidemark.functions.text import base_name, stem


def dual_keyed(rows: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """Each row under its base name and its stem, as `file`; of equal keys the last by order stays."""
    keyed = rows.withColumn("file", F.explode(F.array_distinct(F.array(base_name(path), stem(path)))))
    rest = [c for c in rows.columns if c != "file"]
    last = F.max_by(F.struct(*rest), F.col(order) if order else F.struct(*rest))
    return keyed.groupBy("file").agg(last.alias("r")).select("file", "r.*")


def matched(references: DataFrame, hypotheses: DataFrame, key: str = "file") -> DataFrame:
    """References left, with `generated` and whether a hypothesis was there."""
    found = hypotheses.select(key, F.col("generated"), F.lit(True).alias("is_matched"))
    return references.join(found, key, "left").withColumn("is_matched", F.coalesce("is_matched", F.lit(False)))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all tasks: an edit distance costs the square of a text's length, so a file of a few MB is worth more than the one task that would read it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def metric_rows(pairs: DataFrame, language: Column | str = "language", han=None) -> DataFrame:
    """file, reference, generated and their error rates and lengths, for matched rows."""
    lang = F.col(language) if isinstance(language, str) else language
    return spread(pairs.where("is_matched")).select(
        "file", "reference", "generated",
        character_error_rate("reference", "generated", lang, han).alias("cer"), mixed_error_rate("reference", "generated", lang, han).alias("mer"),
        F.length("reference").cast("bigint").alias("ref_length"), F.length("generated").cast("bigint").alias("gen_length"),
    )


def with_latencies(metrics: DataFrame, latencies: DataFrame) -> DataFrame:
    """Metric rows with first and last token latency in ms where there is one; 0 counts as none."""
    ms = lambda c: F.when(F.col(c) != 0, F.col(c) * 1000).alias(f"{c}_ms")
    return metrics.join(latencies.select("file", ms("first_token_latency"), ms("last_token_latency")), "file", "left")


def summary(pairs: DataFrame, metrics: DataFrame, per_file: bool = False) -> DataFrame:
    """One row: counts, macro averages (0 without a match), mean latencies (null without one); with per_file all metric rows in it."""
    late = [c for c in ("first_token_latency_ms", "last_token_latency_ms") if c in metrics.columns]
    marks = pairs.select("is_matched", F.lit(None).cast("string").alias("file"))
    rows = marks.unionByName(metrics, allowMissingColumns=True)
    out = [F.count("is_matched").alias("total_files"), F.count_if("is_matched").alias("matched_files"), F.count_if(~F.col("is_matched")).alias("unmatched_files")]
    out += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"average_{c}") for c in ("cer", "mer")] + [F.avg(c).alias(f"average_{c}") for c in late]
    if per_file:
        out.append(F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), F.struct(*metrics.columns)))).alias("per_file_results"))
    return rows.agg(*out)


def point_lookup(references: DataFrame, file: str) -> DataFrame:
    return references.where(F.col("file") == file)


def latencies(emissions: DataFrame, key: str, emitted: str, received: str, order: str, warm_up: str | None = None) -> DataFrame:
    """First (once a stream) and last token latency of each stream; warm-up rows don't count."""
    rows = emissions.where(~F.col(warm_up)) if warm_up else emissions
    late = F.col(emitted) - F.col(received)
    return rows.groupBy(key).agg(F.min_by(late, order).alias("first_token_latency"), F.max_by(late, order).alias("last_token_latency"))


def corrected_latency(elapsed: Column, corrector: Column, n_chars: Column) -> Column:
    """First-token latency when a corrector ran: without the share of its time for all characters but the first."""
    return elapsed - corrector / (n_chars + 1) * n_chars


def run_results(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Per file its joined text and ordered segments."""
    rows = F.array_sort(F.collect_list(F.struct(order, "start", "end", "text")))
    return segments.groupBy(key).agg(rows.alias("segments")).withColumn("final_text", F.array_join(F.transform("segments", lambda x: x["text"]), " "))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before it: one sort of the union by key, no inequality join."""
    from pyspark.sql import Window

    l = left.withColumn("__t", F.col(left_time)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__r", F.lit(1))
    r = right.select(key, F.col(right_time).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__r"))
    window = Window.partitionBy(key).orderBy("__t", "__r").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(window))
    return both.where("__r = 1").drop("__t", "__v", "__r")
