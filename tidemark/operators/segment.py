"""Segmentation of streams: chunks, hysteresis, gaps, buffers, timestamp pairs. Windows, and one fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(files: DataFrame, duration: str, step: float, start: float = 0.0) -> DataFrame:
    """A row for each tumbling chunk [beg, end) of a file. The last is clipped to the duration; the first never is."""
    n = F.greatest(F.ceil((F.col(duration) - start) / step), F.lit(1)).cast("int")
    each = files.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    beg = F.lit(start) + F.col("chunk") * step
    end = F.when(F.col("chunk") == 0, beg + step).otherwise(F.least(beg + step, F.col(duration)))
    return each.withColumn("beg", beg).withColumn("end", end).withColumn("emission_time", F.col("end"))


def hysteresis(rows: DataFrame, key: str, order: str, high: Column, low: Column, time: Column, min_silence: Column | float) -> DataFrame:
    """Voice segments' edges as (key, event, at): a start at a high row while off; an end at the first low row since the last high one, once
    low rows have lasted min_silence. Rows between the thresholds neither extend nor cancel. Two window passes, no state."""
    ordered = Window.partitionBy(key).orderBy(order)
    marked = rows.select(key, F.col(order), time.alias("__t"), high.alias("__high"), low.alias("__low"))
    grouped = marked.withColumn("__grp", F.sum(F.col("__high").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).where("__grp > 0")
    first_low = F.min(F.when(F.col("__low"), F.col("__t")))
    groups = grouped.groupBy(key, "__grp").agg(
        F.min(F.when(F.col("__high"), F.col("__t"))).alias("start_at"), first_low.alias("end_at"), F.max(F.when(F.col("__low"), F.col("__t"))).alias("last_low")
    )
    groups = groups.withColumn("ends", F.coalesce(F.col("last_low") - F.col("end_at") >= min_silence, F.lit(False)))
    before = F.lag("ends").over(Window.partitionBy(key).orderBy("__grp"))
    groups = groups.withColumn("starts", F.coalesce(before, F.lit(True)))
    events = F.array(F.struct(F.col("starts").alias("is"), F.lit("start").alias("event"), F.col("start_at").alias("at")), F.struct(F.col("ends").alias("is"), F.lit("end").alias("event"), F.col("end_at").alias("at")))
    return groups.select(key, F.explode(F.filter(events, lambda e: e["is"])).alias("e")).select(key, "e.event", "e.at")


def padded_edges(edges: DataFrame, pad: int = 1600, window: int = 512) -> DataFrame:
    """Sample positions of edges, with speech padding and the frame that had already gone by."""
    at = F.when(F.col("event") == "start", F.greatest(F.lit(0), F.col("at") - pad - window)).otherwise(F.col("at") + pad - window)
    return edges.withColumn("at", at)


def gap_sessions(rows: DataFrame, key: str, time: Column, order: list[str], gap: float) -> DataFrame:
    """rows with a session number that grows where a row begins more than gap after the one before."""
    ordered = Window.partitionBy(key).orderBy(*order)
    fresh = F.coalesce((time - F.lag(time).over(ordered) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__new", fresh).withColumn("session", F.sum("__new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def pair_segments(rows: DataFrame, key: str, order: list[str], is_time: Column) -> DataFrame:
    """rows with a segment number: a segment begins after each row with a timestamp that the next row has too."""
    ordered = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__ts", is_time)
    cut = F.coalesce(F.lag("__ts").over(ordered) & F.col("__ts"), F.lit(False)).cast("int")
    return marked.withColumn("__cut", cut).withColumn("segment", F.sum("__cut").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__cut", "__ts")


def ends_single(flags: Column) -> Column:
    """Do the flags end in false, true?"""
    return F.when(F.size(flags) >= 2, (~F.element_at(flags, -2)) & F.element_at(flags, -1)).otherwise(F.lit(False))


def retained(rows: DataFrame, key: str, time: Column, seconds: int, value: str) -> DataFrame:
    """Sum and count of a sliding buffer that holds the last seconds."""
    window = Window.partitionBy(key).orderBy(time).rangeBetween(-seconds, 0)
    return rows.withColumn("buffered", F.sum(value).over(window)).withColumn("n_buffered", F.count("*").over(window))


def within_budget(rows: DataFrame, key: str, order: list[str], size: str, budget: int, fixed: Column | None = None) -> DataFrame:
    """The last rows of each key whose sizes sum to budget at most; rows that are fixed stay and count first."""
    fixed = F.lit(False) if fixed is None else fixed
    tail = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__fixed", fixed).withColumn("__free", F.when(F.col("__fixed"), 0).otherwise(F.col(size)))
    spent = F.sum(F.when(F.col("__fixed"), F.col(size)).otherwise(0)).over(Window.partitionBy(key))
    kept = marked.withColumn("__sum", F.sum("__free").over(tail) + spent)
    return kept.where(F.col("__fixed") | (F.col("__sum") <= budget)).drop("__fixed", "__free", "__sum")


def last_of_subgroup(rows: DataFrame, key: str, subgroup: str, order: str, k: int) -> DataFrame:
    """The last k rows of each key's last subgroup."""
    newest = F.max(subgroup).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key, subgroup).orderBy(F.col(order).desc()))
    return rows.withColumn("__m", newest).withColumn("__k", rank).where((F.col("__m") == F.col(subgroup)) & (F.col("__k") <= k)).drop("__m", "__k")


def jumps(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows where value differs from the row before; the first always does."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.where(F.lit(True)).withColumn("__d", F.coalesce(step, F.lit(1))).where("__d <> 0").drop("__d")


def triggered(rows: DataFrame, key: str, order: str, size: str, threshold: float) -> DataFrame:
    """(key, order, runs): does the count of what came since the last run exceed the threshold here? A fold over sorted partitions that holds one
    number, not a key's rows."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, 0.0
        for batch in batches:
            runs = []
            for k, n in zip(batch[key], batch[size], strict=True):
                total = (total if k == now else 0.0) + float(n)
                now = k
                runs.append(total > threshold)
                total = 0.0 if runs[-1] else total
            yield batch[[key, order]].assign(runs=runs)

    ordered = rows.select(key, order, size).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, runs boolean")


def long_enough(segments: DataFrame, samples: str, least: int = 1600) -> DataFrame:
    """Segments with enough samples to be worth decoding; shorter ones give nothing."""
    return segments.where(F.col(samples) >= least)


def waits(segments: DataFrame, key: str, order: str, seconds: str, least: float) -> DataFrame:
    """segments with `ready`: has enough audio of the key come by then? Until it has, nothing is decoded."""
    upto = F.sum(seconds).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("ready", upto >= least)


def refreshed(rows: DataFrame, key: str, order: str, resets: Column, language: str, complete: Column | None = None) -> DataFrame:
    """rows with the state that a refresh empties: `segment` (refreshes so far), `step` in it, the `language` detected since, and `is_first`: is this the
    first row since a complete refresh, which alone takes a first-token latency anew?"""
    ordered = Window.partitionBy(key).orderBy(order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = F.lit(False) if complete is None else complete
    marked = rows.withColumn("segment", F.sum(F.coalesce(resets, F.lit(False)).cast("int")).over(upto)).withColumn("__whole", F.sum(F.coalesce(resets & whole, F.lit(False)).cast("int")).over(upto))
    inside = Window.partitionBy(key, "segment").orderBy(order)
    out = marked.withColumn("step", F.row_number().over(inside) - 1).withColumn("detected", F.first(language, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("is_first", F.row_number().over(Window.partitionBy(key, "__whole").orderBy(order)) == 1).drop("__whole")
