"""Ranking and selection of hypotheses: beams, greedy picks, length penalties, retry ladders, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_penalty(length: Column, alpha: float | None = None) -> Column:
    """The length itself, or ((5 + length) / 6) ^ alpha."""
    return length if alpha is None else F.pow((length + 5) / 6, F.lit(alpha))


def ranked_best(rows: DataFrame, key: str, index: str, logprob: str, length: str, alpha: float | None = None) -> DataFrame:
    """The best candidate of each key by penalised log probability; of equals the lowest index."""
    score = F.col(logprob) / length_penalty(F.col(length), alpha)
    return rows.groupBy(key).agg(F.max_by(F.col(index), F.struct(score, -F.col(index))).alias(index), F.max(score).alias("score"))


def beam_step(candidates: DataFrame, key: str, beam: str, token: str, score: str, sequence: str, width: int, end_token: int) -> tuple[DataFrame, DataFrame]:
    """One step of beam search over (key, beam, token, score, sequence so far): each beam's best width + 1 tokens, equal
    sequences once, the best width that go on as the next beams; and those ended above the last of them."""
    own = Window.partitionBy(key, beam).orderBy(F.col(score).desc(), token)
    best = candidates.withColumn("__k", F.row_number().over(own)).where(F.col("__k") <= width + 1)
    grown = best.withColumn(sequence, F.concat(F.col(sequence), F.array(F.col(token))))
    once = grown.groupBy(key, sequence).agg(F.max(score).alias(score), F.min(beam).alias(beam), F.max(token).alias(token))
    over = Window.partitionBy(key).orderBy(F.col(score).desc(), beam, token)
    going = (F.col(token) != end_token).cast("int")
    walked = once.withColumn("__on", going).withColumn("__n", F.sum("__on").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    next_beams = walked.where((F.col("__on") == 1) & (F.col("__n") <= width)).withColumn(beam, (F.col("__n") - 1).cast("int"))
    finished = walked.where((F.col("__on") == 0) & (F.col("__n") < width))
    keep = [key, beam, sequence, score]
    return next_beams.select(*keep), finished.select(*keep)


def finalised(finished: DataFrame, unfinished: DataFrame, key: str, score: str, sequence: str, width: int, end_token: int) -> DataFrame:
    """Finished sequences, filled up to width with unfinished ones by score, which get an end token."""
    both = finished.select(key, sequence, score, F.lit(0).alias("__late")).unionByName(unfinished.select(key, F.concat(sequence, F.array(F.lit(end_token))).alias(sequence), score, F.lit(1).alias("__late")))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__late", F.col(score).desc(), sequence))
    return both.withColumn("__k", rank).where((F.col("__late") == 0) | (F.col("__k") <= width)).drop("__k", "__late")


def greedy(rows: DataFrame, key: str, token: str, logit: str) -> DataFrame:
    """(key, token, logprob) of the largest logit; of equals the lowest token."""
    best = rows.groupBy(key).agg(F.max_by(F.col(token), F.struct(F.col(logit), -F.col(token))).alias(token), F.max(logit).alias("top"))
    window = Window.partitionBy(key)
    shifted = rows.withColumn("__top", F.max(logit).over(window)).groupBy(key, "__top").agg(F.log(F.sum(F.exp(F.col(logit) - F.col("__top")))).alias("__lse"))
    return best.join(shifted, key).select(key, token, (-F.col("__lse")).alias("logprob"))


def ladder(rows: DataFrame, key: str, temperature: str, accepted: Column, *columns: str) -> DataFrame:
    """The result at the lowest temperature that was accepted; the last one tried where none was."""
    item = F.struct(temperature, *columns)
    t = F.col(temperature)
    best = F.coalesce(F.min_by(item, F.when(accepted, t)), F.max_by(item, t))
    return rows.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def needs_fallback(compression: Column, avg_logprob: Column, no_speech: Column, compression_limit: float = 2.4, logprob_limit: float = -1.0, no_speech_limit: float = 0.6) -> Column:
    """Should decoding be tried again? Too repetitive or too unlikely, unless there is no speech."""
    return ((compression > compression_limit) | (avg_logprob < logprob_limit)) & ~F.coalesce(no_speech > no_speech_limit, F.lit(False))


def is_silent(no_speech: Column, avg_logprob: Column, no_speech_limit: float = 0.6, logprob_limit: float | None = -1.0) -> Column:
    silent = no_speech > no_speech_limit
    return silent if logprob_limit is None else silent & ~(avg_logprob > logprob_limit)


def average_logprob(total: Column, length: Column) -> Column:
    return total / (length + 1)


def detected_language(rows: DataFrame, key: str, language: str, logit: str, allowed: list[str] | None = None) -> DataFrame:
    """(key, language, probabilities): softmax over the allowed languages and its first maximum."""
    rows = rows.where(F.col(language).isin(allowed)) if allowed else rows
    top = F.max(logit).over(Window.partitionBy(key))
    e = rows.withColumn("__e", F.exp(F.col(logit) - top))
    p = e.withColumn("__p", F.col("__e") / F.sum("__e").over(Window.partitionBy(key)))
    return p.groupBy(key).agg(F.max_by(F.struct(language), F.struct("__p", F.lit(0))).getField(language).alias(language), F.map_from_entries(F.array_sort(F.collect_list(F.struct(language, "__p")))).alias("probabilities"))


def carried_from(rows: DataFrame, key: str, order: str, temperature: str, conditioned: Column | None = None, limit: float = 0.5) -> DataFrame:
    """rows with `prompt_from`: the first row whose text is still in the prompt; a hot or unconditioned row empties it."""
    reset = F.col(temperature) > limit
    if conditioned is not None:
        reset = reset | ~conditioned
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__r", F.when(reset, F.col(order) + 1)).withColumn("prompt_from", F.coalesce(F.max("__r").over(before), F.lit(0))).drop("__r")


def cleared(segments: DataFrame) -> DataFrame:
    """Segments without duration or text keep their place but lose text, tokens and words."""
    hollow = (F.col("start") == F.col("end")) | (F.trim("text") == "")
    out = segments.withColumn("__hollow", hollow)
    for c in ("tokens", "words"):
        if c in segments.columns:
            out = out.withColumn(c, F.when(F.col("__hollow"), F.array().cast(segments.schema[c].dataType)).otherwise(F.col(c)))
    return out.withColumn("text", F.when(F.col("__hollow"), "").otherwise(F.col("text"))).drop("__hollow")
