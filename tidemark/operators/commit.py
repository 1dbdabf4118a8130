"""Commit policies: what of an incremental hypothesis is final. Pure step functions, used here and by streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.blocks import SuffixAutomaton
from tidemark.functions.text import bound


def common_prefix(a: str, b: str) -> str:
    """The longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a[:lo]


class Committed:
    """A committed text that grows, with the automaton of its blocks, which is built when it is first asked for and grows along."""

    def __init__(self):
        self.automaton: SuffixAutomaton | None = None
        self.text = ""

    def grown(self, text: str) -> SuffixAutomaton:
        if self.automaton is None or not text.startswith(self.text):
            self.automaton, self.text = SuffixAutomaton(), ""
        self.automaton.extend(text[len(self.text) :])
        self.text = text
        return self.automaton


def after_longest_match(committed: str, confirmed: str, known: Committed | None = None) -> str:
    """What follows in confirmed the longest block that it shares with committed; all of it if they share nothing."""
    _, at, size = (known or Committed()).grown(committed).longest_in(confirmed)
    return confirmed[at + size :] if size else confirmed


def agreement_step(state: tuple[str, str], full: str, final: bool, known: Committed | None = None) -> tuple[tuple[str, str], str]:
    """state: previous hypothesis and committed text. known: of this stream. -> new state, text to emit now."""
    previous, committed = state
    confirmed = full if final else common_prefix(previous, full)
    if confirmed.startswith(committed):
        delta = confirmed[len(committed) :]
    else:
        delta = after_longest_match(committed, confirmed, known) if confirmed else ""
    return (full, committed + delta), delta


def local_agreement(rows: DataFrame, key: str, order: str, text: str, final: str) -> DataFrame:
    """(key, order, delta, committed): what each step commits. Blank hypotheses change nothing."""
    kind = rows.schema[key].dataType.simpleString()

    def fold(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out, known = ("", ""), [], Committed()
        for o, t, f in pdf.sort_values(order)[[order, text, final]].itertuples(index=False):
            delta = ""
            if t and t.strip():
                state, delta = agreement_step(state, t, bool(f), known)
            out.append((pdf[key].iloc[0], o, delta, state[1]))
        return pd.DataFrame(out, columns=[key, order, "delta", "committed"])

    return rows.select(key, order, text, final).groupBy(key).applyInPandas(fold, f"{key} {kind}, {order} {rows.schema[order].dataType.simpleString()}, delta string, committed string")


def prefix_agreement(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """rows with `agreed`: the common prefix with the row before, in Catalyst."""
    from tidemark.functions.text import common_prefix as shared

    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__p", before).withColumn("agreed", shared("__p", text)).drop("__p")


def clamp_step(last_end: float | None, beg: float, end: float) -> tuple[float, float]:
    beg = beg if last_end is None else max(beg, last_end + 0.001)
    return beg, max(end, beg + 0.001)


def monotone(rows: DataFrame, key: str, order: str, beg: str, end: str) -> DataFrame:
    """(key, order, beg, end) with each interval after the one before and of 1 ms at least.

    The end of row i is the largest of m_j + 0.002 (i - j) over the rows j up to it, with m_j = max(end_j, beg_j + 0.001): a running maximum
    of m_j - 0.002 j, so one sort and no state."""
    ordered = Window.partitionBy(key).orderBy(order)
    own = F.greatest(F.col("__e"), F.col("__b") + 0.001)
    placed = rows.select(key, order, F.col(beg).cast("double").alias("__b"), F.col(end).cast("double").alias("__e"), (F.row_number().over(ordered) * 0.002).alias("__n"))
    ends = placed.withColumn("__end", F.max(own - F.col("__n")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__n"))
    before = F.lag("__end").over(ordered)
    return ends.select(key, order, F.greatest(F.col("__b"), F.coalesce(before + 0.001, F.col("__b"))).alias(beg), F.col("__end").alias(end))


def before_cut(steps: DataFrame, key: str, order: str, violates: Column) -> DataFrame:
    """The steps before a key's first violation: those from it on are dropped."""
    first = F.min(F.when(violates, F.col(order))).over(Window.partitionBy(key))
    return steps.withColumn("__cut", first).where(F.col("__cut").isNull() | (F.col(order) < F.col("__cut"))).drop("__cut")


def attention_cut(steps: DataFrame, key: str, order: str, frame: str, content: str, threshold: int, is_last: Column | None = None) -> DataFrame:
    """Decoding stops where the most attended frame comes within threshold of the content's end (beyond it, in the last pass)."""
    limit = F.when(F.lit(False) if is_last is None else is_last, -1).otherwise(threshold)
    return before_cut(steps, key, order, F.col(content) - F.col(frame) <= limit)


def rewind_cut(steps: DataFrame, key: str, order: str, frame: str, threshold: int, exempt: Column | None = None) -> DataFrame:
    """Decoding stops where the attended frame jumps back by more than threshold."""
    back = F.lag(frame).over(Window.partitionBy(key).orderBy(order)) - F.col(frame) > threshold
    marked = steps.withColumn("__back", F.coalesce(back & ~(F.lit(False) if exempt is None else exempt), F.lit(False)))
    return before_cut(marked, key, order, F.col("__back")).drop("__back")


def committed_words(words: Column | str, fired: Column, last: Column) -> Column:
    """All words if the last is known to be complete; otherwise all but the last."""
    words = F.col(words) if isinstance(words, str) else words
    return F.when(fired | last, words).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def word_times(words: Column | str, frames: Column | str, offset: Column, frame_seconds: float = 0.02) -> Column:
    """words: array of structs (text, tokens). Each with start and end by its tokens' frames; missing frames on the left repeat the first. In time that grows with the words."""
    words = F.col(words) if isinstance(words, str) else words
    frames = F.col(frames) if isinstance(frames, str) else frames
    # A mark behind each word's tokens: its place, less the marks before it, is the number of tokens up to there.
    marks = F.flatten(F.transform(words, lambda w: F.concat(F.array_repeat(F.lit(False), F.size(w["tokens"])), F.array(F.lit(True)))))
    places = F.filter(F.transform(marks, lambda mark, k: F.when(mark, k)), lambda k: k.isNotNull())
    known = F.struct(words.alias("words"), frames.alias("frames"), F.transform(places, lambda k, i: k - i).alias("upto"))

    def with_frames(x: Column) -> Column:
        need = F.coalesce(F.get(x["upto"], F.size(x["upto"]) - 1), F.lit(0))
        full = F.concat(F.array_repeat(F.element_at(x["frames"], 1), F.greatest(need - F.size(x["frames"]), F.lit(0))), x["frames"])
        return F.struct(x["words"].alias("words"), x["upto"].alias("upto"), full.alias("full"))

    def timed(x: Column) -> Column:
        at = lambda k: F.element_at(x["full"], k) * frame_seconds + offset
        before = lambda i: F.coalesce(F.get(x["upto"], i - 1), F.lit(0))
        return F.transform(x["words"], lambda w, i: F.struct(at(before(i) + 1).alias("start"), at(F.get(x["upto"], i)).alias("end"), w["text"].alias("text"), w["tokens"].alias("tokens")))

    return bound(bound(known, with_frames), timed)


def changed_lines(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """rows whose line differs from the one before."""
    same = F.lag(line).over(Window.partitionBy(key).orderBy(order)).eqNullSafe(F.col(line)) & F.lag(F.lit(True)).over(Window.partitionBy(key).orderBy(order)).isNotNull()
    return rows.withColumn("__same", same).where("NOT __same").drop("__same")
