"""Extension points: scorers, correctors, generators with fallback, writers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.commit import common_prefix
from tidemark.operators.select import beam_step, finalised
from tidemark.sources.sinks import WRITERS


class Scorer(Protocol):
    """Built once in each Python worker; scores batches of rows."""

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


class Corrector(Protocol):
    def __call__(self, previous: str, candidates: list[str]) -> str: ...


SCORERS: dict[str, Callable[..., Scorer]] = {}


def scorer(name: str):
    """Registers a factory of scorers under a name."""

    def add(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        SCORERS[name] = factory
        return factory

    return add


def scored(rows: DataFrame, name: str, schema: str, **options) -> DataFrame:
    factory = SCORERS[name]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory(**options)
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(work, schema)


class SequenceDecoder(Protocol):
    """Picks tokens step by step: reset() before the first step, update() with (key, beam, token, score, seq) candidates of a step gives the beams
    that go on, finalise() the finished sequences."""

    def reset(self) -> None: ...

    def update(self, candidates: DataFrame) -> DataFrame: ...

    def finalise(self) -> DataFrame: ...


class BeamDecoder:
    """Beam search in DataFrame steps. A key is complete with round(width * patience) finished sequences; those that come later don't count."""

    def __init__(self, key: str, width: int, end_token: int, patience: float = 1.0):
        self.key, self.width, self.end_token, self.most = key, width, end_token, round(width * patience)
        self.reset()

    def reset(self) -> None:
        self.going, self.finished, self.steps = None, None, 0

    def update(self, candidates: DataFrame) -> DataFrame:
        self.going, ended = beam_step(candidates, self.key, "beam", "token", "score", "seq", self.width, self.end_token)
        ended = ended.select(self.key, "seq", "score", F.lit(self.steps).alias("step"))
        self.steps += 1
        both = ended if self.finished is None else self.finished.unionByName(ended)
        place = F.row_number().over(Window.partitionBy(self.key).orderBy("step", F.desc("score"), "seq"))
        self.finished = both.withColumn("place", place).where(F.col("place") <= self.most).drop("place")
        return self.going

    def complete(self) -> DataFrame:
        """Keys that need no more steps."""
        return self.finished.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col("n") >= self.most).select(self.key)

    def finalise(self) -> DataFrame:
        return finalised(self.finished.drop("step"), self.going.select(self.key, "seq", "score"), self.key, "score", "seq", self.width, self.end_token)


class GreedyDecoder(BeamDecoder):
    """The best token of each step."""

    def __init__(self, key: str, end_token: int):
        super().__init__(key, 1, end_token)


def agreed_extension(previous: str, candidates: list[str]) -> str:
    """The default corrector: the longest text by which most candidates extend what is confirmed; of equals the longer one."""
    extensions = [c[len(previous) :] for c in candidates if c.strip() and c.startswith(previous)]
    best, support = "", 0
    for x in extensions:
        for y in extensions:
            shared = common_prefix(x, y)
            n = sum(z.startswith(shared) for z in extensions)
            if shared and (n, len(shared)) > (support, len(best)):
                best, support = shared, n
    return best


def corrected(rows: DataFrame, previous: str, candidates: str, corrector: Corrector = agreed_extension) -> DataFrame:
    """rows with `correction`."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["correction"] = [corrector(p or "", [x for x in (c if c is not None else []) if x is not None]) for p, c in zip(batch[previous], batch[candidates], strict=True)]
            yield batch

    return rows.mapInPandas(work, rows.selectExpr("*", "'' AS correction").schema)


def with_fallback(first: Callable[[str], Iterable[str]], second: Callable[[str], Iterable[str]]) -> Callable[[str], list[tuple[int, str]]]:
    """A generator of ranked candidates that takes the second way where the first fails."""

    def generate(x: str) -> list[tuple[int, str]]:
        try:
            found = list(first(x))
        except Exception:  # noqa: BLE001  the second way is for any failure
            found = list(second(x))
        return list(enumerate(found))

    return generate


def guarded(rows: DataFrame, key: str, work: Callable[[pd.Series], dict], columns: dict[str, str]) -> DataFrame:
    """(key, columns, error): a row that fails carries its error instead of ending the job."""
    kind = rows.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, row in batch.iterrows():
                try:
                    out.append({key: row[key], **work(row), "error": None})
                except Exception as e:  # noqa: BLE001
                    out.append({key: row[key], **dict.fromkeys(columns), "error": str(e)})
            yield pd.DataFrame(out, columns=[key, *columns, "error"])

    return rows.mapInPandas(each, ", ".join([f"{key} {kind}", *(f"{c} {t}" for c, t in columns.items()), "error string"]))


writer = WRITERS.__getitem__
