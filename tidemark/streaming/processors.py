"""Structured Streaming forms of the stateful operators, and their batch twins: one step function each.

Every operator is a class with `start()` (the initial state, JSON-serialisable) and `step(state, row) -> (state, outputs)`. batch() folds it over
ordered groups, stream() runs it in transformWithStateInPandas; both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.commit import Committed, agreement_step, clamp_step
from tidemark.operators.runs import other, runs, values
from tidemark.streaming.voice import Buffer, Detector, Router, merged, whole_characters


class Operator:
    """columns: input columns in order of use. output: DDL of what a step gives, without key and order."""

    columns: tuple[str, ...] = ()
    output: str = ""

    def start(self) -> Any:
        return None

    def step(self, state: Any, row: tuple) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def finish(self, state: Any) -> list[tuple]:
        """What is still to be given when no more rows will come."""
        return []


class VoiceEvents(Operator):
    columns, output = ("prob",), "event string, at bigint"

    def start(self):
        return [False, None, 0]

    def step(self, state, row):
        d = Detector(*state)
        event = d.step(row[0])
        return [d.on, d.silent_since, d.at], [event] if event else []


class VoiceRouting(Operator):
    """Chunks of frame probabilities to what goes on to decoding."""

    columns, output = ("probs", "n_samples"), "action string, beg bigint, end bigint"

    def __init__(self, chunk_seconds: float = 1.0):
        self.chunk_seconds = chunk_seconds

    def start(self):
        return {"detector": [False, None, 0], "router": {}}

    def step(self, state, row):
        d, r = Detector(*state["detector"]), Router(**state["router"])
        event = merged([d.step(p) for p in row[0]])
        out = r.step(int(row[1]), event)
        what = r.trigger(self.chunk_seconds)
        if what != "wait":
            out.append((what, r.offset, r.offset))
        return {"detector": [d.on, d.silent_since, d.at], "router": vars(r)}, out


class Agreement(Operator):
    columns, output = ("text", "is_last"), "delta string, committed string"
    #: Streams whose automaton a worker keeps; that of another one is built again when it is needed.
    KEPT = 64

    def __init__(self):
        self.known: dict[str, Committed] = {}

    def start(self):
        return ["", ""]

    def step(self, state, row):
        text, last = row
        if not text or not text.strip():
            return state, []
        known = self.known.pop(state[1], None) or Committed()
        state, delta = agreement_step(tuple(state), text, bool(last), known)
        self.known[state[1]] = known
        if len(self.known) > self.KEPT:
            del self.known[next(iter(self.known))]
        return list(state), [(delta, state[1])] if delta else []

    def finish(self, state):
        """The last hypothesis is final."""
        if not state[0]:
            return []
        state, delta = agreement_step(tuple(state), state[0], True)
        return [(delta, state[1])] if delta else []


class Monotone(Operator):
    columns, output = ("beg", "end"), "beg double, end double"

    def step(self, state, row):
        beg, end = clamp_step(state, float(row[0]), float(row[1]))
        return end, [(beg, end)]


class ChangedLine(Operator):
    columns, output = ("line",), "line string"

    def step(self, state, row):
        return row[0], [] if state is not None and state == row[0] else [(row[0],)]


class CharacterCarry(Operator):
    columns, output = ("raw",), "text string"

    def start(self):
        return ""

    def step(self, state, row):
        text, rest = whole_characters(bytes.fromhex(state), bytes(row[0]))
        return rest.hex(), [(text,)] if text else []

    def finish(self, state):
        """An open character's bytes as replacement marks."""
        return [(bytes.fromhex(state).decode(errors="replace"),)] if state else []


class Retention(Operator):
    columns, output = ("length",), "evicted double, buffered double"

    def __init__(self, most: float = 30.0):
        self.most = most

    def start(self):
        return []

    def step(self, state, row):
        b = Buffer(self.most, list(state))
        gone = b.add(float(row[0]))
        return b.lengths, [(gone, sum(b.lengths))]


class ContextBuffer(Operator):
    """A text context of at most budget words; the oldest leave first. A session's end empties it."""

    columns, output = ("text", "is_last"), "context string"

    def __init__(self, budget: int = 50):
        self.budget = budget

    def start(self):
        return []

    def step(self, state, row):
        words = (state + (row[0] or "").split())[-self.budget :]
        return [] if row[1] else words, [(" ".join(words),)]


def _schema(rows: DataFrame, operator: Operator, key: str, order: str) -> str:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return f"{key} {kind[key]}, {order} {kind[order]}, {operator.output}"


def _run(operator: Operator, state: Any, key_value: Any, pdf: pd.DataFrame, order: str) -> tuple[Any, list[tuple]]:
    out = []
    for row in pdf.sort_values(order)[[order, *operator.columns]].itertuples(index=False, name=None):
        state, got = operator.step(state, row[1:])
        out += [(key_value, row[0], *x) for x in got]
    return state, out


def batch(rows: DataFrame, operator: Operator, key: str, order: str) -> DataFrame:
    """The operator over each key's rows by order. A key's rows are one stream's and pass through one task, which keeps the operator's state and no rows."""
    schema = _schema(rows, operator, key, order)
    names = [x.split()[0] for x in schema.split(", ")]
    types = [f.type for f in to_arrow_schema(StructType.fromDDL(operator.output))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, state, step = None, False, None, operator.step
        for part in batches:
            places, out = [], []
            columns = [values(part.column(k)) for k in range(2, part.num_columns)]
            for n, (k, *row) in enumerate(zip(part.column(0).to_pylist(), *columns, strict=True)):
                if not begun or other(k, last):
                    last, begun, state = k, True, operator.start()
                state, got = step(state, tuple(row))
                for x in got:
                    places.append(n)
                    out.append(x)
            if out:
                at = pa.array(places, pa.int64())
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *made], names)

    return runs(rows.select(key, order, *operator.columns), key, order).mapInArrow(fold, schema)


class _Processor(StatefulProcessor):
    def __init__(self, operator: Operator, order: str, names: list[str]):
        self.operator, self.order, self.names = operator, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.operator.start()
        pdf = pd.concat(list(rows))
        state, out = _run(self.operator, state, key[0], pdf, self.order)
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, operator: Operator, key: str, order: str) -> DataFrame:
    """The same on a streaming DataFrame, for rows that arrive in order within each key. Needs the RocksDB state store."""
    schema = _schema(rows, operator, key, order)
    names = [x.split()[0] for x in schema.split(", ")]
    keyed = rows.select(key, order, *operator.columns).groupBy(key)
    return keyed.transformWithStateInPandas(statefulProcessor=_Processor(operator, order, names), outputStructType=schema, outputMode="Append", timeMode="None")
