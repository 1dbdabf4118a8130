"""Sessions of connections: an operator's state from a connection's first row to its end, which a closing row or silence brings.

A session ends with a row that closes it, or when its connection has been quiet for some time: then a timer fires, the operator says what it still has to say,
and the state goes. A row that comes after so long a silence begins the next session, whether or not the timer has fired before, so a stream gives what
batch() gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.processors import Operator

#: How a session ended.
CLOSED, QUIET = "closed", "quiet"


class Session:
    """One connection: its operator's state, the number of its session, and when its last row came (ms)."""

    def __init__(self, operator: Operator, quiet_ms: int, number: int = 0, at: int | None = None, state: Any = None):
        self.operator, self.quiet_ms, self.number, self.at, self.state = operator, quiet_ms, number, at, state

    def saved(self) -> str:
        return json.dumps([self.number, self.at, self.state])

    @classmethod
    def restored(cls, operator: Operator, quiet_ms: int, saved: str) -> Session:
        return cls(operator, quiet_ms, *json.loads(saved))

    @property
    def open(self) -> bool:
        return self.at is not None

    @property
    def deadline(self) -> int:
        return self.at + self.quiet_ms

    def end(self, how: str) -> list[tuple]:
        """(session, ended, outputs): what the operator still gives, and a row that says how the session ended."""
        blank = (None,) * len(self.operator.output.split(", "))
        out = [(self.number, None, *x) for x in self.operator.finish(self.state)] + [(self.number, how, *blank)]
        self.number, self.at, self.state = self.number + 1, None, None
        return out

    def take(self, at: int, closes: bool, row: tuple) -> list[tuple]:
        out = self.end(QUIET) if self.open and at - self.at > self.quiet_ms else []
        if not self.open:
            self.state = self.operator.start()
        self.at = at if self.at is None else max(self.at, at)
        self.state, got = self.operator.step(self.state, row)
        out += [(self.number, None, *x) for x in got]
        return out + self.end(CLOSED) if closes else out


def _prepared(rows: DataFrame, operator: Operator, key: str, order: str, time: str, closes: Column | None) -> tuple[DataFrame, str]:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shut = F.coalesce(closes, F.lit(False)) if closes is not None else F.lit(False)
    ready = rows.select(F.col(key), F.col(order), F.col(time).cast("timestamp").alias("row_time"), shut.alias("row_closes"), *operator.columns)
    return ready, f"{key} {kinds[key]}, session bigint, ended string, {operator.output}"


def _taken(session: Session, key: Any, pdf: pd.DataFrame, order: str) -> list[tuple]:
    columns = ["row_time", "row_closes", *session.operator.columns]
    out = []
    for at, closes, *row in pdf.sort_values(order)[columns].itertuples(index=False, name=None):
        out += [(key, *x) for x in session.take(int(at.timestamp() * 1000), bool(closes), tuple(row))]
    return out


def batch(rows: DataFrame, operator: Operator, key: str, order: str, time: str, quiet_ms: int, closes: Column | None = None) -> DataFrame:
    """(key, session, ended, outputs) of all connections, the last session of each as one that fell quiet. A connection's rows pass through one task."""
    ready, schema = _prepared(rows, operator, key, order, time, closes)
    names = [x.split()[0] for x in schema.split(", ")]

    def fold(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session(operator, quiet_ms)
        out = _taken(session, k[0], pdf, order)
        if session.open:
            out += [(k[0], *x) for x in session.end(QUIET)]
        return pd.DataFrame(out, columns=names)

    return ready.groupBy(key).applyInPandas(fold, schema)


class _Connections(StatefulProcessor):
    """An open session has its state and a timer for its silence. Of an ended one its number is left, which is forgotten after keep_ms: by its time to live where
    the clock decides, by a timer where the rows' times do."""

    def __init__(self, operator: Operator, order: str, names: list[str], quiet_ms: int, keep_ms: int, by_clock: bool):
        self.operator, self.order, self.names, self.quiet_ms, self.keep_ms, self.by_clock = operator, order, names, quiet_ms, keep_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "saved string")
        self.ended = handle.getValueState("ended", "number bigint", *([self.keep_ms] if self.by_clock else []))

    def _session(self) -> Session:
        if self.live.exists():
            return Session.restored(self.operator, self.quiet_ms, self.live.get()[0])
        return Session(self.operator, self.quiet_ms, self.ended.get()[0] if self.ended.exists() else 0)

    def _keep(self, session: Session, last: int, now: int) -> None:
        """last: the time of the connection's last row. now: the clock."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if session.open:
            self.live.update((session.saved(),))
            self.handle.registerTimer((now if self.by_clock else last) + self.quiet_ms)
        else:
            self.live.clear()
            self.ended.update((session.number,))
            if not self.by_clock:
                self.handle.registerTimer(last + self.quiet_ms + self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, pdf = self._session(), pd.concat(list(rows))
        out = _taken(session, key[0], pdf, self.order)
        self._keep(session, int(pdf["row_time"].max().timestamp() * 1000), timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.live.exists():
            session = self._session()
            last = session.at
            out = [(key[0], *x) for x in session.end(QUIET)]
            self._keep(session, last, timerValues.getCurrentProcessingTimeInMs())
        else:
            self.ended.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, operator: Operator, key: str, order: str, time: str, quiet_ms: int, closes: Column | None = None, delay: str = "0 seconds", by_clock: bool = False, keep_ms: int = 3_600_000) -> DataFrame:
    """The same on a stream, for rows that come in order within a connection. Needs the RocksDB state store.

    By default time is the rows' own: a session ends when the watermark, delay behind the latest row of any connection, has passed its last row by quiet_ms.
    With by_clock a connection that gave no row for quiet_ms has ended. The number of a connection's sessions is forgotten keep_ms after its last one."""
    ready, schema = _prepared(rows, operator, key, order, time, closes)
    names = [x.split()[0] for x in schema.split(", ")]
    ready = ready if by_clock else ready.withWatermark("row_time", delay)
    processor = _Connections(operator, order, names, quiet_ms, keep_ms, by_clock)
    return ready.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if by_clock else "EventTime")
