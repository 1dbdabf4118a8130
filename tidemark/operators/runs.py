"""Rows of a key one after the other, as a stream that a task reads: what a fold over ordered rows needs, without a group for each key."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with those of a key one after the other, by order: what a task has to see of a stream, without a group in memory."""
    return rows.repartition(key).sortWithinPartitions(F.col(key), *(F.col(c).asc_nulls_last() for c in order))


def values(column: pa.Array) -> list:
    """A column as Python values; a number that is missing is NaN."""
    found = column.to_pylist()
    if column.null_count and (pa.types.is_floating(column.type) or pa.types.is_integer(column.type)):
        return [float("nan") if x is None else x for x in found]
    return found


def other(key: Any, last: Any) -> bool:
    """Does a row of key begin another stream than that of last? NaN is one key."""
    return key != last and not (key != key and last != last)
