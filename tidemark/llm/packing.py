"""Variable-capacity best-fit packing (operator 9).

Documents become items of whole token counts; longer ones than the largest permitted length are cut into full pieces and a rest.
Items are dealt by a hash of their row into shards of about the same numbers of tokens and items, so a shard fits into one task however large
the table is and whatever rows repeat. In a shard, items go by falling size into the open bin that they fill best. If none has room, a bin is
opened. Several rules say of which size: the one of the least expected cost (the padding that would be left if the bin were filled as the shard's
items allow), or the smallest permitted length from one of them on that takes the item, of which the largest alone is plain best fit. In the
end each bin is downsized to the smallest permitted length that holds its contents, and the rule whose bins cost least is the shard's.

Defined cases: null or empty text has no items and one row without a bin; a null doc_id is packed like others; repeated rows are packed each
for itself; ties go by doc_id, then by the item's number; other columns play no part. Which rows share a shard depends on how the table's rows lie.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.token_counts import total_counts

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin beside its tokens: attention makes long sequences dearer.
COST_PER_TOKEN = {512: 1.0, 1024: 1.0, 2048: 1.02, 4096: 1.05}
SHARD_TOKENS, SHARD_ITEMS = 1_000_000, 50_000
_PACKED = "doc_id long, item int, bin_id string, capacity int, start int, size int"


def cost(capacity: float) -> float:
    return capacity * COST_PER_TOKEN.get(capacity, 1.0)


def _expected(capacities: tuple[int, ...], ordered: np.ndarray):
    """Opens the size of the least cost for a token that it is expected to hold. What is left to pack is at most as large as the item, so a bin can
    be filled up to what the rest holds, and with a padding of half the median of the rest at most where small items abound."""
    upto, n = np.concatenate(([0], np.cumsum(ordered))), len(ordered)

    def choose(k: int, size: int) -> int:
        rest, smallest, middle = int(upto[-1] - upto[k]), int(ordered[-1]), int(ordered[(k + n) // 2])

        def price(c: int) -> float:
            fill = min(c, rest)
            if c - size < smallest:
                fill = size
            elif size * 2 > c and c - size < middle:
                fill = max(size, c - middle // 2)
            return cost(c) / fill

        return min((c for c in capacities if c >= size), key=price)

    return choose


def best_fit(sizes: np.ndarray, order: np.ndarray, capacities: tuple[int, ...], choose) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, start in it) of each item and the capacity of each bin, downsized. choose(place in order, size) -> capacity of a new bin."""
    bins, start = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for k, (item, size) in enumerate(zip(order.tolist(), sizes[order].tolist(), strict=True)):
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = choose(k, size), len(used)
            used.append(0)
        bins[item], start[item] = b, used[b]
        used[b] += size
        if free > size:
            bisect.insort(room, (free - size, b))
    return bins, start, np.array(capacities, np.int64)[np.searchsorted(capacities, used)]


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, start in it, capacity) of each item by the cheapest rule; sizes are at most the largest capacity and lie in the order of ties."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    rules = [_expected(capacities, sizes[order])]
    rules += [lambda _, size, least=least: next(c for c in capacities if c >= max(size, least)) for least in capacities]
    tried = [best_fit(sizes, order, capacities, rule) for rule in rules]
    bins, start, capacity = min(tried, key=lambda x: sum(map(cost, x[2].tolist())))
    return bins, start, capacity[bins]


def _items(capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(1))
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(n[row] - number * capacity, capacity)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(number, pa.int32()), pa.array(size, pa.int32())], names=["doc_id", "row", "item", "size"])

    return work


def packed(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, path: str | None = None) -> DataFrame:
    """(doc_id, item, bin_id, capacity, start, size), one row per item. The text isn't shuffled."""
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    counted = written(total_counts(docs, path))
    sums = counted.agg(F.sum("n_tokens").alias("tokens"), F.sum(F.ceil(F.col("n_tokens") / largest)).alias("items")).first()
    shards = max(1, -(-int(sums["tokens"] or 0) // SHARD_TOKENS), -(-int(sums["items"] or 0) // SHARD_ITEMS))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "item", "size", "row"], na_position="first", kind="stable").reset_index(drop=True)
        bins, start, capacity = pack(pdf["size"].to_numpy().astype(np.int64), capacities)
        names = [f"{key[0]}-{b}" for b in range(int(bins.max()) + 1)]
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "item": pdf["item"], "bin_id": np.array(names, object)[bins], "capacity": capacity.astype(np.int32), "start": start.astype(np.int32), "size": pdf["size"]})

    # A row's number stays the same in a task that is run again, as the counts are a written table.
    items = counted.where("n_tokens > 0").select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")).mapInArrow(_items(largest), "doc_id long, row long, item int, size int")
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", "item"), F.lit(shards))).groupBy("shard").applyInPandas(work, _PACKED)
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("bin_id", "string"), ("capacity", "int"), ("start", "int"))]
    empty = counted.where("n_tokens = 0").select("doc_id", F.lit(0).alias("item"), *none, F.lit(0).alias("size"))
    return dealt.unionByName(empty)
