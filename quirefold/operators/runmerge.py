"""Sorted runs and their merge by key range: order-preserving keys, and a merge of many runs by a heap over their blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.session import cut

#: Rows of one key range: what one merge holds, whatever the table's size.
RANGE_ROWS = 1_000_000
#: Rows of a block that the merge gives out.
BLOCK_ROWS = 8192


def text_key(c: Column) -> Column:
    """A text whose concatenation with what follows sorts as the text itself; null sorts first."""
    return F.coalesce(F.concat(F.lit("1"), F.replace(c, F.lit("\0"), F.lit("\0\1")), F.lit("\0\0")), F.lit("0"))


def number_key(c: Column, down: bool = False) -> Column:
    """A whole number as 17 characters that sort as it; null first, or last if down."""
    v = F.bitwise_not(c.cast("long")) if down else c.cast("long")
    n = F.lpad(F.hex(v.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(F.concat(F.lit("0" if down else "1"), n), F.lit("1" if down else "0"))


def key_of(df: DataFrame, names: list[str]) -> Column:
    """One sortable text for several columns: whole numbers, dates and times by value, others by their text."""
    parts = []
    for n in names:
        kind = df.schema[n].dataType
        if isinstance(kind, T.IntegralType):
            parts.append(number_key(F.col(n)))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            parts.append(number_key(F.unix_micros(F.col(n).cast("timestamp"))))
        elif isinstance(kind, T.DateType):
            parts.append(number_key(F.unix_date(n)))
        else:
            parts.append(text_key(F.col(n).cast("string")))
    return F.concat(*parts)


def sorted_runs(df: DataFrame, key: str = "k") -> DataFrame:
    """Each input task's rows by key, as one written run a task; `run` tells which."""
    return cut(df.sortWithinPartitions(key).withColumn("run", F.spark_partition_id()), "runs")


def _runs(batches: Iterator[pa.RecordBatch], key: int, run: int) -> list[list[pa.RecordBatch]]:
    """The ascending runs of a stream of rows, as lists of slices: a run ends where another task's rows or a smaller key follow.
    A shuffle hands on each task's rows in the order they were written in, so there is about one a task."""
    out: list[list[pa.RecordBatch]] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k, r = b.column(key), b.column(run)
        n = b.num_rows - 1
        falls = pc.or_(pc.less(k.slice(1), k.slice(0, n)), pc.not_equal(r.slice(1), r.slice(0, n))) if n else pa.array([], pa.bool_())
        at = [0, *(np.flatnonzero(falls.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for x, y in zip(at, at[1:]):
            first = (r[x].as_py(), k[x].as_py())
            if x or last is None or last[0] != first[0] or last[1] > first[1]:
                out.append([])
            out[-1].append(b.slice(x, y - x))
        last = (r[n].as_py(), k[n].as_py())
    return out


def merged(batches: Iterator[pa.RecordBatch], key: int, run: int) -> Iterator[pa.RecordBatch]:
    """All rows by key: a heap holds the last key of every run's foremost block; up to the smallest of them nothing smaller can
    follow, so what all runs hold up to there is given out, merged from its sorted slices."""
    readers = [iter(x) for x in _runs(batches, key, run)]
    front: dict[int, pa.RecordBatch] = {i: next(x) for i, x in enumerate(readers)}
    keys = {i: b.column(key).to_numpy(zero_copy_only=False) for i, b in front.items()}
    heap = [(k[-1], i) for i, k in keys.items()]
    heapq.heapify(heap)
    while heap:
        bound, spent = heap[0][0], []
        while heap and heap[0][0] == bound:  # their blocks end with the bound
            spent.append(heapq.heappop(heap)[1])
        parts, sorts = [], []
        for i, k in keys.items():
            n = int(np.searchsorted(k, bound, "right"))
            if n:
                parts.append(front[i].slice(0, n))
                sorts.append(k[:n])
                front[i], keys[i] = front[i].slice(n), k[n:]
        for i in spent:
            b = next(readers[i], None)
            if b is None:
                del front[i], keys[i]
            else:
                front[i], keys[i] = b, b.column(key).to_numpy(zero_copy_only=False)
                heapq.heappush(heap, (keys[i][-1], i))
        t = pa.Table.from_batches(parts)
        if len(parts) > 1:
            t = t.take(pa.array(np.argsort(np.concatenate(sorts), kind="stable")))  # merges presorted slices
        yield from t.combine_chunks().to_batches(BLOCK_ROWS)


def by_range(runs: DataFrame, key: str = "k", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of written runs by key range, each task's block still in its order."""
    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    return runs.repartitionByRange(n, key)
