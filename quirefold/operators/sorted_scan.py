"""Scans of sorted groups that may be larger than a task: numbering and as-of lookups without one task per key.

Rows are range partitioned by key and order, so a key with a third of all rows spreads over many tasks. Every task scans its own
range; what a range hands to the next one (the last key, and how far it got) is one row a range, so the carries are settled on
the driver, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.session import cut


def _same(cols: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(cols[0]), bool)
    out[0] = False
    for c in cols:
        out[1:] &= c[1:] == c[:-1]
    return out


def _sorted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))


def number(df: DataFrame, keys: list[str], order: list, out: str = "n") -> DataFrame:
    """df with out: 1, 2, 3 and so on within each key, by order. Null keys are equal; ties come in any order."""
    schema = T.StructType([*df.schema.fields, T.StructField("_k", T.StringType()), T.StructField("_n", T.LongType()), T.StructField("_range", T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, last, reached = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            same = _same([k])
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(k))))
            n = np.arange(len(k)) - start + 1
            if k[0] == last:
                n[: int(np.argmin(same[1:])) + 1 if not same[1:].all() else len(k)] += reached
            last, reached = k[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(np.full(len(k), rid, np.int32))], names=[*b.schema.names, "_n", "_range"])

    got = cut(_keyed(_sorted(df, keys, order), keys).mapInArrow(scan, schema), "numbered")
    # within a range keys are sorted: its first and last keys are the least and the greatest
    w = F.struct(*keys)
    ends = got.groupBy("_range").agg(F.min_by("_k", w).alias("a"), F.max_by("_k", w).alias("z"), F.max(F.struct(w.alias("w"), "_n")).getField("_n").alias("n")).orderBy("_range").collect()
    add, carry, key = [], 0, None
    for r in ends:
        if key is not None and r["a"] == key:
            add.append((r["_range"], r["a"], carry))
            carry = r["n"] + (carry if r["z"] == r["a"] else 0)
        else:
            carry = r["n"]
        key = r["z"]
    extra = F.lit(0).cast("long")
    for rid, k, c in add:
        extra = F.when((F.col("_range") == rid) & (F.col("_k") == k), c).otherwise(extra)
    return got.withColumn(out, F.col("_n") + extra).drop("_k", "_n", "_range")


def as_of(df: DataFrame, keys: list[str], ts: str, value: str, out: str = "last") -> DataFrame:
    """df with out: the greatest value of the key's rows at or before each row's time. value is a column that is null in rows that
    are only asked for; rows of equal time see each other."""
    t_type = df.schema[value].dataType
    schema = T.StructType([*df.schema.fields, T.StructField("_k", T.StringType()), T.StructField("_v", t_type), T.StructField("_range", T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd
        from pyspark import TaskContext

        rid, last, seen = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            p = b.to_pandas()
            k, v = p.iloc[:, -1], p[value]
            if seen is not None and k.iloc[0] == last:
                v = v.copy()
                if pd.isna(v.iloc[0]) or v.iloc[0] < seen:
                    v.iloc[0] = seen
            run = v.groupby(k, sort=False).cummax()
            run = run.groupby(k, sort=False).ffill()
            last, seen = k.iloc[-1], None if pd.isna(run.iloc[-1]) else run.iloc[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.Array.from_pandas(run, type=b.schema.field(value).type), pa.array(np.full(len(p), rid, np.int32))], names=[*b.schema.names, "_v", "_range"])

    # of rows of one time, those with a value come first, so that the others see them
    got = cut(_keyed(_sorted(df, keys, [F.col(ts), F.col(value).isNull()]), keys).mapInArrow(scan, schema), "asof")
    w = F.struct(*keys)
    ends = got.groupBy("_range").agg(F.min_by("_k", w).alias("a"), F.max_by("_k", w).alias("z"), F.max(F.struct(w.alias("w"), F.col("_v").alias("v"))).alias("m")).orderBy("_range").collect()
    carry, key, extra = None, None, F.lit(None).cast(t_type)
    for r in ends:
        mine = r["m"]["v"]
        if key is not None and r["a"] == key and carry is not None:
            extra = F.when((F.col("_range") == r["_range"]) & (F.col("_k") == r["a"]), F.lit(carry).cast(t_type)).otherwise(extra)
            if r["z"] == r["a"] and (mine is None or carry > mine):
                mine = carry
        elif key is not None and r["z"] == r["a"] == key and mine is None:
            mine = carry
        carry, key = mine, r["z"]
    return got.withColumn(out, F.greatest("_v", extra)).drop("_k", "_v", "_range")
