"""A bounded filter of keys: a bit for each hash, built by distributed aggregation, sent to every executor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bits of a filter: 8 MB, whatever the number of keys. With more keys than fit, more rows pass; none is lost.
MAX_BITS = 1 << 26
_BUCKET = 32768  # bits of one bitmap of Spark's bitmap functions


def key_filter(keys: DataFrame, cols: list[str], bits_a_key: int = 12):
    """A function from columns to a predicate that holds for every key of the table, and for few others."""
    spark = keys.sparkSession
    n = keys.count()
    bits = _BUCKET
    while bits < min(n * bits_a_key, MAX_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64(*cols), F.lit(bits))
    maps = keys.groupBy((at / _BUCKET).cast("int").alias("b")).agg(F.bitmap_construct_agg((at % _BUCKET).cast("int")).alias("m")).collect()
    flat = np.zeros(bits // 8, np.uint8)
    for r in maps:
        flat[r["b"] * _BUCKET // 8 : (r["b"] + 1) * _BUCKET // 8] = np.frombuffer(bytes(r["m"]), np.uint8)
    shared = spark.sparkContext.broadcast(flat)

    @F.pandas_udf(T.BooleanType())
    def has(h: pd.Series) -> pd.Series:
        x = h.to_numpy()
        return pd.Series((shared.value[x >> 3] >> (x & 7)) & 1 == 1)

    def test(*columns: Column) -> Column:
        return has(F.pmod(F.xxhash64(*columns), F.lit(bits)))

    return test
