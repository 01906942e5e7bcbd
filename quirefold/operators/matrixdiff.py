"""Differences between two copies of data (problem 4).

Method: column-by-bucket checksum matrix. Each side is reduced to additive wide hashes a key bucket and column, with map-side
combining; only buckets and columns whose sums are unequal are read again and joined, and only what differs there is compared
value by value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.canon import canon, parse_object
from quirefold.functions.text import micros_of, place
from quirefold.session import cut, drop_cut

#: Distinct keys a bucket on average: fewer read less around a difference, more make a smaller matrix.
KEYS_A_BUCKET = 4

COLUMNS = ("path", "modified_at", "data_json")


def utc_micros(text: str) -> Column:
    """Microseconds since 1970 of a text timestamp; no zone means UTC; null where it is none."""
    t = F.btrim(F.col(text))
    zoned = F.when(t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & t.rlike(r"\d:\d"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def _hash64(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@F.pandas_udf(T.LongType())
def json_hash(texts: pd.Series) -> pd.Series:
    """A hash of the canonical object, or of the text as it stands; null for null."""

    def one(x: str) -> int:
        o = parse_object(x)
        return _hash64("t" + x if o is None else "o" + canon(o))

    return pd.Series([None if x is None else one(x) for x in texts], dtype="Int64")


def _side(df: DataFrame, micros: Column) -> DataFrame:
    return df.where("collection IS NOT NULL AND id IS NOT NULL").select("collection", "id", F.col("path"), micros.alias("at"), "data_json")


def _hashes(side: DataFrame) -> DataFrame:
    """Key and column hashes of every distinct row: wide enough to tell rows apart, narrow enough to shuffle."""
    ms = F.expr("at div 1000 - CASE WHEN at % 1000 < 0 THEN 1 ELSE 0 END")
    nil = F.lit(-1).cast("long")
    return side.select(
        F.xxhash64("collection", "id").alias("k1"),
        F.xxhash64("id", F.lit("k"), "collection").alias("k2"),
        F.coalesce(F.xxhash64(place("path")), nil).alias("path"),
        # rows equal after cutting to milliseconds are less than 1 ms apart; others are compared exactly
        F.when(F.col("at").isNull(), nil).otherwise(F.xxhash64(ms)).alias("modified_at"),
        F.coalesce(json_hash("data_json"), nil).alias("data_json"),
    ).dropDuplicates()


def _matrix(h: DataFrame, buckets: int) -> DataFrame:
    """(bucket, column sums): halves of two hashes of key and value, so that sums of up to 2^31 rows can't overflow."""
    aggs = [F.count("*").alias("n")]
    for c in COLUMNS:
        for s in (1, 2):
            x = F.xxhash64("k1", "k2", c, F.lit(s))
            aggs += [F.sum(x.bitwiseAND(0xFFFFFFFF)).alias(f"{c}_{s}l"), F.sum(F.shiftrightunsigned(x, 32)).alias(f"{c}_{s}h")]
    return h.groupBy(F.pmod("k1", F.lit(buckets)).alias("bucket")).agg(*aggs)


def unequal_cells(left: DataFrame, right: DataFrame, buckets: int) -> DataFrame:
    """(bucket, path, modified_at, data_json): the buckets that differ, and in which columns."""
    a, b = _matrix(left, buckets), _matrix(right, buckets)
    names = [c for c in a.columns if c != "bucket"]
    j = a.select("bucket", *[F.col(c).alias(f"a_{c}") for c in names]).join(b.select("bucket", *[F.col(c).alias(f"b_{c}") for c in names]), "bucket", "full")
    differs = lambda pre: reduce(Column.__or__, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in names if c.startswith(pre)])
    return j.select("bucket", *[differs(f"{c}_").alias(c) for c in COLUMNS]).where(" OR ".join(COLUMNS))


def diff_copies(documents: DataFrame, replica: DataFrame, keys_a_bucket: int = KEYS_A_BUCKET) -> DataFrame:
    """(collection, id, difference, field): keys of one side only, and fields whose values differ.

    Rows with a null collection or id have no key and are left out. Repeated rows of a side count once; of different rows with
    one key the one with the greatest (modified_at, path, data_json) counts. Null equals null in every column. A text timestamp
    that is none counts as null. Columns of other names are not read. An empty side gives the other's keys.
    """
    left, right = _side(documents, micros_of("modified_at")), _side(replica, utc_micros("modified_at"))
    lh, rh = cut(_hashes(left), "lh"), cut(_hashes(right), "rh")
    n = max(lh.count(), rh.count(), 1)
    buckets = 1 << max(0, (n // keys_a_bucket).bit_length())
    cells = cut(unequal_cells(lh, rh, buckets), "cells")
    # inside unequal buckets, keys whose hashes are the same on both sides are equal: only the others' texts are read
    marked = lh.withColumn("side", F.lit(1)).unionByName(rh.withColumn("side", F.lit(2)))
    hot = (
        marked.withColumn("bucket", F.pmod("k1", F.lit(buckets)))
        .join(cells.select("bucket", *[F.col(c).alias(f"d_{c}") for c in COLUMNS]), "bucket")
        .groupBy("k1", "k2")
        .agg(
            F.max((F.col("side") == 1)).alias("l"),
            F.max((F.col("side") == 2)).alias("r"),
            *[(F.first(f"d_{c}") & (F.min(c) != F.max(c))).alias(f"d_{c}") for c in COLUMNS],
        )
        .where("NOT (l AND r) OR d_path OR d_modified_at OR d_data_json")
    )
    hot = cut(hot, "hot")

    def suspects(side: DataFrame) -> DataFrame:
        keyed = side.withColumn("k1", F.xxhash64("collection", "id")).withColumn("k2", F.xxhash64("id", F.lit("k"), "collection"))
        best = F.max(F.struct("at", "path", "data_json"))
        # texts of columns that are equal are dropped before the shuffle
        h = hot.select("k1", "k2", "l", "r", *[f"d_{c}" for c in COLUMNS])
        both = F.col("l") & F.col("r")
        slim = keyed.join(h, ["k1", "k2"]).select("collection", "id", F.when(both, F.col("at")).alias("at"), F.when(both & F.col("d_path"), F.col("path")).alias("path"), F.when(both & F.col("d_data_json"), F.col("data_json")).alias("data_json"))
        return slim.groupBy("collection", "id").agg(best.alias("v"))

    a, b = suspects(left).withColumnRenamed("v", "a"), suspects(right).withColumnRenamed("v", "b")
    j = a.join(b, ["collection", "id"], "full")
    sql = (
        F.when(F.col("b").isNull(), F.array(F.struct(F.lit("only_documents").alias("difference"), F.lit("").alias("field"))))
        .when(F.col("a").isNull(), F.array(F.struct(F.lit("only_replica").alias("difference"), F.lit("").alias("field"))))
    )
    one = j.where("a IS NULL OR b IS NULL").select("collection", "id", F.inline(sql))
    two = j.where("a IS NOT NULL AND b IS NOT NULL").select(
        "collection", "id", F.col("a.path").alias("ap"), F.col("b.path").alias("bp"), F.col("a.at").alias("at"), F.col("b.at").alias("bt"), F.col("a.data_json").alias("aj"), F.col("b.data_json").alias("bj")
    ).mapInArrow(_fields, "collection string, id string, difference string, field string")
    for x in (lh, rh, cells):  # hot is all that is read from here on
        drop_cut(x)
    return one.unionByName(two)


def json_fields(a: str | None, b: str | None) -> list[str]:
    """The fields in which two JSON texts differ."""
    x, y = parse_object(a), parse_object(b)
    if x is None or y is None:
        return [] if a == b else ["data_json"]
    return [f"data_json.{k}" for k in sorted({*x, *y}) if (canon(x.get(k)) if x.get(k) is not None else None) != (canon(y.get(k)) if y.get(k) is not None else None)]


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from quirefold.functions.text import place_of

    for b in batches:
        out: list[tuple[str, str, str]] = []
        for c, i, ap, bp, at, bt, aj, bj in zip(*[b.column(k).to_pylist() for k in range(8)]):
            if (ap is None) != (bp is None) or (ap is not None and place_of(ap) != place_of(bp)):
                out.append((c, i, "path"))
            if (at is None) != (bt is None) or (at is not None and abs(at - bt) >= 1000):
                out.append((c, i, "modified_at"))
            out += [(c, i, f) for f in json_fields(aj, bj)]
        n = len(out)
        cols = list(zip(*out)) if n else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(np.repeat("differs", n), pa.string()), pa.array(cols[2], pa.string())], names=["collection", "id", "difference", "field"])


def diff_report(found: DataFrame) -> DataFrame:
    return found.groupBy("collection", "difference", "field").agg(F.count("*").alias("n"))
