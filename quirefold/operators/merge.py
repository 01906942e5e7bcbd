"""Keyed changes of tables: upserts, deletions, partial merges, manifests and their differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same keys. changes holds a key once (see last_writer)."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def last_writer(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The greatest row of each key by order. Partial aggregation keeps one row a key and task, so hot keys are no load."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def partial_merge(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """base with the non-null fields of patch; null can't clear a field. patch holds a key once."""
    p = patch.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in patch.columns if c not in keys])
    over = {c for c in patch.columns if c not in keys}
    return base.join(p, keys, "left").select(*[F.coalesce(f"_p_{c}", c).alias(c) if c in over else F.col(c) for c in base.columns])


def manifest_diff(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """(keys, change): added, removed or modified, of two manifests with a stamp each."""
    a = old.select(*keys, F.col(stamp).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*keys, F.col(stamp).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change IS NOT NULL")


def contested(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row claims, and how many do."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def directory_hash(manifest: DataFrame, group: str, path: str, stamp: str, buckets: int = 4096) -> DataFrame:
    """(group, hash): the same for the same entries in any order. Entries are hashed in buckets of their own first, so that no
    task ever holds a whole directory."""
    entry = F.concat_ws("\0", F.col(path), F.col(stamp).cast("string"))
    b = F.pmod(F.xxhash64(path), F.lit(buckets))
    per = manifest.groupBy(group, b.alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("h"))
    return per.groupBy(group).agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: F.concat_ws(":", x["b"].cast("string"), x["h"])), "\n"), 256), 1, 16).alias("hash"))


def debounce(events: DataFrame, key: str, ts: str, seq: str, kind: str, gap: str) -> DataFrame:
    """(key, start, end, n, kind): bursts of events of a key with less than gap between them, and the last kind of each."""
    return (
        events.groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count("*").alias("n"), F.max_by(kind, F.struct(ts, seq)).alias(kind))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", kind)
    )


def emit_order(changes: DataFrame) -> DataFrame:
    """Creations and modifications before deletions, then by path."""
    return changes.orderBy(F.when(F.col("kind") == "deleted", 1).otherwise(0), "path")


def list_filter(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows all of whose named columns equal the text given, scalars as text; null, lists and objects never match."""
    ok = [F.col(k).cast("string") == v for k, v in filters.items() if df.schema[k].dataType.typeName() not in ("array", "struct", "map")]
    if len(ok) < len(filters):
        return df.where(F.lit(False))
    return df.where(reduce(Column.__and__, ok, F.lit(True)))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """last_writer by a window, for orders with directions."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")
