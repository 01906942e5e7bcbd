"""Far too many small files (problem 2).

Method: sorted-run consolidation. Every input task sorts its rows by key and writes one run; the runs are cut into key ranges and
each range is merged from the sorted pieces of all runs (runmerge.py), repeats preserved and marked; outputs are rolled by bytes,
and the range metadata (first and last key, rows, bytes of every output) is derived from what was written. Because a range may
end inside a key that holds many rows, whether the first row of a range continues the key of the range before it is read from
the ranges' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.text import place
from quirefold.operators import runmerge as R
from quirefold.session import cut, drop_cut

#: Bytes of one output by default.
TARGET_BYTES = 128 << 20

MERGED = "entry_id long, collection string, place string, mtime_nanos long, size_bytes long, superseded boolean, head boolean, range_id int, before double"


def listing_runs(entries: DataFrame) -> DataFrame:
    """Each input task's rows by file, newest first, as one written run a task."""
    keyed = entries.select("entry_id", "collection", place("path").alias("place"), "mtime_nanos", "size_bytes")
    # the entry's own id is part of the key, so a path that holds a third of all rows spreads over ranges
    return R.sorted_runs(keyed.withColumn("k", F.concat(R.text_key(F.col("collection")), R.text_key(F.col("place")), R.number_key(F.col("mtime_nanos"), down=True), R.number_key(F.col("entry_id")))))


def merge_runs(runs: DataFrame) -> DataFrame:
    """All rows of the runs by key range: which row of a key is the newest, and how many bytes the range keeps before it. A null
    size counts as nothing, a null mtime as older than any."""
    names = runs.columns
    key, run = names.index("k"), names.index("run")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId()
        last, filled = None, 0.0
        for b in R.merged(batches, key, run):
            col, at = b.column("collection").to_numpy(zero_copy_only=False), b.column("place").to_numpy(zero_copy_only=False)
            same = np.zeros(b.num_rows, bool)
            same[1:] = (col[1:] == col[:-1]) & (at[1:] == at[:-1])
            head = np.zeros(b.num_rows, bool)
            if last is None:
                head[0] = True
            else:
                same[0] = last == (col[0], at[0])
            last = (col[-1], at[-1])
            size = np.where(same, 0, np.nan_to_num(b.column("size_bytes").to_numpy(zero_copy_only=False).astype(float)))
            total = filled + np.cumsum(size)
            filled = float(total[-1])
            keep = [b.column(c) for c in ("entry_id", "collection", "place", "mtime_nanos", "size_bytes")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(same), pa.array(head), pa.array(np.full(b.num_rows, rid, np.int32)), pa.array(total - size)], schema=_ARROW)

    return cut(R.by_range(runs).mapInArrow(merge, MERGED), "merged")


_ARROW = pa.schema([("entry_id", pa.int64()), ("collection", pa.string()), ("place", pa.string()), ("mtime_nanos", pa.int64()), ("size_bytes", pa.int64()), ("superseded", pa.bool_()), ("head", pa.bool_()), ("range_id", pa.int32()), ("before", pa.float64())])


def consolidate(entries: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Every row of the listing with its place, the output that holds it and whether a newer row names the same file. Outputs are
    rolled where the bytes of the kept rows reach target_bytes.

    A row with a null path or collection names no file: it is kept, and never superseded. Equal mtimes: the smaller entry_id
    is the newest. Repeated rows with one entry_id are alike; columns of other names are not read; an empty listing gives no rows.
    """
    named = entries.where("path IS NOT NULL AND collection IS NOT NULL")
    runs = listing_runs(named)
    merged = merge_runs(runs)
    drop_cut(runs)
    # one row a range: bounded by the number of ranges
    ends = merged.groupBy("range_id").agg(
        F.min(F.struct("collection", "place")).alias("lo"), F.max(F.struct("collection", "place")).alias("hi"), F.max(F.when(F.col("head"), F.col("size_bytes"))).alias("size")
    ).orderBy("range_id").collect()
    continued = {b["range_id"]: b["size"] or 0 for a, b in zip(ends, ends[1:]) if a["hi"] == b["lo"]}
    before = F.col("before")
    if continued:  # the head of such a range is no file of its own, and its bytes fill no output
        extra = F.create_map(*[F.lit(x) for pair in continued.items() for x in (pair[0], float(pair[1]))])
        before = before - F.when(F.col("head"), 0.0).otherwise(F.coalesce(F.try_element_at(extra, F.col("range_id")), F.lit(0.0)))
        merged = merged.withColumn("superseded", F.col("superseded") | (F.col("head") & F.col("range_id").isin(list(continued))))
    number = F.floor(before / target_bytes).cast("string")
    merged = merged.withColumn("out_file", F.concat_ws("-", F.lpad(F.col("range_id").cast("string"), 6, "0"), F.lpad(number, 6, "0")))
    unnamed = entries.where("path IS NULL OR collection IS NULL").select("entry_id", "collection", F.lit(None).cast("string").alias("place"), "mtime_nanos", "size_bytes", F.lit(False).alias("superseded"), F.lit(None).cast("string").alias("out_file"))
    return merged.drop("head", "range_id", "before").unionByName(unnamed)


def range_metadata(consolidated: DataFrame) -> DataFrame:
    """(out_file, first_place, last_place, n_files, n_bytes) of every output."""
    kept = consolidated.where("NOT superseded AND out_file IS NOT NULL")
    key = F.concat_ws("/", "collection", "place")
    return kept.groupBy("out_file").agg(F.min(key).alias("first_place"), F.max(key).alias("last_place"), F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))


def rewrite_files(df: DataFrame, keys: list[str], out_dir: str, target_bytes: int = TARGET_BYTES, range_rows: int = R.RANGE_ROWS) -> DataFrame:
    """The records of many small files in few files sorted by key: runs merged by key range, repeats preserved, outputs rolled by
    bytes. Writes out_dir/files/out_file=... and returns, as written to out_dir/ranges, the range metadata: (out_file, first_key,
    last_key, n_rows, n_bytes) of every output. Bytes are those of the values as text; a row larger than target_bytes has an
    output of its own; records with one key may be in several outputs. An empty table gives none.
    """
    spark = df.sparkSession
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + F.coalesce(F.octet_length(F.col(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(f.name))), F.lit(0))
    # a number within the run ends the key, so one key that holds a third of all rows spreads over ranges
    keyed = df.select(F.struct(*df.columns).alias("row"), F.concat(R.key_of(df, keys), R.number_key(F.monotonically_increasing_id())).alias("k"), F.to_json(F.struct(*keys)).alias("key"), size.cast("long").alias("bytes"))
    runs = R.sorted_runs(keyed)
    names = runs.columns
    key, run = names.index("k"), names.index("run")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, number, filled = TaskContext.get().partitionId(), 0, 0
        for b in R.merged(batches, key, run):
            out = []
            for n in b.column("bytes").to_pylist():
                if filled and filled + n > target_bytes:
                    number, filled = number + 1, 0
                filled += n
                out.append(f"{rid:06d}-{number:06d}")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], pa.array(out, pa.string())], names=[*names[:-1], "out_file"])

    schema = T.StructType([*runs.schema.fields[:-1], T.StructField("out_file", T.StringType())])
    rolled = R.by_range(runs, range_rows=range_rows).mapInArrow(roll, schema)
    rolled.sortWithinPartitions("out_file", "k").write.partitionBy("out_file").parquet(f"{out_dir}/files")
    files = spark.read.schema(schema).parquet(f"{out_dir}/files")
    # columnar: only the keys and sizes are read again
    files.groupBy("out_file").agg(F.min_by("key", "k").alias("first_key"), F.max_by("key", "k").alias("last_key"), F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes")).write.parquet(f"{out_dir}/ranges")
    drop_cut(runs)
    return spark.read.parquet(f"{out_dir}/ranges")


def records_of(spark, out_dir: str, schema: T.StructType) -> DataFrame:
    """The records that rewrite_files wrote."""
    return spark.read.schema(T.StructType([T.StructField("row", schema)])).parquet(f"{out_dir}/files").select("row.*")
