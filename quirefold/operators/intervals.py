"""Processing only new or changed records (problem 5).

Method: the sequence numbers that earlier runs have processed are kept as disjoint closed intervals; subtracting them from the
available range leaves the gaps, late commits included; the gaps are processed, and the merged intervals are committed together
with the output by one file that no other run can put there too, so a run that dies has processed nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions.text import micros_of, norm_key, place
from quirefold.operators.consolidate import consolidate
from quirefold.session import cut

#: Sequence numbers in one block. Intervals never span blocks, so every block is closed on its own and in parallel.
BLOCK = 65536


def to_intervals(numbers: DataFrame, col: str = "n", block: int = BLOCK, by: Sequence[str] = ()) -> DataFrame:
    """(block, lo, hi, by): the disjoint intervals of the distinct numbers, of each group if by names one. Null numbers are none;
    repeats count once."""
    n = numbers.where(F.col(col).isNotNull()).select(F.col(col).cast("long").alias("n"), *by).distinct().withColumn("block", F.floor(F.col("n") / block).cast("long"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("block", *by).orderBy("n"))
    return n.withColumn("island", island).groupBy("block", "island", *by).agg(F.min("n").alias("lo"), F.max("n").alias("hi")).drop("island")


def gaps(available: DataFrame, done: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, lo, hi): the numbers of available intervals that no done interval covers, block by block."""
    w = Window.partitionBy("block").orderBy("lo")
    span = available.groupBy("block").agg(F.min("lo").alias("a"), F.max("hi").alias("z"))
    marks = done.select("block", "lo", "hi").unionByName(span.select("block", (F.col("z") + 1).alias("lo"), (F.col("z") + 1).alias("hi")))
    return (
        marks.join(span, "block")
        .withColumn("from", F.greatest(F.coalesce(F.lag("hi").over(w) + 1, F.col("a")), F.col("a")))
        .withColumn("to", F.least(F.col("lo") - 1, F.col("z")))
        .where("from <= to")
        .select("block", F.col("from").alias("lo"), F.col("to").alias("hi"))
    )


def merge_intervals(*parts: DataFrame) -> DataFrame:
    """The union of interval tables, touching and overlapping ones joined."""
    df = parts[0].select("block", "lo", "hi")
    for p in parts[1:]:
        df = df.unionByName(p.select("block", "lo", "hi"))
    w = Window.partitionBy("block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)
    return (
        df.withColumn("new", new)
        .withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("block", "g")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("g")
    )


def rows_in(df: DataFrame, col: str, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of df whose number lies in one of the disjoint intervals. Rows and interval starts are sorted together within a
    block, and the furthest end so far tells whether a row is covered: no pairs, and no task larger than its blocks."""
    rows = df.withColumns({"_b": F.floor(F.col(col) / block).cast("long"), "_hi": F.lit(None).cast("long"), "_row": F.lit(True)})
    starts = intervals.select(F.col("block").alias("_b"), F.col("lo").cast(df.schema[col].dataType).alias(col), F.col("hi").alias("_hi"), F.lit(False).alias("_row"))
    w = Window.partitionBy("_b").orderBy(col, "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionByName(starts, allowMissingColumns=True).withColumn("_hi", F.max("_hi").over(w)).where(F.col("_row") & (F.col("_hi") >= F.col(col))).drop("_b", "_hi", "_row")


def succeeded(runs: DataFrame) -> DataFrame:
    return runs.where((norm_key(F.col("status")) == "ok") & F.col("finished_at").isNotNull()).select("run_id").distinct()


def committed(keep: DataFrame, index: DataFrame) -> DataFrame:
    """(block, lo, hi, run_id): the sequence numbers that each run has committed: those of the listed files that its index rows
    hold as they are. keep is (entry_id, collection, place, micros), index (collection, place, at, run_id)."""
    hit = keep.join(index.where("at IS NOT NULL").select("collection", "place", F.col("at").alias("micros"), "run_id"), ["collection", "place", "micros"]).select("run_id", F.col("entry_id").alias("n"))
    return to_intervals(hit, "n", by=["run_id"])


def pending_files(entries: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """(entry_id, change): the files still to be indexed, each by its newest listing row.

    The entry_id of that row is the file's sequence number. Every successful run has committed the numbers of the files that it
    indexed at the same time (mtime cut to microseconds), as intervals; their union is subtracted from the available range, and
    only the rows in the gaps are looked up: `added` (no row of a successful run) or `changed`. A null mtime differs from any
    time and from a null one. Rows of documents with a null path or collection are no file; listing rows without one are `added`
    only if they name a file, so never. Several index rows of one file: the newest counts. Empty tables give no rows, or every
    file as `added`.
    """
    micros = F.expr("mtime_nanos div 1000 - CASE WHEN mtime_nanos % 1000 < 0 THEN 1 ELSE 0 END")  # cut, not rounded, before 1970 too
    keep = consolidate(entries).where("NOT superseded AND place IS NOT NULL").select("entry_id", "collection", "place", micros.alias("micros"))
    index = cut(
        documents.where("path IS NOT NULL AND collection IS NOT NULL")
        .select("collection", place("path").alias("place"), micros_of("modified_at").alias("at"), F.col("indexed_run").alias("run_id"))
        .join(succeeded(runs), "run_id", "left_semi")
        .groupBy("collection", "place")
        .agg(F.max(F.struct(F.col("at").isNotNull().alias("is"), "at", "run_id")).alias("x"))
        .select("collection", "place", "x.at", "x.run_id"),
        "index",
    )
    done = cut(committed(keep, index), "committed")
    free = gaps(to_intervals(keep, "entry_id"), merge_intervals(done))
    todo = rows_in(keep, "entry_id", free)
    known = index.select("collection", "place", F.lit(True).alias("has"))
    return todo.join(known, ["collection", "place"], "left").select("entry_id", F.when(F.col("has"), "changed").otherwise("added").alias("change"))


class CommitConflict(RuntimeError):
    """Another run has committed the version that this one began with; nothing of this one counts."""


class IntervalLog:
    """The intervals that were committed, in a folder. Commit N is one small file, commit-N, that names the folder of its output and
    of all intervals up to it. A run writes a folder of its own and then moves the file into place, which fails if there is one:
    so of two runs that began alike one fails, and a run that dies leaves nothing that counts and is repeated whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs = spark._jvm.org.apache.hadoop.fs
        self._path = fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = fs.FileContext.getFileContext(self._path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max([int(x[7:]) for x in names if x.startswith("commit-")], default=0)

    def folder(self, version: int) -> str:
        """Where a commit's input, output and intervals are."""
        f = self._fs.open(self._path(f"{self.root}/commit-{version}"))
        try:
            return f"{self.root}/{f.readLine()}"
        finally:
            f.close()

    def done(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        schema = "block long, lo long, hi long"
        return self.spark.read.schema(schema).parquet(f"{self.folder(v)}/intervals") if v else self.spark.createDataFrame([], schema)

    def outputs(self, schema) -> DataFrame | None:
        """The output of all commits."""
        at = [f"{self.folder(v)}/output" for v in range(1, self.version() + 1)]
        return self.spark.read.schema(schema).parquet(*at) if at else None

    def pending(self, df: DataFrame, col: str, version: int | None = None) -> DataFrame:
        return rows_in(df, col, gaps(to_intervals(df.select(F.col(col).alias("n"))), self.done(version)))

    def run(self, df: DataFrame, col: str, process) -> int:
        """Process what is pending and commit it; the rows processed. process maps a DataFrame to the output to keep. Raises
        CommitConflict, with nothing done, if another run has committed in the meantime."""
        v = self.version()
        name = f"run-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        try:
            todo = self.pending(df, col, v)
            todo.write.parquet(f"{at}/input")  # what is processed is what is committed, whatever arrives meanwhile
            todo = self.spark.read.schema(todo.schema).parquet(f"{at}/input")
            process(todo).write.parquet(f"{at}/output")
            merge_intervals(self.done(v), to_intervals(todo.select(F.col(col).alias("n")))).write.parquet(f"{at}/intervals")
            n = todo.count()
            self._commit(v + 1, name)
        except BaseException:
            self._fs.delete(self._path(at), True)
            raise
        return n

    def _commit(self, version: int, name: str) -> None:
        tmp = self._path(f"{self.root}/{name}/commit")
        out = self._fs.create(tmp, True)
        out.writeBytes(name + "\n")
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(tmp, self._path(f"{self.root}/commit-{version}"), options)  # never over a file that is there
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} of {self.root}") from None
            raise
