"""Sessions, the shared working folder and written cut points."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Suggested settings of a session that this library creates itself; a cluster's own settings are never overridden.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "quirefold", **extra: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "12g")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, only where that is unset and the session is local, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):  # a folder of the driver is none of the executors
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quirefold-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_CUTS: set[str] = set()


def clean(spark: SparkSession) -> None:
    """Remove all cuts of this process that are still there: for long sessions, once nothing that was made from them is needed."""
    for at in list(_CUTS):
        _delete(spark, at)


@atexit.register
def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if _CUTS and spark is not None:
        try:
            clean(spark)
        except Exception:  # the session may be gone already
            pass


def _delete(spark: SparkSession, at: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _CUTS.discard(at)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends at replicated files that outlive any executor."""
    spark = df.sparkSession
    at = fresh_path(spark, name)
    _CUTS.add(at)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut whose rows nobody needs any more."""
    at = getattr(df, "_written_at", None)
    if at:
        _delete(df.sparkSession, at)


def share_file(spark: SparkSession, path: str) -> str:
    """Move a file of the driver to the shared folder and have every executor fetch it from there; the name it goes by."""
    name = path.rsplit("/", 1)[-1]
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.copyFromLocalFile(True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}"), at)
    spark.sparkContext.addFile(at.toString())
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
