"""The change feed of a directory of documents, as a Structured Streaming source, and its operators."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quirefold.sources.frontmatter import list_files

EXTENSIONS = ("md", "json", "jsonl")
SCHEMA = "path string, kind string, mtime_nanos long, seq long"


class DirectoryFeed(DataSource):
    """spark.readStream.format("quirefold_feed").option("root", dir): created, modified and deleted files, by comparing listings.

    The offset names a listing that is kept beside the checkpoint (option "state", by default <root>/_feed), so offsets stay small
    however many files there are. A directory's listing is read by the driver, as a file system gives it; rows are its changes.
    """

    @classmethod
    def name(cls) -> str:
        return "quirefold_feed"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


def _keep(state: str, n: int, listing: dict) -> None:
    os.makedirs(state, exist_ok=True)
    tmp = os.path.join(state, f".{n}.json")
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(listing, f)
    os.replace(tmp, os.path.join(state, f"{n}.json"))


def begin_with(state: str, listing: dict[str, int]) -> bool:
    """Let a feed that has no listing yet begin with this one (path, mtime), in place of its own first one."""
    if os.path.isdir(state) and any(f.endswith(".json") for f in os.listdir(state)):
        return False
    _keep(state, 0, listing)
    return True


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root = options["root"]
        self.state = options.get("state", os.path.join(self.root, "_feed"))

    def _load(self, n: int) -> dict:
        try:
            with open(os.path.join(self.state, f"{n}.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _scan(self) -> dict:
        return {p: m for ext in EXTENSIONS for p, m, _, _ in list_files(self.root, "", ext)}

    def initialOffset(self) -> dict:  # noqa: N802
        """What is there when the feed begins is no change; what that is, begin_with may have said."""
        if not os.path.exists(os.path.join(self.state, "0.json")):
            self._keep(0, self._scan())
        return {"n": 0}

    def _keep(self, n: int, listing: dict) -> None:
        _keep(self.state, n, listing)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n, old = start["n"], self._load(start["n"])
        new = self._scan()
        if new == old:
            return iter([]), start
        self._keep(n + 1, new)
        return iter(self._changes(old, new, n + 1)), {"n": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._changes(self._load(start["n"]), self._load(end["n"]), end["n"]))

    def commit(self, end: dict) -> None:
        for f in os.listdir(self.state) if os.path.isdir(self.state) else ():
            if f.endswith(".json") and f[:-5].isdigit() and int(f[:-5]) < end["n"] - 1:
                os.unlink(os.path.join(self.state, f))

    @staticmethod
    def _changes(old: dict, new: dict, seq: int) -> list[tuple]:
        out = [(p, "created" if p not in old else "modified", m, seq) for p, m in sorted(new.items()) if old.get(p) != m]
        return out + [(p, "deleted", old[p], seq) for p in sorted(old.keys() - new.keys())]


def watch(spark: SparkSession, root: str, state: str | None = None) -> DataFrame:
    """The stream of changes below root."""
    spark.dataSource.register(DirectoryFeed)
    r = spark.readStream.format("quirefold_feed").option("root", root)
    return (r.option("state", state) if state else r).load()


def last_kinds(changes: DataFrame) -> DataFrame:
    """The last kind of each path in a micro-batch, creations and modifications before deletions, then by path."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("kind", "mtime_nanos"), "seq").alias("x")).select("path", "x.*")
    return last.orderBy(F.when(F.col("kind") == "deleted", 1).otherwise(0), "path")


class Echoes:
    """One's own writes, once each and for a while, so that the feed does not bring them back."""

    def __init__(self, ttl: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self._seen = ttl, clock, {}

    def expect(self, path: str, digest: str | None) -> None:
        """digest of what was written; None for a deletion."""
        self._seen[path] = (digest, self.clock())

    def is_echo(self, path: str, digest: str | None) -> bool:
        x = self._seen.get(path)
        if x is None:
            return False
        del self._seen[path]
        return x[0] == digest and self.clock() - x[1] <= self.ttl


def windowed_counts(events: DataFrame, ts: str, width: str, keys: list[str], late: str) -> DataFrame:
    """(start, end, keys, n) of a stream or table: counts by tumbling window, late rows let in up to the watermark."""
    src = events.withWatermark(ts, late) if events.isStreaming else events
    return src.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
