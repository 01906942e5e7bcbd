"""Queries of the general problems over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import place
from quirefold.operators import consolidate, forest, intervals, matrixdiff, orphans, schemadrift
from quirefold.session import fresh_path
from quirefold.session import table as t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(t(spark, d, "users"), t(spark, d, "posts"), t(spark, d, "comments"), t(spark, d, "deleted_records"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_found(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.consolidate(t(spark, d, "collection_entries")).where("superseded").select("entry_id")


def p2_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The outputs that all files on disk go to, 1 MiB each here so that there are several at any scale."""
    return consolidate.range_metadata(consolidate.consolidate(t(spark, d, "collection_entries"), target_bytes=1 << 20))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """The range metadata of the files written: each file on disk once, as of its newest listing row, with what the index holds of
    it (nothing, if it isn't indexed), 1 MiB each."""
    kept = consolidate.consolidate(t(spark, d, "collection_entries")).where("NOT superseded AND place IS NOT NULL").select("collection", "place", "entry_id", "mtime_nanos")
    held = t(spark, d, "documents").where("path IS NOT NULL").select("collection", place("path").alias("place"), "id", "data_json", "content_text")
    return consolidate.rewrite_files(kept.join(held, ["collection", "place"], "left"), ["collection", "place"], fresh_path(spark, "small-files"), 1 << 20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return matrixdiff.diff_copies(t(spark, d, "documents"), t(spark, d, "documents_replica"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return matrixdiff.diff_report(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.pending_files(t(spark, d, "collection_entries"), t(spark, d, "documents"), t(spark, d, "scan_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.find_drift(t(spark, d, "documents"), t(spark, d, "schema_history"))


def p6_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.appearing_alternatives(t(spark, d, "documents"), t(spark, d, "schema_history"))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.consistent_table(t(spark, d, "documents"), t(spark, d, "schema_history"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return schemadrift.value_table(t(spark, d, "documents"), t(spark, d, "schema_history"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.find_threads(t(spark, d, "comments"))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    return forest.resolve(forest.links_of(t(spark, d, "comments")), paths=True).select(F.col("node").alias("comment_id"), "root_id", "depth", "state", F.concat_ws("/", "path").alias("full_path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return forest.descendants(forest.resolve(forest.links_of(t(spark, d, "comments")), paths=True))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_outputs, p2_files, p4_found, p4_report, p5_found, p6_found, p6_alternatives, p6_table, p6_values, p7_found, p7_paths, p7_descendants)}


# -- the same in SQL ------------------------------------------------------------------------------------------------------------

_KEY = "nullif(lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _place(path: str) -> str:
    """The place of a path: slashes, composed letters, no empty and `.` segments, `..` undone up to four times."""
    p = f"nfc_normalize(replace({path}, '\\', '/'))"
    p = f"regexp_replace(regexp_replace({p}, '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
    for _ in range(4):
        p = f"regexp_replace({p}, '(^|/)[^/]+/\\.\\./', '\\1')"
    return p


def _counted(table: str, more: str) -> str:
    return f"SELECT *, min(ingested_at) OVER (PARTITION BY k) AS first_at FROM (SELECT {_KEY.format('id')} AS k, *{more} FROM {table}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY modified_at DESC, ingested_at DESC) = 1"


_ORPHANS = f"""
WITH u AS ({_counted("users", "")}), p AS ({_counted("posts", "")}), c AS ({_counted("comments", "")}),
rows AS (SELECT 'users' AS t, k, created_at, first_at FROM u UNION ALL SELECT 'posts', k, created_at, first_at FROM p UNION ALL SELECT 'comments', k, created_at, first_at FROM c),
gone AS (SELECT {_KEY.format("collection")} AS t, {_KEY.format("id")} AS k, max(deleted_at) AS at FROM deleted_records GROUP BY 1, 2),
refs AS (
  SELECT 'posts' AS table_name, k AS record_id, 'author_id' AS field, created_at, ingested_at, unnest(['users']) AS t, {_KEY.format("author_id")} AS ref FROM p
  UNION ALL SELECT 'comments', k, 'user', created_at, ingested_at, unnest(['users']), {_KEY.format('"user"')} FROM c
  UNION ALL SELECT 'comments', k, 'parent', created_at, ingested_at, unnest(CASE WHEN {_KEY.format("parent.type")} IN ('posts', 'comments') THEN [{_KEY.format("parent.type")}] ELSE ['posts', 'comments'] END), {_KEY.format("parent.id")} FROM c),
judged AS (
  SELECT r.*, CASE WHEN x.k IS NULL AND g.at IS NULL THEN 3 WHEN g.at IS NOT NULL AND (x.k IS NULL OR g.at > x.created_at) THEN 2 WHEN x.first_at > r.ingested_at THEN 1 ELSE 0 END AS code
  FROM refs r LEFT JOIN rows x ON x.t = r.t AND x.k = r.ref LEFT JOIN gone g ON g.t = r.t AND g.k = r.ref WHERE r.ref IS NOT NULL),
found AS (SELECT table_name, record_id, field, coalesce(strftime(any_value(created_at), '%Y-%m'), 'unknown') AS period, ['late', 'deleted', 'missing'][min(code)] AS status FROM judged GROUP BY table_name, record_id, field HAVING min(code) > 0)
"""
_FILES = f"""
WITH e AS (SELECT entry_id, collection, mtime_nanos, {_place("path")} AS place FROM collection_entries),
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection, place ORDER BY mtime_nanos DESC, entry_id) AS n FROM e)
"""
_THREADS = f"""
WITH RECURSIVE c AS (SELECT k, {_KEY.format("parent.id")} AS p FROM ({_counted("comments", "")})),
walk(k, here, n, path) AS (
  SELECT k, k, 0, [k] FROM c
  UNION ALL SELECT w.k, c.p, w.n + 1, list_append(w.path, c.p) FROM walk w JOIN c ON c.k = w.here WHERE c.p IS NOT NULL AND NOT list_contains(w.path[:-2], w.here)),
ends AS (SELECT k, arg_max(here, n) AS here, max(n) AS n, arg_max(path, n) AS path FROM walk GROUP BY k)
"""
_THREAD_ROWS = """
SELECT k AS comment_id, CASE WHEN list_contains(path[:-2], here) THEN list_min(path[list_position(path, here):]) ELSE here END AS root_id,
  CAST(CASE WHEN list_contains(path[:-2], here) THEN list_position(path, here) - 1 ELSE n END AS INTEGER) AS depth,
  CASE WHEN NOT list_contains(path[:-2], here) THEN 'tree' WHEN list_position(path, here) = 1 THEN 'cycle' ELSE 'below_cycle' END AS state
FROM ends
"""
#: Each comment's path from itself up to its root, or to where it meets a loop.
_UP = _THREADS + """
, up AS (SELECT k, CASE WHEN NOT list_contains(path[:-2], here) THEN path ELSE path[:list_position(path, here)] END AS up FROM ends)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _ORPHANS + "SELECT * FROM found",
        "p1_report": _ORPHANS + "SELECT table_name, field, period, status, count(*) AS n FROM found GROUP BY ALL",
        "p2_found": _FILES + "SELECT entry_id FROM ranked WHERE n > 1",
        "p5_found": _FILES
        + f"""SELECT r.entry_id, CASE WHEN d.at IS NULL THEN 'added' ELSE 'changed' END AS change FROM ranked r
        LEFT JOIN (SELECT collection, {_place("path")} AS place, max(epoch_us(modified_at)) AS at FROM documents WHERE indexed_run IN (SELECT run_id FROM scan_runs WHERE lower(trim(status)) = 'ok' AND finished_at IS NOT NULL) GROUP BY 1, 2) d
        ON d.collection = r.collection AND d.place = r.place WHERE r.n = 1 AND (d.at IS NULL OR d.at <> r.mtime_nanos // 1000)""",
        "p7_found": _THREADS + _THREAD_ROWS,
        "p7_paths": f"SELECT t.*, p.full_path FROM ({_THREADS}{_THREAD_ROWS}) t JOIN ({_UP} SELECT k, array_to_string(list_reverse(up), '/') AS full_path FROM up) p ON p.k = t.comment_id",
        "p7_descendants": _UP + "SELECT up[i] AS ancestor, k AS descendant, CAST(i - 1 AS INTEGER) AS distance FROM (SELECT k, up, unnest(range(2, len(up) + 1)) AS i FROM up)",
    }
