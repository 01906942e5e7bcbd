"""References to records that do not exist (problem 1).

Method: tagged parent keys, deletions and child keys are united in long form and grouped by key space and key with map-side
combining, so that a key that holds a third of all rows arrives as one partial row a task; groups that have no sound parent
are kept, and only the children that name one of these (told by a bounded bit filter) come back, over a join that splits hot keys by their counts. Counts a table and period are sums
over that result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import norm_key
from quirefold.operators.keyfilter import key_filter
from quirefold.session import cut

#: Children of one unsound key that one task meets; a key named by more is met by as many tasks as it takes.
TASK_ROWS = 1_000_000
#: Most keys that are split so, or the number of shuffle partitions if that is more: none of the others is large against a task.
HOT_KEYS = 1000


def counted_rows(df: DataFrame, **refs: Column) -> DataFrame:
    """One row an id: the version with the greatest modified_at (of equal ones the one that arrived last), and the first
    arrival of any version. Blank ids name no record and are left out."""
    keep = F.struct("modified_at", "ingested_at", "created_at", *[c.alias(k) for k, c in refs.items()])
    return (
        df.select(norm_key(F.col("id")).alias("key"), keep.alias("v"), "ingested_at")
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max("v").alias("v"), F.min("ingested_at").alias("first_at"))
        .select("key", "v.*", "first_at")
    )


def find_orphans(users: DataFrame, posts: DataFrame, comments: DataFrame, deleted: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(table_name, record_id, field, period, status), one row per counted row of posts and comments and per reference that
    is `missing`, `deleted` or `late`.

    Null or blank references are no reference; a null created_at gives period `unknown` and is never before a deletion; a
    null arrival is never late. A parent without a type, or with a type that is neither posts nor comments, may be in either:
    it is sound if one of them has it, else the milder of both findings counts (late, deleted, missing). Repeated rows count
    once, columns beyond those named here are not read, empty tables give no rows.
    """
    # written once, read as parents and as children
    u = cut(counted_rows(users), "users")
    p = cut(counted_rows(posts, author_id=norm_key(F.col("author_id"))), "posts")
    c = cut(counted_rows(comments, user=norm_key(F.col("user")), pid=norm_key(F.col("parent.id")), ptype=norm_key(F.col("parent.type"))), "comments")

    ts = "timestamp_ntz"
    nil = lambda kind: F.lit(None).cast(kind)

    def tagged(df: DataFrame, space: str, tag: Column, key: Column, created: Column, first: Column, gone: Column, named: Column) -> DataFrame:
        return df.select(F.lit(space).alias("space"), key.alias("key"), tag.alias("tag"), created.cast(ts).alias("created_at"), first.cast(ts).alias("first_at"), gone.cast(ts).alias("deleted_at"), named.cast(ts).alias("named_at"))

    k, n = F.col("key"), nil(ts)
    row = lambda df, space, tag: tagged(df, space, F.lit(tag), k, F.col("created_at"), F.col("first_at"), n, n)
    d = deleted.select(norm_key(F.col("collection")).alias("t"), norm_key(F.col("id")).alias("key"), "deleted_at").where("key IS NOT NULL")

    def refs(df: DataFrame, table: str, field: str, space: str, key: Column, want: Column) -> DataFrame:
        period = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("unknown"))
        return df.where(key.isNotNull()).select(F.lit(table).alias("table_name"), F.col("key").alias("record_id"), F.lit(field).alias("field"), period.alias("period"), F.lit(space).alias("space"), key.alias("ref"), want.alias("want"), F.col("ingested_at").cast(ts).alias("own_at"))

    children = reduce(
        DataFrame.unionByName,
        [
            refs(p, "posts", "author_id", "users", F.col("author_id"), F.lit("users")),
            refs(c, "comments", "user", "users", F.col("user"), F.lit("users")),
            refs(c, "comments", "parent", "threads", F.col("pid"), F.when(F.col("ptype").isin("posts", "comments"), F.col("ptype")).otherwise("any")),
        ],
    )
    long = reduce(
        DataFrame.unionByName,
        [
            row(u, "users", "users"),
            row(p, "threads", "posts"),
            row(c, "threads", "comments"),
            tagged(d.where("t = 'users'"), "users", F.col("t"), k, n, n, F.col("deleted_at"), n),
            tagged(d.where("t IN ('posts', 'comments')"), "threads", F.col("t"), k, n, n, F.col("deleted_at"), n),
            children.select("space", F.col("ref").alias("key"), F.lit("ref").alias("tag"), n.alias("created_at"), n.alias("first_at"), n.alias("deleted_at"), F.col("own_at").alias("named_at")),
        ],
    )

    tags = ("users", "posts", "comments")
    of = lambda t, c: F.when(F.col("tag") == t, F.col(c))
    # first_at is null for deletions; a row whose arrival is null still is a row
    aggs = [F.min("named_at").alias("named_at"), F.count_if(F.col("tag") == "ref").alias("children")]
    for t in tags:
        aggs += [
            F.max((F.col("tag") == t) & F.col("deleted_at").isNull()).alias(f"{t}_has"),
            F.max(of(t, "created_at")).alias(f"{t}_created"),
            F.min(of(t, "first_at")).alias(f"{t}_first"),
            F.max(of(t, "deleted_at")).alias(f"{t}_gone"),
        ]
    groups = long.groupBy("space", "key").agg(*aggs).where("children > 0")

    def status(t: str, own: Column) -> Column:
        has, gone = F.col(f"{t}_has"), F.col(f"{t}_gone")
        return (
            F.when(~has & gone.isNull(), 3)
            .when(gone.isNotNull() & (~has | (gone > F.col(f"{t}_created"))), 2)
            .when(F.col(f"{t}_first") > own, 1)
            .otherwise(0)
        )

    # unsound for any child at all: judged by the earliest naming record
    least = F.col("named_at")
    unsound = groups.where(
        F.when(F.col("space") == "users", status("users", least) > 0).otherwise((status("posts", least) > 0) | (status("comments", least) > 0))
    )
    unsound = cut(unsound, "unsound")
    named = key_filter(unsound, ["space", "key"])
    # as many parts of a key as its children fill tasks; the keys that have more than one are few by the choice of a part's size
    total = unsound.agg(F.sum("children")).head()[0] or 0
    part = max(task_rows, -(-total // max(HOT_KEYS, int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    parts = F.ceil(F.col("children") / part).cast("int")
    hot = unsound.where(F.col("children") > part).select("space", F.col("key").alias("ref"), parts.alias("parts"))
    salted = unsound.select("space", F.col("key").alias("ref"), *[f"{t}_{x}" for t in tags for x in ("has", "created", "first", "gone")], F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("salt"))
    named_ones = children.where(named(F.col("space"), F.col("ref"))).join(F.broadcast(hot), ["space", "ref"], "left")
    salt = F.pmod(F.xxhash64("table_name", "record_id", "field"), F.coalesce("parts", F.lit(1))).cast("int")
    met = named_ones.withColumn("salt", salt).drop("parts").join(salted, ["space", "ref", "salt"])
    own = F.col("own_at")
    code = (
        F.when(F.col("want") == "users", status("users", own))
        .when(F.col("want") == "posts", status("posts", own))
        .when(F.col("want") == "comments", status("comments", own))
        .otherwise(F.least(status("posts", own), status("comments", own)))
    )
    return (
        met.withColumn("code", code)
        .where("code > 0")
        .select("table_name", "record_id", "field", "period", F.element_at(F.array(F.lit("late"), F.lit("deleted"), F.lit("missing")), F.col("code")).alias("status"))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """(table_name, field, period, status, n): the orphans of each table and month."""
    return found.groupBy("table_name", "field", "period", "status").agg(F.count("*").alias("n"))
