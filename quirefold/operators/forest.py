"""Parent-child links to full hierarchies (problem 7).

Method: tree contraction. A round compresses unary chains (nodes with a single child are bypassed where their random priority
beats those of child and parent, so no two neighbours go at once) and rakes the leaves (every node without children goes). What
goes is recorded with the link it had; rounds are logarithmic in the number of nodes, not in the depth. A core that
neither rakes nor compresses away is a set of loops, which compression shortens to self-loops: rounds end when no link is left.
The records are then undone in reverse order, which recovers root, depth, state and path. Every round is written once, so lineage
never grows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import norm_key
from quirefold.session import cut, drop_cut

#: A parent with more than this share of all links is hot: there are at most as many as its inverse, so they are broadcast.
HOT = 1 / 1000


def links_of(comments: DataFrame, node: str = "id", parent: str = "parent.id", version: str = "modified_at") -> DataFrame:
    """(node, parent) by the counted row (greatest version; of equal ones the greatest parent) of each id; blank ids are none,
    a blank parent is null."""
    return (
        comments.select(norm_key(F.col(node)).alias("node"), F.struct(F.col(version).alias("v"), norm_key(F.col(parent)).alias("parent")).alias("x"))
        .where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.max("x").alias("x"))
        .select("node", "x.parent")
    )


def _priority(c: Column, k: int) -> Column:
    return F.struct(F.xxhash64(c, F.lit(k)), c)


def _contract(edges: DataFrame, k: int, paths: bool) -> DataFrame:
    """One round, written: the links that stay (tag `rest`) and those of the leaves (`rake`). Where a link skips a bypassed node, it
    carries that node (v) with the weight of the link below it (cw)."""
    none = F.array().cast("array<string>")
    child = F.struct(*[c for c in edges.columns if c != "parent"])
    kids = edges.groupBy("parent").agg(F.count("*").alias("kids"), F.first(child).alias("c")).select(F.col("parent").alias("node"), "kids", "c")
    mine = _priority(F.col("node"), k)
    goes = (F.col("kids") == 1) & (mine > _priority(F.col("c.node"), k)) & (mine > _priority(F.col("parent"), k))
    a = edges.join(kids, "node", "left").withColumn("goes", F.coalesce(goes, F.lit(False)))
    skipped = a.where("goes").select(
        F.col("c.node").alias("node"), F.col("parent").alias("_p"), F.col("w").alias("_w"), F.least("node", "low").alias("_low"), F.col("node").alias("v"),
        *([F.concat(F.coalesce("seg", none), F.array("node")).alias("_seg")] if paths else []),
    )
    kept = a.where("NOT goes").drop("c", "goes").join(skipped, "node", "left").select(
        F.when(F.col("kids").isNull(), "rake").otherwise("rest").alias("tag"), "node", F.coalesce("_p", "parent").alias("parent"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.least("low", "_low").alias("low"),
        *([F.when(F.col("_p").isNull(), F.col("seg")).otherwise(F.concat("_seg", F.coalesce("seg", none))).alias("seg")] if paths else []),
        "v", F.when(F.col("v").isNotNull(), F.col("w")).alias("cw"), *([F.coalesce(F.size("seg"), F.lit(0)).alias("clen")] if paths else []),
    )
    return cut(kept, "round")


def resolve(links: DataFrame, paths: bool = False, hot: float = HOT) -> DataFrame:
    """(node, root_id, depth, state[, path]) of every node of (node, parent), node unique.

    A null parent makes a node its own root; a parent that is no node is a root outside. Links to oneself are loops of one.
    An empty table gives no rows. path runs from the root, or from the node on the loop, to the node itself.
    """
    spark = links.sparkSession
    nil = F.lit(None)
    base = cut(links.select("node", "parent"), "links")
    edges = base.where("parent IS NOT NULL").select("node", "parent", F.lit(1).alias("w"), nil.cast("string").alias("low"), *([nil.cast("array<string>").alias("seg")] if paths else []))
    # roots: nodes without a parent, and parents that are no node (`outside`, left out of the result); both end every walk
    parents = cut(edges.groupBy("parent").agg(F.count("*").alias("n")), "parents")
    total = parents.agg(F.sum("n")).head()[0] or 0
    # at most 1 / hot of them, and their children only become fewer: on the way back they are met by a broadcast, not by one task
    hot_parents = [r["parent"] for r in parents.where(F.col("n") > max(1, total * hot)).select("parent").collect()]
    roots = base.where("parent IS NULL").select("node", F.lit("tree").alias("state")).unionByName(
        parents.select(F.col("parent").alias("node")).join(base.select("node"), "node", "left_anti").withColumn("state", F.lit("outside"))
    )
    done = roots.select("node", F.col("node").alias("root_id"), F.lit(0).alias("depth"), "state", *([F.array("node").alias("path")] if paths else []))
    rounds: list[DataFrame] = []
    for k in count():
        loops = edges.where("node = parent")
        done = done.unionByName(loops.select("node", F.coalesce(F.least("node", "low"), "node").alias("root_id"), F.lit(0).alias("depth"), F.lit("cycle").alias("state"), *([F.array("node").alias("path")] if paths else [])))
        edges = edges.where("node <> parent")
        if edges.isEmpty():
            break
        rounds.append(_contract(edges, k, paths))
        edges = rounds[-1].where("tag = 'rest'").select(*edges.columns)
    done = cut(done, "done")
    schema, written = done.schema, [done._written_at]
    drop_cut(base), drop_cut(parents)
    for r in reversed(rounds):
        new = cut(_undo(r, done, hot_parents, paths), "done")
        drop_cut(r)
        written.append(new._written_at)
        done = spark.read.schema(schema).parquet(*written)
    return done.where("state <> 'outside'")


def _undo(r: DataFrame, done: DataFrame, hot_parents: list[str], paths: bool) -> DataFrame:
    """What a round took away, from what is done: leaves from their parents, with the node that their link skipped; skipped nodes
    from the child that stayed."""
    rake = F.col("tag") == "rake"
    gone = r.where(rake | F.col("v").isNotNull()).withColumn("key", F.when(rake, F.col("parent")).otherwise(F.col("node"))).drop("low", "parent")
    at = done.select(F.col("node").alias("key"), "root_id", "depth", "state", *(["path"] if paths else []))
    met = gone.join(at, "key")
    if hot_parents:
        is_hot = F.col("key").isin(hot_parents)
        met = gone.where(~is_hot).join(at, "key").unionByName(gone.where(is_hot).join(F.broadcast(at.where(is_hot)), "key"))
    below = F.when(F.col("state").isin("tree", "outside"), "tree").otherwise("below_cycle")
    on = F.col("state") == "cycle"

    def row(node, depth, state, path) -> Column:
        return F.struct(node.alias("node"), F.col("root_id"), depth.cast("int").alias("depth"), state.alias("state"), *([path.alias("path")] if paths else []))

    seg, n = (F.coalesce("seg", F.array().cast("array<string>")), F.col("clen")) if paths else (None, None)
    leaf = row(F.col("node"), F.col("depth") + F.col("w"), below, F.concat("path", seg, F.array("node")) if paths else None)
    over_leaf = row(F.col("v"), F.col("depth") + F.col("w") - F.col("cw"), below, F.concat("path", F.slice(seg, F.lit(1), F.greatest(F.size(seg) - n, F.lit(0)))) if paths else None)
    over_rest = row(F.col("v"), F.when(on, 0).otherwise(F.col("depth") - F.col("cw")), F.col("state"), F.when(on, F.array("v")).otherwise(F.slice("path", F.lit(1), F.greatest(F.size("path") - n - 1, F.lit(0)))) if paths else None)
    rows = F.when(rake & F.col("v").isNull(), F.array(leaf)).when(rake, F.array(leaf, over_leaf)).otherwise(F.array(over_rest))
    return met.select(F.inline(rows))


def find_threads(comments: DataFrame) -> DataFrame:
    """(comment_id, root_id, depth, state) of every comment, by its counted row: see resolve and links_of."""
    r = resolve(links_of(comments))
    return r.select(F.col("node").alias("comment_id"), "root_id", F.col("depth").cast("int").alias("depth"), "state")


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) from resolved paths: as many rows as the result itself has."""
    return resolved.select(F.col("node").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor")).select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).alias("distance")).where("distance > 0")
