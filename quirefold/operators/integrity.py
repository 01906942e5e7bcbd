"""Referential integrity: what refers to deleted records, and what becomes of it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.errors import ReferenceRestricted
from quirefold.schema import Schema
from quirefold.session import cut


def policy(s: Schema, collection: str, name: str) -> str:
    """Of a reference: its own, else its collection's, else error."""
    c = s.collections[collection]
    return c.fields[name].on_delete or c.on_delete or "error"


def references(s: Schema) -> list[tuple[str, str, list[str], str]]:
    """(collection, field, targets, single, poly or list) of every reference of a schema."""
    out = []
    for c in s.collections.values():
        for f in c.fields.values():
            if f.type == "ref":
                out.append((c.name, f.name, f.targets, "poly" if f.polymorphic else "single"))
            elif f.type == "list" and f.items is not None and f.items.type == "ref":
                out.append((c.name, f.name, f.items.targets, "list"))
    return out


def referrers(s: Schema, name: str) -> set[str]:
    """The collections whose references lead to a collection, at once or by way of others: what a deletion can concern."""
    out, front = set(), {name}
    while front:
        front = {c for c, _, targets, _ in references(s) if front & set(targets)} - out
        out |= front
    return out


def _keys(df: DataFrame, name: str, shape: str, targets: list[str]) -> DataFrame:
    """(id, target, ref) of the references in one field."""
    if shape == "poly":
        t = F.explode(F.when(F.col(f"{name}.type").isNull(), F.array(*map(F.lit, targets))).otherwise(F.array(F.col(f"{name}.type"))))
        return df.where(F.col(f"{name}.id").isNotNull()).select("id", t.alias("target"), F.col(f"{name}.id").alias("ref"))
    if shape == "list":
        return df.select("id", F.lit(targets[0]).alias("target"), F.explode(name).alias("ref"))
    return df.where(F.col(name).isNotNull()).select("id", F.lit(targets[0]).alias("target"), F.col(name).alias("ref"))


def find_references(s: Schema, tables: dict[str, DataFrame], gone: DataFrame, names: set[str] | None = None) -> DataFrame:
    """(collection, field, id, target, ref) of every reference to the records of gone (collection, id); names are the collections
    that gone may name, if known: others' referrers are not read."""
    g = gone.select(F.col("collection").alias("target"), F.col("id").alias("ref")).distinct()
    out = None
    for c, f, targets, shape in references(s):
        if names is not None and not names & set(targets):
            continue
        hit = _keys(tables[c], f, shape, targets).join(g, ["target", "ref"], "left_semi").select(F.lit(c).alias("collection"), F.lit(f).alias("field"), "id", "target", "ref")
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else gone.sparkSession.createDataFrame([], "collection string, field string, id string, target string, ref string")


#: Rounds of a cascade whose results are united before they are written as one.
CUT_EVERY = 8


@dataclass
class Effects:
    """What deleting some records does: all of it is known before any of it is done."""

    deleted: DataFrame  # (collection, id), the records asked for and those deleted with them
    nullified: DataFrame  # (collection, field, id)
    archived: DataFrame  # (collection, id)
    restricted: list = field(default_factory=list)


def plan_delete(s: Schema, tables: dict[str, DataFrame], gone: DataFrame) -> Effects:
    """The effects of deleting the records of gone, cascades followed to the end; loops end since no record is visited twice.
    Raises ReferenceRestricted, with nothing done, if a record that stays refers to one that goes under the policy error."""
    spark = gone.sparkSession
    pol = spark.createDataFrame([(c, f, policy(s, c, f)) for c, f, _, _ in references(s)] or [("", "", "")], "collection string, field string, policy string")
    seen = cut(gone.select("collection", "id").distinct(), "gone")
    front = seen
    kept = spark.createDataFrame([], "collection string, field string, id string, target string, ref string, policy string")
    for rounds in count(1):
        # only collections that can refer to what goes are read; there are as many names as the schema has collections
        names = {r[0] for r in front.select("collection").distinct().collect()}
        if not any(names & set(targets) for _, _, targets, _ in references(s)):
            break
        refs = cut(find_references(s, tables, front, names).join(F.broadcast(pol), ["collection", "field"]), "refs")
        kept = kept.unionByName(refs)
        front = cut(refs.where("policy = 'cascade'").select("collection", "id").distinct().join(seen, ["collection", "id"], "left_anti"), "front")
        seen = seen.unionByName(front)
        if rounds % CUT_EVERY == 0:  # plans stay small however deep references are
            seen, kept = cut(seen, "gone"), cut(kept, "kept")
    stay = kept.join(seen, ["collection", "id"], "left_anti")
    stopped = stay.where("policy = 'error'").select("collection", "field", "id").limit(20).collect()
    if stopped:
        raise ReferenceRestricted("still referred to by " + ", ".join(f"{r['collection']}/{r['id']} ({r['field']})" for r in stopped))
    archived = stay.where("policy = 'archive'").select("collection", "id").distinct()
    nullified = stay.where("policy = 'nullify'").join(archived, ["collection", "id"], "left_anti").select("collection", "field", "id", "ref").distinct()
    return Effects(seen, nullified, archived)


def nullify(df: DataFrame, name: str, gone: DataFrame, key: str = "id") -> DataFrame:
    """df with null where the reference names a record of gone."""
    g = gone.select(F.col(key).cast(df.schema[name].dataType).alias("_g"), F.lit(True).alias("_hit")).distinct()
    return df.join(g, df[name] == F.col("_g"), "left").withColumn(name, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(name))).drop("_g", "_hit")


def archive(df: DataFrame, name: str, gone: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, archived) rows of df."""
    g = gone.select(F.col(key).alias(name)).distinct()
    return df.join(g, name, "left_anti"), df.join(g, name, "left_semi")


