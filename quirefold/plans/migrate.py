"""Differences between two declared schemas, and what they ask of the documents."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.errors import MigrationFailed
from quirefold.schema import Schema, parse_schema


@dataclass(frozen=True)
class Change:
    kind: str
    collection: str
    field: str = ""
    old: object = None
    new: object = None
    safe: bool = True

    @property
    def description(self) -> str:
        at = f"{self.collection}.{self.field}" if self.field else self.collection
        was = f": {self.old} -> {self.new}" if self.old is not None or self.new is not None else ""
        return f"{self.kind} {at}{was}"


def diff(old: Schema, new: Schema) -> list[Change]:
    """All changes of collections, fields, types, enums, defaults and path templates, in order."""
    out = [Change("collection_added", n) for n in sorted(new.collections.keys() - old.collections.keys())]
    out += [Change("collection_removed", n, safe=False) for n in sorted(old.collections.keys() - new.collections.keys())]
    for n in sorted(old.collections.keys() & new.collections.keys()):
        a, b = old.collections[n], new.collections[n]
        for f in sorted(b.fields.keys() - a.fields.keys()):
            x = b.fields[f]
            out.append(Change("field_added", n, f, new=x.type, safe=x.has_default or not x.required))
        out += [Change("field_removed", n, f, old=a.fields[f].type, safe=False) for f in sorted(a.fields.keys() - b.fields.keys())]
        for f in sorted(a.fields.keys() & b.fields.keys()):
            x, y = a.fields[f], b.fields[f]
            if x.type != y.type:
                out.append(Change("field_type_changed", n, f, x.type, y.type, False))
            if x.enum is not None and y.enum is not None:
                out += [Change("enum_value_added", n, f, new=v) for v in y.enum if v not in x.enum]
                out += [Change("enum_value_removed", n, f, old=v, safe=False) for v in x.enum if v not in y.enum]
            if x.default != y.default:
                out.append(Change("default_changed", n, f, x.default, y.default))
        if a.path != b.path:
            out.append(Change("path_template_changed", n, old=a.path, new=b.path, safe=False))
    return out


def history_diff(history: DataFrame) -> DataFrame:
    """(version_id, kind, collection, field, safe) of every schema text in (id, schema_yaml, created_at) against the one before it.
    Versions are numbered by 16 bytes each; their texts meet in a join and are read by the executors."""
    rows = history.select("id", "schema_yaml", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"))
    order = sorted(((r["t"] is not None, r["t"] or 0, r["id"]) for r in rows.select("id", "t").distinct().collect()))
    number = history.sparkSession.createDataFrame([(k, i, t if there else None) for k, (there, t, i) in enumerate(order)], "n long, id long, t long")
    texts = rows.join(number.withColumnsRenamed({"id": "_i", "t": "_t"}), F.col("id").eqNullSafe(F.col("_i")) & F.col("t").eqNullSafe(F.col("_t"))).select("n", "id", "schema_yaml").dropDuplicates(["n"])
    pairs = texts.alias("b").join(texts.select((F.col("n") + 1).alias("n"), F.col("schema_yaml").alias("old")), "n").select("id", "old", "schema_yaml")

    def run(batches):
        for pdf in batches:
            out = [(i, c.kind, c.collection, c.field, c.safe) for i, a, b in pdf.itertuples(index=False) for c in diff(parse_schema(a), parse_schema(b))]
            yield pd.DataFrame(out, columns=["version_id", "kind", "collection", "field", "safe"])

    return pairs.mapInPandas(run, "version_id long, kind string, collection string, field string, safe boolean")


def check(changes: list[Change], new: Schema) -> list[str]:
    """Warnings of unsafe changes. Raises MigrationFailed for a new required field without default and for a changed type."""
    errors = [c.description for c in changes if c.kind == "field_type_changed" or (c.kind == "field_added" and not c.safe)]
    if errors:
        raise MigrationFailed("; ".join(errors))
    return [c.description for c in changes if not c.safe]


def backfill(documents: DataFrame, new: Schema, changes: list[Change]) -> DataFrame:
    """documents with the default of every added field where its key is absent from data_json; a null that is there stays."""
    fills: dict[str, dict] = {}
    for c in changes:
        if c.kind == "field_added" and new.collections[c.collection].fields[c.field].has_default:
            fills.setdefault(c.collection, {})[c.field] = new.collections[c.collection].fields[c.field].default
    if not fills:
        return documents

    @F.pandas_udf(T.StringType())
    def fill(collections: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for c, t in zip(collections, texts):
            try:
                v = json.loads(t) if t is not None and c in fills else None
            except ValueError:
                v = None
            out.append(json.dumps({**fills[c], **v}, ensure_ascii=False) if isinstance(v, dict) and fills[c].keys() - v.keys() else t)
        return pd.Series(out, dtype=object)

    touched = F.col("collection").isin(*fills)
    return documents.where(~touched | F.col("collection").isNull()).unionByName(documents.where(touched).withColumn("data_json", fill("collection", "data_json")))


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection, field, change) of two catalogs (collection, field, type), for schemas kept as tables."""
    a = old.select("collection", "field", F.col("type").alias("a"))
    b = new.select("collection", "field", F.col("type").alias("b"))
    change: Column = F.when(F.col("a").isNull(), "field_added").when(F.col("b").isNull(), "field_removed").when(F.col("a") != F.col("b"), "field_type_changed")
    return a.join(b, ["collection", "field"], "full").withColumn("change", change).where("change IS NOT NULL").select("collection", "field", "change")
