"""Schemas that drift between files (problem 6).

Method: tagged-union inference. Each document's JSON is read as a map from field to type tag and value; the parallel schemas of
all documents of a collection and version are fused by a map-side combined union that keeps every alternative type of a path, inside objects and lists too;
paths in conflict are split into one typed branch each plus a canonical text, and alternatives that appear are reported. The
declared schemas are fused the same way, so a document deviates where its tag is none of the declared alternatives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.canon import _bad, canon, json_kind, parse_object
from quirefold.session import cut
from quirefold.sources import yamlite

#: The JSON types that a declared type takes. A ref with a list of targets takes objects too.
TAKES = {
    "string": ["string"],
    "date": ["string"],
    "datetime": ["string"],
    "ref": ["string"],
    "number": ["number"],
    "boolean": ["boolean"],
    "list": ["list"],
    "object": ["object"],
}
#: Rows of a small side that are broadcast, some tens of MB; a larger one is joined by salted keys.
SMALL = 200_000
#: Parts of a hot key in such a join.
SALTS = 32

DECLARED = "ver int, version_id long, collection string, field string, type string, takes array<string>, needed boolean"


def declared_fields(text: str) -> list[tuple[str, str, str, list[str], bool]]:
    """(collection, field, type, JSON types taken, required without default) of a schema text; a text that can't be read has none."""
    try:
        doc = yamlite.load(text or "")
    except (yamlite.YamlError, RecursionError):
        return []
    out = []
    cols = doc.get("collections") if isinstance(doc, dict) else None
    for c, body in (cols or {}).items() if isinstance(cols, dict) else ():
        fields = body.get("fields") if isinstance(body, dict) else None
        for f, d in (fields or {}).items() if isinstance(fields, dict) else ():
            d = {"type": d} if isinstance(d, str) else d if isinstance(d, dict) else {}
            kind = str(d.get("type", "string"))
            takes = TAKES.get(kind, ["object"]) + (["object"] if kind == "ref" and isinstance(d.get("target"), list) else [])
            out.append((c, f, kind, takes, d.get("required") is True and d.get("default") is None))
    return out


@dataclass(frozen=True)
class Versions:
    """The versions in order: 16 bytes each, so that every task can look its documents' versions up."""

    ids: tuple[int, ...]
    micros: tuple[int, ...]

    def at(self, modified: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(number, id) of the version in force at each time; null where there is none or no time."""
        t = modified.cast(pa.timestamp("us")).cast(pa.int64())
        ok = t.is_valid().to_numpy(zero_copy_only=False)
        k = np.searchsorted(np.array(self.micros, np.int64), t.fill_null(0).to_numpy(zero_copy_only=False), "right") - 1
        ok &= k >= 0
        ids = np.array(self.ids, np.int64)[np.maximum(k, 0)] if self.ids else np.zeros(len(k), np.int64)
        return pa.array(k.astype(np.int32), mask=~ok), pa.array(ids, mask=~ok)


def versions(spark: SparkSession, history: DataFrame) -> tuple[DataFrame, Versions]:
    """The declared fields of every version, read from their texts by the executors, and the versions by created_at and id."""
    rows = history.where("created_at IS NOT NULL")
    ends = sorted((r["t"], r["id"]) for r in rows.select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t")).distinct().collect())
    number = {x: k for k, x in enumerate(ends)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ver", pa.int32()), ("version_id", pa.int64()), ("collection", pa.string()), ("field", pa.string()), ("type", pa.string()), ("takes", pa.list_(pa.string())), ("needed", pa.bool_())])
        for b in batches:
            out = [(number[r["t"], r["id"]], r["id"], *f) for r in b.to_pylist() for f in declared_fields(r["schema_yaml"])]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema=schema)

    texts = rows.select("id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), "schema_yaml").distinct()
    return cut(texts.mapInArrow(read, DECLARED).distinct(), "declared"), Versions(tuple(i for _, i in ends), tuple(t for t, _ in ends))


def schema_changes(declared: DataFrame, seen: Versions) -> DataFrame:
    """(version_id, collection, field, change) of each version against the one before it: added, removed, retyped."""
    ids = declared.sparkSession.createDataFrame(list(enumerate(seen.ids)), "ver int, version_id long")
    now = declared.where("ver > 0").select("ver", "collection", "field", F.col("type").alias("new"))
    old = declared.where(F.col("ver") < len(seen.ids) - 1).select((F.col("ver") + 1).alias("ver"), "collection", "field", F.col("type").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "retyped")
    return now.join(old, ["ver", "collection", "field"], "full").withColumn("change", change).where("change IS NOT NULL").join(ids, "ver").select("version_id", "collection", "field", "change")


def small_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """large joined with what is expected to be small: by broadcast if it has at most SMALL rows, else by keys in SALTS parts, so
    that one key with a third of all rows is no load for one task. Null keys equal each other."""
    same = {k: F.struct(F.col(k).isNull(), F.coalesce(F.col(k), F.lit(0 if large.schema[k].dataType.typeName() in ("integer", "long") else ""))) for k in keys}
    s = small.withColumns({f"_{k}": same[k] for k in keys}).drop(*keys)
    g = large.withColumns({f"_{k}": same[k] for k in keys})
    on = [f"_{k}" for k in keys]
    if small.limit(SMALL + 1).count() <= SMALL:
        return g.join(F.broadcast(s), on, how).drop(*on)
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    g = g.withColumn("_salt", F.pmod(F.xxhash64(*large.columns[:1], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return g.join(s, [*on, "_salt"], how).drop(*on, "_salt")


def tagged_documents(documents: DataFrame, seen: Versions) -> DataFrame:
    """(doc_id, collection, ver, version_id, tags): each JSON object as a map from field to type tag, with its version in force.
    Texts that hold no object, and documents older than any version or without a time, are left out."""

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ver, ident = seen.at(b.column(2))
            objects = [parse_object(x) if v is not None else None for x, v in zip(b.column(3).to_pylist(), ver.to_pylist())]
            ok = pa.array([k for k, o in enumerate(objects) if o is not None], pa.int32())
            kinds = pa.array([[(k, json_kind(v)) for k, v in o.items()] for o in objects if o is not None], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(ok), b.column(1).take(ok), ver.take(ok), ident.take(ok), kinds], names=["doc_id", "collection", "ver", "version_id", "tags"])

    schema = "doc_id long, collection string, ver int, version_id long, tags map<string,string>"
    return documents.select("doc_id", "collection", "modified_at", "data_json").where("modified_at IS NOT NULL AND data_json IS NOT NULL").mapInArrow(tag, schema)


def step(key: str) -> str:
    """A key as a part of a path; one that could be read as several is quoted."""
    return json.dumps(key) if not key or any(c in key for c in '."[]') else key


def walk(text: str | None) -> list[tuple[str | None, str, str | None]]:
    """(field, tag, canonical) of every value in a document's text: fields of objects as a.b, elements of lists as a[]; null
    values are not there. A text that holds no object, or one without values, is one row without a field: its own JSON type, or
    the tag text and the text itself where it is no JSON or is nested too deep for canon (some hundred levels)."""
    if text is None:
        return [(None, "null", None)]
    try:
        v = json.loads(text, parse_constant=_bad)
        whole = [(None, json_kind(v), v if isinstance(v, str) else canon(v))]
        if not isinstance(v, dict):
            return whole
        out, todo = [], [(step(k), x) for k, x in reversed(v.items())]
        while todo:
            path, x = todo.pop()
            if x is None:
                continue
            out.append((path, json_kind(x), x if isinstance(x, str) else canon(x)))
            if isinstance(x, dict):
                todo += [(f"{path}.{step(k)}", y) for k, y in reversed(x.items())]
            elif isinstance(x, list):
                todo += [(f"{path}[]", y) for y in reversed(x)]
        return out or whole
    except (ValueError, RecursionError):
        return [(None, "text", text)]


def typed_values(documents: DataFrame, seen: Versions) -> DataFrame:
    """(doc_id, collection, ver, version_id, field, tag, canonical, once): walk() of every document, none left out; ver is null
    where no version is in force; once marks a document's first value of a field and tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                there: set = set()
                for field, tag, value in walk(text):
                    at.append(i)
                    rows.append((field, tag, value, (field, tag) not in there))
                    there.add((field, tag))
            ver, ident = seen.at(b.column(2))
            k = pa.array(at, pa.int32())
            cols = list(zip(*rows)) if rows else [()] * 4
            made = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(k), b.column(1).take(k), ver.take(k), ident.take(k), *made], names=["doc_id", "collection", "ver", "version_id", "field", "tag", "canonical", "once"])

    schema = "doc_id long, collection string, ver int, version_id long, field string, tag string, canonical string, once boolean"
    return documents.select("doc_id", "collection", "modified_at", "data_json").mapInArrow(run, schema)


def fuse(values: DataFrame) -> DataFrame:
    """(collection, ver, field, tag, n): the union of all documents' schemas, every alternative kept and its documents counted."""
    return values.where("once AND field IS NOT NULL").groupBy("collection", "ver", "field", "tag").agg(F.count("*").alias("n"))


def deviating(union: DataFrame, declared: DataFrame) -> DataFrame:
    """The alternatives of a fused union that the version does not declare, with the change: undeclared or mistyped."""
    d = declared.select("ver", "collection", "field", "takes")
    known = union.join(d, ["ver", "collection", "field"], "left")
    change = F.when(F.col("takes").isNull(), "undeclared").when(~F.array_contains("takes", F.col("tag")), "mistyped")
    return known.withColumn("change", change).where("change IS NOT NULL").select("collection", "ver", "field", "tag", "change")


def find_drift(documents: DataFrame, history: DataFrame) -> DataFrame:
    """(version_id, doc_id, collection, field, change): changes of the declared schema (doc_id 0) and deviations of documents.

    The schemas of all documents are fused, their alternatives are held against those declared, and the documents that hold a
    deviating alternative are listed. A null field in JSON is not there; a text that is null or no object deviates in nothing; a
    document whose modified_at is null or before the first version has no version. Repeated documents give repeated rows only if
    their doc_id is repeated. Other columns are not read. Without versions there are no rows.
    """
    declared, seen = versions(documents.sparkSession, history)
    changes = schema_changes(declared, seen).select("version_id", F.lit(0).cast("long").alias("doc_id"), "collection", "field", "change")
    tagged = cut(tagged_documents(documents, seen), "tagged")
    long = tagged.select("doc_id", "collection", "ver", "version_id", F.explode("tags").alias("field", "tag")).where("tag <> 'null'")
    bad = cut(deviating(fuse(long.withColumn("once", F.lit(True))), declared), "deviating")
    wrong = small_join(long, bad, ["collection", "ver", "field", "tag"]).select("version_id", "doc_id", "collection", "field", "change")
    needed = declared.where("needed").groupBy("ver", "collection").agg(F.collect_list("field").alias("needed"))  # one schema's fields
    there = F.map_keys(F.map_filter("tags", lambda k, v: v != "null"))
    absent = small_join(tagged, needed, ["ver", "collection"]).select("version_id", "doc_id", "collection", F.explode(F.array_except("needed", there)).alias("field"), F.lit("absent").alias("change"))
    return changes.unionByName(wrong).unionByName(absent)


def appearing_alternatives(documents: DataFrame, history: DataFrame) -> DataFrame:
    """(version_id, collection, field, tag, n): types of a path in a version that no earlier version's documents had. The types
    of the documents in no version are rows of their own, with a null version_id."""
    spark = documents.sparkSession
    _, seen = versions(spark, history)
    first = fuse(typed_values(documents, seen)).groupBy("collection", "field", "tag", F.col("ver").isNull().alias("none")).agg(F.min("ver").alias("ver"), F.min_by("n", F.coalesce("ver", F.lit(-1))).alias("n"))
    ids = spark.createDataFrame(list(enumerate(seen.ids)), "ver int, version_id long")
    return first.join(ids, "ver", "left").select("version_id", "collection", "field", "tag", "n")


def value_table(documents: DataFrame, history: DataFrame) -> DataFrame:
    """One row per document and value that is there at any depth (elements of a list at one path), in one schema for all: the canonical text and, where the fused union has
    several alternatives, the typed branch the value belongs to (as_number, as_boolean, as_json); branch_count tells conflicts.

    Every document has a row: schema_no is null where no version is in force, and a document without fields (null, no JSON, no
    object, an empty one) is one row whose field and branch_count are null, with the tag and text of the whole."""
    _, seen = versions(documents.sparkSession, history)
    long = typed_values(documents, seen)
    alts = cut(fuse(long).groupBy("collection", "field").agg(F.countDistinct("tag").alias("branch_count")), "alternatives")
    return small_join(long, alts, ["collection", "field"], "left").select(
        "doc_id",
        "collection",
        F.col("ver").cast("long").alias("schema_no"),
        "field",
        "tag",
        "canonical",
        F.when(F.col("tag") == "number", F.expr("try_cast(canonical AS double)")).alias("as_number"),
        F.when(F.col("tag") == "boolean", F.col("canonical") == "true").alias("as_boolean"),
        F.when(F.col("tag").isin("list", "object"), F.col("canonical")).alias("as_json"),
        "branch_count",
    )


#: Spark types of the branches, by JSON type; lists and objects stay canonical JSON.
BRANCHES = {"string": "string", "number": "double", "boolean": "boolean", "list": "string", "object": "string"}


def consistent_table(documents: DataFrame, history: DataFrame) -> DataFrame:
    """One row a document, in one schema for all: (doc_id, collection, version_id, kind, whole, data, undeclared).

    data is a struct with a member for each field that any version declares. A member is itself a struct: `canonical`, the text that
    every type has, and a typed branch for each alternative that the documents' fused union holds of the field (as_string,
    as_number, as_boolean, as_list, as_object), all but one of them null. Fields that no version declares are in undeclared, by name,
    with their tag and canonical text, so nothing is lost and the number of columns follows the declared schemas, not the data.
    kind is the JSON type of the whole text (`text` if it is no JSON, null if there is none); what is no object is in whole.
    """
    declared, seen = versions(documents.sparkSession, history)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = pa.struct([("tag", pa.string()), ("canonical", pa.string())])
        for b in batches:
            kinds, wholes, fields = [], [], []
            for text in b.column(3).to_pylist():
                o = parse_object(text) if text is not None else None
                if o is None:
                    _, kind, whole = walk(text)[0]
                    kinds.append(None if text is None else kind), wholes.append(whole), fields.append([])
                else:
                    kinds.append("object"), wholes.append(None)
                    fields.append([(k, {"tag": json_kind(v), "canonical": v if isinstance(v, str) else canon(v)}) for k, v in o.items() if v is not None])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), seen.at(b.column(2))[1], pa.array(kinds, pa.string()), pa.array(wholes, pa.string()), pa.array(fields, pa.map_(pa.string(), entry))], names=["doc_id", "collection", "version_id", "kind", "whole", "fields"])

    schema = "doc_id long, collection string, version_id long, kind string, whole string, fields map<string,struct<tag:string,canonical:string>>"
    rows = cut(documents.select("doc_id", "collection", "modified_at", "data_json").mapInArrow(run, schema), "objects")
    names = [r[0] for r in declared.select("field").distinct().orderBy("field").collect()]  # what the schemas declare, not the data
    found = rows.select(F.explode("fields").alias("field", "v")).join(F.broadcast(declared.select("field").distinct()), "field").select("field", "v.tag").distinct().collect()
    held: dict[str, set] = {}
    for f, tag in found:
        held.setdefault(f, set()).add(tag)

    def member(name: str) -> Column:
        v = F.col("fields")[name]
        branches = [F.when(v["tag"] == t, v["canonical"].try_cast(BRANCHES[t])).alias(f"as_{t}") for t in BRANCHES if t in held.get(name, ())]
        return F.struct(v["canonical"].alias("canonical"), *branches).alias(name)

    data = F.struct(*map(member, names)) if names else F.struct(F.lit(None).cast("string").alias("none"))
    return rows.select("doc_id", "collection", "version_id", "kind", "whole", data.alias("data"), F.map_filter("fields", lambda k, v: ~k.isin(names) if names else F.lit(True)).alias("undeclared"))
