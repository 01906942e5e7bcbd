"""Declared schemas: collections of typed fields, reusable types, named views, and their Spark types."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from quirefold.errors import SchemaError
from quirefold.sources import yamlite

SCALARS = {"string", "number", "boolean", "date", "datetime"}
POLICIES = {"error", "cascade", "nullify", "archive"}
#: Columns that every collection has without declaring them.
IMPLICIT = ("id", "created_at", "modified_at")


@dataclass
class Field:
    name: str
    type: str
    required: bool = False
    enum: list | None = None
    default: object = None
    has_default: bool = False
    targets: list[str] = field(default_factory=list)
    polymorphic: bool = False
    items: Field | None = None
    on_delete: str | None = None


@dataclass
class Collection:
    name: str
    path: str
    fields: dict[str, Field]
    content: bool = False
    additional_properties: bool = False
    strict: bool = True
    readonly: bool = False
    on_delete: str | None = None
    auto_id: str | None = None
    on_conflict: str = "error"
    records: dict | None = None

    @property
    def format(self) -> str:
        """json, jsonl or md, by the extension of the path."""
        return {"json": "json", "jsonl": "jsonl"}.get(self.path.rsplit(".", 1)[-1], "md")


@dataclass
class View:
    name: str
    query: str
    type: str = "view"
    materialize: bool = False
    buffer: float = 1.0
    params: dict[str, str] = field(default_factory=dict)


@dataclass
class Schema:
    collections: dict[str, Collection]
    types: dict[str, dict[str, Field]]
    views: dict[str, View]
    text: str = ""

    @property
    def hash(self) -> str:
        return schema_hash(self.text)


def schema_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _field(name: str, d: object) -> Field:
    if isinstance(d, str):
        d = {"type": d}
    if not isinstance(d, dict) or not isinstance(d.get("type", None), str):
        raise SchemaError(f"field {name}: a type is needed")
    target = d.get("target")
    items = d.get("items")
    return Field(
        name,
        d["type"],
        bool(d.get("required", False)),
        d.get("enum"),
        d.get("default"),
        d.get("default") is not None,
        [target] if isinstance(target, str) else list(target or []),
        isinstance(target, list),
        _field("items", items) if items is not None else None,
        d.get("on_delete"),
    )


def parse_schema(text: str) -> Schema:
    """The schema of a YAML text, checked. Raises SchemaError."""
    try:
        doc = yamlite.load(text)
    except yamlite.YamlError as e:
        raise SchemaError(str(e)) from e
    if not isinstance(doc, dict):
        raise SchemaError("a schema is a mapping")
    types = {n: {f: _field(f, d) for f, d in (body or {}).items()} for n, body in (doc.get("types") or {}).items()}
    cols = {}
    for n, b in (doc.get("collections") or {}).items():
        b = b or {}
        ident = b.get("id") or {}
        cols[n] = Collection(
            n, b.get("path") or "", {f: _field(f, d) for f, d in (b.get("fields") or {}).items()}, bool(b.get("content", False)), bool(b.get("additional_properties", False)),
            bool(b.get("strict", True)), bool(b.get("readonly", False)), b.get("on_delete"), ident.get("auto"), ident.get("on_conflict", "error"), b.get("records"),
        )
    views = {}
    for n, b in (doc.get("views") or {}).items():
        raw = b.get("buffer")
        if raw is not None and not re.fullmatch(r"\d+(\.\d+)?x", str(raw)):
            raise SchemaError(f"view {n}: buffer is a number and x, like 2x")
        params = {p: (x if isinstance(x, str) else (x or {}).get("type", "string")) for p, x in (b.get("params") or {}).items()}
        views[n] = View(n, b.get("query") or "", b.get("type", "view"), bool(b.get("materialize", False)), float(str(raw)[:-1]) if raw is not None else 1.0, params)
    s = Schema(cols, types, views, text)
    check_schema(s)
    return s


def check_schema(s: Schema) -> None:
    for c in s.collections.values():
        if not c.path.strip():
            raise SchemaError(f"collection {c.name}: the path is empty")
        for f in c.fields.values():
            _check_field(s, c.name, f)
        if c.on_delete is not None and c.on_delete not in POLICIES:
            raise SchemaError(f"collection {c.name}: unknown on_delete {c.on_delete}")
    for n, fs in s.types.items():
        for f in fs.values():
            _check_field(s, n, f)
    for v in s.views.values():
        if not v.query.strip():
            raise SchemaError(f"view {v.name}: the query is empty")
        if v.type == "query" and not v.params:
            raise SchemaError(f"view {v.name}: a query needs params")


def _check_field(s: Schema, owner: str, f: Field) -> None:
    at = f"{owner}.{f.name}"
    if f.type == "ref":
        if not f.targets:
            raise SchemaError(f"{at}: a ref needs a target")
        for t in f.targets:
            if t not in s.collections:
                raise SchemaError(f"{at}: no collection {t}")
    elif f.type not in SCALARS | {"list", "object"} and f.type not in s.types:
        raise SchemaError(f"{at}: unknown type {f.type}")
    if f.type == "list" and f.items is not None and f.items.type == "ref":
        for t in f.items.targets:
            if t not in s.collections:
                raise SchemaError(f"{at}: no collection {t}")
    if f.enum is not None and f.type != "string":
        raise SchemaError(f"{at}: only a string has an enum")
    if f.on_delete is not None and (f.type not in ("ref", "list") or f.on_delete not in POLICIES):
        raise SchemaError(f"{at}: on_delete stands at refs and lists, with {', '.join(sorted(POLICIES))}")


def spark_type(s: Schema, f: Field) -> T.DataType:
    """The column type of a field: refs to several collections are structs of type and id, objects stay JSON text."""
    if f.type == "number":
        return T.DoubleType()
    if f.type == "boolean":
        return T.BooleanType()
    if f.type == "list":
        return T.ArrayType(spark_type(s, f.items) if f.items else T.StringType())
    if f.type == "ref" and f.polymorphic:
        return T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.StringType())])
    if f.type in s.types:
        return T.StructType([T.StructField(n, spark_type(s, x), not (x.required or x.has_default)) for n, x in s.types[f.type].items()])
    return T.StringType()


def struct_of(s: Schema, c: Collection) -> T.StructType:
    """The declared fields of a collection; required and defaulted ones are never null, lists neither."""
    return T.StructType([T.StructField(n, spark_type(s, f), not (f.required or f.has_default or f.type == "list")) for n, f in c.fields.items()])
