"""Validation of documents against a declared collection, on the driver for one and by columns for tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.errors import ValidationFailed
from quirefold.schema import Collection, Field, Schema


def with_defaults(c: Collection, data: dict) -> dict:
    """data with the default in place of what is missing or null."""
    return data | {n: f.default for n, f in c.fields.items() if f.has_default and data.get(n) is None}


def default_columns(c: Collection) -> dict[str, object]:
    """with_defaults as columns of typed tables: a column for each field that has a default."""
    return {n: F.coalesce(F.col(n), F.lit(f.default)) for n, f in c.fields.items() if f.has_default}


def _problem(s: Schema, f: Field, v: object, at: str) -> list[str]:
    if f.type in ("string", "date", "datetime"):
        if not isinstance(v, str):
            return [f"{at}: expected {'a string' if f.type == 'string' else 'a ' + f.type + ' as a string'}"]
        return [f"{at}: {v!r} is none of {', '.join(map(str, f.enum))}"] if f.enum and v not in f.enum else []
    if f.type == "number":
        return [] if isinstance(v, (int, float)) and not isinstance(v, bool) else [f"{at}: expected a number"]
    if f.type == "boolean":
        return [] if isinstance(v, bool) else [f"{at}: expected a boolean"]
    if f.type == "list":
        return [] if isinstance(v, list) else [f"{at}: expected a list"]
    if f.type == "object":
        return [] if isinstance(v, dict) else [f"{at}: expected an object"]
    if f.type == "ref":
        return [] if isinstance(v, str) or (f.polymorphic and isinstance(v, dict)) else [f"{at}: expected a reference"]
    if not isinstance(v, dict):
        return [f"{at}: expected {f.type}"]
    return [f"{at}.{n}: required" for n, x in s.types.get(f.type, {}).items() if x.required and not x.has_default and v.get(n) is None]


def validate(s: Schema, c: Collection, data: object) -> tuple[list[str], list[str]]:
    """(errors, warnings): what a strict collection rejects, a lenient one only warns of; what is no mapping is always an error."""
    if not isinstance(data, dict):
        return ["a document is a mapping"], []
    out: list[str] = []
    for n, f in c.fields.items():
        v = data.get(n)
        if v is None:
            if f.required and not f.has_default:
                out.append(f"{n}: required")
        else:
            out += _problem(s, f, v, n)
    if not c.additional_properties:
        out += [f"{n}: not declared" for n in data if n not in c.fields]
    return (out, []) if c.strict else ([], out)


def prepare(s: Schema, c: Collection, data: dict) -> dict:
    """data with its defaults, if it is valid then; else ValidationFailed."""
    data = with_defaults(c, data)
    errors, _ = validate(s, c, data)
    if errors:
        raise ValidationFailed("; ".join(errors))
    return data


_ISSUES = T.StructType([T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType()))])


def validate_table(s: Schema, c: Collection, documents: DataFrame, column: str = "data_json") -> DataFrame:
    """documents with (errors, warnings) of each row's JSON; null or broken JSON is no mapping."""

    @F.pandas_udf(_ISSUES)
    def issues(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                v = json.loads(t) if t is not None else None
            except ValueError:
                v = None
            rows.append(validate(s, c, with_defaults(c, v) if isinstance(v, dict) else v))
        return pd.DataFrame(rows, columns=["errors", "warnings"])

    return documents.withColumn("_i", issues(column)).select("*", "_i.errors", "_i.warnings").drop("_i")


def rule_columns(c: Collection) -> dict[str, object]:
    """A predicate a rule, for typed tables: true where a row breaks it. Required, enum: inside the JVM, pushed to the scan."""
    out = {}
    for n, f in c.fields.items():
        if f.required and not f.has_default:
            out[f"{n}_required"] = F.col(n).isNull()
        if f.enum:
            out[f"{n}_enum"] = F.col(n).isNotNull() & ~F.col(n).isin(*f.enum)
    return out


def report(checked: DataFrame, key: str = "id") -> DataFrame:
    """(collection, total, with_errors, with_warnings) of checked documents."""
    return checked.groupBy("collection").agg(F.count("*").alias("total"), F.count_if(F.size("errors") > 0).alias("with_errors"), F.count_if(F.size("warnings") > 0).alias("with_warnings"))
