"""Canonical forms of JSON texts."""

from __future__ import annotations

import json
import math


def _bad(x: str):
    raise ValueError(x)


def _pairs(pairs: list) -> dict:
    return dict(pairs)


def parse_object(text: str | None) -> dict | None:
    """The object a JSON text holds, else None. NaN and Infinity are not JSON; of repeated keys the last counts."""
    if text is None:
        return None
    try:
        v = json.loads(text, parse_constant=_bad)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def canon(v: object) -> str:
    """One text for equal values: key order is nothing, list order counts, 1 is 1.0 but not "1", null in an object is an absent key."""
    if isinstance(v, str):
        return json.dumps(v)
    if v is None:
        return "null"
    if v is True or v is False:
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isinf(v):
            return "1e999" if v > 0 else "-1e999"
        return str(int(v)) if v.is_integer() else repr(v)
    if isinstance(v, list):
        return "[" + ",".join(map(canon, v)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{canon(v[k])}" for k in sorted(v) if v[k] is not None) + "}"


def json_kind(v: object) -> str:
    """The JSON type of a parsed value: null, string, boolean, number, list or object."""
    if v is None:
        return "null"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "list" if isinstance(v, list) else "object"
