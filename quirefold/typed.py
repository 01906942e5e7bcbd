"""Types made from a schema when it is loaded: enumerations, records, partial records and typed access to a store."""

from __future__ import annotations

import dataclasses
import enum
import json
import re
from typing import Any

from quirefold.functions.paths import singular
from quirefold.schema import IMPLICIT, Collection, Field, Schema


def class_name(s: str) -> str:
    return "".join(x[:1].upper() + x[1:] for x in re.split(r"[^A-Za-z0-9]+", s) if x)


@dataclasses.dataclass(frozen=True)
class Ref:
    """A reference to one of several collections; the type may be unknown."""

    type: str | None
    id: str

    @classmethod
    def of(cls, v: object) -> Ref:
        return cls(v.get("type"), v["id"]) if isinstance(v, dict) else cls(None, str(v))


def enums(s: Schema) -> dict[tuple[str, str], type[enum.Enum]]:
    """An enumeration for each field that has one, named after collection and field."""
    return {(c.name, f.name): enum.Enum(class_name(singular(c.name)) + class_name(f.name), {re.sub(r"\W", "_", str(v)).upper(): v for v in f.enum}) for c in s.collections.values() for f in c.fields.values() if f.enum}


def _attr(name: str) -> str:
    import keyword

    return name + "_" if keyword.iskeyword(name) else name


def _declared(c: Collection) -> list[Field]:
    """The fields that are no implicit columns: a declared id is the document's own."""
    return [f for f in c.fields.values() if f.name not in IMPLICIT and not (c.content and f.name == "content")]


def record(s: Schema, c: Collection, partial: bool = False) -> type:
    """A dataclass of a collection's documents: required and defaulted fields first, then optional ones; lists are never None.
    A partial record has every field optional."""
    need, rest = [], []
    for f in _declared(c):
        if partial:
            rest.append((_attr(f.name), Any, None))
        elif f.type == "list":
            rest.append((_attr(f.name), list, dataclasses.field(default_factory=list)))
        elif f.has_default:
            rest.append((_attr(f.name), Any, f.default))
        elif f.required:
            need.append((_attr(f.name), Any))
        else:
            rest.append((_attr(f.name), Any, None))
    own = [] if partial else [("id", str | None, None), ("created_at", Any, None), ("modified_at", Any, None)]
    body = [("content", str | None, None)] if c.content else []
    return dataclasses.make_dataclass(class_name(singular(c.name)) + ("Partial" if partial else ""), [*need, *rest, *own, *body])


class TypedCollection:
    """A collection of a store by its records. What can't be read as a record is left out of lists."""

    def __init__(self, store, name: str):
        self.store, self.c = store, store._collection(name)
        self.type, self.partial = record(store.schema, self.c), record(store.schema, self.c, True)
        self.enums = {f: e for (c, f), e in enums(store.schema).items() if c == name}

    def _in(self, f: Field, v: object) -> object:
        if v is None:
            return [] if f.type == "list" else None
        if f.name in self.enums:
            return self.enums[f.name](v)
        return Ref.of(v) if f.type == "ref" and f.polymorphic else v

    def _out(self, v: object) -> object:
        if isinstance(v, enum.Enum):
            return v.value
        return {"type": v.type, "id": v.id} if isinstance(v, Ref) else v

    def _record(self, d: dict):
        own = {k: d.get(k) for k in ("id", "created_at", "modified_at", *(["content"] if self.c.content else []))}
        missing = [f.name for f in _declared(self.c) if f.required and not f.has_default and d.get(f.name) is None]
        if missing:
            raise ValueError(f"{d.get('id')}: no {', '.join(missing)}")
        return self.type(**{_attr(f.name): self._in(f, d.get(f.name, f.default)) for f in _declared(self.c)}, **own)

    def _data(self, r) -> dict:
        return {f.name: self._out(v) for f in self.c.fields.values() if (v := getattr(r, _attr(f.name), None)) is not None}

    def get(self, ident: str):
        return self._record(self.store.get(self.c.name, ident))

    def list(self, **filters: str) -> list:
        out = []
        for x in self.store.list(self.c.name, **filters).toJSON().collect():
            try:
                out.append(self._record(json.loads(x)))
            except ValueError:
                continue
        return out

    def insert(self, r) -> str:
        return self.store.insert(self.c.name, self._data(r), getattr(r, "content", None))

    def update(self, ident: str, r) -> None:
        self.store.update(self.c.name, ident, self._data(r), getattr(r, "content", None))

    def update_partial(self, ident: str, r) -> None:
        self.store.update_partial(self.c.name, ident, self._data(r), getattr(r, "content", None))

    def delete(self, ident: str) -> dict:
        return self.store.delete(self.c.name, ident)
