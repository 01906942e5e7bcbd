"""Named SQL views over collections: dependencies, parameters, limits, buffers, caches, materialisation."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quirefold.errors import QueryError, ViewNotFound
from quirefold.schema import View
from quirefold.sources import frontmatter, yamlite

#: What a placeholder scan steps over: quoted text, quoted names, comments, casts.
_TOKENS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|(?P<param>:[A-Za-z_]\w*)", re.S)
_LIMIT = re.compile(r"\s+limit\s+(\d+)(?:\s+offset\s+(\d+))?\s*;?\s*$", re.I)
_CAST = {"string": str, "date": str, "datetime": str, "number": float, "boolean": lambda v: v if isinstance(v, bool) else str(v).strip().lower() in ("true", "1")}


def param_names(sql: str) -> list[str]:
    """The named placeholders, each once, in order; none inside quotes or comments."""
    return list(dict.fromkeys(m["param"][1:] for m in _TOKENS.finditer(sql) if m["param"]))


def dependencies(spark: SparkSession, sql: str, known: Iterable[str]) -> set[str]:
    """The known tables that a query reads, anywhere in it, subqueries and set operations included: the relations of the parsed
    plan, less the names it defines itself."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    names = {m.strip("`") for m in re.findall(r"UnresolvedRelation \[`?([^\],`]+)`?", plan)}
    return names & set(known)


def split_limit(sql: str) -> tuple[str, int | None, int]:
    """(the query without its last LIMIT, the limit, the offset)."""
    m = _LIMIT.search(sql)
    return (sql[: m.start()], int(m[1]), int(m[2] or 0)) if m else (sql.rstrip().rstrip(";"), None, 0)


def _listed(rows: Iterable[str]) -> Iterable[str]:
    """JSON rows as the parts of a YAML list."""
    empty = True
    for x in rows:
        empty = False
        yield yamlite.dump([json.loads(x)])
    if empty:
        yield yamlite.dump([])


@dataclass
class Compiled:
    view: View
    collections: set[str]
    params: list[str]
    template: bool
    limit: int | None
    offset: int
    body: str

    @property
    def buffer_limit(self) -> int | None:
        return None if self.limit is None else math.ceil(self.limit * self.view.buffer)


@dataclass
class Views:
    """The views of a schema over the session's tables of the same names."""

    spark: SparkSession
    compiled: dict[str, Compiled] = field(default_factory=dict)
    cached: dict[str, DataFrame] = field(default_factory=dict)
    listeners: dict[int, tuple[str, Callable]] = field(default_factory=dict)
    built: dict[str, int] = field(default_factory=dict)
    stale: set[str] = field(default_factory=set)
    #: Called before anything is planned: whoever keeps the tables brings them up to date.
    before: Callable[[], object] | None = None

    def define(self, v: View, known: Iterable[str]) -> Compiled:
        params = param_names(v.query)
        body, limit, offset = split_limit(v.query)
        try:
            deps = dependencies(self.spark, v.query, known)
        except Exception as e:
            raise QueryError(f"view {v.name}: {str(e).splitlines()[0]}") from e
        c = Compiled(v, deps, params, v.type == "query" or bool(v.params) or bool(params), limit, offset, body)
        self.compiled[v.name] = c
        return c

    def get(self, name: str) -> Compiled:
        if name not in self.compiled:
            raise ViewNotFound(name)
        return self.compiled[name]

    def affected(self, collections: Iterable[str]) -> list[str]:
        changed = set(collections)
        return [n for n, c in self.compiled.items() if not c.template and c.collections & changed]

    def plan(self, name: str) -> DataFrame:
        """A static view's query with its buffered limit."""
        c = self.get(name)
        if self.before:
            self.before()
        df = self.spark.sql(c.body)
        dup = {x for x in df.columns if df.columns.count(x) > 1}
        if dup:
            raise QueryError(f"view {name}: two columns are named {', '.join(sorted(dup))}")
        if c.offset:
            df = df.offset(c.offset)
        return df if c.limit is None else df.limit(c.buffer_limit)

    def rebuild(self, name: str, root: str | None = None) -> DataFrame:
        """Run a static view anew, keep its rows, tell its listeners and write its file if it is materialised."""
        c = self.get(name)
        old = self.cached.pop(name, None)
        if old is not None:
            old.unpersist()
        df = self.plan(name).persist()
        self.cached[name] = df
        self.stale.discard(name)
        self.built[name] = self.built.get(name, 0) + 1
        if root and c.view.materialize:  # row by row: a view without a limit may be long
            rows = (df if c.limit is None else df.limit(c.limit)).toJSON().toLocalIterator()
            frontmatter.write_atomic(os.path.join(root, "views", f"{name}.yaml"), _listed(rows))
        for view, f in list(self.listeners.values()):
            if view == name:
                f(name, df)
        return df

    def read(self, name: str, exact: bool = False, root: str | None = None) -> DataFrame:
        """The rows kept of a static view, as many as its buffer holds; exact: as many as its limit. A template has none. A view
        that changes have made stale is rebuilt first."""
        c = self.get(name)
        if c.template:
            return self.spark.createDataFrame([], "empty string").drop("empty")
        df = self.cached.get(name)
        df = df if df is not None and name not in self.stale else self.rebuild(name, root)
        return df.limit(c.limit) if exact and c.limit is not None else df

    def query(self, name: str, params: dict | None = None) -> DataFrame:
        """A template, live. Parameters are cast as declared, text else; missing ones are null, unknown ones an error."""
        c = self.get(name)
        given = {k.lstrip(":"): v for k, v in (params or {}).items()}
        extra = set(given) - set(c.params)
        if extra:
            raise QueryError(f"{name}: no parameter {', '.join(sorted(extra))}")
        args = {}
        for p in c.params:
            v = given.get(p)
            args[p] = None if v is None else _CAST.get(c.view.params.get(p, "string"), str)(v)
        return self.spark.sql(c.view.query.rstrip().rstrip(";"), args=args)

    def explain(self, name: str) -> dict:
        c = self.get(name)
        return {"name": name, "sql": c.view.query, "collections": sorted(c.collections), "limit": c.limit, "buffer_limit": c.buffer_limit, "is_query_template": c.template, "params": c.params, "plan": None if c.template else self.plan(name)._jdf.queryExecution().toString()}

    def columns(self, name: str) -> list[tuple[str, str]]:
        """(name, type) of a view's columns, as analysed."""
        return self._analysed(name).dtypes

    def _analysed(self, name: str) -> DataFrame:
        c = self.get(name)
        return self.spark.sql(c.view.query.rstrip().rstrip(";"), args=dict.fromkeys(c.params)) if c.params else self.plan(name)

    def sources(self, name: str) -> list[tuple[str, str | None, str | None]]:
        """(column, collection, field) of a view's columns: where a column is a field as it stands, or renamed, its collection and
        name there; null for what is computed. Read off the analysed plan, so through joins, derived tables and WITH as well."""
        plan = self._analysed(name)._jdf.queryExecution().analyzed()
        known = self.get(name).collections
        where: dict[int, tuple[str, str]] = {}
        alias: dict[int, int] = {}
        todo, seq = [plan], lambda x: [x.apply(k) for k in range(x.size())]
        while todo:
            p = todo.pop()
            if p.nodeName() == "SubqueryAlias" and p.alias() in known:
                for a in seq(p.output()):
                    where.setdefault(a.exprId().id(), (p.alias(), a.name()))
                continue
            for e in seq(p.expressions()):
                if e.nodeName() == "Alias" and e.child().nodeName() == "AttributeReference":
                    alias[e.exprId().id()] = e.child().exprId().id()
            todo += seq(p.children())
        out = []
        for a in seq(plan.output()):
            k = a.exprId().id()
            while k not in where and k in alias:
                k = alias[k]
            out.append((a.name(), *where.get(k, (None, None))))
        return out

    def save(self, path: str) -> None:
        """Write the rows of every static view as Parquet below path."""
        for n, c in self.compiled.items():
            if not c.template:
                self.read(n).write.mode("overwrite").parquet(f"{path}/{n}")

    def load(self, path: str) -> list[str]:
        """Keep the rows that save wrote, for views that have none yet; which these are."""
        out = []
        for n, c in self.compiled.items():
            at = f"{path}/{n}"
            if not c.template and n not in self.cached and os.path.exists(os.path.join(at.removeprefix("file://"), "_SUCCESS")):
                self.cached[n] = self.spark.read.parquet(at)
                out.append(n)
        return out

    def subscribe(self, name: str, f: Callable[[str, DataFrame], None]) -> int:
        self.get(name)
        n = max(self.listeners, default=0) + 1
        self.listeners[n] = (name, f)
        return n

    def unsubscribe(self, n: int) -> bool:
        return self.listeners.pop(n, None) is not None
