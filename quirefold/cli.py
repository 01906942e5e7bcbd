"""The command line: python -m quirefold.cli --data-dir DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from quirefold.errors import QuirefoldError
from quirefold.session import local_session
from quirefold.sources import yamlite


def fields_of(pairs: list[str]) -> dict:
    """k=v pairs, values read as YAML."""
    out = {}
    for p in pairs:
        k, eq, v = p.partition("=")
        if not eq:
            raise QuirefoldError(f"expected key=value, not {p!r}")
        out[k] = yamlite.load(v)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirefold")
    p.add_argument("--data-dir", default=".")
    p.add_argument("--format", choices=["yaml", "json"], default="yaml")
    sub = p.add_subparsers(dest="command", required=True)

    def cmd(name: str, *args: str, **flags) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    cmd("get", "collection", "id")
    cmd("list", "collection").add_argument("--filter", action="append", default=[])
    for name, args in (("insert", ["collection"]), ("update", ["collection", "id"])):
        c = cmd(name, *args)
        c.add_argument("--field", action="append", default=[])
        c.add_argument("--content-file")
        c.add_argument("--content-stdin", action="store_true")
    cmd("delete", "collection", "id").add_argument("--dry-run", action="store_true")
    cmd("view", "name")
    cmd("query", "name").add_argument("--param", action="append", default=[])
    cmd("validate")
    cmd("status")
    sub.add_parser("rebuild").add_argument("collection", nargs="?")
    cmd("migrate").add_argument("--dry-run", action="store_true")
    cmd("export", "collection")
    cmd("explain", "name")
    return p


def _rows(df) -> list:
    return [json.loads(x) for x in df.toJSON().collect()]


def _body(a) -> str | None:
    if a.content_stdin:
        return sys.stdin.read()
    if a.content_file:
        with open(a.content_file, encoding="utf-8") as f:
            return f.read()
    return None


def run(argv: list[str], spark=None) -> object:
    from quirefold.engine import Store, pending_migrations

    a = parser().parse_args(argv)
    if a.command == "migrate" and a.dry_run:  # opening the store would migrate it
        return {"warnings": [], "pending": pending_migrations(a.data_dir)}
    s = Store(spark or local_session("2", 2), a.data_dir)
    text = lambda pairs: dict(x.partition("=")[::2] for x in pairs)
    match a.command:
        case "get":
            return s.get(a.collection, a.id)
        case "list":
            return _rows(s.list(a.collection, **text(a.filter)))
        case "insert":
            ident = s.insert(a.collection, fields_of(a.field), _body(a))
            s.flush()
            return {"id": ident}
        case "update":
            s.update_partial(a.collection, a.id, fields_of(a.field), _body(a))
            s.flush()
            return {"id": a.id}
        case "delete":
            told = s.delete(a.collection, a.id, a.dry_run)
            s.flush()
            return {k: [list(x) for x in v] for k, v in told.items()}
        case "view":
            return _rows(s.view(a.name))
        case "query":
            return _rows(s.query(a.name, text(a.param)))
        case "validate":
            return s.validate_all()
        case "status":
            return s.status()
        case "rebuild":
            s.rebuild(a.collection)
            return s.status()
        case "migrate":
            return {"warnings": s.warnings, "pending": s.migrations()}
        case "export":
            return _rows(s.list(a.collection))
        case "explain":
            return {k: v for k, v in s.explain(a.name).items() if k != "plan"}


def show(out: object, fmt: str) -> None:
    """Print a result as YAML or JSON."""
    plain = json.loads(json.dumps(out, default=str))
    print(json.dumps(plain, indent=2, ensure_ascii=False) if fmt == "json" else yamlite.dump(plain), end="\n" if fmt == "json" else "")


def main() -> int:
    args = sys.argv[1:]
    try:
        out = run(args)
    except QuirefoldError as e:
        print(f"ERROR:{e}", file=sys.stderr)
        return 1
    show(out, parser().parse_args(args).format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
