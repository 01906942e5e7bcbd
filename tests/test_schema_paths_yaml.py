import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold import errors as E
from quirefold.functions import paths as P
from quirefold.functions.text import place_of
from quirefold.operators.validate import validate, with_defaults
from quirefold.plans.migrate import check, diff
from quirefold.schema import parse_schema, struct_of
from quirefold.sources import frontmatter as fm
from quirefold.sources import yamlite

SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-(10**9), 10**9), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(blacklist_categories=("Cs", "Cc")), max_size=20))


@given(st.recursive(SCALARS, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(whitelist_categories=("L", "N")), min_size=1, max_size=8), x, max_size=4), max_leaves=12))
def test_yaml_round_trip(v):
    got = yamlite.load(yamlite.dump(v))
    assert got == v and json.dumps(got) == json.dumps(v)


def test_yaml_core_types():
    v = yamlite.load("date: 2026-02-13\nyes: yes\nn: 012\nt: 12:30:00\nf: 1e3\nb: true\nz: ~\nq: 'it''s'\nl: [a, \"b, c\", {x: 1}]\nt2: |\n  one\n   two\nfold: >-\n  a\n  b\nd: &q {z: 1}\ne: *q\n")
    assert v == {"date": "2026-02-13", "yes": "yes", "n": 12, "t": "12:30:00", "f": 1000.0, "b": True, "z": None, "q": "it's", "l": ["a", "b, c", {"x": 1}], "t2": "one\n two\n", "fold": "a b", "d": {"z": 1}, "e": {"z": 1}}
    for bad in ('a: "x', "a: [1, 2", "a: b: c", "a: 1\n  b: 2", "- a\nb: 1", "a: *no"):
        with pytest.raises(yamlite.YamlError):
            yamlite.load(bad)
    assert yamlite.load("") is None


@pytest.mark.parametrize(
    "raw,head,body",
    [("no fence", "", "no fence"), ("---\na: 1\n", "a: 1\n", None), ("---\na: 1\n---\n\n  \n", "a: 1\n", None), ("\n---\na: 1\n---\n\nbody\n", "a: 1\n", "body"), ("---\n---\nx", "", "x"), ("", "", None), ("---\na: '---'\n---\nb\n---\nc", "a: '---'\n", "b\n---\nc")],
)
def test_front_matter(raw, head, body, spark):
    assert fm.split(raw) == (head, body)
    if raw:
        h, b = fm.head_and_body(F.col("raw"))
        r = spark.createDataFrame([(raw,)], "raw string").select(h.alias("h"), b.alias("b")).head()
        assert (r["h"] or "").strip() == head.strip() and (r["b"] or "").strip() == (body or "").strip()


def test_front_matter_round_trip(tmp_path):
    for fmt in ("md", "json"):
        assert fm.read(fm.write({"a": "x: y", "l": [1, "2"]}, "body\n\nmore", fmt), fmt) == ({"a": "x: y", "l": [1, "2"]}, "body\n\nmore")
    p = tmp_path / "a" / "b" / "c.md"
    fm.write_atomic(str(p), "x")
    fm.remove(str(p), str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(E.FrontMatterError):
        fm.read('---\nname: "Alice\nemail: a\n---\n')


BASE = "collections:\n  users: {path: 'u/{name}.md', fields: {name: {type: string, required: true}, role: {type: string, enum: [a, b], default: a}, n: number, ok: boolean, day: date, tags: {type: list, items: string}, o: object, home: address, boss: {type: ref, target: users}, any: {type: ref, target: [users]}}}\ntypes:\n  address: {street: {type: string, required: true}, city: string}\n"


@pytest.mark.parametrize(
    "bad",
    [
        "collections: {a: {path: ''}}", "collections: {a: {path: x, fields: {r: {type: ref}}}}", "collections: {a: {path: x, fields: {r: {type: ref, target: b}}}}",
        "collections: {a: {path: x, fields: {r: {type: list, items: {type: ref, target: b}}}}}", "collections: {a: {path: x, fields: {r: nothing}}}", "collections: {a: {path: x, fields: {r: {type: number, enum: [a]}}}}",
        "collections: {a: {path: x, fields: {r: {type: string, on_delete: cascade}}}}", "views: {v: {query: ''}}", "views: {v: {query: select 1, type: query}}", "views: {v: {query: select 1, buffer: 2}}", "- a", "a: [",
    ],
)
def test_schema_errors(bad):
    with pytest.raises(E.SchemaError):
        parse_schema(bad)


def test_struct_and_validation():
    s = parse_schema(BASE)
    c = s.collections["users"]
    t = struct_of(s, c)
    assert t.simpleString() == "struct<name:string,role:string,n:double,ok:boolean,day:string,tags:array<string>,o:string,home:struct<street:string,city:string>,boss:string,any:struct<type:string,id:string>>"
    assert not t["name"].nullable and not t["role"].nullable and t["n"].nullable
    assert validate(s, c, with_defaults(c, {"name": "x"})) == ([], [])
    errors, _ = validate(s, c, {"role": "z", "n": True, "ok": 1, "day": 2, "tags": "x", "o": [], "home": {"city": "c"}, "boss": {"id": "x"}, "any": {"id": "x"}, "more": 1})
    assert len(errors) == 10 and any("home.street" in e for e in errors)
    c.strict = False
    assert validate(s, c, {}) == ([], ["name: required"]) and validate(s, c, [])[0]


def test_migration_kinds():
    a = parse_schema("collections: {x: {path: 'p/{id}', fields: {k: string, e: {type: string, enum: [a, b]}, gone: string, d: {type: string, default: q}}}, old: {path: o}}")
    b = parse_schema("collections: {x: {path: 'q/{id}', fields: {k: number, e: {type: string, enum: [b, c]}, need: {type: string, required: true}, opt: string, d: string}}, new: {path: n}}")
    got = {(c.kind, c.field): c.safe for c in diff(a, b)}
    assert got == {("collection_added", ""): True, ("collection_removed", ""): False, ("field_added", "need"): False, ("field_added", "opt"): True, ("field_removed", "gone"): False, ("field_type_changed", "k"): False, ("enum_value_added", "e"): True, ("enum_value_removed", "e"): False, ("default_changed", "d"): True, ("path_template_changed", ""): False}
    with pytest.raises(E.MigrationFailed):
        check(diff(a, b), b)
    assert diff(a, a) == []


def test_paths():
    t = P.PathTemplate("posts/{status}/{date:YYYY-MM-DD}-{title}.md")
    assert t.render({"status": "In Review", "date": "2026-02-13T10:00:00Z", "title": "Äpfel & Öl!"}) == "posts/in-review/2026-02-13-apfel-ol.md"
    assert t.extract("posts/draft/2026-02-13-a-b.md") == {"status": "draft", "date": "2026-02-13", "title": "a-b"}
    assert t.extract("posts/draft/2026-02-13-a-b.txt") is None and t.extract("posts/x.md") is None
    assert t.fields == {"status", "date", "title"} and t.base == "posts" and t.extension == "md"
    n = P.PathTemplate("comments/{parent:type}/{parent:id}/{id}.md")
    assert n.render({"parent": {"type": "posts", "id": "P 1"}}, "01ab") == "comments/posts/p-1/01ab.md" and n.extract("comments/posts/p/1.md") == {"id": "1"}
    for bad in ("a/{x", "a/{}"):
        with pytest.raises(E.PathTemplateError):
            P.PathTemplate(bad)
    for data in ({}, {"status": [1], "date": "x", "title": "y"}):
        with pytest.raises(E.PathTemplateError):
            t.render(data)
    assert P.format_date("2026-02-13T04:05:06", "YYYYMMDDTHHMMSS") == "20260213T040506" and P.format_date("soon", "YYYY") == "soon"
    assert [P.PathTemplate(x).missplittable(a) for x, a in (("tasks/{id}-{title}.md", "uuid"), ("tasks/{id}-{title}.md", "ulid"), ("tasks/{id}x{title}.md", "ulid"), ("notes/{title}-{id}.md", "ulid"), ("posts/{status}/{date:YYYY-MM-DD}-{title}.md", None))] == [True, False, True, True, False]
    taken = {"a/x.md", "a/x-2.md"}
    assert P.unused_path("a/x.md", taken.__contains__) == "a/x-3.md"
    assert P.route("posts\\x.md", {"a": "", "posts": "posts"}) == "posts" and P.route("q.md", {"posts": "posts"}) is None
    assert [P.singular(x) for x in ("stories", "boxes", "classes", "shelves", "cats", "glass", "houses")] == ["story", "box", "class", "shelf", "cat", "glass", "hous"]


@given(st.text(max_size=30))
def test_slug_is_stable(s):
    x = P.slugify(s)
    assert P.slugify(x) == x and not x.startswith("-") and not x.endswith("-")


@pytest.mark.parametrize(
    "a,b",
    [("a/b.md", "a/b.md"), ("a\\b.md", "a/b.md"), ("./a//b.md", "a/b.md"), ("a/./b.md", "a/b.md"), ("a/tmp/../b.md", "a/b.md"), ("café.md", "café.md"), ("../a", "../a"), ("a/..", ""), ("/../a", "/a"), ("/a/", "/a"), ("", ""), ("a/b/", "a/b"), ("A/b", "A/b")],
)
def test_places(a, b):
    assert place_of(a) == b
