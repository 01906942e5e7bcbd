"""Queries of the store itself: a directory of documents made of the whole region, nation and supplier tables, opened, changed and
read back through the store's own operations, each with the SQL of what must then be there."""

from __future__ import annotations

import contextlib
import io
import json
import os
import shutil
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold import errors as E
from quirefold import session
from quirefold.functions.paths import slugify
from quirefold.schema import View
from quirefold.session import table as t
from quirefold.sources import frontmatter as fm
from quirefold.sources import yamlite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SCHEMA = """
collections:
  regions:
    path: "regions/{id}.json"
    fields: { key: { type: number, required: true }, name: { type: string, required: true } }
  nations:
    path: "nations/{region}/{id}.md"
    content: true
    fields:
      id: { type: string }
      key: { type: number, required: true }
      name: { type: string, required: true }
      region: { type: ref, target: regions, on_delete: cascade }
      tier: { type: string, enum: [Large Market, Small Market], default: Small Market }
  suppliers:
    path: "suppliers/{id}.md"
    id: { on_conflict: suffix }
    fields:
      id: { type: string }
      key: { type: number, required: true }
      name: { type: string, required: true }
      nation: { type: ref, target: nations, on_delete: nullify }
      balance: { type: number }
  orders: { path: "orders/all.jsonl", fields: { key: number, nation: { type: ref, target: nations, on_delete: archive } } }
  fixed: { path: "fixed/{id}.md", readonly: true, fields: { name: string } }
views:
  by_nation: { query: "SELECT n.key AS nation_key, count(s.id) AS n FROM nations n LEFT JOIN suppliers s ON s.nation = n.id GROUP BY n.key" }
  richest: { query: "SELECT key, balance AS money FROM suppliers ORDER BY balance DESC, key LIMIT 5", materialize: true, buffer: 2x }
  nation_names: { query: "SELECT name FROM nations ORDER BY name", materialize: true }
  of_nation: { type: query, query: "SELECT s.key, s.name FROM suppliers s WHERE s.nation = :nation", params: { nation: string } }
"""


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_NATION = _SLUG.format("n_name")
_REGION = _SLUG.format("r_name")
_N = f"(SELECT n_nationkey AS key, n_name AS name, {_NATION} AS id, {_REGION} AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"
_S = f"(SELECT s_suppkey AS key, s_name AS name, 's' || s_suppkey AS id, {_NATION} AS nation, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which a store needs as a file system of the driver and all executors."""
    at = session.fresh_path(spark, name)
    if "://" in at and not at.startswith("file://"):
        raise E.QuirefoldError(f"a store needs a mounted folder, not {at}")
    session._CUTS.add(at)
    at = at.removeprefix("file://")
    os.makedirs(at)
    return at


def write(root: str, path: str, data: dict, body: str | None = None) -> None:
    fm.write_atomic(f"{root}/{path}", fm.write(data, body, path.rsplit(".", 1)[-1]))


def files(spark: SparkSession, d: str, schema: str = SCHEMA) -> str:
    """The three tables as documents: regions in JSON, nations with a body, suppliers in front matter alone."""
    root = folder(spark, "store")
    with open(f"{root}/schema.yaml", "w", encoding="utf-8") as f:
        f.write(schema)
    regions = {r["r_regionkey"]: slugify(r["r_name"]) for r in t(spark, d, "region").toLocalIterator()}
    nations = {}
    for r in t(spark, d, "region").toLocalIterator():
        write(root, f"regions/{slugify(r['r_name'])}.json", {"key": r["r_regionkey"], "name": r["r_name"]})
    for r in t(spark, d, "nation").toLocalIterator():
        nations[r["n_nationkey"]] = slugify(r["n_name"])
        write(root, f"nations/{regions[r['n_regionkey']]}/{slugify(r['n_name'])}.md", {"key": r["n_nationkey"], "name": r["n_name"], "region": regions[r["n_regionkey"]]}, f"About {r['n_name']}.")
    for r in t(spark, d, "supplier").toLocalIterator():
        write(root, f"suppliers/s{r['s_suppkey']}.md", {"key": r["s_suppkey"], "name": r["s_name"], "nation": nations[r["s_nationkey"]], "balance": r["s_acctbal"]})
    return root


def opened(spark: SparkSession, d: str):
    from quirefold.engine import Store

    return Store(spark, files(spark, d))


def suppliers(s) -> DataFrame:
    return s.collection("suppliers").select("id", F.col("key").cast("long").alias("key"), "name", "nation", "balance")


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- reading ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, key, name, nation, balance FROM {_S}")
def store_full_scan(spark, d):
    return suppliers(opened(spark, d))


@query(f"SELECT 'suppliers/' || id || '.md' AS path, 'md' AS format, true AS has_size FROM {_S} UNION ALL SELECT 'nations/' || region || '/' || id || '.md', 'md', true FROM {_N} UNION ALL SELECT 'regions/' || {_REGION} || '.json', 'json', true FROM region")
def store_listing(spark, d):
    s = opened(spark, d)
    out = None
    for n in ("suppliers", "nations", "regions"):
        one = fm.listing(spark, s.root, s.bases[n], s.templates[n].extension).select("path", F.lit(s.schema.collections[n].format).alias("format"), (F.col("size_bytes") > 0).alias("has_size"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT id, key, name, region, 'Small Market' AS tier, 'About ' || name || '.' AS content FROM {_N}")
def store_documents(spark, d):
    """Every nation as one object: implicit columns, fields over them, its body, and the defaults that its file lacks."""
    from quirefold.operators.validate import with_defaults

    s = opened(spark, d)
    ids = [r["id"] for r in s.list("nations").select("id").collect()]
    s.index.fetch(("nations", i) for i in ids)
    got = [with_defaults(s.schema.collections["nations"], s.get("nations", i)) for i in ids]
    return table(spark, [(g["id"], g["key"], g["name"], g["region"], g["tier"], g["content"]) for g in got], "id string, key long, name string, region string, tier string, content string")


@query(f"SELECT k % 3 AS part, count(*) AS n, sum(k) AS total FROM (SELECT n_nationkey AS k FROM nation) GROUP BY 1")
def store_record_lines(spark, d):
    """A JSONL file of a record a line, read as one document each."""
    root = files(spark, d)
    os.makedirs(f"{root}/orders")
    with open(f"{root}/orders/all.jsonl", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"id": f"o{r['n_nationkey']}", "key": r["n_nationkey"]}) + "\n" for r in t(spark, d, "nation").toLocalIterator())
    from quirefold.engine import Store

    c = Store(spark, root).collection("orders")
    return c.groupBy((F.col("key").cast("long") % 3).alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("key").cast("long")).alias("total"))


@query(f"SELECT id, key, name, nation, CASE WHEN key % 10 = 0 THEN balance + 1 ELSE balance END AS balance FROM {_S} WHERE key % 17 <> 0 UNION ALL SELECT 'x' || key, key, 'new', NULL, NULL FROM {_S} WHERE key % 25 = 0")
def store_incremental_scan(spark, d):
    """Files changed, removed and added by others between two openings."""
    s = opened(spark, d)
    for r in t(spark, d, "supplier").toLocalIterator():
        k, old = r["s_suppkey"], f"{s.root}/suppliers/s{r['s_suppkey']}.md"
        if k % 10 == 0:
            with open(old, encoding="utf-8") as f:
                data, body = fm.read(f.read())
            write(s.root, f"suppliers/s{k}.md", data | {"balance": data["balance"] + 1}, body)
        if k % 17 == 0:
            os.unlink(old)
        if k % 25 == 0:
            write(s.root, f"suppliers/x{k}.md", {"key": k, "name": "new"})
    s.incremental_scan()
    return suppliers(s)


@query(f"SELECT 'suppliers' AS collection, 'suppliers/' || id || '.md' AS path FROM {_S} UNION ALL SELECT 'nations', 'nations/' || region || '/' || id || '.md' FROM {_N} UNION ALL SELECT 'regions', 'regions/' || {_REGION} || '.json' FROM region UNION ALL SELECT 'suppliers', 'suppliers/extra.md'")
def store_manifest(spark, d):
    """The mirror of the listings, after a write that is appended to it."""
    s = opened(spark, d)
    s.insert("suppliers", {"id": "extra", "key": -1, "name": "extra"})
    return table(spark, [(c, p) for c, m in s.manifest().items() for p in m], "collection string, path string")


@query("SELECT id AS version_id, substring(sha256(schema_yaml), 1, 16) AS hash FROM schema_history")
def schema_hashes(spark, d):
    from quirefold.schema import schema_hash

    def run(batches):
        for pdf in batches:
            yield pdf.assign(hash=pdf["schema_yaml"].map(schema_hash))[["version_id", "hash"]]

    return t(spark, d, "schema_history").select(F.col("id").alias("version_id"), "schema_yaml").mapInPandas(run, "version_id long, hash string")


@query(f"SELECT count(*) AS n, min(length(h)) AS size FROM (SELECT DISTINCT hash AS h FROM (SELECT substring(sha256(schema_yaml), 1, 16) AS hash FROM schema_history LIMIT 1))")
def store_catalog(spark, d):
    """One schema recorded, opened twice."""
    from quirefold.engine import Store

    s = opened(spark, d)
    again = Store(spark, s.root)
    return table(spark, [(h["hash"],) for h in again._read_meta("schema_history.json", [])], "h string").agg(F.count("*").alias("n"), F.min(F.length("h")).cast("long").alias("size"))


# -- writing ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, key, name, nation, balance FROM {_S} UNION ALL SELECT 'copy-' || id, key + 100000, name, nation, -balance FROM {_S}")
def store_insert_many(spark, d):
    """A copy of every supplier, as one batch."""
    s = opened(spark, d)
    s.insert_many("suppliers", [{"id": f"copy-{r['id']}", "key": r["key"] + 100000, "name": r["name"], "nation": r["nation"], "balance": -r["balance"]} for r in suppliers(s).toLocalIterator()])
    return suppliers(s)


@query(f"SELECT id, 2 AS n FROM {_S} WHERE key BETWEEN 1 AND 3 UNION ALL SELECT id || '-2', 2 FROM {_S} WHERE key BETWEEN 1 AND 3")
def store_insert_conflicts(spark, d):
    """A path that is taken gets a suffix."""
    s = opened(spark, d)
    for k in (1, 2, 3):
        s.insert("suppliers", {"id": f"s{k}", "key": k, "name": "again"})
    return s.collection("suppliers").where("key BETWEEN 1 AND 3").select("id", F.lit(2).alias("n"))


@query(f"SELECT id, key, upper(name) || '!' AS name, nation, CAST(NULL AS DOUBLE) AS balance FROM {_S} WHERE key % 2 = 0 UNION ALL SELECT id, key, name, nation, balance FROM {_S} WHERE key % 2 = 1")
def store_update_many(spark, d):
    """Whole documents anew: fields that are not given are gone."""
    s = opened(spark, d)
    s.update_many("suppliers", {r["id"]: {"key": r["key"], "name": r["name"].upper() + "!", "nation": r["nation"]} for r in suppliers(s).where("key % 2 = 0").toLocalIterator()})
    return suppliers(s)


@query(f"SELECT id, key, CASE WHEN key % 2 = 0 THEN 'Large Market' END AS tier, 'About ' || name || '.' AS content, region FROM {_N}")
def store_update_partial(spark, d):
    """One field patched; the body stays."""
    s = opened(spark, d)
    with s.batch():
        for r in s.collection("nations").where("key % 2 = 0").select("id").collect():
            s.patch_field("nations", r["id"], "tier", "Large Market")
    return s.collection("nations").select("id", F.col("key").cast("long").alias("key"), "tier", "content", "region")


@query(f"SELECT id, key, 'nations/' || (SELECT min({_REGION}) FROM region) || '/' || id || '.md' AS path, true AS there FROM {_N}")
def store_moves(spark, d):
    """All nations to one region: their files move with the field, and directories that this leaves empty go."""
    s = opened(spark, d)
    to = min(r["id"] for r in s.collection("regions").select("id").collect())
    with s.batch():
        for r in s.collection("nations").select("id").collect():
            s.patch_field("nations", r["id"], "region", to)
    rows = [(r["id"], json.loads(r["data_json"])["key"], r["path"], os.path.exists(f"{s.root}/{r['path']}") and os.listdir(f"{s.root}/nations") == [to]) for r in s.index.df().where("collection = 'nations'").collect()]
    return table(spark, rows, "id string, key long, path string, there boolean")


@query(f"SELECT id, key, name, nation, balance FROM {_S} WHERE key % 5 <> 0")
def store_delete(spark, d):
    s = opened(spark, d)
    with s.batch():
        s.delete_many("suppliers", [r["id"] for r in suppliers(s).where("key % 20 = 0").select("id").toLocalIterator()])
    for r in t(spark, d, "supplier").where("s_suppkey % 5 = 0 AND s_suppkey % 20 <> 0").select("s_suppkey").toLocalIterator():
        os.unlink(f"{s.root}/suppliers/s{r[0]}.md")
    s.incremental_scan()
    return suppliers(s)


@query(f"SELECT 'nations' AS collection, id, CAST(NULL AS VARCHAR) AS nation FROM {_N} n WHERE region <> (SELECT min({_REGION}) FROM region) UNION ALL SELECT 'suppliers', s.id, CASE WHEN n.region <> (SELECT min({_REGION}) FROM region) THEN s.nation END FROM {_S} s JOIN {_N} n ON n.id = s.nation")
def store_delete_policies(spark, d):
    """A region goes: its nations by cascade, and their suppliers' references become null in files and index."""
    s = opened(spark, d)
    s.delete("regions", min(r["id"] for r in s.collection("regions").select("id").collect()))
    n = s.collection("nations").select(F.lit("nations").alias("collection"), "id", F.lit(None).cast("string").alias("nation"))
    return n.unionByName(suppliers(s).select(F.lit("suppliers").alias("collection"), "id", "nation"))


@query(f"SELECT collection, field, on_delete FROM (VALUES ('nations', 'region', 'cascade'), ('suppliers', 'nation', 'nullify'), ('orders', 'nation', 'archive')) AS v(collection, field, on_delete)")
def reference_policies(spark, d):
    from quirefold.operators.integrity import policy, references
    from quirefold.schema import parse_schema

    s = parse_schema(SCHEMA)
    return table(spark, [(c, f, policy(s, c, f)) for c, f, _, _ in references(s)], "collection string, field string, on_delete string")


@query(f"SELECT id, key, name, nation, balance FROM {_S}")
def store_batch_rolls_back(spark, d):
    """A batch whose last operation fails: all suppliers updated, some deleted, none of it counts, in files or index."""
    s = opened(spark, d)
    try:
        with s.batch():
            s.update_many("suppliers", {r["id"]: {"key": 0, "name": "lost"} for r in suppliers(s).select("id").toLocalIterator()})
            s.delete_many("suppliers", [r["id"] for r in suppliers(s).where("key = 0").select("id").toLocalIterator() if r["id"].endswith("7")])
            s.insert("suppliers", {"id": "bad"})
    except E.ValidationFailed:
        pass
    whole = lambda n: s.index.df().select("collection", "id", "path", "data_json", "content_text", F.lit(n).alias("n"))
    index = whole(1)
    s.full_scan()  # the files, each read anew, say the same as the index did
    both = index.unionByName(whole(-1))
    assert both.groupBy(both.columns[:-1]).agg(F.sum("n").alias("n")).where("n <> 0").isEmpty() and not s.unread
    return suppliers(s)


@query("SELECT op, true AS refused FROM (VALUES ('insert'), ('update'), ('delete'), ('second writer'), ('unknown collection'), ('unknown document'), ('unknown view')) AS v(op)")
def store_guards(spark, d):
    from quirefold.engine import Index

    s = opened(spark, d)
    other = Index(spark, s.root)

    def second():
        with s.index.lock(), other.lock(wait=0.05):
            pass

    tries = {
        "insert": (lambda: s.insert("fixed", {"name": "x"}), E.ReadonlyCollection), "update": (lambda: s.update("fixed", "x", {}), E.ReadonlyCollection), "delete": (lambda: s.delete("fixed", "x"), E.ReadonlyCollection), "second writer": (second, E.IndexLocked),
        "unknown collection": (lambda: s.get("none", "x"), E.CollectionNotFound), "unknown document": (lambda: s.get("nations", "none"), E.DocumentNotFound), "unknown view": (lambda: s.view("none"), E.ViewNotFound),
    }
    rows = []
    for op, (f, kind) in tries.items():
        try:
            f()
            rows.append((op, False))
        except kind:
            rows.append((op, True))
    return table(spark, rows, "op string, refused boolean")


@query("SELECT kind, 1000 AS n, size FROM (VALUES ('ulid', 26), ('uuid', 36), ('nanoid', 21)) AS v(kind, size)")
def generated_ids(spark, d):
    from quirefold.engine import new_id

    return table(spark, [(k, i) for k in ("ulid", "uuid", "nanoid") for i in {new_id(k) for _ in range(1000)}], "kind string, i string").groupBy("kind").agg(F.count("*").cast("int").alias("n"), F.max(F.length("i")).alias("size"))


@query(f"SELECT 'suppliers' AS collection, id, 1 AS errors FROM {_S} WHERE key % 3 = 0 UNION ALL SELECT 'nations', id, 2 FROM {_N} WHERE key % 4 = 0")
def store_issues(spark, d):
    """Documents that others broke: a required field is missing, an enum and a type are wrong."""
    s = opened(spark, d)
    for r in suppliers(s).where("key % 3 = 0").collect():
        write(s.root, f"suppliers/{r['id']}.md", {"key": r["key"]})
    for r in s.collection("nations").where("key % 4 = 0").collect():
        write(s.root, f"nations/{r['region']}/{r['id']}.md", {"key": str(r["key"]), "name": r["name"], "region": r["region"], "tier": "huge"})
    s.incremental_scan()
    return s.issues().select("collection", "id", F.size("errors").alias("errors"))


# -- views --------------------------------------------------------------------------------------------------------------------

_BY = f"SELECT n.key AS nation_key, count(s.id) AS n FROM {_N} n LEFT JOIN {_S} s ON s.nation = n.id GROUP BY n.key"
_RICH = f"SELECT key, balance AS money FROM {_S} ORDER BY balance DESC, key LIMIT"


@query(_BY)
def store_view(spark, d):
    return opened(spark, d).view("by_nation").select(F.col("nation_key").cast("long").alias("nation_key"), "n")


@query(f"{_RICH} 10")
def store_view_buffer(spark, d):
    return opened(spark, d).view("richest").select(F.col("key").cast("long").alias("key"), "money")


@query(f"{_RICH} 5")
def store_view_file(spark, d):
    """The materialised file: as many rows as the limit, as YAML."""
    s = opened(spark, d)
    s.flush()
    with open(f"{s.root}/views/richest.yaml", encoding="utf-8") as f:
        return table(spark, [(int(r["key"]), float(r["money"])) for r in yamlite.load(f.read())], "key long, money double")


@query(f"SELECT name FROM {_N} UNION ALL SELECT 'Atlantis'")
def store_view_file_follows(spark, d):
    """A write makes the view stale; the next flush writes its file, a reading of the view would too."""
    s = opened(spark, d)
    s.insert("nations", {"id": "atlantis", "key": 99, "name": "Atlantis", "region": "sea"})
    s.flush()
    with open(f"{s.root}/views/nation_names.yaml", encoding="utf-8") as f:
        return table(spark, [(r["name"],) for r in yamlite.load(f.read())], "name string")


@query(_BY)
def store_view_cache(spark, d):
    """Views saved and loaded by another store, which reads them without building."""
    from quirefold.engine import Store

    s = opened(spark, d)
    at = f"file://{s.root}/_index/views"
    s.views.save(at)
    other = Store(spark, s.root)
    other.views.load(at)
    other.views.stale.discard("by_nation")
    got = other.view("by_nation")
    assert "by_nation" not in other.views.built
    return got.select(F.col("nation_key").cast("long").alias("nation_key"), "n")


@query("SELECT view, built FROM (VALUES ('by_nation', true), ('nation_names', true), ('richest', false)) AS v(view, built)")
def store_affected_views(spark, d):
    """A change of nations concerns the views that read them."""
    s = opened(spark, d)
    for v in ("by_nation", "richest", "nation_names"):
        s.view(v)
    s.patch_field("nations", s.collection("nations").select("id").orderBy("id").head()["id"], "tier", "Large Market")
    return table(spark, [(v, v in s.views.stale) for v in ("by_nation", "nation_names", "richest")], "view string, built boolean")


@query(f"SELECT 'richest' AS view, 'key' AS name, 'suppliers' AS collection, 'key' AS field UNION ALL SELECT 'richest', 'money', 'suppliers', 'balance' UNION ALL SELECT 'by_nation', 'nation_key', 'nations', 'key' UNION ALL SELECT 'by_nation', 'n', NULL, NULL UNION ALL SELECT 'of_nation', 'key', 'suppliers', 'key' UNION ALL SELECT 'of_nation', 'name', 'suppliers', 'name'")
def store_view_columns(spark, d):
    s = opened(spark, d)
    return table(spark, [(v, *x) for v in ("richest", "by_nation", "of_nation") for x in s._fresh().sources(v)], "view string, name string, collection string, field string")


@query("SELECT * FROM (VALUES ('richest', 'suppliers', 5, 10, false, ''), ('by_nation', 'nations,suppliers', NULL, NULL, false, ''), ('of_nation', 'suppliers', NULL, NULL, true, 'nation')) AS v(name, collections, row_limit, buffer_limit, template, params)")
def store_explain(spark, d):
    s = opened(spark, d)
    x = [s.explain(v) for v in ("richest", "by_nation", "of_nation")]
    return table(spark, [(e["name"], ",".join(e["collections"]), e["limit"], e["buffer_limit"], e["is_query_template"], ",".join(e["params"])) for e in x], "name string, collections string, row_limit int, buffer_limit int, template boolean, params string")


@query(f"SELECT key, name FROM {_S} WHERE nation = (SELECT min(id) FROM {_N})")
def store_template(spark, d):
    s = opened(spark, d)
    n = s.collection("nations").agg(F.min("id")).head()[0]
    return s.query("of_nation", {"nation": n}).select(F.col("key").cast("long").alias("key"), "name")


@query("SELECT event, n FROM (VALUES ('nations inserted', 1), ('nations updated', 1), ('nations deleted', 1), ('by_nation', 3)) AS v(event, n)")
def store_subscriptions(spark, d):
    """What listeners of a collection and a view hear of three changes, and none after they have left."""
    s = opened(spark, d)
    heard: list[str] = []
    a = s.on_collection_change("nations", lambda c, i, k: heard.append(f"{c} {k}"))
    b = s.on_view_change("by_nation", lambda n, _: heard.append(n))
    s.insert("nations", {"id": "atlantis", "key": 99, "name": "Atlantis", "region": "sea"})
    s.patch_field("nations", "atlantis", "tier", "Large Market")
    s.delete("nations", "atlantis")
    s.unsubscribe(a), s.unsubscribe(b)
    s.insert("nations", {"id": "atlantis", "key": 99, "name": "Atlantis", "region": "sea"})
    return table(spark, [(h,) for h in heard], "event string").groupBy("event").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT key, name, nation, balance FROM {_S}")
def store_live_push(spark, d):
    """The rows of a view as they are pushed to whoever listens."""
    s = opened(spark, d)
    pushed: list = []
    s.views.define(View("all_suppliers", "SELECT key, name, nation, balance FROM suppliers"), s.schema.collections)
    s.on_view_change("all_suppliers", lambda _, df: pushed.append([tuple(r) for r in df.toLocalIterator()]))
    s.rebuild("suppliers")
    return table(spark, [(int(k), n, x, b) for k, n, x, b in pushed[-1]], "key long, name string, nation string, balance double")


@query(f"SELECT collection, n FROM (SELECT 'suppliers' AS collection, count(*) AS n FROM supplier UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'orders', 0 UNION ALL SELECT 'fixed', 0)")
def store_status(spark, d):
    return table(spark, list(opened(spark, d).status()["collections"].items()), "collection string, n long")


@query(f"SELECT id, key, name, nation, balance FROM {_S}")
def store_rebuild(spark, d):
    """An index that was spoilt, read anew from the files."""
    s = opened(spark, d)
    with s.index.lock():
        s.index.commit([{"collection": "suppliers", "id": r["id"], "gone": True} for r in suppliers(s).where("key % 2 = 0").collect()])
    s.rebuild("suppliers")
    return suppliers(s)


@query(f"SELECT id, key, name, nation, balance FROM {_S}")
def store_export(spark, d):
    s = opened(spark, d)
    at = f"file://{s.root}/_index/export"
    s.export("suppliers", at)
    return spark.read.schema("id string, key double, name string, nation string, balance double").json(at).select("id", F.col("key").cast("long").alias("key"), "name", "nation", "balance")


def _cli(spark: SparkSession, root: str, *args: str) -> str:
    """What the command line prints."""
    from quirefold import cli

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        cli.show(cli.run(["--data-dir", root, *args], spark), "json" if "json" in args else "yaml")
    return out.getvalue()


@query(f"SELECT id, key, name FROM {_S} WHERE nation = (SELECT min(id) FROM {_N})")
def cli_list(spark, d):
    """`list --filter`, printed as YAML and read back."""
    root = files(spark, d)
    n = min(slugify(r[0]) for r in t(spark, d, "nation").select("n_name").toLocalIterator())
    rows = yamlite.load(_cli(spark, root, "list", "suppliers", "--filter", f"nation={n}")) or []
    return table(spark, [(r["id"], int(r["key"]), r["name"]) for r in rows], "id string, key long, name string")


@query("SELECT * FROM (VALUES (7, 'seven', true, 'free text')) AS v(key, name, has_list, body)")
def cli_insert(spark, d):
    """Field values read as YAML and a body from a file, written and printed as JSON."""
    root = files(spark, d, SCHEMA.replace("key: { type: number, required: true }\n      name: { type: string, required: true }\n      region", "key: { type: number, required: true }\n      also: { type: list }\n      name: { type: string, required: true }\n      region"))
    with open(f"{root}/body.txt", "w", encoding="utf-8") as f:
        f.write("free text\n")
    from quirefold import cli

    cli.run(["--data-dir", root, "insert", "nations", "--field", "id=n7", "--field", "key=7", "--field", "name=seven", "--field", "also=[1, 2]", "--field", "region=sea", "--content-file", f"{root}/body.txt"], spark)
    g = json.loads(_cli(spark, root, "--format", "json", "get", "nations", "n7"))
    return table(spark, [(int(g["key"]), g["name"], g["also"] == [1, 2], g["content"].strip())], "key int, name string, has_list boolean, body string")


# -- changes by others --------------------------------------------------------------------------------------------------------


def _touch_all(s, d, change: Callable[[dict], dict | None]) -> list[tuple[str, str]]:
    """Events for every supplier's file, some of which others have changed."""
    out = []
    for r in t(s.spark, d, "supplier").toLocalIterator():
        path = f"suppliers/s{r['s_suppkey']}.md"
        with open(f"{s.root}/{path}", encoding="utf-8") as f:
            data, body = fm.read(f.read())
        new = change(data)
        if new is not None:
            write(s.root, path, new, body)
        out.append((path, "modified"))
    return out


@query(f"SELECT id, 'updated' AS kind FROM {_S} WHERE key % 3 = 0")
def echo_suppression(spark, d):
    """Events for every file, after the store has written them all itself and others a third of them since: what is told is theirs."""
    s = opened(spark, d)
    s.update_many("suppliers", {r["id"]: {"key": r["key"], "name": r["name"], "balance": 1.0} for r in suppliers(s).collect()})
    s.echoes.ttl = 0.0  # long ago: the index itself tells
    told = s.apply_events(_touch_all(s, d, lambda x: x | {"balance": 2.0} if x["key"] % 3 == 0 else None))
    return table(spark, [(i, k) for _, i, k in told], "id string, kind string")


@query(f"SELECT id, key FROM {_N}")
def stale_remove_guard(spark, d):
    """Every nation has moved; the removals of the old paths come late and take no row."""
    s = opened(spark, d)
    old = [r["path"] for r in s.index.df().where("collection = 'nations'").select("path").collect()]
    with s.batch():
        for r in s.collection("nations").select("id").collect():
            s.patch_field("nations", r["id"], "region", "elsewhere")
    s.apply_events([(p, "deleted") for p in old])
    return s.collection("nations").select("id", F.col("key").cast("long").alias("key"))


@query(f"SELECT CASE key % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'updated' ELSE 'deleted' END AS kind, id FROM {_S} WHERE key % 4 <> 3")
def event_outcomes(spark, d):
    """One batch of events: files that can't be read or break the rules are reported and leave their rows, others are taken,
    removed ones go, and vanished ones are no event."""
    s = opened(spark, d)
    events = _touch_all(s, d, lambda x: {0: {"key": "none"}, 1: x | {"balance": 0.5}}.get(x["key"] % 4))
    for p, _ in list(events):
        k = int(p[len("suppliers/s") : -3])
        if k % 4 == 2:
            os.unlink(f"{s.root}/{p}")
            events = [(q, "deleted" if q == p else kind) for q, kind in events]
    events += [(f"suppliers/ghost{k}.md", "created") for k in range(5)]
    told = s.apply_events(events)
    rows = [("error" if k.startswith("error") else k, i.removeprefix("suppliers/").removesuffix(".md")) for _, i, k in told]
    kinds = [k for k, _ in rows]
    assert "updated" not in kinds[kinds.index("deleted") :] if "deleted" in kinds else True  # changes before removals
    return table(spark, rows, "kind string, id string")


@query(f"SELECT id, key, 'new-region' AS region, 'About ' || name || '.' AS content FROM {_N}")
def event_reconcile(spark, d):
    """Others move every nation's file to another directory: the field follows the path, the body stays, one row each."""
    s = opened(spark, d)
    events = []
    for r in s.index.df().where("collection = 'nations'").select("path").collect():
        new = f"nations/new-region/{r['path'].rsplit('/', 1)[-1]}"
        os.makedirs(f"{s.root}/nations/new-region", exist_ok=True)
        shutil.move(f"{s.root}/{r['path']}", f"{s.root}/{new}")
        events += [(r["path"], "deleted"), (new, "created")]
    s.apply_events(events)
    with open(f"{s.root}/{new}", encoding="utf-8") as f:
        assert fm.read(f.read())[0]["region"] == "new-region"
    return s.collection("nations").select("id", F.col("key").cast("long").alias("key"), "region", "content")


@query(f"SELECT id, key, name, nation, CASE WHEN key % 2 = 0 THEN 0.25 ELSE balance END AS balance FROM {_S} WHERE key % 9 <> 0")
def store_watch(spark, d):
    """The stream keeps the index up with what others do before its first listing and after."""
    s = opened(spark, d)
    _touch_all(s, d, lambda x: x | {"balance": 0.25} if x["key"] % 2 == 0 else None)
    gone = [f"{s.root}/suppliers/s{r[0]}.md" for r in t(spark, d, "supplier").where("s_suppkey % 9 = 0").select("s_suppkey").toLocalIterator()]
    q = s.watch(interval="100 milliseconds")
    try:
        for p in gone:
            os.unlink(p)
        for _ in range(2):  # a listing may be under way while the files go; the one after it sees them all
            q.processAllAvailable()
    finally:
        q.stop()
    return suppliers(s)


# -- schemas ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, key, 'unrated' AS rating FROM {_S}")
def store_migrates(spark, d):
    """A field with a default is added to the schema: opening writes it into every file."""
    from quirefold.engine import Store

    s = opened(spark, d)
    with open(f"{s.root}/schema.yaml", "w", encoding="utf-8") as f:
        f.write(SCHEMA.replace("balance: { type: number }", "balance: { type: number }\n      rating: { type: string, default: unrated }"))
    before = Store(spark, s.root).status()
    shutil.rmtree(f"{s.root}/_index")  # the files alone say so
    again = Store(spark, s.root)
    assert before == again.status()
    return again.collection("suppliers").select("id", F.col("key").cast("long").alias("key"), "rating")


@query("""SELECT * FROM (VALUES ('collection_added', 'ports', '', true), ('collection_removed', 'fixed', '', false), ('field_added', 'nations', 'size', true), ('field_added', 'suppliers', 'must', false), ('field_removed', 'suppliers', 'balance', false),
  ('field_type_changed', 'suppliers', 'name', false), ('enum_value_added', 'nations', 'tier', true), ('enum_value_removed', 'nations', 'tier', false), ('default_changed', 'nations', 'tier', true), ('path_template_changed', 'regions', '', false)) AS v(kind, collection, field, safe)""")
def schema_change_kinds(spark, d):
    """Every kind of change between two schemas, with its safety."""
    from quirefold.plans.migrate import diff
    from quirefold.schema import parse_schema

    new = SCHEMA
    for a, b in (
        ("fixed: { path", "ports: { path"), ("default: Small Market }", "default: Tiny Market }\n      size: { type: number }"), ("[Large Market, Small Market]", "[Large Market, Tiny Market]"), ("balance: { type: number }", "must: { type: string, required: true }"),
        ("name: { type: string, required: true }\n      nation", "name: { type: number, required: true }\n      nation"), ("regions/{id}.json", "areas/{id}.json"),
    ):
        assert a in new
        new = new.replace(a, b)
    return table(spark, [(c.kind, c.collection, c.field, c.safe) for c in diff(parse_schema(SCHEMA), parse_schema(new))], "kind string, collection string, field string, safe boolean")


@query("SELECT 'field_added suppliers.rating: None -> string' AS description, true AS safe, true AS untouched")
def migration_dry_run(spark, d):
    s = opened(spark, d)
    with open(f"{s.root}/schema.yaml", "w", encoding="utf-8") as f:
        f.write(SCHEMA.replace("balance: { type: number }", "balance: { type: number }\n      rating: { type: string, default: unrated }"))
    before = {p: m for x in s.manifest().values() for p, m in x.items()}
    from quirefold import cli

    got = cli.run(["--data-dir", s.root, "migrate", "--dry-run"], spark)["pending"]
    same = all(os.stat(f"{s.root}/{p}").st_mtime_ns == m for p, m in before.items())
    return table(spark, [(g["description"], g["safe"], same) for g in got], "description string, safe boolean, untouched boolean")


@query(f"SELECT id, key, true AS timed FROM {_S}")
def index_upgrade(spark, d):
    """A snapshot of an older layout, without times in nanoseconds, gets them when it is opened."""
    from quirefold.engine import Store

    s = opened(spark, d)
    at = os.path.join(s.index.dir, f"v{s.index.version}")
    spark.read.parquet(at).drop("mtime_nanos").write.partitionBy("collection").parquet(f"file://{at}-old")
    shutil.rmtree(at)
    os.rename(f"{at}-old", at)
    p = os.path.join(s.index.dir, "CURRENT.json")
    with open(p, encoding="utf-8") as f:
        pointer = json.load(f)
    pointer.pop("layout")
    fm.write_atomic(p, json.dumps(pointer))
    rows = Store(spark, s.root).index.df().where("collection = 'suppliers'")
    return rows.select("id", F.get_json_object("data_json", "$.key").cast("long").alias("key"), F.col("mtime_nanos").isNotNull().alias("timed"))


@query("SELECT * FROM (VALUES ('users/{name}.md', 'users', 'name', 'md'), ('a/b/{kind}/{date:YYYY-MM-DD}-{title}.json', 'a/b', 'date,kind,title', 'json'), ('{id}.md', '', 'id', 'md'), ('x/{parent.type}/{id}.md', 'x', 'id,parent', 'md')) AS v(template, base, fields, extension)")
def template_parts(spark, d):
    """Templates taken apart: base directory, the fields they refer to, extension."""
    from quirefold.functions.paths import PathTemplate

    rows = [(x, (p := PathTemplate(x)).base, ",".join(sorted(f.split(".")[0] for f in p.fields)), p.extension) for x in ("users/{name}.md", "a/b/{kind}/{date:YYYY-MM-DD}-{title}.json", "{id}.md", "x/{parent.type}/{id}.md")]
    return table(spark, rows, "template string, base string, fields string, extension string")


@query("SELECT given, refused FROM (VALUES ('a/{b.md', true), ('a/{}.md', true), ('a/{b}.md', false)) AS v(given, refused)")
def template_errors(spark, d):
    from quirefold.functions.paths import PathTemplate

    rows = []
    for x in ("a/{b.md", "a/{}.md", "a/{b}.md"):
        try:
            PathTemplate(x)
            rows.append((x, False))
        except E.QuirefoldError:
            rows.append((x, True))
    return table(spark, rows, "given string, refused boolean")


@query("SELECT * FROM (VALUES ('n=7', 'n', '7'), ('b=true', 'b', 'true'), ('l=[1, x]', 'l', '[1, \"x\"]'), ('s=plain text', 's', '\"plain text\"'), ('o={a: 1}', 'o', '{\"a\": 1}'), ('e=', 'e', 'null')) AS v(given, key, as_json)")
def cli_values(spark, d):
    from quirefold.cli import fields_of

    rows = [(g, *next(iter((k, json.dumps(v)) for k, v in fields_of([g]).items()))) for g in ("n=7", "b=true", "l=[1, x]", "s=plain text", "o={a: 1}", "e=")]
    return table(spark, rows, "given string, key string, as_json string")


@query(f"SELECT 'Nation' AS type, id, name, 'SMALL_MARKET' AS tier FROM {_N}")
def typed_records(spark, d):
    """Records and enums made from the schema, read, written and read again."""
    s = opened(spark, d)
    c = s.typed("nations")
    with s.batch():
        for r in s.collection("nations").select("id").collect():
            c.update_partial(r["id"], c.partial(tier=next(iter(x for x in c.enums["tier"] if x.value == "Small Market"))))
    return table(spark, [(type(x).__name__, x.id, x.name, x.tier.name) for x in c.list()], "type string, id string, name string, tier string")


@query("SELECT * FROM (VALUES ('nation_key', 'double'), ('n', 'bigint')) AS v(name, type)")
def view_row_types(spark, d):
    return table(spark, opened(spark, d)._fresh().columns("by_nation"), "name string, type string")


@query("SELECT field, type FROM (VALUES ('id', 'string'), ('key', 'double'), ('name', 'string'), ('nation', 'string'), ('balance', 'double')) AS v(field, type)")
def declared_types(spark, d):
    """The Spark types of a collection, from its schema alone."""
    return table(spark, [x for x in opened(spark, d).collection("suppliers").dtypes if x[0] not in ("created_at", "modified_at")], "field string, type string")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

