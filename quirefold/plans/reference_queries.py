"""Queries of the store's own operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions import paths
from quirefold.operators import integrity, merge, validate
from quirefold.plans import migrate
from quirefold.plans.views import Views
from quirefold.schema import Collection, Field, View, parse_schema
from quirefold.session import table as t
from quirefold.sources import frontmatter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _tables(spark: SparkSession, d: str, *names: str) -> None:
    for n in names:
        t(spark, d, n).createOrReplaceTempView(n)


def _view(name: str, sql: str, *tables: str, oracle: str | None = None) -> None:
    """A view whose text both engines read."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        _tables(spark, d, *tables)
        v = Views(spark)
        v.define(View(name, sql), tables)
        return v.plan(name)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = oracle or sql


# -- views and templates ------------------------------------------------------------------------------------------------------

FEED = "SELECT o.o_orderkey, o.o_orderdate, c.c_name AS author_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' ORDER BY o.o_orderdate DESC, o.o_orderkey LIMIT 100"
_view("view_feed_join", FEED, "orders", "customer")


@query(FEED.replace("LIMIT 100", "LIMIT 200"))
def view_buffer(spark, d):
    """A view of 100 rows with a buffer of 2x keeps 200."""
    _tables(spark, d, "orders", "customer")
    v = Views(spark)
    v.define(View("feed", FEED, buffer=2.0), ["orders", "customer"])
    return v.plan("feed")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 12")
def param_query(spark, d):
    """A template: parameters are cast as declared."""
    _tables(spark, d, "customer")
    v = Views(spark)
    v.define(View("of_segment", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = :seg AND c_nationkey < :below", "query", params={"seg": "string", "below": "number"}), ["customer"])
    return v.query("of_segment", {"seg": "BUILDING", ":below": "12"})


@query("SELECT c_custkey, c_name FROM customer")
def param_missing_is_null(spark, d):
    _tables(spark, d, "customer")
    v = Views(spark)
    v.define(View("q", "SELECT c_custkey, c_name FROM customer WHERE :who IS NULL", "query", params={"who": "string"}), ["customer"])
    return v.query("q")


@query("SELECT * FROM (VALUES ('customer'), ('nation'), ('orders')) AS x(collection)")
def view_dependencies(spark, d):
    """All tables a view reads: in subqueries and set operations too."""
    from quirefold.plans.views import dependencies

    sql = "WITH x AS (SELECT o_custkey FROM orders WHERE ':a' <> 'orders') SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM x) UNION SELECT n_name FROM nation"
    return spark.createDataFrame([(n,) for n in sorted(dependencies(spark, sql, ["customer", "nation", "orders", "part", "x1"]))], "collection string")


# -- envelope, lookups, filters -----------------------------------------------------------------------------------------------


@query("SELECT 'customers' AS collection, CAST(c_custkey AS VARCHAR) AS id, 'customers/' || trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') || '/' || c_custkey || '.md' AS path, to_json({'name': c_name, 'role': c_mktsegment}) AS data_json FROM customer")
def doc_index_envelope(spark, d):
    c = t(spark, d, "customer")
    tpl = paths.PathTemplate("customers/{role}/{id}.md")
    ident = F.col("c_custkey").cast("string")
    return c.select(F.lit("customers").alias("collection"), ident.alias("id"), tpl.render_column({"role": F.col("c_mktsegment")}, ident).alias("path"), F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))).alias("data_json"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_field(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'click'")
def collection_typed_view(spark, d):
    """The collection as a typed view: JSON by the declared struct, filter and columns pushed to the scan."""
    return t(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", F.from_json("props", "k double").getField("k").alias("k"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7")
def get_by_id(spark, d):
    return t(spark, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT collection, id, path FROM documents WHERE collection = 'notes' AND path LIKE 'notes/%'")
def path_lookup(spark, d):
    return t(spark, d, "documents").where((F.col("collection") == "notes") & F.col("path").startswith("notes/")).select("collection", "id", "path")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer ORDER BY id")
def list_sorted(spark, d):
    return t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")).orderBy("id")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7' AND c_mktsegment = 'MACHINERY'")
def list_filter(spark, d):
    return merge.list_filter(t(spark, d, "customer"), {"c_nationkey": "7", "c_mktsegment": "MACHINERY"}).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT collection, id, path, modified_at FROM documents")
def index_entries(spark, d):
    return t(spark, d, "documents").select("collection", "id", "path", "modified_at")


# -- paths --------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'parts/' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '.md' AS path FROM part")
def path_render_slug(spark, d):
    tpl = paths.PathTemplate("parts/{brand}/{name}.md")
    return t(spark, d, "part").select("p_partkey", tpl.render_column({"brand": F.col("p_brand"), "name": F.col("p_name")}).alias("path"))


@query("SELECT o_orderkey, 'orders/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey || '.md' AS path, strftime(o_orderdate, '%Y%m%dT%H%M%S') AS stamp FROM orders")
def path_date_format(spark, d):
    tpl = paths.PathTemplate("orders/{date:YYYY-MM-DD}-{id}.md")
    return t(spark, d, "orders").select("o_orderkey", tpl.render_column({"date": F.col("o_orderdate")}, F.col("o_orderkey").cast("string")).alias("path"), F.date_format("o_orderdate", paths.java_format("YYYYMMDDTHHMMSS")).alias("stamp"))


@query("SELECT doc_id, split_part(path, '/', 2) AS recipient, regexp_extract(path, '/([^/]+)\\.md$', 1) AS id FROM documents WHERE collection = 'messages' AND regexp_full_match(path, 'messages/[^/]+/[^/]+\\.md')")
def path_extract(spark, d):
    tpl = paths.PathTemplate("messages/{recipient}/{id}.md")
    c = tpl.columns(F.col("path"))
    return t(spark, d, "documents").where("collection = 'messages'").select("doc_id", *[x.alias(n) for n, x in c.items()]).where("id IS NOT NULL")


@query("SELECT o_orderkey, CASE WHEN n = 1 THEN stem || '.md' ELSE stem || '-' || n || '.md' END AS path FROM (SELECT o_orderkey, 'c' || (o_custkey % 50) || '/' || strftime(o_orderdate, '%Y-%m-%d') AS stem, row_number() OVER (PARTITION BY o_custkey % 50, strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey) AS n FROM orders)")
def conflict_suffix(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".md")).alias("path"))
    return paths.conflict_suffix(o, "path", ["o_orderkey"])


@query("SELECT doc_id, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem, replace(path, '\\', '/') AS path FROM documents")
def path_normalise(spark, d):
    p = F.translate("path", "\\", "/")
    return t(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]*$", "").alias("stem"), p.alias("path"))


@query("SELECT DISTINCT collection, CASE collection WHEN 'notes' THEN 'note' WHEN 'tasks' THEN 'task' ELSE 'message' END AS singular FROM documents")
def singular_names(spark, d):
    return t(spark, d, "documents").select("collection").distinct().select("collection", paths.singular_column(F.col("collection")).alias("singular"))


@query("SELECT doc_id, CASE WHEN path LIKE 'messages/%' THEN 'messages' WHEN path LIKE 'tasks/done/%' THEN 'done' WHEN path LIKE 'tasks/%' THEN 'tasks' ELSE 'notes' END AS owner FROM documents")
def path_routing(spark, d):
    bases = {"messages": "messages", "tasks": "tasks", "done": "tasks/done", "notes": ""}
    return t(spark, d, "documents").select("doc_id", paths.route_column(F.col("path"), bases).alias("owner"))


# -- defaults, validation -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source FROM documents")
def default_fill(spark, d):
    c = Collection("documents", "d/{id}.md", {"lang": Field("lang", "string", default="und", has_default=True), "source": Field("source", "string", default="unknown", has_default=True)})
    return t(spark, d, "documents").select("doc_id", *[x.alias(n) for n, x in validate.default_columns(c).items()])


_EVENTS = Collection("events", "events/{id}.md", {"event_type": Field("event_type", "string", required=True, enum=["click", "view"]), "value": Field("value", "number")})


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL AND event_type NOT IN ('click', 'view')")
def validate_enum(spark, d):
    return t(spark, d, "events").where(validate.rule_columns(_EVENTS)["event_type_enum"]).select("event_id", "event_type")


@query("SELECT 'documents' AS collection, count(*) AS total, CAST(count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'fr', 'es')) AS BIGINT) AS bad FROM documents UNION ALL SELECT 'events', count(*), CAST(count(*) FILTER (event_type IS NULL OR event_type NOT IN ('click', 'view')) AS BIGINT) FROM events")
def validate_report(spark, d):
    docs = Collection("documents", "d/{id}.md", {"lang": Field("lang", "string", required=True, enum=["en", "de", "fr", "es"])})
    out = None
    for name, c in (("documents", docs), ("events", _EVENTS)):
        bad = F.lit(False)
        for x in validate.rule_columns(c).values():
            bad = bad | x
        one = t(spark, d, name).select(bad.alias("bad")).agg(F.count("*").alias("total"), F.count_if("bad").alias("bad")).select(F.lit(name).alias("collection"), "total", "bad")
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def validate_documents(spark, d):
    """Every document's JSON against the schema in force last: errors of strict collections, warnings of lenient ones."""
    text = t(spark, d, "schema_history").orderBy(F.desc("created_at")).select("schema_yaml").head()
    if text is None:
        return spark.createDataFrame([], "collection string, total long, with_errors long, with_warnings long")
    s = parse_schema(text[0])
    docs = t(spark, d, "documents").select("collection", "id", "data_json")
    out = None
    for n, c in s.collections.items():
        one = validate.report(validate.validate_table(s, c, docs.where(F.col("collection") == n)))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c.name AS collection, coalesce(n, 0) AS n FROM (VALUES ('messages'), ('notes'), ('tasks'), ('clippings')) AS c(name) LEFT JOIN (SELECT collection, count(*) AS n FROM documents GROUP BY 1) d ON d.collection = c.name")
def status_counts(spark, d):
    names = spark.createDataFrame([(n,) for n in ("messages", "notes", "tasks", "clippings")], "collection string")
    return names.join(t(spark, d, "documents").groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


# -- integrity ----------------------------------------------------------------------------------------------------------------


def _shop(orders: str, items: str):
    return parse_schema(f"collections:\n  customers: {{path: 'c/{{id}}.md', fields: {{name: string}}}}\n  orders:\n    path: o/{{id}}.md\n    fields:\n      customer: {{type: ref, target: customers, on_delete: {orders}}}\n  items:\n    path: i/{{id}}.md\n    fields:\n      order: {{type: ref, target: orders, on_delete: {items}}}\n")


def _shop_tables(spark, d) -> dict[str, DataFrame]:
    s = lambda c: F.col(c).cast("string")
    return {
        "customers": t(spark, d, "customer").select(s("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "orders": t(spark, d, "orders").select(s("o_orderkey").alias("id"), s("o_custkey").alias("customer")),
        "items": t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), s("l_orderkey").alias("order")),
    }


def _five(spark):
    return spark.createDataFrame([("customers", "5"), ("customers", "7")], "collection string, id string")


@query("SELECT 'orders' AS collection, 'customer' AS field, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS ref FROM orders WHERE o_custkey IN (5, 7)")
def find_references(spark, d):
    return integrity.find_references(_shop("cascade", "cascade"), _shop_tables(spark, d), _five(spark)).select("collection", "field", "id", "ref")


@query("SELECT count(*) AS n FROM orders WHERE o_custkey IN (5, 7)")
def ri_restrict(spark, d):
    """How many references stand against the deletion."""
    return integrity.find_references(_shop("error", "error"), _shop_tables(spark, d), _five(spark)).agg(F.count("*").alias("n"))


@query("SELECT 'customers' AS collection, id FROM (VALUES ('5'), ('7')) AS x(id) UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey IN (5, 7) UNION ALL SELECT DISTINCT 'items', l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (5, 7))")
def ri_cascade(spark, d):
    return integrity.plan_delete(_shop("cascade", "cascade"), _shop_tables(spark, d), _five(spark)).deleted


@query("SELECT 'orders' AS collection, 'customer' AS field, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey IN (5, 7)")
def ri_nullify(spark, d):
    return integrity.plan_delete(_shop("nullify", "error"), _shop_tables(spark, d), _five(spark)).nullified.select("collection", "field", "id")


@query("SELECT o_orderkey, CASE WHEN o_custkey NOT IN (5, 7) THEN CAST(o_custkey AS VARCHAR) END AS o_custkey FROM orders")
def ri_nullify_table(spark, d):
    gone = spark.createDataFrame([("5",), ("7",)], "id string")
    return integrity.nullify(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey")), "o_custkey", gone)


@query("SELECT DISTINCT 'items' AS collection, l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (5, 7))")
def ri_archive(spark, d):
    return integrity.plan_delete(_shop("cascade", "archive"), _shop_tables(spark, d), _five(spark)).archived


# -- keyed changes, manifests -------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_custkey % 100 = 0")
def upsert_merge(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 10 = 0").withColumn("c_name", F.upper("c_name")).unionByName(c.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("new").alias("c_name")))
    return merge.upsert(c, new, ["c_custkey"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_writer_wins(spark, d):
    return merge.last_writer(t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0")
def delete_rows(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return merge.delete(c, c.where("c_custkey % 7 = 0"), ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'patched' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def partial_merge(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.where("c_custkey % 3 = 0 OR c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "patched").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return merge.partial_merge(c, patch, ["c_custkey"])


_OLD, _NEW = "o_orderkey % 11 <> 0", "o_orderkey % 13 <> 0"


@query(f"SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT o_orderkey AS k, o_totalprice AS m FROM orders WHERE {_OLD}) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS m FROM orders WHERE {_NEW}) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.m <> b.m")
def manifest_diff(spark, d):
    o = t(spark, d, "orders")
    old = o.where(_OLD).select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("m"))
    new = o.where(_NEW).select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 17 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("m"))
    return merge.manifest_diff(old, new, ["path"], "m")


@query("SELECT collection, path, count(*) AS n FROM collection_entries GROUP BY ALL HAVING count(*) > 1")
def contested_ids(spark, d):
    return merge.contested(t(spark, d, "collection_entries"), ["collection", "path"])


@query(None)
def directory_hash(spark, d):
    """Tested against hashlib on a fixture: the hash of hashed buckets of sorted entries."""
    e = t(spark, d, "collection_entries")
    return merge.directory_hash(e, "collection", "path", "mtime_nanos")


@query("SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s")
def debounce_sessions(spark, d):
    return merge.debounce(t(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "6 hours").drop("end")


@query("SELECT collection, id, CAST(epoch_us(modified_at) AS BIGINT) AS micros FROM documents")
def modified_micros(spark, d):
    from quirefold.functions.text import micros_of

    return t(spark, d, "documents").select("collection", "id", micros_of("modified_at").alias("micros"))


# -- migration ----------------------------------------------------------------------------------------------------------------

_CAT = "(VALUES ('users', 'name', 'string'), ('users', 'age', 'string'), ('posts', 'title', 'string')) AS a(c, f, k)"
_CAT2 = "(VALUES ('users', 'name', 'string'), ('users', 'age', 'number'), ('posts', 'body', 'string')) AS b(c, f, k)"


@query(f"SELECT coalesce(a.c, b.c) AS collection, coalesce(a.f, b.f) AS field, CASE WHEN a.c IS NULL THEN 'field_added' WHEN b.c IS NULL THEN 'field_removed' ELSE 'field_type_changed' END AS change FROM {_CAT} FULL JOIN {_CAT2} ON a.c = b.c AND a.f = b.f WHERE a.c IS NULL OR b.c IS NULL OR a.k <> b.k")
def schema_diff(spark, d):
    kind = "collection string, field string, type string"
    old = spark.createDataFrame([("users", "name", "string"), ("users", "age", "string"), ("posts", "title", "string")], kind)
    new = spark.createDataFrame([("users", "name", "string"), ("users", "age", "number"), ("posts", "body", "string")], kind)
    return migrate.catalog_diff(old, new)


@query(None)
def schema_history_diff(spark, d):
    """The declared changes of every schema against the one before, all nine kinds, with their safety."""
    return migrate.history_diff(t(spark, d, "schema_history"))


@query(None)
def migrate_backfill(spark, d):
    """Defaults of added fields where the key is absent; a null stays null."""
    old = parse_schema("collections: {notes: {path: 'n/{id}.md', fields: {title: string}}}")
    new = parse_schema("collections: {notes: {path: 'n/{id}.md', fields: {title: string, pinned: {type: boolean, default: false}, kind: {type: string, default: plain}}}}")
    docs = t(spark, d, "documents").select("doc_id", "collection", "data_json")
    return migrate.backfill(docs, new, migrate.diff(old, new))


# -- SQL that views pass through ----------------------------------------------------------------------------------------------

_view("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey", "customer", "orders")
_view("join_full", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k", "customer", "supplier")
_view("join_right", "SELECT n.n_name, coalesce(s.s_suppkey, -1) AS s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0", "supplier", "nation")
_view("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "customer", "orders")
_view("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IS NOT NULL)", "customer", "orders")
_view("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
_view("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", "nation", "region")
_view("join_range", "SELECT p.p_partkey, b.band FROM part p JOIN (VALUES (0, 10, 'small'), (10, 30, 'middle'), (30, 1000, 'large')) AS b(lo, hi, band) ON p.p_size >= b.lo AND p.p_size < b.hi", "part")
_view("group_having", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) > 12", "orders")
_view("sum_round", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", "lineitem")
_view("distinct_rows", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "customer")
_view("window_rank_lag", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rk, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS before FROM orders", "orders")
_view("window_frame", "SELECT event_id, count(*) OVER w AS n3, round(sum(value) OVER w, 6) AS s3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "events")
_view("window_ntile", "SELECT p_partkey, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS q, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS first_part FROM part", "part")
_view("cube_counts", "SELECT coalesce(c_nationkey, -1) AS nation, coalesce(c_mktsegment, 'all') AS segment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)", "customer")
_view("rollup_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
_view("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
_view("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
_view("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
_view("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "orders")
_view("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000", "customer", "orders")
_view("order_nulls", "SELECT doc_id, lang FROM documents ORDER BY lang ASC NULLS FIRST, doc_id LIMIT 25", "documents")
_view("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10", "customer")
_view("with_clause", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT c.c_name, round(t.total, 2) AS total FROM top t JOIN customer c ON c.c_custkey = t.o_custkey", "orders", "customer")
_view("derived_table", "SELECT x.c_nationkey, max(x.n) AS most FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) x GROUP BY x.c_nationkey", "customer")
_view("scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.04 FROM part)", "part")
_view("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")
_view("string_functions", "SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, CAST(length(p_type) AS BIGINT) AS n, substring(p_name, 2, 5) AS sub, replace(p_name, 'a', '*') AS rep, CAST(instr(p_name, 'e') AS BIGINT) AS pos, trim('  ' || p_brand || ' ') AS tr, p_brand || '/' || p_type AS joined FROM part", "part")
_view("like_any_case", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%econ%' OR p_name ILIKE 'RED%'", "part")
_view("date_functions", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate) AS first, o_orderdate + INTERVAL '1' DAY AS next FROM orders", "orders")
_view("math_functions", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(sqrt(abs(c_acctbal)), 6) AS s, c_custkey % 7 AS m FROM customer", "customer", oracle="SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS s, c_custkey % 7 AS m FROM customer")
_view("conditional_functions", "SELECT doc_id, coalesce(lang, source, '?') AS c, nullif(lang, 'en') AS n, CASE WHEN n_chars > 1000 THEN 'long' WHEN n_chars IS NULL THEN 'none' ELSE 'short' END AS size FROM documents", "documents")
_view("total_and_list", "SELECT c_nationkey, coalesce(sum(c_acctbal) FILTER (WHERE c_acctbal > 9000), 0) AS total, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS neg FROM customer GROUP BY c_nationkey", "customer", oracle="SELECT c_nationkey, coalesce(sum(c_acctbal) FILTER (WHERE c_acctbal > 9000), 0) AS total, CAST(count(*) FILTER (WHERE c_acctbal < 0) AS BIGINT) AS neg FROM customer GROUP BY c_nationkey")
_view("topk_per_group", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) x WHERE n <= 3", "customer")
_view("recent_activity", "SELECT collection, id, modified_at FROM documents ORDER BY modified_at DESC, collection, id LIMIT 50", "documents")


@query("SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey")
def group_concat(spark, d):
    """The customers of a nation are one value, as the function asks for: the result's own row is what bounds it."""
    return t(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), ",").alias("names"))


@query("SELECT event_id, (SELECT max(ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS last_view FROM events a WHERE event_type = 'click'")
def asof_join(spark, d):
    """The latest view at or before each click of a user: one scan of both sides sorted together, no pairs, no task per user."""
    from quirefold.operators.sorted_scan import as_of

    e = t(spark, d, "events").where("event_type IN ('view', 'click')").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", F.col("ts")).alias("viewed"), (F.col("event_type") == "click").alias("ask"))
    return as_of(e, ["user_id"], "ts", "viewed", "last_view").where("ask").select("event_id", "last_view")


@query("SELECT post_id, tag FROM (SELECT id AS post_id, unnest(tags) AS tag FROM posts WHERE tags IS NOT NULL)")
def list_explode(spark, d):
    return t(spark, d, "posts").select(F.col("id").alias("post_id"), F.explode("tags").alias("tag"))


@query("SELECT id, modified_at, coalesce(len(tags), 0) AS n, CAST(to_json(tags) AS VARCHAR) AS tags_json FROM posts WHERE tags IS NOT NULL")
def tags_json(spark, d):
    return t(spark, d, "posts").where("tags IS NOT NULL").select("id", "modified_at", F.size("tags").cast("long").alias("n"), F.to_json("tags").alias("tags_json"))


@query("SELECT id, modified_at, parent.type AS parent_type, parent.id AS parent_id FROM comments WHERE parent.id IS NOT NULL")
def polymorphic_reference(spark, d):
    return t(spark, d, "comments").where("parent.id IS NOT NULL").select("id", "modified_at", F.col("parent.type").alias("parent_type"), F.col("parent.id").alias("parent_id"))


@query("""SELECT doc_id, k, CASE k WHEN 0 THEN '' WHEN 1 THEN 'a: 1' || chr(10) WHEN 2 THEN '' ELSE 'a: 1' || chr(10) || 'b: x' END AS head,
  CASE WHEN regexp_matches(body, '[^ \\t\\r\\n]') THEN CASE k WHEN 0 THEN body WHEN 3 THEN NULL ELSE trim(replace(body, chr(13) || chr(10), chr(10)), chr(10)) END END AS body
  FROM (SELECT doc_id, k, coalesce(text, '') AS body FROM documents, (VALUES (0), (1), (2), (3)) AS v(k))""")
def frontmatter_split(spark, d):
    """Every text as the body of four documents: without fences, with a head, with an empty one, and with a head that never ends."""
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    raw = F.when(F.col("k") == 0, F.col("text")).when(F.col("k") == 1, F.concat(F.lit("\n---\na: 1\n---\n\n"), "text")).when(F.col("k") == 2, F.concat(F.lit("---\n---\n"), "text")).otherwise(F.lit("---\na: 1\nb: x"))
    head, body = frontmatter.head_and_body(raw)
    return docs.select("doc_id", "k", head.alias("head"), body.alias("body"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    from quirefold.streaming.feed import windowed_counts as counts

    return counts(t(spark, d, "events"), "ts", "1 day", ["event_type"], "2 days").drop("end")


@query("SELECT id, modified_at, name, role, email FROM users")
def frontmatter_roundtrip(spark, d):
    """Rows written as documents with front matter, and read back from their texts."""
    @F.pandas_udf(T.StringType())
    def write(name: pd.Series, role: pd.Series, email: pd.Series) -> pd.Series:
        return pd.Series([frontmatter.write({"name": n, "role": r, "email": e}, "body") for n, r, e in zip(name, role, email)])

    u = t(spark, d, "users").select("id", "modified_at", write("name", "role", "email").alias("raw"))
    v = u.select("id", "modified_at", F.from_json(frontmatter.parser("md")("raw").getField("data_json"), "name string, role string, email string").alias("v"))
    return v.select("id", "modified_at", "v.name", "v.role", "v.email")


@query("SELECT doc_id, sha256(content_text) AS hash FROM documents WHERE content_text IS NOT NULL")
def content_hash(spark, d):
    return t(spark, d, "documents").where("content_text IS NOT NULL").select("doc_id", F.sha2("content_text", 256).alias("hash"))


@query("SELECT event_id, event_type AS kind, CASE WHEN event_type = 'click' THEN user_id ELSE -1 END AS user_id, CASE WHEN event_type = 'view' THEN value ELSE -1 END AS value FROM events WHERE event_type IN ('click', 'view')")
def record_variants(spark, d):
    """A discriminated union of JSON records: each variant read with its own fields."""
    e = t(spark, d, "events").select("event_id", F.to_json(F.struct("event_type", "user_id", "value")).alias("data_json"))
    base = T._parse_datatype_string("event_type string")
    got = frontmatter.records(e, "event_type", {"click": T._parse_datatype_string("user_id long"), "view": T._parse_datatype_string("value double")}, base)
    return got["view"].select("event_id", F.col("event_type").alias("kind"), F.lit(-1).cast("long").alias("user_id"), "value").unionByName(got["click"].select("event_id", F.col("event_type").alias("kind"), "user_id", F.lit(-1.0).alias("value")))


@query("SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def feed_last_kinds(spark, d):
    """The last kind of each path of a micro-batch; deletions come last in its order."""
    from quirefold.streaming.feed import last_kinds

    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.lit(0).cast("long").alias("mtime_nanos"))
    return last_kinds(e).select(F.col("path").cast("long").alias("user_id"), "kind")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey = 7 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_field(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return merge.partial_merge(c, spark.createDataFrame([(7, "PATCHED")], "c_custkey long, c_mktsegment string"), ["c_custkey"])


@query("SELECT id, modified_at, CASE WHEN role IS NULL THEN 'member' ELSE role END AS role, name IS NULL OR email IS NULL AS bad_required, role IS NOT NULL AND role NOT IN ('admin', 'member', 'guest') AS bad_enum FROM users")
def validate_and_prepare(spark, d):
    """Defaults first, then the rules, as columns."""
    c = Collection("users", "users/{name}.md", {"name": Field("name", "string", required=True), "email": Field("email", "string", required=True), "role": Field("role", "string", enum=["admin", "member", "guest"], default="member", has_default=True)})
    u = t(spark, d, "users").select("id", "modified_at", "name", "email", F.coalesce("role", F.lit("member")).alias("role"))
    r = validate.rule_columns(c)
    return u.select("id", "modified_at", "role", (r["name_required"] | r["email_required"]).alias("bad_required"), r["role_enum"].alias("bad_enum"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
