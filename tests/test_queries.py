"""Every query against its SQL on the smallest tables, and the four of the store's that have none against plain Python."""

import contextlib
import hashlib
import json
import math
import os
from datetime import datetime

import duckdb
import pytest

from quirefold.engine import Index, Store
from quirefold.errors import DocumentNotFound
from quirefold.operators import merge
from quirefold.plans import general_queries, migrate, reference_queries, store_queries
from quirefold.schema import parse_schema

D = "/root/testdata/sf0.001"
QUERIES = reference_queries.queries() | store_queries.queries() | general_queries.queries()
SQL = reference_queries.oracle_sql() | store_queries.oracle_sql() | general_queries.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    key = lambda r: repr(r)
    assert sorted((tuple(map(value, r)) for r in df.select(*cols).collect()), key=key) == sorted((tuple(map(value, r)) for r in want), key=key)


def test_directory_hash_is_that_of_its_buckets(spark):
    rows = [("a", f"f{k}.md", k * 7) for k in range(30)] + [("b", "x.md", 1)]
    df = spark.createDataFrame(rows, "g string, p string, m long")
    bucket = {(r["g"], r["p"]): r["b"] for r in df.selectExpr("g", "p", "pmod(xxhash64(p), 4) AS b").collect()}
    for g in "ab":
        per = {}
        for x, p, m in rows:
            if x == g:
                per.setdefault(bucket[g, p], []).append(f"{p}\0{m}")
        text = "\n".join(f"{b}:{hashlib.sha256(chr(10).join(sorted(e)).encode()).hexdigest()}" for b, e in sorted(per.items()))
        got = merge.directory_hash(df.where(f"g = '{g}'"), "g", "p", "m", buckets=4).head()
        assert got["hash"] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_backfill(spark):
    old, new = parse_schema("collections: {n: {path: x, fields: {t: string}}}"), parse_schema("collections: {n: {path: x, fields: {t: string, k: {type: string, default: d}, o: number}}}")
    df = spark.createDataFrame([("n", '{"t": 1}'), ("n", '{"k": null}'), ("n", "oops"), ("n", None), ("m", "{}"), (None, "{}")], "collection string, data_json string")
    got = [r["data_json"] for r in migrate.backfill(df, new, migrate.diff(old, new)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ['{"k": "d", "t": 1}', '{"k": null}', "oops", None, "{}", "{}"]))
    assert migrate.backfill(df, new, []) is df


@pytest.mark.parametrize("name", ["store_batch_rolls_back", "store_delete"])
def test_a_batch_looks_its_documents_up_at_once(spark, monkeypatch, name):
    """No document of a batch costs a scan of its own."""
    alone, get = [], Index.get
    monkeypatch.setattr(Index, "get", lambda self, c, i: alone.append(i) if (c, i) not in self.log and (c, i) not in self.seen else get(self, c, i))
    with contextlib.suppress(DocumentNotFound):
        QUERIES[name](spark, D)
    assert alone == []


def test_an_index_that_is_not_rolled_back_is_found(spark, monkeypatch):
    """The scan that follows does not cover up what the index held, and the batch deletes too."""
    gone, stage = [], Store._stage
    monkeypatch.setattr(Store, "_stage", lambda self, row: (gone.append(row["id"]) if row["gone"] else None, stage(self, row)))
    QUERIES["store_batch_rolls_back"](spark, D)
    assert gone
    monkeypatch.setattr(Index, "log", Index.log.setter(lambda self, log: None))
    with pytest.raises(AssertionError):
        QUERIES["store_batch_rolls_back"](spark, D)


def test_store_queries_without_sql(spark):
    h = QUERIES["schema_history_diff"](spark, D).collect()
    assert {"field_added", "field_removed", "field_type_changed"} <= {r["kind"] for r in h}
    v = QUERIES["validate_documents"](spark, D).collect()
    assert sum(r["total"] for r in v) == duckdb.connect().execute(f"SELECT count(*) FROM '{D}/documents.parquet'").fetchall()[0][0]
    for r in QUERIES["migrate_backfill"](spark, D).where("collection = 'notes' AND data_json LIKE '{\"%'").collect():
        try:
            assert {"pinned", "kind"} <= json.loads(r["data_json"]).keys()
        except ValueError:
            pass
