"""The general operators against brute force, on small tables with nulls, repeats, ties, loops and skew."""

import json
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from quirefold.functions.canon import canon, parse_object
from quirefold.operators import consolidate, forest, integrity, intervals, matrixdiff, merge, orphans, runmerge, schemadrift
from quirefold.operators.keyfilter import key_filter
from quirefold.schema import parse_schema

T0 = datetime(2024, 5, 1)
at = lambda h: T0 + timedelta(hours=h)
U = "id string, created_at timestamp_ntz, modified_at timestamp_ntz, ingested_at timestamp_ntz"
TS = "created_at timestamp_ntz, modified_at timestamp_ntz, ingested_at timestamp_ntz"


def people(spark, users=(), posts=(), comments=(), deleted=()):
    return (
        spark.createDataFrame(list(users), U),
        spark.createDataFrame(list(posts), f"id string, author_id string, {TS}, space string, ref string, salt int"),
        spark.createDataFrame(list(comments), f"id string, user string, parent struct<type:string,id:string>, {TS}"),
        spark.createDataFrame(list(deleted), "collection string, id string, deleted_at timestamp_ntz"),
    )


def test_orphans(spark):
    t = people(
        spark,
        [("ann", at(0), at(0), at(0)), ("ann", at(0), at(9), at(9)), ("late", at(0), at(0), at(50)), ("del", at(0), at(0), at(0)), ("back", at(30), at(30), at(1)), (None, None, None, None), ("nul", None, None, None)],
        # columns with clashing names stay out of the way
        [("p1", " ANN\t", at(1), at(1), at(1), "x", "y", 3), ("p1", "ghost", at(1), at(0), at(1), None, None, None), ("p2", "Ghost", None, at(1), at(1), None, None, None), ("p3", "  ", at(1), at(1), at(1), None, None, None), ("p4", "late", at(1), at(1), at(1), None, None, None), ("p5", "nul", at(1), at(1), at(1), None, None, None), ("p6", None, at(1), None, None, None, None, None)],
        [
            ("c1", "del", ("posts", "p1"), at(2), at(2), at(2)), ("c1", "del", ("posts", "p1"), at(2), at(2), at(2)),
            ("c2", "back", (None, "P1 "), at(2), at(2), at(2)), ("c3", None, ("posts", "c1"), at(2), at(2), at(2)), ("c4", "ann", (" Comments", "c1"), at(2), at(2), at(2)),
            ("c5", "ann", (None, "nowhere"), at(2), at(2), at(2)), ("c6", "ann", None, at(2), at(2), at(2)), ("c7", "ann", (None, None), at(2), at(2), at(2)), ("c8", "ann", ("odd", "c1"), at(2), at(2), None),
        ],
        [("users", "DEL ", at(5)), ("users", "del", at(6)), ("users", "back", at(20)), (None, None, None), ("posts", "p9", None)],
    )
    got = {tuple(r) for r in orphans.find_orphans(*t).collect()}
    assert got == {
        ("posts", "p2", "author_id", "unknown", "missing"), ("posts", "p4", "author_id", "2024-05", "late"), ("comments", "c1", "user", "2024-05", "deleted"),
        ("comments", "c3", "parent", "2024-05", "missing"), ("comments", "c5", "parent", "2024-05", "missing"),
    }
    assert {tuple(r) for r in orphans.orphan_report(orphans.find_orphans(*t)).collect()} >= {("comments", "parent", "2024-05", "missing", 2)}


def test_orphans_of_nothing_and_skew(spark):
    assert orphans.find_orphans(*people(spark)).count() == 0
    t = people(spark, posts=[(f"p{k}", "gone" if k % 3 else f"u{k}", at(k), at(k), at(k), None, None, None) for k in range(300)])
    assert orphans.find_orphans(*t).count() == 300


def test_key_filter_loses_nothing(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    has = key_filter(keys, ["k"])
    other = spark.range(3000, 40000).select(F.col("id").cast("string").alias("k"))
    assert keys.where(has(F.col("k"))).count() == 3000 and other.where(has(F.col("k"))).count() < 2000


ENTRY = "entry_id long, collection string, path string, mtime_nanos long, size_bytes long"


def entries(spark, n=400):
    r = random.Random(3)
    rows = [(k, r.choice("ab"), r.choice(["x/one.md", "x\\one.md", "./x//one.md", f"f{k}.md", f"f{k // 3}.md", None]), r.choice([1, 2, 3, None, 10**18]), r.choice([None, 5, 700])) for k in range(n)]
    return spark.createDataFrame(rows, ENTRY).repartition(5), rows


def test_consolidate(spark):
    from quirefold.functions.text import place_of

    df, rows = entries(spark)
    best = {}
    for e, c, p, m, _ in rows:
        if p is not None:
            k, v = (c, place_of(p)), (-(m if m is not None else -(10**30)), e)
            best[k] = min(best.get(k, v), v)
    want = {e for e, _, p, _, _ in rows if p is not None} - {v[1] for v in best.values()}
    out = consolidate.consolidate(df, target_bytes=1500).cache()
    got = out.where("superseded").select("entry_id").collect()
    assert {r[0] for r in got} == want and len(got) == len(want) and out.count() == len(rows)
    meta = consolidate.range_metadata(out).collect()
    assert sum(r["n_files"] for r in meta) == len(best) and all(r["n_bytes"] <= 1500 + 700 for r in meta)
    spans = sorted((r["first_place"], r["last_place"]) for r in meta)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert consolidate.consolidate(df.limit(0)).count() == 0


@pytest.mark.parametrize("task_rows", [7, 10**6])
def test_a_user_with_most_posts_is_split_by_counts(spark, task_rows):
    """Half of all posts name one user that is missing, the others name users that are there or missing once."""
    users = [(f"u{k}", at(0), at(0), at(0)) for k in range(0, 60, 2)]
    posts = [(f"p{k}", "hot" if k % 2 else f"u{k}", at(1), at(1), at(1), None, None, None) for k in range(120)]
    got = orphans.find_orphans(*people(spark, users, posts), task_rows=task_rows).collect()
    want = {(f"p{k}", "missing") for k in range(120) if k % 2 or k >= 60}
    assert {(r["record_id"], r["status"]) for r in got} == want and len(got) == len(want)


def test_one_path_fills_many_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("entry_id"), F.lit("a").alias("collection"), F.lit("same.md").alias("path"), (F.col("id") % 7).alias("mtime_nanos"), F.lit(1).cast("long").alias("size_bytes"))
    out = consolidate.consolidate(df)
    assert [r[0] for r in out.where("NOT superseded").select("entry_id").collect()] == [6]


def test_merge_of_many_runs():
    import pyarrow as pa

    r = random.Random(3)
    runs = [sorted(f"{r.randrange(60):03}" for _ in range(r.randrange(0, 90))) for _ in range(7)] + [["005"] * 200]
    blocks = []
    for n, keys in enumerate(runs):
        at = 0
        while at < len(keys):
            to = at + r.randrange(1, 30)
            blocks.append(pa.RecordBatch.from_arrays([pa.array(keys[at:to]), pa.array([n] * len(keys[at:to])), pa.array(range(at, at + len(keys[at:to])))], names=["k", "run", "no"]))
            at = to
    blocks.append(blocks[0].slice(0, 0))
    got = [(x["k"], x["run"], x["no"]) for b in runmerge.merged(iter(blocks), 0, 1) for x in b.to_pylist()]
    assert [g[0] for g in got] == sorted(k for x in runs for k in x)
    assert sorted(got) == sorted((k, n, i) for n, x in enumerate(runs) for i, k in enumerate(x))
    for n in range(len(runs)):  # what is equal stays in the order of its run
        assert [g[2] for g in got if g[1] == n] == list(range(len(runs[n])))
    assert list(runmerge.merged(iter([]), 0, 1)) == []


def test_sortable_keys(spark):
    texts, numbers = [None, "", "\0", "\0a", "a", "a\0", "a\0\1", "a b", "ab", "\u00e9", "\U0001f642"], [None, -(2**63), -1, 0, 1, 2**63 - 1]
    df = spark.createDataFrame([(x, n) for x in texts for n in numbers], "x string, n long")
    up = df.select("x", "n", F.concat(runmerge.text_key(F.col("x")), runmerge.number_key(F.col("n"))).alias("k")).orderBy("k").collect()
    assert [(r["x"], r["n"]) for r in up] == [(x, n) for x in texts for n in numbers]
    down = df.select("x", "n", F.concat(runmerge.text_key(F.col("x")), runmerge.number_key(F.col("n"), down=True)).alias("k")).orderBy("k").collect()
    assert [(r["x"], r["n"]) for r in down] == [(x, n) for x in texts for n in [*numbers[:0:-1], None]]


def test_outputs_are_rolled_by_the_bytes_that_stay(spark):
    """Heads of ranges that continue a file of the range before fill no output."""
    rows = [(k, "a", f"{k // 40:02}.md", k, 100) for k in range(400)]
    df = spark.createDataFrame(rows, ENTRY)
    out = consolidate.consolidate(df, target_bytes=100)
    kept = out.where("NOT superseded").collect()
    assert sorted(r["entry_id"] for r in kept) == [40 * k + 39 for k in range(10)]
    assert len({r["out_file"] for r in kept}) == 10  # one file each: none is pushed into another's output, none shares one
    meta = consolidate.range_metadata(out).collect()
    assert {(r["n_files"], r["n_bytes"]) for r in meta} == {(1, 100)}


def test_rewrite_files_keeps_every_row(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 300).alias("k"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("v"), (F.col("id") % 11).cast("int"))).alias("v"))
    df = df.unionByName(df.where("k = 5")).unionByName(spark.range(400).select(F.lit(9).cast("long").alias("k"), F.lit("hot").alias("v")))
    df.repartition(60).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    at = f"file://{tmp_path}/big"
    meta = sorted(map(tuple, consolidate.rewrite_files(small, ["k"], at, 900, range_rows=300).collect()))
    assert sorted(map(str, consolidate.records_of(spark, at, df.schema).collect())) == sorted(map(str, df.collect()))
    files = list((tmp_path / "big" / "files").glob("out_file=*/*.parquet"))
    assert len(files) == len(meta) < 60 and sum(m[3] for m in meta) == df.count() and all(m[4] <= 900 for m in meta)
    ends = [(json.loads(m[1])["k"], json.loads(m[2])["k"]) for m in meta]
    assert all(a <= b for a, b in ends) and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))  # disjoint ranges in order
    assert sum(a == b == 9 for a, b in ends) > 1  # a hot key spreads
    for f in files[:5]:
        k = [x["row"]["k"] for x in pq.read_table(f).to_pylist()]
        assert k == sorted(k)
    assert consolidate.rewrite_files(small.limit(0), ["k"], f"{at}-none").count() == 0


def test_intervals(spark):
    r = random.Random(5)
    avail, done = sorted(r.sample(range(-50, 400), 250)), sorted(r.sample(range(-80, 420), 260))
    one = lambda xs: spark.createDataFrame([(x,) for x in [*xs, *xs[:9], None]], "n long")
    d = intervals.to_intervals(one(done), block=64)
    assert sum(x["hi"] - x["lo"] + 1 for x in d.collect()) == len(done)
    g = intervals.gaps(intervals.to_intervals(one(avail), block=64), d, block=64)
    got = sorted(x["n"] for x in intervals.rows_in(one(avail).where("n IS NOT NULL").distinct(), "n", g, block=64).collect())
    assert got == sorted(set(avail) - set(done))
    m = intervals.merge_intervals(d, intervals.to_intervals(one(avail), block=64)).collect()
    assert sorted(k for x in m for k in range(x["lo"], x["hi"] + 1)) == sorted(set(avail) | set(done))


def test_interval_log_survives_failures(spark, tmp_path):
    log = intervals.IntervalLog(spark, f"file://{tmp_path}/log")
    rows = lambda xs: spark.createDataFrame([(x, f"r{x}") for x in xs], "n long, v string")
    assert log.run(rows([1, 2, 3, 7]), "n", lambda df: df) == 4

    def dies(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        log.run(rows([1, 2, 3, 5, 7, 8]), "n", dies)
    assert log.run(rows([1, 2, 3, 5, 7, 8]), "n", lambda df: df) == 2  # a late commit in the gap, and a new one
    assert log.run(rows([1, 2, 3, 5, 7, 8]), "n", lambda df: df) == 0
    assert sorted((x["lo"], x["hi"]) for x in log.done().collect()) == [(1, 3), (5, 5), (7, 8)]


def test_interval_log_of_two_writers(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    a, b = intervals.IntervalLog(spark, at), intervals.IntervalLog(spark, at)
    rows = spark.createDataFrame([(x, f"r{x}") for x in range(10)], "n long, v string")
    assert a.run(rows.where("n < 3"), "n", lambda df: df) == 3

    def slow(df):  # meanwhile another run takes the same rows and commits first
        assert b.run(rows, "n", lambda x: x) == 7
        return df

    with pytest.raises(intervals.CommitConflict):
        a.run(rows, "n", slow)
    assert a.version() == 2 and sorted(r[0] for r in a.outputs(rows.schema).collect()) == list(range(10))  # each once
    assert a.run(rows, "n", lambda df: df) == 0
    assert len([d for d in (tmp_path / "log").iterdir() if d.is_dir()]) == 3  # the loser's folder is gone


@pytest.mark.parametrize("step", ["input", "output", "intervals", "commit"])
def test_interval_log_dies_at_any_step(spark, tmp_path, monkeypatch, step):
    log = intervals.IntervalLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([(1, "a"), (4, "b")], "n long, v string")
    log.run(rows.where("n = 1"), "n", lambda df: df)
    if step == "commit":
        monkeypatch.setattr(log, "_commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    else:
        write = DataFrameWriter.parquet
        monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, p, *a, **k: (_ for _ in ()).throw(OSError("gone")) if p.endswith(step) else write(self, p, *a, **k))
    with pytest.raises(OSError):
        log.run(rows, "n", lambda df: df)
    monkeypatch.undo()
    again = intervals.IntervalLog(spark, log.root)
    assert again.version() == 1 and again.run(rows, "n", lambda df: df) == 1
    assert sorted(r[0] for r in again.outputs(rows.schema).collect()) == [1, 4]


def test_committed_intervals_of_runs(spark):
    keep = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6), (3, "a", "z", 7), (9, "a", "w", None)], "entry_id long, collection string, place string, micros long")
    index = spark.createDataFrame([("a", "x", 5, 1), ("a", "y", 6, 1), ("a", "z", 8, 2), ("a", "w", None, 2)], "collection string, place string, at long, run_id int")
    assert [tuple(r) for r in intervals.committed(keep, index).select("run_id", "lo", "hi").collect()] == [(1, 1, 2)]


def test_pending_files(spark):
    e = spark.createDataFrame([(1, "a", "x.md", 1_000_000_999, 1), (2, "a", "./y.md", 2_000_000_000, 1), (3, "a", "z.md", -1, 1), (4, "a", "n.md", None, 1), (5, "a", "x.md", 5, 1), (6, None, None, 3, 1)], ENTRY)
    d = spark.createDataFrame([("a", "x.md", datetime(1970, 1, 1, 0, 0, 1), 1), ("a", "y.md", datetime(1970, 1, 1, 0, 0, 2), 2), ("a", "z.md", datetime(1969, 12, 31, 23, 59, 59, 999999), 1), ("a", "n.md", None, 1), (None, None, None, None)], "collection string, path string, modified_at timestamp_ntz, indexed_run int")
    runs = spark.createDataFrame([(1, " OK ", T0), (2, "ok", None), (3, None, None)], "run_id int, status string, finished_at timestamp_ntz")
    assert {tuple(r) for r in intervals.pending_files(e, d, runs).collect()} == {(2, "added"), (4, "changed")}
    assert intervals.pending_files(e.limit(0), d, runs).count() == 0
    assert {r[1] for r in intervals.pending_files(e, d.limit(0), runs).collect()} == {"added"}


DOC = "collection string, id string, path string, data_json string, modified_at timestamp_ntz, bucket int, k1 long"
REP = "collection string, id string, path string, data_json string, modified_at string"


def test_diff_copies(spark):
    docs = [
        ("a", "1", "p/x.md", '{"a":1,"b":[1,2],"n":null}', at(1), 1, 1), ("a", "2", "p.md", '{"a":true}', at(1), 1, 1), ("a", "3", "p.md", "oops", at(1), 1, 1), ("a", "4", "p.md", None, None, 1, 1),
        ("a", "5", "p.md", '{"a":{"x":1,"y":null}}', at(1), 1, 1), ("a", "6", "q.md", "{}", at(1), 1, 1), (None, "7", "q.md", "{}", at(1), 1, 1), ("a", "8", None, "[1]", at(1), 1, 1),
    ]
    reps = [
        ("a", "1", "p//x.md", '{ "b": [2,1], "a": 1.0 }', "2024-05-01T03:00:00.0009+02:00"), ("a", "2", "p.md", '{"a":1}', "2024-05-01 01:00:00.001"), ("a", "3", "p.md", "oops ", "2024-05-01T01:00:00Z"), ("a", "3", "p.md", "oops ", "2024-05-01T01:00:00Z"),
        ("a", "4", "p.md", "{}", None), ("a", "5", "p.md", '{"a":{"x":1.0},"z":null}', "2024-05-01 01:00:00"), ("a", "9", "p.md", "{}", "never"), ("a", "8", None, "[1]", "never"),
    ]
    got = sorted(tuple(r) for r in matrixdiff.diff_copies(spark.createDataFrame(docs, DOC), spark.createDataFrame(reps, REP)).collect())
    assert got == sorted([
        ("a", "1", "differs", "data_json.b"), ("a", "2", "differs", "data_json.a"), ("a", "2", "differs", "modified_at"), ("a", "3", "differs", "data_json"), ("a", "4", "differs", "data_json"),
        ("a", "6", "only_documents", ""), ("a", "9", "only_replica", ""), ("a", "8", "differs", "modified_at"),
    ])
    assert matrixdiff.diff_copies(spark.createDataFrame(docs, DOC).limit(0), spark.createDataFrame([], REP)).count() == 0


def test_canon():
    assert canon({"b": 1, "a": [1.0, None, {"x": None}]}) == canon({"a": [1, None, {}], "b": 1.0})
    assert canon("1") != canon(1) and canon(True) != canon(1) and canon([1, 2]) != canon([2, 1])
    assert parse_object('{"a": NaN}') is None and parse_object("[1]") is None and parse_object('{"a":1,"a":2}') == {"a": 2}


HIST = "id long, hash string, schema_yaml string, created_at timestamp_ntz"


def test_schema_drift(spark):
    v1 = "collections: {notes: {path: x, fields: {title: {type: string, required: true}, n: number, r: {type: ref, target: [notes]}, old: string}}}"
    v2 = "collections:\n  notes:\n    path: x\n    fields:\n      title: string\n      n: {type: string}\n      d: {type: boolean, required: true, default: false}\n  more: {path: y, fields: {q: object}}\n"
    h = spark.createDataFrame([(2, "", v2, at(10)), (1, "", v1, at(0)), (3, "", "a: [", at(20)), (4, "", None, None)], HIST)
    docs = [(1, "notes", '{"n":"x","r":{"id":"1"},"old":null,"new":1}', at(1)), (2, "notes", '{"title":"t","n":"s"}', at(10)), (3, "notes", '{"title":1,"q":[]}', at(11)), (4, "notes", "[1]", at(1)), (5, "notes", None, at(1)), (6, "notes", '{"a":1}', at(-1)), (7, "notes", '{"a":1}', None), (8, "gone", "{}", at(1)), (9, None, '{"z":1}', at(1))]
    d = spark.createDataFrame(docs, "doc_id long, collection string, data_json string, modified_at timestamp_ntz")
    got = {tuple(r) for r in schemadrift.find_drift(d, h).collect()}
    declared = {r for r in got if r[1] == 0}
    assert {r for r in declared if r[0] == 2} == {(2, 0, "notes", "n", "retyped"), (2, 0, "notes", "r", "removed"), (2, 0, "notes", "old", "removed"), (2, 0, "notes", "d", "added"), (2, 0, "more", "q", "added")}
    assert len({r for r in declared if r[0] == 3}) == 4  # a schema that can't be read declares nothing
    assert got - declared == {(1, 1, "notes", "n", "mistyped"), (1, 1, "notes", "new", "undeclared"), (1, 1, "notes", "title", "absent"), (2, 3, "notes", "title", "mistyped"), (2, 3, "notes", "q", "undeclared"), (1, 9, None, "z", "undeclared")}
    alts = {tuple(r)[1:] for r in schemadrift.appearing_alternatives(d, h).collect()}
    assert ("notes", "title", "number", 1) in alts and ("notes", "title", "string", 1) in alts
    t = {(r["doc_id"], r["field"]): r for r in schemadrift.value_table(d, h).collect()}
    assert t[1, "r"]["as_json"] == '{"id":"1"}' and t[3, "title"]["as_number"] == 1.0 and t[3, "title"]["branch_count"] == 2
    assert schemadrift.find_drift(d, h.limit(0)).count() == 0 and {r[1] for r in schemadrift.find_drift(d.limit(0), h).collect()} == {0}


def test_drift_table_keeps_every_document(spark):
    h = spark.createDataFrame([(1, "", "collections: {notes: {path: x, fields: {a: string}}}", at(0))], HIST)
    docs = [(1, "notes", '{"a":1,"b":null}', at(1)), (2, "notes", '{"a":"1"}', at(-1)), (3, "notes", '{"a":true}', None), (4, "notes", "[1]", at(1)), (5, "notes", None, at(1)), (6, "notes", "{}", at(1)), (7, "notes", '{"b":null}', at(1)), (8, None, '{"a":2}', at(1)), (None, None, "oops", None), (10, "notes", '"s"', at(1))]
    d = spark.createDataFrame(docs, "doc_id long, collection string, data_json string, modified_at timestamp_ntz")
    got = {r[0]: tuple(r)[1:] for r in schemadrift.value_table(d, h).collect()}
    assert got == {
        1: ("notes", 0, "a", "number", "1", 1.0, None, None, 3), 2: ("notes", None, "a", "string", "1", None, None, None, 3), 3: ("notes", None, "a", "boolean", "true", None, True, None, 3),
        4: ("notes", 0, None, "list", "[1]", None, None, "[1]", None), 5: ("notes", 0, None, "null", None, None, None, None, None), 6: ("notes", 0, None, "object", "{}", None, None, "{}", None), 7: ("notes", 0, None, "object", "{}", None, None, "{}", None),
        8: (None, 0, "a", "number", "2", 2.0, None, None, 1), None: (None, None, None, "text", "oops", None, None, None, None), 10: ("notes", 0, None, "string", "s", None, None, None, None),
    }
    alts = {tuple(r) for r in schemadrift.appearing_alternatives(d, h).collect()}
    assert alts == {(1, "notes", "a", "number", 1), (1, None, "a", "number", 1), (None, "notes", "a", "string", 1), (None, "notes", "a", "boolean", 1)}
    assert schemadrift.value_table(d, h.limit(0)).count() == 10 and schemadrift.value_table(d.limit(0), h).count() == 0


def test_drift_inside_objects_and_lists(spark):
    h = spark.createDataFrame([(1, "", "a: {}", at(0)), (2, "", "a: {}", at(10))], HIST)
    docs = [(1, "notes", '{"m":{"n":1,"o":null,"p.q":{"":true}},"l":[{"id":"x"},{"id":"y"},[2]]}', at(1)), (2, "notes", '{"m":{"n":"1"},"l":[{"id":7}]}', at(11))]
    d = spark.createDataFrame(docs, "doc_id long, collection string, data_json string, modified_at timestamp_ntz")
    alts = {(r[0], r[2], r[3], r[4]) for r in schemadrift.appearing_alternatives(d, h).collect()}
    assert alts == {
        (1, "m", "object", 1), (1, "m.n", "number", 1), (1, 'm."p.q"', "object", 1), (1, 'm."p.q".""', "boolean", 1), (1, "l", "list", 1), (1, "l[]", "object", 1), (1, "l[]", "list", 1), (1, "l[][]", "number", 1), (1, "l[].id", "string", 1),
        (2, "m.n", "string", 1), (2, "l[].id", "number", 1),
    }
    t = sorted((r["doc_id"], r["field"], r["tag"], r["canonical"], r["as_number"], r["branch_count"]) for r in schemadrift.value_table(d, h).where("field IN ('m.n', 'l[].id')").collect())
    assert t == [(1, "l[].id", "string", "x", None, 2), (1, "l[].id", "string", "y", None, 2), (1, "m.n", "number", "1", 1.0, 2), (2, "l[].id", "number", "7", 7.0, 2), (2, "m.n", "string", "1", None, 2)]
    deep = '{"a":' * 300 + "1" + "}" * 300
    assert len(schemadrift.walk(deep)) == 300 and schemadrift.walk(deep)[-1][1] == "number"


def test_consistent_table_has_one_row_a_document(spark):
    h = spark.createDataFrame([(1, "", "collections: {notes: {fields: {a: number, b: {type: list}}}}", at(0)), (2, "", "collections: {notes: {fields: {a: string, doc_id: string}}}", at(10))], HIST)
    docs = [(1, "notes", '{"a":1,"b":[1, {"y":2,"x":1}],"z":true}', at(1)), (2, "notes", '{"a":"1","b":null}', at(11)), (3, "notes", '{"a":{},"doc_id":"q"}', at(12)), (4, "notes", "oops", at(1)), (5, None, None, None), (6, "notes", "[1]", at(-9)), (1, "notes", "{}", at(1))]
    d = spark.createDataFrame(docs, "doc_id long, collection string, data_json string, modified_at timestamp_ntz").withColumn("kind", F.lit("clash"))
    t = schemadrift.consistent_table(d, h)
    got = sorted((r.asDict(True) for r in t.collect()), key=lambda r: (r["doc_id"], str(r["whole"]), -len(r["undeclared"])))
    assert [(r["doc_id"], r["version_id"], r["kind"], r["whole"]) for r in got] == [(1, 1, "object", None), (1, 1, "object", None), (2, 2, "object", None), (3, 2, "object", None), (4, 1, "text", "oops"), (5, None, None, None), (6, None, "list", "[1]")]
    assert got[0]["data"] == {"a": {"canonical": "1", "as_string": None, "as_number": 1.0, "as_object": None}, "b": {"canonical": '[1,{"x":1,"y":2}]', "as_list": '[1,{"x":1,"y":2}]'}, "doc_id": {"canonical": None, "as_string": None}}
    assert got[0]["undeclared"] == {"z": {"tag": "boolean", "canonical": "true"}}
    assert got[2]["data"]["a"]["as_string"] == "1" and got[2]["data"]["a"]["as_number"] is None and got[3]["data"]["a"]["as_object"] == "{}" and got[3]["data"]["doc_id"]["as_string"] == "q"
    assert schemadrift.consistent_table(d, h.limit(0)).count() == 7 and schemadrift.consistent_table(d.limit(0), h).count() == 0


def test_small_sides_that_are_not_small(spark, monkeypatch):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "x"), (1, "x")], "k int, c string")
    b = spark.createDataFrame([(1, "x", 10), (2, None, 20), (None, "x", 30), (3, "y", 40)], "k int, c string, v int")
    for limit in (200_000, 1):
        monkeypatch.setattr(schemadrift, "SMALL", limit)
        assert sorted(r["v"] for r in schemadrift.small_join(a, b, ["k", "c"]).collect()) == [10, 10, 20, 30]
        assert schemadrift.small_join(a, b.where("k = 9"), ["k", "c"], "left").count() == 4


def test_many_versions(spark):
    """As many as there are: the plan does not grow with them."""
    n = 3000
    h = spark.createDataFrame([(k, "", f"collections: {{notes: {{fields: {{a: {'string' if k % 2 else 'number'}}}}}}}", at(k)) for k in range(n)], HIST)
    d = spark.createDataFrame([(k, "notes", '{"a":1}', at(k)) for k in range(0, n, 7)] + [(n, "notes", '{"a":1}', at(-1)), (n + 1, "notes", '{"a":1}', None)], "doc_id long, collection string, data_json string, modified_at timestamp_ntz")
    got = schemadrift.find_drift(d, h).where("doc_id > 0 OR change = 'mistyped'").collect()
    assert sorted((r["version_id"], r["doc_id"], r["change"]) for r in got) == [(k, k, "mistyped") for k in range(0, n, 7) if k % 2]
    assert schemadrift.find_drift(d, h).where("change = 'retyped'").count() == n - 1


def walk(par):
    out = {}
    for k in par:
        seen, x = [], k
        while par.get(x) is not None and x not in seen:
            seen.append(x)
            x = par[x]
        if x in seen:
            i = seen.index(x)
            out[k] = (min(seen[i:]), 0 if k in seen[i:] else i, "cycle" if k in seen[i:] else "below_cycle", [x, *reversed(seen[:i])] if i else [k])
        else:
            out[k] = (x, len(seen), "tree", [x, *reversed(seen)])
    return out


@pytest.mark.parametrize("seed,hot", [(1, 0.001), (2, 0.001), (3, 0.02), (4, 1.0)])
def test_forest_against_walks(spark, seed, hot):
    r = random.Random(seed)
    par = {f"n{k:03}": (r.choice([None, f"out{r.randrange(3)}"]) if r.random() < 0.05 else f"n{r.randrange(max(0, k - r.choice([1, 3, 200])), k):03}" if k else None) for k in range(220)}
    for k in range(150, 180):  # a chain, and loops with trees below
        par[f"n{k:03}"] = f"n{k - 1:03}"
    par["n150"] = "n020"
    par |= {"a": "b", "b": "c", "c": "a", "self": "self", "t1": "a", "t2": "t1", "t3": "self", **{f"z{k:02}": f"z{(k + 1) % 17:02}" for k in range(17)}, "zt": "z05"}
    links = spark.createDataFrame(list(par.items()), "node string, parent string")
    want = walk(par)
    got = {x["node"]: (x["root_id"], x["depth"], x["state"], x["path"]) for x in forest.resolve(links, paths=True, hot=hot).collect()}
    assert got == want
    assert {x["node"]: (x["root_id"], x["depth"], x["state"]) for x in forest.resolve(links, hot=hot).collect()} == {k: v[:3] for k, v in want.items()}


def test_threads_edges(spark):
    c = spark.createDataFrame([("A ", ("posts", "p"), at(1)), ("a", ("posts", "old"), at(0)), ("b", None, at(0)), ("c", (None, " "), None), (None, None, None), ("d", ("comments", "B"), None), ("d", ("comments", "B"), None)], "id string, parent struct<type:string,id:string>, modified_at timestamp_ntz")
    assert {tuple(r) for r in forest.find_threads(c).collect()} == {("a", "p", 1, "tree"), ("b", "b", 0, "tree"), ("c", "c", 0, "tree"), ("d", "b", 1, "tree")}
    assert forest.find_threads(c.limit(0)).count() == 0
    links = spark.createDataFrame([("x", "r"), ("y", "x"), ("r", None)], "node string, parent string")
    assert {tuple(r) for r in forest.descendants(forest.resolve(links, paths=True)).collect()} == {("r", "x", 1), ("r", "y", 2), ("x", "y", 1)}


def test_cascades_of_any_depth(spark):
    s = parse_schema("collections: {comments: {path: 'c/{id}.md', fields: {parent: {type: ref, target: comments, on_delete: cascade}}}}")
    links = [(f"c{k}", f"c{k - 1}" if k else "c69") for k in range(70)] + [("other", None)]  # a chain that is a loop too
    t = {"comments": spark.createDataFrame(links, "id string, parent string").coalesce(1)}
    fx = integrity.plan_delete(s, t, spark.createDataFrame([("comments", "c0")], "collection string, id string"))
    assert sorted(r["id"] for r in fx.deleted.collect()) == sorted(f"c{k}" for k in range(70)) and fx.nullified.count() == fx.archived.count() == 0


def test_keyed_changes(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "b", "q"), (3, None, "z")], "k long, v string, w string")
    patch = spark.createDataFrame([(2, None, "n"), (9, "x", None)], "k long, v string, w string")
    assert sorted(map(tuple, merge.partial_merge(base, patch, ["k"]).collect())) == [(1, "a", None), (2, "b", "n"), (3, None, "z")]
    assert sorted(map(tuple, merge.upsert(base, patch, ["k"]).collect())) == [(1, "a", None), (2, None, "n"), (3, None, "z"), (9, "x", None)]
    diff = merge.manifest_diff(base.select("k", "w"), patch.select("k", "w"), ["k"], "w")
    assert {tuple(r) for r in diff.collect()} == {(1, "removed"), (3, "removed"), (2, "modified"), (9, "added")}
    h = lambda df: {tuple(r) for r in merge.directory_hash(df, "g", "p", "m", buckets=4).collect()}
    m = spark.createDataFrame([("a", f"f{k}", k) for k in range(40)], "g string, p string, m long")
    assert h(m) == h(m.orderBy(F.desc("p")).repartition(7)) and h(m) != h(m.where("m > 0"))
    assert merge.list_filter(base, {"k": "2", "v": "b"}).count() == 1 and merge.list_filter(base, {"w": ""}).count() == 0
