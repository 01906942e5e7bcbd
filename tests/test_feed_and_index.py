"""The feed against a slow store, lookups of a batch, layouts of the index, sources of view columns."""

import json
import os
import time

import pytest

from quirefold import cli
from quirefold import errors as E
from quirefold.engine import Store
from quirefold.operators import validate as V
from quirefold.streaming.feed import Echoes

SCHEMA = """
collections:
  boats:
    path: "boats/{berth}/{name}.md"
    content: true
    fields:
      name: { type: string, required: true }
      berth: { type: string, enum: [North Pier, South Pier], default: North Pier }
      length: { type: number }
  trips:
    path: "trips/{id}.md"
    id: { auto: uuid }
    fields:
      boat: { type: ref, target: boats, on_delete: cascade }
views:
  fleet: { query: "SELECT id, name FROM boats ORDER BY name", materialize: true }
  long_boats: { query: "SELECT name FROM boats WHERE length > 10" }
  trips_by_boat: { query: "SELECT b.name AS boat_name, b.length, count(t.id) AS n FROM boats b LEFT JOIN trips t ON t.boat = b.id GROUP BY b.name, b.length" }
  of_berth: { type: query, query: "SELECT name AS who, upper(name) AS loud FROM (SELECT * FROM boats) x WHERE berth = :berth", params: { berth: string } }
"""


@pytest.fixture
def port(spark, tmp_path):
    (tmp_path / "schema.yaml").write_text(SCHEMA)
    s = Store(spark, str(tmp_path))
    for n, k in (("Tern", 7), ("Auk", 12)):
        s.insert("boats", {"name": n, "length": k}, f"log of {n}")
    return s


def put(store, path, text):
    os.makedirs(os.path.dirname(f"{store.root}/{path}"), exist_ok=True)
    with open(f"{store.root}/{path}", "w") as f:
        f.write(text)


def test_own_writes_are_no_news_however_late(port):
    port.echoes = Echoes(ttl=0.0)  # the ledger has forgotten everything
    assert port.apply_events([("boats/north-pier/tern.md", "created"), ("boats/north-pier/auk.md", "modified")]) == []
    port.delete("boats", "auk")
    assert port.apply_events([("boats/north-pier/auk.md", "deleted")]) == []
    put(port, "boats/north-pier/tern.md", "---\nname: Tern\nberth: North Pier\nlength: 8\n---\n")
    assert port.apply_events([("boats/north-pier/tern.md", "modified")]) == [("boats", "tern", "updated")]
    assert port.get("boats", "tern")["length"] == 8


def test_a_removal_only_takes_the_row_that_is_there(port):
    """The row has moved to another path: the old path's removal is stale."""
    port.update_partial("boats", "tern", {"berth": "South Pier"})
    assert port.apply_events([("boats/north-pier/tern.md", "deleted")]) == []
    assert port.get("boats", "tern")["berth"] == "South Pier"


def test_watch_begins_with_what_the_index_knows(port):
    told = []
    port.on_collection_change("boats", lambda c, i, k: told.append((i, k)))
    slow = port._after
    port._after = lambda rows: (time.sleep(1), slow(rows))
    put(port, "boats/south-pier/skua.md", "---\nname: Skua\nberth: South Pier\n---\n")  # before the stream is there
    q = port.watch(interval="100 milliseconds")
    try:
        put(port, "boats/south-pier/gull.md", "---\nname: Gull\nberth: South Pier\n---\n")  # before its first listing
        end = time.time() + 60
        while time.time() < end and len(told) < 2:
            time.sleep(0.2)
        port.insert("boats", {"name": "Own"})
        time.sleep(3)
        assert sorted(told) == [("gull", "inserted"), ("own", "inserted"), ("skua", "inserted")]
        assert "Skua" in open(f"{port.root}/views/fleet.yaml").read()
    finally:
        q.stop()


def test_one_lookup_for_a_batch_of_events(port, monkeypatch):
    port.full_scan()  # everything in the snapshot, nothing in the log
    scans = []
    base = port.index.base
    monkeypatch.setattr(port.index, "base", lambda: scans.append(1) or base())
    for n in ("tern", "auk"):
        put(port, f"boats/north-pier/{n}.md", f"---\nname: {n.title()}\nlength: 1\n---\n")
    got = port.apply_events([("boats/north-pier/tern.md", "modified"), ("boats/north-pier/auk.md", "modified")] + [(f"boats/x/{k}.md", "deleted") for k in range(40)])
    assert got == [("boats", "auk", "updated"), ("boats", "tern", "updated")] and len(scans) == 1


def test_a_batch_of_events_is_seen_whole(port, monkeypatch):
    """Who reads the index while events are taken in meets neither half of them nor a log that grows under the reader."""
    paths = [f"boats/south-pier/{n}.md" for n in ("skua", "gull", "smew")]
    for p in paths:
        put(port, p, "---\nname: New\nberth: South Pier\n---\n")
    seen, prepare, reader = [], V.prepare, iter(port.index.log.items())
    next(reader)
    monkeypatch.setattr(V, "prepare", lambda *a: seen.append(len(port.index.log)) or prepare(*a))
    assert len(port.apply_events([(p, "created") for p in paths])) == 3
    assert seen == [2, 2, 2] and len(list(reader)) == 1 and len(port.index.log) == 5


def test_writes_leave_views_until_they_are_read(port):
    port.view("long_boats"), port.flush()
    built = dict(port.views.built)
    for k in range(5):
        port.insert("boats", {"name": f"B{k}", "length": 20})
    assert port.views.built == built
    assert port.view("long_boats").count() == 6 and port.views.built["long_boats"] == built["long_boats"] + 1
    assert port.flush() == ["fleet"] and open(f"{port.root}/views/fleet.yaml").read().count("name:") == 7 and port.flush() == []


def test_many_changes_go_into_a_snapshot(port, monkeypatch):
    monkeypatch.setattr("quirefold.engine.COMPACT_AT", 2)
    for k in range(6):
        put(port, f"boats/north-pier/n{k}.md", f"---\nname: N{k}\n---\n")
    os.unlink(f"{port.root}/boats/north-pier/auk.md")
    v = port.index.version
    assert port.incremental_scan()["boats"]["read"] == 6 and port.index.version == v + 1 and port.index.log == {}
    assert port.status()["collections"]["boats"] == 7 and port.get("boats", "tern")["content"] == "log of Tern"
    with pytest.raises(E.DocumentNotFound):
        port.get("boats", "auk")


def test_old_snapshots_go(port):
    for _ in range(4):
        port.full_scan()
    assert sorted(d for d in os.listdir(port.index.dir) if d.startswith("v") and d[1:].isdigit()) == [f"v{port.index.version - 1}", f"v{port.index.version}"]


def test_an_older_layout_is_upgraded(spark, port):
    port.full_scan()
    at = os.path.join(port.index.dir, f"v{port.index.version}")
    kept = spark.read.parquet(at).drop("mtime_nanos", "content_text").collect()
    spark.createDataFrame(kept).write.mode("overwrite").partitionBy("collection").parquet(f"{at}.old")
    import shutil

    shutil.rmtree(at)
    os.rename(f"{at}.old", at)
    p = os.path.join(port.index.dir, "CURRENT.json")
    json.dump({k: v for k, v in json.load(open(p)).items() if k != "layout"}, open(p, "w"))
    again = Store(spark, port.root)
    assert again.index._pointer()["layout"] == 2
    r = again.index.df().where("id = 'tern'").head()
    assert r["mtime_nanos"] // 10**9 == int(r["modified_at"].timestamp()) and r["content_text"] is None


def test_dry_run_of_a_migration_changes_nothing(spark, port):
    with open(f"{port.root}/schema.yaml", "w") as f:
        f.write(SCHEMA.replace("length: { type: number }", "length: { type: number }\n      flag: { type: string, default: none }"))
    before = open(f"{port.root}/boats/north-pier/tern.md").read()
    assert cli.run(["--data-dir", port.root, "migrate", "--dry-run"], spark) == {"warnings": [], "pending": [{"description": "field_added boats.flag: None -> string", "safe": True}]}
    assert open(f"{port.root}/boats/north-pier/tern.md").read() == before
    cli.run(["--data-dir", port.root, "migrate"], spark)
    assert "flag: none" in open(f"{port.root}/boats/north-pier/tern.md").read()


def test_sources_of_columns(port):
    assert port._fresh().sources("trips_by_boat") == [("boat_name", "boats", "name"), ("length", "boats", "length"), ("n", None, None)]
    assert port.views.sources("of_berth") == [("who", "boats", "name"), ("loud", None, None)]
    assert port.views.sources("fleet") == [("id", "boats", "id"), ("name", "boats", "name")]


def test_views_outlive_snapshots_and_scans(port):
    """A view that was built and not yet read when its snapshot went, and one that a scan has made stale."""
    port._fresh().rebuild("long_boats")
    for _ in range(3):
        port.full_scan()
    assert [r[0] for r in port.view("long_boats").collect()] == ["Auk"]
    put(port, "boats/south-pier/skua.md", "---\nname: Skua\nberth: South Pier\nlength: 30\n---\n")
    port.incremental_scan()
    assert sorted(r[0] for r in port.view("long_boats").collect()) == ["Auk", "Skua"]


def test_a_full_scan_leaves_nothing_out(port, monkeypatch):
    """Files that can't be read are told, keep their rows and are tried again; what changes during the scan is news to the next;
    names may begin with _."""
    put(port, "boats/north-pier/auk.md", '---\nname: "Auk\n---\n')
    put(port, "boats/north-pier/torn.md", "---\n- a list\n---\n")
    put(port, "boats/north-pier/_own.md", "---\nname: Own\n---\n")
    put(port, "_archive/boats/gone.md", "---\nname: Gone\n---\n")
    replace = port.index.replace
    monkeypatch.setattr(port.index, "replace", lambda df: (replace(df), put(port, "boats/north-pier/tern.md", "---\nname: Tern\nlength: 9\n---\n")))
    port.full_scan()
    monkeypatch.undo()
    assert [(c, p) for c, p, _ in port.unread] == [("boats", "boats/north-pier/auk.md"), ("boats", "boats/north-pier/torn.md")]
    assert sorted(r["id"] for r in port.collection("boats").collect()) == ["_own", "auk", "tern"] and port.get("boats", "auk")["length"] == 12
    put(port, "boats/north-pier/torn.md", "---\nname: Torn\n---\n")
    assert port.incremental_scan() == {"boats": {"removed": 0, "read": 3}} and len(port.unread) == 1
    assert sorted(r["id"] for r in port.collection("boats").collect()) == ["_own", "auk", "tern", "torn"]
    assert port.get("boats", "tern")["length"] == 9 and port.get("boats", "auk")["length"] == 12
    put(port, "boats/north-pier/auk.md", "---\nname: Auk\nlength: 13\n---\n")
    port.rebuild("boats")
    assert port.get("boats", "auk")["length"] == 13 and port.unread == [] and port.incremental_scan() == {}
    assert not [d for d in os.listdir(port.index.dir) if d.startswith("scan-")]
