"""Writes touch what changes and nothing else; front matter as JSON."""

import os

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import front_json
from mnemospark.sources.note_store import NoteStore, safe_path, write_files

NOTES, CHUNKS, EDGES = "note_id string, content_hash string", "note_id string, chunk_index int, content_hash string, embedding array<double>", "note_id string, edge_id string"


def state(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def put(spark, store, notes, removed=(), embedding=None):
    n = spark.createDataFrame([(i, h) for i, h, _ in notes], NOTES)
    c = spark.createDataFrame([(i, k, x, embedding) for i, _, cs in notes for k, x in enumerate(cs)], CHUNKS)
    e = spark.createDataFrame([(i, f"{i}>{x}") for i, _, cs in notes for x in cs], EDGES)
    return store.write(n, c, e, spark.createDataFrame([(r,) for r in removed], "note_id string"))


def test_store_rewrites_only_what_changes(spark, tmp_path):
    store = NoteStore(spark, str(tmp_path / "s"), buckets=8)
    first = [(f"n{i}", f"h{i}", [f"a{i}", "same"]) for i in range(30)]
    assert put(spark, store, [*first, (None, "x", ["y"])], embedding=[1.0])["written"] == 30
    before = state(store.path)
    assert put(spark, store, first) == {"written": 0, "removed": 0, "buckets": 0} and state(store.path) == before
    got = put(spark, store, [("n3", "new", ["b3", "same"]), ("n9", "h9", ["not looked at"])], removed=["n4", "nowhere"])
    assert got["written"] == 1 and got["removed"] == 1 and got["buckets"] <= 2
    after = state(store.path)
    assert len({f.split("bucket=")[1].split("/")[0] for f in set(before) ^ set(after)}) == got["buckets"]
    assert {f: t for f, t in before.items() if f in after} == {f: after[f] for f in before if f in after}
    chunks = {(r["note_id"], r["chunk_index"]): (r["content_hash"], r["embedding"]) for r in store.table("chunks").collect()}
    assert chunks["n3", 0] == ("b3", None) and chunks["n3", 1] == ("same", [1.0]) and chunks["n9", 0] == ("a9", [1.0])
    assert {r["note_id"] for r in store.table("edges").collect()} == {r["note_id"] for r in store.table("notes").collect()} == {f"n{i}" for i in range(30) if i != 4}
    assert put(spark, store, [("n3", "new", ["b3", "same"])], removed=["n4"])["buckets"] == 0  # again: nothing
    assert put(spark, store, [], removed=[f"n{i}" for i in range(29)])["removed"] == 28
    assert [r["note_id"] for r in store.table("notes").collect()] == ["n29"] and put(spark, store, [], removed=["n29"])["removed"] == 1
    assert not store.exists("notes") and put(spark, store, first[:2])["written"] == 2


def test_write_broken_off_is_made_whole(spark, tmp_path, monkeypatch):
    store = NoteStore(spark, str(tmp_path / "s"), buckets=4)
    put(spark, store, [("a", "1", ["x"]), ("b", "1", ["y"])], embedding=[2.0])
    real = NoteStore._replace

    def fails(self, name, rows, buckets):
        if name == "notes":
            raise RuntimeError("lost")
        real(self, name, rows, buckets)

    monkeypatch.setattr(NoteStore, "_replace", fails)
    with pytest.raises(RuntimeError):
        put(spark, store, [("a", "2", ["x", "z"])], removed=["b"])
    monkeypatch.setattr(NoteStore, "_replace", real)
    assert put(spark, store, [("a", "2", ["x", "z"])], removed=["b"]) == {"written": 1, "removed": 1, "buckets": len({r["bucket"] for r in spark.createDataFrame([("a",), ("b",)], "i string").select(store._bucket(F.col("i")).alias("bucket")).collect()})}
    assert sorted((r["note_id"], r["chunk_index"], r["embedding"]) for r in store.table("chunks").select("note_id", "chunk_index", F.coalesce("embedding", F.array().cast("array<double>")).alias("embedding")).collect()) == [("a", 0, [2.0]), ("a", 1, [])]


def test_files(spark, tmp_path):
    rows = [("a/b.md", "é"), ("c.md", None), ("../x.md", "no"), ("/abs.md", "no"), ("a//b.md", "no"), (None, "no")]
    df = spark.createDataFrame(rows, "relative_path string, text string")
    for _ in range(2):  # a second run leaves the same
        got = {r["relative_path"]: (r["size"], r["error"]) for r in write_files(df, str(tmp_path / "v")).collect()}
        assert got["a/b.md"] == (2, None) and got["c.md"] == (0, None) and all(got[p][1] == "UNSAFE_PATH" for p, _ in rows[2:])
        assert sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs) == ["v/a/b.md", "v/c.md"]
    assert not safe_path("a\\b") and not safe_path("./a")


@pytest.mark.parametrize(
    "front,code",
    [
        (None, "JSON_MALFORMED"), ("", "JSON_MALFORMED"), ("{", "JSON_MALFORMED"), ("3", "JSON_NOT_AN_OBJECT"), ("null", "JSON_NOT_AN_OBJECT"), ("{}", "SCOPE_REQUIRED"), ('{"scope": null}', "SCOPE_REQUIRED"), ('{"scope": ["GLOBAL"]}', "SCOPE_REQUIRED"),
        ('{"scope": "global"}', None), ('{"scope": "GLOBAL", "agent_id": {"a": 1}}', "TEXT_INVALID:agent_id"), ('{"scope": "GLOBAL", "kind": []}', "TEXT_INVALID:kind"), ('{"scope": "GLOBAL", "artifact_refs": [["a"]]}', "LIST_INVALID:artifact_refs"), ('{"scope": "GLOBAL", "artifact_refs": "one"}', None),
        ('{"scope": "GLOBAL", "updated_at": "2024-02-30"}', "TIMESTAMP_INVALID:updated_at"), ('{"scope": "GLOBAL", "updated_at": "2024-02-28T01:02:03+09:00"}', None), ('{"scope": "GLOBAL", "content_hash": "xyz"}', "CONTENT_HASH_INVALID"),
        ('{"scope": "GLOBAL", "valid_from": "2024-02-02", "valid_to": "2024-02-01"}', "VALIDITY_INVALID"), ('{"scope": "GLOBAL", "confidence": "high", "provenance": {"confidence": "HIGH"}}', None), ('{"scope": "GLOBAL", "evidence_refs": ["a"], "provenance": {}}', "PROVENANCE_CONFLICT:evidence_refs"),
    ],
)
def test_front_matter_errors(spark, front, code):
    assert spark.createDataFrame([(front,)], "f string").select(front_json.error(F.col("f"))).first()[0] == code


def test_context_of_front_matter(spark):
    front = '{"user_id": 7, "observed_at": "2024-01-02", "conflict_set_ids": ["x", " x", null], "mine": {"a": 1}, "scope": " "}'
    df = spark.createDataFrame([(front, 5), ("[", 6)], "f string, i int").select(front_json.context(F.col("f"), F.col("i"), F.lit("note"), F.lit("2020-01-01").cast("timestamp")).alias("c"))
    a, b = (r["c"] for r in df.collect())
    assert b is None and (a["context_id"], a["scope"], a["user_id"], a["kind"], a["conflict_set_ids"]) == ("note:5", "USER", "7", "NOTE", ["x"])
    assert a["observed_at"].isoformat()[:10] == "2024-01-02" and a["created_at"] == a["updated_at"] and set(a["metadata"]) == {"mine"}
