"""Models start once a worker, failures are set aside, the budget of a reindex is shared; a vault is scanned within limits."""

import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from mnemospark.operators import embedding
from mnemospark.sources import markdown, vault


class Counting(embedding.ByteProvider):
    """Leaves a file for each start and each question."""

    def __init__(self, folder, **more):
        super().__init__(4, **more)
        self.folder = folder

    def start(self):
        open(os.path.join(self.folder, f"start-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        embed = super().start()

        def asked(texts):
            open(os.path.join(self.folder, f"ask-{len(texts)}-{uuid.uuid4().hex}"), "w").close()
            return embed(texts)

        return asked


class Odd:
    model, dimensions = "odd", 2

    def start(self):
        answers = {"none": [], "nan": [[1.0, float("nan")]], "short": [[1.0]], "null": [None], "good": [[1.0, 2.0]]}
        return lambda texts: [v for t in texts for v in answers[t]]


def test_one_start_a_worker(spark, tmp_path):
    items = spark.range(0, 2000, 1, 16).select("id", F.concat(F.lit("text "), "id").alias("t"))
    got = embedding.inferred(items, "id", "t", Counting(str(tmp_path)), batch=50)
    rows = got.collect()
    assert [r["id"] for r in rows] == list(range(2000)) and all(r["error"] is None for r in rows)
    names = os.listdir(tmp_path)
    starts = [n.split("-")[1] for n in names if n.startswith("start-")]
    assert len(starts) == len(set(starts)) <= 16 and {n.split("-")[1] for n in names if n.startswith("ask-")} == {"50", "25"}
    plain = {r["id"]: r["v"] for r in items.select("id", embedding.byte_embedding(F.col("t"), 4).alias("v")).collect()}
    assert all(r["embedding"] == plain[r["id"]] for r in rows)


def test_failures_are_set_aside(spark):
    items = spark.createDataFrame([(1, "a bad one"), (2, "fine"), (None, "fine"), (2, None), (3, ""), (4, "x" * 100_000)], "id long, t string").coalesce(1)
    rows = embedding.inferred(items, "id", "t", embedding.ByteProvider(refused="bad")).collect()
    assert [(r["id"], r["error"]) for r in rows] == [(1, "INFERENCE_FAILED"), (2, None), (None, None), (2, "MISSING_TEXT"), (3, None), (4, None)]
    assert rows[4]["embedding"] == [0.0] * 8 and rows[0]["embedding"] is None
    odd = spark.createDataFrame([(t,) for t in ("good", "none", "nan", "short", "null")], "t string").coalesce(1)
    found = {r["t"]: r["error"] for r in embedding.inferred(odd, "t", "t", Odd(), 5).collect()}
    assert found == {"good": None, "none": "CARDINALITY_MISMATCH", "nan": "NON_FINITE_VECTOR", "short": "DIMENSION_MISMATCH", "null": "MISSING_VECTOR"}
    assert embedding.inferred(items.limit(0), "id", "t", Odd()).collect() == []
    with pytest.raises(ValueError):
        embedding.inferred(items, "id", "t", Odd(), 0)
    embedding.register_provider(spark, "embed_test", embedding.ByteProvider(refused="bad"))
    items.createOrReplaceTempView("embed_test_items")
    assert [r[0] is None for r in spark.sql("select embed_test(t) from embed_test_items").collect()] == [True, False, False, True, False, False]


def test_stale_and_shared_budget(spark):
    p = embedding.ByteProvider()
    stored = spark.createDataFrame([(1, [1.0], "bytes", 8, embedding.fingerprint(p)), (2, None, "bytes", 8, embedding.fingerprint(p)), (3, [1.0], "other", 8, "x"), (4, [1.0], None, 8, embedding.fingerprint(p)), (5, [1.0], "bytes", 8, None)], "k int, embedding array<double>, model string, dims int, print string")
    assert [r["k"] for r in stored.where(embedding.stale("model", "dims", "print", p)).collect()] == [2, 3, 4, 5]
    kind = "key int, text string, stale boolean, embedded_at int, created_at int"
    one = spark.createDataFrame([(1, "a", True, 5, 1), (2, "b", True, None, 2), (3, "c", False, 1, 3)], kind)
    two = spark.createDataFrame([(1, "d", True, None, 1), (9, "e", False, None, 1), (4, None, None, 7, 1)], kind)
    pick = lambda *a, **k: [(r["source"], r["key"]) for r in embedding.reindex_selection_of([("one", one), ("two", two)], *a, **k).collect()]
    assert pick(10) == [("one", "2"), ("one", "1"), ("two", "1"), ("two", "4")] and pick(3) == pick(10)[:3]
    assert pick(10, force=True) == [*pick(10), ("one", "3"), ("two", "9")] and pick(5, force=True) == pick(10, force=True)[:5] and pick(2, force=True) == pick(2)


@pytest.fixture
def notes_folder(tmp_path):
    root = tmp_path / "v"
    for path, text in {"b.md": "# B", "a.md": "# A", "x/1.md": "one", "x/2.md": "second", "y/z/3.md": "third", "y/n.txt": "no", ".hid/4.md": "hidden", "y/.h.md": "dot"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def limits(**most):
    return {**vault.LIMITS, **most}


def test_scan_within_limits(notes_folder):
    look = lambda **most: vault.discover(str(notes_folder), limits(**most))
    paths = ["a.md", "b.md", "y/.h.md", "y/z/3.md", "x/1.md", "x/2.md"]  # a folder's files, then its folders, last name first
    whole = look()
    assert [f.relative_path for f in whole.files] == paths and whole.complete and not whole.errors and whole.total_bytes == 23 and whole.entries == 11
    for most in ({"max_files": 2}, {"max_total_bytes": 8}, {"max_entries": 9}):
        some = look(**most)
        assert not some.complete and some.errors == [vault.LIMIT] and [f.relative_path for f in some.files] == paths[: len(some.files)] and len(some.files) < 6
    assert [f.relative_path for f in look(max_file_bytes=4).files] == paths[:3] and look(max_entries=4).files == []  # a file too large ends the scan
    assert look(max_files=6).complete and look(max_total_bytes=23).complete and look(max_entries=11).complete
    for name in ("l1", "l2", ".l3"):
        os.symlink(notes_folder / "x", notes_folder / name)
    assert look(max_errors=1).errors == [vault.LINK_FOUND] and look().errors == [vault.LINK_FOUND] * 2 and not look(max_errors=1).complete
    assert vault.discover(str(notes_folder / "none"), limits()).errors == [vault.MISSING]


def test_bounded_source(spark, notes_folder):
    rows = vault.bounded_scan(spark, str(notes_folder)).collect()
    assert {r["relative_path"]: r["text"] for r in rows} == {"a.md": "# A", "b.md": "# B", "y/.h.md": "dot", "y/z/3.md": "third", "x/1.md": "one", "x/2.md": "second"} and all(r["complete"] for r in rows)
    (notes_folder / "x" / "1.md").write_bytes(b"\xff\xfe")
    os.symlink(notes_folder / "a.md", notes_folder / "x" / "l.md")
    got = markdown.notes(vault.bounded_scan(spark, str(notes_folder), max_files=6)).collect()
    assert {r["relative_path"]: r["error"] for r in got} == {"a.md": None, "b.md": None, "y/.h.md": None, "y/z/3.md": None, "x/1.md": vault.READING, "x/2.md": None, None: vault.LIMIT}
    assert {r["relative_path"]: r["error"] for r in vault.bounded_scan(spark, str(notes_folder)).where("error is not null").collect()} == {"x/1.md": vault.READING, "x/l.md": vault.LINK_FOUND}
    assert [(r["error"], r["complete"]) for r in vault.bounded_scan(spark, str(notes_folder / "none")).collect()] == [(vault.MISSING, False)]
    os.makedirs(notes_folder / "empty")
    assert vault.bounded_scan(spark, str(notes_folder / "empty")).count() == 0
    for wrong in ({"max_files": 0}, {"most": 3}):
        with pytest.raises(Exception, match="limits of a scan"):
            vault.bounded_scan(spark, str(notes_folder), **wrong).collect()


def test_scan_of_an_address(spark, notes_folder, monkeypatch):
    """The way of stores other than folders, tried on an address of this machine."""
    address = f"file://{notes_folder}"
    here = vault.discover(str(notes_folder), limits())
    there = vault.discover(address, limits())
    assert [f[:2] for f in there.files] == [f[:2] for f in here.files] and there[1:] == here[1:]
    assert vault.discover(address, limits(max_entries=4)).errors == [vault.LIMIT] and vault.discover(address + "-none", limits()).errors == [vault.MISSING]
    reader = vault.VaultReader(address, limits())
    assert {r[0]: r[3] for p in reader.partitions() for r in reader.read(p)} == {r["relative_path"]: r["text"] for r in vault.bounded_scan(spark, address).collect()}


def test_conditions_open_only_what_they_ask_for(spark, notes_folder):
    reader = vault.VaultReader(str(notes_folder), limits(max_files=5))
    size = GreaterThan(("size",), 1)
    assert list(reader.pushFilters([StringStartsWith(("relative_path",), "x/"), size])) == [size]
    assert [(f.relative_path, p.complete) for p in reader.partitions() for f in p.files] == [("x/1.md", False)]  # the ceiling counts as before
    reader.conditions = []
    assert list(reader.pushFilters([In(("relative_path",), ("a.md", "x/2.md")), EqualTo(("relative_path",), "a.md")])) == []
    assert [f.relative_path for p in reader.partitions() for f in p.files] == ["a.md"]
    found = vault.bounded_scan(spark, str(notes_folder)).where(F.col("relative_path").startswith("y/") & (F.col("size") > 3))
    assert [r["relative_path"] for r in found.collect()] == ["y/z/3.md"]


def test_files_are_dealt_by_number_and_bytes(notes_folder, monkeypatch):
    monkeypatch.setattr(vault, "TASK_FILES", 4)
    monkeypatch.setattr(vault, "TASK_BYTES", 9)
    parts = [[f.relative_path for f in p.files] for p in vault.VaultReader(str(notes_folder), limits()).partitions()]
    assert parts == [["a.md", "b.md", "y/.h.md"], ["y/z/3.md", "x/1.md"], ["x/2.md"]]
