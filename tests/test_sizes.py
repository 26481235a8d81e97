"""What keeps queries within their limits on large tables, held against the rows they give."""

from pyspark.sql import functions as F

from mnemospark.operators import manifest, search, text_index
from mnemospark.plans import etl, index, stores, streams  # noqa: F401  (they register their queries)
from mnemospark.plans.queries import QUERIES
from mnemospark.sources import markdown, vault
from mnemospark.sources.change_log import ChangeLogReader


def test_a_plan_is_computed_once_a_row(spark):
    texts = [(0, "red ring", "AUTO"), (1, "the  latest red ring 2026-02-01", "AUTO"), (2, "root cause of what", "VECTOR_ONLY"), (3, None, "AUTO"), (4, "", "AUTO"), (5, "a is related to b! and more", "AUTO"), (6, "why?", None)]
    df = spark.createDataFrame(texts, "id long, text string, asked string")
    e = search.execution(F.col("asked"), search.retrieval_plan(F.col("text"), F.lit(5)), F.lit(5), F.lit(20))
    got = df.select("id", e.alias("e")).select("id", "e.strategy", "e.graph", "e.budget")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(0, "FTS_ONLY", False, 5), (1, "FTS_ONLY", False, 5), (2, "VECTOR_ONLY", True, 20), (3, "HYBRID", None, 20), (4, "HYBRID", False, 20), (5, "HYBRID", True, 20), (6, None, True, 20)]
    assert got._jdf.queryExecution().executedPlan().toString().count("root cause") == 1


def test_estimates_stay_small_where_steps_double(spark):
    """A chain of 60 into a ring of 5, a ring of 3 with a tail, a self link, and a chain that ends."""
    links = {i: i + 1 for i in range(60)} | {60 + i: 60 + (i + 1) % 5 for i in range(5)} | {100: 101, 101: 102, 102: 100, 103: 100, 110: 110} | {i: i + 1 for i in range(200, 240)}
    found = manifest.on_cycles(spark.createDataFrame(list(links.items()), "id long, next long"))
    assert sorted(r["id"] for r in found.collect()) == [60, 61, 62, 63, 64, 100, 101, 102, 110]
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**60
    assert manifest.on_cycles(spark.createDataFrame([(1, 2), (2, 3)], "id long, next long")).count() == 0
    assert manifest.on_cycles(spark.createDataFrame([], "id long, next long")).count() == 0


def test_texts_come_along_with_what_is_read_from_them(spark):
    files = spark.createDataFrame([("a.md", "# é", "x"), ("b.md", None, None), ("b.md", "---\n", "y")], "relative_path string, text string, more string")
    got = markdown.notes(files, keep=("text", "more")).select("relative_path", "text", "more", "error", F.size("headings").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == [("a.md", "# é", "x", None, 1), ("b.md", "---\n", "y", "FRONTMATTER_PARSE_ERROR", 0), ("b.md", None, None, None, 0)]
    assert "Join" not in QUERIES["d6_source_ranges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_snapshot_reads_more_files_than_the_usual_ceilings(spark, monkeypatch):
    want = QUERIES["s4_source_snapshot"](spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(vault, "LIMITS", vault.LIMITS | {"max_entries": 90, "max_files": 60, "max_total_bytes": 900})
    got = QUERIES["s4_source_snapshot"](spark, "/root/testdata/sf0.001").collect()
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey % 3 = 1").count()
    assert parts > 60 and len(got) == parts and sorted(got) == sorted(want)


def test_files_that_are_not_wanted_count(tmp_path):
    for name in ("a/1", "a/2", "b/1", "b/2"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.md").write_text("x")
    scan = vault.discover(str(tmp_path), vault.LIMITS | {"max_files": 3}, lambda p: p.startswith("a/"))
    assert [f.relative_path for f in scan.files] == ["a/1.md"] and scan.total_bytes == 3 and not scan.complete


def test_pages_of_a_stretch_are_read_once(spark, tmp_path, monkeypatch):
    log, reads, read = str(tmp_path / "log"), [], ChangeLogReader._read
    entries = lambda a, b: spark.range(a, b).selectExpr("id as sequence", "concat('c', id) as note")
    entries(1, 401).repartition(3).write.parquet(log)
    monkeypatch.setattr(ChangeLogReader, "_read", lambda self, *a: reads.append(a) or read(self, *a))
    reader = ChangeLogReader(entries(0, 1).schema, {"path": log, "max_rows": "10"})
    offset, got = reader.initialOffset(), []
    while page := list((found := reader.read(offset))[0]):
        assert len(page) == 10
        got, offset = got + page, found[1]
        if len(got) == 200:
            entries(401, 421).coalesce(1).write.mode("append").parquet(log)  # files that come meanwhile are seen
    assert got == [(i, f"c{i}") for i in range(1, 421)] and len(reads) <= 20


def test_notes_are_found_in_texts_as_by_an_index(spark, tmp_path):
    rows = [(1, "The cat of\n the of\n---", "the of", ["x"]), (2, "of the\n\nthen often, THE oft", None, ["The  OF", "the of"]), (3, None, "the of", None), (4, "", "", []), (5, "the\nof", "t", None), (6, "nothing", "n", ["n"]), (7, "of of the the theory official", "t", None)]
    notes = spark.createDataFrame(rows, "parent long, text string, title string, aliases array<string>")
    lines = index._lines(notes.withColumnRenamed("parent", "doc_id"))
    chunks = text_index.write_index(lines, str(tmp_path / "c"), "chunk", "text", "parent")
    parents = text_index.write_index(notes, str(tmp_path / "p"), "parent", "text")
    score = lambda df: [(r["parent"], round(r["score"], 9)) for r in df.collect()]
    for query in (" The  OF", "of", "the of n", "?"):
        assert score(text_index.note_search_in(notes, query, 5)) == score(text_index.note_search(chunks, parents, notes, query, 5))
    assert "Exchange" not in QUERIES["r4_chunk_and_note_rank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
