"""What may be in a pack and what it refers to; members of groups of copies; workspaces."""

from pyspark.sql import functions as F

from mnemospark.operators import filters, packs, rows


def test_eligible(spark):
    d = spark.createDataFrame([(1, "SAVED", False, None), (2, "SAVED", True, None), (3, "PENDING_REVIEW", False, None), (4, "REDACTED_AND_SAVED", None, "Current"), (5, "SAVED", None, "superseded"), (6, None, None, None), (7, "SAVED_WITH_WARNINGS", None, "ACTIVE"), (8, "saved", None, None)], "k int, s string, a boolean, l string")
    assert [r["k"] for r in d.where(packs.eligible(F.col("s"), F.col("a"), F.col("l"))).orderBy("k").collect()] == [1, 4, 7]


def test_references(spark):
    kind = "q string, c string, position int, score double, one array<string>, two array<string>"
    m = spark.createDataFrame([("q", "a", 1, 0.5, ["x", "y"], ["z", "x", " \t", None]), ("q", "b", 2, 0.9, None, ["y", "w" * 301]), ("q", "a", 3, 0.4, ["never"], None), ("p", "a", 1, 0.1, None, None), ("r", "a", 1, 0.1, [f"n{i:02}" for i in range(50)], [])], kind)
    found = {}
    for r in packs.evidence_references(packs.selected(m, "q", "c"), "q", ["one", "two"]).orderBy("q", "place").collect():
        found.setdefault(r["q"], []).append(r["reference"])
    assert found == {"q": ["y", "w" * 299 + "…", "x", "z"], "r": [f"n{i:02}" for i in range(20)]}
    assert [(r["c"], r["_n"]) for r in packs.selected(m.where("q = 'q'"), "q", "c", 1).collect()] == [("b", 1)]


def test_duplicate_members(spark):
    d = spark.createDataFrame([("h", 5), ("h", 2), ("h", 2), ("g", 1), ("k", 9), ("k", 8), ("k", 7), (None, 1), (None, 2), ("g", None)], "h string, i int")
    got = [tuple(r) for r in rows.duplicate_members(d.repartition(3), "h", "i").orderBy("h", "place").collect()]
    assert got == [("h", 1, 2), ("h", 2, 5), ("k", 1, 7), ("k", 2, 8), ("k", 3, 9)]
    assert rows.duplicate_members(d.limit(0), "h", "i").count() == 0


def test_workspaces(spark):
    d = spark.createDataFrame([(1, "w"), (2, ""), (3, None), (4, "v")], "k int, w string")
    kept = lambda w: [r["k"] for r in d.where(filters.in_workspace(F.col("w"), w)).collect()]
    assert kept("w") == [1] and kept(None) == [2, 3]
