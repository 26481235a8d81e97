"""Ranges, links and rendering of notes; walks from many seeds against brute force."""

import random

import numpy as np
import pytest

from mnemospark.operators import expansion, linkage
from mnemospark.sources import markdown

SIGNS = ["a", "b ", "\n", "\n\n", ". ", "é", "你", "𝄞", "\r\n", "# h\n", "## k\n", "```\n", "`", "%%", "<!--", "-->", "[[x]]", "![[y#z|q]]", "    ", "~~~~\n", " ", "﻿", "\t"]


def test_ranges_hold_what_they_say():
    r = random.Random(1)
    for _ in range(400):
        body = "".join(r.choice(SIGNS) for _ in range(r.randrange(60)))
        text = "---\nt: é\n---\n" + body
        a = markdown.analyse(text)
        base, raw = len(text) - len(a["body"]), text.encode()
        for x in markdown.with_ranges(markdown.chunks("T", a["body"], 20, 4), text, base):
            assert x["kind"] == "title_fallback" or text[x["start"] : x["end"]] == x["content"] == raw[x["byte_start"] : x["byte_end"]].decode() and x["content"] == x["content"].strip() != ""
        for x in markdown.with_ranges(markdown.links(a["body"]), text, base):
            piece = text[x["start"] : x["end"]]
            assert piece == raw[x["byte_start"] : x["byte_end"]].decode() and piece[0] == x["raw"][0] and piece.endswith("]]")


@pytest.mark.parametrize(
    "body,targets",
    [
        ("a 100%% b [[x]] c", ["x"]), ("<!-- open [[x]]", ["x"]), ("<!-- [[n]] --> [[y]] %% [[n]] %%", ["y"]), ("` [[x]]", ["x"]), ("`[[n]]` ``[[n]]`` [[x]]", ["x"]),
        ("````\n[[n]]\n```\n[[n]]\n````\n[[x]]", ["x"]), ("```\n[[n]]\n~~~\n[[n]]\n``` \n[[x]]", ["x"]), ("```\n[[n]]\n``` text\n[[n]]", []), ("\t[[n]]\n    [[n]]\n   [[x]]", ["x"]),
        ("[[a\nb]]", ["a\nb"]), ("[[a[b]]", ["a[b"]), ("[[a<!-- c -->b]]", ["ab"]), ("[[ ]]", [""]), ("[[#only]]", []), ("[[]]", []),
    ],
)
def test_links_of_a_body(body, targets):
    assert [x["target"] for x in markdown.links(body)] == targets


def test_chunks_of_a_body():
    c = markdown.chunks("T", "intro\n# A\none\n## B\ntwo\n# C\nthree")
    assert [(x["heading_path"], x["content"]) for x in c] == [(["T"], "intro"), (["A"], "# A\none"), (["A", "B"], "## B\ntwo"), (["C"], "# C\nthree")]
    assert [(x["content"], x["kind"], x["start"]) for x in markdown.chunks(" T ", " \n ")] == [("T", "title_fallback", 0)] and markdown.chunks("", "") == []
    assert all(x["content"] for x in markdown.chunks("T", "word" + " " * 5000 + "word", 100, 10))


def test_rendered_values_read_back(spark):
    texts = ["true", "NULL", "~", "12", "-3", "1.5", "2e7", "", " a", "a ", "'q'", "'", '"x"', "[a]", "{a}", "# no", "- x", "a: b", "two\nlines", "é", "---", None]
    rows = [(str(i), t, ["x" if t is None else t, "y"], [], i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "relative_path string, t string, l array<string>, e array<string>, n int")
    for r in markdown.notes(markdown.rendered(df, ["t", "l", "e", "n"], "t")).collect():
        got = {e["key"]: (e["kind"], e["values"]) for e in r["frontmatter"]}
        want = texts[int(r["relative_path"])]
        flat = None if want is None else want.replace("\n", " ")
        assert r["error"] is None and got["t"] == (("null", [None]) if want is None else ("string", [flat]))
        assert got["l"] == ("list", ["x" if want is None else flat, "y"]) and got["e"] == ("list", []) and got["n"] == ("integer", [r["relative_path"]])


def walk_by_hand(near, start, depth, most):
    seen, level = [(start, 0, None)], [start]
    for d in range(1, depth + 1):
        new = []
        for parent in level:
            for n in sorted(near.get(parent, ())):
                if n not in {x[0] for x in seen} and n not in {x[0] for x in new}:
                    new.append((n, d, parent))
        # neighbours of earlier visits come first, then ids
        new = new[: most - len(seen)]
        seen += new
        level = [x[0] for x in new]
    return [(x, d, i + 1, p) for i, (x, d, p) in enumerate(seen)]


def test_many_walks_against_brute_force(spark):
    r = random.Random(2)
    ids = [f"n{i:02d}" for i in range(60)]
    edges = [(f"e{i}", r.choice(ids), r.choice(ids[:30] if i % 3 else ids[:2]), "wikilink" if i % 5 else "cites") for i in range(200)]
    near = {}
    for _, a, b, kind in edges:
        if kind == "wikilink" and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    nodes = spark.createDataFrame([(i,) for i in ids], "note_id string")
    e = spark.createDataFrame(edges, "edge_id string, src string, dst string, relation string")
    seeds = [(q, p, ids[(7 * q + 13 * p) % 60]) for q in range(9) for p in (1, 2)] + [(99, 1, "nowhere")]
    jobs = {}
    for n in (2, len(seeds)):
        spark.sparkContext.setJobGroup(f"walks{n}", "walks")
        got = expansion.walks(nodes, e, spark.createDataFrame(seeds[-n:], "request int, seed_place int, seed string"), max_depth=3, max_visits=12).collect()
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walks{n}"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs[2] >= jobs[len(seeds)] - 3  # the depth tells how many, not the seeds
    for q, p, s in seeds[:-1]:
        mine = sorted(((x["place"], x["id"], x["depth"], x["parent"]) for x in got if (x["request"], x["seed_place"]) == (q, p)))
        assert mine == [(place, i, d, parent) for i, d, place, parent in walk_by_hand(near, s, 3, 12)]
    assert not [x for x in got if x["request"] == 99]
    visits = expansion.walks(nodes, e, spark.createDataFrame(seeds[:4], "request int, seed_place int, seed string"), max_depth=1)
    cut = {tuple(x) for x in expansion.truncated(visits, e).collect()}
    for q, p, s in seeds[:4]:
        reached = {s} | near.get(s, set())
        assert ((q, p) in cut) == any(n not in reached for x in reached for n in near.get(x, ()))


def test_neighbours_in_two_blocks_are_a_pair(spark):
    none = []
    rows = [("a", "h1", [1.0, 0.0], ["x"], ["b"], none), ("b", "h2", [1.0, 0.0], ["y"], ["a"], none), ("c", "h3", [0.0, 1.0], ["z"], ["gone"], ["a"])]
    items = spark.createDataFrame(rows, "item_id string, content_hash string, embedding array<double>, blocks array<string>, neighbours array<string>, ancestors array<string>")
    got = {(r["left_id"], r["right_id"]): r["reasons"] for r in linkage.candidate_pairs(items).collect()}
    assert got == {("a", "b"): ["vector_similarity", "temporal_overlap"], ("a", "c"): ["temporal_overlap", "lineage_structure"]}


@pytest.mark.parametrize("name", ["l1_candidates", "l1_evidence", "l4_clusters", "l12_linkage_recall"])
def test_linkage_of_ten_times_the_table(spark, tmp_path, name):
    from mnemospark.plans import compiling  # noqa: F401  (it registers queries)
    from mnemospark.plans.queries import QUERIES

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    more = e.crossJoin(spark.range(10)).selectExpr("vec_id * 10 + id as vec_id", "transform(embedding, (x, i) -> cast(x + 0.05 * sin(vec_id * 7 + id * 13 + i) as float)) as embedding", "label")
    more.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """sf0.01's vectors six times over, moved a little, some of them equal: about 300 of a label, and their pairs by hand."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    more = e.crossJoin(spark.range(6)).selectExpr("vec_id * 6 + id as vec_id", "transform(embedding, (x, i) -> cast(x + 0.3 * (id % 5) * sin(vec_id * 7 + id * 13 + i) as float)) as embedding", "label")
    path = str(tmp_path_factory.mktemp("grown"))
    more.coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in more.collect())
    ids, label, v = (np.array([r[k] for r in rows], dtype=t) for k, t in enumerate((int, int, float)))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    return path, ids, label, np.round(v @ v.T, 6)


def linked_by_hand(grown):
    path, ids, label, like = grown
    x, y = np.nonzero((label[:, None] == label[None, :]) & (ids[:, None] < ids[None, :]) & (like >= 0.3))
    return {(int(ids[a]), int(ids[b])): like[a, b] for a, b in zip(x, y, strict=True)}


def grown_rows(spark, grown, name):
    from mnemospark.plans import compiling  # noqa: F401  (it registers queries)
    from mnemospark.plans.queries import QUERIES

    return QUERIES[name](spark, grown[0]).collect()


@pytest.mark.parametrize("part", [2048, 70])
def test_l1_candidates_compares_whole_labels(spark, grown, monkeypatch, part):
    monkeypatch.setattr(linkage, "PART", part)
    got = {(r["left_id"], r["right_id"]): r["score"] for r in grown_rows(spark, grown, "l1_candidates")}
    want = linked_by_hand(grown)
    assert max(np.bincount(grown[2])) > 256 and len(want) > 3000
    assert got.keys() == want.keys() and all(abs(got[p] - s) <= 1e-6 for p, s in want.items())


def test_l4_clusters_join_whole_labels(spark, grown):
    low = {i: i for p in linked_by_hand(grown) for i in p}

    def first(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in linked_by_hand(grown):
        a, b = sorted((first(a), first(b)))
        low[b] = a
    assert {(r["item_id"], r["cluster"]) for r in grown_rows(spark, grown, "l4_clusters")} == {(i, first(i)) for i in low}


def test_l1_evidence_counts_whole_labels(spark, grown):
    _, ids, label, like = grown
    at = dict(zip(ids.tolist(), range(len(ids)), strict=True))
    where = {i: label[k] for i, k in at.items()}
    met = {(a, b) for a in at for b in at if a < b and where[a] == where[b]}
    met |= {(i - 1, i) for i in at if i - 1 in at} | {tuple(sorted((i, i % 2))) for i in at if where[i] % 2 == 0 and i > 1}
    want = {}
    for a, b in met:
        near, linked, descends = bool(like[at[a], at[b]] >= 0.3), bool(where[a] % 2 == 0 and where[b] % 2 == 0 and a % 2 == b % 2), b - a == 1
        if near or linked or descends:
            names = ["vector_similarity"] * near + ["temporal_overlap"] + ["graph_neighborhood"] * linked + ["lineage_structure"] * descends
            key = (",".join(names), where[a] == where[b])
            want[key] = want.get(key, 0) + 1
    assert {(r["reasons"], r["same_label"]): r["n"] for r in grown_rows(spark, grown, "l1_evidence")} == want


def test_l12_linkage_recall_ranks_whole_labels(spark, grown):
    near = {}
    for (a, b), s in linked_by_hand(grown).items():
        near.setdefault(a, []).append((-s, b))
        near.setdefault(b, []).append((-s, a))
    want = {(a, b, k) for a, x in near.items() for k, (_, b) in enumerate(sorted(x)[:3], 1)}
    assert {(r["item"], r["other"], r["place"]) for r in grown_rows(spark, grown, "l12_linkage_recall")} == want


def oddly(spark, tmp_path_factory):
    """Vectors of a label each that are like others, and one that is zero, not finite, short or lacks a component; their table and the SQL's database."""
    duckdb = pytest.importorskip("duckdb")
    nan, inf = float("nan"), float("inf")
    odd = [[0.0, 0.0, 0.0], [nan, 1.0, 0.0], [inf, 1.0, 0.0], [0.0, -inf, 1.0], [1.0, 0.1], [0.0, None, 0.2], [None, None, None], [], None, [None, 1.0], [-1.0, 0.0, 0.0]]
    near = [[1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.2], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(10 * k + n, v, k) for k, o in enumerate(odd) for n, v in enumerate([*near, o, *([o] if k % 2 else [])])]
    rows += [(900, near[0], None), (901, near[0], None)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as from '{path}/embeddings.parquet/*.parquet'")
    return path, db


def same_as_sql_on_odd_vectors(spark, tmp_path_factory, name):
    from mnemospark.plans.queries import SQL

    path, db = oddly(spark, tmp_path_factory)
    want = sorted(db.sql(SQL[name]).fetchall())
    assert len(want) > 40 and sorted(tuple(r) for r in grown_rows(spark, (path,), name)) == want


def copied(spark, path, n):
    """n copies of one vector and n of another in a label, and one that is like both."""
    spark.range(2 * n + 1).selectExpr("id as vec_id", f"case when id = {2 * n} then array(1f, 1f) when id < {n} then array(1f, 0f) else array(0f, 1f) end as embedding", "1 as label").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_l4_clusters_of_odd_vectors(spark, tmp_path_factory):
    same_as_sql_on_odd_vectors(spark, tmp_path_factory, "l4_clusters")


@pytest.mark.parametrize("part", [2048, 70])
def test_l4_clusters_in_parts(spark, grown, monkeypatch, part):
    monkeypatch.setattr(linkage, "PART", part)
    test_l4_clusters_join_whole_labels(spark, grown)


def test_l4_clusters_move_a_link_an_item(spark, tmp_path, monkeypatch):
    moved = []
    whole = linkage.clusters
    monkeypatch.setattr(linkage, "clusters", lambda items, pairs: moved.append(pairs.count()) or whole(items, pairs))
    got = grown_rows(spark, (copied(spark, tmp_path, 300),), "l4_clusters")
    assert {(r["item_id"], r["cluster"]) for r in got} == {(i, 0) for i in range(601)} and moved == [600]


def test_l12_linkage_recall_of_odd_vectors(spark, tmp_path_factory):
    same_as_sql_on_odd_vectors(spark, tmp_path_factory, "l12_linkage_recall")


@pytest.mark.parametrize("part", [2048, 70])
def test_l12_linkage_recall_in_parts(spark, grown, monkeypatch, part):
    monkeypatch.setattr(linkage, "PART", part)
    test_l12_linkage_recall_ranks_whole_labels(spark, grown)


def test_l12_linkage_recall_moves_the_best_of_a_cell(spark, tmp_path, monkeypatch):
    n, found = 150, linkage._by_block
    moved = spark.sparkContext.accumulator(0)

    class Cells:
        def __init__(self, cells):
            self.cells = cells

        def applyInArrow(self, f, schema):  # noqa: N802
            def counted(cell):
                out = f(cell)
                moved.add(len(out))
                return out

            return self.cells.applyInArrow(counted, schema)

    monkeypatch.setattr(linkage, "_by_block", lambda items: Cells(found(items)))
    got = {}
    for r in grown_rows(spark, (copied(spark, tmp_path, n),), "l12_linkage_recall"):
        got.setdefault(r["item"], {})[r["place"]] = r["other"]
    for i, places in got.items():
        low = range(n) if i < n else range(n, 2 * n)
        assert [places[k] for k in (1, 2, 3)] == [x for x in (range(2 * n) if i == 2 * n else low) if x != i][:3]
    assert len(got) == 2 * n + 1 and moved.value == 3 * len(got)


def test_near_neighbours_in_two_blocks(spark):
    rows = [("b", [1.0, 0.0], ["x", "y", None]), ("a", [1.0, 0.1], ["y", "x", "x"]), ("c", [1.0, 0.2], ["y"]), ("d", [1.0, 0.0], None), (None, [1.0, 0.0], ["x"])]
    items = spark.createDataFrame(rows, "item_id string, embedding array<double>, blocks array<string>")
    got = {(r["item"], r["other"], r["place"]) for r in linkage.near_neighbours(items, 0.3, 2).collect()}
    assert got == {("b", "a", 1), ("b", "c", 2), ("a", "b", 2), ("a", "c", 1), ("c", "a", 1), ("c", "b", 2)}
    assert {tuple(r) for r in linkage.near_clusters(items, 0.3).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
