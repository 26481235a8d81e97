"""The stored indexes of words and vectors against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import text_index, vector_index

SF = "/root/testdata/sf0.001"


def rank_by_hand(text, tokens, whole=False):
    """Cover density by trying all runs; None where a token begins no word."""
    words = re.findall(r"\w+", (text or "").lower())
    hit = [[t for t in tokens if (w == t if whole else w.startswith(t))] for w in words]
    at = [i for i, h in enumerate(hit) if h]
    runs = []
    for i in at:
        for j in at:
            if i <= j and {t for h in hit[i : j + 1] for t in h} >= set(tokens):
                runs.append((i, j))
                break
    runs = [r for r in runs if not any(s != r and r[0] <= s[0] and s[1] <= r[1] for s in runs)]
    hits = sum(len(h) for h in hit)
    if len(tokens) == 1:
        return (hits, 0.1 * hits) if hits else None
    return (hits, sum(0.1 / (1 + sum(1 for h in hit[i : j + 1] if not h)) for i, j in runs)) if runs else None


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = "red redo ring rinse blue the theory them a an été".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "red " * 500 + "ring"), (203, "RED-ring, red.ring"), (204, "ring")]


@pytest.mark.parametrize("query", ["red", "red ring", "RE ri", "the them", "re red ring", "été a", "zzz red"])
def test_ranks_against_brute_force(spark, texts, tmp_path, query):
    index = text_index.write_index(spark.createDataFrame([*texts, (None, "red ring")], "k long, t string"), str(tmp_path / "i"), "k", "t")
    tokens = list(dict.fromkeys(query.lower().split()))
    for whole in (False, True):
        want = {i: rank_by_hand(t, tokens, whole) for i, t in texts}
        got = {r["doc"]: (r["hits"], r["rank"]) for r in text_index.ranks(index, query, whole).collect()}
        assert set(got) == {i for i, x in want.items() if x}
        assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in got)
    assert {r["doc"]: r["hits"] for r in text_index.counted(index, query).collect()} == {i: x[0] for i, x in ((i, rank_by_hand(t, tokens)) for i, t in texts) if x}


def test_best_skips_blocks_and_loses_none(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", 4)
    monkeypatch.setattr(text_index, "PROBED", 2)
    rows = texts + [(1000 + i, "red ring " * (1 + i % 3)) for i in range(60)]
    index = text_index.write_index(spark.createDataFrame(rows, "k long, t string"), str(tmp_path / "i"), "k", "t")
    for query in ("red ring", "red", "theory an"):
        tokens = query.split()
        want = sorted((-round(x[1], 9), i) for i, x in ((i, rank_by_hand(t, tokens)) for i, t in rows) if x)[:7]
        found, unread = text_index.best(index, query, 7)
        assert [r["doc"] for r in found.collect()] == [i for _, i in want]
        assert unread > 0 or query != "red"
    assert text_index.best(index, " ?! ", 5)[0].count() == 0 and text_index.counted(index, "").count() == 0


def test_chunks_or_parents(spark, texts, tmp_path):
    docs = spark.createDataFrame(texts, "k long, t string")
    lines = [(i * 10 + n, i, " ".join(w)) for i, t in texts if t for n, w in enumerate([t.split()[::2], t.split()[1::2]]) if w]
    parents = text_index.write_index(docs, str(tmp_path / "p"), "k", "t")
    chunks = text_index.write_index(spark.createDataFrame(lines, "c long, p long, t string"), str(tmp_path / "c"), "c", "t", "p")
    got = {r["chunk"]: r["rank"] for r in text_index.chunk_or_parent(chunks, parents, "red ring").collect()}
    want, whole = {}, {i: rank_by_hand(t, ["red", "ring"]) for i, t in texts}
    for c, p, t in lines:
        a, b = rank_by_hand(t, ["red", "ring"]), whole[p]
        if a or b:
            want[c] = (a[1] if a else 0) + 0.5 * (b[1] if b else 0)
    assert set(got) == set(want) and all(abs(got[c] - want[c]) < 1e-9 for c in got)
    empty = text_index.write_index(docs.limit(0), str(tmp_path / "e"), "k", "t")
    assert text_index.chunk_or_parent(empty, empty, "red").count() == 0


def test_index_is_written_once_and_texts_are_not_read(spark):
    from mnemospark.plans import index

    one, two = index.documents_index(spark, SF), index.documents_index(spark, SF)
    assert one.path == two.path != index.lines_index(spark, SF).path
    plan = text_index.chunk_or_parent(index.lines_index(spark, SF), one, "the of")._jdf.queryExecution().executedPlan().toString()
    assert "text:" not in plan and "MapIn" not in plan and "ArrowEval" not in plan and "GreaterThanOrEqual(token,the)" in plan


def vectors(seed, n, dims=16, groups=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    return centers[rng.integers(0, groups, n)] + rng.normal(scale=0.5, size=(n, dims))


@pytest.mark.parametrize("cell,block", [(4096, 1024), (16, 8)])
def test_nearest_against_brute_force(spark, tmp_path, monkeypatch, cell, block):
    monkeypatch.setattr(vector_index, "CELL", cell)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", block)
    v = vectors(1, 300)
    v[7] = v[5]
    rows = [(i, x.tolist(), "m" if i % 3 else "n") for i, x in enumerate(v)]
    odd = [(1000, None, "m"), (1001, [], "m"), (1002, [float("nan")] * 16, "m"), (None, [1.0] * 16, "m"), (1003, [1.0] * 15, "m")]
    index = vector_index.write_index(spark.createDataFrame(rows + odd, "id long, v array<double>, model string"), str(tmp_path / "i"), "id", "v", dims=16, keep=("model",))
    assert index.vectors.count() == 300
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = 1 - u @ u.T
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 300, 10)], "query long, vector array<double>")
    truth = {}
    for i in range(0, 300, 10):
        truth[i] = [j for _, j in sorted((round(d[i, j], 9), j) for j in range(300) if j != i)[:5]]
    got = {}
    for r in vector_index.nearest(index, queries, 5).collect():
        got.setdefault(r["query"], {})[r["place"]] = r["key"]
    assert {i: [got[i][p] for p in range(1, 6)] for i in got} == truth
    assert 1 <= index.probes < index.lists.count()
    found = vector_index.nearest(index, queries, 5, probes=index.probes)
    true = spark.createDataFrame([(i, j) for i, js in truth.items() for j in js], "query long, key long")
    r = vector_index.recall(found, true, 5).first()
    assert r["queries"] == 30 and r["recall"] >= 0.9
    one = [x["key"] for x in vector_index.search(index, v[4].tolist(), 6, keep=F.col("model") == "m").collect()]
    assert one == [j for _, j in sorted((d[4, j], j) for j in range(300) if j % 3)[:6]]
    assert vector_index.search(index, [], 6).count() == 0 and vector_index.search(index, v[4].tolist(), 1, probes=2).first()["key"] == 4


def test_recall_of_the_index_over_the_table(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vector_index.write_index(e, str(tmp_path / "i"), "vec_id", "embedding", dims=64)
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    truth = vector_index.nearest(index, queries, 10)
    r = vector_index.recall(vector_index.nearest(index, queries, 10, probes=index.probes), truth, 10).first()
    print("recall", r)
    assert r["queries"] == 40 and r["recall"] >= 0.9


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = vector_index.write_index(none, str(tmp_path / "i"), "id", "v", dims=4)
    assert index.vectors.count() == 0 and vector_index.search(index, [1.0, 0, 0, 0], 3).count() == 0
    assert vector_index.nearest(index, none.select(F.col("id").alias("query"), F.col("v").alias("vector")), 3).count() == 0
