"""Resampling, suffix sorting and ball k-means against brute force, on odd inputs and on empty tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import ball_kmeans, queries, resampling, suffix_sort
from mnemospark.llm.common import stored
from tests.llm.test_operators import frame, prose

SF = "/root/testdata/sf0.001"


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return w, [zlib.crc32(x) % 10_000 for x in w] + [zlib.crc32(a + b" " + b) % 10_000 for a, b in zip(w, w[1:], strict=False)]


ODD_TEXTS = [None, "", " \n\t ", "one", "A" * 300 + " b " + "c" * 64 + " " + "d" * 65, "été ß 你好 " * 30, "x-y_z.1", prose(7, 30_000, 5000), "é" * 5000]


def test_feature_buckets_against_zlib():
    texts = [(t or "").encode() for t in ODD_TEXTS]
    at = np.cumsum([0, *map(len, texts)])
    bucket, of = resampling.feature_buckets(np.frombuffer(b"".join(texts), dtype=np.uint8), at)
    for i, t in enumerate(ODD_TEXTS):
        assert sorted(bucket[of == i].tolist()) == sorted(features(t)[1])
    assert not len(resampling.feature_buckets(np.zeros(0, np.uint8), np.array([0, 0]))[0])


def resampled_by_hand(docs, target, percent=25, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for _, x in docs:
        for b in features(x)[1]:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    s_all, t_all = sum(s) + 10_000, sum(t) + 10_000
    gain = [math.floor(1000 * math.log((y + 1) * s_all / ((x + 1) * t_all))) for x, y in zip(s, t, strict=True)]
    out, fit = [], []
    for i, x in docs:
        w, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append((i, len(f), weight, score))
        if len(w) >= least:
            fit.append((-score, i is None, i or 0))
    return out, sorted(fit)[: percent * len(fit) // 100]


def test_resampling_against_brute_force(spark):
    docs = [(i, prose(i, r.randrange(1, 60), 90)) for r in [random.Random(3)] for i in range(150)]
    docs += [(200 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, prose(8, 50)), (5, docs[5][1]), (6, prose(99, 40))] + [(300, prose(4, 40))] * 40
    target = [prose(1000 + i, 30, 40) for i in range(5)] + [None, ""]
    d = frame(spark, docs).withColumn("score", F.lit("x")).withColumn("rank", F.lit("y"))
    got = resampling.resample(d, frame(spark, list(enumerate(target)))).collect()
    want, drawn = resampled_by_hand(docs, target)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert order([tuple(r)[:4] for r in got]) == order(want)
    ranked = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1)) and [r[1:] for r in ranked] == drawn
    assert resampling.resample(d.limit(0), d).count() == 0
    assert resampling.resample(d.where("doc_id < 3"), d.limit(0)).where("rank is not null").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_kth_key_against_sorting(spark, seed):
    r = random.Random(seed)
    span = [3, 10**6, 2**62][seed]
    rows = [(r.randrange(-span, span), r.randrange(-(2**63), 2**63) if r.random() < 0.7 else 5, i) for i in range(400)]
    df = stored(spark.createDataFrame(rows, "a long, b long, c long"), "kth")
    for k in (1, 2, 137, 400):
        assert resampling.kth_key(df, ["a", "b", "c"], k)[0] == list(sorted(rows)[k - 1])
    same = stored(spark.createDataFrame([(1, 2)] * 9 + [(1, 1)], "a long, b long"), "kth")
    assert resampling.kth_key(same, ["a", "b"], 4) == ([1, 2], 3)


def cut_by_hand(texts, window=100):
    """(bytes, removed, spans, left) of each (key, text), in the order given."""
    first, out = {}, {}
    for place, (i, t) in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first.setdefault(b[p : p + window], (place, p)) != (place, p):
                gone[p : p + window] = b"\1" * window
        out[i, t] = len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def spliced(seed, n):
    r = random.Random(seed)
    shared = [prose(100 + i, r.randrange(10, 60)) for i in range(6)] + ["a" * 150, "ab" * 90, "é" * 80]
    return [(i, " ".join([prose(1000 + i, r.randrange(0, 50), 50)] + [x for _ in range(2) for x in (r.choice(shared)[r.randrange(5) :], prose(r.randrange(10**6), 9))])) for i in range(n)]


def test_suffixes_against_brute_force(spark):
    texts = spliced(5, 70) + [(70, "a" * 400), (71, "x" * 99), (72, "x" * 100), (73, "x" * 101)]
    want = cut_by_hand(texts)
    got = suffix_sort.dedup(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        n, removed, spans, left = want[r["doc_id"], texts[r["doc_id"]][1]]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == (n, removed, spans, left)


def test_crowded_anchors_and_stretches_agree(spark, monkeypatch):
    texts = [(i, prose(i, 9) + " " + prose(77, 40) + " " + prose(500 + i % 7, 3, 5) + " " + prose(500 + i, 9)) for i in range(60)]
    want = {i: x[3] for (i, _), x in cut_by_hand(texts).items()}
    for anchor, shard, stretch in ((1, 5, 1 << 21), (3, 2000, 60), (20, 50, 500)):
        monkeypatch.setattr(suffix_sort, "ANCHOR_PIECES", anchor)
        monkeypatch.setattr(suffix_sort, "SHARD_PIECES", shard)
        monkeypatch.setattr(suffix_sort, "STRETCH", stretch)
        assert want == {r["doc_id"]: bytes(r["kept"]) for r in suffix_sort.dedup(frame(spark, texts)).collect()}


def test_late_suffixes_of_any_window():
    r = random.Random(2)
    for window in (1, 7, 8, 9, 16, 33):
        data = bytes(r.choice(b"ab") for _ in range(400))
        at = np.arange(len(data) - window + 1)
        seen, want = set(), []
        for p in at.tolist():
            want.append(data[p : p + window] in seen)
            seen.add(data[p : p + window])
        assert suffix_sort.late_suffixes(np.frombuffer(data, np.uint8), at, window).tolist() == want


def test_suffixes_edge_cases(spark):
    base = prose(1, 120)
    rows = [(0, None), (1, ""), (4, base), (5, base), (5, base), (6, base[:-3] + " zz"), (7, prose(2, 30_000, 5000)), (None, base), (None, None), (8, "été ß 你好 " * 30)]
    d = frame(spark, rows).withColumn("spans", F.lit(1)).withColumn("kept", F.lit(None))
    got = suffix_sort.dedup(d).collect()
    assert len(got) == len(rows) and suffix_sort.dedup(d.limit(0)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["n_bytes"] == 0 and by[7][0]["n_removed"] == 0
    assert {r["n_removed"] for r in by[5]} == {len(base)} and by[4][0]["kept"] == b"" and sorted(r["n_bytes"] for r in by[None]) == [0, len(base)]
    assert by[8][0]["n_removed"] > 0
    for window in (32, 233):
        with pytest.raises(ValueError):
            suffix_sort.dedup(d, window=window)


def kmeans_by_hand(rows, k=16, rounds=3):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    c = [v for _, v in sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        where = [near(v)[1] for _, v in rows]
        for i in range(len(c)):
            if mine := [v for (_, v), j in zip(rows, where, strict=True) if i == j]:
                c[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(((i is None, i or 0), *near(v)[::-1]) for i, v in rows), c


def test_ball_kmeans_against_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-2.0, -0.5, 0.25, 1.0]) + r.randrange(3) / 64 for _ in range(64)]) for i in range(200)]
    rows += [(300 + i, [float(i // 20)] * 64) for i in range(60)] + [(None, [0.5] * 64), (3, [9.0] * 64), (3, [9.0] * 64)]
    odd = [(400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 65), (404, [float("nan")] + [0.0] * 63), (405, [float("inf")] + [0.0] * 63), (406, [None] + [0.0] * 63)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("key", F.lit(1))
    got = ball_kmeans.ball_kmeans(d)
    want, centroids = kmeans_by_hand(rows)
    assert sorted(((x["vec_id"] is None, x["vec_id"] or 0), x["cluster"], x["distance"]) for x in got.vectors.collect()) == want
    assert got.centroids == centroids
    few = ball_kmeans.ball_kmeans(d.where("vec_id < 5"))
    assert few.vectors.count() == 7 and len(few.centroids) == 7
    for none in (d.limit(0), d.where("vec_id in (400, 401, 404)")):
        out = ball_kmeans.ball_kmeans(none)
        assert out.vectors.count() == 0 and out.centroids == []
    with pytest.raises(Exception, match="fit a long"):
        ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_balls_compare_less_and_choose_alike():
    rng = np.random.default_rng(1)
    centers = rng.integers(-60, 60, (16, 64))
    v = centers[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 64))
    v[:200] = (centers[:1] + centers[1:2]) // 2  # in the middle: on the edge of two balls
    for before in (np.argmin(ball_kmeans.distances(v, centers), axis=1), rng.integers(0, 16, 3000)):
        cluster, best, compared = ball_kmeans.reassign(v, before, centers)
        d = ball_kmeans.distances(v, centers)
        assert (cluster == np.argmin(d, axis=1)).all() and (best == d.min(axis=1)).all()
        assert compared < 3000 * 15
    wide = v * 2**20  # beyond exact doubles
    assert (ball_kmeans.distances(wide, centers) == ((wide[:, None] - centers[None]) ** 2).sum(axis=2)).all()


@pytest.mark.parametrize("name", ["op12_suffix_dedup", "op13_ball_kmeans"])
def test_new_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values.tolist())) == sorted(map(tuple, want.astype(str).values.tolist()))


def test_resampling_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want, drawn = resampled_by_hand(docs, target)
    rank = {i: n + 1 for n, (_, _, i) in enumerate(drawn)}
    assert sorted(tuple(r) for r in queries.op11_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", F.coalesce("rank", F.lit(0))).collect()) == sorted((*w, rank.get(w[0], 0)) for w in want)


def test_boilerplate_counts_documents_or_texts(spark):
    from mnemospark.llm import quality_rules

    own = "A line of its own, which no other text has, about " + prose(1, 60)
    rows = [(i, own) for i in range(60)] + [(100 + i, prose(200 + i, 80)) for i in range(5)]
    d = frame(spark, rows, source=lambda i: "s")
    each = {r["doc_id"]: (r["boilerplate_chars"] > 0, r["kept"]) for r in quality_rules.judge(d).collect()}
    once = {r["doc_id"]: (r["boilerplate_chars"] > 0, r["kept"]) for r in quality_rules.judge(d, copies_once=True).collect()}
    assert {each[i] for i in range(60)} == {(True, False)} and {once[i] for i in range(60)} == {(False, True)}
    assert {each[100 + i] for i in range(5)} == {(False, True)}
    assert {r["text"] for r in quality_rules.without_boilerplate(d).where("doc_id < 60").collect()} == {""}
    assert {r["text"] for r in quality_rules.without_boilerplate(d, copies_once=True).where("doc_id < 60").collect()} == {own}


def test_no_label_is_left_out(spark):
    from mnemospark.llm import byte_net

    rows = [(i, prose(i, 12), f"l{i % 600}") for i in range(1800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    sample = byte_net.labelled_sample(d, d.select("doc_id", "label"), key="doc_id", text="text", per_label=2, longest=1000)
    seen = [y for y, _ in sample]
    assert len(set(seen)) == 600 and max(map(seen.count, set(seen))) == 2
    few = byte_net.labelled_sample(d, d.select("doc_id", "label"), key="doc_id", text="text", per_label=2, longest=1000, rows_most=100)
    assert len(few) == 600
