"""Notes, links, plans and streams on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import graph, lint, linkage, packs, reconcile, retrieval, rows
from mnemospark.sources import markdown
from mnemospark.streaming import change_log, limits

NOTE = """---
title: A plan
tags: [x, 'y, z', [q]]
refs:
- one
- 2
count: 012
n: 12
ok: True
none: ~
---
intro
# First
text [[Target#Part|name]] and `[[no]]` ![[pic.png]]
```
# not a heading
[[hidden]]
```
## Second
more
"""


def test_analysis():
    a = markdown.analyse(NOTE)
    kinds = {e["key"]: (e["kind"], e["values"]) for e in a["frontmatter"]}
    assert kinds["tags"] == ("list", ["x", "y, z", "[q]"])
    assert kinds["refs"] == ("list", ["one", "2"])
    assert kinds["count"] == ("string", ["012"]) and kinds["n"] == ("integer", ["12"])
    assert kinds["ok"] == ("boolean", ["true"]) and kinds["none"] == ("null", [None])
    assert [(h["level"], h["text"]) for h in a["headings"]] == [(1, "First"), (2, "Second")]
    assert markdown.analyse("---\nx: 1\n")["error"] == "FRONTMATTER_PARSE_ERROR"
    assert markdown.analyse("---\nx: 1\nx: 2\n---\n")["error"] == "FRONTMATTER_PARSE_ERROR"
    text = "---\ntags:\n  - a\n  - 'it''s'\n  nested: no\n  -\nempty:\nx: (a, b)\ny: [(a, b), 'c\\', d', , \"q\"]\nf: 1.5e3\ng: 1e3\nh: -0.5\nnone: []\n---\n"
    kinds = {e["key"]: (e["kind"], e["values"]) for e in markdown.analyse(text)["frontmatter"]}
    assert kinds["tags"] == ("list", ["a", "it's", None]) and kinds["empty"] == ("list", []) and kinds["x"] == ("string", ["(a, b)"])
    assert kinds["y"] == ("list", ["(a, b)", "c\\', d", None, "q"]) and kinds["none"] == ("list", [])
    assert [kinds[k][0] for k in "fgh"] == ["string", "float", "float"]


def test_links_and_chunks():
    found = markdown.links(markdown.analyse(NOTE)["body"])
    assert [(x["kind"], x["target"], x["heading"], x["alias"]) for x in found] == [("wikilink", "Target", "Part", "name"), ("embed", "pic.png", None, None)]
    spans = markdown.cut_points("word " * 1000, 1400, 160)
    assert spans[0][0] == 0 and spans[-1][1] == 5000 and all(b - a <= 1400 for a, b in spans)
    assert all(x[1] >= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_vault(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hid").mkdir()
    (tmp_path / "a" / "n.md").write_text(NOTE)
    (tmp_path / "b.md").write_text("plain")
    (tmp_path / ".hid" / "c.md").write_text("no")
    files = markdown.scan(spark, str(tmp_path))
    got = {r["relative_path"]: r for r in markdown.notes(files).collect()}
    assert set(got) == {"a/n.md", "b.md"} and got["a/n.md"]["title"] == "A plan" and got["b.md"]["title"] == "b"
    some = markdown.scan(spark, str(tmp_path), max_bytes=len(NOTE) + 2).collect()
    assert [(r["relative_path"], r["complete"]) for r in some] == [("a/n.md", False)] and markdown.scan(spark, str(tmp_path), max_bytes=3).count() == 0
    assert {r["complete"] for r in markdown.scan(spark, str(tmp_path), max_bytes=9999).collect()} == {True}
    found = lambda **most: [(r["relative_path"], r["complete"]) for r in markdown.scan(spark, str(tmp_path), **most).orderBy("relative_path").collect()]
    assert found(max_files=1) == [("a/n.md", False)] and found(max_file_bytes=5) == [("b.md", False)] and found(max_file_bytes=4) == []
    assert found(max_files=2, max_file_bytes=9999, max_bytes=9999) == [("a/n.md", True), ("b.md", True)]
    with pytest.raises(ValueError):
        markdown.scan(spark, str(tmp_path), max_files=0)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    got = [(r["id"], r["lane"]) for r in retrieval.fuse(a, b, "id", 9).collect()]
    assert got == [(2, "vector"), (1, "lexical"), (3, "vector")]
    assert retrieval.lexical_match(spark.createDataFrame([("x",)], "t string"), "t", " ?").count() == 0


def test_components_of_a_chain(spark):
    nodes = spark.range(40)
    edges = spark.range(39).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src != 20")
    got = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(40)}


def test_targets(spark):
    nodes = spark.createDataFrame([(1, "a/x.md", "x"), (2, "b/x.md", "x"), (3, "c/y.md", "y")], "id long, path string, name string")
    edges = spark.createDataFrame([("a/x.md",), ("x",), ("Y.md",), ("z",)], "target_path string")
    got = {r["target_path"]: (r["dst"], r["state"]) for r in graph.resolve_targets(edges, nodes).collect()}
    assert got == {"a/x.md": (1, "RESOLVED"), "x": (None, "AMBIGUOUS"), "Y.md": (3, "RESOLVED"), "z": (None, "MISSING")}


def test_oversize_block(spark):
    items = spark.range(5).select(F.col("id").alias("item_id"), F.lit("h").alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"), F.array(F.lit("b")).alias("blocks"), F.array(F.lit("n")).alias("neighbours"), F.array(F.lit(-1).cast("long")).alias("ancestors"))
    assert linkage.candidate_pairs(items).count() == 10
    with pytest.raises(linkage.OversizeBlock):
        linkage.candidate_pairs(items, max_block=4)


def test_cap_is_greedy(spark):
    import random

    r = random.Random(2)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(150)})
    pairs = [(a, b, r.randrange(5) / 4) for a, b in pairs if a < b]
    for most in (1, 2, 4):
        used, want = {}, set()
        for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if used.get(a, 0) < most and used.get(b, 0) < most:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                want.add((a, b))
        got = linkage.capped(spark.createDataFrame(pairs, "left_id long, right_id long, score double"), most)
        assert {(x["left_id"], x["right_id"]) for x in got.collect()} == want


def test_open_intervals(spark):
    v = spark.createDataFrame([("a", 1, None, "2020-01-05"), ("a", 2, "2020-01-04", None), ("a", 3, "2020-01-06", "2020-01-07"), ("b", 4, "2020-01-06", "2020-01-07")], "k string, id int, s string, e string")
    v = v.select("k", "id", F.to_timestamp("s").alias("s"), F.to_timestamp("e").alias("e"))
    assert sorted((r["left_id"], r["right_id"]) for r in rows.overlapping_pairs(v, "k", "id", "s", "e").collect()) == [(1, 2), (2, 3)]


def test_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(300).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = change_log.deduplicated(spark.readStream.schema(schema).parquet(path), ["user_id", "event_type"], "ts", "1 hour")
    q = change_log.windowed_counts(stream, "ts", ["event_type"], "value", "1 hour", late=None).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").count() > 0


def test_relations(spark):
    claim = "struct<subject string, predicate string, object string, polarity boolean, qualifiers array<string>>"
    a = ("The  Sky", "is", "blue", True, ["now"])
    others = [a, ("the sky", "IS", "blue", True, []), ("the sky", "is", "red", True, []), ("sea", "has", "fish", True, []), None]
    df = spark.createDataFrame([(i, a, b) for i, b in enumerate(others)], f"n int, a {claim}, b {claim}")
    no, yes = F.lit(False), F.lit(True)
    e = F.when(F.col("b").isNotNull(), reconcile.claim_evidence(F.col("a"), F.col("b")))
    v = reconcile.classify(e, F.lit(0.2), same_hash=no, same_source=F.lit(None).cast("boolean"), compatible=yes, independent=yes, overlapping=yes, newer=no)
    got = df.select("n", v.alias("v")).select("n", "v.*").orderBy("n").collect()
    assert [(r["relation"], r["confidence"]) for r in got] == [("SUPPORTS", 0.98), ("EXTENDS", 0.9), ("CONTRADICTS", 0.96), ("UNRELATED", 0.9), ("UNRELATED", 0.75)]
    texts = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "x string, y string")
    assert [r[0] for r in texts.select(reconcile.text_ratio(F.col("x"), F.col("y"))).collect()] == [0.75, 1.0, None]


def test_redaction_and_lint(spark):
    rows_ = [(1, "password: hunter2 and AKIA" + "A" * 16), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, None), (4, "plain text about a password")]
    got = {r["n"]: r for r in lint.redacted(spark.createDataFrame(rows_, "n int, t string"), "t").collect()}
    assert got[1]["redacted_text"] == "[REDACTED] and [REDACTED]" and got[1]["n_redacted"] == 2
    assert got[2]["blocked"] and got[3]["redacted_text"] == "" and got[4]["n_redacted"] == 0 and not got[4]["blocked"]
    one = spark.createDataFrame([("USAGE", "t", "## Summary\nx\n## Evidence\ny", "s"), ("USAGE", "t", None, None)], "k string, t string, c string, s string")
    assert [(r["score"], r["status"]) for r in lint.lint(one, "k", "t", "c", "s").collect()] == [(100, "SAVED"), (36, "PENDING_REVIEW")]


def test_pack_budget(spark):
    m = spark.createDataFrame([("q", "a", 0, 0.5, "GLOBAL", "x" * 9), ("q", "b", 1, 0.9, "USER", "yy"), ("q", "a", 2, 0.5, "GLOBAL", "later")], "q string, c string, position int, score double, scope string, text string")
    got = [(r["c"], r["position"], r["section"], r["content"]) for r in packs.context_pack(m, "q", "c", budget=8).orderBy("position").collect()]
    assert got == [("b", 1, "Agent Context", "yy"), ("a", 2, "Project Context", "xxxxx…")]


def test_rate_limit(spark):
    calls = spark.createDataFrame([("u", i, t) for i, t in enumerate([0, 5, 9, 10, 25])] + [("v", 9, 5), (None, 10, 5)], "s string, n int, t int").withColumn("t", F.timestamp_seconds("t"))
    got = {r["n"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in limits.fixed_window(calls, "s", "t", "n", limit=2, seconds=10).collect()}
    assert got == {0: (True, 1, 10), 1: (True, 0, 5), 2: (False, 0, 1), 3: (True, 1, 10), 4: (True, 1, 10), 9: (True, 1, 10)}


def test_rate_limit_against_a_loop(spark):
    import random

    draw = random.Random(5)
    calls = sorted({(draw.choice("ab"), draw.randrange(-400, 4000) if draw.random() < 0.5 else draw.randrange(900, 1100)) for _ in range(300)})
    want, begin, n = {}, {}, {}
    for s, t in calls:
        if s not in begin or t >= begin[s] + 30:
            begin[s], n[s] = t, 0
        n[s] += 1
        want[s, t] = (n[s] <= 2, begin[s] + 30 - t)
    df = spark.createDataFrame(calls, "s string, n int").withColumn("t", F.timestamp_seconds("n")).repartition(3)
    got = limits.fixed_window(df, "s", "t", "n", limit=2, seconds=30).collect()
    assert {(r["s"], r["n"]): (r["allowed"], r["retry_after"]) for r in got} == want and len(got) == len(calls)


def test_delta_page(spark):
    log = spark.createDataFrame([(i, "x" * i) for i in range(1, 9)], "sequence int, c string")
    page = change_log.delta_page(log, None, most=5).orderBy("sequence").collect()
    assert [r["sequence"] for r in page] == [1, 2, 3, 4, 5] and page[0]["has_more"] and change_log.cursor_place(page[0]["next_cursor"]) == 5
    rest = change_log.delta_page(log, page[0]["next_cursor"], most=5).collect()
    assert sorted(r["sequence"] for r in rest) == [6, 7, 8] and not rest[0]["has_more"] and rest[0]["next_cursor"] == change_log.cursor_token(8)
    assert [r["sequence"] for r in change_log.delta_page(log, None, most_bytes=1).collect()] == [1]  # the first always comes
    assert change_log.delta_page(log, change_log.cursor_token(8)).count() == 0
    for bad, error in (("?", ValueError), (change_log.base64.urlsafe_b64encode(b"{}").decode(), ValueError), (change_log.base64.urlsafe_b64encode(b'{"v":2,"scope":"context-change-log","last_sequence":1}').decode(), LookupError)):
        with pytest.raises(error):
            change_log.delta_page(log, bad)


def test_lexical_match_at_word_begins(spark):
    docs = spark.createDataFrame([(1, "The theme, bathe the-the"), (2, "other"), (3, None), (4, ""), (5, "thethe the"), (6, "Éthe")], "k int, t string")
    assert {r["k"]: r["hits"] for r in retrieval.lexical_match(docs, "t", "THE").collect()} == {1: 4, 5: 2}
    assert retrieval.lexical_match(docs, "t", " ?").count() == 0


def test_case_metrics(spark):
    cases = spark.createDataFrame([("a", "MULTI_HOP_GRAPH", False, 2, ["r"], ["r", "q"], 2, 2), ("b", "SUPERSESSION", False, 1, [], [], 0, 0), ("c", "X", True, 0, [], [], 0, 0), ("d", "WRONG_PREMISE", False, 1, [], [], 0, 0)], "case string, query_class string, abstains boolean, least int, required array<string>, seen array<string>, least_distance int, seen_distance int")
    truth = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 9, False), ("d", 1, True)], "case string, item int, expected boolean")
    hits = spark.createDataFrame([("a", 7, 1), ("a", 1, 2), ("a", 2, 6), ("b", 9, 1), ("b", 1, 4)], "case string, item int, rank int")
    got = {r["case"]: r for r in retrieval.case_metrics(cases, truth, hits).collect()}
    assert [got["a"][k] for k in ("recall_1", "recall_3", "rr", "multi_hop", "wrong_memory", "obsolete_rate")] == [0.0, 1.0, 0.5, 0.0, 0.0, None]
    assert [got["b"][k] for k in ("superseded_leakage", "current_precision", "obsolete_rate", "wrong_memory", "recall_5")] == [1.0, 0.5, 0.5, 1.0, 1.0]
    assert [got["c"][k] for k in ("abstention", "wrong_memory", "recall_1", "rr", "ndcg_5")] == [1.0, 0.0, None, None, None]
    assert [got["d"][k] for k in ("wrong_premise", "rr", "ndcg_5", "wrong_memory")] == [0.0, 0.0, 0.0, 1.0]
    means = {r["query_class"]: r for r in retrieval.mean_metrics(retrieval.case_metrics(cases, truth, hits), "query_class").collect()}
    assert means["X"]["cases"] == 1 and means["X"]["recall_1"] is None and means["X"]["abstention"] == 1.0


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8)], "src int, dst int")
    assert {(r["id"], r["cycle"]) for r in graph.cycles(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert graph.cycles(edges.where("src = 0")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cycles_against_reach(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(14), r.randrange(14)) for _ in range((8, 14, 20, 30)[seed])]
    links += [(i, i + 1) for i in range(20, 29)] + [(29, 20)] + [(i, i + 1) for i in range(40, 46)] + [(46, 3), (5, 40)]  # a ring, a chain between two nodes
    links += [(50, 51), (51, 50), (50, 52), (52, 50), (60, 61), (62, 61), (61, 63)]
    ids = {x for link in links for x in link}
    to = {i: {b for a, b in links if a == i} for i in ids}
    for k in ids:
        for i in ids:
            if k in to[i]:
                to[i] |= to[k]
    want = {(i, min(j for j in ids if j in to[i] and i in to[j])) for i in ids if i in to[i]}
    edges = spark.createDataFrame(links + links[:5], "src long, dst long")
    got = graph.cycles(edges).collect()
    assert {(x["id"], x["cycle"]) for x in got} == want and len(got) == len(want)


def test_cycles_of_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, real = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or real(df))
    chain = spark.range(10_000).selectExpr("id as src", "id + 1 as dst")
    assert graph.cycles(chain).count() == 0 and len(rounds) < 40
    ring = chain.union(spark.createDataFrame([(10_000, 0)], "src long, dst long"))
    got = graph.cycles(ring).groupBy("cycle").count().collect()
    assert [(x["cycle"], x["count"]) for x in got] == [(0, 10_001)] and len(rounds) < 80


def test_plan_fingerprint(spark):
    from mnemospark.operators import manifest

    plan = spark.createDataFrame([(i, f"a{i % 3}", None) for i in range(40)], "path long, action string, more string")
    one, two = (manifest.plan_fingerprint(p).first() for p in (plan, plan.repartition(5).orderBy("action")))
    assert one == two and one["rows"] == 40
    assert manifest.plan_fingerprint(plan.where("path > 0")).first()["fingerprint"] != one["fingerprint"]


def test_canonical_names(spark):
    from mnemospark.operators import projection

    names = spark.createDataFrame([("Cafe\u0301",), ("CAF\u00c9",), ("stra\u00dfe",), ("STRASSE",)], "n string")
    got = [r[0] for r in names.select(projection.folded(F.col("n"))).collect()]
    assert got[0] == got[1] and got[2] == got[3] == "strasse"


def test_brief_budget(spark):
    from mnemospark.operators import briefs

    rows_ = [("q", 1, "h", "intro\n## Next Action\ngo", 0.9, 0), ("q", 2, "h", "x" * 50, 0.8, 1), ("q", 3, "h", "y", 0.7, 2)]
    m = spark.createDataFrame(rows_, "query string, context int, content_hash string, content string, score double, position int")
    had = m.where("context = 3").select("query", "context", "content_hash")
    got = {r["context"]: r for r in briefs.brief(m, had, byte_budget=40, record_budget=9).collect()}
    assert got[1]["content"] == "#### Next Action\ngo\nintro" and got[2]["content_bytes"] == 40 - got[1]["content_bytes"] and got[3]["state"] == "already_delivered"


def test_odd_calendars(spark):
    from mnemospark.operators import calendar

    p = spark.createDataFrame([("f", "2024-01-01", "2024-01-01")], "family string, day string, created string").withColumn("day", F.to_date("day"))
    with pytest.raises(ValueError):
        calendar.coverage(p, "2020-01-01", "2024-01-01", "2024-01-01")
    assert calendar.coverage(p.limit(0), "2024-01-01", "2024-01-05", "2024-01-03").count() == 0
