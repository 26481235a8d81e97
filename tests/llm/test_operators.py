"""The training-data operators on small fixtures: against brute force, exact round trips, edge cases."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import html_text, language, media, minhash, mixing, packing, quality, quality_rules, substring, token_output, word_hash, word_ids
from mnemospark.llm.common import shared_path, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, label int, key string"
TOKENS = tokenizer_path("word_bpe_49k.json")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts, **more):
    rows = [(i, t, "en", more.get("source", lambda i: f"s{(i or 0) % 3}")(i), 0, 7, 1, "k") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    base = prose(1, 120)
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, base), (5, base), (5, base), (6, base[:-3] + " zz"), (7, prose(2, 30_000, 5000)), (None, base), (None, None), (8, "été ß 你好 " * 30), (9, base + "\n" + prose(3, 60))]
    rows = [(i, t, None, None if i == 4 else "s", None, None, None, None) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_passages_against_brute_force(spark):
    r = random.Random(5)
    shared = [prose(100 + i, r.randrange(20, 70)) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(1000 + i, r.randrange(0, 60), 50)] + [x for _ in range(2) for x in (r.choice(shared), prose(r.randrange(10**6), 15))]
        texts.append((i, " ".join(parts)))
    texts.append((60, "a " * 90))
    got = {x["doc_id"]: x for x in substring.dedup(frame(spark, texts)).collect()}
    first = {}
    for i, t in texts:
        w = t.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t in texts:
        w = t.split()
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i, k) for j in range(k, k + 20)}
        assert got[i]["n_removed"] == len(gone)
        assert got[i]["kept_words"] == " ".join(x for j, x in enumerate(w) if j not in gone)


def test_crowded_anchors_agree_with_automata(spark, monkeypatch):
    texts = [(i, prose(i, 9) + " " + prose(77, 40) + " " + prose(500 + i % 7, 3, 5) + " " + prose(500 + i, 9)) for i in range(60)]
    one = {r["doc_id"]: r["kept_words"] for r in substring.dedup(frame(spark, texts)).collect()}
    for most in (1, 3, 20):  # anchors of 13 words, then whole windows
        monkeypatch.setattr(substring, "ANCHOR_PIECES", most)
        assert one == {r["doc_id"]: r["kept_words"] for r in substring.dedup(frame(spark, texts)).collect()}
    want = passages_by_hand(texts)
    assert one == {i: want[i, t][1] for i, t in texts}


def passages_by_hand(texts, window=20):
    """(removed words, words left) of each (key, text), in the order given."""
    first, out = {}, {}
    for place, (i, t) in enumerate(texts):
        w = t.split()
        gone = set()
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), (place, k)) != (place, k):
                gone |= set(range(k, k + window))
        out[i, t] = len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)
    return out


def test_passages_edge_cases(odd, empty):
    got = substring.dedup(odd).collect()
    assert len(got) == odd.count() and substring.dedup(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["n_words"] == 0 and by[1][0]["kept_words"] == "" and by[7][0]["n_removed"] == 0
    assert {r["n_removed"] for r in by[5]} == {120} and by[4][0]["n_removed"] == 120  # the null key comes first
    assert by[9][0]["n_removed"] == 120
    for window in (5, 65):
        with pytest.raises(ValueError):
            substring.dedup(odd, window=window)


def test_passages_of_repeated_rows_and_null_keys(spark):
    base, shared = prose(1, 600, 5000), prose(2, 30)
    rows = [(7, base)] * 1000 + [(None, base + " z")] * 300 + [(None, f"{shared} {prose(50 + i, 5)}") for i in range(20)]
    got = substring.dedup(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got if r["n_words"] > 100) == [(0, 0)] * 300 + [(7, 600)] * 1000
    few = [r for r in got if r["n_words"] < 100]
    assert len(few) == 20 and sum(r["n_removed"] == 0 for r in few) == 1 and all(r["n_removed"] in (0, 30) for r in few)


def test_passages_of_few_words(spark):
    for n in range(1, 7):
        got = substring.dedup(frame(spark, [(0, "a b c d e f"[: 2 * n - 1])]).coalesce(1)).collect()
        assert [(r["n_words"], r["n_removed"], r["kept_words"]) for r in got] == [(n, 0, "a b c d e f"[: 2 * n - 1])]
    long = "word " * 220_000  # over 1 MB: a slice of its own, so the short text beside it is one too
    for texts in ([(0, "a b c"), (1, long)], [(0, long), (1, "a b c")]):
        got = {r["doc_id"]: r for r in substring.dedup(frame(spark, texts).coalesce(1)).collect()}
        assert {got[i]["n_words"]: got[i]["n_removed"] for i in got} == {3: 0, 220_000: 219_999}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for g in range(12):
        base = prose(g, 90).split()
        for _ in range(10):
            w = list(base)
            for _ in range(r.randrange(0, 9)):
                w[r.randrange(len(w))] = f"x{r.randrange(30)}"
            texts.append((len(texts), " ".join(w).replace("w1", "W1") if r.random() < 0.2 else " ".join(w)))
    got = {x["doc_id"]: x for x in minhash.components(frame(spark, texts)).collect()}
    sets = {i: set(zip(t.lower().split(), t.lower().split()[1:], strict=False)) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (x["component_id"], x["n_shingles"]) for i, x in got.items()} == {i: (find(i), len(sets[i])) for i in sets}


def test_near_duplicates_edge_cases(odd, empty):
    got = minhash.components(odd).collect()
    assert len(got) == odd.count() and minhash.components(empty).count() == 0
    by = {(r["doc_id"], r["n_shingles"] > 0): r for r in got}
    assert by[0, False]["component_id"] == 0 and by[5, True]["component_id"] == 4 and by[6, True]["component_id"] == 4
    assert by[None, True]["component_id"] is None and by[3, True]["n_shingles"] == 1


@pytest.mark.parametrize("union,common", [(360, 288), (35, 28), (370, 315)])
def test_bands_find_pairs_at_the_threshold(union, common):
    """Of 3,000 pairs at 0.8 and 0.85 none is without a shared band, and pairs share as many as
    independent values would: minima and maxima of one permutation can be counted as two."""
    rng, n = np.random.default_rng(7), 3000
    grams, left = rng.integers(0, 2**63, (n, union), dtype=np.uint64), common + (union - common) // 2
    sides = [grams[:, :left], np.concatenate([grams[:, :common], grams[:, left:]], axis=1)]
    keys = [minhash.band_keys(np.sort(s, axis=1).ravel(), np.full(n, s.shape[1]), minhash.ROWS, minhash.BANDS) for s in sides]
    shared = (keys[0] == keys[1]).sum(axis=1)
    p = (common / union) ** minhash.ROWS
    assert shared.min() > 0
    assert abs(shared.mean() / (minhash.BANDS * p) - 1) < 0.03 and shared.var() < 1.15 * minhash.BANDS * p * (1 - p)


def test_chain_of_links(spark):
    e = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 17 != 16")
    got = {r["node"]: r["root"] for r in minhash.connected(e, "test").collect()}
    assert got == {i: (i // 17) * 17 for i in range(51)}


def test_planes():
    for ids in ([], [0], [2**32 - 1, 5], list(range(1000)) * 3):
        for unit in (1, 8):
            packed = token_output.pack_planes(np.array(ids, dtype=np.uint32), unit=unit, block=256)
            assert token_output.unpack_planes(packed).tolist() == ids


def test_word_ids_are_the_library_s():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    texts = ["It's Don't STOP!! a,b. x|y <|endoftext|> <|endoftext|>. end", "", " \x1c!\x1c ", "Été ſ İ ΑΣ ", "naïve x 12.5%***  z", "o'clock's. 'tis''s,"]
    ids, n = word_ids.WordIds(TOKENS, 2).encode([x.encode() for x in texts])
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_table_keeps_words_that_come_again():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(TOKENS), word_ids.WordIds(TOKENS, 2, most=300)
    for k in range(12):
        texts = [f"The house, THE House! été x{k}y {k}-{k} " + " ".join(f"w{'abcdefghij'[j % 10]}{'klmnopqrst'[k % 10]}{j}q{k}." for j in range(40)), "the house", ""]
        ids, n = coder.encode([t.encode() for t in texts])
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
        assert coder.known <= 300 + 2 * 60
    while coder.known <= 300:
        coder.encode([(" ".join(f"house, the {coder.known}-{j}" for j in range(40))).encode()])
    ids, _ = coder.encode([b"zebra"])  # the table was full: words met again stay, others go
    assert ids.tolist() == [*library.encode("zebra", add_special_tokens=False).ids, 2]
    assert coder.known <= 160 and b"house," in coder.codes and b"the" in coder.codes


def test_word_table_takes_little_memory():
    import tracemalloc

    coder = word_ids.WordIds(TOKENS, 2)
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}orem{'aeiouvwx'[i // 64 % 8]}{'bcdfghjk'[i // 512 % 8]}{'lmnpqrst'[i // 4096 % 8]}" for i in range(k, 32768, 8)) for k in range(8)]
    tracemalloc.start()
    try:
        for t in texts:
            coder.encode([t.encode()])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 250 * 32768
    assert word_ids.WordIds(TOKENS, 2).most * 250 <= 125_000_000  # a worker's table


@pytest.mark.parametrize("kind", ["word_bpe", "cased", "crosses_spaces", "no_pieces", "plain_special"])
def test_word_ids_of_other_tokenizers(tmp_path, kind):
    from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers

    path = TOKENS
    if kind != "word_bpe":
        signs = [chr(i) for i in range(33, 127)] + ["Ġ", "é", "the", "The", "b,", " "]
        model = models.BPE(vocab={s: i for i, s in enumerate(signs + ["?u", "th", "Th"])}, merges=[("t", "h"), ("T", "h"), ("th", "e"), ("Th", "e"), ("b", ",")], unk_token="?u")
        t = Tokenizer(model)
        if kind == "plain_special":
            t.normalizer = normalizers.Lowercase()
            t.add_special_tokens([AddedToken("[END]", normalized=False)])
        if kind != "no_pieces":
            t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False) if kind == "crosses_spaces" else pre_tokenizers.WhitespaceSplit()
        t.enable_truncation(5)
        t.save(path := str(tmp_path / "t.json"))
    coder, t = word_ids.WordIds(path, 7), Tokenizer.from_file(path)
    t.no_truncation()
    assert (coder.whole, coder.folds, coder.marks) == {
        "word_bpe": (False, True, True), "cased": (False, False, False), "crosses_spaces": (True, False, True), "no_pieces": (True, False, False), "plain_special": (False, False, False),
    }[kind]
    texts = ["The the THE a b, ab. AB.", "", "  ", " x\ty [END] [END]x. é", "the " * 50]
    ids, n = coder.encode([x.encode() for x in texts])
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids + [7] for x in texts]


def test_token_files(spark, odd, empty):
    path = shared_path(spark, "test-ids")
    token_output.write_ids(odd, path, TOKENS, chunk_ids=3000, block=1024)
    got = sorted(token_output.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    token_output.write_ids(empty, path + "e", TOKENS)
    assert token_output.read_ids(spark, path + "e").count() == 0


def test_packing(odd, empty):
    got = sorted(packing.pack(odd, TOKENS, length=256).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    fill = {}
    for r in got:
        assert r["offset"] == fill.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 256 for s, n in fill.items() if s != max(fill)) and packing.pack(empty, TOKENS).count() == 0
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == next(r["doc_tokens"] for r in got if r["doc_id"] == 7)


def test_hilbert_curve_is_one_step_at_a_time():
    g = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    key = packing.hilbert_key(g, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_mixing(spark, odd, empty):
    d = frame(spark, [(i, prose(i, 20 + i % 50)) for i in range(400)])
    got = mixing.mix(d).toPandas()
    totals = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(totals.taken - totals.target) <= 1).all() and (got.taken <= 2 * got["size"]).all()
    assert abs(totals.target.sum() - 1.5 * totals["size"].sum()) < 1 and (totals.target <= 2 * totals["size"]).all()
    assert got.sort_values("doc_id").taken.tolist() == mixing.mix(d.repartition(7)).toPandas().sort_values("doc_id").taken.tolist()
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0
    rows = mixing.mixed_rows(d)
    assert rows.count() == int(np.ceil(got.taken / got["size"]).sum())


def test_targets_fill_up_level(spark):
    t = spark.createDataFrame([("=a", "a", 100), ("=b", "b", 1000), ("=c", "c", 10)], "_s string, source string, source_size long")
    got = {r["source"]: round(r["target"], 6) for r in mixing.source_targets(t, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == {"a": 200.0, "b": 1445.0, "c": 20.0}


def test_targets_of_tied_sources(spark):
    t = spark.createDataFrame([(f"={c}", c, 100) for c in "abcdef"], "_s string, source string, source_size long")
    got = {r["source"]: round(r["target"], 6) for r in mixing.source_targets(t, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == {"a": 200.0, "b": 166.666667, "c": 83.333333, "d": 200.0, "e": 166.666667, "f": 83.333333}


def test_rules(spark, odd, empty):
    line = "A line that everybody has, 2024 edition of it"
    d = frame(spark, [(i, "\n".join([f"{line} {i % 10}"] * 8 + [prose(i, 60 if i % 2 else 4)])) for i in range(80)], source=lambda i: "s")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    assert not got[1]["kept"] and got[1]["base_failed"]  # eight times one line
    d = frame(spark, [(i, f"{line} {i}\n" + " ".join(f"q{chr(97 + i // 10)}{chr(97 + i % 10)}{chr(97 + j // 10)}{chr(97 + j % 10)}" for j in range(60))) for i in range(80)] + [(99, f"{line} 17\n{line.upper()} 18\n" + prose(9, 40).replace(" ", " \t"))], source=lambda i: "s")
    got = {r["doc_id"]: r for r in quality_rules.judge(d).collect()}
    assert got[15]["kept"] and got[15]["boilerplate_chars"] > 0 and got[99]["boilerplate_chars"] == 2 * len((line + "17").replace(" ", ""))
    assert quality_rules.judge(odd).count() == odd.count() and quality_rules.judge(empty).count() == 0
    left = {r["doc_id"]: r["text"] for r in quality_rules.without_boilerplate(d).collect()}
    assert left[99] == prose(9, 40).replace(" ", " \t") and line not in left[15] and left[15].count(" ") == 59
    assert quality_rules.without_boilerplate(odd).columns == odd.columns and quality_rules.without_boilerplate(odd).count() == odd.count()


def test_classifiers(spark, odd, empty):
    r = random.Random(8)
    clean, junk = (lambda i: prose(i, 80)), (lambda i: " ".join(r.choice(["$$$", "BUY!!", "%%%"]) + str(j) for j in range(60)))
    d = frame(spark, [(i, (clean if i % 2 else junk)(i)) for i in range(300)])
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    net = quality.train(d, labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(d, net).collect()}
    assert np.mean([(got[i] > 0.5) == bool(i % 2) for i in range(200, 300)]) > 0.95
    assert quality.score(odd, net).count() == odd.count() and quality.score(empty, net).count() == 0
    assert quality.train(empty, labels) is None and quality.score(odd, None).count() == odd.count()
    d = spark.createDataFrame([(i, " ".join(r.choice("der die und nicht" .split() if i % 2 else "the of and with".split()) for _ in range(60)), "de" if i % 2 else "en") for i in range(200)], "doc_id long, text string, lang string")
    net = language.train(d.where("doc_id < 100"))
    got = {x["doc_id"]: x for x in language.identify(d, net).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") and 0 <= got[i]["score"] <= 1 for i in range(100, 200))
    found = language.identify(odd, net)
    assert found.count() == odd.count() and {x["lang_pred"] for x in found.where("doc_id in (0, 1, 2)").collect()} == {"und"}
    assert language.identify(empty, net).count() == 0 and language.train(empty) is None


def test_long_texts_are_learned_from(spark):
    r = random.Random(4)
    text = lambda words, n: " ".join(r.choice(words.split()) for _ in range(n))
    rows = [(i, text("der die und nicht", 60), "de") for i in range(400)] + [(1000 + i, text("the of and with", 9000), "en") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(d)
    assert net.classes == ["de", "en"]
    assert {(x["doc_id"] < 1000, x["lang_pred"]) for x in language.identify(d, net).collect()} == {(True, "de"), (False, "en")}
    labels = d.select("doc_id", (F.col("doc_id") >= 1000).cast("int").alias("quality"))
    net = quality.train(d, labels)  # all of label 1 are long
    scores = {x["doc_id"]: x["score"] for x in quality.score(d, net).collect()}
    assert min(s for i, s in scores.items() if i >= 1000) > max(s for i, s in scores.items() if i < 1000)
    net = quality.train(d.where("doc_id >= 1000"), labels.union(spark.createDataFrame([(1001, 0)], "doc_id long, quality int")))
    assert net is not None


def test_spread_windows(spark):
    from mnemospark.llm.byte_net import labelled_sample

    long = "".join(chr(97 + i // 1000) for i in range(26_000))
    d = spark.createDataFrame([(1, long), (1, long), (2, "short"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "doc_id long, label string")
    got = dict(sorted((t[:1], t) for _, t in labelled_sample(d, marks, key="doc_id", text="text", per_label=9, longest=2560)))
    assert set(got) == {b"", b"s", b"a"} and len(got[b"a"]) == 2560 and got[b"a"].endswith(b"z") and len(set(got[b"a"])) >= 10


def test_languages_that_were_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned, net = docs.where("doc_id % 2 = 0"), None
    net = language.train(learned, none=True)
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa.",
        "Все люди рождаются свободными и равными в своем достоинстве.", "人人生而自由,在尊严和权利上一律平等。", "for (int i = 0; i < n; i++) { if (x[i] != 0) { y += x[i] * k; } }", "deadbeef00ff12a4c3d2e1f09a8b7c6d5e4f", "=====-----*****=====a",
    ]
    found = language.identify(frame(spark, list(enumerate(foreign))), net, whole=True).collect()
    assert {r["text"] for r in found if r["lang_pred"] != "und"} == set()
    held_out = language.identify(docs.where("doc_id % 2 = 1"), net)
    assert held_out.where("lang_pred = 'und'").count() <= 0.005 * held_out.count()


def test_pipeline_keeps_nameless_documents(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, prose(i, 80)) for i in range(20)] + [(None, prose(i, 80)) for i in (30, 31, 31, 5)] + [(None, prose(3, 30) + " " + prose(77, 50))]
    docs = frame(spark, texts, source=lambda i: "s").withColumn("source", F.when(F.col("doc_id").isNull(), F.col("text")).otherwise("s")).select("doc_id", "text", "lang", "source", "n_chars")
    want = {prose(30, 80), prose(31, 80), prose(3, 30) + " " + prose(77, 50)}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = [(r["text"], r["source"]) for r in docs.where("doc_id is null").collect()]
    assert len(seen["language"]) == 5
    assert sorted(t for t, _ in seen["near_duplicates"]) == sorted(want)
    assert sorted(seen["repeated_passages"]) == sorted((t if t != prose(3, 30) + " " + prose(77, 50) else prose(77, 50), t) for t in want)
    assert {t for t, _ in seen["mixing"]} <= {t for t, _ in seen["repeated_passages"]} and seen["mixing"]


def test_equal_nameless_rows_keep_the_same_one(spark):
    import corpus_pipeline

    rows = [(None, prose(3, 40), lang, source, 1) for source in ("c", "a", "b") for lang in ("de", "en")] + [(None, None, "x", "y", 1)] * 2 + [(None, " ", "x", "y", 1)] * 2
    for part in (1, 4):
        docs = spark.createDataFrame(rows[::-1] if part > 1 else rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(part)
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert [(r["lang"], r["source"]) for r in got if r["text"] == prose(3, 40)] == [("de", "a")]
        assert len(got) == 5


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="ad">Buy this, buy that, buy it all.</div><article><h1>Title &amp; more</h1><p>First   paragraph, with commas, and
    text that goes on for a while, as they do.<p>Second one, without an end tag, and also of some length, I think.<ul><li>an item<li>another</ul></article>
    <div id="comments"><p>I agree, wholly, with all of this, and more, and then some.</p></div><footer>Legal, notices, imprint, and so on and on.</footer></body></html>"""
    want = "Title & more\n\nFirst paragraph, with commas, and text that goes on for a while, as they do.\n\nSecond one, without an end tag, and also of some length, I think.\n\nan item\n\nanother"
    assert html_text.main_text(page) == want
    assert html_text.main_text("") == "" and html_text.main_text("just text") == "just text" and html_text.main_text("<p>a<b>b</b> &lt;c") == "ab <c"
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", "<p>")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract(d).orderBy("page_id").collect()] == ["", want, ""]
    assert html_text.extract(d.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    n = 1 << 18
    kinds = ["<a ", '<a "', "<a x='", "<p", "<!", "<!--", "<![CDATA[", "</p>", "<div>", "<div><p>a, b", "<li>", "<div><li>", "<td>", "&amp", "<b x=y", "a=", '<div class="ad" ', "<script>", "<p>text, and more of it, for a block that counts</p></div>"]
    for kind in kinds:
        page = (kind * (n // len(kind) + 1))[:n]
        for p in (page, page + ">", page + '">'):
            begin = time.process_time()
            html_text.main_text(p)
            assert time.process_time() - begin < 4, kind  # a quarter of a second alone; quadratic time would be minutes


def test_pages_edge_cases(spark):
    page = "<article>" + "<p>A paragraph, of some length, with commas, number {}.</p>" * 30_000 + "</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, "u", "", None), (3, None, "<p>a <b>b", "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [len(r["text"]) for r in got] == [30_000 * 54 - 2] * 2 + [0, 3] and got[0].asDict().keys() == {"page_id", "url", "text"}


def test_media(spark, odd, empty):
    g = np.arange(70, dtype=np.uint8).reshape(7, 10)
    c = np.stack([g, g + 1, g + 2], axis=2)
    assert (media.decode_image(media.encode_netpbm(g)) == g).all() and (media.decode_image(media.encode_netpbm(c)) == c).all()
    assert media.decode_image(b"P2 # note\n2 2 15\n0 15 5 10\n").tolist() == [[0, 255], [85, 170]]
    assert media.decode_image(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]] and media.decode_image(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    bmp = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    rows = bytes([1, 2, 3, 4, 5, 6, 0, 0]) + bytes([7, 8, 9, 10, 11, 12, 0, 0])
    assert media.decode_image(bmp + rows).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    for bad in (b"", b"P5\n9 9\n255\n1", b"GIF89a", bmp):
        with pytest.raises(ValueError):
            media.decode_image(bad)
    assert np.allclose(media.area_resized(g.astype(float), 7, 5), g.reshape(7, 5, 2).mean(axis=2)) and abs(media.area_resized(g.astype(float), 3, 4).mean() - g.mean()) < 1e-9
    paletted = lambda pixel: b"BM" + (62).to_bytes(4, "little") + bytes(4) + (62).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(24) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + bytes([pixel, 0, 0, 0])
    assert media.decode_image(paletted(1)).tolist() == [[[6, 5, 4]]]
    images = spark.createDataFrame([(1, paletted(0)), (2, paletted(9)), (3, None), (4, b"P5\n0 0\n255\n")], "id int, image binary")
    path = shared_path(spark, "test-tiles")
    media.tiles(images, path, keep=["id"], data="image")
    assert [r["payload_bytes"] for r in media.tile_digests(spark.read.parquet(path), keep=["id"]).orderBy("id").collect()] == [3, None, None, None]
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.tile_digests(media.text_media(odd), keep=["doc_id", "n_bytes"]).collect()}
    assert len(got) == odd.distinct().count()
    r, raw = got[3, 3], b"one".ljust(64, b"\0")
    assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (64, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw))
    assert media.tile_digests(media.text_media(empty), keep=["doc_id"]).count() == 0


def test_word_hashes_see_content_only():
    texts = [b"alpha beta", b"", b" beta\talpha ", b"x"]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, starts = word_hash.word_hashes(np.frombuffer(b"".join(texts), dtype=np.uint8), at)
    assert starts.tolist() == [0, 2, 2, 4, 5] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, prose(i, 80) + "\n" + (prose(9999, 40) if i % 4 == 0 else "")) for i in range(40)] + [(40, prose(3, 80) + "\n"), (41, "12 34"), (42, None)]
    frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") < 40, "en")).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = docs.toPandas()
    assert not {41, 42} & set(seen["language"].doc_id) and set(range(40)) <= set(seen["language"].doc_id)
    assert 40 not in set(seen["near_duplicates"].doc_id) and 3 in set(seen["near_duplicates"].doc_id)
    passages = seen["repeated_passages"].set_index("doc_id").text
    assert prose(9999, 40) in passages[0] and passages[4].strip() == prose(4, 80) and passages[5] == prose(5, 80) + "\n"
    assert json.dumps(sorted(seen["mixing"].columns)) == json.dumps(sorted(["doc_id", "text", "lang", "source", "n_chars"]))
    assert seen["packing"].length.sum() > 0


def mix_by_hand(docs, sizes_of, quality, seed=17):
    """taken by row, in plain Python, from the drawn keys of the rows."""
    sources = sorted({s for _, s in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for (_, x), n in zip(docs, sizes_of, strict=True) if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(sources)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            return size, target | share
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full


def test_mixing_against_brute_force(spark):
    texts = [(i, prose(i, 5 + (i * 37) % 90)) for i in range(300)] + [(None, prose(900 + i, 30)) for i in range(9)] + [(301, ""), (302, None)]
    d = frame(spark, texts, source=lambda i: None if i is None else "abcde"[(i * i) % 5])
    got = mixing.mix(d).collect()
    rows = [(r["doc_id"], r["source"]) for r in got]
    size, target = mix_by_hand(rows, [r["size"] for r in got], None)
    for s in size:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size[s]} and abs(mine[0]["target"] - target[s]) < 1e-6
        whole = int(target[s] // size[s])
        assert sum(r["taken"] for r in mine) == round(target[s]) and all(whole * r["size"] <= r["taken"] <= (whole + 1) * r["size"] for r in mine)
        assert sum(whole * r["size"] < r["taken"] < (whole + 1) * r["size"] for r in mine) <= 1  # one crosses the budget
    assert len({r["taken"] for r in got if r["doc_id"] is None}) > 1 or size[None] * 2 == target[None]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_query_against_the_library(spark, tmp_path):
    from mnemospark.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() + [(10**6, None), (10**6 + 1, "")]
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, start = [], 0
    rows = sorted((tuple(r) for r in rows), key=lambda r: r[0])
    ids = library_ids([t for _, t in rows])
    for (i, _), x in zip(rows, ids, strict=True):
        want.append((i, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in queries.op4_token_output(spark, str(tmp_path)).collect()) == want
    known = {i: x for (i, _), x in zip(rows, ids, strict=True)}
    seen, fill = {i: [] for i in known}, {}
    for r in sorted(queries.op6_packing(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["start"])):
        x = known[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        seen[r["doc_id"]].append((r["start"], r["length"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in seen.items():
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(known[i])
    for s, parts in fill.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert s == max(fill) or sum(n for _, n in parts) == 4096


def test_media_query_against_hashlib(spark, tmp_path):
    from mnemospark.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "a"), (-4, "a" * 64), (-5, "ß" * 100_000), (-6, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op10_media_columns(spark, str(tmp_path)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        pixels = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64).astype(float)
        h = len(pixels)
        cell = np.zeros((8, 9))
        for y in range(8):  # the mean over each cell's area, pixel by pixel
            wy = np.clip(np.minimum(np.arange(h) + 1, (y + 1) * h / 8) - np.maximum(np.arange(h), y * h / 8), 0, None)
            for x in range(9):
                wx = np.clip(np.minimum(np.arange(64) + 1, (x + 1) * 64 / 9) - np.maximum(np.arange(64), x * 64 / 9), 0, None)
                cell[y, x] = wy @ pixels @ wx / (wy.sum() * wx.sum())
        clear = np.abs(np.diff(cell, axis=1)) > 1e-3  # bits that rounding can't turn
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r["feature"]), dtype=np.uint8)).reshape(8, 8).astype(bool)
        assert (bits == (cell[:, :-1] < cell[:, 1:]))[clear].all()
    assert (got[-3]["media_sha256"], got[-3]["feature"]) == (got[-6]["media_sha256"], got[-6]["feature"])


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on the same odd table: repeated rows, null keys, long and empty texts, more columns."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(None, docs.first()["text"], None, None, 0), (None, None, None, None, 0), (5000, "", "en", "s", 0), (5001, prose(4, 20_000, 3000), "en", "s", 0), (5001, prose(4, 20_000, 3000), "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("epoch", F.lit(7)).withColumn("_x", F.col("text"))
    stage = dict(corpus_pipeline.STAGES)
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    for name in ("language", "near_duplicates", "repeated_passages", "mixing"):
        out = stage[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage[name](spark, docs.limit(0), str(tmp_path)).count() == 0

    near = stage["near_duplicates"](spark, docs, str(tmp_path)).collect()
    named = {i: t for i, t in texts if i is not None}
    sets = {}
    for i, t in named.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r["doc_id"] for r in near} - {None} == {i for i in root if root[i] == i}
    assert sum(r["doc_id"] == 5001 for r in near) == 2 and [r["text"] for r in near if r["doc_id"] is None] == [None]

    distinct = list(dict.fromkeys(texts))
    want = passages_by_hand([(i, t or "") for i, t in distinct])
    left = stage["repeated_passages"](spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in left) == sorted((i or -1, want[i, t or ""][1]) for i, t in texts if want[i, t or ""][1])
    assert all(r["n_chars"] == len(r["text"]) for r in left)

    mixed = stage["mixing"](spark, docs, str(tmp_path)).collect()
    taken = {(r["doc_id"], r["source"]): -(-r["taken"] // r["size"]) if r["size"] else 0 for r in mixing.mix(docs).collect()}
    seen = {}
    for r in mixed:
        seen[r["doc_id"], r["source"]] = seen.get((r["doc_id"], r["source"]), 0) + 1
    assert {k: v for k, v in seen.items() if k[0] != 5001} == {k: v for k, v in taken.items() if v and k[0] != 5001}
    packed = stage["packing"](spark, docs, str(tmp_path)).toPandas()
    ids = library_ids([t for _, t in texts])
    assert packed.length.sum() == sum(map(len, ids)) and len(packed.groupby("sequence_id")) == -(-sum(map(len, ids)) // 4096)
