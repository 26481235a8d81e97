"""Removing passages that stand earlier in the corpus: suffix automata of reference shards.

Every window of `window` consecutive words picks an anchor: the GRAM-word run in it whose hash is
lowest (the first such). Neighbouring windows that pick the same anchor form a piece. Equal windows
pick equal anchors, so a window can only stand twice where its anchor does: the anchors route pieces
to each other, one for about eight words, and text that is nowhere repeated goes no further.

Copies of one piece collapse to the first of them before words are moved: the windows of all others
stand earlier. Different pieces with one anchor (at the edges of shared passages, and where copies
differ) are the reference. It's cut in shards of bounded size by anchor; each task gets the shards'
words, builds their suffix automata and streams the pieces through them for matching statistics.

An anchor with more different pieces than a shard holds is cut finer: its pieces fall into smaller
ones by a second anchor, a longer run of words, equal ones collapse again, and so on until each
shard is bounded; at last an anchor is a whole window, and pieces with one anchor are equal. No
piece is left out, and the automata decide wherever different pieces meet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import raw_bytes, shared_path, slices, stored
from mnemospark.llm.word_hash import WORD_BASE, mixed, range_hashes, word_hashes

GRAM = 6
#: Pieces of a reference shard, about: an automaton of 50,000 words.
SHARD_PIECES = 2000
#: Different pieces of one anchor that go to one shard; anchors with more are cut by longer ones.
ANCHOR_PIECES = 500
NO_KEY = -(2**63)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For each place, the place of the lowest of the next width values; of equal ones, the first."""
    last = max(len(values) - 1, 0)
    at, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        other = at[np.minimum(np.arange(len(values)) + step, last)]
        at = np.where(values[other] < values[at], other, at)
        done += step
    return at


def pieces_of(data: np.ndarray, at: np.ndarray, window: int, width: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other: for each piece its text, first word, windows, the hash of
    its anchor (a run of width words), own hash, and whether the text has it before."""
    h, starts = word_hashes(data, at)
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(h)) - starts[:-1][text]
    valid = np.flatnonzero(place + window <= counts[text])
    gram = np.full(len(h), width, dtype=np.uint64)
    for j in range(min(width, len(h))):  # fewer words have no window
        gram[: len(h) - j] = gram[: len(h) - j] * np.uint64(WORD_BASE) + h[j:]
    gram = mixed(gram)
    anchor = lowest(gram, window - width + 1)[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    head = np.flatnonzero(new)
    n = np.diff(head, append=len(valid))
    first, of = valid[head], text[valid[head]]
    own = range_hashes(h, first, first + n + window - 1, WORD_BASE)
    order = np.lexsort((first, own, of))
    again = np.zeros(len(head), dtype=bool)
    again[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    return of, place[first], n, gram[anchor[head]], own, again


class SuffixAutomaton:
    """The automaton of all runs of words in the texts added to it. ends[s]: where the runs of state
    s end first."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.ends, self.last, self.size = [-1], [0], [-1], 0, 0

    def _state(self, edges: dict, link: int, length: int, end: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(end)
        return len(self.link) - 1

    def add(self, word) -> None:
        new = self._state({}, 0, self.length[self.last] + 1, self.size)
        p, self.last = self.last, new
        self.size += 1
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            return
        q = self.next[p][word]
        if self.length[q] > self.length[p] + 1:  # q's longer runs don't end here: its shorter ones get a state of their own
            short = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.ends[q])
            self.link[q] = short
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = short
                p = self.link[p]
            q = short
        self.link[new] = q

    def first_ends(self, words: list, window: int) -> list[int]:
        """Matching statistics of a text: for each word, where the window words that end with it
        end first in the automaton's texts; -1 where they don't stand there or are too few."""
        out, state, matched = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            out.append(self.ends[state] if matched >= window else -1)
        return out


def repeated_windows(pieces: list[list], window: int) -> list[int]:
    """Of pieces in the order of the corpus: for each a number whose bit j says that its window j
    stands earlier, in a piece before or in itself."""
    automaton = SuffixAutomaton()
    begins = []
    for i, words in enumerate(pieces):
        begins.append(automaton.size)
        for w in words:
            automaton.add(w)
        automaton.add(i)  # a word of its own: no run crosses it
    out = []
    for begin, words in zip(begins, pieces, strict=True):
        ends = automaton.first_ends(words, window)
        out.append(sum(1 << (k - window + 1) for k in range(window - 1, len(words)) if 0 <= ends[k] < begin + k))
    return out


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """key, mark, anchor, own, spot: a row for each piece. spot holds its first word (from bit 32), its
    windows (from bit 24) and whether the text has it before (bit 0)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            of, first, n, anchor, own, again = pieces_of(*raw_bytes(s.column("text")), window)
            key, mark = (s.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[of] for c in ("key", "mark"))
            spot = first << 32 | n << 24 | again.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(mark), pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(spot)], ["key", "mark", "anchor", "own", "spot"])

    return rows.mapInArrow(apply, "key bigint, mark bigint, anchor bigint, own bigint, spot bigint")


def _finer(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """The smaller pieces that anchors of width words cut pieces into: piece (its id), begin (first
    window in it), anchor, words, and where it stands first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "words"):
            of, first, n, anchor, _, _ = pieces_of(*raw_bytes(s.column("words")), window, width)
            words = [w.split(" ") for w in s.column("words").to_pylist()]
            cut = [" ".join(words[t][i : i + m + window - 1]) for t, i, m in zip(of.tolist(), first.tolist(), n.tolist(), strict=True)]
            parent = s.column("anchor").to_numpy().view(np.uint64)[of]
            anchor = mixed(anchor ^ (parent * np.uint64(WORD_BASE)))
            to = pa.array(of)
            at = s.column("at").to_numpy()[of] + first
            cols = [s.column("piece").take(to), pa.array(first, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(cut, pa.string()), s.column("key").take(to), s.column("mark").take(to), pa.array(at)]
            yield pa.RecordBatch.from_arrays(cols, ["piece", "begin", "anchor", "words", "key", "mark", "at"])

    flat = pieces.select("piece", "anchor", "words", "first.key", "first.mark", "first.at")
    return flat.mapInArrow(apply, "piece bigint, begin int, anchor bigint, words string, key bigint, mark bigint, at bigint")


def _settled(pieces: DataFrame, window: int, widths: tuple[int, ...]) -> DataFrame:
    """anchor, own (the hash of the words), first, mask of each different piece: first is the earliest
    (key, mark, at) it has; mask says which of its windows stand earlier than there. pieces has anchor,
    words, key, mark, at; widths: the lengths of the anchors by which crowded ones are cut, the window
    at last. Pieces are told apart by their words; what is known of one is found by anchor and own."""
    distinct = pieces.groupBy("anchor", "words").agg(F.min(F.struct("key", "mark", "at")).alias("first"))
    distinct = stored(distinct.withColumn("piece", F.monotonically_increasing_id()).withColumn("own", F.xxhash64("words")), "substring-pieces")
    # no window of a piece stands earlier in that piece: it would have picked the earlier anchor
    several = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"), "substring-several")
    none = distinct.select("anchor", "own", "first").join(several, "anchor", "left_anti").withColumn("mask", F.lit(0).cast("long"))
    few = distinct.join(several.where(F.col("pieces") <= ANCHOR_PIECES), "anchor")
    shards = -(-(several.where(F.col("pieces") <= ANCHOR_PIECES).agg(F.sum("pieces")).first()[0] or 0) // SHARD_PIECES)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "mark", "at"], kind="stable")
        masks = repeated_windows([w.split(" ") for w in pdf["words"]], window)
        return pd.DataFrame({"anchor": pdf["anchor"], "own": pdf["own"], "key": pdf["key"], "mark": pdf["mark"], "at": pdf["at"], "mask": masks})

    flat = few.select("anchor", "own", "words", "first.key", "first.mark", "first.at", F.pmod(F.xxhash64("anchor"), F.lit(max(shards, 1))).alias("shard"))
    by_automata = flat.groupBy("shard").applyInPandas(shard, "anchor bigint, own bigint, key bigint, mark bigint, at bigint, mask bigint")
    found = none.unionByName(by_automata.select("anchor", "own", F.struct("key", "mark", "at").alias("first"), "mask"))
    if several.where(F.col("pieces") > ANCHOR_PIECES).isEmpty():
        return found
    crowded = distinct.join(several.where(F.col("pieces") > ANCHOR_PIECES), "anchor")
    parts = stored(_finer(crowded, window, widths[0]), "substring-parts")
    inner = _settled(parts.select("anchor", "words", "key", "mark", "at"), window, widths[1:])
    n = F.size(F.split("words", " ")) - (window - 1)
    met = parts.select("piece", "begin", "anchor", F.xxhash64("words").alias("own"), "key", "mark", "at", n.alias("n")).join(inner, ["anchor", "own"])
    bits = F.when(F.struct("key", "mark", "at") == F.col("first"), F.col("mask")).otherwise(F.expr("shiftleft(1L, n) - 1"))
    masks = met.select("piece", F.call_function("shiftleft", bits, F.col("begin")).alias("bits")).groupBy("piece").agg(F.bit_or("bits").alias("mask"))
    return found.unionByName(crowded.select("piece", "anchor", "own", "first").join(masks, "piece").select("anchor", "own", "first", "mask"))


def _cut(text: bytes, spans: list[tuple[int, int]], layout: bool) -> tuple[int, int, bytes]:
    """Words, words removed, what is left; spans of words to remove may overlap."""
    words = text.split()
    if not spans:
        return len(words), 0, text if layout else b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    a = np.array(spans, dtype=np.int64)
    np.add.at(depth, np.minimum(a[:, 0], len(words)), 1)
    np.add.at(depth, np.minimum(a[:, 1], len(words)), -1)
    keep = np.cumsum(depth[:-1]) == 0
    if not layout:
        return len(words), int((~keep).sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
    out, at = [], 0
    for m, k in zip(WORDS.finditer(text), keep.tolist(), strict=True):
        if k:
            out.append(text[at : m.end()])
        at = m.end()
    return len(words), int((~keep).sum()), b"".join(out).strip()


UNSURE = pa.list_(pa.struct([("anchor", pa.int64()), ("spot", pa.int64()), ("words", pa.string())]))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20, layout: bool = False, keep: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_words of every row: the text without each word that a window
    of window words covers whose words stand earlier too (in a document with a smaller key, or
    earlier in the same one). What is left is joined by one space, or where layout is set keeps its
    own white space (a text nothing is taken from is then unchanged). window: GRAM to 64 words.

    Null and empty texts have no words. Null keys come before all others. Different texts with one
    key, null too, come in the order of their hashes, each a document of its own. Repeated rows (key
    and text alike) are one document, and each of them gets what is left of it. Texts of any length
    are whole. An empty table gives none; other columns are ignored, but for the one named keep,
    which stays.

    Scale: four shuffles, of 40 bytes for each piece (twice), of the texts, and of the few pieces
    that share an anchor but differ. All meet under hashes of content; an anchor that a third of all
    documents have is summed before the first shuffle, one row to be joined with in the second, and
    if it has many different pieces, these are dealt anew by longer anchors."""
    if not GRAM <= window <= 64:
        raise ValueError(f"window must be {GRAM} to 64 words")
    widths = tuple(sorted({(GRAM + window) // 2, window}))
    carried = [keep] if keep else []
    types = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.col(key).cast("long").alias("doc_id"),
        *carried,
    ).withColumn("mark", F.xxhash64("text"))
    pieces = _pieces(rows.select("key", "mark", "text"), window)
    me = F.struct("key", "mark")
    anchors = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("own").alias("low"), F.max("own").alias("high"), F.min(me).alias("first"))
    anchors = stored(anchors.where("c > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"), "first"), "substring-anchors")
    again = F.col("spot").bitwiseAND(F.lit(1)) != 0
    met = pieces.join(anchors, "anchor").where(again | F.col("mixed") | (me > F.col("first")))
    met = met.select("key", "mark", "spot", F.when(~again & F.col("mixed"), F.col("anchor")).alias("anchor"))
    flags = met.groupBy("key", "mark").agg(F.collect_set(F.struct("spot", "anchor")).alias("flags"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            gone, unsure = [], []
            for t, fs in zip(s.column("text").to_pylist(), s.column("flags").to_pylist(), strict=True):
                fs = fs or []
                gone.append([f["spot"] for f in fs if f["anchor"] is None])
                open_ = [f for f in fs if f["anchor"] is not None]
                words = t.encode().split() if open_ else []
                unsure.append([{"anchor": f["anchor"], "spot": f["spot"], "words": b" ".join(words[(f["spot"] >> 32) : (f["spot"] >> 32) + (f["spot"] >> 24 & 0xFF) + window - 1]).decode()} for f in open_])
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in ("key", "mark", "doc_id", "text")), pa.array(gone, pa.list_(pa.int64())), pa.array(unsure, UNSURE), pa.array([bool(u) for u in unsure]), *(s.column(c) for c in carried)], ["key", "mark", "doc_id", "text", "gone", "unsure", "pending", *carried])

    table = rows.join(flags, ["key", "mark"], "left").select("key", "mark", "doc_id", "text", "flags", *carried)
    table = table.mapInArrow(gather, f"key bigint, mark bigint, doc_id bigint, text string, gone array<bigint>, unsure array<struct<anchor:bigint,spot:bigint,words:string>>, pending boolean{types}")
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "substring")
    table.write.option("compression", "zstd").partitionBy("pending").parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    waiting = table.where("pending")
    open_ = waiting.select("key", "mark", F.explode("unsure").alias("u")).select("key", "mark", "u.anchor", "u.spot", "u.words", F.shiftright("u.spot", 32).alias("at"))
    settled = stored(_settled(open_.select("anchor", "words", "key", "mark", "at"), window, widths), "substring-settled")
    here = F.struct("key", "mark", "at") == F.col("first")
    met = open_.select("key", "mark", "spot", "at", "anchor", F.xxhash64("words").alias("own"))
    masks = met.join(settled, ["anchor", "own"]).select("key", "mark", "spot", F.when(here, F.col("mask")).otherwise(F.lit(-1)).alias("mask"))
    masks = masks.where("mask != 0").groupBy("key", "mark").agg(F.collect_set(F.struct("spot", "mask")).alias("masks"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            out = []
            for t, gone, masks_ in zip(*(s.column(c).to_pylist() for c in ("text", "gone", "masks")), strict=True):
                spans = [(p >> 32, (p >> 32) + (p >> 24 & 0xFF) + window - 1) for p in gone]
                for m in masks_ or []:
                    at, n, mask = m["spot"] >> 32, m["spot"] >> 24 & 0xFF, m["mask"]
                    spans += [(at, at + n + window - 1)] if mask < 0 else [(at + j, at + j + window) for j in range(n) if mask >> j & 1]
                out.append(_cut(t.encode(), spans, layout))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([x.decode() for x in cols[2]], pa.string()), *(s.column(c) for c in carried)], ["doc_id", "n_words", "n_removed", "kept_words", *carried])

    none = F.lit(None).cast("array<struct<spot:bigint,mask:bigint>>").alias("masks")
    done = table.where("not pending").select("doc_id", "text", "gone", none, *carried)
    late = waiting.join(masks, ["key", "mark"], "left").select("doc_id", "text", "gone", "masks", *carried)
    return done.union(late).mapInArrow(apply, f"doc_id bigint, n_words bigint, n_removed bigint, kept_words string{types}")
