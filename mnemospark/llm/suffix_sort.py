"""Removing byte strings that stand earlier in the corpus, by depth-limited radix sorting of suffixes.

A repeated string of `window` bytes is a group of suffixes that agree in their first `window` bytes.
Sorting suffixes by most-significant digits (8 bytes a pass) and dropping after each pass those that
are alone with their prefix leaves, after the last pass, exactly these groups; no suffix is ever compared beyond
the window, so repeats of any length cost the same. Of each group the first in the order of the corpus
stays, the others are late.

Suffixes meet by content before they are sorted. Each window picks as its anchor the run of GRAM bytes
in it with the lowest hash (the first such); neighbouring windows with one anchor form a piece. Equal
windows pick equal anchors, so anchors deal the suffixes out to tasks, and a piece whose anchor stands
nowhere else goes no further. Pieces that agree as a whole (by two hashes of 64 bits) are combined
with the first of them before their bytes move, as a combiner does: all their windows stand there. What is sorted
is every different piece of every anchor that has several, wherever it comes from.

An anchor with more different pieces than a shard holds is dealt out further by longer anchors, at
last by whole windows; no piece is left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import raw_bytes, shared_path, slices, stored
from mnemospark.llm.word_hash import BYTE_BASE, mixed, powers

GRAM = 32
#: Pieces of a shard, about: 300 kB, some 70,000 suffixes.
SHARD_PIECES = 2000
#: Different pieces of one anchor that go to one shard; anchors with more are dealt by longer ones.
ANCHOR_PIECES = 1000
#: Bytes of text whose hashes are in memory at once; longer texts go by stretches of so much.
STRETCH = 1 << 21
#: The place of rows without a key: before all others.
NO_KEY = -(2**63)


def prefix_digits(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a number that orders as they do; bytes 0 follow the end."""
    d = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        d[:-step] = d[:-step] << np.uint64(8 * step) | d[step:]
    return d


def late_suffixes(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes of data at the places at share their first window bytes with one that
    comes earlier in at: a radix sort by most-significant digits that ends at that depth."""
    late = np.zeros(len(at), dtype=bool)
    digits = prefix_digits(data)
    who, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    for depth in range(0, window, 8):
        digit = digits[at[who] + depth]
        if window - depth < 8:
            digit = digit >> np.uint64(8 * (8 - window + depth))
        order = np.lexsort((digit, group))  # stable: groups stay in the order of at
        who, group, digit = who[order], group[order], digit[order]
        new = np.ones(len(who), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group] if len(group) else new
        who, group = who[several], group[several]
        if not len(who):
            return late
    late[who[1:][group[1:] == group[:-1]]] = True
    return late


def late_runs(pieces: list[bytes], window: int) -> list[list[int]]:
    """Of pieces in the order of the corpus: for each the runs of its windows that stand in a piece
    before (none can be twice in one piece), each as its first window << 8 | the window after its last."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    counts = sizes - window + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(len(piece)) - (np.cumsum(counts) - counts)[piece]
    late = late_suffixes(data, (np.cumsum(sizes) - sizes)[piece] + place, window)
    out: list[list[int]] = [[] for _ in pieces]
    found = np.flatnonzero(late)
    if len(found):
        cut = np.flatnonzero((np.diff(found) != 1) | (np.diff(piece[found]) != 0)) + 1
        for first, last in zip(found[np.append(0, cut)].tolist(), found[np.append(cut, len(found)) - 1].tolist(), strict=True):
            out[piece[first]].append(int(place[first]) << 8 | int(place[last]) + 1)
    return out


def pieces_of(data: np.ndarray, at: np.ndarray, window: int, width: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other, text i from at[i] to at[i + 1]: for each piece its text, the
    place of its first window in data, windows, the hash of its anchor (a run of width bytes) and its own."""
    last = np.maximum(at[1:] - window + 1, at[:-1])  # behind the last window of each text
    sizes = last - at[:-1]
    none = np.zeros(0, dtype=np.int64)
    if not sizes.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(BYTE_BASE, len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n = len(data) - width + 1
    gram = mixed((sums[width:] - sums[:n]) * down[:n])
    low = gram & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)  # of equal ones the first
    done, span = 1, window - width + 1
    while done < span:
        step = min(done, span - done)
        low[:-step] = np.minimum(low[:-step], low[step:])
        done += step
    text = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text] + at[:-1][text]
    anchor = (low[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    count = np.diff(head, append=len(valid))
    first = valid[head]
    own = mixed((sums[first + count + window - 1] - sums[first]) * down[first] + count.astype(np.uint64))
    return text[head], first, count, gram[anchor[head]], own


def _stretches(s: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of a slice's texts by stretches: data, at, row and the place in its text of each."""
    data, at = raw_bytes(s.column("text"))
    if len(data) <= 2 * STRETCH:
        yield data, at, np.arange(s.num_rows), np.zeros(s.num_rows, dtype=np.int64)
        return
    for row in range(s.num_rows):
        text = data[at[row] : at[row + 1]]
        for begin in range(0, max(len(text) - window + 1, 1), STRETCH):
            part = text[begin : begin + STRETCH + window - 1]
            yield part, np.array([0, len(part)]), np.array([row]), np.array([begin])


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    """anchor: those that stand more than once in all rows. A task sends each of its anchors once."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if seen:
                values, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n > 1)], ["anchor", "several"])
                seen.clear()

        for s in slices(batches, "text"):
            for data, at, _, _ in _stretches(s, window):
                seen.append(pieces_of(data, at, window)[3])
                held += len(seen[-1])
            if held > 4_000_000:
                yield from flush()
                held = 0
        yield from flush()

    found = rows.select("text").mapInArrow(apply, "anchor bigint, several boolean")
    counted = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("several"))
    return counted.where((F.col("n") > 1) | F.col("several")).select("anchor")


def _pieces(rows: DataFrame, window: int) -> DataFrame:
    """key, mark, anchor, own, spot of each piece; spot holds its first byte (from bit 8) and its windows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            key, mark = (s.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "mark"))
            for data, at, row, begin in _stretches(s, window):
                of, first, n, anchor, own = pieces_of(data, at, window)
                spot = first - at[of] + begin[of] << 8 | n
                yield pa.RecordBatch.from_arrays([pa.array(key[row[of]]), pa.array(mark[row[of]]), pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(spot)], ["key", "mark", "anchor", "own", "spot"])

    return rows.select("key", "mark", "text").mapInArrow(apply, "key bigint, mark bigint, anchor bigint, own bigint, spot bigint")


def _dealt_further(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """The smaller pieces that anchors of width bytes cut pieces into: piece (its id), begin (the window
    in it that is their first), anchor, bytes, and where each stands."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "bytes"):
            data, at = raw_bytes(s.column("bytes"))
            of, first, n, anchor, _ = pieces_of(data, at, window, width)
            cut = [data[i : i + m + window - 1].tobytes() for i, m in zip(first.tolist(), n.tolist(), strict=True)]
            begin = first - at[of]
            parent = s.column("anchor").to_numpy().view(np.uint64)[of]
            anchor = mixed(anchor ^ (parent * np.uint64(BYTE_BASE)))
            to = pa.array(of)
            place = s.column("place").to_numpy()[of] + begin
            cols = [s.column("piece").take(to), pa.array(begin.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(cut, pa.binary()), s.column("key").take(to), s.column("mark").take(to), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, ["piece", "begin", "anchor", "bytes", "key", "mark", "place"])

    flat = pieces.select("piece", "anchor", "bytes", "key", "mark", "place")
    return flat.mapInArrow(apply, "piece bigint, begin int, anchor bigint, bytes binary, key bigint, mark bigint, place bigint")


def _sorted_pieces(pieces: DataFrame, window: int, widths: tuple[int, ...]) -> DataFrame:
    """piece and runs of its late windows, where it has some. pieces (stored): piece (an id), anchor, bytes,
    key, mark, place of every different piece where it stands first. widths: the anchors by which crowded
    ones are dealt further, the window at last."""
    counts = stored(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-counts")
    few, many = counts.where(F.col("n") <= ANCHOR_PIECES), counts.where(F.col("n") > ANCHOR_PIECES)
    shards = max(1, -(-(few.agg(F.sum("n")).first()[0] or 0) // SHARD_PIECES))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "mark", "place"], kind="stable")
        out = pd.DataFrame({"piece": pdf["piece"], "runs": late_runs(list(map(bytes, pdf["bytes"])), window)})
        return out[out["runs"].str.len() > 0]

    met = pieces.join(few.select("anchor"), "anchor").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = met.select("piece", "bytes", "key", "mark", "place", "shard").groupBy("shard").applyInPandas(shard, "piece bigint, runs array<int>")
    if many.isEmpty():
        return found
    if not widths:
        raise AssertionError("pieces of one window that share their anchor are equal, so one is left of them")
    parts = stored(_dealt_further(pieces.join(many.select("anchor"), "anchor"), window, widths[0]), "suffix-parts")
    spot = F.struct("key", "mark", "place")
    inner = stored(parts.groupBy("anchor", "bytes").agg(F.min(spot).alias("first")).withColumn("id", F.monotonically_increasing_id()), "suffix-inner")
    runs = _sorted_pieces(inner.select(F.col("id").alias("piece"), "anchor", "bytes", "first.*"), window, widths[1:])
    known = inner.join(runs.withColumnRenamed("piece", "id"), "id", "left").select("anchor", F.xxhash64("bytes").alias("own"), "first", "runs")
    n = F.length("bytes") - (window - 1)
    met = parts.select("piece", "begin", "anchor", F.xxhash64("bytes").alias("own"), spot.alias("me"), n.alias("n")).join(known, ["anchor", "own"])
    late = F.when(F.col("me") == F.col("first"), F.col("runs")).otherwise(F.array("n"))  # a copy: windows 0 to n
    late = F.transform(late, lambda r: (r + F.col("begin") * 257).cast("int"))
    return found.unionByName(met.select("piece", late.alias("late")).where("late is not null").groupBy("piece").agg(F.flatten(F.collect_list("late")).alias("runs")))


def removed_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as maximal ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


UNSURE = pa.list_(pa.struct([("anchor", pa.int64()), ("spot", pa.int64()), ("bytes", pa.binary())]))


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end of each removed run of bytes) and kept (the bytes
    left) of every row: its UTF-8 text without each byte that a string of window bytes covers which
    stands earlier too (in a document with a smaller key, or earlier in the same one; overlaps count).
    window: GRAM + 1 to GRAM + 200 bytes.

    Null texts are empty. Null keys come before all others. Different texts with one key, null too,
    come in the order of their hashes, each a document of its own. Repeated rows (key and text alike)
    are one document, and each of them gets what is left of it. What is cut may be part of a character,
    so kept is binary. Texts of any length are whole. An empty table gives none; other columns are ignored.

    Scale: anchors (one for about 35 bytes of text) are counted over all tasks, each sent once a task;
    pieces move once to meet the repeated ones, which a join can split where a third of all documents
    share one. From there on only repeated pieces move, the bytes only of different ones, and each text
    once, to its spans."""
    if not GRAM < window <= GRAM + 200:
        raise ValueError(f"window must be {GRAM + 1} to {GRAM + 200} bytes")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(key).cast("long").alias("doc_id"))
    # where each key is there once, texts need no mark beside it: 8 bytes less in every row that moves
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alone = several.isEmpty()
    rows = rows.withColumn("mark", F.lit(0).cast("long") if alone else F.xxhash64("text"))
    anchors = stored(_anchors(rows, window), "suffix-anchors")
    met = stored(_pieces(rows, window).join(anchors, "anchor"), "suffix-met")
    me = F.struct("key", "mark", "spot")
    firsts = met.groupBy("anchor", "own").agg(F.min(me).alias("first"))
    firsts = stored(firsts, "suffix-firsts")
    mixed_ = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", F.lit(True).alias("mixed"))
    known = firsts.join(mixed_, "anchor", "left")
    flagged = met.join(known, ["anchor", "own"]).where((me > F.col("first")) | F.col("mixed"))
    open_ = me == F.col("first")
    flags = flagged.groupBy("key", "mark").agg(F.collect_set(F.when(~open_, F.col("spot"))).alias("copies"), F.collect_set(F.when(open_, F.struct("spot", "anchor"))).alias("open"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            gone, unsure = [], []
            for t, copies, open_ in zip(s.column("text").cast(pa.binary()).to_pylist(), s.column("copies").to_pylist(), s.column("open").to_pylist(), strict=True):
                spots = [(x >> 8, (x >> 8) + (x & 255) + window - 1) for x in copies or []]
                gone.append([x for span in removed_spans(spots) for x in span])
                unsure.append([{"anchor": f["anchor"], "spot": f["spot"], "bytes": t[f["spot"] >> 8 : (f["spot"] >> 8) + (f["spot"] & 255) + window - 1]} for f in open_ or []])
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in ("key", "mark", "doc_id", "text")), pa.array(gone, pa.list_(pa.int64())), pa.array(unsure, UNSURE), pa.array([bool(u) for u in unsure])], ["key", "mark", "doc_id", "text", "gone", "unsure", "pending"])

    table = rows.join(flags, ["key", "mark"], "left").select("key", "mark", "doc_id", "text", "copies", "open")
    table = table.mapInArrow(gather, "key bigint, mark bigint, doc_id bigint, text string, gone array<bigint>, unsure array<struct<anchor:bigint,spot:bigint,bytes:binary>>, pending boolean")
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "suffix")
    table.write.option("compression", "zstd").partitionBy("pending").parquet(path)
    table = spark.read.schema(table.schema).parquet(path)
    waiting = table.where("pending")
    # rows alike in key and text are one document, whose pieces count once
    once = waiting if alone else waiting.dropDuplicates(["key", "mark"])
    pieces = once.select("key", "mark", F.explode("unsure").alias("u")).select("key", "mark", "u.*")
    pieces = stored(pieces.withColumn("place", F.shiftright("spot", 8)).withColumn("piece", F.monotonically_increasing_id()), "suffix-pieces")
    runs = _sorted_pieces(pieces.drop("spot"), window, tuple(w for w in ((GRAM + window) // 2, window) if w > GRAM))
    late = pieces.select("piece", "key", "mark", "place").join(runs, "piece")
    late = late.groupBy("key", "mark").agg(F.collect_list(F.struct("place", "runs")).alias("late"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            sizes, lost, spans_, kept = [], [], [], []
            for t, gone, late_ in zip(s.column("text").cast(pa.binary()).to_pylist(), s.column("gone").to_pylist(), s.column("late").to_pylist(), strict=True):
                spans = list(zip(gone[::2], gone[1::2], strict=True))
                spans += [(x["place"] + (r >> 8), x["place"] + (r & 255) + window - 1) for x in late_ or [] for r in x["runs"]]
                spans = removed_spans(spans)
                edges = [0, *(x for span in spans for x in span), len(t)]
                sizes.append(len(t))
                lost.append(sum(b - a for a, b in spans))
                spans_.append([{"start": a, "end": b} for a, b in spans])
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            cols = [s.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    none = F.lit(None).cast("array<struct<place:bigint,runs:array<int>>>").alias("late")
    done = table.where("not pending").select("doc_id", "text", "gone", none)
    rest = waiting.join(late, ["key", "mark"], "left").select("doc_id", "text", "gone", "late")
    return done.union(rest).mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
