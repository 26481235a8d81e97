"""Resampling towards a target distribution: weights from bucketed word runs, exact selection by digits.

Documents and target texts are bags of hashed features (words and pairs of words). A feature's gain
is the logarithm of how much likelier its bucket is in the target; a document's weight is the mean
gain. With a Gumbel variate added, the highest scores are a sample without replacement in proportion to
exp(weight). The k-th score is found by radix selection: histograms of one digit of the key after
the other, each over the rows that share the digits found so far, so no rows are sorted to find it.
Only what is drawn is sorted, by ranges, and ranked."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import raw_bytes, slices, stored, with_running_sum

BUCKETS = 10_000
#: Words longer than this are hashed one by one; shorter ones all at once.
LONG = 64
#: Bits of a digit in the selection: a histogram has at most 65,536 rows.
DIGIT = 16


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _shift_tables() -> np.ndarray:
    """[n, b, x]: what byte b of a checksum, with value x, becomes when n bytes 0 follow."""
    out = np.zeros((LONG + 1, 4, 256), dtype=np.uint32)
    x = np.arange(256, dtype=np.uint32)
    for b in range(4):
        out[0, b] = x << np.uint32(8 * b)
    for n in range(1, LONG + 1):
        out[n] = CRC[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


CRC = _crc_table()
SHIFT = _shift_tables()
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def feature_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that lie one after the other in data, text i from at[i] to at[i + 1]: the buckets of all
    features, and the text of each. The crc32 of a pair of words follows from those of its words: a
    checksum moves over n bytes by tables, whatever the bytes are."""
    raw = np.frombuffer(data.tobytes().translate(LOWER), dtype=np.uint8)
    solid = IN_WORD[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = end - first
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    start, crc = first[order], np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    active = len(first) - np.searchsorted(np.sort(size), np.arange(LONG + 1), side="right")  # words of over j bytes
    for j in range(LONG):
        n = active[j]
        if not n:
            break
        crc[:n] = CRC[(crc[:n] ^ raw[start[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    one = np.empty(len(first), dtype=np.uint32)
    one[order] = ~crc
    far = np.flatnonzero(size > LONG)
    for i in far.tolist():
        one[i] = zlib.crc32(raw[first[i] : end[i]])
    text = np.searchsorted(at, first, side="right") - 1
    left = np.flatnonzero(text[1:] == text[:-1])
    spaced = ~one[left]
    spaced = ~(CRC[(spaced ^ np.uint32(32)) & np.uint32(255)] ^ (spaced >> np.uint32(8)))
    n = np.minimum(size[left + 1], LONG)
    two = one[left + 1].copy()
    for b in range(4):
        two ^= SHIFT[n, b, (spaced >> np.uint32(8 * b)) & np.uint32(255)]
    for i in np.flatnonzero(size[left + 1] > LONG).tolist():
        w = left[i] + 1
        two[i] = zlib.crc32(raw[first[w] : end[w]], int(spaced[i]))
    return np.concatenate([one, two]).astype(np.int64) % BUCKETS, np.concatenate([text, text[left]])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all rows fall in each bucket. A task sends at most a row a bucket; the
    driver gets one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for s in slices(batches, "text"):
            total += np.bincount(feature_buckets(*raw_bytes(s.column("text")))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    found = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n bigint")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


@dataclass
class Part:
    """One part of the key: a long column and its bounds over the rows still in question."""

    value: Column
    low: int
    high: int

    def flipped(self) -> Column:
        """The value as an unsigned number from 0 on that orders alike."""
        if self.high - self.low < 2**63:
            return self.value - F.lit(self.low)
        return self.value.bitwiseXOR(F.lit(-(2**63)))

    def bits(self) -> int:
        return (self.high - self.low).bit_length() if self.high - self.low < 2**63 else 64


def kth_key(rows: DataFrame, parts: list[str], k: int) -> tuple[list[int], int]:
    """The values of the long columns parts of the row that stands k-th (from 1) in their ascending
    order, and how many rows up to k have these very values. parts have no nulls; k is at most the count.

    A job for the bounds of each part and one for each of its digits that is not the same in all rows,
    until one row is left in question: about five for scores and keys. Each counts rows by digit where they
    lie; nothing but histograms moves."""
    found: list[int] = []
    open_, left = rows, k
    for i, name in enumerate(parts):
        low, high, n = open_.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        part = Part(F.col(name), low, high)
        value, bits = part.flipped(), part.bits()
        shift = -(-bits // DIGIT) * DIGIT
        prefix = 0
        while shift and n > 1:
            shift -= DIGIT
            digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(2**DIGIT - 1))
            histogram = sorted((r["d"], r["n"]) for r in open_.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
            for d, n in histogram:
                if left <= n:
                    break
                left -= n
            prefix = prefix << DIGIT | d
            open_ = open_.where(digit == d)
        if n == 1 or not shift:
            if shift:  # one row is left: it has the rest of the digits
                low = open_.select(name).first()[0]
            elif bits:
                low = prefix + low if high - low < 2**63 else prefix - 2**63
            found.append(low)
        if n == 1:
            if parts[i + 1 :]:
                found += list(open_.select(*parts[i + 1 :]).first())
            return found, 1
    return found, left


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row: rank is 1, 2, ... over the percent of
    rows with least_words words or more whose scores are highest, null for all others.

    Ties in score go to the smaller key, then to the smaller hash of the text; rows alike in all are
    interchangeable, and exactly the number asked for is drawn. Null keys come last and draw by the
    empty word. Null and empty texts have no feature, weight 0 and no rank. An empty table gives
    none; an empty target gives every bucket its smoothed gain. Other columns are ignored.

    Scale: texts are read twice and never moved: once for the counts of buckets (a task sends at most
    10,000), once for the weights. What is written is a few numbers a document. The k-th key takes a
    handful of jobs that move histograms; only drawn rows are sorted, by ranges."""
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, text))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            bucket, of = feature_buckets(*raw_bytes(s.column("text")))
            n = np.bincount(of, minlength=s.num_rows)
            total = np.zeros(s.num_rows, dtype=np.int64)
            np.add.at(total, of, gains[bucket])
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("mark"), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "mark", "n_features", "weight"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id bigint, mark bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", F.col("weight") + gumbel)
    rows = rows.withColumn("_down", -F.col("score")).withColumn("_null", F.col("doc_id").isNull().cast("long")).withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "resampling")
    out = ["doc_id", "n_features", "weight", "score"]
    fit = F.col("n_features") >= 2 * least_words - 1  # words and pairs of neighbours
    k = percent * rows.where(fit).count() // 100
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*out, none)
    parts = ["_down", "_null", "_id", "mark", "_row"]
    last, _ = kth_key(rows.where(fit), parts, k)
    drawn = fit & (F.struct(*parts) <= F.struct(*[F.lit(x).cast("long").alias(p) for p, x in zip(parts, last, strict=True)]))
    ranked = with_running_sum(rows.where(drawn).withColumn("_one", F.lit(1).cast("long")), parts, "_one", "_before", "resampling-ranks")
    return ranked.select(*out, (F.col("_before") + 1).alias("rank")).unionByName(rows.where(~drawn).select(*out, none))
