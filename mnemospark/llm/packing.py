"""Packing documents into sequences along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import raw_texts, slices, stored, with_running_sum
from mnemospark.llm.word_hash import mixed
from mnemospark.llm.word_ids import encoder

#: Buckets of a hashed vector, dimensions it is projected to, bits of each on the curve.
BUCKETS, DIMENSIONS, BITS = 64, 4, 10


@functools.cache
def hashed(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each id under n."""
    h = mixed(np.arange(n, dtype=np.uint32))
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def document_vectors(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row for each document: signed counts of its hashed ids, by square roots, at length 1."""
    bucket, sign = hashed(1 << int(ids.max(initial=0)).bit_length())  # ids are under the size of a vocabulary
    cell = np.repeat(np.arange(len(counts)) * BUCKETS, counts) + bucket[ids]
    v = np.bincount(cell, weights=sign[ids], minlength=len(counts) * BUCKETS).reshape(-1, BUCKETS)
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def projected(v: np.ndarray, seed: int = 5) -> np.ndarray:
    """Each vector's place in a grid of DIMENSIONS times 2**BITS cells. Coordinates of unit vectors
    under a random projection are about normal, so a logistic curve spreads them over the grid."""
    axes = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return np.minimum((1 / (1 + np.exp(-1.7 * (v @ axes))) * 2**BITS).astype(np.int64), 2**BITS - 1)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each cell (a row of coordinates under 2**bits) on the Hilbert curve.

    Works from the highest bit down: where a coordinate has the bit, the lower bits of the first
    coordinate are mirrored, else they change places with its own; then Gray code, then the bits of
    all coordinates interleaved."""
    x = [c.copy() for c in cells.T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            has = (x[i] >> b) & 1 == 1
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[i] ^= swap
            if i:
                x[0] ^= swap
            x[0] ^= np.where(has, low, 0)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ flip) >> b) & 1)
    return key


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    length: int = 4096,
    end_id: int = 2,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian, 32 bits), doc_tokens,
    sequence_id, offset.

    Documents lie one after the other along the Hilbert curve (ties by key, then row), and the line
    is cut every length tokens: every sequence but the last is full, so at most one is padded.
    Null and empty texts are their end id. Repeated rows are packed as often as they stand there;
    null keys are packed too. A document longer than a sequence fills several. An empty table gives
    none. Other columns are ignored.

    Scale: texts are encoded once, where they're read, and stored as ids; what is range-sorted is a
    few numbers for each document; ids move once, to meet their places. Copies share a place on the
    curve, and the sort splits them by key."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(tokenizer, end_id), TaskContext.get().partitionId() << 33
        narrow = np.dtype("<u2" if max(coder.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        for s in slices(batches, "text"):
            flat, n = coder.encode(raw_texts(s.column("text")))
            curve = hilbert_key(projected(document_vectors(flat, n)))
            raw, ends = flat.astype(narrow).tobytes(), np.cumsum(n) * narrow.itemsize
            ids = [raw[a:b] for a, b in zip((ends - n * narrow.itemsize).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), s.column("doc_id"), pa.array(curve), pa.array(n), pa.array(ids, pa.binary())], ["row", "doc_id", "curve", "n", "ids"])
            row += len(n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "ids"):
            first, n = (s.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "n"))
            pieces = (first + n - 1) // length - first // length + 1
            of = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum((first[of] // length + k) * length, first[of])
            end = np.minimum((first[of] // length + k + 1) * length, first[of] + n[of])
            raw = s.column("ids").to_pylist()
            wide = [np.frombuffer(x, dtype="<u2" if len(x) == 2 * m else "<u4").astype("<u4").tobytes() for x, m in zip(raw, n.tolist(), strict=True)]
            start = begin - first[of]
            ids = [wide[d][4 * a : 4 * b] for d, a, b in zip(of.tolist(), start.tolist(), (end - first[of]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(end - begin), pa.array(ids, pa.binary()), pa.array(n[of]), pa.array(begin // length), pa.array(begin % length)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    coded = stored(rows.mapInArrow(encode, "row bigint, doc_id bigint, curve bigint, n bigint, ids binary"), "pack")
    places = with_running_sum(coded.select("row", "doc_id", "curve", "n"), ["curve", "doc_id", "row"], "n", "first", "pack-places")
    placed = coded.select("row", "doc_id", "n", "ids").join(places.select("row", "first"), "row")
    return placed.select("doc_id", "first", "n", "ids").mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
