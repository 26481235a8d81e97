"""Token ids in files: bit- or byte-plane shuffled, compressed plane by plane, with a chunk index."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.common import raw_texts, slices, with_base
from mnemospark.llm.word_ids import encoder

MAGIC = b"MNIP"
#: magic, 1 for bit and 8 for byte planes, planes, ids, ids of a block
HEAD = struct.Struct("<4sBBII")


def pack_planes(ids: np.ndarray, *, unit: int = 1, block: int = 65536, level: int = 3) -> bytes:
    """One chunk: ids (unsigned, 32 bits) in blocks of fixed size, the last one filled with zeros;
    each block transposed to planes of unit bits (1 or 8), as many as the largest id needs; each
    plane of each block a zstandard frame. The index before the frames has the length of each."""
    import zstandard

    ids = np.asarray(ids, dtype=np.uint32)
    planes = max(1, -(-int(ids.max(initial=0)).bit_length() // unit))
    press = zstandard.ZstdCompressor(level=level)
    frames = []
    for i in range(0, len(ids), block):
        rows = np.zeros(block, dtype=np.uint32)
        rows[: len(ids[i : i + block])] = ids[i : i + block]
        if unit == 8:
            cells = rows.astype("<u4").view(np.uint8).reshape(block, 4).T[:planes]
        else:
            bits = np.unpackbits(rows.astype("<u4").view(np.uint8).reshape(block, 4), axis=1, bitorder="little")
            cells = np.packbits(np.ascontiguousarray(bits.T[:planes]), axis=1)
        frames += [press.compress(np.ascontiguousarray(c).tobytes()) for c in cells]
    index = np.array([len(f) for f in frames], dtype="<u4").tobytes()
    return HEAD.pack(MAGIC, unit, planes, len(ids), block) + index + b"".join(frames)


def unpack_planes(chunk: bytes) -> np.ndarray:
    import zstandard

    magic, unit, planes, n, block = HEAD.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    blocks = -(-n // block)
    sizes = np.frombuffer(chunk, dtype="<u4", count=blocks * planes, offset=HEAD.size)
    ends = np.cumsum(sizes, dtype=np.int64) + HEAD.size + 4 * blocks * planes
    open_ = zstandard.ZstdDecompressor()
    out = np.zeros(blocks * block, dtype=np.uint32)
    for i in range(blocks):
        cells = np.stack([np.frombuffer(open_.decompress(chunk[ends[k] - sizes[k] : ends[k]]), dtype=np.uint8) for k in range(i * planes, (i + 1) * planes)])
        if unit == 8:
            wide = np.zeros((block, 4), dtype=np.uint8)
            wide[:, :planes] = cells.T
        else:
            bits = np.zeros((block, 32), dtype=np.uint8)
            bits[:, :planes] = np.unpackbits(cells, axis=1).T
            wide = np.packbits(bits, axis=1, bitorder="little")
        out[i * block : (i + 1) * block] = np.ascontiguousarray(wide).view("<u4").ravel()
    return out[:n]


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 2,
    unit: int = 1,
    chunk_ids: int = 1 << 19,
    block: int = 65536,
) -> None:
    """Writes the ids of all texts, in ascending key order (null first), to the folder path.

    The folder is a Parquet table with a row for each chunk: part and chunk (their order), the keys
    of its documents, how many ids each has, and the packed planes. A chunk ends with the document
    that fills it, so each row can be read alone. Null and empty texts have the end id only.
    Repeated keys stand side by side, ordered by text; every row is written. An empty table writes
    no chunk. Other columns are ignored; extra memory of a task is one chunk and one text.

    One range shuffle of the texts; ids and planes are made where the sorted texts are, then written."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, chunk = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        keys, counts, ids, total = [], [], [], 0

        def row() -> pa.RecordBatch:
            packed = pack_planes(np.concatenate(ids), unit=unit, block=block)
            return pa.RecordBatch.from_pydict({"part": [part], "chunk": [chunk], "keys": [keys], "counts": [counts], "n_ids": [total], "planes": [packed]}, schema=schema)

        for s in slices(batches, "text"):
            flat, n = coder.encode(raw_texts(s.column("text")))
            keys += s.column("doc_id").to_pylist()
            counts += n.tolist()
            ids.append(flat)
            total += len(flat)
            if total >= chunk_ids:
                yield row()
                keys, counts, ids, total, chunk = [], [], [], 0, chunk + 1
        if keys:
            yield row()

    schema = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("planes", pa.binary())])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("_h"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    table = ordered.mapInArrow(encode, "part bigint, chunk bigint, keys array<bigint>, counts array<bigint>, n_ids bigint, planes binary")
    table.write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits) of
    each document in the files. Each chunk is decoded by itself; nothing is shuffled but the sums
    of the parts."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, keys, counts, planes in zip(*(batch.column(c).to_pylist() for c in ("_base", "_before", "keys", "counts", "planes")), strict=True):
                raw = unpack_planes(planes).astype("<u4").tobytes()
                n = np.array(counts, dtype=np.int64)
                ends = np.cumsum(n)
                ids = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends - n + part + before), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    from pyspark.sql.window import Window

    chunks = spark.read.parquet(path)
    index = chunks.select(F.col("part").alias("_part"), F.col("chunk").alias("_chunk"), "n_ids")
    earlier = Window.partitionBy("_part").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("_before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    totals = index.groupBy("_part").agg(F.sum("n_ids").alias("_sum"))
    starts = with_base(index, totals).drop("n_ids")
    rows = chunks.join(starts, (chunks["part"] == starts["_part"]) & (chunks["chunk"] == starts["_chunk"]))
    return rows.select("_base", "_before", "keys", "counts", "planes").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
