"""What the operators of this subpackage share: intermediate tables, Arrow slices, running sums, words."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.session import shared_folder

#: A word, in Java's and in RE2's syntax: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables made within: for steps whose result is written by then."""
    begin = len(_made)
    try:
        yield
    finally:
        for path in _made[begin:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _made[begin:]


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read again: it cuts the lineage, and a lost
    executor costs no recomputation of what was written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about most bytes of a column, so that what a task
    makes of its rows at once is bounded however many rows a batch has. One longer text is a slice."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        if batch.num_rows:
            sizes[:] = np.diff(_offsets(batch.column(column)))
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n + 64
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def raw_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column without nulls, one after the other, and where
    each begins (one more entry than texts)."""
    at = _offsets(column)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def with_running_sum(df: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """df with out: the sum of value over all rows that stand before, in the order of all rows.

    One range shuffle; each range is summed as a stream, and the sums of whole ranges (a row for
    each range, as few as there are shuffle partitions, so broadcast) come on top. The result is
    read from a stored table: ranges that a lost executor made are not dealt anew."""
    fields = df.columns

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) + total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part)), pa.array(ends - sizes)], [*fields, "_part", "_within"])
            total = int(ends[-1]) if len(ends) else total

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(within, f"{ddl}, _part bigint, _within bigint"), name)
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    return with_base(rows, totals).withColumn(out, F.col("_base") + F.col("_within")).drop("_part", "_within", "_base")


def with_base(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """rows (with _part) and _base: the sum of _sum over all lower parts. totals has a row for each
    part; parts are shuffle partitions, so this side is a few KB whatever the input."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_part")
