"""The change log as a stream: bounded delta reads, deduplicated submissions, windowed counts."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a cursor says beside its place, and the most bytes of a page (fixed values).
VERSION, SCOPE, PAGE_BYTES = 1, "context-change-log", 262_144


def delta(log: DataFrame, cursor: int, most: int = 64, sequence: str = "sequence") -> DataFrame:
    """The next most rows after cursor, in order, and has_more on each."""
    rows = log.where(F.col(sequence) > cursor).orderBy(sequence).limit(most + 1)
    n = rows.agg(F.count(F.lit(1)).alias("_n"), F.max(sequence).alias("_last"))
    more = F.col("_n") > most
    return rows.join(F.broadcast(n)).where(~more | (F.col(sequence) < F.col("_last"))).withColumn("has_more", more).drop("_n", "_last")


def cursor_token(last: int) -> str:
    """An opaque token of the place up to which a log was read."""
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "scope": SCOPE, "last_sequence": last}, separators=(",", ":")).encode()).decode()


def cursor_place(token: str) -> int:
    """The place a token stands for. ValueError for what is no token; LookupError for a token of
    another version or log, after which a reader begins anew."""
    try:
        fields = json.loads(base64.urlsafe_b64decode(token.encode("ascii")))
    except ValueError as e:
        raise ValueError("the cursor cannot be read") from e
    if not isinstance(fields, dict) or set(fields) != {"v", "scope", "last_sequence"}:
        raise ValueError("the cursor has other fields")
    if (fields["v"], fields["scope"]) != (VERSION, SCOPE):
        raise LookupError("the cursor is of another version or log")
    last = fields["last_sequence"]
    if type(last) is not int or last < 0:
        raise ValueError("the cursor has no place")
    return last


def delta_page(log: DataFrame, cursor: str | None, most: int = 64, most_bytes: int = PAGE_BYTES, sequence: str = "sequence") -> DataFrame:
    """The next rows after a cursor (None: from the beginning), in order, with has_more and next_cursor on
    each: most of them at most, and no more than most_bytes as JSON but for the first, which always comes.

    most + 1 rows are taken by their order before anything is summed, so the windows see so many."""
    rows = log.where(F.col(sequence) > (0 if cursor is None else cursor_place(cursor))).orderBy(sequence).limit(most + 1)
    order, size = Window.orderBy(sequence), F.octet_length(F.to_json(F.struct(*log.columns)))
    rows = rows.select("*", F.row_number().over(order).alias("_r"), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_b"))
    fits = (F.col("_r") == 1) | ((F.col("_r") <= most) & (F.col("_b") <= most_bytes))
    everything = Window.partitionBy(F.lit(1))
    rows = rows.select("*", F.count(F.lit(1)).over(everything).alias("_n"), F.count_if(fits).over(everything).alias("_k"), F.max(F.when(fits, F.col(sequence))).over(everything).alias("_last"))
    text = F.concat(F.lit(f'{{"v":{VERSION},"scope":"{SCOPE}","last_sequence":'), F.col("_last").cast("string"), F.lit("}"))
    token = F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")
    return rows.where(fits).select(*log.columns, (F.col("_n") > F.col("_k")).alias("has_more"), token.alias("next_cursor"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, cooldown: str) -> DataFrame:
    """A stream without the rows whose keys came within the cooldown before; late rows go."""
    return stream.withWatermark(time, cooldown).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], value: str, width: str, slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Count and sum of value in tumbling or sliding windows; works on streams and on tables.
    late is None for a stream that has its watermark already."""
    rows = stream.withWatermark(time, late) if stream.isStreaming and late else stream
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str | None = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(time, late) if stream.isStreaming and late else stream
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), *by, "n")
