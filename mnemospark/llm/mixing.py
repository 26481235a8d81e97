"""Mixing sources to target weights with Efraimidis-Spirakis keys, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.llm.common import WORD, stored

#: Slices of a source's key order. A slice is what one task sorts: a source of 10**9 documents
#: gives slices of about 60,000.
SLICES = 16384


def word_count(text: Column) -> Column:
    """Words of a text (runs of anything but ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A quality weight over 0 and at most 1: the share of characters that are neither symbols
    nor in a line that stands earlier in the text. 1 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    size = F.length(t)
    unique = F.aggregate(F.array_distinct(lines), F.lit(0), lambda n, x: n + F.length(x) + 1) - 1
    symbols = F.regexp_count(t, F.lit("[#*$%&|<>!]"))
    share = (unique - symbols) / F.greatest(size, F.lit(1))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.greatest(share, F.lit(0.05))).cast("double")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sizes: one row a source (_s, source, source_size). Adds target: share of the total, dealt by
    weight; a target stops at most times its source's size and the excess goes to the others by
    weight, until none is above.

    The sources that stop are those with the least size per weight, so one running sum in that
    order finds the level at which the dealing ends. Weights repeat over the sources in code point
    order, null last. The table has a row per source, never per document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    line = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    fill = line.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        sizes.withColumn("_w", deal)
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", share * F.sum("source_size").over(every))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(fill), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_place", F.row_number().over(line))
    )
    # the first source, in the order of the running sums, that isn't above its cap at its level sets the
    # level of all; of sources with one ratio, the levels of later ones hold only if the first is capped
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_place", "_level"))).over(every)
    return t.select("_s", "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_w") * level["_level"], F.col("_cap"))).alias("target"))


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    quality: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """One row per document: key, size, source_size, target, epochs, taken, and _h, its text's hash.

    Every source is taken whole target // size times; what is left of its target is filled by
    weighted sampling without replacement: a document's key is an exponential variate divided by
    its quality, documents are taken in ascending key order, and the one that crosses the budget
    is taken in part. So a source's taken words equal its target, rounded to whole words.

    Nulls: a null text has size 0; a null source is a source of its own, ordered last; null keys
    keep their rows. Repeated rows are documents of their own, ordered by key then row hash: equal
    rows are interchangeable. An empty table gives an empty result. Other columns are ignored. The
    variate depends on key (where null, on the text) and seed alone, so reruns agree.

    Scale: the text is read once and stays where it is; only (key, source, size, sort key) move.
    A source's order is cut in SLICES by the sort key's own distribution; running sums go over the
    slices first, then within each, so a source with a third of all rows is spread over all tasks."""
    t = F.col(text)
    drawn = F.when(F.col("doc_id").isNull(), F.xxhash64("_h", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed)))
    u = (F.shiftrightunsigned(drawn, 11) + 1) / F.lit(float(2**53 + 1))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(t).alias("size"),
        (quality if quality is not None else text_quality(t)).cast("double").alias("_q"),
        F.xxhash64(t).alias("_h"),
    ).select(
        "doc_id",
        "source",
        "size",
        (-F.log(u) / F.greatest(F.coalesce(F.col("_q"), F.lit(1.0)), F.lit(1e-6))).alias("_key"),
        "_h",
    )
    # a null source gets a name of its own, so that plain equality joins and windows agree on a shuffle
    rows = rows.withColumn("_s", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source")))
    # key / (1 + key) spreads exponential keys about evenly over 0 to 1, for weights near 1 and far below
    rows = stored(rows.withColumn("_slice", F.floor(F.col("_key") / (1 + F.col("_key")) * SLICES).cast("int")), "mix")
    slices = stored(rows.groupBy("_s", "source", "_slice").agg(F.sum("size").alias("_sum")), "mix-slices")
    targets = source_targets(slices.groupBy("_s", "source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("_s").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("_s", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    known = starts.join(targets.drop("source"), "_s")
    inside = Window.partitionBy("_s", "_slice").orderBy("_key", "doc_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = rows.join(known, ["_s", "_slice"])
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least(F.greatest(left - F.col("_start") - F.col("_before"), F.lit(0)), F.col("size"))
    return both.withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "_h"
    )


def mixed_rows(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of docs that it takes, each as often as it is taken, whole times
    first; a part counts as a time. Columns of docs, then mix_epoch (0, 1, ...). Rows are matched by key
    (null like any other), source and text; rows alike in all three are taken as often as the one
    taken most."""
    source, text = options.get("source", "source"), options.get("text", "text")
    taken = mix(docs, key=key, **options).where("taken > 0").select(F.col("doc_id").alias("_mix_key"), F.col("source").alias("_mix_source"), F.col("_h").alias("_mix_hash"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("_times"))
    taken = taken.groupBy("_mix_key", "_mix_source", "_mix_hash").agg(F.max("_times").alias("_times"))
    same = docs[key].eqNullSafe(taken["_mix_key"]) & docs[source].cast("string").eqNullSafe(taken["_mix_source"]) & (F.xxhash64(docs[text]) == taken["_mix_hash"])
    return docs.join(taken, same).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_mix_key", "_mix_source", "_mix_hash", "_times")
