"""Quality rules: per-document counts and cross-document line frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import SPACE, stored

#: The characters counted as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"


def normalised(text: Column) -> Column:
    """A text whose lines are compared across documents: digits as 0, no white space but line
    feeds. (Case is dropped when a line is hashed.)"""
    return F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", ""), "[1-9]", "0")


def with_repeated_words(rows: DataFrame, words_column: str, out: str, width: int = 3) -> DataFrame:
    """rows with out: how many words of the array lie in a window of width words that is found
    twice or more in it.

    Windows are hashed to 64 bits. Most texts repeat none, which a hash set tells. For the others
    (hash, start) are sorted, so that equal windows are neighbours in the order of their starts;
    then each start of a repeated one adds the words that the starts before it don't cover. n log n
    for n words. Each step is a column of its own, so that it's computed once."""
    rows = rows.withColumn("_h", F.transform(words_column, lambda x: F.xxhash64(x)))
    keys = F.transform(F.sequence(F.lit(0), F.size("_h") - width), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(width)]))
    rows = rows.withColumn("_keys", F.when(F.size("_h") < width, F.array().cast("array<bigint>")).otherwise(keys))
    sorted_ = F.sort_array(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.cast("long").alias("i"))))
    rows = rows.withColumn("_p", F.when(F.size(F.array_distinct("_keys")) < F.size("_keys"), sorted_).otherwise(F.array().cast("array<struct<k:bigint,i:bigint>>")))
    none = F.array().cast("array<bigint>")
    same = lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(none)
    rows = rows.withColumn("_at", F.when(F.size("_p") == 0, none).otherwise(F.sort_array(F.flatten(F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), same)))))
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("long").alias("last"))
    add = lambda s, i: F.struct((s["n"] + F.least(F.lit(width).cast("long"), i - s["last"])).alias("n"), i.alias("last"))
    return rows.withColumn(out, F.when(F.size("_at") == 0, F.lit(0).cast("long")).otherwise(F.aggregate("_at", first, add, lambda s: s["n"]))).drop("_h", "_keys", "_p", "_at")


def base_features(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """One row per document with the counts and its lines as (hash, characters)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(host).cast("string").alias("host"), t.alias("_t"))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", SPACE), "")).withColumn("_n", F.split(normalised(F.col("_t")), "\n"))
    raw = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = F.transform(F.array_remove("_n", ""), lambda x: F.struct(F.xxhash64(F.lower(x)).alias("h"), F.length(x).alias("n")))
    rows = rows.select(
        "doc_id",
        "host",
        F.xxhash64("_t", F.lit(1)).alias("text_hash"),
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_n", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        F.regexp_count("_t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        raw.alias("_raw"),
        lines.alias("lines"),
        "_w",
    )
    rows = rows.withColumn("n_dup_lines", (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long")).drop("_raw")
    return with_repeated_words(rows, "_w", "n_repeat_words").drop("_w")


def host_name(host: Column) -> Column:
    """A host as a plain string; null is a host of its own."""
    return F.when(host.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), host.cast("string")))


def frequent_lines(lines: DataFrame, max_documents: int, copies_once: bool) -> DataFrame:
    """h, documents of the lines (h: hash of host and line; _row, text_hash) that over max_documents
    documents have, or where copies_once is set over so many different texts. Counts are summed
    before each shuffle."""
    seen = lines.groupBy("h", "text_hash" if copies_once else "_row").agg(F.lit(1).alias("one"))
    return seen.groupBy("h").agg(F.count("one").alias("documents")).where(F.col("documents") > max_documents)


def judge(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_documents: int = 50,
    copies_once: bool = False,
    least_words: int = 50,
    least_share: float = 0.3,
    max_repeat_share: float = 0.5,
) -> DataFrame:
    """One row per document: the base counts, base_failed, boilerplate_chars, kept.

    A line is boilerplate where over max_documents documents of its host have it (lines are compared in
    lower case, digits as 0, without white space). copies_once: equal texts count as one document, so that
    groups of exact copies, which are another operator's to thin out, don't condemn their own lines. Boilerplate lines are removed; a document that
    keeps under least_share of its characters is depleted and not kept. Before that, base rules reject
    texts under least_words words and those with over max_repeat_share of their words in repeated
    3-word windows.

    Nulls: a null text has no words, all counts 0, and fails; a null host is a host of its own.
    Repeated rows each get a row with the same verdict. Empty tables give none. Other columns are
    ignored. Texts of any length are one row; lines move as a few bytes each.

    Scale: counts are summed before each shuffle. A line that a third of all documents share is one
    key only in the last join, against the short table of boilerplate lines, which Spark splits."""
    base = base_features(docs, key, host, text).withColumn("_row", F.monotonically_increasing_id())
    base = stored(base.withColumn("_host", host_name(F.col("host"))), "rules")
    lines = base.select("_row", "_host", "text_hash", F.explode("lines").alias("l")).select("_row", F.xxhash64("_host", "l.h").alias("h"), "text_hash", F.col("l.n").alias("n"))
    frequent = stored(frequent_lines(lines, max_documents, copies_once), "rules-lines")
    removed = lines.join(frequent, "h").groupBy("_row").agg(F.sum("n").alias("boilerplate_chars"))
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > max_repeat_share * F.col("n_words"))
    left = F.col("word_chars") - F.col("boilerplate_chars")
    return (
        base.drop("lines", "text_hash", "_host")
        .join(removed, "_row", "left")
        .withColumn("boilerplate_chars", F.coalesce("boilerplate_chars", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= least_share * F.col("word_chars")))
        .select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "boilerplate_chars", "kept")
    )


def without_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", max_documents: int = 50, copies_once: bool = False) -> DataFrame:
    """docs with the lines taken out of text that judge() calls boilerplate: over max_documents documents
    of the host (with copies_once different texts) have them.

    Lines are matched by host and content, row by row; a text without such lines is unchanged, null
    stays null, a text of nothing else is empty. Repeated rows and null keys keep their rows; an empty
    table gives none; all columns of docs stay."""
    numbered = stored(docs.withColumn("_id", F.monotonically_increasing_id()), "rules-docs")
    split = numbered.select("_id", host_name(F.col(host)).alias("_host"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)).alias("text_hash"), F.posexplode(F.split(normalised(F.coalesce(F.col(text), F.lit(""))), "\n")).alias("_p", "_line")).where("_line != ''")
    split = split.select("_id", F.col("_id").alias("_row"), "_p", "text_hash", F.xxhash64("_host", F.xxhash64(F.lower("_line"))).alias("h"))
    frequent = stored(frequent_lines(split, max_documents, copies_once), "rules-lines")
    gone = split.join(frequent, "h", "left_semi").groupBy("_id").agg(F.collect_set("_p").alias("_gone"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return numbered.join(gone, "_id", "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_id", "_gone")
