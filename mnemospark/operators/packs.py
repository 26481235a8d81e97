"""Context packs: the best memories of each query within a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.operators.rows import best_per_key

#: Memories in a pack, its characters, its references and their characters (fixed values).
MOST, BUDGET, MOST_REFERENCES, REFERENCE_LENGTH = 10, 20_000, 20, 300
#: Stored statuses and lifecycle states that a pack takes (fixed values).
RECALLED, LIVING = ("SAVED", "SAVED_WITH_WARNINGS", "REDACTED_AND_SAVED"), ("active", "current")


def section(scope: Column) -> Column:
    return F.when(scope.isin("GLOBAL", "PROJECT"), "Project Context").when(scope.isin("AGENT", "USER"), "Agent Context").otherwise("Session Context")


def trimmed(text: Column, limit: Column) -> Column:
    """text in at most limit characters, the last an ellipsis where some were cut."""
    cut = F.concat(F.substring(text, F.lit(1), (limit - 1).cast("int")), F.lit("…"))
    return F.when(limit <= 0, "").when(F.length(text) <= limit, text).otherwise(cut)


def eligible(status: Column, archived: Column, lifecycle: Column) -> Column:
    """Whether a match may be in a pack: not archived, stored, and living where it has a lifecycle state.
    A null status is not stored; a null archived is not archived."""
    return ~F.coalesce(archived, F.lit(False)) & F.coalesce(status.isin(*RECALLED), F.lit(False)) & F.coalesce(F.lower(lifecycle).isin(*LIVING), F.lit(True))


def selected(matches: DataFrame, query: str, context: str, most: int = MOST) -> DataFrame:
    """Each query's `most` best contexts with all columns of their best match, and _n, their place from 1. Of a context's
    matches the best counts, the first of equals; contexts go by score, equals by their first position."""
    first = matches.groupBy(query, context).agg(F.min("position").alias("_first"))
    best = best_per_key(matches, [query, context], [F.desc("score"), F.asc("position")]).join(first, [query, context])
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "_first", context))
    return best.withColumn("_n", place).where(F.col("_n") <= most).drop("_first")


def evidence_references(chosen: DataFrame, query: str, lists: list[str], most: int = MOST_REFERENCES) -> DataFrame:
    """query, place (from 1), reference: what the contexts of a pack (rows of selected()) refer to, at most `most` a query.

    lists: array columns, read one after the other within a context. Blank and null references are left out, long ones cut
    as trimmed() does; of equal ones the first counts. References are rows, so a context may have any number."""
    every = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))
    rows = chosen.select(query, "_n", F.posexplode(every).alias("_at", "reference")).where(F.col("reference").rlike(r"[^\s\p{Z}]"))
    rows = rows.withColumn("reference", trimmed(F.col("reference"), F.lit(REFERENCE_LENGTH)))
    first = rows.groupBy(query, "reference").agg(F.min(F.struct("_n", "_at")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("_first"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(query, "place", "reference")


def context_pack(matches: DataFrame, query: str, context: str, *, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """query, position, context, score, section, content of each query's pack.

    matches: query, context (the canonical id), position in the recall, score, scope, text; see selected()
    for which of them are in it. What is left of the budget is shared evenly among the contexts still
    to come. A pack is at most `most` rows, so it is small enough for one array."""
    rows = selected(matches, query, context, most)
    entry = F.struct("_n", F.col(context).alias("context"), "score", section(F.col("scope")).alias("section"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    packs = rows.groupBy(query).agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def share(state: Column, entry: Column) -> Column:
        part = F.floor(state["left"] / (F.size("entries") - F.size(state["texts"])))
        text = trimmed(entry["text"], part)
        return F.struct((state["left"] - F.length(text)).cast("long").alias("left"), F.concat(state["texts"], F.array(text)).alias("texts"))

    none = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("texts"))
    texts = F.aggregate("entries", none, share, lambda s: s["texts"])
    out = packs.select(query, F.explode(F.arrays_zip("entries", texts.alias("content"))).alias("e"))
    return out.select(query, F.col("e.entries._n").alias("position"), F.col("e.entries.context").alias(context), F.col("e.entries.score").alias("score"), F.col("e.entries.section").alias("section"), F.col("e.content").alias("content"))
