"""Lexical and vector recall, best-lane fusion, confidence, retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemospark.functions.text import cosine_to, distance_score, word_tokens

#: Rank constant of reciprocal-rank fusion and the vector lane's factor (fixed values).
RANK_CONSTANT, VECTOR_FACTOR = 60, 1.01


def query_tokens(query: str, most: int = 32, longest: int = 64) -> list[str]:
    import regex

    return [t[:longest].lower() for t in regex.findall(r"[\p{L}\p{N}_]+", query)[:most]]


def token_tests(text: Column, query: str) -> tuple[Column, Column]:
    """Whether every token of the query begins some word of the text, and how many words they begin. An
    empty query matches none.

    A plain search for the tokens decides about most texts, and only those with all tokens at words' begins
    are counted. A pattern begins with its token and looks back from its end, so that the engine stops at
    the token's places alone; nothing is split into arrays, so texts of any length cost their bytes."""
    tokens = list(dict.fromkeys(query_tokens(query)))
    if not tokens:
        return F.lit(False), F.lit(0)
    low, begins = F.lower(text), [rf"{t}(?<![\p{{L}}\p{{N}}_]{t})" for t in tokens]
    found = [*(low.contains(t) for t in tokens), *(low.rlike(b) for b in begins)]
    return reduce(lambda a, b: a & b, found), reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(b)) for b in begins])


def lexical_match(docs: DataFrame, text: str, query: str) -> DataFrame:
    """docs with hits and score where token_tests() finds the query: rank is a tenth of the hits, score
    rank / (1 + rank). This reads all texts; text_index answers from an index."""
    found, hits = token_tests(F.col(text), query)
    rank = F.col("hits") * F.lit(0.1)
    return docs.where(found).withColumn("hits", hits).withColumn("score", rank / (1 + rank))


def vector_recall(vectors: DataFrame, key: str, column: str, query: list[float], k: int, norm: str | None = None) -> DataFrame:
    """key, distance, score of the k vectors nearest to query by cosine; ties by key. An empty query
    (none was found) matches nothing. norm: a column with the vectors' lengths, where one is stored."""
    rows = vectors if query else vectors.where(F.lit(False))
    scored = rows.select(key, (1 - cosine_to(F.col(column), list(query), F.col(norm) if norm else None)).alias("distance"))
    return scored.withColumn("score", distance_score(F.col("distance"))).orderBy("distance", key).limit(k)


def ranked(lane: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """key and rank (from 1) of a lane's first k rows."""
    top = lane.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, "rank")


def fuse(lexical: DataFrame, vector: DataFrame, key: str, k: int) -> DataFrame:
    """key, score, lane of the k best: each lane gives 1 / (60 + rank), the vector lane 1.01 times
    that; a key counts by its best lane, not by the sum. Ties: the lexical lane, then the rank."""
    a = lexical.select(key, "rank", F.lit("lexical").alias("lane"), (F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))).alias("score"))
    b = vector.select(key, "rank", F.lit("vector").alias("lane"), (F.lit(VECTOR_FACTOR) / (RANK_CONSTANT + F.col("rank"))).alias("score"))
    best = a.union(b).groupBy(key).agg(F.max_by(F.struct("score", "lane", "rank"), F.struct("score", F.col("lane") == "lexical")).alias("_b"))
    return best.select(key, "_b.score", "_b.lane", "_b.rank").orderBy(F.desc("score"), "lane", "rank").limit(k).select(key, "score", "lane")


def confidence(scores: list[Column], exact: Column) -> Column:
    """1 for an exact hit; else the largest score within 0 to 1, and a tenth more where several are known."""
    known = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in scores), F.lit(0))
    top = F.greatest(*[F.least(F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for s in scores])
    return F.when(exact, F.lit(1.0)).otherwise(F.least(top + F.when(known >= 2, 0.1).otherwise(0.0), F.lit(1.0)))


def retrieval_metrics(hits: DataFrame, expected: DataFrame, case: str, item: str) -> DataFrame:
    """For each case of expected: recall at 1, 3 and 5 (1 where any of its items is among so many hits),
    reciprocal rank, nDCG at 5. hits has a rank from 1; cases without hits count 0."""
    found = expected.join(hits, [case, item], "left")
    size = F.count(F.lit(1))
    at = lambda n: F.max(F.coalesce(F.col("rank") <= n, F.lit(False)).cast("double"))
    gain = F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(size, F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return found.groupBy(case).agg(
        F.round(at(1), 6).alias("recall_1"), F.round(at(3), 6).alias("recall_3"), F.round(at(5), 6).alias("recall_5"),
        F.round(F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)), 6).alias("rr"), F.round(gain / ideal, 6).alias("ndcg_5"),
    )


#: The classes of cases that single metrics are about, and each metric's test where it is one (fixed values).
WITHIN_3 = {"experiential_recall": "EXPERIENTIAL_RECALL", "procedural_recall": "PROCEDURAL_RECALL", "cross_language": "CROSS_LANGUAGE"}


def case_metrics(cases: DataFrame, truth: DataFrame, hits: DataFrame) -> DataFrame:
    """case and its metrics; null where one doesn't apply to the case.

    cases: case, query_class, abstains (nothing should be found), least (expected items that must be
    found), required and seen (arrays of graph relations), least_distance, seen_distance. truth: case,
    item, expected (false: forbidden). hits: case, item, rank from 1. Beside the five of
    retrieval_metrics(), which don't apply to cases that abstain: obsolete_rate (forbidden among the first
    five), temporal_correctness, superseded_leakage, current_precision, experiential_recall,
    procedural_recall, wrong_premise, conflict_collapse, wrong_memory, abstention, multi_hop, cross_language.

    Both tables are summed up by case before they meet the cases, so a case costs a row."""
    known = truth.groupBy("case").agg(F.count_if("expected").alias("_e"), F.count_if(~F.col("expected")).alias("_f"))
    rank, good, bad = F.col("rank"), F.coalesce("expected", F.lit(False)), F.coalesce(~F.col("expected"), F.lit(False))
    once = hits.groupBy("case", "item").agg(F.min("rank").alias("rank"))
    seen = once.join(truth, ["case", "item"], "left").groupBy("case").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(good, rank)).alias("_first"), F.count_if(good & (rank <= 5)).alias("_good"), F.count_if(bad & (rank <= 5)).alias("_bad"),
        F.sum(F.when(good & (rank <= 5), 1 / F.log2(rank + 1)).otherwise(0.0)).alias("_gain"),
    )
    rows = cases.join(known, "case", "left").join(seen, "case", "left").fillna(0, ["_e", "_f", "_n", "_good", "_bad", "_gain"])
    c, answers = F.col, ~F.col("abstains")
    number = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    of = lambda kind, value: F.when(c("query_class") == kind, value)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("_e", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    enough = c("_good") >= c("least")
    walked = (F.size(F.array_except("required", "seen")) == 0) & (c("seen_distance") >= c("least_distance"))
    metrics = {f"recall_{n}": F.when(answers, number(c("_first") <= n)) for n in (1, 3, 5)} | {
        "rr": F.when(answers, F.coalesce(1 / c("_first"), F.lit(0.0))),
        "ndcg_5": F.when(answers & (c("_e") > 0), c("_gain") / ideal),
        "obsolete_rate": F.when(c("_f") > 0, c("_bad") / F.greatest(F.lit(1), F.least(c("_n"), F.lit(5)))),
        "temporal_correctness": of("TEMPORAL_CURRENT_STATE", number((c("_first") == 1) & (c("_bad") == 0))),
        "superseded_leakage": of("SUPERSESSION", number(c("_bad") > 0)),
        "current_precision": F.when(c("query_class").isin("TEMPORAL_CURRENT_STATE", "SUPERSESSION"), c("_good") / F.greatest(F.lit(1), c("_good") + c("_bad"))),
        "wrong_premise": of("WRONG_PREMISE", number((c("_first") <= 3) & (c("_bad") == 0))),
        "conflict_collapse": of("CONFLICT_PRESERVATION", number(~enough)),
        "wrong_memory": F.when(answers, number(c("_first").isNull() | (c("_bad") > 0))).otherwise(number(c("_n") > 0)),
        "abstention": F.when(c("abstains"), number(c("_n") == 0)),
        "multi_hop": of("MULTI_HOP_GRAPH", number(enough & walked)),
    } | {name: of(kind, number(c("_first") <= 3)) for name, kind in WITHIN_3.items()}
    return rows.select("case", "query_class", *[F.round(m, 6).alias(name) for name, m in metrics.items()])


def mean_metrics(metrics: DataFrame, by: str) -> DataFrame:
    """by, cases and the mean of each metric over the cases it applies to; null where it applies to none."""
    names = [c for c in metrics.columns if c not in ("case", by)]
    return metrics.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def lexical_words(text: Column) -> Column:
    return F.transform(word_tokens(text), F.lower)
