"""Search from the query to the answer: variants, plans, ranks, lanes, cascades, outcomes.

What decides about one query is plain Python on the driver; the same rules over a table of queries are
column expressions. Everything that touches documents is DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import once, single_spaced, word_tokens
from mnemospark.operators import retrieval
from mnemospark.operators.graph import checkpointed
from mnemospark.operators.rows import best_per_key

#: Words that focused variants of a query leave out (fixed values).
STOP_WORDS = frozenset("about find how please show what when where why 관련 뭐가 무엇 알려줘 어떻게 위해서 있을까요 찾아줘 해주세요".split())
#: Where a query is cut into segments (fixed pattern).
SEGMENT = re.compile(r"[,;\n.!?。]+")
#: What a query's intent is told by, in the order in which they are looked for (fixed values).
MARKERS = {
    "TEMPORAL_CURRENT_STATE": ["현재 상태", "최신", "지금", "최종", "승인된", "current state", "latest", "right now", "final state", "final seal"],
    "EXPERIENTIAL": ["예전에", "전에 비슷", "이전에 비슷", "과거에 비슷", "경험", "교훈", "원인이", "고쳤", "문제와 해결", "이유와 결과", "검증한 결과", "실제 성능을 검증", "다시 겪지", "장애", "버그", "incident", "previous issue", "similar issue", "lessons learned", "root cause", "bug"],
    "PROCEDURAL": ["순서", "절차", "세팅", "재현하려", "따라가", "작업 전에", "어떻게 진행", "진행 방법", "방법 알려", "how to", "steps", "procedure", "setup", "reproduce"],
    "GRAPH_ORIENTED": ["무엇과 관련", "어떤 관계", "관계가", "관계 evidence", "연결되어", "연결된", "연결해", "영향 관계", "graph", "graph path", "evidence chain", "lineage", "relation evidence", "related to", "relationship", "dependency graph", "impact graph"],
    "SEMANTIC": ["알려줘", "설명해", "찾아줘", "무엇", "뭐가", "왜", "what", "why", "explain", "find"],
}
QUERY_TOKEN, DATE_TOKEN = r"[0-9A-Za-z가-힣_./:+-]+", r"\b20\d{2}-\d{2}-\d{2}\b"
TITLE_TOKENS, TITLE_CHARS, MULTIPLIER, MOST_CANDIDATES, GRAPH_DEPTH = 8, 96, 6, 50, 2
#: A match is good enough from this confidence on; nearness of its project, the best first (fixed values).
CONFIDENT, AFFINITY = 0.5, ["PRIMARY", "RELATED", "GLOBAL"]


def query_variants(query: str, most: int = 16) -> list[str]:
    """The query, then for each of its segments the words that count, and windows of 4, 3 and 2 of
    them: those at either end before those within. Each variant once."""
    import regex

    found = dict.fromkeys([" ".join(query.split())])
    for segment in SEGMENT.split(query):
        words = [w for w in regex.findall(r"[\p{L}\p{N}_]+", segment) if len(w) > 1 and w.casefold() not in STOP_WORDS]
        runs = [words]
        for size in (4, 3, 2):
            if len(words) > size:
                runs += [words[:size], words[-size:], *(words[i : i + size] for i in range(1, len(words) - size))]
        found |= dict.fromkeys(" ".join(r) for r in runs)
    return [v for v in found if v][:most]


def variants(query: Column, most: int = 16) -> Column:
    """query_variants() of a column of queries: an array, empty where query is null."""
    stop = [F.lit(w) for w in sorted(STOP_WORDS)]

    def runs(segment: Column) -> Column:
        words = F.filter(word_tokens(segment), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*stop))
        none, n = F.array().cast("array<array<string>>"), F.size(words)

        def windows(size: int) -> Column:
            inner = F.when(n - size > 1, F.transform(F.sequence(F.lit(1), n - size - 1), lambda i: F.slice(words, i + 1, F.lit(size)))).otherwise(none)
            return F.when(n > size, F.concat(F.array(F.slice(words, 1, size), F.slice(words, -size, size)), inner)).otherwise(none)

        return F.concat(F.array(words), *[windows(size) for size in (4, 3, 2)])

    segments = F.split(query, SEGMENT.pattern)
    found = F.transform(F.flatten(F.transform(segments, runs)), lambda r: F.array_join(r, " "))
    every = F.array_distinct(F.concat(F.array(single_spaced(query)), found))
    return F.coalesce(F.slice(F.filter(every, lambda v: v != ""), 1, most), F.array().cast("array<string>"))


def first_variant_matches(docs: DataFrame, key: str, text: str, variants: list[str]) -> DataFrame:
    """key, hits, variant (its place, from 0) of the documents that the first variant with any match
    finds. All variants are looked for in one scan, whose matches are stored before the first is known."""
    tests = [retrieval.token_tests(F.col(text), v) for v in variants]
    each = [F.when(found, F.struct(F.lit(i).alias("variant"), hits.alias("hits"))) for i, (found, hits) in enumerate(tests)]
    met = docs.select(key, F.explode(F.array_compact(F.array(*each))).alias("m")).select(key, "m.hits", "m.variant")
    met = checkpointed(met)
    first = met.agg(F.min("variant").alias("variant"))
    return met.join(F.broadcast(first), "variant").select(key, "hits", "variant")


def hybrid_limit(k: Column) -> Column:
    """How many candidates each lane brings for k results."""
    return F.least(F.lit(MOST_CANDIDATES), F.greatest(k, MULTIPLIER * k))


def retrieval_plan(query: Column, k: Column) -> Column:
    """intent, strategy, graph, fts_budget, vector_budget, graph_depth, functions, prefers_current of a
    query. The first rule that holds tells the intent: a dated title, marks of time, experience,
    procedure or relations, a short title, a question; else MIXED."""
    flags = lambda q, f: F.struct(q.alias("q"), *[reduce(lambda a, b: a | b, [f.contains(m) for m in marks]).alias(kind) for kind, marks in MARKERS.items()], q.rlike(DATE_TOKEN).alias("dated"), F.regexp_count(q, F.lit(QUERY_TOKEN)).alias("tokens"))

    def named(s: Column) -> Column:
        title = (s["tokens"] > 0) & ~s["q"].rlike("[?!。]") & ~s["SEMANTIC"] & (s["dated"] | ((s["tokens"] <= TITLE_TOKENS) & (F.length(F.trim(s["q"])) <= TITLE_CHARS)))
        intent = F.when(s["dated"] & title, "EXACT_OR_TITLE")
        for kind in ("TEMPORAL_CURRENT_STATE", "EXPERIENTIAL", "PROCEDURAL", "GRAPH_ORIENTED"):
            intent = intent.when(s[kind], kind)
        intent = intent.when(title, "EXACT_OR_TITLE").when(s["q"].contains("?") | s["SEMANTIC"], "SEMANTIC_PARAPHRASE").otherwise("MIXED")
        return F.struct(intent.alias("intent"), s["GRAPH_ORIENTED"].alias("relations"))

    def planned(s: Column) -> Column:
        intent, exact = s["intent"], s["intent"] == "EXACT_OR_TITLE"
        graph = ~exact & s["relations"]
        return F.struct(
            intent.alias("intent"), F.when(exact, "FTS_ONLY").otherwise("HYBRID").alias("strategy"), graph.alias("graph"),
            F.when(exact, k).otherwise(hybrid_limit(k)).alias("fts_budget"), F.when(exact, F.lit(0)).otherwise(hybrid_limit(k)).alias("vector_budget"),
            F.when(graph, GRAPH_DEPTH).otherwise(0).alias("graph_depth"), F.when(intent.isin("EXPERIENTIAL", "PROCEDURAL"), intent).alias("functions"),
            (intent == "TEMPORAL_CURRENT_STATE").alias("prefers_current"),
        )

    return once(once(once(query, lambda q: once(F.lower(single_spaced(q)), lambda f: flags(q, f))), named), planned)


def execution(asked: Column, plan: Column, k: Column, native: Column) -> Column:
    """What is run for an asked strategy: AUTO follows the plan, with lanes of at most native candidates
    each; a fixed strategy runs as it is, with graph evidence."""
    auto = asked == "AUTO"

    def run(p: Column) -> Column:
        budget = F.least(native, F.greatest(k, p["fts_budget"]))
        return F.struct(F.when(auto, p["strategy"]).otherwise(asked).alias("strategy"), F.when(auto, p["graph"]).otherwise(F.lit(True)).alias("graph"), F.when(auto, budget).otherwise(native).alias("budget"))

    return once(plan, run)


# -- ranks -------------------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """token, key, n: how often each document has each word (lower case). Written once, partitioned by
    the tokens' first signs, it answers a query by ranges of tokens instead of a scan of all texts."""
    return docs.select(key, F.explode(word_tokens(F.lower(F.col(text)))).alias("token")).groupBy("token", key).agg(F.count(F.lit(1)).alias("n"))


def posting_match(index: DataFrame, key: str, query: str) -> DataFrame:
    """key, hits, score as lexical_match() gives them, from postings. Each token of the query is a range
    of the index's tokens, which is pushed down to its scan."""
    tokens = list(dict.fromkeys(retrieval.query_tokens(query)))
    if not tokens:
        return index.select(key, F.col("n").alias("hits"), F.lit(0.0).alias("score")).where(F.lit(False))
    begins = [(F.col("token") >= t) & F.col("token").startswith(t) for t in tokens]
    rows = index.where(reduce(lambda a, b: a | b, begins))
    counts = [F.sum(F.when(b, F.col("n")).otherwise(0)).alias(f"_{i}") for i, b in enumerate(begins)]
    found = rows.groupBy(key).agg(*counts).where(reduce(lambda a, b: a & b, [F.col(f"_{i}") > 0 for i in range(len(tokens))]))
    hits = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(len(tokens))])
    return found.select(key, hits.alias("hits"), (hits * 0.1 / (1 + hits * 0.1)).alias("score"))


def cover_density(text: Column, tokens: list[str], weight: float = 0.1) -> Column:
    """The cover density rank of a text: each shortest run of words that has all tokens (whole words,
    any case) gives weight, divided by 1 and the words in it that are none of them. 0 without a run.

    A word may stand for one token only. The runs are found in one pass over the places of the tokens."""

    @F.pandas_udf("double")
    def rank(texts: pd.Series) -> pd.Series:
        import regex

        word, place = regex.compile(r"[\p{L}\p{N}_]+"), {t: i for i, t in enumerate(tokens)}

        def one(t: str | None) -> float:
            at = [(i, place[w]) for i, w in enumerate(word.findall((t or "").lower())) if w in place]
            last, begin, total = [-1] * len(tokens), -1, 0.0
            for i, k in at:
                last[k] = i
                first = min(last)
                if first > begin:  # a shorter run than all before ends here
                    inside = sum(1 for j, _ in at[_left(at, first) : _left(at, i) + 1])
                    total += weight / (1 + max(i - first + 1 - inside, 0))
                    begin = first
            return total

        return texts.map(one)

    return rank(text)


def _left(at: list[tuple[int, int]], place: int) -> int:
    from bisect import bisect_left

    return bisect_left(at, (place, -1))


def note_search(notes: DataFrame, query: str, k: int, *, title: str = "title", aliases: str = "aliases", text: str = "text", modified: str = "modified_at", key: str = "note_id", keep: Column | None = None) -> DataFrame:
    """key, score of the k best notes (of those that keep, such as filters.note_filter(), accepts): the lexical score of the text, 1 more where the title is the query
    and 1 more where an alias is. Candidates are found by text, title or alias. A query without words
    gives the notes modified last, with score 0."""
    notes = notes if keep is None else notes.where(keep)
    if not retrieval.query_tokens(query):
        return notes.orderBy(F.desc(modified), key).limit(k).select(key, F.lit(0.0).alias("score"))
    flat = lambda c: F.lower(single_spaced(c))
    same_title, same_alias = flat(F.col(title)) == flat(F.lit(query)), F.exists(aliases, lambda a: flat(a) == flat(F.lit(query)))
    lexical = retrieval.lexical_match(notes, text, query).select(key, F.col("score").alias("_lex"))
    named = notes.select(key, F.coalesce(same_title, F.lit(False)).cast("int").alias("_t"), F.coalesce(same_alias, F.lit(False)).cast("int").alias("_a"))
    rows = named.join(lexical, key, "left").where("_lex is not null or _t > 0 or _a > 0")
    return rows.select(key, (F.coalesce("_lex", F.lit(0.0)) + F.col("_t") + F.col("_a")).alias("score")).orderBy(F.desc("score"), key).limit(k)


def context_recall(chunks: DataFrame, query: str, k: int, keep: Column, *, context: str = "note_id", text: str = "content") -> DataFrame:
    """context, score of the k best contexts: the best chunk of each counts, chunks without text and rows
    that keep rejects are left out before the limit, so nothing is lost to over-fetching."""
    rows = chunks.where((F.trim(F.coalesce(text, F.lit(""))) != "") & keep)
    found = retrieval.lexical_match(rows, text, query).groupBy(context).agg(F.max("score").alias("score"))
    return found.orderBy(F.desc("score"), context).limit(k)


def fusion_trace(lexical: DataFrame, vector: DataFrame, key: str, k: int) -> DataFrame:
    """One row of what a fusion did: rows, different and repeated keys of each lane, keys of both, results."""
    both = lexical.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_v")).union(vector.select(key, F.lit(0), F.lit(1)))
    per = both.groupBy(key).agg(F.sum("_l").alias("l"), F.sum("_v").alias("v"))
    n = F.coalesce
    zero = F.lit(0)
    out = per.agg(
        n(F.sum("l"), zero).alias("lexical_rows"), F.count_if(F.col("l") > 0).alias("lexical_unique"), n(F.sum("v"), zero).alias("vector_rows"), F.count_if(F.col("v") > 0).alias("vector_unique"),
        F.count_if((F.col("l") > 0) & (F.col("v") > 0)).alias("cross_lane"), F.count(F.lit(1)).alias("fused"),
    )
    return out.select("*", (F.col("lexical_rows") - F.col("lexical_unique")).alias("lexical_repeated"), (F.col("vector_rows") - F.col("vector_unique")).alias("vector_repeated"), F.least("fused", F.lit(k)).alias("returned"))


# -- cascades ----------------------------------------------------------------------------------------


class LaneUnavailable(RuntimeError):
    """A lane of a search cannot answer now."""


def resolve_scopes(requested: list[str], identities: dict[str, str | None], strict: bool) -> tuple[list[str], list[str]]:
    """The scopes to search and those left out for want of an identity. strict: a missing one is an error;
    else, with nothing left, GLOBAL is searched."""
    asked = list(dict.fromkeys(requested or (["GLOBAL"] if strict else ["PROJECT", "AGENT", "SESSION", "USER", "GLOBAL"])))
    missing = [s for s in asked if s != "GLOBAL" and identities.get(s) is None]
    if strict and missing:
        raise ValueError(f"no identity for {', '.join(missing)}")
    return [s for s in asked if s not in missing] or ["GLOBAL"], [f"{s}:identity_unavailable" for s in missing]


def scopes(requested: Column, have: Column, strict: Column) -> Column:
    """resolve_scopes() of columns: searched (null where strict and a scope has no identity, which is an
    error) and skipped. have: the scopes with an identity."""
    lits = lambda names: F.array(*map(F.lit, names))
    asked = F.array_distinct(F.when(F.coalesce(F.size(requested), F.lit(0)) > 0, requested).when(strict, lits(["GLOBAL"])).otherwise(lits(["PROJECT", "AGENT", "SESSION", "USER", "GLOBAL"])))
    missing = F.filter(asked, lambda s: (s != "GLOBAL") & ~F.array_contains(have, s))
    left = F.array_except(asked, missing)
    searched = F.when(~(strict & (F.size(missing) > 0)), F.when(F.size(left) > 0, left).otherwise(lits(["GLOBAL"])))
    return F.struct(searched.alias("searched"), F.transform(missing, lambda s: F.concat(s, F.lit(":identity_unavailable"))).alias("skipped"))


def deduplicated(matches: DataFrame, limit: int) -> DataFrame:
    """The best match of each context (context, affinity, confidence, score, ...): the nearest project, then
    confidence, then score; the first limit in that order."""
    near = F.array_position(F.array(*map(F.lit, AFFINITY)), F.col("affinity"))
    order = [near.asc(), F.desc("confidence"), F.desc("score"), F.asc("context")]
    return best_per_key(matches, ["context"], order).orderBy(*order).limit(limit)


def cascade(stages: list[tuple[str, Callable[[], DataFrame]]], limit: int) -> tuple[DataFrame, list[str]]:
    """The matches of stages run one after the other until one brings a confident match, and the names of
    those that ran. Each is run once, and its rows are stored. A stage that fails in Spark or is unavailable is
    left out and named with :failed; other errors are the caller's."""
    found: DataFrame | None = None
    ran: list[str] = []
    for name, stage in stages:
        try:
            rows = checkpointed(stage())
            sure = not rows.where(F.col("confidence") >= CONFIDENT).isEmpty()
        except (PySparkException, LaneUnavailable):  # a lane that is down must not take the others with it
            ran.append(f"{name}:failed")
            continue
        ran.append(name)
        found = rows if found is None else found.unionByName(rows)
        if sure:
            break
    if found is None:
        raise RuntimeError(f"no stage could run: {', '.join(ran)}")
    return deduplicated(found, limit), ran


def outcome(matches: DataFrame, degraded: bool) -> DataFrame:
    """One row: outcome, confidence, matches."""
    best, n = F.coalesce(F.max("confidence"), F.lit(0.0)), F.count(F.lit(1))
    word = F.when(best >= CONFIDENT, "MATCHED").when(F.lit(degraded), "DEGRADED_SEARCH").when(n > 0, "NO_CONFIDENT_MATCH").otherwise("SEARCH_EXHAUSTED")
    return matches.agg(word.alias("outcome"), best.alias("confidence"), n.alias("matches"))


def exact_selector(notes: DataFrame, *, note_id=None, path: str | None = None, identity: dict | None = None) -> DataFrame:
    """The one note that an id, a path (./ and a missing .md don't count) or a logical identity names;
    none where it names none or several."""
    if note_id is not None:
        found = notes.where(F.col("note_id") == note_id)
    elif path is not None:
        name = re.sub(r"^(\./)+", "", path.strip())
        found = notes.where(F.col("relative_path") == (name if name.lower().endswith(".md") else name + ".md"))
    else:
        flat = lambda c: F.lower(single_spaced(c))
        found = notes.where(reduce(lambda a, b: a & b, [flat(F.col(k)) == flat(F.lit(v)) for k, v in (identity or {}).items()], F.lit(bool(identity))))
    two = found.limit(2)
    return two.join(F.broadcast(two.agg(F.count(F.lit(1)).alias("_n")).where("_n = 1"))).drop("_n")


def reindex_selection(chunks: DataFrame, stale: Column, embedded_at: str, key: str, budget: int, force: bool = False) -> DataFrame:
    """The chunks to embed next, at most budget: stale ones, those never embedded first, then the oldest;
    with force, others make up what is left of the budget."""
    rows = chunks if force else chunks.where(stale)
    return rows.orderBy(F.when(stale, 0).otherwise(1), F.col(embedded_at).asc_nulls_first(), key).limit(budget)
